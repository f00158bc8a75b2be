"""Words of whole texts, as Arrow and numpy arrays inside a task.

A word is a run of characters other than the six ASCII white-space characters
``\\x20 \\x09-\\x0D``; everything else, other Unicode spaces included, belongs to words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the batch, offsets): text ``i`` has the words ``offsets[i]:offsets[i + 1]``; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values[ends[0]:ends[-1]]
    full = np.asarray(pc.not_equal(flat, ""))
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), before[ends - ends[0]]


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(id of every word, the distinct words): equal words have equal ids."""
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, the same in every task."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of a multiply-xorshift hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


class WindowHashes:
    """Hashes of all runs of ``size`` consecutive words, built by joining halves.

    ``of(size)[i]`` belongs to the run that starts at word ``i`` of the concatenation;
    runs that leave their document are for the caller to mask (see :func:`inside`).
    """

    def __init__(self, hashes: np.ndarray):
        self.levels = {1: hashes}

    def power(self, size: int) -> np.ndarray:
        if size not in self.levels:
            half = self.power(size // 2)
            self.levels[size] = pair(half[:max(0, len(half) - size // 2)], half[size // 2:])
        return self.levels[size]

    def of(self, size: int) -> np.ndarray:
        top = 1 << (size.bit_length() - 1)
        head, at = self.power(top), top
        while at < size:
            part = 1 << ((size - at).bit_length() - 1)
            tail = self.power(part)[at:]
            head, at = pair(head[:len(tail)], tail), at + part
        return head


def inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """Mask over window starts of the concatenation: true where the window stays in one document."""
    total = int(offsets[-1])
    ok = np.zeros(max(0, total - size + 1), bool)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if hi - lo >= size:
            ok[lo:hi - size + 1] = True
    return ok


def spread(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask of the words covered by windows of ``size`` that start where ``starts`` is true."""
    step = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def give_back() -> None:
    """Hand memory that is free in this worker back to the system: a worker runs other steps later, beside an executor that has grown."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 24_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most_bytes`` at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column(batch, text)), 0), dtype=np.int64))
        lo = 0
        while lo < batch.num_rows:
            seen = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, seen + most_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()
