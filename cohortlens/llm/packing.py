"""Compact exchange of hashes between chunks of documents and parts of the hash range.

A chunk (a bounded run of documents, one row) offers each hash it holds once; all
offers of one hash range meet in one part, which answers every chunk in the order of
its offer.  Per (chunk, part) there is one row with a compressed byte string: sorted
hashes as differences, so a hash costs two to three bytes in the shuffle, and however
often a hash occurs, a part gets it once per chunk at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string, stored byte plane by byte plane."""
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append((a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(blob))):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)
                   if n else np.empty(0, kind))
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_sorted(hashes: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted hashes as differences, with aligned arrays."""
    return pack(hashes[:1], narrow(np.diff(hashes)), *more)


def unpack_sorted(blob: bytes) -> list[np.ndarray]:
    first, steps, *more = unpack(blob)
    return [np.cumsum(np.concatenate((first, steps.astype(np.uint64))), dtype=np.uint64), *more]


def ranges(hashes: np.ndarray, parts: int, bits: int = 64) -> Iterator[tuple[int, int, int]]:
    """(part, lo, hi) of the non-empty parts for sorted hashes of ``bits`` bits: equal ranges of the hash space."""
    edges = np.array([(p << bits) // parts for p in range(1, parts)], np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), int(cuts[p]), int(cuts[p + 1])


def runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
