"""Chunks: bounded runs of documents stored as one row, the unit that offers hashes and gets answers.

``words`` holds the word hashes of the chunk through a chunk vocabulary (about two bytes a
word), ``rows`` the documents themselves; a job reads only the column that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import narrow, pack, unpack
from .storing import settled
from .words import column, small_batches, split_words, word_hashes, word_ids

CHUNK_WORDS = 1 << 20
PART_OFFERS = 2_000_000
SCHEMA = "chunk long, n_words long, words binary, rows binary"


def doc_keys(ids: pa.Array) -> np.ndarray:
    """Integer ids as unsigned numbers in the same order; null comes last."""
    whole = np.asarray(pc.fill_null(ids.cast(pa.int64()), np.iinfo(np.int64).max))
    return whole.astype(np.uint64) ^ np.uint64(1 << 63)


def text_ties(texts: pa.Array) -> np.ndarray:
    """A hash of every whole text; it orders rows that share an id."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t or "") for t in texts.to_pylist()), np.uint64, len(texts))


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with all its nested fields nullable, as Spark declares them."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, nullable(kind.item_type))
    return pa.list_(nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def _one(batches: list[pa.RecordBatch], number: int, with_text: bool) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    batch = table.to_batches()[0]
    texts = column(batch, "__text")
    words, offsets = split_words(texts)
    ids, distinct = word_ids(words)
    blob = pack(doc_keys(column(batch, "__id")), text_ties(texts), np.diff(offsets), narrow(ids), word_hashes(distinct))
    return pa.RecordBatch.from_pydict({
        "chunk": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
        "n_words": pa.array([int(offsets[-1])], pa.int64()), "words": pa.array([blob], pa.binary()),
        "rows": pa.array([to_bytes(batch if with_text else batch.drop_columns(["__text"]))], pa.binary())})


def cut(batches: Iterator[pa.RecordBatch], with_text: bool = True, size: int = CHUNK_WORDS) -> Iterator[pa.RecordBatch]:
    """One row for about ``size`` words (estimated as bytes / 6) of consecutive documents."""
    held: list[pa.RecordBatch] = []
    bytes_held, number = 0, 0
    for batch in small_batches(batches, "__text", most_bytes=6 * size):
        more = pc.sum(pc.binary_length(column(batch, "__text"))).as_py() or 0
        if held and bytes_held + more > 6 * size:
            yield _one(held, number, with_text)
            held, bytes_held, number = [], 0, number + 1
        held.append(batch)
        bytes_held += more
    if held:
        yield _one(held, number, with_text)


def chunked(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = (), with_text: bool = True,
            purpose: str = "chunks", size: int = CHUNK_WORDS) -> tuple[DataFrame, int]:
    """(stored chunk table, number of words in all documents)."""
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"),
                     *([F.struct(*keep).alias("__row")] if keep else []))
    table = settled(rows.mapInArrow(lambda b: cut(b, with_text, size), SCHEMA), purpose)
    return table, table.agg(F.sum("n_words")).first()[0] or 0


def part_count(offers: int) -> int:
    """Parts of the hash range such that one task gets a few million offers, whatever the corpus size."""
    return max(1, ceil(offers / PART_OFFERS))


class Chunk:
    """The decoded ``words`` column of one chunk."""

    def __init__(self, blob: bytes):
        self.keys, self.ties, lengths, ids, vocabulary = unpack(blob)
        self.offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.ids, self.vocabulary = ids, vocabulary
        self.hashes = vocabulary[ids] if len(ids) else np.empty(0, np.uint64)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def of_word(self, per_doc: np.ndarray) -> np.ndarray:
        """A value per document repeated for each of its words."""
        return np.repeat(per_doc, self.lengths)
