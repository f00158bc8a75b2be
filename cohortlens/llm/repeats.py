"""Removal of word sequences that occur earlier in the corpus, by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window; all rolling
windows of block length probe that index.  Two equal windows of ``window`` words contain a
whole reference block of either document, so both are found by an anchor that occurs
twice.  Hits are extended: the full windows over a repeated anchor are hashed (64 bits),
each distinct one finds its first place in the corpus, and the union of the windows that
start later is the maximal repeat that goes.

Shuffled are compressed hashes per (chunk, part of the hash range), see ``packing``: a passage
that a third of all documents share is one entry per chunk, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .chunks import Chunk, chunked, doc_keys, from_bytes, nullable, part_count, text_ties
from .storing import settled
from .words import WindowHashes, column, inside, split_words, spread, word_hashes, word_ids

NAMES = ("n_words", "n_removed", "removed", "kept_text")
OFFER = "kind int, part int, chunk long, payload binary"


class _Blocks:
    """Distinct rolling block hashes of a chunk, sorted, with what the index needs."""

    def __init__(self, chunk: Chunk, windows: WindowHashes, block: int, bits: int):
        ok = inside(chunk.offsets, block)
        self.starts = np.flatnonzero(ok)
        keys = windows.of(block)[:len(ok)][ok] >> np.uint64(64 - bits)
        self.order = np.argsort(keys, kind="stable")
        ordered = keys[self.order]
        self.runs = packing.runs(ordered)
        self.distinct = ordered[self.runs]
        self.counts = np.diff(np.append(self.runs, len(ordered)))
        first = chunk.of_word(chunk.offsets[:-1])[self.starts]
        aligned = ((self.starts - first) % block == 0)[self.order]
        self.reference = np.logical_or.reduceat(aligned, self.runs) if len(ordered) else np.empty(0, bool)

    def starts_of(self, flagged: np.ndarray) -> np.ndarray:
        """Block starts whose distinct hash is flagged."""
        return self.starts[self.order[np.repeat(flagged, self.counts)]]


def _first_places(hashes: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of windows by hash, document rank, start; starts of the runs of equal hashes)."""
    order = np.lexsort((starts, rank, hashes))
    return order, packing.runs(hashes[order])


def _doc_ranks(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((np.arange(len(keys)), ties, keys))] = np.arange(len(keys))
    return rank


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "chunk", "payload"])


def _block_offers(block: int, bits: int, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, blob in zip(frame["chunk"], frame["words"]):
                chunk = Chunk(blob)
                b = _Blocks(chunk, WindowHashes(chunk.hashes), block, bits)
                flags = b.reference.astype(np.uint8) | (b.counts > 1).astype(np.uint8) << 1
                yield _frame([(1, p, number, packing.pack_sorted(b.distinct[lo:hi], flags[lo:hi]))
                              for p, lo, hi in packing.ranges(b.distinct, parts, bits)])
    return run


def _answer_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """Per offered block hash: is it in the index, and does it occur twice in the corpus?"""
    offers = [packing.unpack_sorted(x) for x in frame["payload"]]
    hashes = np.concatenate([h for h, _ in offers])
    flags = np.concatenate([f for _, f in offers])
    order = np.argsort(hashes, kind="stable")
    starts = packing.runs(hashes[order])
    repeated = (np.logical_or.reduceat((flags[order] & 1) > 0, starts)
                & (np.add.reduceat(1 + (flags[order] >> 1).astype(np.int64), starts) > 1))
    told = np.empty(len(hashes), bool)
    told[order] = np.repeat(repeated, np.diff(np.append(starts, len(hashes))))
    return _reply(frame, told, [len(h) for h, _ in offers])


def _reply(frame: pd.DataFrame, told: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    cuts = np.cumsum([0, *sizes])
    return _frame([(1, p, c, packing.pack(np.packbits(told[lo:hi]), np.array([hi - lo])))
                   for p, c, lo, hi in zip(frame["part"], frame["chunk"], cuts[:-1], cuts[1:])])


def _told(frame: pd.DataFrame) -> np.ndarray:
    """The answers of all parts in the order of the chunk's sorted hashes."""
    replies = frame[frame["kind"] == 1].sort_values("part")["payload"]
    parts = [np.unpackbits(bits, count=int(n[0])).astype(bool) for bits, n in map(packing.unpack, replies)]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def _window_offers(window: int, block: int, bits: int, parts: int):
    """From a chunk and its answered blocks: the candidate windows, and an offer of each distinct one's first place."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["chunk"].iloc[0])
        chunk = Chunk(frame[frame["kind"] == 0]["payload"].iloc[0])
        windows = WindowHashes(chunk.hashes)
        b = _Blocks(chunk, windows, block, bits)
        hit = np.zeros(len(chunk.hashes) + 1, np.int64)
        hit[b.starts_of(_told(frame)) + 1] = 1
        hits = np.cumsum(hit)
        ok = inside(chunk.offsets, window)
        s = np.arange(len(ok))
        ok &= hits[s + window - block + 1] > hits[s]
        rows = [(0, 0, number, packing.pack(np.packbits(ok), np.array([len(ok)])))]
        starts = np.flatnonzero(ok)
        if len(starts):
            hashes = windows.of(window)[starts]
            doc = np.repeat(np.arange(len(chunk.keys)), chunk.lengths)[starts]
            order, at = _first_places(hashes, starts, _doc_ranks(chunk.keys, chunk.ties)[doc])
            distinct, owner = hashes[order][at], doc[order][at]
            for p, lo, hi in packing.ranges(distinct, parts):
                docs, where = np.unique(owner[lo:hi], return_inverse=True)
                rows.append((1, p, number, packing.pack_sorted(distinct[lo:hi], packing.narrow(where), chunk.keys[docs],
                                                               chunk.ties[docs])))
        return _frame(rows)
    return run


def _answer_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """Per offered window: does this chunk hold its first place in the corpus?"""
    offers = [packing.unpack_sorted(x) for x in frame["payload"]]
    sizes = [len(o[0]) for o in offers]
    hashes = np.concatenate([o[0] for o in offers])
    keys = np.concatenate([o[2][o[1]] for o in offers])
    ties = np.concatenate([o[3][o[1]] for o in offers])
    order = np.lexsort((np.repeat(frame["chunk"].to_numpy(), sizes), ties, keys, hashes))
    first = np.zeros(len(hashes), bool)
    first[order[packing.runs(hashes[order])]] = True
    return _reply(frame, first, sizes)


def _cleaned(window: int):
    """From a chunk's documents, candidates and answers: the documents without their repeats."""
    def run(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        rows = from_bytes(frame[frame["kind"] == 2]["payload"].iloc[0]).to_batches()[0]
        texts = column(rows, "__text")
        words, offsets = split_words(texts)
        bits, n = packing.unpack(frame[frame["kind"] == 0]["payload"].iloc[0])
        starts = np.flatnonzero(np.unpackbits(bits, count=int(n[0])))
        gone = np.zeros(len(words), bool)
        if len(starts):
            ids, distinct = word_ids(words)
            hashes = WindowHashes(word_hashes(distinct)[ids]).of(window)[starts]
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[starts]
            order, at = _first_places(hashes, starts, _doc_ranks(doc_keys(column(rows, "__id")), text_ties(texts))[doc])
            later = np.ones(len(starts), bool)
            later[order[at[_told(frame)]]] = False
            mask = np.zeros(len(words), bool)
            mask[starts[later]] = True
            gone = spread(mask, window, len(words))
        kept = np.concatenate(([0], np.cumsum(~gone)))[offsets]
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(~gone))),
                              pa.scalar(" ", pa.large_string()))
        # A run of removed words within a document, as word positions [lo, hi).
        edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(gone))]
        inner = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner
        lo = np.sort(np.concatenate((np.flatnonzero(edge > 0), inner)))
        hi = np.sort(np.concatenate((np.flatnonzero(edge < 0), inner)))
        owner = np.searchsorted(offsets, lo, side="right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(lo - offsets[owner]), pa.array(hi - offsets[owner])], ["lo", "hi"]))
        given = {"__id": column(rows, "__id"), "n_words": pa.array(np.diff(offsets)),
                 "n_removed": pa.array(np.diff(offsets) - np.diff(kept)), "removed": spans, "kept_text": text.cast(pa.string())}
        if "__row" in rows.schema.names:
            given["__row"] = column(rows, "__row").cast(nullable(rows.schema.field("__row").type))
        return pa.table(given)
    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Documents without the words that a window which also starts earlier covers.

    Earlier means a smaller id, or the same document and an earlier start.  Windows are judged
    on the input.  Returns one row per input row: ``id_col``, the columns ``keep``, ``n_words``,
    ``n_removed``, ``removed`` (array of word ranges ``[lo, hi)``) and ``kept_text`` (kept words
    joined by one space).

    Null text has no words and gives an empty ``kept_text``.  Rows with a null id come after all
    others; rows that share an id are ordered by a hash of their text, and of fully equal rows
    one is the first.  Texts shorter than a window stay whole.  An empty table gives an
    empty result.  Columns of ``df`` that are not named are not read; a kept column may not have
    one of the result's names.
    """
    keep = [c for c in keep if c != id_col]
    if set(keep) & {*NAMES, "kind"}:
        raise ValueError(f"kept columns clash with result columns: {sorted(set(keep) & set(NAMES))}")
    block = (window + 1) // 2
    table, total = chunked(df, id_col, text_col, keep, purpose="repeats")
    # Enough bits that false anchors stay rare at any size; they would only add candidates.
    parts, bits = part_count(total), min(64, max(40, total.bit_length() + 12))
    offers = table.select("chunk", "words").mapInPandas(_block_offers(block, bits, parts), OFFER)
    # Answers are stored, so that the offers, the largest exchange, are gone before words and texts move.
    replies = settled(offers.groupBy("part").applyInPandas(_answer_blocks, OFFER), "repeat-blocks")
    own = table.select(F.lit(0).alias("kind"), F.lit(0).alias("part"), "chunk", F.col("words").alias("payload"))
    found = settled(own.unionByName(replies).groupBy("chunk").applyInPandas(_window_offers(window, block, bits, parts), OFFER),
                    "repeat-candidates", by=["kind"])
    found = found.select("kind", "part", "chunk", "payload")
    firsts = settled(found.filter("kind = 1").groupBy("part").applyInPandas(_answer_windows, OFFER), "repeat-windows")
    texts = table.select(F.lit(2).alias("kind"), F.lit(0).alias("part"), "chunk", F.col("rows").alias("payload"))
    schema = "__id long, n_words long, n_removed long, removed array<struct<lo: long, hi: long>>, kept_text string"
    if keep:
        schema += f", __row {df.select(F.struct(*keep).alias('__row')).schema['__row'].dataType.simpleString()}"
    done = (found.filter("kind = 0").unionByName(firsts).unionByName(texts)
            .groupBy("chunk").applyInArrow(_cleaned(window), schema))
    return done.select(F.col("__id").alias(id_col), *([F.col(f"__row.`{c}`").alias(c) for c in keep]), *NAMES)
