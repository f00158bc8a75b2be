"""Stupid-backoff scores of documents from n-gram counts over the whole corpus.

The count table of all n-grams up to ``order`` is partitioned by hash: every chunk of
documents explodes its texts into n-grams, sums them, and sends each distinct one with its count
to the part that owns its hash; the part adds up the counts and joins them back to
the chunks that asked.  Positions then take their score, and documents their sum.  So a
frequent n-gram is one entry per chunk, in packed form (see ``packing``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .chunks import Chunk, chunked, from_bytes, nullable, part_count
from .storing import settled
from .words import WindowHashes, column, inside

OFFER = "kind int, part int, chunk long, payload binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "chunk", "payload"])


class _Grams:
    """Distinct n-gram hashes of a chunk, sorted, and where each position's n-grams are among them."""

    def __init__(self, chunk: Chunk, order: int, bits: int):
        windows = WindowHashes(chunk.hashes)
        shift = np.uint64(64 - bits)
        found, self.masks = [], []
        for n in range(1, order + 1):
            ok = inside(chunk.offsets, n)
            found.append(windows.of(n)[:len(ok)][ok] >> shift)
            self.masks.append(ok)
        hashes = np.concatenate(found)
        order_ = np.argsort(hashes, kind="stable")
        ordered = hashes[order_]
        runs = packing.runs(ordered)
        self.distinct, self.counts = ordered[runs], np.diff(np.append(runs, len(ordered)))
        place = np.empty(len(hashes), np.int64)
        place[order_] = np.repeat(np.arange(len(runs)), self.counts)
        self.places = np.split(place, np.cumsum([len(f) for f in found])[:-1])


def _offers(order: int, bits: int, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, blob in zip(frame["chunk"], frame["words"]):
                grams = _Grams(Chunk(blob), order, bits)
                yield _frame([(1, p, number, packing.pack_sorted(grams.distinct[lo:hi], packing.narrow(grams.counts[lo:hi])))
                              for p, lo, hi in packing.ranges(grams.distinct, parts, bits)])
    return run


def _totals(frame: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of one part of the hash range, answered to every chunk in the order of its offer."""
    offers = [packing.unpack_sorted(x) for x in frame["payload"]]
    hashes = np.concatenate([h for h, _ in offers])
    counts = np.concatenate([c.astype(np.int64) for _, c in offers])
    order = np.argsort(hashes, kind="stable")
    runs = packing.runs(hashes[order])
    total = np.empty(len(hashes), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], runs), np.diff(np.append(runs, len(hashes))))
    cuts = np.cumsum([0, *(len(h) for h, _ in offers)])
    return _frame([(1, p, c, packing.pack(packing.narrow(total[lo:hi])))
                   for p, c, lo, hi in zip(frame["part"], frame["chunk"], cuts[:-1], cuts[1:])])


def position_scores(chunk: Chunk, grams: _Grams, totals: np.ndarray, corpus: int, backoff: float, least: int) -> np.ndarray:
    """log score of every word of a chunk given the words before it in its document."""
    size = len(chunk.hashes)
    counts = []
    for n, (mask, place) in enumerate(zip(grams.masks, grams.places), 1):
        at = np.zeros(size, np.int64)  # count of the n-gram that ends at a word, 0 where the document is too short
        at[np.flatnonzero(mask) + n - 1] = totals[place]
        counts.append(at)
    score = np.log(counts[0] / max(corpus, 1)) if size else np.zeros(0)
    known = counts[0] > 0
    for n in range(2, len(counts) + 1):
        context = np.concatenate(([0], counts[n - 2][:-1]))
        there = counts[n - 1] > 0  # the document has n words up to here
        seen = counts[n - 1] >= least
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log(counts[n - 1] / context)
        score = np.where(seen, direct, np.where(there, score + np.log(backoff), score))
    return np.where(known, score, 0.0)


def _scored(order: int, bits: int, corpus: int, backoff: float, least: int):
    def run(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        chunk = Chunk(frame[frame["kind"] == 0]["payload"].iloc[0])
        rows = from_bytes(frame[frame["kind"] == 2]["payload"].iloc[0]).to_batches()[0]
        grams = _Grams(chunk, order, bits)
        replies = frame[frame["kind"] == 1].sort_values("part")["payload"]
        totals = np.concatenate([packing.unpack(x)[0].astype(np.int64) for x in replies]) if len(replies) else np.empty(0, np.int64)
        scores = position_scores(chunk, grams, totals, corpus, backoff, least)
        lengths = chunk.lengths
        doc = np.repeat(np.arange(len(lengths)), lengths)
        given = {"__id": column(rows, "__id"), "n_words": pa.array(lengths.astype(np.int64)),
                 "log_score": pa.array(np.bincount(doc, weights=scores, minlength=len(lengths)))}
        if "__row" in rows.schema.names:
            given["__row"] = column(rows, "__row").cast(nullable(rows.schema.field("__row").type))
        return pa.table(given)
    return run


def backoff_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), order: int = 3,
                   backoff: float = 0.4, least: int = 2) -> DataFrame:
    """(``id_col``, kept columns, ``n_words``, ``log_score``): natural log of the product of all word scores, per row.

    The score of a word is count(n-gram) / count(context) for the longest n-gram up to ``order`` that the
    corpus holds at least ``least`` times (once it would only be this text itself), times ``backoff`` for every
    order given up; a single word's is its share of all words.  Counts cover all rows of ``df``.
    n-grams do not leave their document, its first words have shorter contexts.

    Null, empty and blank texts have no words and log score 0.  Rows with equal or null ids count and score as
    rows of their own.  An empty table gives an empty result.  Columns that are not named are not read.
    """
    keep = [c for c in keep if c != id_col]
    if {"n_words", "log_score"} & set(keep):
        raise ValueError("a kept column has the name of a result column")
    table, total = chunked(df, id_col, text_col, keep, with_text=False, purpose="backoff")
    # Equal hashes of different n-grams stay as rare at any size: one in 2^26 or less.
    parts, bits = part_count(total * order), min(64, max(54, total.bit_length() + 26))
    # Stored, so that the offers, by far the largest exchange, are gone before the texts move.
    totals = settled(table.select("chunk", "words").mapInPandas(_offers(order, bits, parts), OFFER)
                     .groupBy("part").applyInPandas(_totals, OFFER), "backoff-counts")
    own = table.select(F.lit(0).alias("kind"), F.lit(0).alias("part"), "chunk", F.col("words").alias("payload"))
    rows = table.select(F.lit(2).alias("kind"), F.lit(0).alias("part"), "chunk", F.col("rows").alias("payload"))
    schema = "__id long, n_words long, log_score double"
    if keep:
        schema += f", __row {df.select(F.struct(*keep).alias('__row')).schema['__row'].dataType.simpleString()}"
    done = (own.unionByName(rows).unionByName(totals).groupBy("chunk")
            .applyInArrow(_scored(order, bits, total, backoff, least), schema))
    return done.select(F.col("__id").alias(id_col), *[F.col(f"__row.`{c}`").alias(c) for c in keep], "n_words", "log_score")
