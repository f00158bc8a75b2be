"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Every candidate block is turned into postings: per term (vector component) the rows with a
non-zero weight.  A block of sparse query rows is taken term by term; each query that has the
term scatters its weight times the postings into the dense score array of (query, candidate).
The finished array is cut to its k best by partition selection, and the blocks' best are merged
per query.

Candidates and queries are packed in blocks of bounded size.  Candidate blocks are dealt into a bounded
number of groups, and every query block is copied once per group; they meet in a merge join on the group,
so a task holds one pair of blocks at a time, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import pack, unpack
from .storing import settled

#: Rows of a candidate block and of a query block: a score array of 16 MB.
CANDIDATES, QUERIES = 4096, 512
#: Groups of candidate blocks at most, so copies of a query block.
GROUPS = 256


def usable(vector: Column) -> Column:
    """True for a vector that is not null and holds only finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, taken as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(block, payload) with ``size`` rows (id, vec) each, the last of a partition with fewer."""
    def block(part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["vec"].map(len).to_numpy(np.int64)
        flat = np.concatenate(part["vec"].to_list()) if lengths.sum() else np.empty(0, np.int64)
        return pd.DataFrame({"payload": [pack(part["id"].to_numpy(np.int64), lengths, flat.astype(np.int64))]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"id": [], "vec": []})
        for frame in frames:
            held = pd.concat((held, frame)) if len(held) else frame
            while len(held) >= size:
                yield block(held.iloc[:size])
                held = held.iloc[size:]
        if len(held):
            yield block(held)
    return (rows.mapInPandas(run, "payload binary")
            .select(F.monotonically_increasing_id().alias("block"), "payload"))


def _pairs(asked: DataFrame, given: DataFrame, groups: int) -> DataFrame:
    """(block, payload, asked): every candidate block beside every query block.

    The planner takes the copies of the query blocks for one, and would broadcast them all; so the kind of join is stated.
    """
    copies = asked.select(F.col("payload").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    dealt = given.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    return dealt.join(copies.hint("merge"), "group").select("block", "payload", "asked")


def _terms(lengths: np.ndarray, flat: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Postings of a block: term -> (rows, weights), zero weights left out."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = flat != 0
    row, term, flat = row[kept], term[kept], flat[kept]
    order = np.argsort(term, kind="stable")
    cuts = np.flatnonzero(np.diff(term[order])) + 1
    return {int(term[o[0]]): (row[o], flat[o]) for o in np.split(order, cuts) if len(o)}


def _dense(postings: dict, size: int) -> dict:
    """A term that more than half of the rows have, as (all rows, weights with zeros): adding a zero is cheaper than an index."""
    for term, (rows, weights) in postings.items():
        if 2 * len(rows) > size:
            line = np.zeros(size, np.int64)
            line[rows] = weights
            postings[term] = (slice(None), line)
    return postings


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score, smaller id); partition selection first, ties at the cut included."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= cut)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _scored(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids, postings = None, None, {}
        for frame in frames:
            for block, asked, given in zip(frame["block"], frame["asked"], frame["payload"]):
                if block != last:
                    ids, lengths, flat = unpack(given)
                    last, postings = block, _dense(_terms(lengths, flat), len(ids))
                query_ids, lengths, flat = unpack(asked)
                scores = np.zeros((len(query_ids), len(ids)), np.int64)
                for term, (rows, weights) in _terms(lengths, flat).items():
                    at, weight = postings.get(term, (None, None))
                    for row, w in zip(rows, weights) if weight is not None else ():
                        scores[row, at] += w * weight
                out = []
                for q, line in zip(query_ids, scores):
                    others = np.flatnonzero(ids != q)
                    own, line = ids[others], line[others]
                    b = _best(line, own, k)
                    out.append((np.full(len(b), q), own[b], line[b]))
                if out:
                    q, v, s = (np.concatenate(x) for x in zip(*out))
                    yield pd.DataFrame({"query_id": q, "vec_id": v, "score": s})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256) -> DataFrame:
    """(``query_id``, ``rank`` from 1, ``vec_id``, ``score``) of the ``k`` best of every query row.

    Scores are exact integers of ``floor(scale * x)``; ties go to the smaller id.  Rows without id, without vector
    or with a null or non-finite component take no part.  Fully repeated rows count once; a query never meets rows
    of its own id.  A missing component of a shorter vector counts as zero.  An empty table, or
    one without queries or other candidates, gives an empty result.  Other columns are not read.
    """
    rows = (vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("vec"), is_query.alias("asks"))
            .dropDuplicates(["id", "vec"]))
    rows = settled(rows, "topk-vectors")
    given = settled(_packed(rows.select("id", "vec"), CANDIDATES), "topk-candidates")
    asked = settled(_packed(rows.filter("asks").select("id", "vec"), QUERIES), "topk-queries")
    pairs = _pairs(asked, given, min(GROUPS, max(1, given.count())))
    best = pairs.mapInPandas(_scored(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
