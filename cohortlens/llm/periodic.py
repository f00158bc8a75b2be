"""Periodic runs of words by enumeration of maximal pairs in LCP-interval trees.

Two places of one text form a maximal pair of length ``l`` when exactly ``l`` words from either
place on are equal and the words to their left differ.  A stretch of ``l + d`` words that no
neighbour extends keeping period ``d`` begins at such a pair of distance ``d``, so the pairs whose
distance is at most ``l / (exponent - 1)`` are the runs themselves: nothing is extended.  A
stretch with a smaller period turns up at that distance too, and the smallest one stays.

Per batch of texts, suffixes are ranked by prefix doubling (only those that still share a prefix
take part), which also gives the common prefixes of neighbours.  The tree of LCP intervals
is walked bottom-up; a node holds the places below it in order, with their left words as classes.
Where two children meet, each place of the smaller one looks for places of the other within the
distance.  Occurrences of a string that close to each other overlap, and all but the first of
them have the same left word: so a look-up compares two classes and lists only pairs that are maximal.

Every text is judged by itself, so there is no shuffle; a task works on a few megabytes of text at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import runs as group_starts
from .words import WindowHashes, column, mix, small_batches, split_words, word_ids

NAMES = ("n_words", "runs", "collapsed")
BATCH_BYTES = 4_000_000


class _Suffixes:
    """Suffixes of a batch of texts that share their first ``least`` words with another suffix of their text.

    ``seq`` has the word numbers of all texts, each followed by ``least`` end marks (-1).  Suffix order is
    by (text, words); ``ranks[k]`` tells apart prefixes of ``least * 2**k`` words.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, least: int):
        self.least, counts = least, np.diff(offsets)
        doc = np.repeat(np.arange(len(counts)), counts)
        self.seq = np.full(len(ids) + least * len(counts), -1, np.int64)
        self.seq[np.arange(len(ids)) + least * doc] = ids
        self.base = offsets[:-1] + least * np.arange(len(counts))
        self.doc = np.repeat(np.arange(len(counts)), counts + least)
        shared = self._shared(counts)
        self.places = np.union1d(shared, shared + least)
        self.where = np.full(len(self.seq) + 1, -1, np.int64)
        self.where[self.places] = np.arange(len(self.places))
        self.ranks = [self._first_ranks()]
        self._refine()

    def _shared(self, counts: np.ndarray) -> np.ndarray:
        """Starts of full windows whose hash occurs twice in their text; equal windows have equal hashes, so none is missed."""
        hashes = WindowHashes(mix(self.seq.astype(np.uint64))).of(self.least)
        full = np.ones(len(hashes), bool)
        ends = self.base + counts
        for back in range(self.least):  # windows that reach an end mark
            at = ends - self.least + 1 + back
            full[at[(at >= self.base) & (at < len(full))]] = False
            at = ends + back
            full[at[at < len(full)]] = False
        starts = np.flatnonzero(full)
        keys = hashes[starts] ^ mix(self.doc[starts].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return np.sort(starts[order[twice]]) if len(starts) else starts

    def _first_ranks(self) -> np.ndarray:
        words = [self.seq[self.places + k] for k in range(self.least)]
        owner = self.doc[self.places]
        order = np.lexsort((*words[::-1], owner))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in (owner, *words):
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(order), np.int64)
        first = np.flatnonzero(new)
        rank[order] = np.repeat(first, np.diff(np.append(first, len(order))))
        return rank

    def _refine(self) -> None:
        """Double the compared length until all suffixes are told apart; settled ones keep their rank."""
        size = self.least
        while True:
            rank = self.ranks[-1]
            open_ = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
            if not len(open_):
                return
            # An unsettled suffix shares this much with another, so the place behind it is ranked too.
            after = rank[self.where[self.places[open_] + size]]
            order = np.lexsort((after, rank[open_]))
            own, after = rank[open_][order], after[order]
            group = group_starts(own)
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
            first = np.flatnonzero(new)
            begin = np.repeat(group, np.diff(np.append(group, len(own))))[first]
            finer = rank.copy()
            finer[open_[order]] = np.repeat(own[first] + first - begin, np.diff(np.append(first, len(own))))
            self.ranks.append(finer)
            size *= 2

    def sorted_groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in suffix order, their common prefix with the one before, group of suffixes that share ``least`` words)."""
        top = self.ranks[0]
        many = np.flatnonzero(np.bincount(top, minlength=len(top))[top] > 1)
        order = many[np.argsort(self.ranks[-1][many])]
        places, group = self.places[order], top[order]
        common = np.zeros(len(places), np.int64)
        pair = np.flatnonzero(group[1:] == group[:-1]) + 1
        left, right = places[pair - 1].copy(), places[pair].copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = self.where[left], self.where[right]
            equal = (a >= 0) & (b >= 0) & (self.ranks[k][a] == self.ranks[k][b])
            step = np.where(equal, self.least << k, 0)
            left, right = left + step, right + step
        going = np.ones(len(pair), bool)
        for _ in range(self.least - 1):
            going &= self.seq[left] == self.seq[right]
            left, right = left + going, right + going
        common[pair] = left - places[pair - 1]
        return places, common, group


def _meet(large: list[int], small: list[int], length: int, most: int, left: np.ndarray, least_length: int, out: list) -> list[int]:
    """Join two children of a node with common prefix ``length``, noting the maximal pairs between them."""
    if len(large) < len(small):
        large, small = small, large
    for p in small:
        lo, hi = bisect_left(large, p - most), bisect_right(large, p + most)
        if lo < hi:
            own = left[p]
            near = large[lo:lo + 1] if left[large[lo]] != own else []
            if hi - lo > 1 and left[large[lo + 1]] != own:
                near += large[lo + 1:hi]
            for q in near:
                if length + abs(p - q) >= least_length:
                    out.append((min(p, q), length + abs(p - q), abs(p - q)))
    for p in small:
        insort(large, p)
    return large


def _pairs_of(places: list[int], common: list[int], left: np.ndarray, parts: int, least_length: int, out: list) -> None:
    """Maximal pairs of one group of suffixes, by its LCP intervals from the leaves up."""
    stack: list[tuple[int, list[int]]] = []
    node = [places[0]]
    for p, length in zip(places[1:], common[1:]):
        while stack and stack[-1][0] > length:
            deep, other = stack.pop()
            node = _meet(other, node, deep, deep // parts, left, least_length, out)
        if stack and stack[-1][0] == length:
            node = _meet(stack.pop()[1], node, length, length // parts, left, least_length, out)
        stack.append((length, node))
        node = [p]
    while stack:
        deep, other = stack.pop()
        node = _meet(other, node, deep, deep // parts, left, least_length, out)


def find_runs(ids: np.ndarray, offsets: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """(text, start, length, period) of all runs of the texts ``ids[offsets[k]:offsets[k + 1]]``, in order of text, start, period."""
    parts = min_exponent - 1
    least = min(max(min_length - d, parts * d) for d in range(1, min_length + 1))
    none = np.empty((0, 4), np.int64)
    if not len(ids):
        return none
    suffixes = _Suffixes(ids, offsets, least)
    if not len(suffixes.places):
        return none
    places, common, group = suffixes.sorted_groups()
    if not len(places):
        return none
    left = np.concatenate(([-1], suffixes.seq[:-1]))
    starts = group_starts(group)
    ends = np.append(starts[1:], len(group))
    # Only groups with two places close enough for their longest common prefix can hold a run.
    nearest = np.full(len(group), np.iinfo(np.int64).max)
    by_place = np.lexsort((places, group))
    gaps = np.diff(places[by_place])
    nearest[1:][group[1:] == group[:-1]] = gaps[group[1:] == group[:-1]]
    close = np.minimum.reduceat(nearest, starts) <= np.maximum.reduceat(common, starts) // parts
    found: list[tuple[int, int, int]] = []
    for lo, hi in zip(starts[close].tolist(), ends[close].tolist()):
        _pairs_of(places[lo:hi].tolist(), common[lo:hi].tolist(), left, parts, min_length, found)
    if not found:
        return none
    start, length, period = np.array(found, np.int64).T
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    doc = suffixes.doc[start]
    out = np.stack((doc, start - suffixes.base[doc], length, period), axis=1)
    return out[np.lexsort((period, out[:, 1], doc))]


def _judged(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", BATCH_BYTES):
            words, offsets = split_words(column(batch, "__text"))
            found = find_runs(word_ids(words)[0], offsets, min_length, min_exponent)
            doc, start, length, period = found.T
            at = offsets[doc] + start
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, at + period, 1)
            np.add.at(step, at + length, -1)
            stays = np.cumsum(step[:-1]) == 0
            cuts = np.concatenate(([0], np.cumsum(stays)))[offsets]
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words.filter(pa.array(stays))),
                                  pa.scalar(" ", pa.large_string()))
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            others = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [column(batch, n) for n in others] + [pa.array(np.diff(offsets)), lists, text.cast(pa.string())],
                names=others + list(NAMES))
    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4,
                  keep: Sequence[str] = ()) -> DataFrame:
    """(``id_col``, kept columns, ``n_words``, ``runs``, ``collapsed``) for every row.

    ``runs`` lists (start, length, period) by start and period: stretches of words with smallest period ``period`` and
    at least ``max(min_length, min_exponent * period)`` words that no neighbouring word extends.  ``collapsed`` has the
    words that stay when every run keeps its first period only, joined by one space.

    Null, empty and wordless texts have no words, no runs and an empty ``collapsed``.  Rows are judged one by one: repeated
    rows and null ids give a row each.  A text of any length is judged whole, in one task.  An empty table gives an empty result.
    Columns that are not named are not read; kept columns may have any names but those of the result.
    """
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs need an exponent of at least 3 and a length of at least 2")
    keep = [c for c in dict.fromkeys(keep) if c != id_col]
    if set(keep) & set(NAMES):
        raise ValueError(f"kept columns clash with result columns: {sorted(set(keep) & set(NAMES))}")
    given = [id_col, *keep]
    rows = df.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(given)], F.col(f"`{text_col}`").alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    found = rows.mapInArrow(_judged(min_length, min_exponent),
                            f"{kinds}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(given)], *NAMES)
