"""Near-duplicates by similarity of shingle sets: SimHash fingerprints and min-hash bands find candidates, the sets decide.

Texts that are equal after lower-casing A-Z and joining words by one space are one class.  A class
has ``BANDS`` codes of ``ROWS`` minima each; classes that share a code meet, so a pair of similarity J
does with probability ``1 - (1 - J ** ROWS) ** BANDS`` (0.9999 at 0.8).  Where they meet they are
compared by sketches, one bit of every minimum: canopies link what differs in at most ``LOOSE`` bits
(4.5 standard deviations above the mean at 0.8), and what differs in at most ``TIGHT`` bits is done, as all that is
near it is near the same centre.  A task that deals out codes does so first, with ``COPY`` bits, so of a large group of
near copies it sends one entry a code and some stragglers.  A part of the codes with more entries than two tasks' worth, as
one code that very many different texts share makes it, is cut into blocks by class, and every pair of blocks is a cell of its own.

Where a distance is given, classes whose SimHash fingerprints (those of ``simhash``) differ in at most so many bits are candidates as well.

The components of these links are compared with whole sets, and only pairs whose sets have the
similarity asked for are linked.  A component larger than a block is cut into blocks by hash, and every pair of
blocks is a cell of its own: no task holds more than two blocks, and no pair is left out.  The links of a cell are
searched from one class to all that are left, so m near copies of one text give m - 1 links and not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing
from .components import components
from .simhash import links as fingerprint_links
from .simhash import with_fingerprints
from .storing import settled
from .words import WindowHashes, column, give_back, mix, small_batches, split_words, word_hashes, word_ids

BANDS, ROWS = 32, 6
#: Bits of a sketch, and by how many candidates, done members of a canopy and copies that need not travel may differ.
SKETCH, LOOSE, TIGHT, COPY = BANDS * ROWS, 38, 24, 9
#: Classes that one dealing task holds at a time, and entries that one task compares.
DEALT, PART_ENTRIES = 20_000, 1_000_000
#: Shingles of one block of a component, and of the sets in one task where components are small.
BLOCK, PART_SHINGLES = 1_000_000, 4_000_000
BATCH_BYTES = 8_000_000


def shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Hashes of all runs of ``size`` words of every text, A-Z lower-cased; a shorter text is one run, one without words none."""
    # A copy, because ascii_lower reads a slice of large strings at wrong places.
    words, offsets = split_words(pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())))
    ids, distinct = word_ids(words)
    windows = WindowHashes(word_hashes(distinct)[ids])
    lengths = np.minimum(np.diff(offsets), size).tolist()
    of = {n: windows.of(n) if n else np.empty(0, np.uint64) for n in set(lengths)}  # once per length, all texts are views of it
    return [of[n][lo:hi - n + 1] if n else of[n] for n, lo, hi in zip(lengths, offsets[:-1].tolist(), offsets[1:].tolist())]


def band_codes(runs: Sequence[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, ``BANDS``) codes of non-empty shingle hashes, and their sketches as (texts, ``SKETCH`` / 64) words."""
    flat = np.concatenate(runs)
    starts = np.cumsum([0, *map(len, runs)])[:-1]
    salt = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    codes = np.zeros((BANDS, len(runs)), np.uint64)
    bits = np.zeros((len(runs), SKETCH), np.uint8)
    for i in range(BANDS * ROWS):
        least = np.minimum.reduceat((flat ^ salt[2 * i]) * (salt[2 * i + 1] | np.uint64(1)), starts)
        codes[i // ROWS] = mix(codes[i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
        bits[:, i] = mix(least) & np.uint64(1)
    return codes.T, np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _class_key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split()))


def with_codes(df: DataFrame, size: int, seed: int) -> DataFrame:
    """The columns of ``df`` without ``__text``, with ``key`` (its class), ``n`` (shingles), ``codes`` and ``sketch`` (empty where there are no words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", BATCH_BYTES):
            texts = column(batch, "__text")
            runs = shingles(texts, size)
            full = [i for i, r in enumerate(runs) if len(r)]
            codes, sketch = [[] for _ in runs], [[] for _ in runs]
            if full:
                found = [m.view(np.int64).tolist() for m in band_codes([runs[i] for i in full], seed)]
                for i, line, bits in zip(full, *found):
                    codes[i], sketch[i] = line, bits
            keys = pa.array([_class_key(t) for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
                + [keys, pa.array([len(r) for r in runs], pa.int64()), pa.array(codes, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=[n for n in batch.schema.names if n != "__text"] + ["key", "n", "codes", "sketch"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text")
    return df.mapInArrow(run, f"{kinds}, key binary, n long, codes array<long>, sketch array<long>")


def canopies(codes: np.ndarray, sketch: np.ndarray, loose: int, tight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, members, left) over entries with a code and a sketch each.

    Among entries of one code the first that is left is a centre, gets every other one within ``loose`` bits as a member, and those
    within ``tight`` bits leave.  ``left`` marks the entries that never left.
    """
    order = np.argsort(codes, kind="stable")
    starts = packing.runs(codes[order])
    ends = np.append(starts[1:], len(codes))[:len(starts)]
    left = np.ones(len(codes), bool)
    # Codes of two entries, the usual ones among those that are shared, in one step.
    two = starts[ends - starts == 2]
    a, b = order[two], order[two + 1]
    apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1)
    left[b[apart <= tight]] = False
    centres, members = [a[apart <= loose]], [b[apart <= loose]]
    many = ends - starts > 2
    for lo, hi in zip(starts[many].tolist(), ends[many].tolist()):
        at = order[lo:hi]
        own = sketch[at]
        while len(at) > 1:
            apart = np.bitwise_count(own[1:] ^ own[0]).sum(1)
            found = at[1:][apart <= loose]
            centres.append(np.full(len(found), at[0]))
            members.append(found)
            stay = apart > tight
            left[at[1:][~stay]] = False
            at, own = at[1:][stay], own[1:][stay]
    return np.concatenate(centres), np.concatenate(members), left


def _deal(parts: int, cut: Mapping[int, int]):
    """Entries (code, node, sketch) by part of the codes, without the copies of entries of the same chunk; these travel as links.

    ``cut`` names the parts that come in several blocks; the block of an entry is that of its node.
    """
    blocks = np.ones(parts, np.uint64)
    for p, b in cut.items():
        blocks[p] = b

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _chunks(frames):
            nodes = np.repeat(frame["node"].to_numpy(np.int64), BANDS)
            codes = np.concatenate(frame["codes"].tolist()).astype(np.int64).view(np.uint64)
            sketch = np.repeat(np.stack(frame["sketch"].tolist()).astype(np.int64).view(np.uint64), BANDS, axis=0)
            centres, members, left = canopies(codes, sketch, COPY, COPY)
            part = codes.view(np.int64) % parts
            block = (mix(nodes.view(np.uint64)) % blocks[part]).astype(np.int64)
            # A link goes with its centre, which stays.
            at, linked = np.flatnonzero(left), np.lexsort((block[centres], part[centres]))
            at = at[np.lexsort((block[at], part[at]))]
            place = part << np.int64(32) | block
            starts = packing.runs(place[at])
            ties, sent = place[centres][linked], place[at][starts]
            lows, highs = np.searchsorted(ties, sent), np.searchsorted(ties, sent, "right")
            rows = []
            for to, lo, hi, low, high in zip(sent.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], lows.tolist(), highs.tolist()):
                own, pair = at[lo:hi], linked[low:high]
                payload = packing.pack(codes[own], nodes[own], *sketch[own].T, nodes[centres[pair]], nodes[members[pair]])
                rows.append((to >> 32, to & 0xFFFFFFFF, int(blocks[to >> 32]), payload))
            yield pd.DataFrame(rows, columns=["part", "block", "blocks", "payload"])
        give_back()
    return run


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for frame in frames:
        if len(frame):
            held.append(frame)
        if sum(map(len, held)) >= DEALT:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    codes, nodes, *words, centres, members = (np.concatenate(c) for c in zip(*map(packing.unpack, frame["payload"])))
    a, b, _ = canopies(codes, np.stack(words, axis=1), LOOSE, TIGHT)
    pairs = np.stack((np.concatenate((nodes[a], centres)), np.concatenate((nodes[b], members))), axis=1)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    del codes, nodes, words, centres, members, a, b
    give_back()
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _cells() -> tuple[Column, Column, Column]:
    """Of rows with ``block`` of ``blocks``: the blocks they meet (their own only where it is the one), and the cell with ``other``."""
    other = F.explode(F.expr("case when blocks = 1 then array(0) else array_remove(sequence(0, blocks - 1), block) end"))
    return other, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")


def candidates(classes: DataFrame, entries: int = PART_ENTRIES) -> DataFrame:
    """(a, b): links between the ``node`` of classes with ``codes`` and ``sketch``; similar classes are in one component of them.

    A task compares some ``entries`` (code, class) at a time, whatever the number of classes that share one code.
    """
    full = classes.filter(F.size("codes") > 0)
    parts = max(1, -(-full.count() * BANDS // entries))
    # Parts of one block are usual; the others, which only hot codes make, are told to the dealing tasks.
    sizes = full.select(F.explode("codes").alias("code")).groupBy(F.pmod("code", F.lit(parts)).cast("int").alias("part")).agg(F.count("*").alias("n"))
    cut = {r.part: -(-r.n // entries) for r in sizes.filter(F.col("n") > 2 * entries).collect()}
    other, low, high = _cells()
    dealt = full.select("node", "codes", "sketch").mapInPandas(_deal(parts, cut), "part int, block int, blocks int, payload binary")
    cells = dealt.withColumn("other", other).select("part", low, high, "payload")
    return cells.groupBy("part", "low", "high").applyInPandas(_meet, "a long, b long").filter("a <> b").distinct()


def fingerprint_candidates(rows: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between the ``node`` of classes with words whose first rows have SimHash fingerprints within ``distance`` bits.

    ``rows`` has (__id, digest, __text).  Classes of one fingerprint are linked to its smallest node; only distinct fingerprints are compared.
    """
    marked = with_fingerprints(rows, "__id", "__text", keep=["digest"])
    first = classes.filter("n > 0").select("node", F.col("first.__id").alias("__i"), F.col("first.digest").alias("__d"))
    named = marked.join(first, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("digest") == F.col("__d")))
    named = settled(named.select("fp", "node").distinct(), "overlap-fingerprints")
    heads = settled(named.groupBy("fp").agg(F.min("node").alias("head")), "overlap-heads")
    same = named.join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = fingerprint_links(heads, distance)
    for side in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head")), side)
    return same.unionByName(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))).filter("a <> b").distinct()


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", BATCH_BYTES):
            sets = [packing.pack_sorted(np.unique(r)) for r in shingles(column(batch, "__text"), size)]
            kept = ["root", "block", "blocks", "key"]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + [pa.array(sets, pa.binary())], names=[*kept, "payload"])
    return run


def spanning(sets: Sequence[np.ndarray], least: Fraction) -> Iterator[tuple[int, int]]:
    """Links (places in ``sets``) of a spanning forest of the distinct non-empty sets with Jaccard similarity of ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(flat.max()) + 1, bool)
    ends = np.cumsum(sizes)
    own = [flat[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
    # Sets held for comparing; those that are linked leave it when they are half of it.
    held, left = np.arange(len(sets)), np.ones(len(sets), bool)
    starts = ends - sizes
    at = 0
    while at < len(sets):
        if not left[at]:
            at += 1
            continue
        wave, left[at] = [at], False
        while wave and left.any():
            seed = wave.pop()
            if 2 * np.count_nonzero(left[held]) < len(held):
                held = held[left[held]]
                flat = np.concatenate([own[i] for i in held])
                starts = np.cumsum(sizes[held]) - sizes[held]
            mark[own[seed]] = True
            # Counted in int64: a sum over booleans would only say whether there is any.
            common = np.add.reduceat(mark[flat].astype(np.int64), starts)
            mark[own[seed]] = False
            whole = sizes[held] + sizes[seed] - common
            for i in held[left[held] & (common * least.denominator >= whole * least.numerator)].tolist():
                left[i] = False
                wave.append(i)
                yield seed, i


def _links(least: Fraction):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, cell in frame.groupby(["root", "low", "high"]):
            cell = cell.drop_duplicates("key")
            keys = cell["key"].tolist()
            for i, j in spanning([packing.unpack_sorted(p)[0] for p in cell["payload"]], least):
                a.append(keys[i])
                b.append(keys[j])
        give_back()
        return pd.DataFrame({"a": a, "b": b})
    return run


def in_cells(near: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``near`` (root, key, n shingles) with ``block`` of ``blocks``, and how many tasks their cells take."""
    # The longest set is not counted: cutting further would only copy it to more cells.
    rest = F.ceil((F.col("n") - F.col("longest")) / F.lit(block)).cast("int") + 1
    sizes = settled(near.groupBy("root").agg(F.sum("n").alias("n"), F.max("n").alias("longest"), F.count("*").cast("int").alias("classes"))
                    .withColumn("blocks", F.when(F.col("n") > block, F.least(rest, "classes")).otherwise(1)), "overlap-sizes")
    # A component of b blocks has each block in b - 1 cells.
    total = sizes.agg(F.sum(F.col("n") * F.greatest(F.lit(1), F.col("blocks") - 1))).first()[0] or 0
    large = sizes.filter("blocks > 1").select("root", "blocks")
    cut = near.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return cut.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), max(1, -(-total // PART_SHINGLES))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                   least: Fraction = Fraction(4, 5), seed: int = 42, block: int = BLOCK,
                   entries: int = PART_ENTRIES, distance: int | None = None) -> DataFrame:
    """(``id_col``, ``digest``, ``group``), one row per document: rows of one ``group`` are linked by similarities of ``least`` or more.

    ``digest`` is the SHA-256 of the text.  Texts without words (null, empty, white space) are copies of each other; null ids and
    repeated ids count as rows like any other; an empty table gives an empty result.  ``least`` below four fifths loses pairs, as bands and
    sketches are laid out for that.  A set must fit a task, however long its text; ``block`` bounds the shingles of the others that one task compares,
    ``entries`` the (code, class) entries.  With ``distance``, SimHash fingerprints at that many bits or fewer make candidates too.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.sha2(F.col(text_col), 256).alias("digest"), F.col(text_col).alias("__text"))
    marks = settled(with_codes(rows, size, seed), "overlap-marks")
    classes = marks.groupBy("key").agg(F.min(F.struct("__id", "digest")).alias("first"), F.min("n").alias("n"),
                                       F.min("codes").alias("codes"), F.min("sketch").alias("sketch"))
    # Two classes with the same node are only compared in the same component; their keys tell them apart.
    classes = settled(classes.withColumn("node", F.xxhash64("key")), "overlap-classes")
    met = candidates(classes, entries)
    if distance:
        met = met.unionByName(fingerprint_candidates(rows, classes, distance))
    groups = components(settled(met, "overlap-candidates"))
    near = settled(groups.join(classes.drop("codes", "sketch"), "node"), "overlap-near")
    # One row's text per candidate class is read again, for its whole set.
    cut, parts = in_cells(near, block)
    wanted = cut.select("root", "key", "block", "blocks", F.col("first.__id").alias("__i"), F.col("first.digest").alias("__d"))
    found = rows.join(wanted, F.col("__id").eqNullSafe(F.col("__i")) & F.col("digest").eqNullSafe(F.col("__d")))
    sets = found.select("root", "block", "blocks", "key", "__text").mapInArrow(
        _with_sets(size), "root long, block int, blocks int, key binary, payload binary")
    other, low, high = _cells()
    cells = (sets.withColumn("other", other).select("root", low, high, "key", "payload")
             .withColumn("part", F.pmod(F.xxhash64("root", "low", "high"), F.lit(parts)).cast("int")))
    links = settled(cells.groupBy("part").applyInPandas(_links(least), "a binary, b binary").distinct(), "overlap-links")
    label = components(links).withColumnRenamed("node", "key")
    return marks.join(label, "key", "left").select(F.col("__id").alias(id_col), "digest", F.coalesce("root", "key").alias("group"))
