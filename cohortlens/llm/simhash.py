"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link when at most ``distance`` of 64 bits differ.  They are cut into so few
segments that in a linked pair one segment differs by at most one bit
(``distance // segments == 1``).  Each segment is indexed under its one-wildcard variants (one
bit deleted), so two such segments share at least one key.  An equality join on (segment,
deleted bit, rest) brings candidates together, and the whole fingerprints are verified.

Distinct fingerprints are joined, never documents, so a group of copies is one row.  Keys
travel packed by part of the key space.  Inside one key the verified links are searched from
one fingerprint to all that are left, and only a spanning forest leaves the task: a key with m
fingerprints gives at most m - 1 links, with the same components as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing
from .components import components
from .storing import settled
from .words import column, give_back, small_batches

BITS = 64
#: Keys that one task compares.
PART_KEYS = 1_000_000
#: Fingerprints that one offering task holds at a time.
OFFER_ROWS = 25_000


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """64-bit SimHash of one text as an unsigned number: a bit is set where over half the shingle hashes have it."""
    if not text:
        return 0
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = ends[min(shingle, len(words)) - 1:] - 1
    first = np.concatenate(([0], ends))[:len(last)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42,
                      keep: Sequence[str] = ()) -> DataFrame:
    """(``id_col``, kept columns, ``fp``): the fingerprint as a signed long.  Null and wordless texts have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text"):
            fps = np.array([fingerprint(t, shingle, seed) for t in column(batch, "__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"] + [pa.array(fps.view(np.int64))],
                names=[n for n in batch.schema.names if n != "__text"] + ["fp"])
    rows = df.select(id_col, *keep, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{kinds}, fp long")


def hex_digits(fp: Column) -> Column:
    """A signed long as 16 lower-case hexadecimal digits of its bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width): as few segments as leave one with at most one differing bit."""
    count = distance // 2 + 1
    cuts = [BITS * i // count for i in range(count + 1)]
    return list(zip(cuts[:-1], np.diff(cuts).tolist()))


def _keys(fps: np.ndarray, variant: np.ndarray, distance: int) -> np.ndarray:
    """Key of each fingerprint under a variant number (segment and deleted bit): the number in the high byte, then the other bits."""
    cut = segments(distance)
    low = np.concatenate([np.full(w, lo, np.uint64) for lo, w in cut])[variant]
    width = np.concatenate([np.full(w, w, np.uint64) for _, w in cut])[variant]
    bit = np.concatenate([np.arange(w, dtype=np.uint64) for _, w in cut])[variant]
    one = np.uint64(1)
    part = (fps >> low) & ((one << width) - one)
    rest = ((part >> (bit + one)) << bit) | (part & ((one << bit) - one))
    return rest | variant.astype(np.uint64) << np.uint64(56)


def _spanning(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (from, to) of a spanning forest of the distinct fingerprints within ``distance``: each search takes what it links."""
    left = fps
    while len(left) > 1:
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            seed = wave.pop()
            near = np.bitwise_count(left ^ seed) <= distance
            if near.any():
                found = left[near]
                yield np.full(len(found), seed), found
                wave.extend(found)
                left = left[~near]


def _offers(distance: int, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fps in _blocks(frames):
            keys = np.stack([_keys(fps, np.full(len(fps), v), distance) for v in range(BITS)])
            # A part is a hash of the key, so that frequent bit patterns of texts spread.
            part = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, axis=None, kind="stable")
            cuts = np.searchsorted(part.ravel()[order], np.arange(parts + 1, dtype=np.uint64))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[p]:cuts[p + 1]]  # variant-major places in the table of keys
                rows.append((int(p), packing.pack(fps[at % len(fps)], (at // len(fps)).astype(np.uint8))))
            yield pd.DataFrame(rows, columns=["part", "payload"])
        give_back()
    return run


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for frame in frames:
        held.append(frame["fp"].to_numpy(np.int64).view(np.uint64))
        if sum(map(len, held)) >= OFFER_ROWS:
            yield np.concatenate(held)
            held = []
    if held and sum(map(len, held)):
        yield np.concatenate(held)


def _links(distance: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        offers = [packing.unpack(payload) for payload in frame["payload"]]
        fps = np.concatenate([f for f, _ in offers])
        keys = _keys(fps, np.concatenate([v for _, v in offers]), distance)
        order = np.argsort(keys, kind="stable")
        fps, keys = fps[order], keys[order]
        starts = packing.runs(keys)
        ends = np.append(starts[1:], len(keys))
        size = ends - starts
        left, right = [], []
        # Keys of two fingerprints, the usual ones, in one step.
        two = starts[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
        left.append(fps[two][near])
        right.append(fps[two + 1][near])
        for lo, hi in zip(starts[size > 2], ends[size > 2]):
            for a, b in _spanning(fps[lo:hi], distance):
                left.append(a)
                right.append(b)
        pairs = np.stack((np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)), axis=1)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        del fps, keys, order, starts, ends, size, left, right
        give_back()
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``."""
    if not 1 <= distance <= 8:
        raise ValueError("the distance must be 1 to 8 bits")
    total = fps.count()
    parts = max(1, -(-total * BITS // PART_KEYS))
    offered = fps.select("fp").mapInPandas(_offers(distance, parts), "part int, payload binary")
    return offered.groupBy("part").applyInPandas(_links(distance), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42,
                    distance: int = 4) -> DataFrame:
    """(``id_col``, ``fp``, ``component_id``), one row per document.

    ``component_id`` is the smallest id that links reach, itself included.  Texts without words (null, empty,
    white space) share fingerprint zero and are linked like any other.  Rows that repeat an id count
    as they are; a null id never names a component unless the component has no other.
    An empty table gives an empty result; other columns of ``df`` are not read.
    """
    docs = settled(with_fingerprints(df, id_col, text_col, shingle, seed).withColumnRenamed(id_col, "__id"), "simhash-docs")
    classes = settled(docs.groupBy("fp").agg(F.min("__id").alias("first")), "simhash-classes")
    found = settled(links(classes, distance), "simhash-links")
    label = components(found)  # fp -> smallest fp of its component; fingerprints without a link are absent
    named = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")
