"""Counts of whole texts that quality rules and the quality classifier look at."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .words import WindowHashes, column, inside, mix, small_batches, split_words, spread, word_ids

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "longest_word",
          "n_digits", "n_upper", "n_stops", "n_bytes", "n_code_points")
REPEAT_WINDOW = 8


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a batch; a null text counts as empty."""
    texts = pc.fill_null(texts, "")
    words, offsets = split_words(texts)
    ids, _ = word_ids(words)
    lengths = np.asarray(pc.utf8_length(words), dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    ok = inside(offsets, REPEAT_WINDOW)
    starts = np.flatnonzero(ok)
    windows = WindowHashes(mix(ids.astype(np.uint64) + np.uint64(1))).of(REPEAT_WINDOW)[:len(ok)][starts]
    windows = mix(windows ^ mix(doc[starts].astype(np.uint64) + np.uint64(1 << 40)))
    order = np.argsort(windows, kind="stable")
    runs = packing.runs(windows[order])
    size = np.diff(np.append(runs, len(order)))
    twice = np.zeros(len(ok), bool)
    twice[starts[order[np.repeat(size > 1, size)]]] = True
    span = int(ids.max()) + 1 if len(ids) else 1
    distinct = np.bincount(np.unique(doc * span + ids) // span, minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, lengths)
    lists = pc.split_pattern(texts, "\n")
    line_at = np.asarray(lists.offsets, np.int64)
    lines = lists.values[line_at[0]:line_at[-1]]
    line_at = line_at - line_at[0]
    filled = np.asarray(pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]"))
    line_ids, _ = word_ids(lines)
    line_doc = np.repeat(np.arange(len(texts)), np.diff(line_at))[filled]
    span = int(line_ids.max()) + 1 if len(line_ids) else 1
    n_lines = np.bincount(line_doc, minlength=len(texts))
    different = np.bincount(np.unique(line_doc * span + line_ids[filled]) // span, minlength=len(texts))

    def count(pattern: str) -> np.ndarray:
        return np.asarray(pc.count_substring_regex(texts, pattern), np.int64)
    return {"n_words": np.diff(offsets), "word_chars": sums(lengths, offsets), "n_symbols": count(r"[#*$%&|<>]"),
            "n_dup_lines": n_lines - different, "n_repeat_words": sums(spread(twice, REPEAT_WINDOW, len(words)), offsets),
            "n_lines": n_lines, "n_distinct_words": distinct, "longest_word": longest, "n_digits": count(r"[0-9]"),
            "n_upper": count(r"\p{Lu}"), "n_stops": count(r"[.,;:!?]"),
            "n_bytes": np.asarray(pc.binary_length(texts), np.int64), "n_code_points": np.asarray(pc.utf8_length(texts), np.int64)}


def with_statistics(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns and the counts ``COUNTS`` (long) of every row's whole text."""
    if set(keep) & set(COUNTS):
        raise ValueError(f"kept columns have names of counts: {sorted(set(keep) & set(COUNTS))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", 6_000_000):
            counts = measure(column(batch, "__text"))
            yield pa.RecordBatch.from_arrays(
                [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
                + [pa.array(counts[n], pa.int64()) for n in COUNTS],
                names=[n for n in batch.schema.names if n != "__text"] + list(COUNTS))
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"]
    return rows.mapInArrow(run, ", ".join([*kinds, *(f"{n} long" for n in COUNTS)]))
