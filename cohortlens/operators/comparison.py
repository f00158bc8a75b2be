"""Deltas between phases, side-by-side tables and places in a leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexing import running_before

METRICS = ("balanced_accuracy", "macro_f1", "accuracy")


def phase_delta(current: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Result rows with ``delta_*`` against the same key in the earlier phase."""
    old = baseline.select(*keys, *[F.col(m).alias(f"__old_{m}") for m in metrics])
    joined = current.join(old, list(keys))
    return (joined.withColumns({f"delta_{m}": F.col(m) - F.col(f"__old_{m}") for m in metrics})
            .drop(*[f"__old_{m}" for m in metrics]))


def single_vs_dual(single: DataFrame, dual: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    left = single.select(*keys, *[F.col(m).alias(f"single_{m}") for m in metrics])
    right = dual.select(*keys, *[F.col(m).alias(f"dual_{m}") for m in metrics])
    return left.join(right, list(keys)).withColumns(
        {f"delta_{m}": F.col(f"dual_{m}") - F.col(f"single_{m}") for m in metrics})


def insertion_rank(scores: DataFrame, board: DataFrame, on: Sequence[str], score: str = "score",
                   board_score: str = "score", tables: Sequence[str] = ()) -> DataFrame:
    """Place of each fresh score among published ones: 1 + the number strictly above it.

    ``tables`` are board columns that split the board further, one placement per table.
    Systems and board stand in one descending order, on equal scores the system first: the board rows before a
    system are those above it.  No system meets any board row, whatever their numbers.  A published score
    that is null or NaN is no competitor; a system without a score gets no place (null).
    """
    on, keys = list(on), [*on, *tables]
    fresh = scores.select(*on, "method", F.col(score).alias("score"))
    published = board.select(*keys, F.col(board_score).alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    sizes = published.groupBy(*keys).agg(F.count("*").alias("size"))
    # Without tables, a system without any published competitor still takes place 1 of 1.
    systems = (fresh.join(sizes, on, "inner" if tables else "left")
               .select(*keys, "method", "score", F.coalesce("size", F.lit(0)).alias("size"), F.lit(0).alias("__board")))
    rows = systems.unionByName(published.select(*keys, F.lit(None).cast("string").alias("method"), "score",
                                                F.lit(None).cast("long").alias("size"), F.lit(1).alias("__board")))
    rated = F.when(~F.isnan("score"), F.col("score"))
    placed = running_before(rows, [-rated, F.col("__board"), F.col("method")], "above", keys=keys, value=F.col("__board"))
    return placed.filter("__board = 0").select(
        *keys, "method", "score", F.when(rated.isNotNull(), F.col("above") + 1).alias("estimated_position"),
        (F.col("size") + 1).alias("comparison_set_size"))
