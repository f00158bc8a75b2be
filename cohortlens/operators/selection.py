"""Hyper-parameter choice by declared tie-break rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_alphas(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank a grid by balanced accuracy, macro F1, closeness to 0.5, then the smaller alpha.

    The window holds the grid of one task, not data rows.
    """
    order = Window.partitionBy(*by).orderBy(
        F.desc("balanced_accuracy"), F.desc("macro_f1"), F.abs(F.col("alpha") - 0.5), F.col("alpha"))
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("selected", F.col("rank") == 1)


def mean_over_folds(scores: DataFrame, by: Sequence[str], score: str = "Score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(score).alias("mean_score"))


def incumbent(means: DataFrame, by: Sequence[str], candidate: str, score: str = "mean_score",
              margin: float = 1e-4) -> DataFrame:
    """Ascending pass over the candidates; one replaces the incumbent only if it beats it by more than ``margin``.

    The pass depends on its own earlier outcome, so each task's grid (a declared,
    short list) is folded in order inside one row.
    """
    grid = means.groupBy(*by).agg(F.array_sort(F.array_agg(
        F.struct(F.col(candidate).alias("candidate"), F.col(score).alias("score")))).alias("grid"))

    def step(held: Column, offer: Column) -> Column:
        return F.when(offer["score"] > held["score"] + F.lit(margin), offer).otherwise(held)

    return grid.select(*by, F.aggregate(F.slice("grid", 2, F.size("grid")), F.get("grid", F.lit(0)), step)
                       .getField("candidate").alias("selected"))
