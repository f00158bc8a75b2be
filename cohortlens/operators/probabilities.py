"""Probability tables: one row per (record, method) with a class order and a probability array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax_label, double_list, fuse, reorder, string_list


def decode(rows: DataFrame, class_order: str = "class_order", probabilities: str = "probabilities") -> DataFrame:
    """JSON text columns to arrays; unequal lengths are an error."""
    parsed = rows.withColumns({
        class_order: F.from_json(class_order, "array<string>"),
        probabilities: F.from_json(probabilities, "array<double>")})
    same = F.size(class_order) == F.size(probabilities)
    return parsed.withColumn(probabilities, F.when(same, F.col(probabilities)).otherwise(
        F.raise_error(F.lit("as many probabilities as classes are needed")).cast("array<double>")))


def encode(rows: DataFrame, class_order: str = "class_order", probabilities: str = "probabilities") -> DataFrame:
    return rows.withColumns({class_order: F.to_json(class_order), probabilities: F.to_json(probabilities)})


def predict(rows: DataFrame, stored: str | None = None) -> DataFrame:
    """Add ``y_pred``; with ``stored`` fail where the kept label differs from the arg-max."""
    label = argmax_label(F.col("class_order"), F.col("probabilities"))
    if stored is not None:
        kept = F.col(stored)
        label = F.when(kept.isNull() | (kept == "") | (kept == label), label).otherwise(
            F.raise_error(F.lit("the kept label is not the most probable class")))
    return rows.withColumn("y_pred", label)


def reconcile(rows: DataFrame, target: Sequence[str]) -> DataFrame:
    """Bring every row's probabilities into the declared class order."""
    return rows.withColumns({
        "probabilities": reorder(F.col("probabilities"), F.col("class_order"), target),
        "class_order": string_list(target)})


def fuse_tables(first: DataFrame, second: DataFrame, keys: Sequence[str], alpha: Column | float,
                size: int | None = None) -> DataFrame:
    """``first`` with its probabilities fused with those of ``second`` on ``keys``."""
    other = second.select(*keys, F.col("probabilities").alias("__other"))
    return (first.join(other, list(keys))
            .withColumn("probabilities", fuse(F.col("probabilities"), F.col("__other"), alpha, size)).drop("__other"))


def aligned_pairs(first: DataFrame, second: DataFrame, truth: str, key: str = "record_id") -> DataFrame:
    """Both branches' arrays per record; a record or a truth found in one branch only is an error."""
    a = first.select(key, F.col(truth).alias("y_true"), F.col("probabilities").alias("p_first"))
    b = second.select(key, F.col(truth).alias("__truth"), F.col("probabilities").alias("p_second"))
    joined = a.join(b, key, "full_outer")
    matched = F.col("p_first").isNotNull() & F.col("p_second").isNotNull() & F.col("y_true").eqNullSafe(F.col("__truth"))
    return joined.select(key, F.when(matched, F.col("y_true")).otherwise(
        F.raise_error(F.lit("the two readouts differ in records or in truth"))).alias("y_true"), "p_first", "p_second")


def alpha_grid(steps: int = 20) -> list[float]:
    return [i / float(steps) for i in range(steps + 1)]


def alpha_sweep(pairs: DataFrame, keep: Sequence[str], classes: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """One predicted label per pair row and alpha; the arrays are consumed inside the row."""
    spread = pairs.select(*keep, "p_first", "p_second", F.explode(double_list(alphas)).alias("alpha"))
    mixed = fuse(F.col("p_first"), F.col("p_second"), F.col("alpha"), len(classes))
    return spread.select(*keep, "alpha", argmax_label(string_list(classes), mixed).alias("y_pred"))
