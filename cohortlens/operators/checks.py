"""Validation as data: every check returns rows, none collects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import string_list
from .metrics import Classes, class_list


def label_domain(records: DataFrame, label: str, declared: Sequence[str]) -> DataFrame:
    """Labels outside the declared list, with their record count."""
    return (records.filter(~F.col(label).isin(list(declared)) | F.col(label).isNull())
            .groupBy(F.col(label).alias("label")).agg(F.count("*").alias("records")))


def class_order_check(rows: DataFrame, by: Sequence[str], declared: Classes) -> DataFrame:
    """Rows per group whose class order is not exactly the declared list."""
    wanted = class_list(declared)
    wrong = ~F.col("class_order").eqNullSafe(wanted)
    return rows.groupBy(*by).agg(F.count("*").alias("checked"), F.count_if(wrong).alias("mismatched"))


def duplicate_keys(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def expectations(df: DataFrame, checks: Sequence[tuple[str, Column, int | Column]]) -> DataFrame:
    """One row per check ``(check, expected, actual, ok)`` from a single aggregation over the data.

    A check is (name, aggregate expression, expected value).
    """
    row = df.agg(*[actual.cast("long").alias(f"a{i}") for i, (_, actual, _) in enumerate(checks)],
                 *[(e if isinstance(e, Column) else F.lit(e)).cast("long").alias(f"e{i}")
                   for i, (_, _, e) in enumerate(checks)])
    lines = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"e{i}").alias("expected"),
                               F.col(f"a{i}").alias("actual")) for i, (name, _, _) in enumerate(checks)])
    return row.select(F.inline(lines)).withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def source_join(records: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Records joined with their source rows on the pseudonym, with the split agreement as a column."""
    other = sources.withColumnRenamed("split", "source_split")
    return records.join(other, key).withColumn("split_agrees", F.col("split").eqNullSafe(F.col("source_split")))


def window_alignment(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows per record over the union of both record sets; ``state`` tells which side is missing."""
    counted = windows.groupBy("record_id").agg(F.count("*").alias("windows"))
    listed = records.select("record_id", F.lit(True).alias("__listed"))
    joined = listed.join(counted, "record_id", "full_outer")
    state = (F.when(F.col("__listed").isNull(), F.lit("unknown record"))
             .when(F.col("windows").isNull(), F.lit("no windows")).otherwise(F.lit("ok")))
    return joined.select("record_id", F.coalesce("windows", F.lit(0)).cast("long").alias("windows"), state.alias("state"))


def branch_alignment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Do two score branches cover the same records with the same truth?  Four counts in one row."""
    a = left.select(*keys, F.col("y_true").alias("ta"), F.lit(True).alias("ia"))
    b = right.select(*keys, F.col("y_true").alias("tb"), F.lit(True).alias("ib"))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("ia") & F.col("ib")).alias("matched"),
        F.count_if(F.col("ib").isNull()).alias("only_left"),
        F.count_if(F.col("ia").isNull()).alias("only_right"),
        F.count_if(F.col("ia") & F.col("ib") & ~F.col("ta").eqNullSafe(F.col("tb"))).alias("truth_mismatch"))


def universe_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Identifiers on one side only, as ``missing`` or ``unexpected``; no rows means equal sets.

    Sides are compared as sets: repeats do not count, null is an identifier like any other.
    """
    sides = (expected.select(key, F.lit(True).alias("e"), F.lit(False).alias("a"))
             .unionByName(actual.select(key, F.lit(False).alias("e"), F.lit(True).alias("a"))))
    return (sides.groupBy(key).agg(F.bool_or("e").alias("e"), F.bool_or("a").alias("a")).filter("e <> a")
            .select(key, F.when(F.col("e"), F.lit("missing")).otherwise(F.lit("unexpected")).alias("state")))


def fold_leakage(records: DataFrame, fold: str = "fold_id", group: str = "group_id") -> DataFrame:
    """Groups that occur in more than one fold, hence in fit and validation parts of some fold."""
    return (records.filter(F.col(fold) >= 0).groupBy(group)
            .agg(F.countDistinct(fold).alias("folds")).filter("folds > 1"))


def shared_groups(records: DataFrame, split: str, group: str, left: str, right: str) -> DataFrame:
    """Groups that occur in both of two splits, by set intersection of the distinct group ids."""
    return (records.filter(F.col(split) == left).select(group)
            .intersect(records.filter(F.col(split) == right).select(group)))


def ordered_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def max_abs_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest element difference between two runs, and whether they hold exactly the same rows.

    ``rows`` are on both sides, ``only_left`` and ``only_right`` on one; any of these, or vectors of different
    lengths, make the runs unequal.  Different lengths, or a number against none, differ by infinity.  ``by``
    columns are among the ``keys``.
    """
    from ..functions.vectors import max_abs_difference
    a = left.select(*keys, F.col(vector).alias("__a"), F.lit(True).alias("__in_a"))
    b = right.select(*keys, F.col(vector).alias("__b"), F.lit(True).alias("__in_b"))
    both = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    equal = F.col("__a").eqNullSafe(F.col("__b"))
    gap = F.when(both & ~equal, F.coalesce(F.when(F.size("__a") == F.size("__b"), max_abs_difference(F.col("__a"), F.col("__b"))),
                                           F.lit(float("inf")))).when(both, F.lit(0.0))
    return a.join(b, list(keys), "full_outer").groupBy(*by).agg(
        F.count_if(both).alias("rows"), F.count_if(F.col("__in_b").isNull()).alias("only_left"),
        F.count_if(F.col("__in_a").isNull()).alias("only_right"), F.max(gap).alias("max_abs_diff"),
        F.bool_and(both & equal).alias("exact"))


def coverage(expected: Sequence[str], produced: DataFrame, label: str = "label") -> DataFrame:
    """Expected table labels against produced ones."""
    want = produced.sparkSession.range(1).select(F.explode(string_list(expected)).alias(label), F.lit(True).alias("e"))
    have = produced.select(label).distinct().withColumn("p", F.lit(True))
    return want.join(have, label, "full_outer").select(
        label, F.when(F.col("p").isNull(), F.lit("missing")).when(F.col("e").isNull(), F.lit("unexpected"))
        .otherwise(F.lit("present")).alias("state"))
