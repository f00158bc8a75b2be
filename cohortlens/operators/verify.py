"""Comparison of result tables and content fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_decimals

TOLERANCE = 1e-12


def table_diff(actual: DataFrame, expected: DataFrame, keys: Sequence[str], numbers: Sequence[str],
               texts: Sequence[str] = (), decimals: int = 4, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per key and field: both values, numeric and display agreement, or which side lacks the key."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{mark}_{c}") for c in [*numbers, *texts]],
                         F.lit(True).alias(f"{mark}_in"))

    both = side(actual, "a").join(side(expected, "e"), list(keys), "full_outer")
    state = (F.when(F.col("a_in").isNull(), F.lit("missing")).when(F.col("e_in").isNull(), F.lit("extra"))
             .otherwise(F.lit("both")))
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def line(field: str, a: Column, e: Column, at: Column, et: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), a.alias("actual"), e.alias("expected"),
                        at.alias("actual_text"), et.alias("expected_text"))

    lines = [line(c, F.col(f"a_{c}").cast("double"), F.col(f"e_{c}").cast("double"), no_text, no_text) for c in numbers]
    lines += [line(c, no_number, no_number, F.col(f"a_{c}").cast("string"), F.col(f"e_{c}").cast("string")) for c in texts]
    rows = both.select(*keys, state.alias("state"), F.inline(F.array(*lines)))
    present = F.col("state") == "both"
    gap = F.abs(F.col("actual") - F.col("expected"))
    same = F.when(F.col("actual").isNotNull() | F.col("expected").isNotNull(),
                  F.coalesce(gap <= tolerance, F.lit(False)) | (F.isnan("actual") & F.isnan("expected"))).otherwise(
        F.col("actual_text").eqNullSafe(F.col("expected_text")))
    shown = fixed_decimals(F.col("actual"), decimals).eqNullSafe(fixed_decimals(F.col("expected"), decimals))
    text_same = F.col("actual_text").eqNullSafe(F.col("expected_text"))
    return rows.select(*keys, "field", "state", "actual", "expected", gap.alias("difference"),
                       (present & same).alias("numeric_ok"), (present & shown & text_same).alias("display_ok"))


def verification_report(diffs: Mapping[str, DataFrame]) -> DataFrame:
    """PASS or FAIL per labelled table, with its largest difference."""
    parts = [d.select(F.lit(label).alias("label"), "difference", "numeric_ok", "display_ok") for label, d in diffs.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    good = F.bool_and(F.col("numeric_ok") & F.col("display_ok"))
    return rows.groupBy("label").agg(
        F.when(good, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.when(F.bool_and("numeric_ok"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("numeric_status"),
        F.when(F.bool_and("display_ok"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("display_status"),
        F.coalesce(F.max("difference"), F.lit(0.0)).alias("max_difference"),
        F.count("*").alias("checked"))


def run_comparison(diffs: Mapping[str, DataFrame]) -> DataFrame:
    """One row over all tables of two runs: comparable count, display agreement, largest difference."""
    return verification_report(diffs).agg(
        F.count("*").alias("comparable_table_count"),
        F.bool_and(F.col("display_status") == "PASS").alias("display_consistent"),
        F.max("max_difference").alias("maximum_absolute_difference"))


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the row text: names and types, then every field with its length; null is told apart from any text."""
    header = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns)

    def field(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))
    return F.sha2(F.concat(F.lit(header), *map(field, columns)), 256)


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive content hash: the row count and sums of four 20-bit slices of the row hashes.

    One streaming aggregation; 20-bit parts keep the sums inside a long for 8e12 rows.
    """
    hashed = df.select(row_hash(df, columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 5 * i, 5), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)]
    return hashed.agg(F.count("*").alias("rows"), *[F.coalesce(p, F.lit(0)).alias(f"h{i}") for i, p in enumerate(parts)])


def manifest(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row: row count (under the table's name) and ``<name>_fingerprint`` of every table over the given columns."""
    whole: DataFrame | None = None
    for name, (df, columns) in tables.items():
        one = table_fingerprint(df, columns).select(F.col("rows").alias(name), F.concat_ws("-", "rows", "h0", "h1", "h2", "h3").alias(f"{name}_fingerprint"))
        row = F.struct(*one.columns)
        whole = one if whole is None else whole.withColumn("__m", one.agg(F.first(row)).scalar()).select(*whole.columns, "__m.*")
    return whole


def cache_valid(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Field-by-field comparison of a stored manifest row with the current one: ``(field, expected, actual, ok)``.

    A stored table may be reused only when every row is ok.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in df.columns])
        return df.select(F.inline(pairs))

    return (long(current, "expected").join(long(stored, "actual"), "field", "full_outer")
            .withColumn("ok", F.col("expected").eqNullSafe(F.col("actual"))))
