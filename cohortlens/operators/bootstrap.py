"""Patient-cluster paired bootstrap.

Records are combined to confusion cells per patient first, so a draw only ever
touches those cells.  Draws come from a hash of (draw, slot): they need no
storage, are the same for every method, and can be made in any number of tasks.
Result tables use ``slots.resampled_confusions``; the one here takes draws that are given as a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import slots
from .indexing import running_before
from .metrics import Classes, official_score_from_counts, per_class_counts, summarise_classes

# About 24 bytes per cell: at most some 50 MB per executor.
BROADCAST_CELLS = 2_000_000


def patient_positions(records: DataFrame, group: str = "group_id", by: Sequence[str] = ("task",)) -> DataFrame:
    """Position of every distinct group in sorted order, per ``by``: every task has its own patients."""
    return running_before(records.select(*by, group).distinct(), [F.col(group)], "patient_index", keys=by)


def patient_confusions(predictions: DataFrame, positions: DataFrame, by: Sequence[str] = ("task", "method"),
                       group: str = "group_id") -> DataFrame:
    """Confusion cells per patient; combined on the group before positions are attached."""
    cells = (predictions.groupBy(*by, group, F.col("y_true").alias("truth"), F.col("y_pred").alias("predicted"))
             .agg(F.count("*").alias("n")))
    return cells.join(positions, ["task", group]).drop(group)


def draws(spark: SparkSession, patients: Mapping[str, int], replicates: int) -> DataFrame:
    """``(task, draw, slot, patient_index)``: per task as many slots per draw as it has patients, filled with replacement.

    All methods of a task share its draws.  The slots are spread evenly over tasks; see ``slots`` for how they are filled.
    """
    return slots.in_long_form(slots.pieces(spark, patients, replicates))


def resampled_confusions(cells: DataFrame, drawn: DataFrame, replicates: int, by: Sequence[str] = ("task", "method"),
                         broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Confusion cells per draw; a patient drawn twice counts twice, a cell that no drawn patient has counts zero.

    So a method without any record in a draw is there with empty classes, and its metrics are NaN.

    Every distinct (method, labels) cell gets a small number; there are at most
    methods x classes^2 of them.  A patient's cells are packed into one row of
    (number, count) pairs, so each drawn slot is joined once and the sums per draw
    hash two integers.  The packed table is broadcast only after its cells have been
    counted, which leaves the draws in place; above the bound both sides are shuffled.
    ``cells`` is read more than once, so pass a stored table.
    """
    labels = [*by, "truth", "predicted"]
    codes = cells.select(*labels).distinct().withColumn("cell", F.row_number().over(Window.orderBy(*labels)))
    packed = (cells.join(codes, labels).groupBy("task", "patient_index")
              .agg(F.array_agg(F.struct("cell", "n")).alias("cells")))
    packed = F.broadcast(packed) if cells.count() <= broadcast_cells else packed.hint("shuffle_hash")
    hits = drawn.select("task", "draw", "patient_index").join(packed, ["task", "patient_index"]).select("draw", F.inline("cells"))
    nothing = codes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("draw"), "cell", F.lit(0).cast("long").alias("n"))
    sums = hits.unionByName(nothing).groupBy("draw", "cell").agg(F.sum("n").alias("n"))
    return sums.join(codes, "cell").select("draw", *labels, "n")


def classification_replicates(resampled: DataFrame, by: Sequence[str], classes: Classes) -> DataFrame:
    """Balanced accuracy, macro F1 (2TP/(T+P)) and accuracy per draw; a class missing from a draw gives NaN."""
    keys = ["draw", *by]
    return summarise_classes(per_class_counts(resampled, keys, classes), keys, absent="nan").drop("record_count")


def challenge_replicates(resampled: DataFrame, by: Sequence[str], normal: str | Mapping[str, str],
                         sensitive: Classes) -> DataFrame:
    """SE, SP, AS, HS and Score per draw; an empty population gives NaN."""
    return official_score_from_counts(resampled, ["draw", *by], normal, sensitive, empty="nan").drop("record_count")


def to_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str], value: str = "value") -> DataFrame:
    return wide.unpivot(list(keys), list(metrics), "metric", value)


def percentile_interval(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Linear 2.5 and 97.5 percentiles per group; NaN where any replicate is NaN.

    A group holds one value per replicate, so the exact percentile buffer is bounded by the draw count.
    """
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    broken = F.bool_or(F.isnan(value))
    nan = F.lit(float("nan"))
    return (values.groupBy(*by).agg(ends.alias("e"), broken.alias("b"), F.count("*").alias("replicates"))
            .select(*by, F.when(F.col("b"), nan).otherwise(F.get("e", F.lit(0))).alias("ci_lower"),
                    F.when(F.col("b"), nan).otherwise(F.get("e", F.lit(1))).alias("ci_upper"), "replicates"))


def paired_differences(values: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]],
                       value: str = "value") -> DataFrame:
    """``left - right`` of the same key for every method pair, named ``"left - right"``.

    The methods of a key are put side by side by one aggregation instead of self-joins.
    """
    names = list(dict.fromkeys(m for pair in pairs for m in pair))
    wide = values.groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col(value))).alias(f"m{i}")
                                       for i, m in enumerate(names)])
    lines = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("method"),
                               (F.col(f"m{names.index(a)}") - F.col(f"m{names.index(b)}")).alias(value))
                      for a, b in pairs])
    return wide.select(*keys, F.inline(lines))


def interval_table(points: DataFrame, replicates: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Point estimate and interval per (task, method, metric), methods first and then their differences."""
    keys = ["task", "metric"]
    all_points = points.unionByName(paired_differences(points, keys, pairs))
    all_values = replicates.unionByName(paired_differences(replicates, ["draw", *keys], pairs))
    ends = percentile_interval(all_values, ["task", "method", "metric"])
    return (all_points.withColumnRenamed("value", "point_estimate").join(ends, ["task", "method", "metric"]))
