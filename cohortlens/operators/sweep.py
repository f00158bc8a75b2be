"""Fusion weights on a fine grid: confusion cells change only where the lines of two classes cross.

A record's fused probability of a class is a line over the weight, so the most probable class changes at
crossings on the upper envelope of these lines.  Labels are evaluated at the grid points beside such crossings only,
by the same expression as a full sweep; a record sends its first label and its changes, and running sums over the
(small) table of changes give the cells of every weight.  What is shuffled depends on classes and changes, not on records times weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import all_finite, argmax_label, fuse, string_list

#: Lines closer than this (relative) at both ends are within rounding of each other on the whole grid.
CLOSE = 1e-9


def grid_points(first: Column, second: Column, size: int, steps: int) -> Column:
    """Ascending grid numbers 0..steps at which the label can differ from that of the number before, and 0.

    All numbers where a value is not finite or two different lines are within rounding of each other.
    """
    p, q = ([F.get(v, F.lit(i)) for i in range(size)] for v in (first, second))
    scale = F.greatest(F.lit(1e-300), *map(F.abs, p + q)) if size else F.lit(1.0)
    near, found = F.lit(False), []
    for i, j in combinations(range(size), 2):
        rise, start = (p[i] - q[i]) - (p[j] - q[j]), q[j] - q[i]
        apart = F.greatest(F.abs(p[i] - p[j]), F.abs(q[i] - q[j]))
        near = near | ((apart > 0) & (apart <= CLOSE * scale))
        at = F.try_divide(start, rise)
        value = at * p[i] + (F.lit(1.0) - at) * q[i]
        top = F.greatest(*[at * a + (F.lit(1.0) - at) * b for a, b in zip(p, q)], F.lit(float("-inf")))
        found.append(F.when((F.abs(at) <= 2) & (value >= top - CLOSE * scale), F.floor(at * F.lit(float(steps))).cast("int")))
    crossings = F.filter(F.array(*found, F.lit(None).cast("int")), lambda x: x.isNotNull())
    # A crossing may be one grid number off by rounding, and a tie may go to either side.
    beside = F.flatten(F.transform(crossings, lambda x: F.array(x, x + 1, x + 2)))
    some = F.array_sort(F.array_union(F.array(F.lit(0)), F.filter(beside, lambda x: (x >= 0) & (x <= steps))))
    plain = all_finite(first) & all_finite(second) & ~near
    return F.when(F.coalesce(plain, F.lit(False)), some).otherwise(F.sequence(F.lit(0), F.lit(steps)))


def label_changes(pairs: DataFrame, keep: Sequence[str], classes: Sequence[str], steps: int) -> DataFrame:
    """``(keep, predicted, at, step)``: +1 where a label begins, -1 where it ends, per pair row of ``p_first`` and ``p_second``."""
    names = string_list(classes)
    points = pairs.select(*keep, "p_first", "p_second", grid_points(F.col("p_first"), F.col("p_second"), len(classes), steps).alias("__at"))

    def label(i: Column) -> Column:
        mixed = fuse(F.col("p_first"), F.col("p_second"), i.cast("double") / F.lit(float(steps)), len(classes))
        # Without values there is no label; the condition keeps the field nullable.
        return F.struct(i.alias("at"), F.when(F.array_max(mixed).isNotNull(), argmax_label(names, mixed)).alias("predicted"))
    seen = points.select(*keep, F.transform("__at", label).alias("__seen"))

    def change(x: Column, k: Column) -> Column:
        before = F.get("__seen", k - 1)
        begins = F.struct(x["predicted"].alias("predicted"), x["at"].alias("at"), F.lit(1).alias("step"))
        ends = F.struct(before["predicted"].alias("predicted"), x["at"].alias("at"), F.lit(-1).alias("step"))
        return (F.when(k == 0, F.array(begins)).when(x["predicted"].eqNullSafe(before["predicted"]), F.slice(F.array(begins), 1, 0))
                .otherwise(F.array(ends, begins)))
    return seen.select(*keep, F.inline(F.flatten(F.transform("__seen", change))))


def sweep_counts(pairs: DataFrame, by: Sequence[str], classes: Sequence[str], steps: int = 20, truth: str = "y_true") -> DataFrame:
    """Non-zero confusion cells ``(by, alpha, truth, predicted, n)`` of every weight ``i / steps``.

    Equal to the cells of all labels of ``probabilities.alpha_sweep`` at these weights: ties go to the earlier class, values
    that are null or not finite are evaluated at every weight, a row without an array has the label null, an empty table has no cells.
    """
    changes = label_changes(pairs.withColumnRenamed(truth, "truth"), [*by, "truth"], classes, steps)
    cells = [*by, "truth", "predicted"]
    sums = changes.groupBy(*cells, "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*cells).orderBy("at")
    runs = sums.select(*cells, "at", F.lead("at", 1, steps + 1).over(order).alias("end"),
                       F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    at = F.explode(F.sequence("at", F.col("end") - 1)).alias("at")
    return (runs.filter("n > 0").select(*cells, "n", at)
            .select(*by, (F.col("at").cast("double") / F.lit(float(steps))).alias("alpha"), "truth", "predicted", "n"))
