"""Positions and running totals that never put a whole group into one task.

Rows are dealt out by sampled ranges of their sort key, so ids of any type, outliers and
groups of any size spread evenly.  Inside a range the rows are numbered, and shifted by what
the last rows of the ranges before it carry over.  There is one way for every size of table and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def running_before(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = (), value: Column | None = None,
                   partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one within ``keys``.

    ``order`` must be a total order; nulls come first.  Without ``value`` the result is the zero-based position.
    Without ``keys`` the whole table is one group; null keys are a group like any other.  The input is read twice, once
    for the sample of cut points.  Rows are numbered inside their range before they are stored (a lost
    executor cannot redraw the cut points afterwards), and the last row of a range, in a folder of its own, tells the next
    ranges what comes before them: ranges follow the order of the keys, so only the group of that row can go on.
    What is broadcast has one row per range.  Only ``keep`` (all columns where it is not given) and ``name`` are stored and returned.
    """
    keys, cuts = list(keys), [f"__o{i}" for i in range(len(order))]
    kept = list(df.columns if keep is None else keep)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The columns made for the order are not shuffled beside those they come from.
    dealt = df.repartitionByRange(parts, *keys, *order).select("*", *[c.alias(n) for c, n in zip(order, cuts)],
                                                               (F.lit(1) if value is None else value).cast("long").alias("__n"))
    dealt = dealt.withColumn("__part", F.spark_partition_id())
    after = F.lead(F.lit(1)).over(Window.partitionBy("__part").orderBy(*keys, *cuts))
    before = Window.partitionBy("__part", *keys).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (dealt.withColumn("__end", F.when(after.isNull(), F.lit(1)).otherwise(F.lit(0)))
                .withColumn("__local", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    own_keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys) if k not in kept]
    numbered = stored(numbered.select(*kept, *own_keys, "__n", "__part", "__local", "__end"), "numbering", ["__end"])
    keys = [k if k in kept else f"__k{i}" for i, k in enumerate(keys)]
    own = F.struct(*keys) if keys else F.lit(0)
    ends = numbered.filter("__end = 1").select(F.col("__part").alias("__p"), own.alias("__k"), (F.col("__local") + F.col("__n")).alias("__t"))
    # One row per range, whatever the table: windows over them are small.
    so_far = ends.withColumn("__t", F.sum("__t").over(Window.partitionBy("__k").orderBy("__p")))
    previous = Window.orderBy("__p")
    carried = so_far.select("__p", F.lag("__k").over(previous).alias("__k"), F.lag("__t").over(previous).alias("__t"))
    placed = numbered.join(F.broadcast(carried), F.col("__part") == F.col("__p"))
    shift = F.when(F.col("__t").isNotNull() & own.eqNullSafe(F.col("__k")), F.col("__t")).otherwise(F.lit(0))
    return placed.select(*kept, (F.col("__local") + shift).alias(name))


def sorted_position(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Zero-based position in the global order of columns ``order`` (a unique key)."""
    return running_before(df.select(*order), [F.col(c) for c in order], name, partitions=partitions)
