"""Exact linear-interpolated quantiles for groups too large to hold in one buffer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
ACCURACY = 10_000


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null; the keys of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)])
    return left.join(named, same).drop(*[f"__r{i}" for i in range(len(keys))])


def counted_quantile(rows: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Quantile ``q`` of ``value`` per ``keys`` as column ``q``, by counting instead of gathering.

    A mergeable sketch brackets the quantile whatever the distribution, and the
    bracket is cut into bins.  Bin counts tell exactly which bins hold the two
    neighbouring ranks, and only the distinct values of those bins are ordered.
    Values outside the bracket form two outer bins, so the result is exact even
    where the sketch misses.  Null keys are keys like any other; keys without a value are absent.
    """
    keys = list(keys)
    near = 5.0 / ACCURACY
    bracket = F.percentile_approx(value, F.array(F.lit(max(0.0, q - near)), F.lit(min(1.0, q + near))), F.lit(ACCURACY))
    known = rows.filter(F.col(value).isNotNull())
    ranges = (known.groupBy(*keys).agg(F.count("*").alias("__n"), bracket.alias("__k"))
              .select(*keys, F.get("__k", F.lit(0)).alias("__lo"), F.get("__k", F.lit(1)).alias("__hi"),
                      (F.lit(q) * (F.col("__n") - 1)).alias("__at")))
    step = (F.col("__hi") - F.col("__lo")) / F.lit(float(BINS))
    inner = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("__lo"), step)), F.lit(BINS - 1)), F.lit(0))
    bin_no = F.when(F.col(value) < F.col("__lo"), -1).when(F.col(value) > F.col("__hi"), BINS).otherwise(inner)
    binned = _joined(known, ranges, keys).select(*keys, "__at", F.col(value).alias("__v"), bin_no.cast("int").alias("__b"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (binned.groupBy(*keys, "__b").agg(F.count("*").alias("__bc"), F.max("__at").alias("__at"))
              .withColumn("__skip", F.coalesce(F.sum("__bc").over(upto), F.lit(0)))
              .filter((F.ceil("__at") >= F.col("__skip")) & (F.floor("__at") < F.col("__skip") + F.col("__bc")))
              .select(*keys, "__b", "__skip"))
    # Equal values collapse before anything is ordered.
    counted = _joined(binned, wanted, [*keys, "__b"]).groupBy(*keys, "__b", "__skip", "__at", "__v").agg(F.count("*").alias("__c"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__first", F.col("__skip") + F.coalesce(F.sum("__c").over(inside), F.lit(0)))

    def at(rank):
        hit = (F.col("__first") <= rank) & (rank < F.col("__first") + F.col("__c"))
        return F.max(F.when(hit, F.col("__v")))

    return (ranked.groupBy(*keys).agg(at(F.floor("__at")).alias("__v0"), at(F.ceil("__at")).alias("__v1"),
                                      F.max(F.col("__at") - F.floor("__at")).alias("__w"))
            .select(*keys, (F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__w")).alias("q")))
