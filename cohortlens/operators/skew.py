"""Separation of keys that hold too many rows for one buffer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_hot(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """``df`` as (rows of keys with at most ``limit`` rows, rows of the others); null keys are keys like any other.

    There are fewer hot keys than rows / limit, so their list is broadcast: neither side of ``df`` is shuffled for it.
    """
    names = [f"__h{i}" for i in range(len(keys))]
    hot = (df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit)
           .select(*[F.col(k).alias(n) for k, n in zip(keys, names)]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return df.join(F.broadcast(hot), same, "left_anti"), df.join(F.broadcast(hot), same, "left_semi")
