"""Tables written to the shared scratch folder between the jobs of one operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import stored

#: A setting of Spark 4.1: the shuffle files of a finished query go at once, not at the driver's next garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches_for(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of at most a thousand rows, so that a worker and its executor hold few of them."""
    if int(spark.conf.get(ROWS)) > 1000:
        spark.conf.set(ROWS, "1000")


def settled(df: DataFrame, purpose: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: a lost executor costs a re-read, not a recomputation."""
    small_batches_for(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored(df, purpose, by)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
