"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators are written for.  Skewed shuffle joins are
# split by AQE even where that costs one more exchange after the join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Settings a session can only take when it is created: without call-site capture
# building a plan from Python takes a fraction of the time.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


_PLACES: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    That is ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.  Only a session
    that runs in one process may do without; its folder is local.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    place = f"{root.rstrip('/')}/cohortlens-{purpose}-{uuid.uuid4().hex}"
    _PLACES.append(place)
    return place


def clear_scratch(spark: SparkSession) -> int:
    """Delete all folders that this process has taken so far; call it when no DataFrame that reads them is needed any more."""
    places, hadoop = _PLACES.copy(), spark.sparkContext._jsc.hadoopConfiguration()
    for place in places:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(hadoop).delete(path, True)
        _PLACES.remove(place)
    return len(places)


def stored(df: DataFrame, purpose: str, by: Sequence[str] = (), files: int = 0) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back, in folders of ``by``.

    For tables that many jobs read, such as the rows behind a series of fits: each
    job then reads only its columns and folders, and a lost executor re-reads
    files instead of repeating the joins before them.  With ``files``, the rows of a folder are brought to about
    that many files, whatever the number of tasks that write.
    """
    if by and files:
        df = df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    place = scratch(df.sparkSession, purpose)
    df.write.partitionBy(*by).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def together(jobs: Sequence[Callable[[], object]], parallel: int = 8) -> list:
    """Submit independent Spark jobs side by side, results in order.

    Fits and small writes are short jobs with driver latency between them; the cluster's
    scheduler interleaves them.
    """
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(lambda job: job(), jobs))
