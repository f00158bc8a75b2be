"""Signals as long sample tables ``(record_id, sample_index, value)``: windows, crops, mixing, resampling."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_windows(samples: DataFrame, size: int, records: DataFrame | None = None) -> DataFrame:
    """Consecutive windows of ``size`` samples; the last one is short by its right padding.

    Padding zeros are never stored: a window mean divides by ``size``.  Records
    of ``records`` without samples get one empty window.
    """
    windows = (samples.groupBy("record_id", F.expr(f"sample_index div {size}").cast("int").alias("window_index"))
               .agg(F.count("*").alias("valid_samples"), F.sum("value").alias("__sum")))
    if records is not None:
        # A zero row for every record's first window is added up with what is there: no join, and the samples are read once.
        empty = records.select("record_id").distinct().select(
            "record_id", F.lit(0).alias("window_index"), F.lit(0).cast("long").alias("valid_samples"), F.lit(0.0).alias("__sum"))
        windows = (windows.unionByName(empty).groupBy("record_id", "window_index")
                   .agg(F.sum("valid_samples").alias("valid_samples"), F.sum("__sum").alias("__sum")))
    return windows.select("record_id", "window_index", "valid_samples",
                          (F.lit(size) - F.col("valid_samples")).alias("right_padding_samples"),
                          (F.col("__sum") / F.lit(float(size))).alias("window_mean"))


def fixed_windows(samples: DataFrame, size: int, count: int) -> DataFrame:
    """Exactly ``count`` windows per record; missing or short ones are padded, later samples are outside."""
    numbered = samples.select("record_id", F.expr(f"sample_index div {size}").cast("int").alias("window_index"), "value")
    sums = (numbered.filter(F.col("window_index") < count).groupBy("record_id", "window_index")
            .agg(F.count("*").alias("n"), F.sum("value").alias("s")))
    # The empty slots are rows to add up with, so no join is needed.
    slots = (samples.select("record_id").distinct()
             .select("record_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("window_index"),
                     F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")))
    return (sums.unionByName(slots).groupBy("record_id", "window_index")
            .agg(F.sum("n").alias("valid_samples"), F.sum("s").alias("s"))
            .select("record_id", "window_index", "valid_samples",
                    (F.lit(size) - F.col("valid_samples")).alias("right_padding_samples"),
                    (F.col("s") / F.lit(float(size))).alias("window_mean")))


def max_energy_crop(samples: DataFrame, size: int, chunk: int | None = None) -> DataFrame:
    """Earliest start of the frame of ``size`` samples with the largest sum of squares.

    Each record is cut into chunks and every chunk also receives the first
    ``size - 1`` samples of the next one, so all frames starting in a chunk can be
    summed there and a very long record spreads over many tasks.  A frame is the sum of blocks of
    1, 8, 64 ... samples, each the sum of eight smaller ones, so its energy depends on its own samples
    only: frames of the same samples in the same order tie exactly, wherever they are.  Signals not
    longer than a frame start at 0 and are padded.
    """
    chunk = max(chunk or 65_536, size)
    i = F.col("sample_index")
    own = F.expr(f"sample_index div {chunk}")
    halo = (i % chunk < size - 1) & (own > 0)
    placed = samples.select("record_id", "sample_index", (F.col("value") * F.col("value")).alias("e"),
                            F.explode(F.when(halo, F.array(own - 1, own)).otherwise(F.array(own))).alias("chunk"))
    # Rows reaching past the frame belong to the halo only; frames start inside the chunk itself.
    inside = Window.partitionBy("record_id", "chunk").orderBy("sample_index")
    blocks, width, rest, at = placed.withColumns({"__sum": F.coalesce("e", F.lit(0.0)), "energy": F.lit(0.0)}), 1, size, 0

    def following(first: int, count: int) -> list[Column]:
        return [F.lead("__sum", first + j * width).over(inside) for j in range(count)]

    while rest:
        here, rest = rest % 8, rest // 8
        wider = reduce(add, following(0, 8)) if rest else F.col("__sum")
        blocks = blocks.withColumns({"__sum": wider, "energy": reduce(add, following(at, here), F.col("energy"))})
        at, width = at + here * width, width * 8
    scored = blocks.select("record_id", "sample_index", "chunk", "energy",
                           F.when(F.col("energy").isNotNull(), F.lit(size)).otherwise(F.lit(0)).alias("filled"))
    full = (F.col("filled") == size) & (F.expr(f"sample_index div {chunk}") == F.col("chunk"))
    best = F.min(F.when(full, F.struct((-F.col("energy")).alias("e"), F.col("sample_index").alias("i"))))
    # The own copy of each sample counts the record's length.
    length = F.count_if(F.expr(f"sample_index div {chunk}") == F.col("chunk"))
    return (scored.groupBy("record_id").agg(best.alias("best"), length.alias("n"))
            .select("record_id",
                    F.coalesce(F.col("best.i"), F.lit(0)).cast("long").alias("crop_start_sample"),
                    F.least(F.coalesce(F.col("best.i"), F.lit(0)) + size, F.col("n")).cast("long").alias("crop_end_sample"),
                    F.greatest(F.lit(size) - F.col("n"), F.lit(0)).cast("long").alias("padding_samples")))


def channel_mean(samples: DataFrame) -> DataFrame:
    """Channels mixed to one by the mean per sample."""
    return samples.groupBy("record_id", "sample_index").agg(F.avg("value").alias("value"))


def linear_resample(samples: DataFrame, source_rate: int, target_rate: int) -> DataFrame:
    """Linear interpolation onto the target grid over [0, 1), held at the right end.

    Each source sample serves the targets between it and its successor.  It meets
    that successor in one aggregation on (record, index), so nothing is ordered
    per record and the table is not joined with itself.
    """
    lengths = (samples.groupBy("record_id").agg(F.count("*").alias("n"))
               .withColumn("m", F.bround(F.col("n") * (float(target_rate) / float(source_rate)), 0).cast("long")))
    nothing = F.lit(None).cast("double")
    both = samples.select("record_id", F.inline(F.array(
        F.struct(F.col("sample_index").alias("sample_index"), F.col("value").alias("value"), nothing.alias("nxt")),
        F.struct((F.col("sample_index") - 1).alias("sample_index"), nothing.alias("value"), F.col("value").alias("nxt")))))
    pairs = (both.groupBy("record_id", "sample_index").agg(F.max("value").alias("value"), F.max("nxt").alias("nxt"))
             .filter(F.col("value").isNotNull()).withColumn("nxt", F.coalesce("nxt", "value"))
             .join(lengths, "record_id"))
    i, n, m = F.col("sample_index"), F.col("n"), F.col("m")
    # Targets t with floor(t / m * n) = i; one is allowed on each side and the exact test follows.
    lowest = F.greatest(F.floor(F.try_divide(i * m, n)) - 1, F.lit(0).cast("long"))
    highest = F.least(F.ceil(F.try_divide((i + 1) * m, n)) + 1, m - 1)
    targets = pairs.withColumn("t", F.explode(F.when(highest >= lowest, F.sequence(lowest, highest))))
    at = F.col("t").cast("double") / m * n
    return (targets.withColumn("at", at).filter(F.floor("at") == i)
            .select("record_id", F.col("t").alias("sample_index"),
                    (F.col("value") + (F.col("at") - i) * (F.col("nxt") - F.col("value"))).alias("value")))


def batch_minmax(windows: DataFrame, batch: str, values: str) -> DataFrame:
    """Scale vectors by the min and max of their whole batch: (v - min) / (max - min).

    The bounds are combined map-side and joined back instead of windowed.
    """
    bounds = windows.groupBy(batch).agg(F.min(F.array_min(values)).alias("__lo"), F.max(F.array_max(values)).alias("__hi"))
    joined = windows.join(bounds, batch)
    scaled = F.transform(values, lambda v: F.coalesce(
        F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)))
    return joined.withColumn(values, scaled).drop("__lo", "__hi")
