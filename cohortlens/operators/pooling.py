"""Window vectors to record vectors.

Vectors are ``array<double>`` with a declared dimension; another one is an error, and windows
without a vector do not count.  Vectors are aggregated in blocks of elements: a window
gives one row per block to a hash aggregation with map-side combine, so what is shuffled depends on
groups and blocks, not on windows times elements, and no record is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_dimension
from .quantiles import counted_quantile
from .skew import split_hot

#: Aggregate columns per row of the aggregation; a wider vector takes several blocks.
BLOCK = 64
Combine = Callable[[Column], Column]


def gather(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, dim, value) rows back to one array per key; each list holds one entry per dimension."""
    ordered = F.array_sort(F.array_agg(F.struct("dim", F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias(name))


def pool_many(windows: DataFrame, keys: Sequence[str], dim: int, combines: Sequence[Combine], vector: str = "features",
              extra: Sequence[Column] = ()) -> DataFrame:
    """Apply each aggregate of ``combines`` to every element of ``vector`` per ``keys``.

    ``vector`` becomes an array of one array per aggregate; the aggregates ``extra`` ride along.
    """
    width = max(1, BLOCK // len(combines))
    rows = with_dimension(windows.filter(F.col(vector).isNotNull()), dim, vector)
    if dim > width:  # the same aggregation, over blocks of the vector
        rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((dim - 1) // width))))
        rows = rows.withColumn(vector, F.slice(vector, F.col("__block") * width + 1, F.lit(width)))
    cells = [F.array(*[c(F.get(vector, F.lit(i))) for i in range(min(dim, width))]) for c in combines]
    by = [*keys, "__block"] if dim > width else list(keys)
    pooled = rows.groupBy(*by).agg(F.array(*cells).alias(vector), *extra)
    if dim <= width:
        return pooled
    others = [c for c in pooled.columns if c not in (*by, vector)]
    ordered = F.array_sort(F.array_agg(F.struct("__block", F.col(vector).alias("v"))))
    whole = pooled.groupBy(*keys).agg(ordered.alias("__all"), *[F.any_value(c).alias(c) for c in others])

    def of(i: int) -> Column:
        return F.slice(F.flatten(F.transform("__all", lambda s: s["v"][i])), 1, dim)

    joined = map(of, range(len(combines)))
    return whole.select(*keys, F.array(*joined).alias(vector), *others)


def pool(windows: DataFrame, keys: Sequence[str], dim: int, combine: Combine, vector: str = "features",
         extra: Sequence[Column] = ()) -> DataFrame:
    """:func:`pool_many` with one aggregate, whose array is ``vector``."""
    return pool_many(windows, keys, dim, [combine], vector, extra).withColumn(vector, F.col(vector)[0])


def mean_pool(windows: DataFrame, dim: int, keys: Sequence[str] = ("record_id",), vector: str = "features") -> DataFrame:
    return pool(windows, keys, dim, F.avg, vector)


def min_length_mean_pool(chunks: DataFrame, dim: int, frames: str, least: int = 16, empty: str = "error") -> DataFrame:
    """Mean over chunks of at least ``least`` frames; a record with none left is an error, or null on ``empty='null'``."""
    kept = F.count_if(F.col(frames) >= least)

    def combine(x: Column) -> Column:
        return F.avg(F.when(F.col(frames) >= least, x))

    pooled = pool(chunks, ["record_id"], dim, combine, extra=[kept.alias("chunks_used")])
    nothing = F.lit(None) if empty == "null" else F.raise_error(F.lit("no valid chunk for record"))
    return pooled.withColumn("features", F.when(F.col("chunks_used") > 0, F.col("features")).otherwise(
        nothing.cast("array<double>")))


def distances(windows: DataFrame, dim: int, chunk: int) -> DataFrame:
    """Every window vector with its chunk and its Euclidean distance to the record's mean vector.

    The windows are shuffled once, by (record, chunk).  Chunk sums, the join with the
    centres and all later steps per chunk use that same exchange; the null filter, which the
    join implies anyway, is written out so that both of its readers have the same plan.
    """
    cut = (windows.select("record_id", F.expr(f"window_index div {chunk}").alias("chunk"), "features")
           .filter("record_id is not null and chunk is not null and features is not null").repartition("record_id", "chunk"))
    sums = pool(cut, ["record_id", "chunk"], dim, F.sum, extra=[F.count("*").alias("n")])
    # A record's chunks ride along with its sums (one number per ``chunk`` windows), so each meets its centre without another pass over the windows.
    whole = pool(sums, ["record_id"], dim, F.sum, extra=[F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")])
    placed = whole.select("record_id", F.explode("chunks").alias("chunk"), F.transform("features", lambda v: v / F.col("n")).alias("__centre"))
    squares = F.zip_with("features", "__centre", lambda x, c: (x - c) * (x - c))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))
    return cut.join(placed, ["record_id", "chunk"]).withColumn("distance", distance).drop("__centre")


def sdp_pool(windows: DataFrame, dim: int, temperatures: Sequence[float], chunk: int = 16_384) -> DataFrame:
    """Softmax-distance pooling per record and temperature: windows far from the mean weigh more.

    The distances are computed once for all temperatures.  The softmax is taken
    inside chunks of ``chunk`` windows against the chunk's own maximum, and the chunk
    sums are then rescaled to the record's maximum.  That equals the softmax over the
    record while a record with very many windows stays spread out.
    """
    if min(temperatures) <= 0:
        raise ValueError("temperatures have to be above zero")
    top = F.max("distance").over(Window.partitionBy("record_id", "chunk"))
    steps = [float(t) for t in temperatures]
    # Every window stays one row: its weights for all temperatures are columns.
    weighed = distances(windows, dim, chunk).withColumn("top", top).withColumns(
        {f"w{i}": F.exp((F.col("distance") - F.col("top")) / t) for i, t in enumerate(steps)})
    parts = pool_many(weighed.select("record_id", "chunk", "top", "features", *[f"w{i}" for i in range(len(steps))]),
                      ["record_id", "chunk"], dim, [lambda x, i=i: F.sum(F.col(f"w{i}") * x) for i in range(len(steps))],
                      extra=[*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(steps))], F.max("top").alias("top")])
    # One row per (record, chunk) from here on, with all temperatures: chunk sums are rescaled to the record's maximum and added up.
    peak = F.max("top").over(Window.partitionBy("record_id"))
    scaled = parts.withColumn("peak", peak).withColumns({f"r{i}": F.exp((F.col("top") - F.col("peak")) / t) for i, t in enumerate(steps)})

    def times(vector: Column, factor: Column) -> Column:
        return F.transform(vector, lambda v: v * factor)

    every = F.array(*[times(F.col("features")[i], F.col(f"r{i}")) for i in range(len(steps))])
    scaled = scaled.select("record_id", F.flatten(every).alias("features"), *[(F.col(f"r{i}") * F.col(f"w{i}")).alias(f"w{i}") for i in range(len(steps))])
    pooled = pool(scaled, ["record_id"], dim * len(steps), F.sum, extra=[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(steps))])

    def over(vector: Column, total: Column) -> Column:
        return F.transform(vector, lambda v: v / total)

    lines = F.array(*[F.struct(F.lit(t).alias("temperature"), over(F.slice("features", i * dim + 1, dim), F.col(f"w{i}")).alias("features"))
                      for i, t in enumerate(steps)])
    return pooled.select("record_id", F.inline(lines))


def sorted_quantile(x: Column, q: float) -> Column:
    """Linear quantile as an aggregate over a bounded group."""
    values = F.sort_array(F.collect_list(x))
    at = F.lit(q) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def q75_pool(windows: DataFrame, dim: int, q: float = 0.75, hot_rows: int = 200_000) -> DataFrame:
    """Exact linear quantile of every dimension per record.

    Ordinary records sort their values in the aggregation buffer, which is faster than the
    built-in percentile's value map.  Records with more than ``hot_rows`` windows take the
    counting form, so no buffer grows beyond that.
    """
    rows = with_dimension(windows.select("record_id", "features").filter("features is not null"), dim)
    ordinary, hot = split_hot(rows, ["record_id"], hot_rows)
    plain = pool(ordinary, ["record_id"], dim, lambda x: sorted_quantile(x, q))
    spread = hot.select("record_id", F.posexplode("features").alias("dim", "x"))
    # Every dimension of a hot record has an entry, null where it has no value.
    empty = hot.groupBy("record_id").agg(F.sequence(F.lit(0), F.lit(dim - 1)).alias("dim")).select("record_id", F.explode("dim").alias("dim"))
    cells = counted_quantile(spread, ["record_id", "dim"], "x", q).unionByName(empty.withColumn("q", F.lit(None).cast("double")))
    cells = cells.groupBy("record_id", "dim").agg(F.max("q").alias("q"))
    counted = gather(cells, ["record_id"], "q", "features")
    return plain.unionByName(counted)


def moments(rows: DataFrame, dim: int, vector: str = "features") -> Column:
    """Scalar subquery with the mean and population deviation arrays of ``rows``; its size is twice ``dim``."""
    both = pool_many(rows.select(F.lit(1).alias("__all_rows"), vector), ["__all_rows"], dim, [F.avg, F.stddev_pop], vector)
    return both.select(F.struct(F.col(vector)[0].alias("mean"), F.col(vector)[1].alias("std")).alias("z")).scalar()


def standardise(rows: DataFrame, fit: Column, dim: int, vector: str = "features") -> DataFrame:
    """Mean 0 and population deviation 1, learnt on the ``fit`` rows only; a constant dimension is divided by 1."""
    # One row of 2 * dim numbers, whatever the table size.
    scaled = rows.withColumn("__z", moments(rows.filter(fit), dim, vector))
    centred = F.zip_with(vector, "__z.mean", lambda x, m: x - m)
    return scaled.withColumn(vector, F.zip_with(
        centred, "__z.std", lambda x, s: x / F.when(s == 0.0, F.lit(1.0)).otherwise(s))).drop("__z")
