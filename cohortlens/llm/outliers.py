"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Every document is a vector of transformed statistics.  Per group, several starts are refined side by side by concentration
steps, which look for the ``share`` of rows whose covariance has the smallest determinant: distances under the current
estimate are counted in fixed bins together with their moments (one aggregation with map-side
combine, a few hundred rows per group and start), the bins up to the wanted share, the last one in part, give the next
estimate.  After two steps the start with the least determinant goes on until that stops falling, and the least is kept.
Every row takes part, a hot group is never in one task, and runs repeat.

The covariance of an inner share understates the spread, so it is scaled up until the median distance is that of a normal
sample, and rows beyond a high quantile of its distances are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import with_statistics
from .storing import settled

#: Least spread taken for granted per component, so that a group of equal texts does not reject a single odd line.
FLOORS = (0.05, 0.03, 0.04, 0.04, 0.4)
DIM = len(FLOORS)
BINS = 256
#: Rows below which a group joins the rest of its language, and that rest the rest of the table.
LEAST_ROWS = 200
#: Steps of every start, most steps of the best one, fall of the logarithm of the determinant that counts, rows expected in a random start.
FIRST_STEPS, STEPS, FALL, DRAWN = 2, 25, 1e-3, 60
#: Groups whose estimates are broadcast (some 400 bytes each); more of them meet the rows by a salted join.
BROADCAST_GROUPS, SALTS = 50_000, 64


def vector() -> Column:
    """log mean word length, root of the symbol share, shares of repeated lines and words, log number of words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(F.log1p(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
                   F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / words, F.log1p("n_words"))


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)


def chi2_quantile(q: float, dim: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's cube)."""
    return dim * (1 - 2 / (9 * dim) + NormalDist().inv_cdf(q) * (2 / (9 * dim)) ** 0.5) ** 3


def grouped(df: DataFrame, groups: Sequence[str], least: int = LEAST_ROWS) -> DataFrame:
    """``df`` with ``__g``: its (language, source), or a pool where that has too few rows with ``base_failed`` false.

    Only those are estimated, so only they count for the sizes of groups and pools.
    The table of group sizes has one row per group; rows meet it in a join that Spark broadcasts or splits by measured size.
    """
    named = df.withColumns({f"__g{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for i, c in enumerate(groups)})
    keys = [f"__g{i}" for i in range(len(groups))]
    sizes = named.groupBy(*keys).agg(F.count_if(~F.col("base_failed")).alias("count"))
    label = F.concat_ws("\x1f", *keys)
    pools = sizes.groupBy(keys[0]).agg(F.sum(F.when(F.col("count") < least, F.col("count"))).alias("__rest"))
    sizes = (sizes.join(pools, keys[0])
             .select(*keys, F.when(F.col("count") >= least, label).when(F.col("__rest") >= least, F.col(keys[0])).otherwise("").alias("__g")))
    return _beside(named, sizes, keys).drop(*keys)


def _beside(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of a row per group, without a shuffle of the rows by group.

    The table is counted; up to a bound it is broadcast, beyond it each of its rows is copied to all salts.
    """
    table = settled(table, "groups")
    if table.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), list(keys), how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.floor(F.rand(1) * SALTS).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")


def _estimate(centre: np.ndarray, cov: np.ndarray) -> dict:
    """Estimate with variances below the floors raised to them; ``free`` components are above."""
    least = np.square(FLOORS)
    var = np.diag(cov)
    spread = np.sqrt(np.maximum(var, least))
    cov = cov + np.diag(spread ** 2 - var)
    # Components that depend on each other would make it singular: correlations keep a least eigenvalue.
    values, vectors = np.linalg.eigh(cov / np.outer(spread, spread))
    cov = (vectors * np.maximum(values, 1e-3)) @ vectors.T * np.outer(spread, spread)
    root = np.linalg.cholesky(cov)
    # Distances are products with the factor of the inverse covariance.
    return {"centre": centre.tolist(), "factor": np.linalg.inv(root).ravel().tolist(),
            "logdet": 2 * float(np.log(np.diag(root)).sum()), "free": int(max(1, (var > least).sum()))}


def _moments(frame: pd.DataFrame, weight: np.ndarray, tag: str = "") -> tuple[np.ndarray, np.ndarray]:
    n = (frame[f"n{tag}"].to_numpy(float) * weight).sum()
    centre = np.array([(frame[f"s{tag}{i}"].to_numpy() * weight).sum() for i in range(DIM)]) / n
    cov = np.zeros((DIM, DIM))
    for i in range(DIM):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = (frame[f"m{tag}{i}_{j}"].to_numpy() * weight).sum() / n - centre[i] * centre[j]
    return centre, cov


def _middles(frame: pd.DataFrame) -> pd.DataFrame:
    """The first start: median and scaled median deviation of every component, from bins."""
    centre, spread = np.zeros(DIM), np.array(FLOORS)
    for j, part in frame.groupby("j"):
        bins, count = part["bin"].to_numpy(float), part["n"].to_numpy()

        def middle(values: np.ndarray) -> float:
            order = np.argsort(values)
            return values[order][np.searchsorted(np.cumsum(count[order]), count.sum() / 2)]
        centre[j] = (middle(bins) + 0.5) / BINS
        spread[j] = max(FLOORS[j], 1.4826 * middle(np.abs((bins + 0.5) / BINS - centre[j])))
    return pd.DataFrame([{"__g": frame["__g"].iloc[0], "start": 0, "rows": int(frame["n"].sum()) // DIM, **_estimate(centre, np.diag(spread ** 2))}])


def _more_starts(frame: pd.DataFrame) -> pd.DataFrame:
    """From one row per group: the first start, the covariance of directions from the median, and two small random subsets."""
    row = frame.iloc[0]
    centre = np.array(row["centre"])
    own = {"__g": row["__g"], "rows": row["rows"]}
    out = [own | {"start": 0, **{c: row[c] for c in ("centre", "factor", "logdet", "free")}}]
    root = np.linalg.inv(np.array(row["factor"]).reshape(DIM, DIM))
    for start in (1, 2, 3):
        if row[f"n{start}_"] > DIM + 1:
            middle, cov = _moments(frame, np.ones(1), f"{start}_")
            out.append(own | {"start": start, **(_estimate(centre, root @ cov @ root.T * DIM) if start == 1 else _estimate(middle, cov))})
    return pd.DataFrame(out)


def _step(share: float):
    """The next estimate from binned moments; the bin in which the share is reached counts in part."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        count = frame["n"].to_numpy(float)
        wanted = share * count.sum()
        weight = np.clip((wanted - (np.cumsum(count) - count)) / count, 0, 1)
        return pd.DataFrame([{"__g": frame["__g"].iloc[0], "start": int(frame["start"].iloc[0]), "rows": int(count.sum()), **_estimate(*_moments(frame, weight))}])
    return run


def _scale(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("bin")
    middle = int(np.searchsorted(np.cumsum(frame["n"]), frame["n"].sum() / 2))
    median = 2.0 ** ((frame["bin"].iloc[middle] + 0.5) / 32)
    return pd.DataFrame({"__g": [frame["__g"].iloc[0]], "scale": [max(1.0, median / chi2_quantile(0.5, int(frame["free"].iloc[0])))]})


ESTIMATE = "__g string, start int, rows long, centre array<double>, factor array<double>, logdet double, free int"


def _products(x: list[Column], when: Column | None = None, tag: str = "") -> list[Column]:
    """Number, sums and sums of products of some rows, as aggregates."""
    def only(c: Column) -> Column:
        return c if when is None else F.when(when, c)
    return [F.count(only(F.lit(1))).alias(f"n{tag}"), *[F.sum(only(x[i])).alias(f"s{tag}{i}") for i in range(DIM)],
            *[F.sum(only(x[i] * x[j])).alias(f"m{tag}{i}_{j}") for i in range(DIM) for j in range(i + 1)]]


def _lines() -> list[Column]:
    return [sum((F.col("factor")[i * DIM + j] * (F.col("__x")[j] - F.col("centre")[j]) for j in range(i + 1)), F.lit(0.0)) for i in range(DIM)]


def _distance() -> Column:
    return sum((z * z for z in _lines()), F.lit(0.0))


def estimates(rows: DataFrame, share: float = 0.75, steps: int = STEPS) -> DataFrame:
    """(``__g``, ``rows``, ``centre``, ``factor``, ``logdet``, ``free``, ``scale``) for every group of ``rows`` (``__g``, ``__x``)."""
    bins = (rows.select("__g", F.posexplode("__x").alias("j", "v")).groupBy("__g", "j", F.floor(F.col("v") * BINS).alias("bin"))
            .agg(F.count("*").alias("n")))
    x = [F.col("__x")[i] for i in range(DIM)]
    bin_ = F.floor(F.log2(F.greatest(F.col("d"), F.lit(1e-6))) * 32).alias("bin")
    first = bins.groupBy("__g").applyInPandas(_middles, ESTIMATE)
    placed = _beside(rows, first, ["__g"]).withColumn("__z", F.array(*_lines())).withColumn("__r", F.sqrt(_distance()))
    unit = [F.col("__z")[i] / F.col("__r") for i in range(DIM)]
    drawn = [F.pmod(F.xxhash64("__x", F.lit(k)), F.col("rows")) < DRAWN for k in (2, 3)]
    kept = [F.first(c).alias(c) for c in ("rows", "centre", "factor", "logdet", "free")]
    sums = placed.groupBy("__g").agg(*kept, *_products(unit, F.col("__r") > 0, "1_"), *_products(x, drawn[0], "2_"), *_products(x, drawn[1], "3_"))

    def stepped(now: DataFrame) -> DataFrame:
        """All estimates of ``now`` moved on by one step."""
        listed = now.groupBy("__g").agg(F.array_agg(F.struct("start", "centre", "factor")).alias("all"))
        spread = _beside(rows, listed, ["__g"]).select("__g", "__x", F.inline("all"))
        binned = spread.select("__g", "start", "__x", _distance().alias("d")).groupBy("__g", "start", bin_).agg(*_products(x))
        return settled(binned.groupBy("__g", "start").applyInPandas(_step(share), ESTIMATE), "mcd")

    now = settled(sums.groupBy("__g").applyInPandas(_more_starts, ESTIMATE), "mcd")
    for _ in range(FIRST_STEPS):
        now = stepped(now)
    columns = [c for c in now.columns if c != "__g"]
    order = F.struct("logdet", "start")
    best = settled(now.groupBy("__g").agg(F.min_by(F.struct(*columns), order).alias("e")).select("__g", "e.*", F.lit(True).alias("falls")), "mcd")
    for _ in range(steps):
        if best.filter("falls").isEmpty():
            break
        new = stepped(best.filter("falls").drop("falls")).select("__g", F.struct(*columns).alias("new"))
        lower = F.coalesce(F.col("new.logdet") < F.col("logdet") - FALL, F.lit(False))
        best = settled(best.join(new, "__g", "left").select("__g", *[F.when(lower, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns],
                                                            lower.alias("falls")), "mcd")
    best = best.drop("falls")
    binned = _beside(rows, best, ["__g"]).withColumn("d", _distance()).groupBy("__g", bin_).agg(F.count("*").alias("n"), F.first("free").alias("free"))
    scale = binned.groupBy("__g").applyInPandas(_scale, "__g string, scale double")
    return settled(best.join(scale, "__g"), "mcd")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Sequence[str] = ("lang", "source"),
                  share: float = 0.75, quantile: float = 0.9999) -> DataFrame:
    """One row per document: ``id_col``, all counts, ``base_failed``, ``distance`` (squared, robust) and ``kept``.

    ``kept`` is false if the base rules fail, or if the distance is beyond ``quantile`` of the chi-square distribution with as many
    degrees as there are components.  Variances below the squares of ``FLOORS`` count as these; the scale of distances is only ever
    lowered, so a group of equal texts does not turn small differences into outliers.
    A null text counts as empty and fails the base rules.  A null language or source is a group of its
    own.  Groups of fewer than 200 rows that pass the base rules are pooled by language and then over the table; if even
    that pool is smaller, its rows have no distance and only the base rules count.  Rows that fail the base
    rules take no part in the estimates.  Very long texts are counted whole, in one task.  An empty table gives an empty result; repeated rows give repeated rows.
    """
    named = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(groups)])
    stats = settled(with_statistics(named, "__text", keep=["__id", *[f"__k{i}" for i in range(len(groups))]]), "statistics")
    rows = settled(grouped(stats.withColumns({"base_failed": base_failed(), "__x": vector()}), [f"__k{i}" for i in range(len(groups))]),
                   "statistics-grouped")
    found = estimates(rows.filter(~F.col("base_failed")).select("__g", "__x"), share).filter(F.col("rows") >= LEAST_ROWS)
    judged = _beside(rows, found.drop("rows"), ["__g"], "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2_quantile(quantile, DIM))
    others = [c for c in stats.columns if not c.startswith("__")]
    return judged.select(F.col("__id").alias(id_col), *others, "base_failed", "distance", kept.alias("kept"))
