"""Fitting linear scorers with MLlib and scoring held-out or left-out rows.

Feature tables carry ``record_id``, ``features`` (array<double> of a declared
dimension) and a label column.  Scaling is learnt on the fit rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.vectors import string_list
from ..session import together
from ..sources.tables import with_dimension
from .checks import fold_leakage


@dataclass(frozen=True)
class Scorer:
    """A fitted model; ``score`` adds probabilities in declared class order."""

    model: LogisticRegressionModel
    classes: tuple[str, ...]

    def score(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows.withColumn("__v", array_to_vector("features")))
        return (scored.withColumn("probabilities", vector_to_array("probability"))
                .withColumn("class_order", string_list(self.classes))
                .drop("__v", "rawPrediction", "probability", "prediction"))


def fit_logreg(rows: DataFrame, label: str, classes: Sequence[str], dim: int, c: float = 1.0, tol: float = 1e-6,
               max_iter: int = 5000) -> Scorer:
    """L2 logistic regression with inverse strength ``c`` on standardised features.

    The estimator standardises inside, on the fit rows.  It divides by the sample
    deviation, the protocol asks for the population deviation; that is one common factor
    sqrt((n - 1) / n) on all features, which the penalty takes up exactly.  Only
    class counts and coefficients reach the driver.
    """
    checked = with_dimension(rows.select("features", label), dim)
    known = F.when(F.col(label).isin(list(classes)), F.col(label))
    found = rows.groupBy(known.alias("known")).agg(F.count("*").alias("n"), F.max(label).alias("example")).collect()
    sizes = {r["known"]: r["n"] for r in found if r["known"] is not None}
    if strange := [r["example"] for r in found if r["known"] is None]:
        raise ValueError(f"label {strange[0]!r} is not among the classes")
    absent = [name for name in classes if not sizes.get(name)]
    if absent:
        raise ValueError(f"classes without fit rows: {absent}")
    n = sum(sizes.values())
    indexed = checked.select(array_to_vector("features").alias("__v"),
                             (F.array_position(string_list(classes), F.col(label)) - 1).cast("double").alias("__y"))
    estimator = LogisticRegression(featuresCol="__v", labelCol="__y", maxIter=max_iter, tol=tol, elasticNetParam=0.0,
                                   regParam=(n - 1) / (n * n * c), standardization=True,
                                   family="binomial" if len(classes) == 2 else "multinomial")
    return Scorer(estimator.fit(indexed), tuple(classes))


def logreg_scores(rows: DataFrame, fit: Column, label: str, classes: Sequence[str], dim: int, **options) -> DataFrame:
    """Every row scored by a model fitted on the ``fit`` rows."""
    return fit_logreg(rows.filter(fit), label, classes, dim, **options).score(rows)


def require_whole_groups(train: DataFrame, fold: str = "fold_id") -> None:
    """Fail when a group has rows in more than one fold; one aggregation over the group and fold columns."""
    if "group_id" not in train.columns:
        raise ValueError("folds can only be checked with a group_id column")
    if not fold_leakage(train, fold).isEmpty():
        raise ValueError("a group has rows in several folds")


def oof_scores(rows: DataFrame, label: str, classes: Sequence[str], dim: int, folds: int = 5, fold: str = "fold_id",
               fit: Callable = fit_logreg, **options) -> DataFrame:
    """Each training row scored once, by the model that ``fit`` makes of the other folds; rows with fold -1 take no part.

    ``rows`` is read by every fit, so pass a stored table; in folders per fold each fit reads only its own part.
    """
    train = rows.filter(F.col(fold) >= 0)
    require_whole_groups(train, fold)

    def one(k: int) -> DataFrame:
        scorer = fit(train.filter(F.col(fold) != k), label, classes, dim, **options)
        return scorer.score(train.filter(F.col(fold) == k))

    return reduce(DataFrame.unionByName, together([lambda k=k: one(k) for k in range(folds)]))


def oof_prior_scores(rows: DataFrame, label: str, classes: Sequence[str], fold: str = "fold_id") -> DataFrame:
    """Leave-one-fold-out with the class shares of the fit rows as the scorer.

    One aggregation gives the counts per fold; the fit counts of a fold are the totals minus its own.
    """
    train = rows.filter(F.col(fold) >= 0)
    own = train.groupBy(fold).agg(F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("own"))
    total = train.agg(F.array(*[F.count_if(F.col(label) == c) for c in classes])).scalar()
    left = own.withColumn("all", total).withColumn("left", F.zip_with("all", "own", lambda t, o: t - o))
    size = F.aggregate("left", F.lit(0).cast("long"), lambda acc, v: acc + v)
    priors = left.select(fold, F.transform("left", lambda v: ratio(v, size)).alias("probabilities"))
    return train.join(priors, fold).withColumn("class_order", string_list(classes))
