"""Many scorers at once: every (part, task, left-out fold) cell is fitted and applied in common passes over the rows.

A part is one set of feature vectors of the records (a readout, a temperature, an encoder).  A task has a label column,
its classes in declared order and a fold column.  Each cell is a model of the training rows of its part and task outside one
fold, or of all of them (left-out fold -1).  A training row is scored by the model that left its fold out,
any other row by the model of all training rows.

Class means need one aggregation: sums per fold, added up over the folds that stay.  Logistic regressions
take Newton steps together: one pass over the rows brings the gradient and Hessian of all open cells, and the
number of passes is that of the steps.  What reaches the driver is the size of the models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import string_list
from ..session import stored
from ..sources.tables import with_dimension
from .pooling import pool, pool_many

#: Bounds of what a model may have: the Hessian of one cell has to fit a task, all models together the driver.
MOST_PARAMETERS, MOST_NUMBERS = 4096, 50_000_000
#: Partial sums that one task adds up.
FAN_IN = 32


@dataclass(frozen=True)
class Task:
    """Label column, classes in declared order, and the fold column (None: only models of all training rows)."""

    label: str
    classes: tuple[str, ...]
    fold: str | None = None


@dataclass(frozen=True)
class Cells:
    """Rows ready for fitting: ``part``, ``features``, and per task i the class place ``__y{i}`` and fold ``__f{i}`` (-1 outside training)."""

    rows: DataFrame
    tasks: dict[str, Task]
    dim: int
    folds: int

    @property
    def outs(self) -> dict[str, list[int]]:
        """Left-out folds per task."""
        return {name: [-1, *(range(self.folds) if t.fold else [])] for name, t in self.tasks.items()}

    def tall(self) -> DataFrame:
        """A row per task: ``task``, ``y_true``, ``fold`` and all other columns."""
        each = F.array(*[F.struct(F.lit(name).alias("task"), F.col(t.label).cast("string").alias("y_true"), F.col(f"__y{i}").alias("__y"),
                                  F.col(f"__f{i}").alias("__f")) for i, (name, t) in enumerate(self.tasks.items())])
        hidden = {f"__{k}{i}" for k in "yf" for i in range(len(self.tasks))}
        kept = [c for c in self.rows.columns if c not in hidden and c not in ("task", "y_true")]
        return self.rows.select(*kept, F.inline(each))


def place(rows: DataFrame, tasks: Mapping[str, Task], dim: int, train: Column, folds: int = 5) -> Cells:
    """Rows with their class places and folds, unchecked; ``rows`` has ``part``, ``record_id``, ``features``, and the label and fold columns."""
    columns = {}
    for i, t in enumerate(tasks.values()):
        fold = F.coalesce(F.col(t.fold), F.lit(-1)) if t.fold else F.lit(0)
        columns[f"__f{i}"] = F.when(train, fold).otherwise(F.lit(-1)).cast("int")
        columns[f"__y{i}"] = (F.array_position(string_list(list(t.classes)), F.col(t.label).cast("string")) - 1).cast("int")
    return Cells(with_dimension(rows.withColumns(columns), dim), dict(tasks), dim, folds)


def prepare(rows: DataFrame, tasks: Mapping[str, Task], dim: int, train: Column, folds: int = 5) -> Cells:
    """:func:`place` with the rows stored and checked.

    A training row with a label outside the classes, a class without training rows in some cell, or a group with training
    rows in two folds of a task is an error.
    """
    cells = place(rows, tasks, dim, train, folds)
    table = stored(cells.rows, "cells", ["part"], files=8)
    cells = Cells(table, cells.tasks, dim, folds)
    folded = [i for i, t in enumerate(tasks.values()) if t.fold]
    if folded:
        if "group_id" not in table.columns:
            raise ValueError("folds can only be checked with a group_id column")
        own = {i: F.when(F.col(f"__f{i}") >= 0, F.col(f"__f{i}")) for i in folded}
        ends = table.groupBy("group_id").agg(*[f(own[i]).alias(f"{n}{i}") for i in folded for n, f in (("lo", F.min), ("hi", F.max))])
        if not ends.filter(reduce(lambda a, b: a | b, [F.col(f"lo{i}") < F.col(f"hi{i}") for i in folded])).isEmpty():
            raise ValueError("a group has rows in several folds")
    found = cells.tall().filter("__f >= 0").groupBy("part", "task", "__f", "__y").agg(F.count("*").alias("n"), F.max("y_true").alias("example")).collect()
    strange = [r["example"] for r in found if r["__y"] is None or r["__y"] < 0]
    if strange:
        raise ValueError(f"label {strange[0]!r} is not among the classes")
    for part, (name, t) in product(sorted({r["part"] for r in found}), tasks.items()):
        for out in cells.outs[name]:
            seen = {r["__y"] for r in found if r["part"] == part and r["task"] == name and r["__f"] != out}
            if len(seen) < len(t.classes):
                raise ValueError(f"classes without fit rows: {[c for k, c in enumerate(t.classes) if k not in seen]}")
    return cells


def _applied(cells: Cells, models: DataFrame, probabilities: Column) -> DataFrame:
    """Every row of every task beside its model, by (part, task, fold), with ``class_order`` and ``probabilities``."""
    order = F.lit(None).cast("array<string>")
    for name, t in cells.tasks.items():
        order = F.when(F.col("task") == name, string_list(list(t.classes))).otherwise(order)
    keyed = models.withColumnsRenamed({"part": "__part", "task": "__task"})
    rows = cells.tall().withColumn("class_order", order)
    whole = reduce(lambda a, b: a | b, [F.col("task") == n for n, t in cells.tasks.items() if not t.fold], F.lit(False))
    on = [F.col("part") == F.col("__part"), F.col("task") == F.col("__task"), F.when(whole, F.lit(-1)).otherwise(F.col("__f")) == F.col("out")]
    return (rows.join(keyed, on).withColumn("probabilities", probabilities)
            .withColumnRenamed("__f", "fold").drop("__part", "__task", "out", "__y", "features", *[c for c in models.columns if c not in ("part", "task", "out")]))


def _shares(values: Column) -> Column:
    """Non-negative numbers of a row scaled to sum 1."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(F.array(F.struct(values.alias("v"), total.alias("t"))), lambda s: F.transform(s["v"], lambda v: v / s["t"]))[0]


def mean_models(cells: Cells) -> DataFrame:
    """(part, task, out, ``means``: class to mean vector) of the training rows of every cell."""
    own = pool(cells.tall().filter("__f >= 0"), ["part", "task", "__f", "y_true"], cells.dim, F.sum, extra=[F.count("*").alias("n")])
    outs = F.filter(F.sequence(F.lit(-1), F.lit(cells.folds - 1)), lambda k: k != F.col("__f"))
    shared = stored(own, "fold-sums").withColumn("out", F.explode(outs))
    total = pool(shared, ["part", "task", "out", "y_true"], cells.dim, F.sum, extra=[F.sum("n").alias("n")])
    means = total.withColumn("m", F.transform("features", lambda x: x / F.col("n")))
    return stored(means.groupBy("part", "task", "out").agg(F.map_from_entries(F.array_agg(F.struct("y_true", "m"))).alias("means")), "means")


def mean_scores(cells: Cells, models: DataFrame) -> DataFrame:
    """Closeness to the class means, ``1 / (1 + distance)`` per class scaled to sum 1."""
    def closeness(name: Column) -> Column:
        squares = F.zip_with("features", F.element_at("means", name), lambda x, m: (x - m) * (x - m))
        return F.lit(1.0) / (F.lit(1.0) + F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)))
    return _applied(cells, models, _shares(F.transform("class_order", closeness)))


@dataclass
class _Fit:
    """State of one cell: standardisation, accepted and tried parameters, loss at the accepted ones."""

    task: int
    out: int
    mean: np.ndarray
    scale: np.ndarray
    classes: int
    at: np.ndarray | None = None
    loss: float = np.inf
    tried: np.ndarray | None = None
    steps: int = 0
    done: bool = False

    @property
    def shape(self) -> tuple[int, int]:
        """One line of parameters for two classes, else one per class; the last column is the intercept."""
        return (1 if self.classes == 2 else self.classes), len(self.mean) + 1


def _terms(fit: _Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of some rows at the tried parameters, without the penalty."""
    a = np.concatenate(((x - fit.mean) / fit.scale, np.ones((len(x), 1))), axis=1)
    z = a @ fit.tried.T
    lines, width = fit.shape
    if lines == 1:
        z, t = z[:, 0], (y == 1).astype(float)
        p = 1 / (1 + np.exp(-np.abs(z)))
        p = np.where(z >= 0, p, 1 - p)
        return np.concatenate(([(np.logaddexp(0, z) - t * z).sum()], (p - t) @ a, ((a * (p * (1 - p))[:, None]).T @ a).ravel()))
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    p = e / e.sum(axis=1, keepdims=True)
    rest = p.copy()
    rest[np.arange(len(y)), y] -= 1
    hessian = np.empty((lines, width, lines, width))
    for j in range(lines):
        for k in range(j, lines):
            w = p[:, j] * ((j == k) - p[:, k])
            hessian[j, :, k, :] = hessian[k, :, j, :] = (a * w[:, None]).T @ a
    loss = (np.log(e.sum(axis=1)) - z[np.arange(len(y)), y]).sum()
    return np.concatenate(([loss], (rest.T @ a).ravel(), hessian.ravel()))


def _partial(open_: dict[str, list[tuple[int, _Fit]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("features")
            x = np.asarray(vectors.flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            parts = np.asarray(batch.column("part").to_pylist(), object)
            for part, fits in open_.items():
                own = parts == part
                for number, fit in fits if own.any() else ():
                    fold = batch.column(f"__f{fit.task}").to_numpy()
                    rows = np.flatnonzero(own & (fold >= 0) & (fold != fit.out))
                    for lo in range(0, len(rows), 4096):
                        at = rows[lo:lo + 4096]
                        terms = _terms(fit, x[at], batch.column(f"__y{fit.task}").to_numpy(zero_copy_only=False)[at].astype(np.int64))
                        sums[number] = sums[number] + terms if number in sums else terms
        slot = TaskContext.get().partitionId()
        for number, terms in sums.items():
            yield pa.RecordBatch.from_pydict({"cell": pa.array([number], pa.int32()), "slot": pa.array([slot], pa.int32()),
                                              "terms": pa.array([terms], pa.list_(pa.float64()))})
    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(x.values) for x in table["terms"]], axis=0)
    return pa.table({"cell": table["cell"][:1], "slot": table["slot"][:1], "terms": pa.array([total], pa.list_(pa.float64()))})


def _step(fits: list[_Fit], c: float):
    """The penalised loss at the tried parameters and the Newton step from them."""
    def run(table: pa.Table) -> pa.Table:
        number = table["cell"][0].as_py()
        fit, total = fits[number], np.asarray(_added(table)["terms"][0].values)
        lines, width = fit.shape
        size = lines * width
        ridge = np.ones((lines, width))
        ridge[:, -1] = 0
        loss = total[0] + (ridge * fit.tried ** 2).sum() / (2 * c)
        gradient = total[1:size + 1] + (ridge * fit.tried).ravel() / c
        hessian = total[size + 1:].reshape(size, size) + np.diag(ridge.ravel() / c)
        if lines > 1:  # a constant added to all intercepts changes nothing; hold it at zero
            last = np.arange(lines) * width + width - 1
            hessian[np.ix_(last, last)] += 1.0
        step = np.linalg.solve(hessian, gradient)
        return pa.table({"cell": pa.array([number], pa.int32()), "loss": pa.array([loss]), "step": pa.array([step], pa.list_(pa.float64()))})
    return run


def newton(cells: Cells, c: float = 1.0, tol: float = 1e-8, most_steps: int = 100) -> tuple[DataFrame, int]:
    """((part, task, out, ``weights``, ``bias``) per cell, number of passes): L2 logistic regressions on standardised features.

    The penalty is ``|b|^2 / (2 c)`` on the weights of features with mean 0 and population deviation 1 over the cell's rows (features
    without spread are only centred), none on intercepts; two classes have one weight vector, more have one each.  ``weights`` and ``bias``
    are in units of the given features.  A step that does not lower the loss is halved.
    """
    names = list(cells.tasks)
    lines = {n: 1 if len(t.classes) == 2 else len(t.classes) for n, t in cells.tasks.items()}
    size = max(lines.values()) * (cells.dim + 1)
    if size > MOST_PARAMETERS:
        raise ValueError(f"{size} parameters a model: beyond {MOST_PARAMETERS}, fit them one by one with fit_logreg")
    moments = pool_many(cells.tall().filter("__f >= 0"), ["part", "task", "__f"], cells.dim, [F.avg, F.var_pop], extra=[F.count("*").alias("n")]).collect()
    keys, fits = [], []
    for part, (i, name) in product(sorted({r["part"] for r in moments}), enumerate(names)):
        for out in cells.outs[name]:
            own = [r for r in moments if r["part"] == part and r["task"] == name and r["__f"] != out]
            n = np.array([r["n"] for r in own], float)
            mean, var = (np.array([r["features"][k] for r in own]) for k in (0, 1))
            centre = n @ mean / n.sum()
            spread = np.sqrt(n @ (var + (mean - centre) ** 2) / n.sum())
            # A constant feature can have a spread of rounding errors.
            spread = np.where(spread <= 1e-12 * np.maximum(np.abs(centre), 1e-300), 1.0, spread)
            keys.append((part, name, out))
            fits.append(_Fit(i, out, centre, spread, len(cells.tasks[name].classes)))
            fits[-1].tried = np.zeros(fits[-1].shape)
    if len(fits) * size > MOST_NUMBERS:
        raise ValueError(f"{len(fits)} models of {size} parameters are too many for one driver")
    needed = ["part", "features", *[f"__{k}{i}" for k in "fy" for i in range(len(names))]]
    passes = 0
    while not all(f.done for f in fits):
        open_: dict[str, list[tuple[int, _Fit]]] = {}
        for number, ((part, _, _), fit) in enumerate(zip(keys, fits)):
            if not fit.done:
                open_.setdefault(part, []).append((number, fit))
        rows = cells.rows.filter(F.col("part").isin(list(open_))).select(*needed)
        sums = rows.mapInArrow(_partial(open_), "cell int, slot int, terms array<double>")
        tasks = rows.rdd.getNumPartitions()
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            sums = sums.withColumn("slot", F.pmod("slot", F.lit(tasks))).groupBy("cell", "slot").applyInArrow(_added, sums.schema)
        found = sums.groupBy("cell").applyInArrow(_step(fits, c), "cell int, loss double, step array<double>").collect()
        passes += 1
        for r in found:
            fit = fits[r["cell"]]
            if r["loss"] <= fit.loss + 1e-12 * abs(fit.loss) if np.isfinite(fit.loss) else True:
                fit.at, fit.loss = fit.tried, r["loss"]
                step = np.array(r["step"]).reshape(fit.shape)
                fit.tried = fit.at - step
                # The error after a Newton step is of the order of its square.
                fit.done = np.abs(step).max() <= np.sqrt(tol) * 1e-1 * (1 + np.abs(fit.at).max())
                if fit.done:
                    fit.at = fit.tried
            else:
                fit.tried = (fit.at + fit.tried) / 2
                fit.done = np.abs(fit.tried - fit.at).max() <= tol
            fit.steps += 1
            if fit.steps >= most_steps and not fit.done:
                raise RuntimeError(f"no optimum after {most_steps} steps: {keys[r['cell']]}")
    out = []
    for (part, name, left), fit in zip(keys, fits):
        weights = fit.at[:, :-1] / fit.scale
        bias = fit.at[:, -1] - weights @ fit.mean
        if fit.classes == 2:  # the first class is the reference
            weights, bias = np.concatenate((np.zeros_like(weights), weights)), np.concatenate(([0.0], bias))
        out.append((part, name, left, weights.tolist(), bias.tolist()))
    spark = cells.rows.sparkSession
    return spark.createDataFrame(out, "part string, task string, out int, weights array<array<double>>, bias array<double>"), passes


def logistic_scores(cells: Cells, models: DataFrame) -> DataFrame:
    """Probabilities of the cells' logistic regressions."""
    def margin(w: Column, b: Column) -> Column:
        return b + F.aggregate(F.zip_with("features", w, lambda x, v: x * v), F.lit(0.0), lambda acc, v: acc + v)
    margins = F.zip_with("weights", "bias", margin)
    # The array of one element gives the inner functions a name for the whole list, computed once.
    shifted = F.transform(F.array(margins), lambda z: F.transform(z, lambda v: F.exp(v - F.array_max(z))))[0]
    return _applied(cells, models, _shares(shifted))


@dataclass(frozen=True)
class Family:
    """How to fit the models of all cells, and how to score rows with them."""

    fit: Callable[[Cells], DataFrame]
    score: Callable[[Cells, DataFrame], DataFrame]

    def __call__(self, cells: Cells) -> DataFrame:
        """Every row and task, scored by its own cell's model."""
        return self.score(cells, self.fit(cells))


class_means = Family(mean_models, mean_scores)
logistic = Family(lambda cells: newton(cells)[0], logistic_scores)
