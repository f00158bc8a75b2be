"""The three experiments: phase progression, challenge readouts, encoder comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cells import Family, Task, logistic, place, prepare
from ..operators.metrics import classification_metrics, official_score
from ..operators.pooling import q75_pool, sdp_pool
from ..operators.probabilities import aligned_pairs, alpha_grid, alpha_sweep, fuse_tables, predict
from ..operators.selection import incumbent, mean_over_folds, rank_alphas
from ..session import stored

# Fixed values of the protocol: temperature grid, replacement margin, fusion weight.
TEMPERATURES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
REPLACEMENT_MARGIN = 1e-4
FUSION_ALPHA = 0.5


@dataclass(frozen=True)
class Branch:
    """Feature rows of one readout with their dimension."""

    rows: DataFrame
    dim: int


@dataclass(frozen=True)
class Outcome:
    """Predictions of an experiment, and the table its choice was made from (every candidate, with ``selected``)."""

    predictions: DataFrame
    selection: DataFrame
    folds: DataFrame | None = None


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prediction_rows(scored: DataFrame, label: str, **names: Column | str) -> DataFrame:
    """Scored rows in the long prediction layout; ``names`` adds the constant or derived key columns."""
    keys = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in names.items()]
    return predict(scored).select(*keys, "record_id", F.col(label).alias("y_true"), "y_pred", "class_order", "probabilities")


def choose_alpha(cls_oof: DataFrame, tg_oof: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Fused out-of-fold metrics per alpha, ranked by the declared rule.

    The out-of-fold scores are joined once and every alpha is tried inside the row.
    """
    pairs = aligned_pairs(cls_oof, tg_oof, label)
    tried = alpha_sweep(pairs, ["y_true"], classes, alpha_grid())
    return rank_alphas(classification_metrics(tried, ["alpha"], classes, absent="skip"), [])


def _dataset(evaluations: Mapping[str, str]) -> Column:
    name = F.lit(None).cast("string")
    for split, dataset in evaluations.items():
        name = F.when(F.col("split") == split, F.lit(dataset)).otherwise(name)
    return name


def score_parts(parts: Mapping[str, Branch], tasks: Mapping[str, Task], train: Column, family: Family = logistic) -> DataFrame:
    """All rows of all parts scored for every task, stored: ``part``, ``task``, ``fold``, ``y_true``, ``class_order``, ``probabilities`` and the rows' columns.

    Parts of one dimension are fitted together.
    """
    dims = dict.fromkeys(b.dim for b in parts.values())
    scored = [family(prepare(union([b.rows.withColumn("part", F.lit(name)) for name, b in parts.items() if b.dim == dim]), tasks, dim, train))
              for dim in dims]
    return stored(union(scored), "scores")


def progression(single: Branch, cls: Branch, tg: Branch, tasks: Mapping[str, tuple[str, Sequence[str]]],
                evaluations: Mapping[str, str], train: Column, folds: Mapping[str, str], family: Family = logistic) -> Outcome:
    """Predictions of the three phases on every evaluation split, and the ranked alphas per task.

    ``tasks`` maps a task to (label column, classes), ``folds`` to the fold column stratified on that label, and
    ``evaluations`` a split to its dataset name.  Alpha is chosen on out-of-fold training scores only.
    ``family`` fits and applies the models of all parts, tasks and folds.
    """
    kinds = {t: Task(label, tuple(classes), folds[t]) for t, (label, classes) in tasks.items()}
    scored = score_parts({"phase1": single, "phase2": cls, "grid": tg}, kinds, train, family)
    held = scored.filter((F.col("fold") < 0) & F.col("split").isin(list(evaluations)))
    out, choices = [], []
    for task, (_, classes) in tasks.items():
        own = scored.filter((F.col("task") == task) & (F.col("fold") >= 0))
        ranked = stored(choose_alpha(own.filter("part = 'phase2'"), own.filter("part = 'grid'"), "y_true", classes), "alphas")
        alpha = ranked.filter("selected").first()["alpha"]
        choices.append(ranked.withColumn("task", F.lit(task)))
        s, c, t = (held.filter((F.col("task") == task) & (F.col("part") == part)) for part in ("phase1", "phase2", "grid"))
        phases = {"phase1": s, "phase2": c, "phase3": fuse_tables(c, t, ["record_id"], alpha, len(classes))}
        for phase, rows in phases.items():
            out.append(prediction_rows(rows, "y_true", dataset=_dataset(evaluations), evaluation=F.col("split"), phase=phase, task=task)
                       .withColumn("selected_alpha", F.lit(alpha if phase == "phase3" else None).cast("double")))
    return Outcome(union(out), union(choices))


def temperature_scores(scored: DataFrame, tasks: Mapping[str, tuple[str, Sequence[str], str, Sequence[str]]]) -> DataFrame:
    """Official scores per (task, temperature, fold) from left-out predictions; the part of a temperature is its number as text."""
    trials = predict(scored.filter("fold >= 0")).select("task", F.expr("try_cast(part as double)").alias("temperature"),
                                                        F.col("fold").alias("fold_id"), "y_true", "y_pred")
    return official_score(trials, ["task", "temperature", "fold_id"], {t: normal for t, (_, _, normal, _) in tasks.items()},
                          {t: sensitive for t, (_, _, _, sensitive) in tasks.items()})


def select_temperature(pooled: DataFrame, dim: int, tasks: Mapping[str, tuple[str, Sequence[str], str, Sequence[str]]],
                       train: Column, folds: Mapping[str, str], family: Family = logistic) -> DataFrame:
    """Official scores per (task, temperature, fold): every temperature of ``pooled`` fitted and scored fold by fold on training rows."""
    kinds = {t: Task(label, tuple(classes), folds[t]) for t, (label, classes, _, _) in tasks.items()}
    rows = pooled.filter(train).withColumn("part", F.col("temperature").cast("string")).drop("temperature")
    return temperature_scores(family(prepare(rows, kinds, dim, train)), tasks)


def rank_temperatures(fold_scores: DataFrame, margin: float = REPLACEMENT_MARGIN) -> DataFrame:
    """(task, temperature, mean_score, selected) from the scores per (task, temperature, fold)."""
    means = mean_over_folds(fold_scores, ["task", "temperature"])
    chosen = incumbent(means, ["task"], "temperature", margin=margin).withColumnRenamed("selected", "__t")
    return means.join(chosen, "task").withColumn("selected", F.col("temperature") == F.col("__t")).drop("__t")


def challenge(windows: DataFrame, dim: int, records: DataFrame, tasks: Mapping[str, tuple[str, Sequence[str], str, Sequence[str]]],
              train: Column, folds: Mapping[str, str], family: Family = logistic) -> Outcome:
    """Predictions of the distance-pooled, q75 and fused readouts on all rows outside ``train``, with the fold and mean scores per temperature.

    ``tasks`` maps a task to (label column, classes, normal class, sensitive classes), ``folds`` to its fold column.
    All temperatures and the quartile readout are fitted together, so a chosen temperature needs no fit of its own; records outside
    ``train`` are pooled at the chosen temperatures only.
    """
    kinds = {t: Task(label, tuple(classes), folds[t]) for t, (label, classes, _, _) in tasks.items()}
    # Windows meet their records once and are stored in two folders: each pooling reads the rows of its side only.
    both = windows.select("record_id", "window_index", "features").join(records.withColumn("__train", train).select("record_id", "__train"), "record_id")
    both = stored(both, "sides", ["__train"])

    def pooled(side: Column, temperatures: Sequence[float]) -> DataFrame:
        shares, own = both.filter(side).drop("__train"), records.withColumn("__train", train).filter(side).drop("__train")
        sdp = sdp_pool(shares, dim, temperatures).withColumn("part", F.col("temperature").cast("string")).drop("temperature")
        # Both come out by record, so the joins move the records only.
        return union([rows.join(own, "record_id") for rows in (sdp, q75_pool(shares, dim).withColumn("part", F.lit("q75")))])

    fitted = prepare(pooled(F.col("__train"), TEMPERATURES), kinds, dim, train)
    models = stored(family.fit(fitted), "models")
    scores = stored(temperature_scores(family.score(fitted, models).filter("part <> 'q75'"), tasks), "fold-scores")
    ranked = stored(rank_temperatures(scores), "temperatures")
    chosen = {r["task"]: r["temperature"] for r in ranked.filter("selected").collect()}  # one per task
    held = stored(family.score(place(pooled(~F.col("__train"), sorted(set(chosen.values()))), kinds, dim, train), models), "scores")
    out = []
    for task, (_, classes, _, _) in tasks.items():
        own = held.filter(F.col("task") == task)
        cls = own.filter((F.col("part") != "q75") & (F.expr("try_cast(part as double)") == F.lit(chosen[task])))
        tg = own.filter("part = 'q75'")
        methods = {"CLS": cls, "Temporal Grid": tg, "Fusion": fuse_tables(cls, tg, ["record_id"], FUSION_ALPHA, len(classes))}
        out += [prediction_rows(s, "y_true", evaluation=F.col("split"), task=task, method=m) for m, s in methods.items()]
    return Outcome(union(out), ranked, scores)


def encoder_comparison(encoders: Mapping[str, Branch], tasks: Mapping[str, tuple[str, Sequence[str]]],
                       evaluations: Mapping[str, str], train: Column, family: Family = logistic) -> DataFrame:
    """Predictions of one model per (encoder, task) on the training split, scored on the held-out splits."""
    kinds = {t: Task(label, tuple(classes)) for t, (label, classes) in tasks.items()}
    scored = score_parts(encoders, kinds, train, family).filter((F.col("fold") < 0) & F.col("split").isin(list(evaluations)))
    return prediction_rows(scored, "y_true", dataset=_dataset(evaluations), evaluation=F.col("split"), task=F.col("task"), method=F.col("part"))
