"""Confusion counts and the scores derived from them.

Every score starts from ``confusion_counts``: one hash aggregation with
map-side combine over the predictions.  All later steps work on that table,
whose size depends only on the number of groups and classes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import harmonic_mean, ratio, ratio_or_nan, ratio_or_zero
from ..functions.vectors import string_list

Classes = Sequence[str] | Mapping[str, Sequence[str]]


def per_task(values: Mapping[str, Column], task: str) -> Column:
    """Pick the entry of ``values`` named by column ``task``; null for other tasks."""
    chosen = None
    for name, value in values.items():
        hit = F.col(task) == name
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen


def class_list(classes: Classes, task: str = "task") -> Column:
    """Declared classes as an array; per task when given as a mapping."""
    if isinstance(classes, Mapping):
        return per_task({name: string_list(labels) for name, labels in classes.items()}, task)
    return string_list(classes)


def confusion_counts(predictions: DataFrame, by: Sequence[str], truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Non-zero confusion cells ``(by, truth, predicted, n)``."""
    return (predictions.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
            .agg(F.count("*").alias("n")))


def _declared(counts: DataFrame, classes: Classes) -> DataFrame:
    """Attach the class list and fail on a label outside it."""
    labels = class_list(classes)
    known = F.array_contains(labels, F.col("truth")) & F.array_contains(labels, F.col("predicted"))
    return counts.withColumn("__classes", F.when(known, labels).otherwise(
        F.raise_error(F.lit("a label is not among the declared classes")).cast("array<string>")))


def confusion_matrix(predictions: DataFrame, by: Sequence[str], classes: Classes) -> DataFrame:
    """Dense matrix in long form: every declared (truth, predicted) pair, zero where unseen."""
    counts = _declared(confusion_counts(predictions, by), classes)
    pairs = F.flatten(F.transform("__classes", lambda t: F.transform(
        "__classes", lambda p: F.struct(t.alias("truth"), p.alias("predicted")))))
    grid = counts.select(*by, F.explode(pairs).alias("__p")).select(*by, "__p.truth", "__p.predicted", F.lit(0).alias("n"))
    return (counts.select(*by, "truth", "predicted", "n").unionByName(grid)
            .groupBy(*by, "truth", "predicted").agg(F.sum("n").alias("n")))


def confusion_wide(matrix: DataFrame, by: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """One row per truth, one column per declared predicted class."""
    return matrix.groupBy(*by, "truth").pivot("predicted", list(classes)).agg(F.sum("n"))


def per_class_counts(counts: DataFrame, by: Sequence[str], classes: Classes) -> DataFrame:
    """``(by, class, position, tp, support, predicted_n)`` for every declared class, zero-filled."""
    known = _declared(counts, classes)
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))

    def side(label: Column, tp, support, predicted) -> Column:
        return F.struct(label.alias("class"), tp.cast("long").alias("tp"), support.cast("long").alias("support"),
                        predicted.cast("long").alias("predicted_n"))

    zero = F.lit(0)
    sides = F.concat(
        F.array(side(F.col("truth"), hit, F.col("n"), zero), side(F.col("predicted"), zero, zero, F.col("n"))),
        F.transform("__classes", lambda c: side(c, zero, zero, zero)))
    rows = known.select(*by, "__classes", F.explode(sides).alias("__s"))
    return (rows.select(*by, "__s.*", F.array_position("__classes", F.col("__s.class")).alias("position"))
            .groupBy(*by, "class", "position")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted_n")))


def _f1(tp: Column, support: Column, predicted_n: Column) -> Column:
    return harmonic_mean(ratio_or_zero(tp, predicted_n), ratio_or_zero(tp, support))


def _f1_counts(tp: Column, support: Column, predicted_n: Column) -> Column:
    return ratio_or_zero(F.lit(2) * tp, support + predicted_n)


def summarise_classes(per_class: DataFrame, by: Sequence[str], absent: str = "zero") -> DataFrame:
    """Balanced accuracy, macro F1, accuracy and size from per-class counts.

    ``absent`` decides what a declared class without true members adds to the
    balanced accuracy: ``zero`` counts it as recall 0, ``skip`` leaves it out of
    the mean, ``nan`` makes the result NaN.
    """
    tp, support, predicted_n = F.col("tp"), F.col("support"), F.col("predicted_n")
    recall = {"zero": ratio_or_zero, "skip": ratio, "nan": ratio_or_nan}[absent](tp, support)
    f1 = _f1_counts if absent == "nan" else _f1
    return per_class.groupBy(*by).agg(
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(f1(tp, support, predicted_n)).alias("macro_f1"),
        (ratio_or_nan if absent == "nan" else ratio_or_zero)(F.sum(tp), F.sum(support)).alias("accuracy"),
        F.sum(support).alias("record_count"))


def classification_metrics(predictions: DataFrame, by: Sequence[str], classes: Classes, absent: str = "zero") -> DataFrame:
    return summarise_classes(per_class_counts(confusion_counts(predictions, by), by, classes), by, absent)


def recall_of(per_class: DataFrame, by: Sequence[str]) -> DataFrame:
    """Recall per declared class, 0 for a class without true members."""
    return per_class.select(*by, "class", "position", ratio_or_zero(F.col("tp"), F.col("support")).alias("recall"))


def per_class_recall(predictions: DataFrame, by: Sequence[str], classes: Classes) -> DataFrame:
    return recall_of(per_class_counts(confusion_counts(predictions, by), by, classes), by)


def official_score(predictions: DataFrame, by: Sequence[str], normal: str | Mapping[str, str], sensitive: Classes,
                   empty: str = "error") -> DataFrame:
    return official_score_from_counts(confusion_counts(predictions, by), by, normal, sensitive, empty)


def official_score_from_counts(counts: DataFrame, by: Sequence[str], normal: str | Mapping[str, str],
                               sensitive: Classes, empty: str = "error") -> DataFrame:
    """SE, SP, AS, HS and Score from confusion cells; other true classes leave both denominators.

    ``sensitive`` rows count as hits only when the exact class is right.  An empty
    normal or sensitive population is an error, or NaN with ``empty='nan'``.
    """
    is_normal = F.col("truth") == (
        per_task({t: F.lit(v) for t, v in normal.items()}, "task") if isinstance(normal, Mapping) else F.lit(normal))
    is_sensitive = F.array_contains(class_list(sensitive), F.col("truth"))
    right = F.col("truth") == F.col("predicted")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    sums = counts.groupBy(*by).agg(
        F.sum("n").alias("record_count"),
        total(is_normal).alias("__normal"), total(is_normal & right).alias("__normal_ok"),
        total(is_sensitive).alias("__sens"), total(is_sensitive & right).alias("__sens_ok"))
    if empty == "error":
        missing = F.raise_error(F.lit("the score has no records to count")).cast("double")
    else:
        missing = F.lit(float("nan"))
    rates = sums.select(
        *by, "record_count",
        F.coalesce(ratio(F.col("__sens_ok"), F.col("__sens")), missing).alias("SE"),
        F.coalesce(ratio(F.col("__normal_ok"), F.col("__normal")), missing).alias("SP"))
    return (rates.withColumn("AS", (F.col("SE") + F.col("SP")) / 2.0)
            .withColumn("HS", harmonic_mean(F.col("SE"), F.col("SP")))
            .withColumn("Score", (F.col("AS") + F.col("HS")) / 2.0))


def capture_rate(rows: DataFrame, by: Sequence[str], positive: Column, captured: Column) -> DataFrame:
    """Among positive records: how many were captured, and the percentage."""
    sums = rows.groupBy(*by).agg(F.count_if(positive).alias("pathological_records"),
                                 F.count_if(positive & captured).alias("captured_records"))
    return sums.filter("pathological_records > 0").withColumn(
        "capture_rate_percent", F.lit(100.0) * F.col("captured_records") / F.col("pathological_records"))


def class_distribution(records: DataFrame, tasks: Mapping[str, tuple[str, Sequence[str]]], splits: Sequence[str],
                       split: str = "split") -> DataFrame:
    """Count per task, split and declared class, zero where none.

    ``tasks`` maps a task to its label column and class list.  The records are
    combined to distinct (split, labels) rows first; only those are unpivoted.
    """
    columns = list(dict.fromkeys(column for column, _ in tasks.values()))
    seen = records.groupBy(split, *columns).agg(F.count("*").alias("n"))
    unpivoted = seen.select(F.col(split).alias("split"), "n", F.inline(F.array(*[
        F.struct(F.lit(task).alias("task"), F.col(column).alias("class")) for task, (column, _) in tasks.items()])))
    declared = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(t).alias("task"), F.lit(c).alias("class"))
                         for t, (_, labels) in tasks.items() for s in splits for c in labels])
    grid = records.sparkSession.range(1).select(F.inline(declared)).withColumn("n", F.lit(0).cast("long"))
    valid = F.array_contains(class_list({t: labels for t, (_, labels) in tasks.items()}), F.col("class"))
    return (unpivoted.filter(valid & F.col("split").isin(list(splits))).unionByName(grid)
            .groupBy("task", "split", "class").agg(F.sum("n").alias("count")))


def share_within(records: DataFrame, within: str, value: str) -> DataFrame:
    """Count of ``value`` and its percentage of the ``within`` total, combined before the window."""
    counts = records.groupBy(within, value).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(within))
    return counts.withColumn("percentage", F.lit(100.0) * F.col("count") / total)
