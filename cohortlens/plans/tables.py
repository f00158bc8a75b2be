"""The labelled result tables from prediction tables and record manifests.

Prediction tables carry ``dataset, evaluation, task, record_id, y_true, y_pred``
and ``phase`` (progression) or ``method`` (encoders, challenge).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bootstrap as boot
from ..operators import multinomial, slots
from ..operators.comparison import insertion_rank, phase_delta, single_vs_dual
from ..operators.metrics import (capture_rate, class_distribution, classification_metrics, confusion_counts,
                                 official_score_from_counts, per_class_counts, recall_of, share_within, summarise_classes)
from ..operators.records import custom_order
from ..session import stored

KEYS = ["dataset", "evaluation", "task"]


def manifest_tables(harmonised: DataFrame, everything: DataFrame, tasks: Mapping[str, tuple[str, Sequence[str]]],
                    splits: Sequence[str], captures: DataFrame, positive: str) -> dict[str, DataFrame]:
    """Class, device and event-capture tables.

    ``harmonised`` holds the included records, ``everything`` also those of the reject class.
    """
    return {
        "tab:class_distribution": class_distribution(harmonised, tasks, splits),
        "tab:device_distribution": share_within(harmonised, "split", "device"),
        "tab:challenge_class_distribution": class_distribution(everything, tasks, splits),
        "tab:single_window_event_capture": capture_rate(
            captures, ["dataset"], F.col("binary_label") == positive, F.col("overlap")),
    }


def progression_tables(predictions: DataFrame, classes: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Metric and recall tables of the three phases with their deltas, and single against dual.

    The predictions are read once: all seven tables come from the stored class counts.
    """
    by = ["phase", *KEYS]
    counts = stored(per_class_counts(confusion_counts(predictions, by), by, classes), "counts")
    metrics, recalls = summarise_classes(counts, by), recall_of(counts, by)

    def phase(table: DataFrame, name: str) -> DataFrame:
        return table.filter(F.col("phase") == name).drop("phase")

    m1, m2, m3 = (phase(metrics, f"phase{i}") for i in (1, 2, 3))
    r1, r2, r3 = (phase(recalls, f"phase{i}") for i in (1, 2, 3))
    rk = [*KEYS, "class"]
    return {
        "tab:single_window_results": m1,
        "tab:single_window_per_class_recall": r1,
        "tab:complete_record_results": phase_delta(m2, m1, KEYS),
        "tab:complete_record_per_class_recall": phase_delta(r2, r1, rk, ["recall"]),
        "tab:dual_readout_results": phase_delta(m3, m2, KEYS),
        "tab:dual_readout_per_class_recall": phase_delta(r3, r2, rk, ["recall"]),
        "tab:overall_harmonised_comparison": single_vs_dual(m1, m3, KEYS),
    }


def method_table(encoders: DataFrame, progression: DataFrame, classes: Mapping[str, Sequence[str]], own_name: str,
                 order: Sequence[str]) -> DataFrame:
    """Metrics per method: encoder rows and the final phase re-labelled as one more method, in declared order."""
    columns = [*KEYS, "method", "record_id", "y_true", "y_pred"]
    own = progression.filter(F.col("phase") == "phase3").withColumn("method", F.lit(own_name)).select(*columns)
    rows = encoders.select(*columns).unionByName(own)
    return custom_order(classification_metrics(rows, [*KEYS, "method"], classes), "method", order)


def challenge_tables(predictions: DataFrame, board: DataFrame, normal: Mapping[str, str],
                     sensitive: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Official score per readout, and the placement of the fused readout in every published table."""
    by = ["evaluation", "task", "method"]
    cells = stored(confusion_counts(predictions, by), "cells")
    scores = official_score_from_counts(cells, by, normal, sensitive)
    fused = scores.filter(F.col("method") == "Fusion").withColumnRenamed("Score", "score")
    places = insertion_rank(fused, board, ["evaluation", "task"], tables=["table"]).withColumnRenamed("table", "published_table")
    places = places.withColumn("status", F.lit("estimated afterwards; never submitted"))
    return {"tab:challenge_placements": places, "tab:challenge_readout_comparison": scores}


def patient_numbers(predictions: DataFrame) -> dict[str, int]:
    """Number of patients per task; a row per task comes to the driver, and nothing is stored."""
    return {r["task"]: r["count"] for r in predictions.select("task", "group_id").distinct().groupBy("task").count().collect()}


def patient_cells(predictions: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Stored confusion cells of the predictions' patients, and the number of patients per task.

    The patients and their cells are the only tables taken from the predictions, one pass
    each.  Points, draws and packing read these compact tables.
    """
    groups = stored(predictions.select("task", "group_id").distinct(), "groups")
    cells = boot.patient_confusions(predictions, boot.patient_positions(groups))
    return stored(cells, "cells"), patient_numbers(groups)


@dataclass(frozen=True)
class Resampled:
    """Stored confusion counts, total and per draw, that all bootstrap tables of a bundle share."""

    totals: DataFrame
    drawn: DataFrame


def resample(predictions: DataFrame, replicates: int) -> Resampled:
    cells, patients = patient_cells(predictions)
    totals = cells.groupBy("task", "method", "truth", "predicted").agg(F.sum("n").alias("n"))
    drawn = slots.resampled_confusions(cells, patients, replicates)
    return Resampled(stored(totals, "totals"), stored(drawn, "resampled"))


def resample_by_counts(predictions: DataFrame, replicates: int, seed: int = 0) -> Resampled:
    """The same from patient counts per draw (see ``operators.multinomial``), for the protocol's number of replicates."""
    cells, patients = patient_cells(predictions)
    totals = cells.groupBy("task", "method", "truth", "predicted").agg(F.sum("n").alias("n"))
    return Resampled(stored(totals, "totals"), stored(multinomial.resampled_confusions(cells, patients, replicates, seed=seed), "resampled"))


def bootstrap_classification(resampled: Resampled, classes: Mapping[str, Sequence[str]], pairs: Sequence[tuple[str, str]],
                             metrics: Sequence[str] = ("balanced_accuracy", "macro_f1")) -> DataFrame:
    """Intervals for the classification metrics of each method and of the declared differences."""
    by = ["task", "method"]
    reps = boot.classification_replicates(resampled.drawn, by, classes)
    points = summarise_classes(per_class_counts(resampled.totals, by, classes), by)
    return boot.interval_table(boot.to_long(points, by, metrics), boot.to_long(reps, ["draw", *by], metrics), pairs)


def bootstrap_challenge(resampled: Resampled, normal: Mapping[str, str], sensitive: Mapping[str, Sequence[str]],
                        pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Intervals for the official Score of each method and of the declared differences."""
    by = ["task", "method"]
    reps = boot.challenge_replicates(resampled.drawn, by, normal, sensitive)
    points = official_score_from_counts(resampled.totals, by, normal, sensitive)
    return boot.interval_table(boot.to_long(points, by, ["Score"]), boot.to_long(reps, ["draw", *by], ["Score"]), pairs)
