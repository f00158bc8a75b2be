"""Fitted scorers and the experiments built on them.

Fitting is iterative, so most of these have no SQL; the tests check them
against a numerical optimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.vectors import grid_readout
from ..operators import fitting, metrics
from ..operators.cells import Family, class_means, logistic
from ..operators.pooling import sdp_pool
from ..operators.records import grouped_stratified_folds
from ..plans import experiments
from ..plans.experiments import Branch
from ..session import stored
from .registry import query, rounded, with_views

EVALUATIONS = {"test2022": "Set2022", "test2023": "Set2023"}
TASKS = {"binary": ("binary_label", views.BINARY_LABELS), "coarse": ("coarse_label", views.QUARTER_LABELS)}
CLASSES = {task: classes for task, (_, classes) in TASKS.items()}


FOLDS = {task: f"fold_{task}" for task in TASKS}
CHALLENGE = {"T2-1": ("coarse_label", views.COARSE, "Normal", ["Abnormal"]),
             "T2-2": ("fine_label", views.FINE, "1-URGENT", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])}
CHALLENGE_FOLDS = {task: f"fold_{task}" for task in CHALLENGE}


def with_folds(rows: DataFrame, labels: dict[str, str], train: Column) -> DataFrame:
    """A fold column per task, stratified on the task's own label."""
    for task, label in labels.items():
        rows = grouped_stratified_folds(rows, label, train).withColumnRenamed("fold_id", f"fold_{task}")
    return rows


def branch(spark: SparkSession, folder: str, kind: str) -> Branch:
    """One readout of the embeddings, with folds per task: their squares, the values, or their grid readout."""
    rows = stored(with_folds(views.features(spark, folder), {t: label for t, (label, _) in TASKS.items()}, F.col("split") == "train"), "branch")
    if kind == "single":
        return Branch(rows.withColumn("features", F.transform("features", lambda x: x * x)), views.FEATURE_DIM)
    if kind == "grid":
        return Branch(rows.withColumn("features", grid_readout(F.col("features"), 4, 4, 4)), 32)
    return Branch(rows, views.FEATURE_DIM)


def scored(df: DataFrame, label: str) -> DataFrame:
    return df.select("record_id", "split", F.col(label).alias("y_true"),
                     F.round(F.array_max("probabilities"), 6).alias("top"))


@query("logreg_scores")
def logreg_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every record scored by a model of the training rows."""
    rows = views.features(spark, folder)
    return scored(fitting.logreg_scores(rows, F.col("split") == "train", "coarse_label", views.QUARTER_LABELS,
                                        views.FEATURE_DIM), "coarse_label")


@query("oof_scores", with_views("""select record_id, fold_id, y_true, round((t-o)::double/(ts-os),9) p_normal from
 (select record_id, fold_id, coarse_label y_true from folded where fold_id>=0)
 join (select fold_id, count(*) filter (coarse_label='Normal') o, count(*) os from folded where fold_id>=0 group by all) using (fold_id)
 cross join (select count(*) filter (coarse_label='Normal') t, count(*) ts from folded where fold_id>=0)""", "folded"))
def oof_prior(spark: SparkSession, folder: str) -> DataFrame:
    """Left-out folds scored by the class shares of the other folds."""
    rows = grouped_stratified_folds(views.records(spark, folder), "coarse_label", F.col("split") == "train2022")
    out = fitting.oof_prior_scores(rows, "coarse_label", views.COARSE)
    return out.select("record_id", "fold_id", F.col("coarse_label").alias("y_true"),
                      F.round(F.get("probabilities", F.lit(0)), 9).alias("p_normal"))


@query("oof_scores_logreg")
def oof_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """Left-out folds scored by models of the other folds."""
    b = branch(spark, folder, "all")
    return scored(fitting.oof_scores(b.rows, "binary_label", views.BINARY_LABELS, b.dim, fold=FOLDS["binary"]), "binary_label")


def records_with_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_folds(views.records(spark, folder), {t: spec[0] for t, spec in CHALLENGE.items()}, F.col("split") == "train2022")
    return stored(rows.select("record_id", "group_id", "split", *CHALLENGE_FOLDS.values(), "fine_label", "coarse_label"), "folds")


@query("select_temperature_cv", with_views("""select task, temperature, fold_id::int fold_id, record_count, round(SE,6) SE, round(SP,6) SP, round("AS",6) "AS",
 round(HS,6) HS, round(Score,6) Score, temperature=(select temperature from cbest where cbest.task=cscore.task) selected from cscore""", "cscore", "cbest"))
def select_temperature_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Official score per task, temperature and fold of distance-pooled windows, scored by the class means of the other folds; the choice."""
    return temperature_table(spark, folder, class_means)


@query("select_temperature_cv_logreg")
def select_temperature_cv_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """The same by logistic regressions, all fitted in common Newton steps."""
    return temperature_table(spark, folder, logistic)


def temperature_table(spark: SparkSession, folder: str, family: Family) -> DataFrame:
    train = F.col("split") == "train2022"
    # Only training rows are fitted and scored, so only their windows are pooled.
    records = records_with_folds(spark, folder).filter(train)
    pooled = sdp_pool(views.windows(spark, folder).join(records.select("record_id"), "record_id", "left_semi"), views.WINDOW_DIM, experiments.TEMPERATURES)
    rows = pooled.join(records, "record_id")
    scores = stored(experiments.select_temperature(rows, views.WINDOW_DIM, CHALLENGE, train, CHALLENGE_FOLDS,
                                                   family), "fold-scores")
    chosen = experiments.rank_temperatures(scores).select("task", "temperature", "selected")
    return rounded(scores.join(chosen, ["task", "temperature"]), "SE", "SP", "AS", "HS", "Score", digits=6)


@query("progression", with_views("""select case split when 'test2022' then 'Set2022' else 'Set2023' end dataset, split evaluation, task,
 case kind when 'single' then 'phase1' when 'all' then 'phase2' else 'phase3' end phase, alpha selected_alpha, round(balanced_accuracy,6) balanced_accuracy,
 round(macro_f1,6) macro_f1, round(accuracy,6) accuracy, record_count from emet where kind<>'grid'""", "emet"))
def progression(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the three phases by class means, with alpha chosen on out-of-fold training scores."""
    return phase_table(spark, folder, class_means)


@query("progression_logreg")
def progression_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """The same by logistic regressions, all fitted in common Newton steps."""
    return phase_table(spark, folder, logistic)


def phase_table(spark: SparkSession, folder: str, family: Family) -> DataFrame:
    found = experiments.progression(branch(spark, folder, "single"), branch(spark, folder, "all"), branch(spark, folder, "grid"),
                                    TASKS, EVALUATIONS, F.col("split") == "train", FOLDS, family)
    by = ["dataset", "evaluation", "task", "phase"]
    alphas = found.selection.filter("selected").select("task", F.lit("phase3").alias("phase"), F.col("alpha").alias("selected_alpha"))
    rows = metrics.classification_metrics(found.predictions, by, CLASSES, absent="skip").join(alphas, ["task", "phase"], "left")
    return rounded(rows, "balanced_accuracy", "macro_f1", "accuracy", digits=6)


@query("challenge_workflow", with_views("""select evaluation, task, method, record_count, round(SE,6) SE, round(SP,6) SP, round("AS",6) "AS", round(HS,6) HS,
 round(Score,6) Score from coff""", "coff"))
def challenge_workflow(spark: SparkSession, folder: str) -> DataFrame:
    """Official scores of both pooled readouts and their fusion by class means, temperature chosen on training rows, both tasks."""
    return readout_table(spark, folder, class_means)


@query("challenge_workflow_logreg")
def challenge_workflow_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """The same by logistic regressions, all fitted in common Newton steps."""
    return readout_table(spark, folder, logistic)


def readout_table(spark: SparkSession, folder: str, family: Family) -> DataFrame:
    found = experiments.challenge(views.windows(spark, folder), views.WINDOW_DIM, records_with_folds(spark, folder),
                                  CHALLENGE, F.col("split") == "train2022", CHALLENGE_FOLDS, family)
    scores = metrics.official_score(found.predictions, ["evaluation", "task", "method"], views.NORMAL, views.SENSITIVE)
    return rounded(scores, "SE", "SP", "AS", "HS", "Score", digits=6)


@query("encoder_comparison", with_views("""select case split when 'test2022' then 'Set2022' else 'Set2023' end dataset, split evaluation, task,
 case kind when 'single' then 'Enc-A' when 'all' then 'Enc-B' else 'Enc-C' end as method, round(balanced_accuracy,6) balanced_accuracy,
 round(macro_f1,6) macro_f1, round(accuracy,6) accuracy, record_count from emet where kind<>'fused'""", "emet"))
def encoder_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of one set of class means per encoder and task on two held-out splits."""
    return encoder_table(spark, folder, class_means)


@query("encoder_comparison_logreg")
def encoder_comparison_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """The same by logistic regressions, all fitted in common Newton steps."""
    return encoder_table(spark, folder, logistic)


def encoder_table(spark: SparkSession, folder: str, family: Family) -> DataFrame:
    encoders = {name: branch(spark, folder, kind) for name, kind in
                (("Enc-A", "single"), ("Enc-B", "all"), ("Enc-C", "grid"))}
    rows = experiments.encoder_comparison(encoders, TASKS, EVALUATIONS, F.col("split") == "train", family)
    by = ["dataset", "evaluation", "task", "method"]
    return rounded(metrics.classification_metrics(rows, by, CLASSES, absent="skip"),
                   "balanced_accuracy", "macro_f1", "accuracy", digits=6)
