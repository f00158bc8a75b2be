"""Distributions, confusion counts, scores, comparisons and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.vectors import argmax_label, fuse, string_list
from ..operators import checks, comparison, metrics, probabilities, records, selection
from ..plans import tables as plans
from ..plans.experiments import TEMPERATURES
from ..session import stored
from .registry import parts, query, rounded, with_views

KEYS = ["dataset", "evaluation", "task"]
RUN = ["evaluation", "task", "method"]
THREE = ("balanced_accuracy", "macro_f1", "accuracy")


def r9(*columns: str) -> str:
    return ", ".join(f"round({c},9) {c.split('.')[-1]}" for c in columns)


GRID = "(values ('train2022'),('test2022'),('test2023')) s(split)"


def distribution_sql(condition: str, tasks: dict[str, str]) -> str:
    """Zero-filled counts over the declared split and class grid."""
    which = " or ".join(f"(task='{t}' and {c}=cls)" for t, c in tasks.items())
    return with_views(f"""select task, s.split, cls "class", count(record_id) "count" from cl cross join {GRID}
 left join recs on recs.split=s.split and {condition} and ({which}) group by all""", "recs", "cl")


@query("class_distribution", distribution_sql("inclusion_status='included'", {"T2-1": "coarse_label", "T2-2": "fine_label"}))
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Included records per task, split and declared class; the reject class is empty and shows zero."""
    tasks = {"T2-1": ("coarse_label", views.COARSE), "T2-2": ("fine_label", views.FINE)}
    return metrics.class_distribution(records.included(views.records(spark, folder)), tasks, views.SPLITS)


@query("challenge_distribution", distribution_sql("true", {"T2-1": "coarse_label", "T2-2": "fine_label"}))
def challenge_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """All records per task, split and class, the reject class kept."""
    tasks = {"T2-1": ("coarse_label", views.COARSE), "T2-2": ("fine_label", views.FINE)}
    return metrics.class_distribution(views.records(spark, folder), tasks, views.SPLITS)


@query("device_distribution", with_views("""select split, device, count(*) "count", round(100.0::double*count(*)/sum(count(*)) over (partition by split),9) percentage
 from recs group by split, device""", "recs"))
def device_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Devices per split with their share."""
    return rounded(metrics.share_within(views.records(spark, folder), "split", "device"), "percentage")


@query("value_counts", with_views("""select split, fold_id, coarse_label, count(*) "count" from folded group by all""", "folded"))
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records per split, fold and class."""
    rows = records.grouped_stratified_folds(views.records(spark, folder), "coarse_label", F.col("split") == "train2022")
    return rows.groupBy("split", "fold_id", "coarse_label").agg(F.count("*").alias("count"))


@query("exclusion_accounting", with_views("""select coalesce(exclusion_reason,'total') exclusion_reason, count(*) records from recs
 where inclusion_status='excluded' group by rollup(exclusion_reason)""", "recs"))
def exclusion_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Excluded records by reason with their total."""
    return records.exclusion_accounting(views.records(spark, folder))


@query("confusion_matrix", with_views("""select g.evaluation, g.task, g.method, a.cls truth, b.cls predicted, coalesce(c.n,0)::bigint n
 from (select distinct evaluation, task, method from conf) g join cl a on a.task=g.task join cl b on b.task=g.task
 left join conf c on c.evaluation=g.evaluation and c.task=g.task and c.method=g.method and c.t=a.cls and c.p=b.cls""", "conf", "cl"))
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Dense confusion counts in long form."""
    return metrics.confusion_matrix(views.predictions(spark, folder), RUN, views.CLASSES)


@query("confusion_wide", with_views("""select evaluation, method, truth, """ + ", ".join(
    f"""sum(case when p='{c}' then n else 0 end)::bigint "{c}" """ for c in views.COARSE)
    + """from (select *, t truth from conf) where task='T2-1' group by evaluation, method, truth""", "conf"))
def confusion_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse confusion counts with one column per predicted class."""
    coarse = views.predictions(spark, folder).filter("task = 'T2-1'")
    matrix = metrics.confusion_matrix(coarse, ["evaluation", "method"], views.COARSE)
    return metrics.confusion_wide(matrix, ["evaluation", "method"], views.COARSE)


@query("classification_metrics", with_views(f"select dataset, evaluation, task, phase, {r9(*THREE)}, record_count from met", "met"))
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced accuracy, macro F1 and accuracy per evaluation, task and phase."""
    return rounded(metrics.classification_metrics(views.predictions(spark, folder), [*KEYS, "phase"], views.CLASSES), *THREE)


@query("classification_metrics_observed", with_views("""select device, round(avg(case when sup>0 then tp::double/sup end),9) balanced_accuracy,
 round(avg(case when tp=0 then 0.0::double else 2.0::double*(tp::double/prd)*(tp::double/sup)/(tp::double/prd+tp::double/sup) end),9) macro_f1,
 round(sum(tp)::double/sum(sup)::double,9) accuracy, sum(sup)::bigint record_count from (
 select device, cls, count(*) filter (y_true=cls and y_pred=cls) tp, count(*) filter (y_true=cls) sup, count(*) filter (y_pred=cls) prd
 from (select device, y_true, y_pred from pred3 join recs using (record_id) where method='CLS' and y_true<>'5-LOW') cross join fine group by all) group by all""",
 "pred3", "recs", "fine"))
def classification_metrics_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics per device over included records: the reject class never occurs as truth and leaves the mean."""
    rows = views.predictions(spark, folder).filter("task = 'T2-2' and method = 'CLS' and y_true <> '5-LOW'")
    joined = rows.join(views.records(spark, folder).select("record_id", "device"), "record_id")
    return rounded(metrics.classification_metrics(joined, ["device"], views.FINE, absent="skip"), *THREE)


@query("per_class_recall", with_views("""select dataset, evaluation, task, phase, cls "class", pos::bigint "position", round(rec,9) recall from pr""", "pr"))
def per_class_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of every declared class."""
    return rounded(metrics.per_class_recall(views.predictions(spark, folder), [*KEYS, "phase"], views.CLASSES), "recall")


OFFICIAL = ["SE", "SP", "AS", "HS", "Score"]
OFFICIAL_SQL = 'round(SE,9) SE, round(SP,9) SP, round("AS",9) "AS", round(HS,9) HS, round(Score,9) Score'


def official(spark: SparkSession, folder: str) -> DataFrame:
    cells = stored(metrics.confusion_counts(views.predictions(spark, folder), RUN), "cells")
    return metrics.official_score_from_counts(cells, RUN, views.NORMAL, views.SENSITIVE)


@query("official_score", with_views(f"select evaluation, task, method, {OFFICIAL_SQL} from off", "off"))
def official_score(spark: SparkSession, folder: str) -> DataFrame:
    """Sensitivity, specificity and the combined scores."""
    return rounded(official(spark, folder).drop("record_count"), *OFFICIAL)


@query("readout_comparison", with_views(f"select evaluation, task, method, record_count, {OFFICIAL_SQL} from off where evaluation like 'test%'", "off"))
def readout_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Official score of every readout on the test evaluations, with record counts."""
    rows = views.predictions(spark, folder).filter(F.col("evaluation").startswith("test"))
    table = plans.challenge_tables(rows, views.board(spark, folder), views.NORMAL, views.SENSITIVE)
    return rounded(table["tab:challenge_readout_comparison"], *OFFICIAL)


@query("method_comparison", with_views(f"""select dataset, evaluation, task, name method, {r9(*THREE)}, record_count,
 case name when 'Own' then 0 when 'Enc-TG' then 1 else 2 end ord from (select *, case method when 'Fusion' then 'Own' else 'Enc-'||method end name from met)""", "met"))
def method_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Encoders and the final phase side by side in a declared method order."""
    rows = views.predictions(spark, folder)
    encoders = rows.filter("method <> 'Fusion'").withColumn("method", F.concat(F.lit("Enc-"), "method"))
    return rounded(plans.method_table(encoders, rows, views.CLASSES, "Own", ["Own", "Enc-TG", "Enc-CLS"]), *THREE)


@query("event_capture_rate", with_views("""select dataset, count(*) pathological_records, count(*) filter (overlap) captured_records,
 round(100.0::double*count(*) filter (overlap)/count(*),9) capture_rate_percent from caps where binary_label='Abnormal' group by all""", "caps"))
def event_capture_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Captured share of the abnormal records."""
    return rounded(metrics.capture_rate(views.captures(spark, folder), ["dataset"], F.col("binary_label") == "Abnormal",
                                        F.col("overlap")), "capture_rate_percent")


def tables_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return plans.progression_tables(views.predictions(spark, folder), views.CLASSES)


@query("phase_delta", with_views(f"""select a.dataset, a.evaluation, a.task, {r9(*[f'a.{m}' for m in THREE])}, a.record_count,
 {', '.join(f'round(a.{m}-b.{m},9) delta_{m}' for m in THREE)} from met a join met b on a.evaluation=b.evaluation and a.task=b.task
 and a.phase='phase2' and b.phase='phase1'""", "met"))
def phase_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Second phase with its change over the first."""
    return rounded(tables_of(spark, folder)["tab:complete_record_results"], *THREE, *[f"delta_{m}" for m in THREE])


@query("recall_delta", with_views("""select a.dataset, a.evaluation, a.task, a.cls "class", a.pos::bigint "position", round(a.rec,9) recall,
 round(a.rec-b.rec,9) delta_recall from pr a join pr b on a.evaluation=b.evaluation and a.task=b.task and a.cls=b.cls
 and a.phase='phase3' and b.phase='phase2'""", "pr"))
def recall_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Third phase recalls with their change over the second."""
    return rounded(tables_of(spark, folder)["tab:dual_readout_per_class_recall"], "recall", "delta_recall")


@query("single_vs_dual", with_views(f"""select a.dataset, a.evaluation, a.task, {', '.join(
    f'round(a.{m},9) single_{m}, round(b.{m},9) dual_{m}, round(b.{m}-a.{m},9) delta_{m}' for m in THREE)}
 from met a join met b on a.evaluation=b.evaluation and a.task=b.task and a.phase='phase1' and b.phase='phase3'""", "met"))
def single_vs_dual(spark: SparkSession, folder: str) -> DataFrame:
    """First and last phase in one row."""
    return rounded(tables_of(spark, folder)["tab:overall_harmonised_comparison"],
                   *[f"{p}_{m}" for p in ("single", "dual", "delta") for m in THREE])


@query("insertion_rank", with_views("""select evaluation, task, tbl published_table, method, 'estimated afterwards; never submitted' status, round(o.Score,9) score,
 1+count(*) filter (b.score>o.Score) estimated_position, 1+count(*) comparison_set_size from off o join board b using (evaluation, task)
 where method='Fusion' group by evaluation, task, tbl, method, o.Score""", "off", "board"))
def insertion_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Place of the fused readout in each published table."""
    rows = views.predictions(spark, folder)
    places = plans.challenge_tables(rows, views.board(spark, folder), views.NORMAL, views.SENSITIVE)
    return rounded(places["tab:challenge_placements"], "score")


@query("insertion_rank_pooled", with_views("""select evaluation, task, method, round(o.Score,9) score,
 1+count(b.score) filter (b.score>o.Score) estimated_position, 1+count(b.score) comparison_set_size from off o left join board b using (evaluation, task)
 group by evaluation, task, method, o.Score""", "off", "board"))
def insertion_rank_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every readout among all published systems of its task; without any it is 1 of 1."""
    scores = official(spark, folder).withColumnRenamed("Score", "score")
    return rounded(comparison.insertion_rank(scores, views.board(spark, folder), ["evaluation", "task"]), "score")


@query("max_abs_diff", with_views("""select coalesce(a.split,b.split) split, count(distinct case when a.j is not null and b.j is not null then a.record_id end) "rows",
 count(distinct case when b.j is null then a.record_id end) only_left, count(distinct case when a.j is null then b.record_id end) only_right,
 round(max(abs(a.p-b.p)),9) max_abs_diff, coalesce(bool_and(a.j is not null and b.j is not null and a.p=b.p),true) exact
 from (select * from scores_long where method='CLS') a
 full join (select * from scores_long where method='TG') b on a.record_id=b.record_id and a.j=b.j group by all""", "scores_long"))
def max_abs_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Largest probability difference between two runs per split, over all records of both."""
    rows = views.scores(spark, folder, fused=False)
    left, right = rows.filter("method = 'CLS'"), rows.filter("method = 'TG'")
    return rounded(checks.max_abs_diff(left, right, ["record_id", "split"], "probabilities", ["split"]), "max_abs_diff")


@query("decode_probabilities", with_views("""select record_id, method, 5 classes, 5 "values", round(max(case when j=0 then p end),9) first_p
 from scores_long group by all""", "scores_long"))
def decode_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays to JSON text and back."""
    rows = probabilities.decode(probabilities.encode(views.scores(spark, folder, fused=False)))
    return rows.select("record_id", "method", F.size("class_order").alias("classes"), F.size("probabilities").alias("values"),
                       F.round(F.get("probabilities", F.lit(0)), 9).alias("first_p"))


@query("argmax_label", with_views("select record_id, method, y_true, y_pred from pred3", "pred3"))
def argmax_query(spark: SparkSession, folder: str) -> DataFrame:
    """Class at the first maximum for every record and method."""
    return probabilities.predict(views.scores(spark, folder)).select("record_id", "method", "y_true", "y_pred")


@query("reconcile_class_order", with_views("""select record_id, method, """ + ", ".join(
    f"round(max(case when j={j} then p end),9) v{j}" for j in range(5)) + " from scores_long group by all", "scores_long"))
def reconcile_class_order(spark: SparkSession, folder: str) -> DataFrame:
    """Stored scores of either class order brought into the declared one."""
    rows = probabilities.reconcile(views.stored_scores(spark, folder), views.FINE)
    return parts(rows.select("record_id", "method", "probabilities"), "probabilities", 5, 9)


@query("fuse_probabilities", with_views("""select a.record_id, """ + ", ".join(
    f"round(max(case when a.j={j} then 0.75::double*a.p+0.25::double*b.p end),9) v{j}" for j in range(5)) + """ from scores_long a
 join scores_long b on a.record_id=b.record_id and a.j=b.j and a.method='CLS' and b.method='TG' group by all""", "scores_long"))
def fuse_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Two score tables joined on the record and fused three to one."""
    rows = views.scores(spark, folder, fused=False)
    fused = probabilities.fuse_tables(rows.filter("method = 'CLS'"), rows.filter("method = 'TG'"), ["record_id"], 0.75, len(views.FINE))
    return parts(fused.select("record_id", "probabilities"), "probabilities", 5, 9)


def sweep_metrics(spark: SparkSession, folder: str) -> DataFrame:
    pairs = views.score_pairs(spark, folder).filter("split = 'train2022'")
    tried = probabilities.alpha_sweep(pairs, ["y_true"], views.FINE, probabilities.alpha_grid())
    return metrics.classification_metrics(tried, ["alpha"], views.FINE, absent="skip")


@query("alpha_grid_sweep", with_views(f"select round(alpha,9) alpha, {r9(*THREE)}, record_count from sweepm", "sweepm"))
def alpha_grid_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Fused training metrics for 21 weights."""
    return rounded(sweep_metrics(spark, folder), "alpha", *THREE)


@query("alpha_ranking", with_views(f"""select round(alpha,9) alpha, {r9(*THREE)}, record_count, rk::int "rank", rk=1 selected from (select *,
 row_number() over (order by round(balanced_accuracy,12) desc, round(macro_f1,12) desc, abs(alpha-0.5::double), alpha) rk from sweepm)""", "sweepm"))
def alpha_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The weights ranked by the declared tie-break rule."""
    ranked = selection.rank_alphas(rounded(sweep_metrics(spark, folder), "balanced_accuracy", "macro_f1", digits=12), [])
    return rounded(ranked, "alpha", *THREE)


def fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Official score of the mix with weight 1 / temperature, per temperature and group fold."""
    spread = views.score_pairs(spark, folder).filter("split = 'train2022'").select(
        "y_true", "p_first", "p_second", (F.col("group_id") % 5).cast("int").alias("fold_id"),
        F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])).alias("temperature"))
    mixed = fuse(F.col("p_first"), F.col("p_second"), F.lit(1.0) / F.col("temperature"), len(views.FINE))
    rows = spread.withColumn("y_pred", argmax_label(string_list(views.FINE), mixed))
    return metrics.official_score(rows, ["temperature", "fold_id"], views.NORMAL["T2-2"], views.SENSITIVE["T2-2"])


def fold_means(spark: SparkSession, folder: str) -> DataFrame:
    return selection.mean_over_folds(fold_scores(spark, folder).withColumn("task", F.lit("T2-2")), ["task", "temperature"])


@query("fold_mean_score", with_views("select task, temperature, round(mean_score,9) mean_score from tmean", "tmean"))
def fold_mean_score(spark: SparkSession, folder: str) -> DataFrame:
    """Mean validation score per grid value."""
    return rounded(fold_means(spark, folder), "mean_score")


@query("incumbent_selection", with_views("""select task, temperature selected from walk order by k desc limit 1""", "tmean").replace(
    "\nselect task, temperature selected", """,
o as (select *, row_number() over (order by temperature) k from tmean),
walk as (select task, k, temperature, mean_score from o where k=1 union all
 select o.task, o.k, case when o.mean_score>walk.mean_score+1e-4::double then o.temperature else walk.temperature end,
 case when o.mean_score>walk.mean_score+1e-4::double then o.mean_score else walk.mean_score end from walk join o on o.k=walk.k+1)
select task, temperature selected""", 1))
def incumbent_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Grid value kept by the ascending replacement rule."""
    return selection.incumbent(fold_means(spark, folder), ["task"], "temperature")
