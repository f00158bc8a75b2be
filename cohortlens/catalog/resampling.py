"""Bootstrap, verification and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import bootstrap as boot
from ..operators import checks, metrics, report, verify
from ..operators.records import included
from ..plans import tables as plans
from ..session import scratch, stored
from ..sources import sinks
from .registry import PROTOCOL_REPLICATES, REPLICATES, query, rounded, with_views
from .scoring import RUN, THREE, official

BY = ["task", "method"]
PAIRS = [("TG", "CLS"), ("Fusion", "CLS"), ("Fusion", "TG")]


def resampled(spark: SparkSession, folder: str) -> plans.Resampled:
    return plans.resample(views.drawn_predictions(spark, folder), REPLICATES)


@query("patient_confusions", with_views("select task, method, patient_index, t truth, p predicted, n from cells", "cells"))
def patient_confusions(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion cells per patient."""
    return plans.patient_cells(views.drawn_predictions(spark, folder))[0]


@query("bootstrap_draws", with_views("select task, draw, slot, patient_index from draws", "draws"))
def bootstrap_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Hash-based patient draws with replacement."""
    return boot.draws(spark, plans.patient_numbers(views.drawn_predictions(spark, folder)), REPLICATES)


@query("resampled_confusions", with_views("select draw, task, method, t truth, p predicted, n from resampled", "resampled"))
def resampled_confusions(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion cells per draw with multiplicity."""
    return resampled(spark, folder).drawn


def class_replicates(spark: SparkSession, folder: str) -> DataFrame:
    return boot.classification_replicates(resampled(spark, folder).drawn, BY, views.CLASSES)


def score_replicates(spark: SparkSession, folder: str) -> DataFrame:
    return boot.challenge_replicates(resampled(spark, folder).drawn, BY, views.NORMAL, views.SENSITIVE)


@query("classification_replicates", with_views("""select draw, task, method, round(balanced_accuracy,9) balanced_accuracy,
 round(macro_f1,9) macro_f1, round(accuracy,9) accuracy from creps""", "creps"))
def classification_replicates(spark: SparkSession, folder: str) -> DataFrame:
    """Classification metrics per draw."""
    return rounded(class_replicates(spark, folder), *THREE)


@query("challenge_replicates", with_views("""select draw, task, method, round(SE,9) SE, round(SP,9) SP, round("AS",9) "AS", round(HS,9) HS,
 round(Score,9) Score from hreps""", "hreps"))
def challenge_replicates(spark: SparkSession, folder: str) -> DataFrame:
    """Official scores per draw."""
    return rounded(score_replicates(spark, folder), "SE", "SP", "AS", "HS", "Score")


@query("percentile_interval", with_views("""select task, method, round(quantile_cont(Score,0.025),9) ci_lower, round(quantile_cont(Score,0.975),9) ci_upper,
 count(*) replicates from hreps group by all""", "hreps"))
def percentile_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Linear 95% interval of the official score."""
    return rounded(boot.percentile_interval(score_replicates(spark, folder), BY, "Score"), "ci_lower", "ci_upper")


PAIRED = " union all ".join(f"""select '{a} - {b}' method, x.task, x.draw, x.{{0}}-y.{{0}} v from {{1}} x join {{1}} y
 on x.task=y.task and x.draw=y.draw and x.method='{a}' and y.method='{b}'""" for a, b in PAIRS)


@query("paired_difference_ci", with_views(f"""select task, method, round(quantile_cont(v,0.025),9) ci_lower, round(quantile_cont(v,0.975),9) ci_upper,
 count(*) replicates from ({PAIRED.format('Score', 'hreps')}) group by all""", "hreps"))
def paired_difference_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the paired score differences."""
    values = score_replicates(spark, folder).select("draw", *BY, F.col("Score").alias("value"))
    return rounded(boot.percentile_interval(boot.paired_differences(values, ["task", "draw"], PAIRS), BY), "ci_lower", "ci_upper")


INTERVALS = """select p.task, p.method, p.metric, round(p.v,9) point_estimate, round(i.lo,9) ci_lower, round(i.hi,9) ci_upper, i.replicates
 from pts p join (select task, method, metric, quantile_cont(v,0.025) lo, quantile_cont(v,0.975) hi, count(*) replicates from vals group by all) i
 using (task, method, metric)"""


def _interval_sql(points: str, replicates: str, views_needed: tuple[str, ...]) -> str:
    """Points and replicates in long form, extended by the differences, then joined to their intervals."""
    diffs = " union all ".join(
        f"""select x.task, '{a} - {b}' method, x.metric, x.v-y.v v from {{0}} x join {{0}} y on x.task=y.task and x.metric=y.metric {{1}}
 and x.method='{a}' and y.method='{b}'""" for a, b in PAIRS)
    body = (f"pts0 as ({points}), reps0 as ({replicates}), pts as (select task, method, metric, v from pts0 union all {diffs.format('pts0', '')}), "
            f"vals as (select task, method, metric, v from reps0 union all {diffs.format('reps0', 'and x.draw=y.draw')})\n{INTERVALS}")
    head = with_views("", *views_needed)
    return head.rstrip() + ",\n" + body


@query("bootstrap_tables", _interval_sql(
    "select task, method, 'Score' metric, Score v from hrepsp where draw=-1",
    "select draw, task, method, 'Score' metric, Score v from hreps", ("hreps",)))
def bootstrap_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Official score intervals of the readouts and of their differences."""
    table = plans.bootstrap_challenge(resampled(spark, folder), views.NORMAL, views.SENSITIVE, PAIRS)
    return rounded(table, "point_estimate", "ci_lower", "ci_upper")


@query("bootstrap_classification", _interval_sql(
    """select task, method, unnest(['balanced_accuracy','macro_f1']) metric, unnest([balanced_accuracy,macro_f1]) v from crepsp where draw=-1""",
    """select draw, task, method, unnest(['balanced_accuracy','macro_f1']) metric, unnest([balanced_accuracy,macro_f1]) v from creps""", ("creps",)))
def bootstrap_classification(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced accuracy and macro F1 intervals of the phases and of their differences."""
    table = plans.bootstrap_classification(resampled(spark, folder), views.CLASSES, PAIRS)
    return rounded(table, "point_estimate", "ci_lower", "ci_upper")


@query("bootstrap_protocol")
def bootstrap_protocol(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of all metrics at the protocol's number of draws, from patient counts per draw."""
    drawn = plans.resample_by_counts(views.drawn_predictions(spark, folder), PROTOCOL_REPLICATES)
    tables = (plans.bootstrap_challenge(drawn, views.NORMAL, views.SENSITIVE, PAIRS), plans.bootstrap_classification(drawn, views.CLASSES, PAIRS))
    return rounded(tables[0].unionByName(tables[1]), "point_estimate", "ci_lower", "ci_upper")


def result_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All labelled result tables of the engine from the given data."""
    rows, everything = stored(views.predictions(spark, folder), "predictions"), views.records(spark, folder)
    tasks = {"T2-1": ("coarse_label", views.COARSE), "T2-2": ("fine_label", views.FINE)}
    encoders = rows.filter("method <> 'Fusion'").withColumn("method", F.concat(F.lit("Enc-"), "method"))
    drawn = plans.resample(views.drawn(rows), REPLICATES)
    own = {"binary": ("binary_label", views.BINARY_LABELS), "quarter": ("coarse_label", views.QUARTER_LABELS)}
    return {
        "tab:source_class_distribution": metrics.class_distribution(views.features(spark, folder), own, ["train", "test2022", "test2023"]),
        **plans.manifest_tables(included(everything), everything, tasks, views.SPLITS, views.captures(spark, folder), "Abnormal"),
        **plans.progression_tables(rows, views.CLASSES),
        "tab:encoder_comparison": plans.method_table(encoders, rows, views.CLASSES, "Own", ["Own", "Enc-TG", "Enc-CLS"]),
        **plans.challenge_tables(rows, views.board(spark, folder), views.NORMAL, views.SENSITIVE),
        "tab:bootstrap_harmonised": plans.bootstrap_classification(drawn, views.CLASSES, PAIRS),
        "tab:bootstrap_challenge_readouts": plans.bootstrap_challenge(drawn, views.NORMAL, views.SENSITIVE, PAIRS),
    }


@query("result_bundle", with_views("""select 'tab:class_distribution' "label", 24::bigint "rows" union all select 'tab:source_class_distribution', 18 union all
 select 'tab:challenge_class_distribution', 24 union all
 select 'tab:device_distribution', count(*) from (select distinct split, device from recs where inclusion_status='included') union all
 select 'tab:single_window_event_capture', count(distinct dataset) from caps where binary_label='Abnormal' union all
 select l, count(*) from met cross join (values ('tab:single_window_results'),('tab:complete_record_results'),('tab:dual_readout_results'),
  ('tab:overall_harmonised_comparison')) t(l) where phase='phase1' group by l union all
 select l, count(*) from pc cross join (values ('tab:single_window_per_class_recall'),('tab:complete_record_per_class_recall'),
  ('tab:dual_readout_per_class_recall')) t(l) where phase='phase1' group by l union all
 select 'tab:encoder_comparison', count(*) from met union all
 select 'tab:challenge_readout_comparison', count(*) from off union all
 select 'tab:challenge_placements', count(*) from (select distinct evaluation, task, tbl from board join off using (evaluation, task) where method='Fusion') union all
 select 'tab:bootstrap_harmonised', 2*2*(count(distinct method)+3) from off union all
 select 'tab:bootstrap_challenge_readouts', 2*(count(distinct method)+3) from off""", "recs", "caps", "met", "off", "board"))
def result_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The whole result set written as one bundle; label and row count per table."""
    tables = result_tables(spark, folder)
    order = {label: df.columns for label, df in tables.items()}
    return sinks.write_bundle(tables, scratch(spark, "bundle"), order).select("label", "rows")


def two_runs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Differences between the two methods' metric and score tables."""
    rows = views.predictions(spark, folder)
    keys = ["evaluation", "task"]
    m = rounded(metrics.classification_metrics(rows, RUN, views.CLASSES), *THREE)
    m = m.withColumn("note", F.concat(F.lit("n="), F.col("record_count").cast("string")))
    s = rounded(official(spark, folder), "Score")
    s = s.withColumn("note", F.col("method"))

    def run(df: DataFrame, method: str) -> DataFrame:
        return df.filter(F.col("method") == method)

    return {"tab:results": verify.table_diff(run(m, "CLS"), run(m, "TG"), keys, list(THREE), ["note"]),
            "tab:scores": verify.table_diff(run(s, "CLS").filter("evaluation <> 'train2022'"), run(s, "TG").filter("task = 'T2-1'"),
                                            keys, ["Score"], ["note"], decimals=1)}


_DIFF = with_views("", "met", "off").rstrip() + """,
m0 as (select evaluation, task, method, field, v, null::varchar txt from (select evaluation, task, method, unnest(['balanced_accuracy','macro_f1','accuracy']) field,
  unnest([round(balanced_accuracy,9),round(macro_f1,9),round(accuracy,9)]) v from met) union all
  select evaluation, task, method, 'note', null, 'n='||record_count from met),
s0 as (select evaluation, task, method, 'Score' field, round(Score,9) v, null::varchar txt from off union all select evaluation, task, method, 'note', null, method from off),
j as (select 'tab:results' lab, 4 dec, evaluation, task, field, a.v av, e.v ev, a.txt atx, e.txt etx, a.method am, e.method em
  from (select * from m0 where method='CLS') a full outer join (select * from m0 where method='TG') e using (evaluation, task, field)
  union all select 'tab:scores', 1, evaluation, task, field, a.v, e.v, a.txt, e.txt, a.method, e.method
  from (select * from s0 where method='CLS' and evaluation<>'train2022') a
  full outer join (select * from s0 where method='TG' and task='T2-1') e using (evaluation, task, field)),
d as (select lab, evaluation, task, field, case when am is null then 'missing' when em is null then 'extra' else 'both' end state, av actual, ev expected,
  abs(av-ev) difference, am is not null and em is not null and case when av is not null or ev is not null then coalesce(abs(av-ev)<=1e-12::double,false)
   else atx is not distinct from etx end numeric_ok,
  am is not null and em is not null and atx is not distinct from etx and
   (case when dec=4 then printf('%.4f',av) else printf('%.1f',av) end) is not distinct from
   (case when dec=4 then printf('%.4f',ev) else printf('%.1f',ev) end) display_ok from j)
"""
_REPORT = """(select lab "label", case when bool_and(numeric_ok and display_ok) then 'PASS' else 'FAIL' end status,
 case when bool_and(numeric_ok) then 'PASS' else 'FAIL' end numeric_status, case when bool_and(display_ok) then 'PASS' else 'FAIL' end display_status,
 coalesce(max(difference),0) max_difference, count(*) checked from d group by all)"""
DIFF_COLUMNS = ["evaluation", "task", "field", "state", "actual", "expected", "difference", "numeric_ok", "display_ok"]


@query("table_diff", _DIFF + """select evaluation, task, field, state, actual, expected, round(difference,9) difference, numeric_ok, display_ok
 from d where lab='tab:results'""")
def table_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed field comparison of two metric tables."""
    return rounded(two_runs(spark, folder)["tab:results"], "difference").select(*DIFF_COLUMNS)


@query("display_diff", _DIFF + "select evaluation, task, field, state, display_ok from d where lab='tab:scores'")
def display_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement at display precision, with keys missing on either side."""
    return two_runs(spark, folder)["tab:scores"].select("evaluation", "task", "field", "state", "display_ok")


@query("verification_report", _DIFF + f'select "label", status, numeric_status, display_status, round(max_difference,9) max_difference, checked from {_REPORT}')
def verification_report(spark: SparkSession, folder: str) -> DataFrame:
    """PASS or FAIL per table."""
    return rounded(verify.verification_report(two_runs(spark, folder)), "max_difference")


@query("run_comparison", _DIFF + f"""select count(*) comparable_table_count, bool_and(display_status='PASS') display_consistent,
 round(max(max_difference),9) maximum_absolute_difference from {_REPORT}""")
def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Summary over all tables of two runs."""
    return rounded(verify.run_comparison(two_runs(spark, folder)), "maximum_absolute_difference")


@query("table_coverage", with_views("""select coalesce(e.l, p.l) "label", case when p.l is null then 'missing' when e.l is null then 'unexpected' else 'present' end state
 from (values ('tab:CLS'),('tab:Fusion'),('tab:Grid')) e(l) full outer join (select distinct 'tab:'||method l from met) p on e.l=p.l""", "met"))
def table_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Expected labels against the produced ones."""
    produced = views.predictions(spark, folder).select(F.concat(F.lit("tab:"), "method").alias("label"))
    return checks.coverage(["tab:CLS", "tab:Fusion", "tab:Grid"], produced)


@query("table_fingerprint", with_views("""select count(*) "rows", """ + ", ".join(
    f"sum(('0x'||substr(h,{1 + 5 * i},5))::bigint)::bigint h{i}" for i in range(4)) + """ from (select sha256(concat('record_id:bigint,group_id:bigint,split:string,fine_label:string,exclusion_reason:string',
 'v', length(record_id::varchar), ':', record_id, 'v', length(group_id::varchar), ':', group_id, 'v', length(split), ':', split,
 'v', length(fine_label), ':', fine_label, coalesce('v'||length(exclusion_reason)||':'||exclusion_reason,'n'))) h from recs)""", "recs"))
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Order-insensitive content hash of the manifest."""
    return verify.table_fingerprint(views.records(spark, folder), ["record_id", "group_id", "split", "fine_label", "exclusion_reason"])


@query("display_projection", with_views("""select case dataset when 'Set2022' then 'Set 2022' else 'Set 2023' end "Dataset", task "Task",
 case phase when 'phase1' then 'Single' when 'phase2' then 'Complete' else 'Dual' end "Method", printf('%.4f',round(balanced_accuracy,9)) "BA",
 printf('%.4f',round(macro_f1,9)) "Macro-F1", printf('%.1f',round(100.0::double*accuracy,9)) "Acc. (%)", record_count::varchar "N" from met where evaluation<>'train2022'""", "met"))
def display_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Metric table in display form: mapped labels, fixed decimals, chosen columns."""
    by = ["dataset", "evaluation", "task", "phase"]
    rows = views.predictions(spark, folder).filter("evaluation <> 'train2022'")
    table = metrics.classification_metrics(rows, by, views.CLASSES).withColumn("percent", F.lit(100.0) * F.col("accuracy"))
    return report.display_projection(
        rounded(table, *THREE, "percent"),
        ["dataset", "task", "phase", "balanced_accuracy", "macro_f1", "percent", "record_count"],
        {"balanced_accuracy": 4, "macro_f1": 4, "percent": 1}, ["record_count"],
        {"Set2022": "Set 2022", "Set2023": "Set 2023", "phase1": "Single", "phase2": "Complete", "phase3": "Dual"},
        {"dataset": "Dataset", "task": "Task", "phase": "Method", "balanced_accuracy": "BA", "macro_f1": "Macro-F1",
         "percent": "Acc. (%)", "record_count": "N"})
