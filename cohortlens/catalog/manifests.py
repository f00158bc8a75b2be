"""Sources, sinks, record manifests, joins and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import checks, records, verify
from ..operators.slots import pieces
from ..operators.metrics import classification_metrics
from ..plans.experiments import prediction_rows
from ..plans.tables import patient_numbers
from ..session import scratch
from ..sources import sinks, tables
from .registry import REPLICATES, query, rounded, with_views

REC_COLUMNS = {"record_id": "long", "group_id": "long", "yr": "int", "split": "string", "device": "string", "fine_label": "string"}
REC_SQL = with_views("select record_id, group_id, yr, split, device, fine_label from recs", "recs")
MET_SQL = with_views("""select evaluation, task, method, round(balanced_accuracy,9) balanced_accuracy, round(macro_f1,9) macro_f1,
 round(accuracy,9) accuracy, record_count from met""", "met")
RUN = ["evaluation", "task", "method"]


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(classification_metrics(views.predictions(spark, folder), RUN, views.CLASSES),
                   "balanced_accuracy", "macro_f1", "accuracy")


@query("scan_csv_gz", REC_SQL)
def scan_csv_gz(spark: SparkSession, folder: str) -> DataFrame:
    """Record manifest through a gzip CSV, read as text and cast to its types."""
    path = scratch(spark, "csv")
    views.records(spark, folder).select(*REC_COLUMNS).write.option("header", True).option("compression", "gzip").csv(path)
    return tables.read_csv(spark, path, REC_COLUMNS)


@query("sink_csv_gz", REC_SQL)
def sink_csv_gz(spark: SparkSession, folder: str) -> DataFrame:
    """Record manifest written as ordered gzip CSV, then read back."""
    path = scratch(spark, "csv")
    sinks.write_csv_gz(views.records(spark, folder).select(*REC_COLUMNS), path, ["record_id"])
    return tables.read_csv(spark, path, REC_COLUMNS)


@query("scan_table_json", MET_SQL.replace("select evaluation, task", "select 'tab:results' label, evaluation, task"))
def scan_table_json(spark: SparkSession, folder: str) -> DataFrame:
    """Metric table through a result payload document."""
    path = scratch(spark, "json")
    rows = metric_rows(spark, folder)
    sinks.write_payload(rows, path, "tab:results")
    return tables.read_payload(spark, path, ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema))


@query("sink_json", MET_SQL)
def sink_json(spark: SparkSession, folder: str) -> DataFrame:
    """Metric table as JSON lines with sorted fields, then read back."""
    path = scratch(spark, "json")
    rows = metric_rows(spark, folder)
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("sink_bundle", MET_SQL.replace("select evaluation, task", """select 'tab:results' label, (select count(*) from met) table_rows,
 (select count(*) from met) + (select count(*) from pc) total_rows, evaluation, task"""))
def sink_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Two labelled tables as JSON and CSV; the values of one read back from its CSV, with the manifest's counts."""
    from ..operators.metrics import per_class_recall
    predictions = views.predictions(spark, folder)
    path, results = scratch(spark, "bundle"), metric_rows(spark, folder)
    manifest = sinks.write_bundle(
        {"tab:results": results, "tab:recalls": per_class_recall(predictions, RUN, views.CLASSES)},
        path, {"tab:results": RUN, "tab:recalls": [*RUN, "position"]})
    counts = manifest.filter("label = 'tab:results'").select(F.struct("label", F.col("rows").alias("table_rows"), "total_rows").alias("m")).scalar()
    read = spark.read.schema(results.schema).option("header", True).csv(f"{path}/tables/results")
    return read.withColumn("m", counts).select("m.*", *results.columns)


@query("sink_features", with_views("select split, record_id, len(features)::int size, round(features[1],9) v0 from embs", "embs"))
def sink_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature table written by split folder and read back with its dimension checked."""
    path = scratch(spark, "features")
    sinks.write_features(views.features(spark, folder).select("record_id", "split", "features"), path, "split")
    stored = tables.read_features(spark, path, views.FEATURE_DIM)
    return stored.select("split", "record_id", F.size("features").alias("size"),
                         F.round(F.get("features", F.lit(0)), 9).alias("v0"))


@query("scan_features", with_views("select record_id, len(features)::int size, round(list_sum(features),6) total from embs", "embs"))
def scan_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature vectors under a dimension contract."""
    rows = tables.with_dimension(views.features(spark, folder), views.FEATURE_DIM)
    total = F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("record_id", F.size("features").alias("size"), F.round(total, 6).alias("total"))


@query("scan_draws", with_views("select task, draw, slot, patient_index from draws", "draws"))
def scan_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Bootstrap draws stored as array pieces and read back in long form."""
    path = scratch(spark, "draws")
    patients = patient_numbers(views.drawn_predictions(spark, folder))
    sinks.write_draw_pieces(pieces(spark, patients, REPLICATES), path)
    return tables.read_draws(spark, path)


@query("file_inventory")
def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of the data folder with the number of files sharing their stem."""
    files = tables.file_inventory(spark, folder, ".parquet")
    copies = files.groupBy("stem").agg(F.count("*").alias("copies"))
    return files.join(copies, "stem").select("file_name", "stem", "length", "copies").orderBy("file_name")


@query("public_projection", with_views("select record_id, split, group_id patient_group, device, coarse_label from recs", "recs"))
def public_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Public columns of the manifest; the device is optional and the group is renamed."""
    return records.public_projection(views.records(spark, folder),
                                     ["record_id", "split", "group_id", "device", "room", "coarse_label"],
                                     optional=["device", "room"], renames={"group_id": "patient_group"})


@query("inclusion_filter", with_views("select record_id, split, fine_label from recs where inclusion_status='included'", "recs"))
def inclusion_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Included records only."""
    return records.included(views.records(spark, folder)).select("record_id", "split", "fine_label")


@query("key_filters", with_views("""select dataset, evaluation, task, method, count(*) "rows" from tp
 where phase='phase3' and dataset like 'Set%' and evaluation in ('test2022','test2023') group by all""", "tp"))
def key_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Equality, prefix and membership filters on the prediction keys."""
    rows = views.predictions(spark, folder).filter(
        (F.col("phase") == "phase3") & F.col("dataset").startswith("Set") & F.col("evaluation").isin("test2022", "test2023"))
    return rows.groupBy("dataset", "evaluation", "task", "method").agg(F.count("*").alias("rows"))


OFFICIAL = """case when split<>'test2022' then split when group_id in (select group_id from recs where split='train2022')
 then 'test_intra' else 'test_inter' end"""


@query("official_split", with_views(f"select record_id, {OFFICIAL} official_split from recs", "recs"))
def official_split(spark: SparkSession, folder: str) -> DataFrame:
    """Test records split by whether their group occurs in training."""
    return (records.official_split(views.records(spark, folder), "train2022", "test2022")
            .select("record_id", "official_split"))


def _normalised(spark: SparkSession, folder: str) -> DataFrame:
    split = records.official_split(views.records(spark, folder), "train2022", "test2022")
    return records.normalise_keys(split, {"test2023": "SetB"}, "SetA")


NORMALISED = f"""select record_id, fine_label, {OFFICIAL} official_split, split,
 case when split='test2023' then 'SetB' else 'SetA' end dataset from recs"""


@query("normalise_keys", with_views(f"select record_id, dataset, split, lower(dataset) evaluation from ({NORMALISED})", "recs"))
def normalise_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset by split, merged test parts and lower-case evaluation names."""
    return _normalised(spark, folder).select("record_id", "dataset", "split", "evaluation")


@query("dataset_records", with_views(f"select record_id, official_split split, fine_label from ({NORMALISED}) where dataset='SetA'", "recs"))
def dataset_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one dataset under their official split."""
    return records.dataset_records(_normalised(spark, folder), "SetA").select("record_id", "split", "fine_label")


@query("evaluation_splits", with_views("""select case split when 'test2022' then 'Set2022' else 'Set2023' end dataset, split evaluation, record_id
 from recs where split in ('test2022','test2023')""", "recs"))
def evaluation_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out rows under the name of their evaluation."""
    mapping = [("test2022", "Set2022", "test2022"), ("test2023", "Set2023", "test2023")]
    return records.evaluation_splits(views.records(spark, folder), mapping).select("dataset", "evaluation", "record_id")


@query("label_domain_check", with_views("""select fine_label "label", count(*) records from recs
 where fine_label not in ('1-URGENT','2-HIGH','3-MEDIUM') group by all""", "recs"))
def label_domain_check(spark: SparkSession, folder: str) -> DataFrame:
    """Labels outside a shorter declared list, with their counts."""
    return checks.label_domain(views.records(spark, folder), "fine_label", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("class_order_check", with_views("""select m.method, count(*) checked, sum(case when m.method='TG' then 1 else 0 end)::bigint mismatched
 from recs cross join meth m group by all""", "recs", "meth"))
def class_order_check(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per method whose stored class order differs from the declared one."""
    return checks.class_order_check(views.stored_scores(spark, folder), ["method"], views.FINE)


@query("schema_expectations", with_views("""select * from (
 select 'unique record_id' "check", (select count(distinct record_id) from recs) expected, (select count(*) from recs) actual union all
 select 'missing labels', 0, (select count(*) from recs where fine_label is null) union all
 select 'known splits', (select count(*) from recs), (select count(*) from recs where split in ('train2022','test2022','test2023')) union all
 select 'excluded have a reason', (select count(*) from recs where inclusion_status='excluded'), (select count(*) from recs where exclusion_reason is not null) union all
 select 'train records', 0, (select count(*) from recs where split='train2022') union all
 select 'vectors of 64', (select count(*) from embs), (select count(*) from embs where len(features)=64) union all
 select 'finite vectors', (select count(*) from embs), (select count(*) from embs where len(list_filter(features, lambda x: not isfinite(x)))=0))
 cross join (select 1) one""", "recs", "embs").replace('select * from (\n', 'select "check", expected::bigint expected, actual::bigint actual, expected=actual ok from (\n'))
def schema_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, uniqueness, split membership, dimension and finiteness as rows of expected against actual."""
    from ..functions.vectors import all_finite
    everything = F.count("*")
    manifest = checks.expectations(views.records(spark, folder), [
        ("unique record_id", everything, F.countDistinct("record_id")),
        ("missing labels", F.count_if(F.col("fine_label").isNull()), 0),
        ("known splits", F.count_if(F.col("split").isin(views.SPLITS)), everything),
        ("excluded have a reason", F.count("exclusion_reason"), F.count_if(F.col("inclusion_status") == "excluded")),
        ("train records", F.count_if(F.col("split") == "train2022"), 0)])
    vectors = checks.expectations(views.features(spark, folder), [
        ("vectors of 64", F.count_if(F.size("features") == 64), everything),
        ("finite vectors", F.count_if(all_finite(F.col("features"))), everything)])
    return manifest.unionByName(vectors)


@query("duplicate_keys", """select l_orderkey, l_linenumber, count(*) copies from lineitem group by all having count(*)>1""")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Key pairs that occur more than once."""
    return checks.duplicate_keys(tables.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("cross_split_duplicates", with_views("""select record_id, content, held_out_copies from docs
 join (select content, count(*) held_out_copies from docs where split='test' group by all) using (content) where split='train'""", "docs"))
def cross_split_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Train documents whose exact text is also held out."""
    return (records.cross_split_duplicates(views.contents(spark, folder), "content", "split", "train", "test")
            .select("record_id", "content", "held_out_copies"))


@query("record_source_join", with_views("""select r.split, s.split=r.split split_agrees, count(*) records from recs r
 join (select o_orderkey record_id, case when o_totalprice>300000 then 'moved' when year(o_orderdate)=1995 then 'train2022'
  when year(o_orderdate)<=1997 then 'test2022' else 'test2023' end split from orders) s using (record_id) group by all""", "recs"))
def record_source_join(spark: SparkSession, folder: str) -> DataFrame:
    """Records against their source rows, counted by agreement of the split."""
    year = F.year("o_orderdate")
    sources = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.when(F.col("o_totalprice") > 300000, F.lit("moved")).when(year == 1995, F.lit("train2022"))
        .when(year <= 1997, F.lit("test2022")).otherwise(F.lit("test2023")).alias("split"))
    joined = checks.source_join(views.records(spark, folder), sources, "record_id")
    return joined.groupBy("split", "split_agrees").agg(F.count("*").alias("records"))


@query("record_window_align", with_views("""select coalesce(r.record_id, w.record_id) record_id, coalesce(w.n,0) windows,
 case when r.record_id is null then 'unknown record' when w.record_id is null then 'no windows' else 'ok' end state
 from recs r full outer join (select l_orderkey record_id, count(*) n from lineitem group by all) w on r.record_id=w.record_id""", "recs"))
def record_window_align(spark: SparkSession, folder: str) -> DataFrame:
    """Windows per record, with records missing on either side."""
    return checks.window_alignment(views.records(spark, folder), views.windows(spark, folder, indexed=False))


@query("branch_align_check", with_views("""select count(*) filter (a.record_id is not null and b.record_id is not null) matched,
 count(*) filter (b.record_id is null) only_left, count(*) filter (a.record_id is null) only_right,
 count(*) filter (a.y_true is distinct from b.y_true and a.record_id is not null and b.record_id is not null) truth_mismatch
 from (select * from recs1) a full outer join recs2 b on a.record_id=b.record_id""", "recs").replace("\nselect count(*) filter (a", """,
recs1 as (select record_id, fine_label y_true from recs where device<>'MACHINERY'),
recs2 as (select record_id, case when yr=1996 then 'x' else fine_label end y_true from recs where device<>'BUILDING')
select count(*) filter (a""", 1))
def branch_align_check(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage and truth agreement of two branches that each miss a device."""
    rows = views.records(spark, folder)
    left = rows.filter("device <> 'MACHINERY'").select("record_id", F.col("fine_label").alias("y_true"))
    right = rows.filter("device <> 'BUILDING'").select(
        "record_id", F.when(F.col("yr") == 1996, F.lit("x")).otherwise(F.col("fine_label")).alias("y_true"))
    return checks.branch_alignment(left, right, ["record_id"])


@query("method_union", with_views("""select dataset, evaluation, task, 'Enc-'||method method, record_id, y_true, y_pred from tp where method<>'Fusion'
 union all select dataset, evaluation, task, 'Own', record_id, y_true, y_pred from tp where phase='phase3'""", "tp"))
def method_union(spark: SparkSession, folder: str) -> DataFrame:
    """Encoder rows and the final phase under one method column."""
    rows = views.predictions(spark, folder)
    columns = ["dataset", "evaluation", "task", "method", "record_id", "y_true", "y_pred"]
    encoders = rows.filter("method <> 'Fusion'").withColumn("method", F.concat(F.lit("Enc-"), "method"))
    own = rows.filter("phase = 'phase3'").withColumn("method", F.lit("Own"))
    return encoders.select(*columns).unionByName(own.select(*columns))


@query("universe_equality", """select o_orderkey record_id, 'missing' state from orders where o_orderkey not in (select l_orderkey from lineitem)
 union all select distinct l_orderkey, 'unexpected' from lineitem where l_orderkey not in (select o_orderkey from orders)""")
def universe_equality(spark: SparkSession, folder: str) -> DataFrame:
    """Record ids without windows, and windows without a record."""
    expected = tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("record_id"))
    actual = tables.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id"))
    expected = expected.unionByName(expected.filter("record_id % 2 = 0"))  # repeats do not count
    return checks.universe_difference(expected, actual, "record_id")


@query("group_leakage_intersect", with_views("""select group_id from recs where split='train2022' intersect
 select group_id from recs where split='test2022'""", "recs"))
def group_leakage_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Groups on both sides of the train/test boundary."""
    return checks.shared_groups(views.records(spark, folder), "split", "group_id", "train2022", "test2022")


@query("ordered_distinct", with_views("select distinct fine_label from recs order by 1", "recs"))
def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct labels in order."""
    return checks.ordered_distinct(views.records(spark, folder), "fine_label")


@query("fold_leakage_nunique", with_views("""select group_id, count(distinct record_id%5) folds from recs where split='train2022'
 group by all having count(distinct record_id%5)>1""", "recs"))
def fold_leakage_nunique(spark: SparkSession, folder: str) -> DataFrame:
    """Groups torn apart by folds drawn per record instead of per group."""
    rows = views.records(spark, folder).withColumn(
        "fold_id", F.when(F.col("split") == "train2022", F.col("record_id") % 5).otherwise(-1))
    return checks.fold_leakage(rows)


@query("grouped_stratified_folds", with_views("select record_id, fold_id from folded", "folded"))
def grouped_stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Five folds over the training records with whole groups and balanced classes."""
    return records.grouped_stratified_folds(views.records(spark, folder), "coarse_label", F.col("split") == "train2022"
                                            ).select("record_id", "fold_id")


@query("custom_order_sort", with_views("""select record_id, official_split, case official_split when 'train2022' then 0 when 'test_inter' then 1
 when 'test_intra' then 2 else 3 end ord from (""" + NORMALISED + ")", "recs"))
def custom_order_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Records in the declared split order, then by id."""
    split = records.official_split(views.records(spark, folder), "train2022", "test2022")
    ordered = records.custom_order(split, "official_split", ["train2022", "test_inter", "test_intra", "test2023"])
    return ordered.select("record_id", "official_split", "ord").orderBy("ord", "record_id")


@query("sequential_ids", """select c_name, printf('record_%05d', row_number() over (order by c_name)) record_name from (select distinct c_name from customer)""")
def sequential_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted distinct names numbered from 1."""
    return records.sequential_ids(tables.table(spark, folder, "customer"), "c_name", "record_%05d")


@query("first_n_records", with_views("select record_id, split from recs order by split, record_id limit 100", "recs"))
def first_n_records(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 records in manifest order."""
    return records.first_n(views.records(spark, folder).select("record_id", "split"), ["split", "record_id"], 100)


def _fingerprint_sql(header: str, fields: str, source: str, where: str = "true") -> str:
    slices = ", '-', ".join(f"sum(('0x'||substr(h,{1 + 5 * i},5))::bigint)::bigint" for i in range(4))
    return f"(select concat(count(*), '-', {slices}) from (select sha256(concat('{header}', {fields})) h from {source} where {where}))"


RECORD_KEYS = "o_orderkey:bigint,o_custkey:bigint", "'v', length(o_orderkey::varchar), ':', o_orderkey, 'v', length(o_custkey::varchar), ':', o_custkey", "orders"
WINDOW_KEYS = ("l_orderkey:bigint,l_linestatus:string",
               "'v', length(l_orderkey::varchar), ':', l_orderkey, 'v', length(l_linestatus), ':', l_linestatus", "lineitem")


@query("cache_valid", f"""with m as (select
 (select count(*)::varchar from orders) records, (select count(*)::varchar from lineitem) windows,
 (select count(*)::varchar from lineitem where l_linestatus<>'O') fewer, {_fingerprint_sql(*RECORD_KEYS)} rf,
 {_fingerprint_sql(*WINDOW_KEYS)} wf, {_fingerprint_sql(*WINDOW_KEYS, "l_linestatus<>'O'")} ff)
 select field, expected, actual, expected=actual ok from (select unnest(['records','windows','records_fingerprint','windows_fingerprint']) field,
 unnest([records,windows,rf,wf]) expected, unnest([records,fewer,rf,ff]) actual from m)""")
def cache_valid(spark: SparkSession, folder: str) -> DataFrame:
    """A stored manifest that counted only part of the windows against the current one."""
    records, lines = tables.table(spark, folder, "orders"), tables.table(spark, folder, "lineitem")

    def manifest(windows: DataFrame) -> DataFrame:
        return verify.manifest({"records": (records, ["o_orderkey", "o_custkey"]), "windows": (windows, ["l_orderkey", "l_linestatus"])})

    return verify.cache_valid(manifest(lines.filter("l_linestatus <> 'O'")), manifest(lines))


@query("prediction_rows", with_views("""select 'Set' dataset, split evaluation, 'phase1' phase, 'T2-2' task, a.record_id, a.y_true, pred3.y_pred,
 5 classes, round(max(p),9) top from scores_long a join pred3 using (record_id, method, group_id, split, y_true) where method='CLS' group by all""", "scores_long", "pred3"))
def prediction_rows_query(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows in the long prediction layout."""
    scored = views.scores(spark, folder).filter("method = 'CLS'")
    rows = prediction_rows(scored, "y_true", dataset="Set", evaluation=F.col("split"), phase="phase1", task="T2-2")
    return rows.select("dataset", "evaluation", "phase", "task", "record_id", "y_true", "y_pred",
                       F.size("class_order").alias("classes"), F.round(F.array_max("probabilities"), 9).alias("top"))
