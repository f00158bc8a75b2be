"""Signal windows, crops, resampling and vector pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.vectors import grid_readout, pad_right
from ..operators import pooling, records, signals
from ..plans.experiments import TEMPERATURES
from .registry import parts, query, rounded, with_views

W = 8


@query("record_windows", with_views(f"""select record_id, (sample_index//{W})::int window_index, count(*) valid_samples, {W}-count(*) right_padding_samples,
 round(sum(value)/{W}.0::double,6) window_mean from sig group by all union all
 select c_custkey, 0, 0, {W}, 0.0 from customer where c_custkey not in (select user_id from events)""", "sig"))
def record_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive windows; customers without any event get one empty window."""
    people = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("record_id"))
    return rounded(signals.record_windows(views.signal(spark, folder), W, people), "window_mean", digits=6)


@query("fixed_count_windows", with_views(f"""select r.record_id, k::int window_index, count(value) valid_samples, {W}-count(value) right_padding_samples,
 round(coalesce(sum(value),0)/{W}.0::double,6) window_mean from (select distinct record_id from sig) r cross join range(8) t(k)
 left join sig on sig.record_id=r.record_id and sample_index//{W}=k group by all""", "sig"))
def fixed_count_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly eight windows per record."""
    return rounded(signals.fixed_windows(views.signal(spark, folder), W, 8), "window_mean", digits=6)


@query("max_energy_crop", with_views(f"""select n.record_id, coalesce(start,0)::bigint crop_start_sample, least(coalesce(start,0)+{W},n)::bigint crop_end_sample,
 greatest({W}-n,0)::bigint padding_samples from (select record_id, count(*) n from sig group by all) n left join
 (select record_id, sample_index start from (select *, row_number() over (partition by record_id order by e desc, sample_index) rk from
  (select record_id, sample_index, sum(value*value) over f e, count(*) over f c from sig
   window f as (partition by record_id order by sample_index rows between current row and {W - 1} following)) where c={W}) where rk=1) s
 using (record_id)""", "sig"))
def max_energy_crop(spark: SparkSession, folder: str) -> DataFrame:
    """Earliest loudest frame of eight samples."""
    return signals.max_energy_crop(views.signal(spark, folder), W)


@query("right_pad_array", with_views("""select record_id, 80 padded, 50 cut, round(list_sum(features),6) padded_sum, round(list_sum(features[1:50]),6) cut_sum from embs""", "embs"))
def right_pad_array(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors filled up to 80 and cut to 50 elements."""
    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v), 6)
    rows = views.features(spark, folder).select("record_id", pad_right(F.col("features"), 80).alias("a"),
                                                pad_right(F.col("features"), 50).alias("b"))
    return rows.select("record_id", F.size("a").alias("padded"), F.size("b").alias("cut"),
                       total(F.col("a")).alias("padded_sum"), total(F.col("b")).alias("cut_sum"))


@query("channel_mean", with_views("select record_id, sample_index//2 sample_index, round(avg(value),6) \"value\" from sig group by all", "sig"))
def channel_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Even and odd samples as two channels mixed to one."""
    frames = views.signal(spark, folder).select(
        "record_id", F.expr("sample_index div 2").alias("sample_index"), (F.col("sample_index") % 2).alias("channel"), "value")
    return rounded(signals.channel_mean(frames), "value", digits=6)


@query("linear_resample", with_views("""select g.record_id, t sample_index, round(a.value+(pos-a.sample_index)*(coalesce(b.value,a.value)-a.value),9) "value" from
 (select record_id, t, t::double/m*n pos from (select record_id, count(*) n, round_even(count(*)*(3000.0::double/4000.0::double),0)::bigint m from sig group by all),
  lateral (select unnest(range(0,m)) t)) g
 join sig a on a.record_id=g.record_id and a.sample_index=floor(pos)::bigint
 left join sig b on b.record_id=g.record_id and b.sample_index=floor(pos)::bigint+1""", "sig"))
def linear_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Signals from rate 4000 to 3000."""
    return rounded(signals.linear_resample(views.signal(spark, folder), 4000, 3000), "value")


INDEXED = """select *, row_number() over (order by record_id, window_index)-1 gi from wins"""


@query("global_window_index", with_views(f"select record_id, window_index, gi global_window_index, gi//32 batch_id from ({INDEXED})", "wins"))
def global_window_index(spark: SparkSession, folder: str) -> DataFrame:
    """Running index over all windows in record order, and the batch of 32."""
    rows = views.windows(spark, folder).select("record_id", "window_index")
    return records.global_window_index(rows)


@query("batch_minmax_normalise", with_views(f"""select record_id, window_index, b batch_id, {', '.join(
    f'round((f{i}-lo)/(hi-lo),6) v{i}' for i in range(4))} from (select *, gi//32 b, min(least(f0,f1,f2,f3)) over (partition by gi//32) lo,
 max(greatest(f0,f1,f2,f3)) over (partition by gi//32) hi from ({INDEXED}))""", "wins"))
def batch_minmax_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Window vectors scaled by the bounds of their whole batch."""
    rows = records.global_window_index(views.windows(spark, folder).select("record_id", "window_index", "features"))
    scaled = signals.batch_minmax(rows, "batch_id", "features")
    return parts(scaled.select("record_id", "window_index", "batch_id", "features"), "features", 4)


@query("mean_pool", with_views(f"select record_id, {', '.join(f'round(avg(f{i}),6) v{i}' for i in range(4))} from wins group by all", "wins"))
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Mean window vector per record."""
    return parts(pooling.mean_pool(views.windows(spark, folder, indexed=False), views.WINDOW_DIM), "features", 4)


@query("min_length_mean_pool", with_views(f"""select record_id, count(*) filter (f0>=16) chunks_used, {', '.join(
    f'round(avg(f{i}) filter (f0>=16),6) v{i}' for i in range(4))} from wins group by all""", "wins"))
def min_length_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over chunks of at least 16 frames; null where a record has none."""
    rows = views.windows(spark, folder, indexed=False)
    return parts(pooling.min_length_mean_pool(rows, views.WINDOW_DIM, "frames", empty="null"), "features", 4)


SDP = ", ".join(f"round(max(case when dim={i} then v end),4) v{i}" for i in range(4))


@query("sdp_pool", with_views(f"select record_id, temperature, {SDP} from sdp where temperature=5 group by all", "sdp"))
def sdp_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Softmax-distance pooling at one temperature."""
    return parts(pooling.sdp_pool(views.windows(spark, folder), views.WINDOW_DIM, [5.0]), "features", 4, 4)


@query("sdp_pool_grid", with_views(f"select record_id, temperature, {SDP} from sdp group by all", "sdp"))
def sdp_pool_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Softmax-distance pooling at the seven temperatures, distances shared."""
    return parts(pooling.sdp_pool(views.windows(spark, folder), views.WINDOW_DIM, TEMPERATURES), "features", 4, 4)


@query("q75_pool", with_views(f"select record_id, {', '.join(f'round(quantile_cont(f{i},0.75),6) v{i}' for i in range(4))} from wins group by all", "wins"))
def q75_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension-wise upper quartile per record."""
    return parts(pooling.q75_pool(views.windows(spark, folder, indexed=False), views.WINDOW_DIM), "features", 4)


@query("grid_readout", with_views("""select record_id, """ + ", ".join(
    f"round(max(case when k={k} then m end),6) v{k}" for k in range(16)) + ", " + ", ".join(
    f"round(max(case when k={k} then s end),6) v{16 + k}" for k in range(16)) + """ from
 (select record_id, (dim//16)*4+dim%4 k, avg(x) m, stddev_pop(x) s from embl group by all) group by all""", "embl"))
def grid_query(spark: SparkSession, folder: str) -> DataFrame:
    """Means and deviations over the bands of a 4 x 4 x 4 token grid, inside each row."""
    rows = views.features(spark, folder).select("record_id", grid_readout(F.col("features"), 4, 4, 4).alias("features"))
    return parts(rows, "features", 32)


@query("standardise", with_views("""select record_id, round(sum(z),6) total, round(sum(z*z),5) squares from (select embl.record_id,
 (x-m)/case when s=0 then 1.0::double else s end z from embl join (select dim, avg(x) m, stddev_pop(x) s from embl where split='train' group by all) using (dim))
 group by all""", "embl"))
def standardise(spark: SparkSession, folder: str) -> DataFrame:
    """Features scaled by training means and population deviations."""
    rows = pooling.standardise(views.features(spark, folder), F.col("split") == "train", views.FEATURE_DIM)
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("record_id", F.round(total(F.col("features")), 6).alias("total"),
                       F.round(total(F.transform("features", lambda v: v * v)), 5).alias("squares"))
