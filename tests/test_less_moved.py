"""Windows are moved once, and only those that are needed."""

from pyspark.sql import functions as F

from cohortlens import views
from cohortlens.catalog import models
from cohortlens.operators.cells import class_means
from cohortlens.operators.indexing import running_before
from cohortlens.operators.pooling import sdp_pool
from cohortlens.session import stored
from tests.conftest import SMALL


def test_pooling_shuffles_the_windows_once(spark):
    pooled = sdp_pool(stored(views.windows(spark, SMALL), "windows"), views.WINDOW_DIM, [1.0, 2.0])
    pooled.collect()
    plan = pooled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("REPARTITION_BY_COL" in line and "Reused" not in line for line in plan.splitlines()) == 1


def test_only_windows_of_training_records_are_pooled(spark, monkeypatch):
    given = []

    def watched(windows, dim, temperatures):
        given.append({r.record_id for r in windows.select("record_id").distinct().collect()})
        return sdp_pool(windows, dim, temperatures)

    monkeypatch.setattr(models, "sdp_pool", watched)
    models.temperature_table(spark, SMALL, class_means)
    train = {r.record_id for r in views.records(spark, SMALL).filter("split = 'train2022'").collect()}
    assert given[0] and given[0] <= train


def test_numbering_keeps_the_columns_asked_for(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") * 7 % 40).alias("o"))
    whole = {(r.k, r.id): r.at for r in running_before(rows, [F.col("o")], "at", keys=["k"], partitions=5).collect()}
    assert sorted(whole.values()) == sorted([*range(14), *range(13), *range(13)])
    slim = running_before(rows, [F.col("o")], "at", keys=["k"], partitions=5, keep=["id"])
    assert slim.columns == ["id", "at"] and {r.id: r.at for r in slim.collect()} == {i: at for (_, i), at in whole.items()}
