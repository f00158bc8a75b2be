"""Readers and writers over small files."""

import gzip
from pathlib import Path
import json

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import checks, records, verify
from cohortlens.sources import sinks, tables


def test_gzip_csv_is_read_as_text_and_cast(spark, tmp_path):
    with gzip.open(tmp_path / "r.csv.gz", "wt") as out:
        out.write("record_id,fold\n007,1\n008,-1\n")
    rows = tables.read_csv(spark, str(tmp_path), {"record_id": "string", "fold": "int"}).orderBy("record_id").collect()
    assert [(r.record_id, r.fold) for r in rows] == [("007", 1), ("008", -1)]


def test_indented_and_split_payloads(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"label": "tab:x", "rows": [{"k": "a", "v": 0.5}, {"k": "b", "v": 1.0}]}, indent=2))
    got = tables.read_payload(spark, str(tmp_path / "t.json"), "k:string, v:double", multi_line=True).collect()
    assert sorted((r.label, r.k, r.v) for r in got) == [("tab:x", "a", 0.5), ("tab:x", "b", 1.0)]
    sinks.write_payload(spark.range(25).toDF("k"), str(tmp_path / "p"), "tab:y", rows_per_document=10)
    back = tables.read_payload(spark, str(tmp_path / "p"), "k:bigint")
    assert sorted(r.k for r in back.collect()) == list(range(25))


def test_feature_dimension_is_enforced(spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.write_features(spark.sql("select 'd' dataset, array(1D,2D) features"), path)
    assert tables.read_features(spark, path, 2).count() == 1
    with pytest.raises(Exception, match="feature dimension is not 3"):
        tables.read_features(spark, path, 3).collect()


def test_inventory_finds_duplicates_without_reading(spark, tmp_path):
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.wav").write_bytes(b"123")
    (tmp_path / "a" / "y.wav").write_bytes(b"1")
    (tmp_path / "a" / "z.txt").write_bytes(b"1")
    files = tables.file_inventory(spark, str(tmp_path), ".wav")
    assert sorted((r.stem, r.length, r.folder) for r in files.collect()) == [("x", 3, "a"), ("x", 3, "c"), ("y", 1, "a")]
    assert [(r.stem, r.files) for r in tables.duplicate_files(files).collect()] == [("x", 2)]


def test_ordered_csv_and_draw_pieces(spark, tmp_path):
    df = spark.range(50).select((F.lit(49) - F.col("id")).alias("k"))
    sinks.write_csv_gz(df, str(tmp_path / "c"), ["k"])
    lines = [line for p in sorted((tmp_path / "c").glob("*.csv.gz")) for line in gzip.open(p, "rt").read().split()[1:]]
    assert lines == [str(i) for i in range(50)]
    drawn = spark.range(60).select(F.lit("t").alias("task"), (F.col("id") % 3).alias("draw"), F.expr("id div 3").alias("slot"), (F.col("id") * 7 % 20).alias("patient_index"))
    sinks.write_draws(drawn, str(tmp_path / "d"), piece=8)
    key = ["task", "draw", "slot", "patient_index"]
    assert sorted(map(tuple, tables.read_draws(spark, str(tmp_path / "d")).select(*key).collect())) == sorted(map(tuple, drawn.collect()))


def test_scratch_tables(spark, tmp_path):
    from cohortlens.session import clear_scratch, stored
    df = spark.range(0, 400, 1, 12).select((F.col("id") % 3).alias("k"), "id")
    kept = stored(df, "test", ["k"], files=2)
    assert kept.filter("k = 1").count() == 133 and len(kept.inputFiles()) <= 6
    assert stored(df.limit(0), "test", ["k"]).count() == 0
    place = kept.inputFiles()[0].split("/k=")[0].removeprefix("file:").replace("///", "/")
    assert Path(place).is_dir() and clear_scratch(spark) >= 2 and not Path(place).exists()


def test_bundle_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "k string, v double")
    row = sinks.write_bundle({"tab:t:one": df}, str(tmp_path), {"tab:t:one": ["k"]}).first()
    assert (row.label, row.columns, row.rows) == ("tab:t:one", "k,v", 2)
    assert (tmp_path / "machine_readable" / "t_one").is_dir() and (tmp_path / "tables" / "t_one").is_dir()
    direct = verify.table_fingerprint(df, ["k", "v"]).first()
    assert row.h0 == direct.h0 and row.h3 == direct.h3
    assert (row.json_files, row.csv_files, row.total_tables, row.total_rows, row.total_files) == (1, 1, 1, 2, 2)


def test_payload_of_equal_rows_and_of_none(spark, tmp_path):
    df = spark.range(0, 5000, 1, 3).select(F.lit(7).alias("v"))
    sinks.write_payload(df, str(tmp_path / "p"), "tab:x", rows_per_document=1000)
    sizes = [r[0] for r in spark.read.json(str(tmp_path / "p")).select(F.size("rows")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1000
    sinks.write_payload(df.limit(0), str(tmp_path / "e"), "tab:x")
    assert spark.read.schema("label string, rows array<struct<v:int>>").json(str(tmp_path / "e")).select("label", F.size("rows")).collect() == [("tab:x", 0)]


def test_official_split_and_exclusions(spark):
    rows = spark.createDataFrame([(1, "g1", "train2022", "included", None), (2, "g1", "test2022", "included", None),
                                  (3, "g2", "test2022", "excluded", "poor"), (4, "g1", "test2023", "excluded", "copy")],
                                 "record_id int, group_id string, split string, inclusion_status string, exclusion_reason string")
    got = {r.record_id: r.official_split for r in records.official_split(rows, "train2022", "test2022").collect()}
    assert got == {1: "train2022", 2: "test_intra", 3: "test_inter", 4: "test2023"}
    assert {r.exclusion_reason: r.records for r in records.exclusion_accounting(rows).collect()} == {"poor": 1, "copy": 1, "total": 2}


def test_cache_and_alignment(spark):
    old = spark.sql("select 'm1' model, 10 windows")
    assert {r.field: r.ok for r in verify.cache_valid(old, spark.sql("select 'm1' model, 11 windows")).collect()} == {"model": True, "windows": False}
    known, windows = spark.range(2).toDF("record_id"), spark.sql("select 1L record_id union all select 5L")
    got = {r.record_id: (r.windows, r.state) for r in checks.window_alignment(known, windows).collect()}
    assert got == {0: (0, "no windows"), 1: (1, "ok"), 5: (1, "unknown record")}
