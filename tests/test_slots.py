"""Draws by digests of many slots at once against hashlib, and what is counted from them against the slot table."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import resampling
from cohortlens.operators import bootstrap as boot
from cohortlens.operators import slots
from cohortlens.sources import sinks, tables
from tests.conftest import SMALL


def filled(task, draw, slot, patients):
    return int(hashlib.md5(f"boot:{task}:{draw}:{slot}".encode()).hexdigest()[:15], 16) % patients


@pytest.mark.parametrize("task", ["T2-1", "", "x" * 47, "é" * 40])
@pytest.mark.parametrize("first, last", [(0, 12), (95, 1005), (99_990, 100_030), (199_999, 200_003), (99_999_998, 100_000_002)])
def test_digests(task, first, last):
    got = np.concatenate(list(slots.drawn_patients(task, 7, first, last, 977)))
    assert got.tolist() == [filled(task, 7, i, 977) for i in range(first, last)]


@pytest.mark.parametrize("size", [1, 2, 5, 100, 32_768])
def test_packed_counts(size):
    rng = np.random.default_rng(size)
    for places in (np.array([], int), np.zeros(40, int), rng.integers(0, size, size), rng.integers(0, size, 3)):
        dense, payload = slots.pack_block(places, size)
        assert slots.unpack_block(dense, payload, size).tolist() == np.bincount(places, minlength=size).tolist()
        assert len(payload) <= max(2 * len(places), size // 2 + 1)


def test_stored_pieces_are_written_without_a_shuffle(spark, tmp_path):
    made = slots.pieces(spark, {"a": 2500, "b": 3}, 3, piece=1000)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    sinks.write_draw_pieces(made, str(tmp_path / "d"))
    got = Counter(map(tuple, tables.read_draws(spark, str(tmp_path / "d")).select("task", "draw", "slot", "patient_index").collect()))
    assert got == Counter((t, d, s, filled(t, d, s, n)) for t, n in (("a", 2500), ("b", 3)) for d in range(3) for s in range(n))


@pytest.mark.parametrize("block, span, together", [(32_768, 1 << 23, 1000), (16, 50, 3), (7, 1000, 2), (1, 3, 5)])
def test_counts_per_block_give_the_cells_of_the_slot_table(spark, block, span, together):
    rng = np.random.default_rng(3)
    rows = [(t, m, p, "AB"[rng.integers(2)], c, int(rng.integers(1, 9))) for t, n in (("a", 61), ("b", 2)) for m in "xy" for p in range(n)
            for c in "AB" if rng.random() < 0.6]
    rows = list({r[:5]: r for r in rows}.values()) + [("a", "z", 60, "A", "A", 1)]
    cells = spark.createDataFrame(rows, "task string, method string, patient_index long, truth string, predicted string, n long")
    patients = {"a": 61, "b": 2}
    want = boot.resampled_confusions(cells, boot.draws(spark, patients, 8), 8)
    got = slots.resampled_confusions(cells, patients, 8, block=block, span=span, together=together)
    key = ["draw", "task", "method", "truth", "predicted", "n"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_a_slot_travels_in_half_a_byte(spark):
    drawn = slots.block_counts(spark, {"a": 100_000}, 20)
    assert drawn.agg(F.sum(F.length("payload"))).first()[0] < 0.51 * 100_000 * 20


def test_slots_of_neighbouring_rows_repeat_so_that_files_hold_them_in_few_bits(spark, tmp_path):
    boot.draws(spark, {"a": 30_000}, 100).write.parquet(str(tmp_path / "d"))
    size = Counter()
    for file in (tmp_path / "d").glob("*.parquet"):
        held = pq.ParquetFile(file).metadata
        for group in map(held.row_group, range(held.num_row_groups)):
            size.update({c.path_in_schema: c.total_compressed_size for c in map(group.column, range(group.num_columns))})
    assert size["slot"] < 0.5 * 30_000 * 100


def test_draws_need_no_stored_table(spark, monkeypatch):
    monkeypatch.setattr(resampling.plans, "stored", None)
    assert resampling.bootstrap_draws(spark, SMALL).select("task").distinct().count() == 2
