"""Bootstrap by patient counts: exact totals, the multinomial distribution, and the slot table's sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import multinomial as m


def counts(draw, patients, size, task="t", seed=0):
    return np.concatenate([m.block_counts(task, draw, b, patients, size, seed) for b in range(-(-patients // size))])


@pytest.mark.parametrize("patients, size", [(1, 4), (4, 4), (5, 4), (37, 4), (100, 7), (64, 1000)])
def test_every_draw_has_all_slots(patients, size):
    for draw in range(50):
        c = counts(draw, patients, size)
        assert len(c) == patients and c.sum() == patients


def test_same_key_same_counts_and_other_keys_differ():
    assert (counts(3, 60, 8) == counts(3, 60, 8)).all()
    others = [counts(4, 60, 8), counts(3, 60, 8, task="u"), counts(3, 60, 8, seed=1)]
    assert all((counts(3, 60, 8) != c).any() for c in others)


@pytest.mark.parametrize("size", [3, 8, 1000])
def test_distribution(size):
    """Totals per patient, and how often a patient is drawn k times, are those of a multinomial (chi-square, 5 deviations)."""
    patients, draws = 29, 4000
    c = np.stack([counts(d, patients, size) for d in range(draws)])
    chi = ((c.sum(0) - draws) ** 2 / draws).sum() * patients / (patients - 1) if patients > 1 else 0
    assert abs(chi - (patients - 1)) < 5 * np.sqrt(2 * (patients - 1))
    assert np.allclose(c.var(0).mean(), 1 - 1 / patients, rtol=0.03)
    p = [1.0]
    for k in range(4):  # binomial(29, 1/29)
        p.append(p[-1] * (patients - k) / (k + 1) / (patients - 1))
    p = np.array(p[:4]) * (1 - 1 / patients) ** patients
    seen = np.array([(c == k).mean() for k in range(4)])
    assert np.abs(seen - p).max() < 5 * np.sqrt(0.25 / draws / patients) * 2
    covariance = np.cov(c.T)
    off = covariance[~np.eye(patients, dtype=bool)]
    assert abs(off.mean() + 1 / patients) < 0.002


def test_sums_of_cells(spark):
    rng = np.random.default_rng(0)
    rows = [(t, method, p, str(rng.integers(3)), str(rng.integers(3)), int(rng.integers(1, 5)))
            for t, n in (("a", 23), ("b", 5)) for method in "xy" for p in range(n) for _ in range(2)]
    cells = spark.createDataFrame(rows, "task string, method string, patient_index long, truth string, predicted string, n long")
    cells = cells.groupBy("task", "method", "patient_index", "truth", "predicted").agg(F.sum("n").alias("n"))
    got = {(r.draw, r.task, r.method, r.truth, r.predicted): r.n for r in m.resampled_confusions(cells, {"a": 23, "b": 5}, 300, size=6).collect()}
    want = {}
    times = {t: np.stack([counts(d, n, 6, task=t) for d in range(300)]) for t, n in (("a", 23), ("b", 5))}
    for r in cells.collect():
        for d in range(300):
            key = (d, r.task, r.method, r.truth, r.predicted)
            want[key] = want.get(key, 0) + int(times[r.task][d, r.patient_index]) * r.n
    assert got == want and 0 in want.values()
    assert m.resampled_confusions(cells.limit(0), {}, 10).collect() == []


def test_protocol_query(spark):
    """The intervals at 10,000 draws hold the points and are near those of 1,000 slot-table draws."""
    import __spark_entry__ as entry
    from tests.conftest import SMALL
    rows = {(r.task, r.method, r.metric): r for r in entry.queries()["bootstrap_protocol"](spark, SMALL).collect()}
    assert {r.replicates for r in rows.values()} == {10_000}
    for r in entry.queries()["bootstrap_tables"](spark, SMALL).collect():
        own = rows[r.task, r.method, r.metric]
        width = r.ci_upper - r.ci_lower
        assert own.point_estimate == r.point_estimate and own.ci_lower <= own.point_estimate <= own.ci_upper
        assert abs(own.ci_lower - r.ci_lower) < 0.25 * width and abs(own.ci_upper - r.ci_upper) < 0.25 * width


def test_splits_of_a_run_of_blocks_are_made_once(monkeypatch):
    made, random = [], m._random
    monkeypatch.setattr(m, "_random", lambda *key: made.append(key) or random(*key))
    got = m.run_slots("t", 7, 48, 80, 1000, 4)
    assert len(made) == len(set(made)) <= 32 + 2 * 8
    assert got == [m.block_slots("t", 7, b, 1000, 4) for b in range(48, 80)]


@pytest.mark.parametrize("run, together", [(1, 7), (3, 40), (100, 16)])
def test_sums_do_not_depend_on_the_groups(spark, run, together):
    """One sum per draw, cell and run of blocks leaves a task; a count above 2^24 is exact."""
    rows = [("a", "x", p, "AB"[p % 2], "A", 1 + p * 10_000_001) for p in range(23)] + [("b", "y", 0, "A", "B", 3)]
    cells = spark.createDataFrame(rows, "task string, method string, patient_index long, truth string, predicted string, n long")
    got = {(r.draw, r.task, r.truth): r.n for r in m.resampled_confusions(cells, {"a": 23, "b": 1}, 40, size=4, run=run, together=together).collect()}
    want = {(d, "b", "A"): 3 for d in range(40)}
    for d in range(40):
        c = counts(d, 23, 4, task="a")
        want |= {(d, "a", "AB"[k]): sum(int(c[p]) * (1 + p * 10_000_001) for p in range(k, 23, 2)) for k in (0, 1)}
    assert got == want
