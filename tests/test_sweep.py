"""Confusion cells of a grid of fusion weights against labels evaluated at every weight."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics, probabilities, sweep

CLASSES = ["a", "b", "c", "d"]
SCHEMA = "g string, y_true string, p_first array<double>, p_second array<double>"


def rows():
    rng = random.Random(4)
    out = [("g0", rng.choice(CLASSES), *([rng.random() for _ in CLASSES] for _ in "pq")) for _ in range(300)]
    eighths = [k / 8 for k in range(9)]  # ties at many weights, three lines through one point, equal lines
    out += [("g1", rng.choice(CLASSES), *([rng.choice(eighths) for _ in CLASSES] for _ in "pq")) for _ in range(600)]
    out += [(None, None, [0.3, 0.3 + 1e-16 * k, 0.1, 0.3], [0.3 + 5e-17, 0.3, 0.1, 0.3 - 6e-17 * k]) for k in range(5)]
    nan, inf = float("nan"), float("inf")
    out += [("g2", "a", p, q) for p, q in [([nan, 0.5, 0.1, 0.2], [0.1, 0.2, 0.6, 0.1]), ([inf, 0.0, 0.0, 0.0], [0.1, 0.2, 0.6, 0.1]), ([0.0] * 4, [0.0] * 4),
                                           ([1.0, 2.0, 3.0, -4.0], [4.0, 3.0, -2.0, 1.0]), ([None, 0.5, 0.1, 0.2], [0.1, 0.2, 0.6, 0.1])]]
    return out


@pytest.mark.parametrize("steps", [1, 20, 160])
def test_cells_equal_a_full_sweep(spark, steps):
    pairs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    tried = probabilities.alpha_sweep(pairs, ["g", "y_true"], CLASSES, probabilities.alpha_grid(steps))
    want = Counter({tuple(r): r.n for r in metrics.confusion_counts(tried, ["g", "alpha"]).collect()})
    got = Counter({tuple(r): r.n for r in sweep.sweep_counts(pairs, ["g"], CLASSES, steps).select("g", "alpha", "truth", "predicted", "n").collect()})
    assert got == want
    assert sweep.sweep_counts(pairs.limit(0), ["g"], CLASSES, steps).count() == 0


def test_few_weights_are_evaluated_and_few_changes_sent(spark):
    pairs = spark.createDataFrame(rows()[:300], SCHEMA)
    points = pairs.select(F.size(sweep.grid_points(F.col("p_first"), F.col("p_second"), 4, 1000)).alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert points[0] <= 1 + 3 * 3 and points[1] < 6  # at most three changes among four classes
    assert sweep.label_changes(pairs, ["y_true"], CLASSES, 1000).count() <= 300 * 7


def test_rows_without_values_have_no_label(spark):
    pairs = spark.createDataFrame([("g", "a", None, [0.1, 0.2, 0.6, 0.1]), ("g", "b", [0.1, 0.2, 0.6, 0.1], None)], SCHEMA)
    got = sweep.sweep_counts(pairs, ["g"], CLASSES, 2).collect()
    assert sorted((r.alpha, r.truth, r.predicted, r.n) for r in got) == [(a, t, None, 1) for a in (0.0, 0.5, 1.0) for t in "ab"]


def test_two_classes_by_hand(spark):
    pairs = spark.createDataFrame([("x", [1.0, 0.0], [0.0, 1.0])], "y_true string, p_first array<double>, p_second array<double>")
    got = sweep.sweep_counts(pairs, [], ["x", "y"], 4).select("alpha", "truth", "predicted", "n").collect()
    assert sorted(map(tuple, got)) == [(0.0, "x", "y", 1), (0.25, "x", "y", 1), (0.5, "x", "x", 1), (0.75, "x", "x", 1), (1.0, "x", "x", 1)]
