"""Scores, probabilities, selection and comparison on small literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.numbers import fixed_decimals
from cohortlens.functions.vectors import all_finite, argmax_label, fuse, pad_right
from cohortlens.operators import bootstrap as boot
from cohortlens.plans import tables as plans
from cohortlens.operators import checks, comparison, metrics, probabilities, selection, verify


def pairs(spark, truth, predicted):
    return spark.createDataFrame([("g", t, p) for t, p in zip(truth, predicted)], "g string, y_true string, y_pred string")


def official(spark, truth, predicted, sensitive):
    return metrics.official_score(pairs(spark, truth, predicted), ["g"], "Normal", sensitive).first()


@pytest.mark.parametrize("reject", ["Poor Quality", "Normal"])
def test_reject_class_leaves_the_denominators(spark, reject):
    row = official(spark, ["Normal", "Adventitious", "Poor Quality"], ["Normal", "Adventitious", reject], ["Adventitious"])
    assert [row[c] for c in ("SE", "SP", "AS", "HS", "Score")] == [1.0] * 5


def test_official_score_halves(spark):
    row = official(spark, ["Normal", "Normal", "A", "A"], ["Normal", "A", "A", "Normal"], ["A"])
    assert [row[c] for c in ("SE", "SP", "AS", "HS", "Score")] == [0.5] * 5
    row = official(spark, ["Normal", "Normal", "CAS", "DAS", "Poor"], ["Normal", "CAS", "CAS", "Normal", "Normal"], ["CAS", "DAS"])
    assert [row[c] for c in ("SE", "SP", "Score")] == [0.5] * 3


def test_wrong_sensitive_class_is_not_a_hit(spark):
    assert official(spark, ["Normal", "CAS"], ["Normal", "DAS"], ["CAS", "DAS"])["SE"] == 0.0


def test_empty_population(spark):
    with pytest.raises(Exception, match="no records to count"):
        official(spark, ["Normal"], ["Normal"], ["A"])
    row = metrics.official_score(pairs(spark, ["Normal"], ["Normal"]), ["g"], "Normal", ["A"], empty="nan").first()
    assert math.isnan(row["SE"]) and math.isnan(row["Score"])


def test_classification_metrics(spark):
    row = metrics.classification_metrics(pairs(spark, "NNAA", "NAAA"), ["g"], ["N", "A"]).first()
    assert row["balanced_accuracy"] == 0.75 and row["accuracy"] == 0.75 and row["record_count"] == 4
    assert row["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 2, abs=1e-12)


def test_three_balanced_accuracies(spark):
    rows = pairs(spark, "NNA", "NNA")
    values = {a: metrics.classification_metrics(rows, ["g"], ["N", "A", "B"], absent=a).first()["balanced_accuracy"]
              for a in ("zero", "skip", "nan")}
    assert values["zero"] == pytest.approx(2 / 3) and values["skip"] == 1.0 and math.isnan(values["nan"])


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="not among the declared classes"):
        metrics.classification_metrics(pairs(spark, "NX", "NN"), ["g"], ["N", "A"]).collect()


def test_confusion_is_dense(spark):
    cells = {(r.truth, r.predicted): r.n for r in metrics.confusion_matrix(pairs(spark, "NNA", "NAA"), ["g"], ["N", "A", "B"]).collect()}
    assert len(cells) == 9 and cells["N", "N"] == 1 and cells["N", "A"] == 1 and cells["A", "A"] == 1 and sum(cells.values()) == 3


def test_argmax_takes_the_first_tie(spark):
    row = spark.sql("select array('b','a','c') k, array(0.4D,0.4D,0.2D) p").select(argmax_label(F.col("k"), F.col("p")).alias("y")).first()
    assert row.y == "b"


@pytest.mark.parametrize("size", [None, 2])
def test_fusion(spark, size):
    df = spark.sql("select array(.8D,.2D) a, array(.2D,.8D) b")
    got = df.select(fuse(F.col("a"), F.col("b"), 0.75, size).alias("f")).first().f
    assert got == pytest.approx([0.75 * 0.8 + 0.25 * 0.2, 0.75 * 0.2 + 0.25 * 0.8])
    with pytest.raises(ValueError):
        fuse(F.col("a"), F.col("b"), 1.5)


def test_padding_and_finiteness(spark):
    df = spark.sql("select array(1D,2D,3D) a, array(1D,double('nan')) b, array(double('inf')) c")
    row = df.select(pad_right(F.col("a"), 5).alias("long"), pad_right(F.col("a"), 2).alias("short"),
                    *[all_finite(F.col(c)).alias(c) for c in "abc"]).first()
    assert row.long == [1, 2, 3, 0, 0] and row.short == [1, 2] and (row.a, row.b, row.c) == (True, False, False)


def test_class_order(spark):
    rows = spark.sql("""select array('b','a') class_order, array(0.3D,0.7D) probabilities""")
    assert probabilities.reconcile(rows, ["a", "b"]).first().probabilities == [0.7, 0.3]
    with pytest.raises(Exception, match="missing class"):
        probabilities.reconcile(rows, ["a", "z"]).collect()


def test_json_round_trip_and_errors(spark):
    rows = spark.sql("""select '["a","b"]' class_order, '[0.25, 0.75]' probabilities, 'b' y_pred""")
    assert probabilities.predict(probabilities.decode(rows), stored="y_pred").first().y_pred == "b"
    with pytest.raises(Exception, match="not the most probable class"):
        probabilities.predict(probabilities.decode(rows.withColumn("y_pred", F.lit("a"))), stored="y_pred").collect()
    with pytest.raises(Exception, match="as many probabilities as classes"):
        probabilities.decode(rows.withColumn("probabilities", F.lit("[1.0]"))).collect()


def test_alpha_tie_goes_to_the_smaller(spark):
    rows = spark.createDataFrame([(a, 0.8, 0.7) for a in (0.6, 0.4, 0.9)] + [(0.1, 0.7, 0.9)], "alpha double, balanced_accuracy double, macro_f1 double")
    assert selection.rank_alphas(rows, []).filter("selected").first().alpha == 0.4
    assert probabilities.alpha_grid() == [round(0.05 * i, 10) for i in range(21)]


def test_branches_must_cover_the_same_records(spark):
    def branch(rows):
        return spark.createDataFrame([(k, t, [0.5, 0.5]) for k, t in rows], "record_id int, y string, probabilities array<double>")
    full = branch([(1, "a"), (2, "b")])
    assert probabilities.aligned_pairs(full, full, "y").count() == 2
    for other in ([(1, "a")], [(1, "a"), (2, "a")]):
        with pytest.raises(Exception, match="the two readouts differ in records or in truth"):
            probabilities.aligned_pairs(full, branch(other), "y").collect()


def incumbent(spark, changes):
    scores = {t: 0.5 for t in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)} | changes
    rows = spark.createDataFrame([("t", t, s) for t, s in scores.items()], "task string, temperature double, mean_score double")
    return selection.incumbent(rows, ["task"], "temperature").first().selected


def test_incumbent_needs_more_than_the_margin(spark):
    assert incumbent(spark, {2.0: 0.5001, 5.0: 0.50010000001}) == 5.0
    assert incumbent(spark, {2.0: 0.5001, 5.0: 0.50010000001, 10.0: 0.5002001}) == 10.0
    assert incumbent(spark, {}) == 1.0


def test_equal_scores_share_the_better_place(spark):
    fresh = spark.createDataFrame([("e", "t", "m", 0.5), ("e", "u", "m", 0.5)], "evaluation string, task string, method string, score double")
    board = spark.createDataFrame([("e", "t", s) for s in (0.6, 0.5, 0.4)], "evaluation string, task string, score double")
    rows = comparison.insertion_rank(fresh, board, ["evaluation", "task"]).collect()
    assert {r.task: (r.estimated_position, r.comparison_set_size) for r in rows} == {"t": (2, 4), "u": (1, 1)}


def test_places_with_missing_scores(spark):
    nan = float("nan")
    fresh = spark.createDataFrame([("e", "m", 0.5), ("e", "n", None), ("e", "o", nan)], "e string, method string, score double")
    board = spark.createDataFrame([("e", "t", s) for s in (0.6, None, nan, 0.4, 0.6)], "e string, t string, score double")
    for tables in ([], ["t"]):
        rows = comparison.insertion_rank(fresh, board, ["e"], tables=tables).collect()
        assert {r.method: (r.estimated_position, r.comparison_set_size) for r in rows} == {"m": (3, 4), "n": (None, 4), "o": (None, 4)}


def test_places_match_counting(spark):
    fresh = spark.createDataFrame([(e, f"m{i}", i * 37 % 11 / 10) for e in "ab" for i in range(40)], "e string, method string, score double")
    board = spark.createDataFrame([(e, t, i * 13 % 23 / 20) for e in "ab" for t in "xyz" for i in range(30)], "e string, t string, score double")
    got = {(r.e, r.t, r.method): r.estimated_position for r in comparison.insertion_rank(fresh, board, ["e"], tables=["t"]).collect()}
    listed = [(r.e, r.t, r.score) for r in board.collect()]
    assert got == {(f.e, t, f.method): 1 + sum(e == f.e and u == t and s > f.score for e, u, s in listed) for f in fresh.collect() for t in "xyz"}


def test_display_rounds_the_exact_binary_value(spark):
    values = [0.125, 2.675, 5e-05, 0.03125, 0.015, 1.005, -0.03125, 0.99995, 0.0, 12.34565, 1 / 3, 99.99995, -1e-9, 0.5, 1.5]
    values += [i / 32 for i in range(64)] + [i / 1000 + 0.0005 for i in range(200)] + [(i * 7919 % 10007) / 10007 for i in range(300)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for decimals in (1, 2, 4):
        got = [r[0] for r in df.select(fixed_decimals(F.col("v"), decimals)).collect()]
        assert got == [format(v, f".{decimals}f") for v in values]


def test_display_of_huge_and_missing_values(spark):
    values = [1e15, 1e19, -1e19, 123456789012345.6, 2.0 ** 53 + 2, 900719925474.5, 900719925474.09375, -900719925475.99999, 2.0 ** 70, 1e30, 99999999999.99999, 0.0]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("inf"), -float("inf"), float("nan")]], "v double")
    for decimals in (1, 4):
        got = [r[0] for r in df.select(fixed_decimals(F.col("v"), decimals)).collect()]
        assert got == [format(v, f".{decimals}f") for v in values] + [None, "inf", "-inf", "nan"]


def test_interval_is_nan_when_a_replicate_is(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", float("nan")), ("b", 1.0)], "k string, value double")
    got = {r.k: r for r in boot.percentile_interval(rows, ["k"]).collect()}
    assert (got["a"].ci_lower, got["a"].ci_upper) == pytest.approx((0.1, 3.9)) and math.isnan(got["b"].ci_lower)


def test_resampling_counts_multiplicity_on_both_join_paths(spark):
    cells = spark.createDataFrame([("t", "m", 0, "N", "N", 2), ("t", "m", 0, "A", "N", 1), ("t", "m", 1, "A", "A", 3)],
                                  "task string, method string, patient_index long, truth string, predicted string, n long")
    drawn = spark.createDataFrame([("t", 0, 0, 0), ("t", 0, 1, 0), ("t", 1, 0, 0), ("t", 1, 1, 1)], "task string, draw long, slot long, patient_index long")
    want = [(0, "A", "A", 0), (0, "A", "N", 2), (0, "N", "N", 4), (1, "A", "A", 3), (1, "A", "N", 1), (1, "N", "N", 2)]
    for bound in (1000, 0):
        rows = boot.resampled_confusions(cells, drawn, 2, broadcast_cells=bound).collect()
        assert sorted((r.draw, r.truth, r.predicted, r.n) for r in rows) == want


def test_draws_are_never_the_broadcast_side(spark):
    cells = spark.createDataFrame([("t", "m", i, "N", "N", 1) for i in range(50)],
                                  "task string, method string, patient_index long, truth string, predicted string, n long")
    plan = boot.resampled_confusions(cells, boot.draws(spark, {"t": 50}, 2000), 2000)._jdf.queryExecution().executedPlan().toString()
    assert "Inner, BuildRight" in plan and "BuildLeft" not in plan


def test_every_task_draws_its_own_patients_and_absent_methods_are_nan(spark):
    rows = [("A", m, f"p{i}", "N", "N") for i in range(2) for m in ("x", "y")] + [("B", "x", f"p{i}", "N", "N") for i in range(20)] + [("B", "y", "p0", "N", "N")]
    df = spark.createDataFrame(rows, "task string, method string, group_id string, y_true string, y_pred string")
    drawn = plans.resample(df, 60).drawn
    sizes = {(r.task, r.method, r.draw): r.n for r in drawn.groupBy("task", "method", "draw").agg(F.sum("n").alias("n")).collect()}
    assert len(sizes) == 4 * 60 and all(n == 2 for (t, _, _), n in sizes.items() if t == "A")
    assert all(n == 20 for (t, m, _), n in sizes.items() if (t, m) == ("B", "x")) and 0 in {n for (t, m, _), n in sizes.items() if (t, m) == ("B", "y")}
    reps = {(r.task, r.method, r.draw): r.accuracy for r in boot.classification_replicates(drawn, ["task", "method"], {"A": ["N"], "B": ["N"]}).collect()}
    assert len(reps) == 240 and all(math.isnan(v) == (sizes[k] == 0) for k, v in reps.items())


def test_table_diff(spark):
    a = spark.createDataFrame([("x", 0.12341, "t"), ("y", 1.0, "t"), ("w", 1.0, "t")], "k string, v double, s string")
    e = spark.createDataFrame([("x", 0.12342, "t"), ("y", 1.0 + 1e-13, "u"), ("z", 1.0, "t")], "k string, v double, s string")
    got = {(r.k, r.field): (r.state, r.numeric_ok, r.display_ok) for r in verify.table_diff(a, e, ["k"], ["v"], ["s"]).collect()}
    assert got["x", "v"] == ("both", False, True) and got["y", "v"] == ("both", True, True)
    assert got["y", "s"] == ("both", False, False) and got["w", "v"][0] == "extra" and got["z", "v"][0] == "missing"


def test_fingerprint_ignores_order_only(spark):
    def mark(rows):
        return verify.table_fingerprint(spark.createDataFrame(rows, "a int, b string"), ["a", "b"]).first()
    assert mark([(1, "x"), (2, None)]) == mark([(2, None), (1, "x")])
    assert mark([(1, "x"), (2, None)]) != mark([(1, "x"), (2, "")])
    assert mark([(1, "n")]) != mark([(1, None)])

    def pair(a, b):
        return verify.table_fingerprint(spark.createDataFrame([(a, b)], "a string, b string"), ["a", "b"]).first()
    assert pair("a|b", "c") != pair("a", "b|c") and pair("1v1:", "") != pair("1", "v1:")


def test_run_difference_sees_rows_of_one_side(spark):
    def run(rows):
        return spark.createDataFrame(rows, "k int, v array<double>")
    one = checks.max_abs_diff(run([(1, [1.0]), (2, [2.0])]), run([(1, [1.0])]), ["k"], "v").first()
    assert (one.rows, one.only_left, one.only_right, one.max_abs_diff, one.exact) == (1, 1, 0, 0.0, False)
    assert checks.max_abs_diff(run([(1, [1.0, 2.0])]), run([(1, [1.0])]), ["k"], "v").first().max_abs_diff == math.inf
    same = checks.max_abs_diff(run([(1, [1.0])]), run([(1, [1.0])]), ["k"], "v").first()
    assert same.exact and same.max_abs_diff == 0.0


def test_checks(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, -1), (3, 1)], "group_id int, fold_id int")
    assert [r.group_id for r in checks.fold_leakage(rows).collect()] == [1]
    left, right = spark.range(0, 4).union(spark.range(0, 4)).toDF("k"), spark.range(1, 5).toDF("k")
    assert sorted((r.k, r.state) for r in checks.universe_difference(left, right, "k").collect()) == [(0, "missing"), (4, "unexpected")]
