"""Windows, crops, resampling, pooling, positions and fits against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.vectors import grid_readout
from cohortlens.operators import bootstrap, fitting, pooling, records, signals
from cohortlens.operators.indexing import running_before, sorted_position
from cohortlens.operators.quantiles import counted_quantile


def samples(spark, *signals_):
    rows = [(r, i, float(v)) for r, values in enumerate(signals_) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "record_id long, sample_index long, value double")


def ones(spark, n):
    return spark.range(n).select(F.lit(0).cast("long").alias("record_id"), F.col("id").alias("sample_index"), F.lit(1.0).alias("value"))


@pytest.mark.parametrize("length, valid", [(32000, [32000]), (64000, [32000] * 2), (32001, [32000, 1]), (70000, [32000, 32000, 6000])])
def test_record_windows(spark, length, valid):
    got = signals.record_windows(ones(spark, length), 32000).orderBy("window_index").collect()
    assert [r.valid_samples for r in got] == valid and [r.right_padding_samples for r in got] == [32000 - v for v in valid]
    assert got[-1].window_mean == pytest.approx(valid[-1] / 32000)


def test_a_record_without_samples_has_one_empty_window(spark):
    got = signals.record_windows(ones(spark, 3), 4, spark.range(2).toDF("record_id")).orderBy("record_id").collect()
    assert [(r.record_id, r.valid_samples, r.right_padding_samples) for r in got] == [(0, 3, 1), (1, 0, 4)]


def test_fixed_windows(spark):
    got = signals.fixed_windows(ones(spark, 240000), 32000, 8).orderBy("window_index").collect()
    assert [r.valid_samples for r in got] == [32000] * 7 + [16000] and got[-1].window_mean == 0.5


def test_crop_takes_the_earliest(spark):
    assert signals.max_energy_crop(ones(spark, 32002), 32000).first().crop_start_sample == 0
    quiet = [0.0] * 4000
    for start in (10, 700):
        quiet[start:start + 20] = [1.0] * 20
    assert signals.max_energy_crop(samples(spark, quiet), 100).first().crop_start_sample == 0
    short = signals.max_energy_crop(samples(spark, [1, 2, 3]), 8).first()
    assert (short.crop_start_sample, short.crop_end_sample, short.padding_samples) == (0, 3, 5)


@pytest.mark.parametrize("size, chunk", [(8, 8), (8, 13), (8, None), (70, 70), (70, 101), (70, None)])
def test_crop_over_chunks_is_brute_force(spark, size, chunk):
    rng = np.random.default_rng(1)
    data = [rng.integers(-9, 9, n).astype(float) for n in (5, 8, 70, 71, 200, 333)]
    got = {r.record_id: r for r in signals.max_energy_crop(samples(spark, *data), size, chunk).collect()}
    for k, x in enumerate(data):
        energy = [float((x[i:i + size] ** 2).sum()) for i in range(len(x) - size + 1)]
        assert got[k].crop_start_sample == (int(np.argmax(energy)) if energy else 0)
        assert got[k].padding_samples == max(0, size - len(x))


@pytest.mark.parametrize("size, chunk", [(8, 8), (8, 13), (8, None), (73, 100)])
def test_equal_frames_tie_exactly(spark, size, chunk):
    rng = np.random.default_rng(2)
    data = [np.concatenate([rng.integers(1, 40_000, 40) / 100, *[np.repeat(v, 3 * size) for v in rng.integers(40_000, 60_000, 3) / 100], [600.01] * 3 * size, [0.07] * 90])
            for _ in range(12)]
    got = {r.record_id: r.crop_start_sample for r in signals.max_energy_crop(samples(spark, *data), size, chunk).collect()}
    assert got == {k: 40 + 9 * size for k in range(len(data))}


@pytest.mark.parametrize("source, target", [(4000, 3000), (3000, 4000), (7, 5), (8000, 16000)])
def test_linear_resample(spark, source, target):
    rng = np.random.default_rng(2)
    data = [rng.normal(size=n) for n in (1, 2, 37, 100)]
    got = {}
    for r in signals.linear_resample(samples(spark, *data), source, target).collect():
        got.setdefault(r.record_id, {})[r.sample_index] = r.value
    for k, x in enumerate(data):
        m = int(round(len(x) * float(target) / float(source)))
        want = np.interp(np.linspace(0, 1, m, endpoint=False), np.linspace(0, 1, len(x), endpoint=False), x) if m else []
        assert [got.get(k, {})[i] for i in range(m)] == pytest.approx(list(want), abs=1e-9) and len(got.get(k, {})) == m


def test_channel_mean_and_batch_scaling(spark):
    two = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 3.0)], "record_id long, sample_index long, channel int, value double")
    assert signals.channel_mean(two).first().value == 2.0
    rows = spark.createDataFrame([(0, [1.0, 3.0]), (0, [2.0, 5.0]), (1, [4.0, 4.0])], "b int, v array<double>")
    got = sorted((r.b, r.v) for r in signals.batch_minmax(rows, "b", "v").collect())
    assert got == [(0, [0.0, 0.5]), (0, [0.25, 1.0]), (1, [0.0, 0.0])]


def test_grid_readout(spark):
    values = np.arange(96 * 1024, dtype=float)
    df = spark.range(96 * 1024).agg(F.array_sort(F.array_agg(F.col("id").cast("double"))).alias("v"))
    got = df.select(grid_readout(F.col("v"), 12, 8, 1024).alias("g")).first().g
    grid = values.reshape(12, 8, 1024)
    assert np.allclose(got, np.concatenate([grid.mean(axis=1).ravel(), grid.std(axis=1).ravel()]), atol=1e-9)


def vectors(spark, groups):
    rows = [(k, i, [float(v) for v in row]) for k, m in enumerate(groups) for i, row in enumerate(m)]
    return spark.createDataFrame(rows, "record_id long, window_index long, features array<double>")


@pytest.mark.parametrize("dim", [2, 20])
def test_pools_match_numpy(spark, dim):
    rng = np.random.default_rng(3)
    groups = [rng.normal(size=(n, dim)) * 3 for n in (1, 2, 7, 40)]
    df = vectors(spark, groups)
    mean = {r.record_id: r.features for r in pooling.mean_pool(df, dim).collect()}
    sdp = {(r.record_id, r.temperature): r.features for r in pooling.sdp_pool(df, dim, [1.0, 50.0], chunk=3).collect()}
    plain = {r.record_id: r.features for r in pooling.q75_pool(df, dim).collect()}
    counted = {r.record_id: r.features for r in pooling.q75_pool(df, dim, hot_rows=2).collect()}
    for k, m in enumerate(groups):
        assert mean[k] == pytest.approx(list(m.mean(axis=0)))
        assert plain[k] == pytest.approx(list(np.quantile(m, 0.75, axis=0)))
        assert counted[k] == pytest.approx(list(np.quantile(m, 0.75, axis=0)))
        for t in (1.0, 50.0):
            d = np.linalg.norm(m - m.mean(axis=0), axis=1) / t
            w = np.exp(d - d.max())
            assert sdp[k, t] == pytest.approx(list((m * (w / w.sum())[:, None]).sum(axis=0)))


def test_small_pools(spark):
    assert pooling.mean_pool(vectors(spark, [[[1, 2], [3, 4]]]), 2).first().features == [2.0, 3.0]
    chunks = vectors(spark, [[[1], [9], [3]]]).withColumn("frames", F.when(F.col("window_index") == 1, 15).otherwise(16))
    assert pooling.min_length_mean_pool(chunks, 1, "frames").first().features == [2.0]
    with pytest.raises(Exception, match="no valid chunk"):
        pooling.min_length_mean_pool(chunks.withColumn("frames", F.lit(3)), 1, "frames").collect()
    with pytest.raises(ValueError):
        pooling.sdp_pool(chunks, 1, [0.0])


def test_counted_quantile_with_ties_and_outliers(spark):
    rng = np.random.default_rng(4)
    groups = {0: np.repeat([1.0, 2.0, 3.0], [50, 30, 21]), 1: np.append(rng.normal(size=400), 1e9), 2: np.array([5.0]), 3: rng.normal(size=1001)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "k int, v double")
    for q in (0.25, 0.75, 0.975):
        got = {r.k: r.q for r in counted_quantile(df, ["k"], "v", q).collect()}
        assert all(got[k] == pytest.approx(np.quantile(x, q)) for k, x in groups.items())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_positions_with_a_key_holding_a_third(spark, parts):
    rng = np.random.default_rng(5)
    keys = [0] * 100 + [int(k) for k in rng.integers(1, 60, 200)]
    rows = [(k, int(rng.integers(0, 50)), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k int, a int, b int").repartition(5)
    got = running_before(df, [F.col("a"), F.col("b")], "at", keys=["k"], partitions=parts)
    want = {}
    for k, a, b in sorted(rows):
        want[k, a, b] = sum(1 for r in want if r[0] == k)
    assert {(r.k, r.a, r.b): r["at"] for r in got.collect()} == want


def test_positions_of_text_ids_nulls_and_outliers(spark):
    rows = [("a", 1), ("a", None), (None, 5), (None, 4), ("b", 10 ** 15), *[("b", i) for i in range(50)]]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    got = {(r.k, r.v): r["at"] for r in running_before(df, [F.col("v")], "at", keys=["k"], partitions=6).collect()}
    assert got == {("a", None): 0, ("a", 1): 1, (None, 4): 0, (None, 5): 1, ("b", 10 ** 15): 50, **{("b", i): i for i in range(50)}}
    names = spark.createDataFrame([(f"p{i % 17}", t) for i in range(60) for t in "xy" if t == "x" or i % 17 < 3], "group_id string, task string")
    places = {(r.task, r.group_id): r.patient_index for r in bootstrap.patient_positions(names).collect()}
    assert places == {("x", n): i for i, n in enumerate(sorted(f"p{i}" for i in range(17)))} | {("y", f"p{i}"): i for i in range(3)}
    windows = spark.createDataFrame([(f"r{i}", w) for i in range(30) for w in range(i % 4 + 1)], "record_id string, window_index long")
    at = [r.global_window_index for r in records.global_window_index(windows).orderBy("record_id", "window_index").collect()]
    assert at == list(range(len(at)))


def test_no_range_holds_most_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(10 ** 15)).otherwise(F.col("id")).alias("v"))
    placed = running_before(df, [F.col("v")], "at", partitions=8)
    assert placed.filter("v = 1000000000000000").first()["at"] == 19_999
    sizes = [r["count"] for r in placed.groupBy(F.expr("at div 2500")).count().collect()]
    assert max(sizes) == 2500


@pytest.mark.parametrize("dim", [4, 64, 65, 200])
def test_pools_are_alike_at_every_width(spark, dim):
    rng = np.random.default_rng(dim)
    x = {r: rng.normal(size=(int(n), dim)) for r, n in zip("abcd", [1, 3, 9, 30])}
    rows = [(r, i, v.tolist()) for r, m in x.items() for i, v in enumerate(m)] + [("a", 9, None), ("z", 0, None)]
    df = spark.createDataFrame(rows, "record_id string, window_index long, features array<double>").repartition(4)

    def got(pooled, where="true"):
        return {r.record_id: np.array(r.features) for r in pooled.filter(where).collect()}
    mean, quart = got(pooling.mean_pool(df, dim)), [got(pooling.q75_pool(df, dim, hot_rows=h)) for h in (5, 10 ** 6)]
    sdp = pooling.sdp_pool(df, dim, [1.0, 5.0, 20.0], chunk=4)
    assert set(mean) == set(quart[0]) == set(quart[1]) == set(x)
    for r, m in x.items():
        assert np.allclose(mean[r], m.mean(0))
        assert all(np.allclose(q[r], np.quantile(m, 0.75, axis=0)) for q in quart)
        d = np.sqrt(((m - m.mean(0)) ** 2).sum(1))
        for t in (1.0, 5.0, 20.0):
            w = np.exp((d - d.max()) / t)
            assert np.allclose(got(sdp, f"temperature = {t}")[r], (w[:, None] * m).sum(0) / w.sum())
    known = df.filter("features is not null and record_id <> 'a'")
    z = {(r.record_id, r.window_index): np.array(r.features) for r in pooling.standardise(known, F.col("record_id") != "b", dim).collect()}
    fit = np.concatenate([x["c"], x["d"]])
    assert np.allclose(z["b", 1], (x["b"][1] - fit.mean(0)) / fit.std(0))
    with pytest.raises(Exception, match="dimension"):
        pooling.mean_pool(df, dim + 1).collect()


def test_shuffled_rows_do_not_follow_the_dimension(spark):
    for dim in (64, 256):
        df = spark.range(400).select((F.col("id") % 4).alias("record_id"), F.array_repeat(F.col("id").cast("double"), dim).alias("features"))
        plan = pooling.mean_pool(df, dim)._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" not in plan


def test_crop_of_a_constant_signal_by_prefix_sums(spark):
    for size in (3, 64, 65):
        df = spark.createDataFrame([(1, i, 0.5) for i in range(200)], "record_id int, sample_index long, value double")
        assert signals.max_energy_crop(df, size).first().crop_start_sample == 0


def test_global_running_total_and_batches(spark):
    windows = spark.createDataFrame([(r, w) for r in (3, 10, 11, 500) for w in range(r % 7 + 1)], "record_id long, window_index long")
    got = records.global_window_index(windows, batch_size=4).orderBy("record_id", "window_index").collect()
    assert [r.global_window_index for r in got] == list(range(len(got))) and [r.batch_id for r in got] == [i // 4 for i in range(len(got))]


def test_sequential_ids(spark):
    names = [f"n{i * 37 % 101:03d}" for i in range(101)]
    df = spark.createDataFrame([(n,) for n in names * 2], "name string").repartition(6)
    got = {r.name: r.record_name for r in records.sequential_ids(df, "name", "rec_%05d").collect()}
    assert got == {n: f"rec_{i:05d}" for i, n in enumerate(sorted(names), start=1)}
    assert sorted(r["at"] for r in sorted_position(df.distinct(), ["name"], "at", 9).collect()) == list(range(101))


def test_folds_keep_groups_whole_and_balanced(spark):
    rows = [(i, i // 3, ["a", "b", "c"][(i // 3) % 3], "train" if i < 270 else "test") for i in range(300)]
    df = spark.createDataFrame(rows, "record_id int, group_id int, label string, split string")
    got = records.grouped_stratified_folds(df, "label", F.col("split") == "train").collect()
    assert all((r.fold_id == -1) == (r.split == "test") for r in got)
    folds = {}
    for r in got:
        if r.fold_id >= 0:
            folds.setdefault(r.group_id, set()).add(r.fold_id)
    assert all(len(f) == 1 for f in folds.values())
    sizes = {}
    for r in got:
        sizes[r.label, r.fold_id] = sizes.get((r.label, r.fold_id), 0) + (r.fold_id >= 0)
    assert {v for (_, f), v in sizes.items() if f >= 0} == {18}


def test_a_hot_content_is_matched_once_per_train_copy(spark):
    rows = [(i, "same" if i % 3 == 0 else f"c{i}", "test" if i % 2 else "train") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id int, content string, split string")
    got = records.cross_split_duplicates(df, "content", "split", "train", "test").collect()
    assert sorted(r.record_id for r in got) == [i for i in range(0, 60, 6)] and {r.held_out_copies for r in got} == {10}


def feature_rows(spark, classes):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.1] + [0, 10, 3]
    y = [classes[int(v)] for v in rng.integers(0, len(classes), 120)]
    x[:, 0] += [classes.index(v) for v in y]
    rows = [(i, [float(v) for v in x[i]] + [7.0], y[i], "train" if i < 100 else "test") for i in range(120)]
    return spark.createDataFrame(rows, "record_id int, features array<double>, label string, split string"), x, y


def softmax_optimum(x, y, classes):
    """Newton minimum of sum of losses + |w|^2 / 2 with free intercepts, weights pinned by the penalty."""
    z = (x[:100] - x[:100].mean(axis=0)) / x[:100].std(axis=0)
    a = np.hstack([z, np.ones((100, 1))])
    k, d = len(classes), a.shape[1]
    t = np.eye(k)[[classes.index(v) for v in y[:100]]]
    w = np.zeros((k, d))
    pen = np.ones((k, d))
    pen[:, -1] = 1e-9
    if k == 2:
        pen = pen * 2
    for _ in range(60):
        s = a @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = ((p - t).T @ a + pen * w).ravel()
        h = np.diag(pen.ravel())
        for i in range(k):
            for j in range(k):
                c = p[:, i] * ((i == j) - p[:, j])
                h[i * d:(i + 1) * d, j * d:(j + 1) * d] += a.T @ (a * c[:, None])
        w -= np.linalg.solve(h, g).reshape(k, d)
    z = (x - x[:100].mean(axis=0)) / x[:100].std(axis=0)
    s = np.hstack([z, np.ones((120, 1))]) @ w.T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("classes", [["no", "yes"], ["c", "a", "b"]])
def test_logreg_reaches_the_optimum_in_declared_order(spark, classes):
    df, x, y = feature_rows(spark, classes)
    got = fitting.logreg_scores(df, F.col("split") == "train", "label", classes, 4, tol=1e-10).orderBy("record_id").collect()
    want = softmax_optimum(x, y, classes)
    assert np.abs(np.array([r.probabilities for r in got]) - want).max() < 1e-5
    usual = fitting.logreg_scores(df, F.col("split") == "train", "label", classes, 4).orderBy("record_id").collect()
    assert np.abs(np.array([r.probabilities for r in usual]) - want).max() < 2e-3
    with pytest.raises(ValueError, match="'other' is not among"):
        fitting.fit_logreg(df.withColumn("label", F.when(F.col("record_id") == 3, F.lit("other")).otherwise(F.col("label"))), "label", classes, 4)
    assert got[0].class_order == classes


def test_scaling_uses_fit_rows_only(spark):
    df, x, _ = feature_rows(spark, ["no", "yes"])
    got = np.array([r.features for r in pooling.standardise(df, F.col("split") == "train", 4).orderBy("record_id").collect()])
    assert np.allclose(got[:, :3], (x - x[:100].mean(axis=0)) / x[:100].std(axis=0)) and (got[:, 3] == 0).all()


def test_out_of_fold_scores_cover_the_training_rows_once(spark):
    rows = [(i, [float(i % 2), float(i)], ["no", "yes"][i % 2], i // 2 if i < 10 else -1) for i in range(12)]
    df = spark.createDataFrame(rows, "record_id int, features array<double>, label string, fold_id int").withColumn("group_id", F.expr("record_id div 2"))
    got = fitting.oof_scores(df, "label", ["no", "yes"], 2).collect()
    assert sorted(r.record_id for r in got) == list(range(10)) and all(math.isfinite(p) for r in got for p in r.probabilities)
    prior = fitting.oof_prior_scores(df, "label", ["no", "yes"]).collect()
    assert sorted(r.record_id for r in prior) == list(range(10)) and {tuple(r.probabilities) for r in prior} == {(0.5, 0.5)}
    with pytest.raises(ValueError, match="without fit rows"):
        fitting.fit_logreg(df, "label", ["no", "yes", "maybe"], 2)


def test_leaking_folds_are_refused(spark):
    rows = [(i, 7, [float(i)], ["no", "yes"][i % 2], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "record_id int, group_id int, features array<double>, label string, fold_id int")
    with pytest.raises(ValueError, match="several folds"):
        fitting.oof_scores(df, "label", ["no", "yes"], 1, folds=2)


def test_upper_quartile_of_null_keys_and_null_dimensions(spark):
    rows = [(None, [float(i), None, 1.0]) for i in range(5)] + [(1, [None, float(i), 2.0]) for i in range(5)] + [(2, [None, None, None])] * 3
    df = spark.createDataFrame(rows, "record_id long, features array<double>")
    want = {None: [3.0, None, 1.0], 1: [None, 3.0, 2.0], 2: [None, None, None]}
    for hot_rows in (2, 10 ** 6):
        assert {r.record_id: r.features for r in pooling.q75_pool(df, 3, hot_rows=hot_rows).collect()} == want


def test_folds_are_as_even_as_one_greedy_walk(spark, monkeypatch):
    """Buckets of 64 groups beside the plain walk over all of them: no class of a fold is further off than one group; null groups and labels count."""
    rng = np.random.default_rng(8)
    counts = rng.poisson(rng.dirichlet([0.5] * 3, 400) * 10)
    rows = [(None if g == 7 else g, None if c == 0 else "xyz"[c], "train") for g, line in enumerate(counts.tolist()) for c, n in enumerate(line) for _ in range(n)]
    monkeypatch.setattr(records, "HEAD", 64)
    df = spark.createDataFrame(rows + [(3, "y", "test"), (9_999, "z", None)], "group_id long, label string, split string")
    got = records.grouped_stratified_folds(df, "label", F.col("split") == "train").collect()
    assert all((r.fold_id == -1) == (r.split != "train") for r in got) and len(got) == len(rows) + 2
    fold = {r.group_id: r.fold_id for r in got if r.split == "train"}
    assert all(fold[r.group_id] == r.fold_id for r in got if r.split == "train")
    loads = np.zeros((5, 3))
    for r in got:
        if r.split == "train":
            loads[r.fold_id, 0 if r.label is None else "xyz".index(r.label)] += 1
    plain, weights = np.zeros((5, 3)), 1.0 / counts.sum(0) ** 2.0
    for v in sorted(counts.tolist(), key=lambda v: -np.std(v)):
        plain[np.argmin((plain * v * weights).sum(1))] += v
    assert (np.abs(loads - plain.mean(0)).max(0) <= np.abs(plain - plain.mean(0)).max(0) + counts.max(0)).all()
    assert records.grouped_stratified_folds(df.limit(0), "label", F.col("split") == "train").count() == 0
