"""The experiments with logistic regression, against plain numpy versions of the whole flow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cells as many
from cohortlens.operators.cells import Task
from cohortlens.operators.fitting import fit_logreg
from cohortlens.plans import experiments
from cohortlens.plans.experiments import Branch

CLASSES = {"two": ["no", "yes"], "three": ["c", "a", "b"]}
SPLITS = ["train", "test2022", "test2023"]
ABNORMAL = {"two": ("no", ["yes"]), "three": ("c", ["a", "b"])}


def optimum(x, y, k, c=1.0):
    """[class][feature..., intercept] of the penalised optimum on standardised features, by plain Newton steps."""
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    a = np.c_[(x - mean) / std, np.ones(len(x))]
    lines = 1 if k == 2 else k
    w = np.zeros((lines, a.shape[1]))
    ridge = np.tile(np.r_[np.ones(x.shape[1]), 0] / c, lines)
    onehot = np.eye(k)[y]
    for _ in range(60):
        p = shares(a @ w.T)
        g = ((p - onehot)[:, -lines:].T @ a).ravel() + ridge * w.ravel()
        h = np.diag(ridge) + 1e-12 * np.eye(len(ridge))
        q = p[:, -lines:]
        for i in range(lines):
            for j in range(lines):
                at = np.ix_(range(i * a.shape[1], (i + 1) * a.shape[1]), range(j * a.shape[1], (j + 1) * a.shape[1]))
                h[at] += (a * (q[:, i] * ((i == j) - q[:, j]))[:, None]).T @ a
        w = w - np.linalg.lstsq(h, g, rcond=None)[0].reshape(w.shape)
    return lambda z: shares(np.c_[(z - mean) / std, np.ones(len(z))] @ w.T)


def shares(z):
    z = np.c_[np.zeros(len(z)), z] if z.shape[1] == 1 else z
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Data:
    """Records with groups, splits, labels, folds and three sets of vectors."""

    def __init__(self, n=240, seed=0):
        rng = np.random.default_rng(seed)
        self.ids = np.arange(n)
        self.group = self.ids // 3
        self.split = np.array(SPLITS)[np.where(self.group % 10 < 6, 0, np.where(self.group % 10 < 8, 1, 2))]
        self.train = self.split == "train"
        self.label = {t: rng.integers(0, len(c), n) for t, c in CLASSES.items()}
        self.fold = {t: np.where(self.train, (self.group * 7 + i) % 5, -1) for i, t in enumerate(CLASSES)}
        shift = self.label["three"][:, None] + 2 * self.label["two"][:, None]
        self.x = {"single": rng.normal(size=(n, 3)) + 0.3 * shift, "cls": rng.normal(size=(n, 3)) + 0.6 * shift,
                  "grid": np.c_[rng.normal(size=(n, 4)) - 0.4 * shift, np.ones(n)]}

    def frame(self, spark, kind=None):
        rows = [(int(i), int(self.group[i]), str(self.split[i]), *[CLASSES[t][self.label[t][i]] for t in CLASSES], *[int(self.fold[t][i]) for t in CLASSES],
                 self.x[kind][i].tolist() if kind else None) for i in self.ids]
        df = spark.createDataFrame(rows, "record_id long, group_id long, split string, two string, three string, fold_two int, fold_three int, features array<double>")
        return df if kind else df.drop("features")

    def branch(self, spark, kind):
        return Branch(self.frame(spark, kind), self.x[kind].shape[1])

    def scores(self, x, task):
        """Probabilities of every record: left-out ones in training, those of the whole training set elsewhere."""
        out = np.zeros((len(self.ids), len(CLASSES[task])))
        for k in range(-1, 5):
            fit, rows = self.train & (self.fold[task] != k), (self.fold[task] == k)
            out[rows] = optimum(x[fit], self.label[task][fit], out.shape[1])(x[rows])
        return out


TASKS = {t: Task(t, tuple(c), f"fold_{t}") for t, c in CLASSES.items()}
PLAIN = {t: (t, c) for t, c in CLASSES.items()}
FOLDS = {t: f"fold_{t}" for t in CLASSES}


def train():
    return F.col("split") == "train"


@pytest.fixture(scope="module")
def data():
    return Data()


def test_coefficients_match_separate_fits(spark, data):
    rows = data.frame(spark, "cls").withColumn("part", F.lit("cls"))
    models, passes = many.newton(many.prepare(rows, TASKS, 3, train()))
    found = {(r["task"], r["out"]): r for r in models.collect()}
    assert len(found) == 12 and passes <= 12
    for task, out in (("two", -1), ("two", 3), ("three", -1), ("three", 0)):
        fit = rows.filter(train() & (F.col(f"fold_{task}") != out))
        model = fit_logreg(fit, task, CLASSES[task], 3, tol=1e-13).model
        w, b = np.array(found[task, out]["weights"]), np.array(found[task, out]["bias"])
        want_w, want_b = model.coefficientMatrix.toArray(), np.array(model.interceptVector)
        w, b = (w[1:], b[1:]) if task == "two" else (w, b)
        assert np.abs(w - want_w).max() < 1e-6 and np.abs((b - b.mean() * (len(b) > 1)) - (want_b - want_b.mean() * (len(b) > 1))).max() < 1e-6


def test_scores_of_every_row(spark, data):
    rows = data.frame(spark, "grid").withColumn("part", F.lit("g")).unionByName(data.frame(spark, "grid").withColumn("part", F.lit("h")))
    got = many.logistic(many.prepare(rows.repartition(7), TASKS, 5, train())).collect()
    want = {t: data.scores(data.x["grid"], t) for t in CLASSES}
    assert len(got) == 2 * 2 * len(data.ids)
    for r in got:
        assert np.abs(np.array(r["probabilities"]) - want[r["task"]][r["record_id"]]).max() < 1e-8
        assert r["class_order"] == CLASSES[r["task"]] and r["fold"] == data.fold[r["task"]][r["record_id"]]


def test_many_partials_are_added_in_steps(spark, data, monkeypatch):
    monkeypatch.setattr(many, "FAN_IN", 2)
    rows = data.frame(spark, "cls").withColumn("part", F.lit("p"))
    got = many.logistic(many.prepare(rows, TASKS, 3, train())).filter("task = 'three'").collect()
    want = data.scores(data.x["cls"], "three")
    assert max(np.abs(np.array(r["probabilities"]) - want[r["record_id"]]).max() for r in got) < 1e-8


def test_class_means(spark, data):
    rows = data.frame(spark, "cls").withColumn("part", F.lit("p"))
    x, y = data.x["cls"], data.label["three"]
    for r in many.class_means(many.prepare(rows, TASKS, 3, train())).filter("task = 'three'").collect():
        fit = data.train & (data.fold["three"] != r["fold"])
        near = np.array([1 / (1 + np.linalg.norm(x[r["record_id"]] - x[fit & (y == k)].mean(0))) for k in range(3)])
        assert np.abs(np.array(r["probabilities"]) - near / near.sum()).max() < 1e-12


def test_bad_inputs(spark, data):
    rows = data.frame(spark, "cls").withColumn("part", F.lit("p"))
    with pytest.raises(ValueError, match="not among"):
        many.prepare(rows.withColumn("two", F.when(F.col("record_id") == 0, F.lit("odd")).otherwise(F.col("two"))), TASKS, 3, train())
    with pytest.raises(ValueError, match="without fit rows"):
        many.prepare(rows.filter("not (split = 'train' and two = 'yes' and fold_two <> 2)"), TASKS, 3, train())
    with pytest.raises(ValueError, match="several folds"):
        many.prepare(rows.withColumn("fold_two", F.when(train(), F.col("record_id") % 5).otherwise(F.lit(-1))), TASKS, 3, train())
    with pytest.raises(ValueError, match="one by one"):
        many.newton(many.Cells(rows, {"t": Task("three", tuple(range(3000)))}, 3, 5))


def recall_mean(y, p, k):
    return np.mean([(p[y == j] == j).mean() for j in range(k) if (y == j).any()])


def macro_f1(y, p, k):
    return np.mean([2 * ((p == j) & (y == j)).sum() / max(1, (p == j).sum() + (y == j).sum()) for j in range(k)])


def test_progression(spark, data):
    found = experiments.progression(*[data.branch(spark, k) for k in ("single", "cls", "grid")], PLAIN, {"test2022": "A", "test2023": "B"}, train(), FOLDS)
    rows = {(r["phase"], r["task"], r["record_id"]): r for r in found.predictions.collect()}
    assert len(rows) == 3 * 2 * int((~data.train).sum())
    chosen = {r["task"]: r["alpha"] for r in found.selection.filter("selected").collect()}
    for task, classes in CLASSES.items():
        k, y = len(classes), data.label[task]
        single, cls, grid = (data.scores(data.x[s], task) for s in ("single", "cls", "grid"))
        tried = []
        for i in range(21):
            p = np.argmax(i / 20 * cls + (1 - i / 20) * grid, 1)[data.train]
            tried.append((-round(recall_mean(y[data.train], p, k), 12), -round(macro_f1(y[data.train], p, k), 12), abs(i / 20 - 0.5), i / 20))
        alpha = min(tried)[3]
        assert chosen[task] == alpha
        for phase, p in (("phase1", single), ("phase2", cls), ("phase3", alpha * cls + (1 - alpha) * grid)):
            for i in data.ids[~data.train]:
                r = rows[phase, task, i]
                assert np.abs(np.array(r["probabilities"]) - p[i]).max() < 1e-8 and r["y_pred"] == classes[int(np.argmax(p[i]))]
                assert (r["y_true"], r["dataset"]) == (classes[y[i]], "A" if data.split[i] == "test2022" else "B")


def test_encoder_comparison(spark, data):
    rows = experiments.encoder_comparison({"E": data.branch(spark, "single"), "F": data.branch(spark, "grid")}, PLAIN, {"test2022": "A"}, train()).collect()
    assert len(rows) == 2 * 2 * int((data.split == "test2022").sum())
    want = {(m, t): data.scores(data.x[x], t) for m, x in (("E", "single"), ("F", "grid")) for t in CLASSES}
    for r in rows:
        assert np.abs(np.array(r["probabilities"]) - want[r["method"], r["task"]][r["record_id"]]).max() < 1e-8


def test_challenge(spark, data):
    rng = np.random.default_rng(1)
    wins = {i: data.x["cls"][i] + rng.normal(size=(rng.integers(1, 6), 3)) for i in data.ids}
    windows = spark.createDataFrame([(int(i), j, v.tolist()) for i, w in wins.items() for j, v in enumerate(w)], "record_id long, window_index int, features array<double>")
    tasks = {t: (t, CLASSES[t], *ABNORMAL[t]) for t in CLASSES}
    found = experiments.challenge(windows, 3, data.frame(spark), tasks, train(), FOLDS)

    def pooled(temperature):
        out = []
        for w in wins.values():
            d = np.linalg.norm(w - w.mean(0), axis=1)
            e = np.exp((d - d.max()) / temperature)
            out.append(e / e.sum() @ w)
        return np.array(out)

    def official(y, p, classes, normal, sensitive):
        sp = (p[y == classes.index(normal)] == classes.index(normal)).mean()
        of = np.isin(y, [classes.index(c) for c in sensitive])
        se = (p[of] == y[of]).mean()
        return ((se + sp) / 2 + (2 * se * sp / (se + sp) if se + sp else 0)) / 2
    scores = {(r["task"], r["temperature"], r["fold_id"]): r["Score"] for r in found.folds.collect()}
    chosen = {r["task"]: r["temperature"] for r in found.selection.filter("selected").collect()}
    rows = {(r["method"], r["task"], r["record_id"]): r for r in found.predictions.collect()}
    assert len(rows) == 3 * 2 * int((~data.train).sum()) and len(scores) == 2 * 7 * 5
    q75 = np.array([np.percentile(w, 75, axis=0) for w in wins.values()])
    for task, classes in CLASSES.items():
        y, best = data.label[task], None
        for t in experiments.TEMPERATURES:
            p = np.argmax(data.scores(pooled(t), task), 1)
            own = [official(y[data.fold[task] == k], p[data.fold[task] == k], classes, *ABNORMAL[task]) for k in range(5)]
            assert np.allclose(own, [scores[task, t, k] for k in range(5)], atol=1e-9)
            if best is None or np.mean(own) > best[0] + experiments.REPLACEMENT_MARGIN:
                best = np.mean(own), t
        assert chosen[task] == best[1]
        cls, tg = data.scores(pooled(best[1]), task), data.scores(q75, task)
        for method, p in (("CLS", cls), ("Temporal Grid", tg), ("Fusion", 0.5 * cls + 0.5 * tg)):
            for i in data.ids[~data.train]:
                assert np.abs(np.array(rows[method, task, i]["probabilities"]) - p[i]).max() < 1e-7


def test_registered_forms_run(spark):
    import __spark_entry__ as entry
    from tests.conftest import SMALL
    for name in ("encoder_comparison_logreg",):
        rows, means = (entry.queries()[n](spark, SMALL) for n in (name, name.removesuffix("_logreg")))
        assert rows.columns == means.columns and rows.count() == means.count()
