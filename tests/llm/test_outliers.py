import random

import numpy as np

from cohortlens.llm import outliers
from cohortlens.llm.outliers import DIM, chi2_quantile, estimates, quality_rules
from cohortlens.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm import brute


def counts(text):
    w, lines = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    gone = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)} if len(set(windows)) < len(windows) else set()
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(gone))


def test_base_counts_match_plain_counts(spark):
    rows = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op1_quality_rules"](spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        c = counts(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and not (r.base_failed and r.kept)


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(9)
    good = rng.multivariate_normal([1.5, 0.5, 0.5, 0.5, 6], np.diag([0.04, 0.02, 0.02, 0.02, 1.0]), 1600)
    bad = rng.normal([4, 2, 1, 1, 9], 0.05, (400, DIM))
    df = spark.createDataFrame([("g", x.tolist()) for x in np.concatenate((good, bad))], "__g string, __x array<double>").repartition(6)
    e = estimates(df).collect()[0]
    assert e.rows == 2000 and np.allclose(e.centre, [1.5, 0.5, 0.5, 0.5, 6], atol=0.12)
    z = (np.concatenate((good, bad)) - e.centre) @ np.array(e.factor).reshape(DIM, DIM).T
    d = (z ** 2).sum(1) / e.scale
    assert (d[:1600] < 25).mean() > 0.99 and d[1600:].min() > 40


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)]

    def text(end):
        return " ".join(rng.choice(vocabulary) + end(i) for i in range(rng.randint(60, 500)))
    rows = [(i, text(lambda i: ".\n" if i % 20 == 19 else ""), "en", f"s{i % 2}") for i in range(800)]
    rows += [(800 + i, text(lambda i: rng.choice(["$$$", "###", "%%%"])), "en", f"s{i % 2}") for i in range(60)]
    rows += [(900, "short", "en", "s0"), (901, None, None, None), (902, rows[0][1], None, "rare"), (903, rows[0][1], None, "rare"), (903, rows[0][1], None, "rare"),
             (904, " ".join(vocabulary) * 10, "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 n_words", "2 kept", "3 bin")
    got = [(r.doc_id, r.kept, r.base_failed) for r in quality_rules(df).collect()]
    assert len(got) == len(rows)
    kept = {i for i, k, _ in got if k}
    assert sum(i < 800 for i in kept) >= 798 and not any(800 <= i < 900 for i in kept)
    assert {900, 901, 904}.isdisjoint(kept) and {902, 903} <= kept  # 904 repeats itself ten times
    assert quality_rules(df.limit(0)).count() == 0


def test_a_group_with_few_passing_rows_is_pooled_and_judged(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)]

    def text(end):
        return " ".join(rng.choice(vocabulary) + end() for _ in range(rng.randint(60, 500)))
    rows = [(i, text(str), "en", "large") for i in range(400)]
    rows += [(1000 + i, text(str) if i < 180 else text(lambda: "$$$") if i < 190 else "short", "en", "junk") for i in range(250)]  # 60 fail the base rules
    rows += [(2000 + i, text(str), "en", "small") for i in range(60)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(r.base_failed for r in got.values()) == 60 and all(r.distance is not None for r in got.values())
    assert not any(got[1000 + i].kept for i in range(180, 190)) and sum(got[1000 + i].kept for i in range(180)) >= 178


def brute_mcd(x, share=0.75, starts=60, seed=0):
    """(centre, covariance) of least determinant by exact concentration steps from many starts."""
    rng, n = np.random.default_rng(seed), len(x)
    best = None
    for s in range(starts):
        own = x[rng.choice(n, DIM + 2, replace=False)] if s else x
        centre, cov = np.median(x, 0) if not s else own.mean(0), np.cov(own.T) + 1e-6 * np.eye(DIM)
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[np.argsort(d, kind="stable")[:int(np.ceil(share * n))]]
            centre, cov = near.mean(0), np.cov(near.T, bias=True)
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], centre, cov
    return best


def test_estimates_match_brute_force(spark):
    rng = np.random.default_rng(21)
    groups = {}
    for g, (bad, n) in {"a": (0.0, 900), "b": (0.2, 1200), "c": (0.1, 700)}.items():
        a = rng.normal(size=(DIM, DIM))
        x = rng.normal(size=(n, DIM)) @ a + 5
        k = int(bad * n)
        x[:k] = rng.normal(size=(k, DIM)) * 0.3 + 25
        groups[g] = x
    df = spark.createDataFrame([(g, r.tolist()) for g, x in groups.items() for r in x], "__g string, __x array<double>").repartition(5)
    found = {r["__g"]: r for r in estimates(df).collect()}
    cut = chi2_quantile(0.9999, DIM)
    for g, x in groups.items():
        logdet, centre, cov = brute_mcd(x)
        e = found[g]
        factor = np.array(e.factor).reshape(DIM, DIM)
        own = np.linalg.inv(factor.T @ factor)
        spread = np.sqrt(np.diag(cov))
        assert e.rows == len(x) and e.free == DIM and e.logdet < logdet + 0.05
        assert np.abs((np.array(e.centre) - centre) / spread).max() < 0.05
        assert np.abs((own - cov) / np.outer(spread, spread)).max() < 0.06
        want = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        want /= max(1.0, np.median(want) / chi2_quantile(0.5, DIM))
        got = (((x - e.centre) @ factor.T) ** 2).sum(1) / e.scale
        assert ((got <= cut) == (want <= cut)).mean() > 0.998


def test_many_groups_meet_rows_by_salts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"g{i % 3}", r.tolist()) for i, r in enumerate(rng.normal(size=(900, DIM)))], "__g string, __x array<double>")
    want = {r["__g"]: (r.rows, round(r.logdet, 9)) for r in estimates(df).collect()}
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 1)
    assert {r["__g"]: (r.rows, round(r.logdet, 9)) for r in estimates(df).collect()} == want


def test_symbols_on_some_words(spark):
    """Symbols on a fifth of the words or more are outliers; nearly all clean texts stay."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 10))) for _ in range(3000)]

    def text(part):
        return " ".join(rng.choice(vocabulary) + ("#" if rng.random() < part else "") for _ in range(200))
    rows = [(i, text(0), "en", "s") for i in range(800)] + [(1000 + i, text((0.2, 0.3, 0.5)[i % 3] + 0.05), "en", "s") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(60)) and sum(got[i] for i in range(800)) >= 792
