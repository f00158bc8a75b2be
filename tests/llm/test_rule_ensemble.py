import math
import random
import zlib

import pytest

from cohortlens.llm.queries import QUERIES
from cohortlens.llm.rule_ensemble import RuleEnsemble, classify, features, paths, simplified
from cohortlens.llm.statistics import with_statistics

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = QUERIES["op4_quality_classifier"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in judged) >= 0.97 * len(judged) and len(judged) > 40


def test_paths_of_a_printed_tree():
    text = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= 0.5)
   If (feature 1 <= -1.0E-3)
    Predict: 0.0
   Else (feature 1 > -1.0E-3)
    Predict: 1.0
  Else (feature 0 > 0.5)
   Predict: 1.0"""
    a, b = ("a", "<=", 0.5), ("b", "<=", -0.001)
    assert paths(text, ["a", "b"]) == [(a,), (a, b), (a, ("b", ">", -0.001)), (("a", ">", 0.5),)]
    assert simplified([("a", "<=", 3.0), ("a", ">", 1.0), ("a", "<=", 2.0)]) == (("a", "<=", 2.0), ("a", ">", 1.0))


def test_compiled_rules_equal_plain_evaluation(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["a", "bb|", "ccc", "#", "D."]) for _ in range(rng.randint(0, 30)))) for i in range(80)], "doc_id long, text string")
    stats = with_statistics(df, keep=["doc_id"])
    names = list(features())
    rules = {simplified([(rng.choice(names), rng.choice(["<=", ">"]), rng.random() * 3) for _ in range(rng.randint(1, 3))]): rng.gauss(0, 1) for _ in range(25)}
    model = RuleEnsemble(0.3, rules)
    for r in stats.select(*[c.alias(n) for n, c in features().items()], model.score().alias("score")).collect():
        total = 0.3 + sum(w for rule, w in rules.items() if all(r[n] <= t if s == "<=" else r[n] > t for n, s, t in rule))
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (4, "w " * 30_000), (4, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' score", "'y' n_words", "1 quality")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, None), (4, 7), (None, 1)], "doc_id long, quality int")
    for labels in (none, one):
        got = classify(df, labels, keep=["text", "n_words"]).collect()
        assert len(got) == 5 and len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    assert classify(df.limit(0), one).count() == 0
    with pytest.raises(ValueError):
        classify(df, one, keep=["score"])
