import math
import random

from pyspark.sql import functions as F

from cohortlens.llm import topk
from tests.compare import compare
from tests.conftest import SMALL


def brute(rows, k):
    rows = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in rows:
        if q % 3 == 0:
            best = sorted(((sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q), key=lambda t: (-t[0], t[1]))[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_query_matches_sql(spark, duck):
    assert compare(spark, duck, SMALL, "op9_topk") is None


def test_random_sparse_vectors_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0, 0.0, 0.25, -0.5, 1.0]) for _ in range(12)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, None), (3, [0.5, None]), (None, [1.0, 1.0]), (4, [float("inf"), 1.0]),
            (5, [0.001, -0.001]), (6, [0.0, 0.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 score", "2 rank", "3 id", "4 block")
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)
    assert topk.top_k(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_blocks_of_the_stated_size_meet_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 1500)
    monkeypatch.setattr(topk, "GROUPS", 2)
    vectors = spark.range(0, 4000, 1, 1).selectExpr("id", "array(id % 7, 1L) vec")
    blocks = topk._packed(vectors, topk.CANDIDATES)
    assert sorted(len(topk.unpack(r.payload)[0]) for r in blocks.collect()) == [1000, 1500, 1500]
    df = vectors.selectExpr("id vec_id", "cast(vec as array<double>) embedding")
    best = topk.top_k(df, F.col("vec_id") % 50 == 0, k=1)
    assert best.count() == 80
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
