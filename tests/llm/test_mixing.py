import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortlens.llm.mixing import Level, mix
from tests.compare import compare
from tests.conftest import SMALL
from tests.llm import brute


def water(budget, children):
    """{key: quota} of (key, weight, capacity): raise a common level until the budget is spent."""
    left, out, spent = list(children), {}, 0
    while left:
        level = Fraction(budget - spent, sum(w for _, w, _ in left))
        full = [c for c in left if c[2] <= level * c[1]]
        if not full:
            return out | {k: int(level * w) for k, w, _ in left}
        for k, _, cap in full:
            out[k] = cap
            spent += cap
        left = [c for c in left if c not in full]
    return out


def plain(rows, weights, budget, epochs, seed):
    """rows: (id, path of three, tokens); weights by path prefix."""
    docs = defaultdict(list)
    for r in rows:
        docs[r[1]].append(r)
    cap = defaultdict(int)
    for path, own in docs.items():
        if all(weights(path[:d + 1]) > 0 for d in range(3)):
            for d in range(4):
                cap[path[:d]] += epochs * sum(r[2] for r in own)
    quota = {(): min(budget, cap[()])}
    for d in range(3):
        for parent in [p for p in quota if len(p) == d]:
            kids = sorted({p[:d + 1] for p in docs if p[:d] == parent and cap[p[:d + 1]] > 0})
            quota |= water(quota[parent], [(k, weights(k), cap[k]) for k in kids])
    out = []
    for path, own in docs.items():
        total, q = sum(r[2] for r in own), quota.get(path, 0)
        if not q:
            continue
        full, rest, run = q // total, q % total, 0
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{seed}|{full}|{r[0]}".encode()).hexdigest(), r[0], r[2])):
            run += r[2]
            out += [(r[0], path, e) for e in range(full + (run <= rest))]
    return sorted(out)


def test_query_matches_sql(spark, duck):
    assert compare(spark, duck, SMALL, "op2_mixing") is None


@pytest.mark.parametrize("share", [(1, 3), (1, 1), (5, 2), (9, 1)])
def test_random_trees(spark, share):
    rng = random.Random(share[0])
    rows = [(i, "abc"[rng.randint(0, 2)], rng.choice("xy"), rng.choice("pqrs"), " ".join("w" * rng.randint(0, 30))) for i in range(400)]
    rows += [(1000 + i, "a", "x", "p", "w " * 400) for i in range(30)]
    value = {"a": 5, "b": 0, "c": 2, "x": 3, "y": 1, "p": 1, "q": 2, "r": 4, "s": 1}
    df = spark.createDataFrame(rows, "doc_id long, d string, l string, s string, text string").repartition(5)
    named = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    levels = [Level(n, F.col(n), named[F.col(n)]) for n in "dls"]
    got = sorted((r.doc_id, (r.d, r.l, r.s), r.epoch) for r in mix(df, levels, share, max_epochs=3, seed=4).collect())
    listed = [(r[0], tuple("=" + x for x in r[1:4]), len(brute.words(r[4]))) for r in rows]
    total = sum(r[2] for r in listed)
    assert got == plain(listed, lambda p: value[p[-1][1:]], total * share[0] // share[1], 3, 4)


def test_edges(spark):
    rows = [(1, "a b", None, None), (None, None, "x", "s"), (2, "", "x", "s"), (3, "a " * 40_000, "x", "s"), (3, "a " * 40_000, "x", "s"), (4, "q r", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 capacity", "2 weight", "3 tokens")
    levels = [Level("lang", F.col("lang"), F.lit(1)), Level("source", F.col("source"), F.lit(2))]
    got = mix(df, levels, budget=10**9, max_epochs=2, keep=["capacity", "text"]).collect()
    assert sorted((r.doc_id, r.epoch) for r in got if r.doc_id) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 0), (3, 1), (3, 1), (4, 0), (4, 1)]
    assert {(r.lang, r.source) for r in got} == {("null", "null"), ("=x", "=s"), ("=x", "null")} and all(r.capacity == 1 for r in got)
    assert mix(df, levels, budget=0).count() == 0 and mix(df.limit(0), levels).count() == 0
    assert mix(df, [Level("lang", F.col("lang"), F.lit(None).cast("int"))]).count() == 0
    with pytest.raises(ValueError):
        mix(df.withColumn("epoch", F.lit(1)), levels, keep=["epoch"])
