import random

import pytest

from cohortlens.llm.components import components
from cohortlens.llm.queries import QUERIES
from cohortlens.llm.simhash import links, near_duplicates
from tests.conftest import SMALL
from tests.llm import brute


def test_query_matches_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == brute.near_duplicates(rows)
    assert any(c != i for i, (_, c) in got.items())


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5, 7])
def test_links_lose_nothing(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = set(base)
    for f in base:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, distance + 2)):
                f ^= 1 << b
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = [(r.a, r.b) for r in links(df, distance).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in pairs)
    want = brute.components(signed, near)
    assert brute.components(signed, pairs) == want
    got = {r.node: r.root for r in components(links(df, distance)).collect()}
    assert got == {n: r for n, r in want.items() if list(want.values()).count(r) > 1}


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(201)}


def test_edges(spark):
    rows = [(3, None), (5, ""), (7, " \n"), (9, "One two"), (9, "one TWO"), (None, "one two"), (11, "É one"), (12, "é one"), (13, "w " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' fp", "1 component_id")
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicates(df).collect())
    assert got[:3] == [("11", 11), ("12", 12), ("13", 13)] and got[3:6] == [("3", 3), ("5", 3), ("7", 3)]
    assert got[6:] == [("9", 9), ("9", 9), ("None", 9)]
    assert near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        links(df.selectExpr("cast(doc_id as long) fp"), 0)
