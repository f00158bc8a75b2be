import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm.queries import QUERIES
from cohortlens.llm.repeats import remove_repeats
from tests.conftest import SMALL
from tests.llm import brute


def digest(df):
    return {r[0]: (r[1], r[2], r[3]) for r in df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()}


def test_query_matches_brute_force(spark):
    got = QUERIES["op10_substring_dedup"](spark, SMALL).collect()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute.removed_repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert any(n for _, n, _ in want.values())


@pytest.mark.parametrize("window", [2, 5, 20])
def test_random_repeats(spark, window):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    rows = [(i * 7 % 101, rng.choice(["", " ", "\n"]).join(rng.choice(passages) + rng.choice([" ", "\t\n"]) for _ in range(rng.randint(0, 5))))
            for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert digest(remove_repeats(df, window=window)) == brute.removed_repeats(rows, window)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, long), (2, None), (3, ""), (4, "\x1c " * 3), (5, long + " " + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("part", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, [tuple(x) for x in r.removed], r.chunk)
                 for r in remove_repeats(df, keep=["chunk", "part"]).collect())
    assert got == sorted([("1", 50, 0, [], "x"), ("1", 50, 50, [(0, 50)], "x"), ("None", 50, 50, [(0, 50)], "x"), ("2", 0, 0, [], "x"),
                          ("3", 0, 0, [], "x"), ("4", 3, 0, [], "x"), ("5", 100, 100, [(0, 100)], "x")])
    assert remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="clash"):
        remove_repeats(df.withColumn("removed", F.lit(1)), keep=["removed"])
