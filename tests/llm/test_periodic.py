import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortlens.llm.periodic import find_runs, periodic_runs
from tests.conftest import SMALL
from tests.llm import brute


def plain(w, min_length=6, min_exponent=4):
    """(start, length, period) by comparing all words at every distance."""
    found = {}
    for d in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + d < len(w):
            j = i
            while j + d < len(w) and w[j] == w[j + d]:
                j += 1
            if j > i and j - i + d >= max(min_length, min_exponent * d):
                found.setdefault((i, j - i + d), d)
            i = j + 1
    return sorted(((s, n, d) for (s, n), d in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, d in runs for i in range(s + d, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(50))]
    for _ in range(rng.randrange(3)):
        at, period = rng.randrange(len(w) + 1), [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        w[at:at] = (period * 9)[:rng.randrange(40)]
    return w


def test_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 5))]
        least, exponent = rng.choice([2, 6, 9]), rng.choice([3, 4, 5])
        got = find_runs(np.array([x for d in docs for x in d], np.int64), np.cumsum([0, *map(len, docs)]), least, exponent)
        assert list(map(tuple, got.tolist())) == [(k, *r) for k, w in enumerate(docs) for r in plain(w, least, exponent)]


def test_long_periodic_texts():
    for period in (1, 3, 1000):
        w = np.arange(60_000) % period
        assert find_runs(w, np.array([0, len(w)])).tolist() == [[0, 0, 60_000, period]]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, " \n\t", "y"), (4, "a a a a a", "x"), (5, "b a a a a a a b", None), (5, "b a a a a a a b", None),
            (6, "é  " * 8, "z"), (7, "a b " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__text` string").withColumn("runs", F.lit(1)).withColumn("__c0", F.lit(2))
    got = sorted(periodic_runs(df, keep=["__text", "__c0"]).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    want = sorted(rows, key=lambda r: (r[0] or 0, len(brute.words(r[1]))))
    for r, (i, text, tag) in zip(got, want, strict=True):
        w = brute.words(text)
        runs = [(0, 40_000, 2)] if i == 7 else plain(w)
        assert (r.doc_id, r["__text"], r["__c0"], r.n_words) == (i, tag, 2, len(w))
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(w, runs)
    assert periodic_runs(df.limit(0)).collect() == []


def test_query(spark):
    docs = {r.doc_id: brute.words(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = entry.queries()["op11_periodic_runs"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        w, h = docs[r.doc_id], zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{d}\n" for s, n, d in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
