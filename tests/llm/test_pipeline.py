"""Every stage of the pipeline against a plain version of it, on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cohortlens.llm.queries import target_levels
from cohortlens.llm.unigram import _pieces
from tests.llm import brute
from tests.llm.test_mixing import plain
from tests.llm.test_overlap import plain as all_pairs

FOLDER = "/root/testdata/sf0.001"
TYPES = ["bigint", "string", "string", "string", "bigint"]


@pytest.fixture(scope="module")
def results(spark):
    """[documents, result of every stage], each written and read again."""
    from cohortlens.llm.storing import settled
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        out.append(settled(stage(spark, out[-1], FOLDER), "test-stage"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(results):
    for df in results[1:-1]:
        assert df.columns == pipeline.COLUMNS and [t for _, t in df.dtypes] == TYPES


def test_classifier_keeps_good_documents(spark, results):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = texts(results[0]), texts(results[1])
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad)
    assert all(before[i] == t for i, t in after.items())


def test_near_copies(results):
    before, after = texts(results[1]), texts(results[2])
    assert after == {i: before[i] for i, first in all_pairs(before.items()).items() if i == first}


def test_repeats(results):
    before = texts(results[2])
    want = {}
    seen = brute.removed_repeats(before.items())
    for i, text in before.items():
        n, gone, digest = seen[i]
        if n == 0 or gone < n:
            want[i] = digest if gone else hashlib.sha256(" ".join(brute.words(text)).encode()).hexdigest()
    got = {r.doc_id: hashlib.sha256(" ".join(brute.words(r.text)).encode()).hexdigest() for r in results[3].collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in results[3].collect())


def test_mixing(spark, results):
    rows = results[3].select("doc_id", *[c.value.alias(c.name) for c in target_levels()], *[c.weight.alias(f"w_{c.name}") for c in target_levels()], "text").collect()
    listed, weight = [], {}
    for r in rows:
        path = ("=" + r.domain, "=" + r.lang, "=" + r.source)
        listed.append((r.doc_id, path, len(brute.words(r.text))))
        weight |= {path[:1]: r.w_domain, path[:2]: r.w_lang, path: r.w_source}
    want = plain(listed, weight.__getitem__, sum(r[2] for r in listed) * 5 // 4, 4, 1)
    assert Counter(r.doc_id for r in results[4].collect()) == Counter(i for i, _, _ in want)
    before = texts(results[3])
    assert all(before[i] == t for i, t in texts(results[4]).items())


def test_encoding(results):
    own = _pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    given = [(r.doc_id, r.text) for r in results[4].collect()]
    got = results[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in given) and all(r.round_trip for r in got)
    want = dict(given)
    for r in got[:60]:
        assert list(r.ids) == own.search(("▁" + want[r.doc_id].replace(" ", "▁")).encode()) and r.n_tokens == len(r.ids)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (None, "a b c d e", "en", "s1", 9), (3, "", "en", None, 0), (4, "w " * 30_000, "xx", "s1", 60_000), (4, "w " * 30_000, "xx", "s1", 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    for docs in (df, df.limit(0)):
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            docs.count()
