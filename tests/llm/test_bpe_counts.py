import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm.bpe_counts import counter, prefix_tables, token_counts
from cohortlens.llm.queries import QUERIES
from tests.conftest import SMALL

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_query_matches_library(spark, library):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = got[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 512)
        if n > 512:
            assert len(library.encode(text[:r.fits_chars], add_special_tokens=False).ids) <= 512 < \
                len(library.encode(text[:r.fits_chars + 1], add_special_tokens=False).ids)


def test_every_prefix(library):
    own, rng = counter(open(PATH, encoding="utf-8").read()), random.Random(1)
    bits = ["hello", " world", "  ", " ", "\n\n", "\t", "'ll", "'s", "'", "ll", "12", " 345", "é", "日本", "!!", " ?", "🙂", " ", "<|endoftext|>", "<|endof", "the", "THE", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["a" * 300, " " * 50, "'l", "'", ""]
    for t in texts:
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.table(t).tolist() == want, t
        for limit in (0, 1, 3, 10):
            assert own.within(t, limit) == (want[-1], max(i for i, n in enumerate(want) if n <= limit)), (t, limit)


def test_edges(spark, library):
    rows = [(1, None), (1, None), (None, ""), (2, " x" * 60_000), (3, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' n_tokens", "1 counts")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect())
    n = len(library.encode("y" * 5000).ids)
    assert got == [("1", 0, 0, False), ("1", 0, 0, False), ("2", 120_000, 60_000, True), ("3", 5000, n, n > 512), ("None", 0, 0, False)]
    assert [r.counts for r in prefix_tables(df.filter("doc_id = 1"), PATH).collect()] == [[0], [0]]
    assert token_counts(df.limit(0), PATH).count() == 0
