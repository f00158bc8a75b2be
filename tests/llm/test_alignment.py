import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from cohortlens.llm import alignment
from cohortlens.llm.bpe_counts import byte_letters
from tests.conftest import SMALL

FILES = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def groups_of(text, libraries):
    """[(A ids, B ids)] of the groups, token by token."""
    if not text:
        return []
    first, second = libraries
    letters = byte_letters()
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        p = second.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in t) != whole for t in (a, b)):
        return []
    ends = []
    for tokens in (a, b):
        at, e = 0, []
        for _, x in tokens:
            at += len(x)
            e.append(at)
        ends.append(e)
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        out.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
        i, j = x, y
    return out


def plain(texts, libraries):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, written groups)."""
    groups = [groups_of(t, libraries) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
             sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
             ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)) for g, c in zip(groups, links)]


def rows_of(df):
    return [tuple(r[c] for c in alignment.NAMES) for r in df.collect()]


def some_texts():
    rng = random.Random(5)
    letters = "ab eé漢字😀\n\t<|endoftext|>▁ \u0000​ß1234'll"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(150)]
    return [None, "", " ", "a", "<|endoftext|> x", "<s> <0x41>", "x▁y", "same text", "same text", "\r\n\r\n", "word " * 20_000, *made]


def test_against_plain(spark, libraries, monkeypatch):
    texts = some_texts()
    df = spark.createDataFrame([(i if i else None, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, `__text` string, pairs int")
    want = sorted(plain(texts, libraries))
    assert sorted(rows_of(alignment.align(df.repartition(3), *FILES))) == want
    got = alignment.align(df, *FILES, keep=["__text", "pairs", "doc_id"]).collect()
    assert sorted(r["pairs"] for r in got) == list(range(len(texts))) and {r["__text"] for r in got} == {"k"}
    assert [tuple(r[c] for c in alignment.NAMES) for r in sorted(got, key=lambda r: r["pairs"])] == plain(texts, libraries)
    assert rows_of(alignment.align(df.limit(0), *FILES)) == []
    assert sorted(rows_of(alignment.align(df.filter("text is null"), *FILES))) == [(0, 0, 0, 0, 0, 0, "")]


def test_both_encoders_of_a_vocabulary_agree(spark):
    both = alignment._both(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())
    texts = [t for t in some_texts() if t] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.text]
    assert both.quick is not None
    for t in texts:
        assert both._first_ids(t).tolist() == both.first.encode(" " + t, add_special_tokens=False).ids


def test_links_in_slices(libraries, monkeypatch):
    """However few links a join makes at a time, the pairs are the same."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"__text": [t for t in some_texts() if t and len(t) < 1000]})
    both = alignment._both(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())
    want = alignment._aligned(batch, both)
    monkeypatch.setattr(alignment, "LINKS", 7)
    assert alignment._aligned(batch, both).equals(want)


def test_query(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: row for (i, _), row in zip(docs, plain([t for _, t in docs], libraries))}
    got = entry.queries()["op13_token_alignment"](spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        *numbers, written = want[r.doc_id]
        assert [r[c] for c in alignment.NAMES[:-1]] == numbers
        assert r.groups_sha256 == (hashlib.sha256(written.encode()).hexdigest() if written else "")
