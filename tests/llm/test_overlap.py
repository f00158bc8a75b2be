import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cohortlens.llm.components import components
from cohortlens.llm import packing
from cohortlens.llm.overlap import LOOSE, SKETCH, _deal, candidates, canopies, shingles, similar_groups, with_codes
from tests.conftest import SMALL
from tests.llm import brute


def shingle_set(text):
    w = brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows, least=Fraction(4, 5)):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
              if (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))]
    return brute.components(ids, linked)


def smallest(df):
    rows = df.collect()
    first = {}
    for r in rows:
        first[bytes(r.group)] = min(r.doc_id, first.get(bytes(r.group), r.doc_id))
    return {r.doc_id: first[bytes(r.group)] for r in rows}


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.random()}"
    return out


def test_groups_match_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(1)
    for n in range(60):  # similarities from about 0.6 to 1
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 5, 40, 300]))]
        rows += [(10_000 + 10 * n + k, " ".join(edited(rng, base, len(base) * k // 60))) for k in range(4)]
    rows += [(20_000, None), (20_001, " \n"), (20_002, ""), (20_003, "A b C d E f"), (20_004, "a  B c D e F")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert smallest(similar_groups(df)) == plain(rows)
    assert smallest(similar_groups(df, block=100)) == plain(rows)  # every component of some texts in cells of pairs of blocks
    assert smallest(similar_groups(df, entries=500)) == plain(rows)  # codes in many parts and cells
    assert similar_groups(df.limit(0)).count() == 0


def test_boilerplate_is_no_component(spark):
    """4,000 texts that share 30 per cent of their shingles with each other meet in buckets and must not grow together."""
    rng = random.Random(3)
    shared = " ".join(f"b{i}" for i in range(50))
    rows = [(i, shared + " " + " ".join(f"w{rng.random()}" for _ in range(50))) for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    coded = with_codes(df.select("doc_id", F.col("text").alias("__text")), 5, 42).withColumn("node", F.xxhash64("key"))
    sizes = components(candidates(coded)).groupBy("root").count()
    assert (sizes.agg(F.max("count")).first()[0] or 0) <= 20
    assert similar_groups(df).select("group").distinct().count() == 4_000


def test_a_code_that_different_texts_share(spark):
    """One code in all classes, no two of them alike but for planted pairs: cells of two blocks bound what a task holds, and no pair is lost."""
    rng = np.random.default_rng(8)
    sketch = rng.integers(-1 << 63, 1 << 63, (1_500, SKETCH // 64))
    sketch[1::3] = sketch[::3] ^ 1  # close to the text before it
    rows = [(i, [7] + [100 * i + k for k in range(31)], s) for i, s in enumerate(sketch.tolist())]
    df = spark.createDataFrame(rows, "node long, codes array<long>, sketch array<long>").repartition(3)
    wanted = {(i, i + 1) for i in range(0, 1_500, 3)}
    for entries in (150, 10_000_000):
        assert {(r.a, r.b) for r in candidates(df, entries).collect()} == wanted
    sent = [r for f in _deal(2, {1: 5})([df.toPandas()]) for r in f.itertuples()]
    assert {(r.part, r.block, r.blocks) for r in sent} == {(0, 0, 1)} | {(1, b, 5) for b in range(5)}
    assert max(len(packing.unpack(r.payload)[0]) for r in sent if r.part) < 2 * (1_500 * 32) // 2 // 5


def test_recall_at_stated_similarities(spark):
    """Planted pairs of 0.80 to 0.95 are all found."""
    rows, wanted = [], set()
    for n in range(400):
        base = [f"v{n}x{i}" for i in range(1_004)]  # 1,000 shingles; k edits far apart change 5 k of them
        edits = (14, 10, 5, 22)[n % 4]  # similarity about 0.87, 0.90, 0.95 and 0.80
        other = list(base)
        for at in range(edits):
            other[(at + 1) * 1_000 // (edits + 1)] = f"e{n}x{at}"
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
        assert len(shingle_set(rows[-1][1]) & shingle_set(rows[-2][1])) == 1_000 - 5 * edits
        wanted.add(2 * n)
    got = smallest(similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert set(got.values()) == wanted


def test_a_large_group_of_near_copies(spark):
    """Every copy differs from the others; a task that deals codes out keeps what must travel, and cells of blocks find the rest."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert set(smallest(similar_groups(df, block=60_000)).values()) == {0}


def test_canopies_match_their_rule():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (5, SKETCH // 64)).astype(np.uint64)
    sketch = base[rng.integers(0, 5, 200)] ^ (np.uint64(1) << rng.integers(0, 64, (200, SKETCH // 64)).astype(np.uint64))
    codes = rng.integers(0, 40, 200).astype(np.uint64)
    a, b, left = canopies(codes, sketch, LOOSE, 4)
    far = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(-1)
    links, gone = set(), set()
    for i in range(200):
        if i not in gone:
            near = [j for j in range(i + 1, 200) if codes[j] == codes[i] and j not in gone]
            links |= {(i, j) for j in near if far[i, j] <= LOOSE}
            gone |= {j for j in near if far[i, j] <= 4}
    assert set(zip(a.tolist(), b.tolist())) == links and set(np.flatnonzero(~left).tolist()) == gone
    assert len(canopies(codes[:0], sketch[:0], LOOSE, 4)[0]) == 0


def test_shingles_of_a_slice():
    texts = [f"É{i} B c D e f g ü{i}" for i in range(40)] + [None, "", "x"]
    want = shingles(pa.array(texts[20:]), 5)
    assert [x.tolist() for x in shingles(pa.array(texts).slice(20), 5)] == [x.tolist() for x in want]
    assert [len(x) for x in want[-4:]] == [4, 0, 0, 1]


def test_edited_copies_go(spark):
    """A few edited words in a text of 400, similarity 0.9 or so: the old rule of 4 bits kept most."""
    rng = random.Random(2)
    rows = []
    for n in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(2 * n, " ".join(base), "en", "s", 0), (2 * n + 1, " ".join(edited(rng, base, 5)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, docs, SMALL).collect()) == [2 * n for n in range(60)]


def test_a_shared_majority_shingle_is_no_copy(spark):
    """One repeated shingle decides every bit of a fingerprint; the sets have little in common."""
    texts = ["same " * 60 + " ".join(f"{x}{i}" for i in range(40)) for x in "ab"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.near_copies(spark, docs, SMALL).count() == 2


def test_repeated_and_null_ids_keep_one_row_of_each_group(spark):
    clean, other, third = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, clean), (1, other), (2, other), (5, other), (None, third), (None, third), (None, clean), (7, None), (None, ""), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, docs, SMALL).collect()]
    assert sorted(got, key=repr) == sorted([(1, clean), (1, other), (None, third), (7, None), (3, "x y")], key=repr)
