import math
import random
from collections import Counter

from cohortlens.llm.backoff import backoff_scores
from tests.compare import compare
from tests.conftest import SMALL
from tests.llm import brute


def plain(rows, order, backoff=0.4, least=2):
    counts = Counter()
    for _, text in rows:
        w = brute.words(text)
        for n in range(1, order + 1):
            counts.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total = sum(v for k, v in counts.items() if len(k) == 1)
    out = []
    for i, text in rows:
        w, score = brute.words(text), 0.0
        for at in range(len(w)):
            longest = min(order, at + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[at - n + 1:at + 1])
                if n == 1 or counts[gram] >= least:
                    score += math.log(backoff) * (longest - n) + math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total))
                    break
        out.append((str(i), len(w), round(score, 6)))
    return sorted(out)


def test_query_matches_sql(spark, duck):
    assert compare(spark, duck, SMALL, "op5_backoff_scores") is None


def test_orders_and_edges(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, "a b c"), (7, "a b c"), (7, "a b c"), (70, None), (71, " \n"), (72, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 chunk", "2 log_score").repartition(5)
    for order in (1, 2, 3, 5):
        got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in backoff_scores(df, order=order, keep=["chunk"]).collect())
        want = plain(rows, order)
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want))
    assert backoff_scores(df.limit(0)).count() == 0
