import random

from cohortlens.llm.snapshots import render_maximal
from tests.compare import compare
from tests.conftest import SMALL


def test_query_matches_sql(spark, duck):
    assert compare(spark, duck, SMALL, "op3_chat_snapshots") is None


def test_random_logs(spark):
    rng = random.Random(11)
    logs = {}
    for i in range(150):
        base = list(rng.choice(list(logs.values()))) if logs and rng.random() < 0.7 else []
        base = base[:rng.randint(0, len(base))] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(0 if base else 1, 3))]
        logs[i] = tuple(base) or (("user", "a"),)
    rows = [(i, t, r, s) for i, turns in logs.items() for t, (r, s) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:20], "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in render_maximal(df).collect()}
    whole = set(logs.values())
    top = {t for t in whole if not any(len(o) > len(t) and o[:len(t)] == t for o in whole)}
    want = {min(i for i, x in logs.items() if x == t): (len(t), sum(x == t for x in logs.values())) for t in top}
    assert got == want


def test_edges(spark):
    rows = [(1, 0, "user", "hi <|user|> x"), (1, 0, "user", "hi <|user|> x"), (1, 1, None, None), (2, 0, "user", "hi <|user|> x"), (3, None, "user", "z" * 90_000),
            (None, 0, "user", "lost"), (4, 5, "user", ""), (5, 5, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' conv", "1 pos", "2 rendered")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in render_maximal(df).collect()}
    assert got == {1: (2, 1, "<|user|>\nhi < |user|> x\n<|unknown|>\n\n<|end|>"), 3: (1, 1, "<|user|>\n" + "z" * 90_000 + "\n<|end|>"),
                   4: (1, 1, "<|user|>\n\n<|end|>"), 5: (1, 1, "<|user|>\n\n<|end|>")}
    assert render_maximal(df.limit(0)).count() == 0
