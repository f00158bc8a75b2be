import numpy as np
import pytest

import __spark_entry__ as entry
from cohortlens.llm import hnsw
from tests.conftest import SMALL
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, least=0.95):
    """[(id, links, component)] of (id, vector) rows by all pairs; ids may repeat."""
    width = max((len(v) for _, v in rows if v), default=0)
    full = [np.array(list(v) + [0.0] * (width - len(v))) if v and all(x is not None for x in v) else np.zeros(width) for _, v in rows]
    good = [n for n, x in enumerate(full) if np.isfinite(x).all() and x.any()]
    unit = hnsw.unit_rows(np.stack([full[n] for n in good])) if good else np.zeros((0, width))
    near = unit @ unit.T >= least
    near |= (unit[:, None, :] == unit[None, :, :]).all(-1) if len(good) < 300 else False
    np.fill_diagonal(near, False)
    label = brute.components(range(len(rows)), [(good[a], good[b]) for a, b in zip(*np.nonzero(near))])
    links = dict.fromkeys(range(len(rows)), 0) | {good[a]: int(n) for a, n in enumerate(near.sum(1))}
    first = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            first[label[n]] = min(i, first.get(label[n], i))
    return [(i, links[n], first.get(label[n])) for n, (i, _) in enumerate(rows)]


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def copies(rng, base, n, noise):
    return base + noise * rng.normal(size=(n, len(base)))


def test_graph_finds_planted_pairs_and_groups():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(1500, 32))
    rows[500:1000] = rows[:500] + 0.05 * rng.normal(size=(500, 32))
    rows = np.concatenate((rows, copies(rng, rows[7], 700, 0.05)))
    unit = hnsw.unit_rows(rows)
    graph = hnsw.Graph(unit.astype(np.float32))
    assert len(graph.layers) > 1
    want = {(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.95))}
    for width in (16, 64):
        got = [(a, b) for q, n in hnsw.linked(graph, unit, unit, 0.95, width) for a, b in zip(q.tolist(), n.tolist())]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("shard", [64, 8192])
def test_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "BLOCK", 100)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 8))
    rows = [base, base[:60] + 0.08 * rng.normal(size=(60, 8)), copies(rng, base[3], 80, 0.02)]
    chain = [np.cos(a) * np.eye(8)[0] + np.sin(a) * np.eye(8)[1] for a in np.arange(30) * 0.3]  # linked to its neighbours only
    listed = [(i, v.tolist()) for i, v in enumerate(np.concatenate([*rows, chain, base[:20] * 7.0, base[5:6].repeat(9, 0)]))]
    df = spark.createDataFrame([(i, v, 0) for i, v in listed], SCHEMA).repartition(3)
    assert result(hnsw.near_vectors(df)) == sorted(plain(listed), key=str)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0]), (8, [2.0]),
            (None, [3.0, 0.0, -0.0]), (None, [0.0, 1.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [-1.0]), (13, [1.0, 0.2])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as cid", "2 as copies", "3 as vec")
    want = {(7, 4, 7), (8, 4, 7), (None, 4, 7), (10, 1, 10), (11, 1, 10), (12, 0, 12), (13, 4, 7), (None, 0, None)} | {(i, 0, i) for i in range(1, 7)}
    got = result(hnsw.near_vectors(df))
    assert len(got) == len(rows) and set(got) == want
    assert hnsw.near_vectors(df.limit(0)).collect() == []
    assert result(hnsw.near_vectors(df.filter("vec_id < 4"))) == [(i, 0, i) for i in (1, 2, 3)]


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert result(entry.queries()["op12_embedding_near_dedup"](spark, SMALL)) == sorted(plain(rows), key=str)


def test_of_two_shards_one_is_asked_for_the_other(spark):
    blocks = spark.range(12).selectExpr("id block", "cast(cast(id as string) as binary) asked")
    shards = spark.range(6).selectExpr("id shard", "binary('') index")
    got = [(r.shard, int(r.asked) // 2, r.both) for r in hnsw._cells(blocks, shards, 6, per=2).collect()]
    assert len(got) == 2 * (6 + 15)
    assert {frozenset(x[:2]) for x in got} == {frozenset((a, b)) for a in range(6) for b in range(6)}
    assert all(both == (a != b) for a, b, both in got)


def test_shards_grow_once_there_are_some():
    assert [hnsw.shard_number(n) for n in (0, 1, 8192, 8193, 51_282, 262_144, 262_145, 600_000)] == [1, 1, 1, 2, 7, 8, 9, 19]


def test_a_beam_is_not_widened_to_as_many_links_as_the_shard_has_vectors():
    widths = []

    class Linked:
        def walk(self, queries, width):
            widths.append(width)
            return np.arange(width)[None, :].repeat(len(queries), 0), np.ones((len(queries), width))

    got = [len(q) for q, _ in hnsw.linked(Linked(), np.ones((9000, 1)), np.ones((3, 1)), 0.95, 16)]
    assert sum(got) == 3 * 9000 and widths == [16, 128]


def test_a_node_that_its_own_walk_misses_is_linked_again():
    def missed(graph):
        near = np.concatenate([graph.walk(graph.vectors[lo:lo + 256], hnsw.WIDTH)[0] for lo in range(0, len(graph.vectors), 256)])
        return np.flatnonzero(~(near == np.arange(len(near))[:, None]).any(axis=1)).tolist()

    graph = hnsw.Graph(hnsw.unit_rows(np.random.default_rng(4).normal(size=(2000, 32))).astype(np.float32))
    for node in (1500, 1900):
        graph.layers[0][graph.layers[0] == node] = -1
    assert missed(graph) == [1500, 1900]
    graph._mend()
    assert missed(graph) == []
