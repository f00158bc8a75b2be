"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt into shards of bounded size by a hash.  Every shard gets its graph: layers of fewer and
fewer nodes, each node linked to diverse near ones, and more links where a walk for a node's own vector misses it.  A shard is cut into blocks of query vectors, which walk its own graph and, as links go both
ways, that of every second other shard, so of two shards one is asked for the other; all queries of a block go in step: a beam of the best nodes seen is expanded until it holds no
unexpanded one.  A beam that holds linked vectors only may be too narrow, so it is widened, in the end to the whole shard.
The starting width comes from audits: a bounded sample of queries is compared with all vectors, and the
width doubles until the graphs find the stated share of their links.

Whatever a walk brings is verified by its cosine in double precision.  A block of queries and a shard leave counts
and a spanning star of their linked vectors, never pairs, so a group of m copies costs links in proportion
to the blocks it is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .packing import pack, unpack
from .storing import settled

#: Vectors of a shard and of a query block (by hash, so a few per cent more or less), and of a step of queries.
SHARD, BLOCK, STEP = 8192, 2048, 256
#: From so many shards on they grow, up to so many times the size: a walk takes little longer in a larger shard.
FEW, LARGER = 8, 4
#: Links of a new node, most links of a node, width of the beam while building.
DEGREE, MOST, BUILD = 16, 32, 48
#: A payload is copied to at most so many cells of the grid (query blocks x shards), whatever their number.
GRID = 64
#: Expected size of the audited sample, taken by hash; the share of its links to be found, and the width to begin with.
AUDITED, RECALL, WIDTH = 1024, 0.995, 16


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _diverse(own: np.ndarray, near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (by falling similarity, -1 for none), those closer to the row than to any chosen before;
    free places go to the nearest others."""
    own_vectors = vectors[near]
    between = np.matmul(own_vectors, own_vectors.transpose(0, 2, 1))
    chosen = np.zeros(near.shape, bool)
    real = (near >= 0) & (near != own[:, None])
    for c in range(near.shape[1]):
        covered = (chosen[:, :c] & (between[:, c, :c] > sims[:, c, None])).any(axis=1)
        chosen[:, c] = real[:, c] & ~covered & (chosen.sum(axis=1) < most)
    place = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(real, near, -1), place, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """A hierarchical graph over unit vectors (float32); layer 0 holds all nodes, the layer above the first sixteenth of them, and so on."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors = vectors
        self.layers = layers if layers is not None else []
        if layers is None:
            sizes = [len(vectors)]
            while sizes[-1] > 4 * MOST:
                sizes.append(max(1, sizes[-1] // DEGREE))
            for size in sizes[::-1]:  # from the top down: the layers above lead to where a node belongs
                self.layers.insert(0, np.full((size, MOST), -1, np.int32))
                self._fill(size)
            self._mend()

    def _fill(self, size: int) -> None:
        lo = 0
        while lo < size:
            hi = min(size, max(2 * lo, 2 * MOST), lo + 1024)
            fresh = np.arange(lo, hi)
            within = self.vectors[lo:hi] @ self.vectors[lo:hi].T
            np.fill_diagonal(within, -np.inf)
            k = min(BUILD // 2, hi - lo)
            best = np.argpartition(-within, k - 1, axis=1)[:, :k]
            near, sims = best + lo, np.take_along_axis(within, best, axis=1)
            near = np.where(np.isfinite(sims), near, -1)
            if lo:
                seen, close = self.walk(self.vectors[lo:hi], BUILD, upto=lo)
                near, sims = np.concatenate((near, seen), axis=1), np.concatenate((sims, close), axis=1)
            order = np.argsort(-sims, axis=1)[:, :BUILD]
            near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
            links = _diverse(fresh, near, sims, self.vectors, DEGREE)
            self._link(np.repeat(fresh, DEGREE), links.ravel())
            self._link(links.ravel(), np.repeat(fresh, DEGREE))
            lo = hi

    def _mend(self) -> None:
        """A node that a walk for its own vector misses is linked from the nearest that the walk comes to, in place of their last links."""
        for lo in range(0, len(self.vectors), STEP):
            own = np.arange(lo, min(lo + STEP, len(self.vectors)))
            near = self.walk(self.vectors[own], WIDTH)[0]
            for node in np.flatnonzero(~(near == own[:, None]).any(axis=1)):
                self.layers[0][near[node][near[node] >= 0][:4], -1] = own[node]

    def _link(self, start: np.ndarray, to: np.ndarray) -> None:
        """Add links; a node with too many keeps the diverse ones."""
        table = self.layers[0]
        real = (start >= 0) & (to >= 0)
        pairs = np.unique(np.stack((start[real], to[real]), axis=1), axis=0)
        held = table[pairs[:, 0]] == pairs[:, 1, None]
        pairs = pairs[~held.any(axis=1)]
        nodes, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        for lo in range(0, len(nodes), STEP):
            n, f, c = nodes[lo:lo + STEP], first[lo:lo + STEP], count[lo:lo + STEP]
            if not len(n):
                return
            width = int(c.max())
            more = np.full((len(n), width), -1, np.int64)
            inner = np.arange(width)[None, :] < c[:, None]
            more[inner] = pairs[f[0]:f[-1] + c[-1], 1]
            near = np.concatenate((table[n], more), axis=1)
            sims = np.where(near >= 0, np.matmul(self.vectors[near], self.vectors[n][:, :, None])[:, :, 0], -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2 * MOST]
            near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
            full = (near >= 0).sum(axis=1) > MOST
            table[n[~full]] = near[~full][:, :MOST] if near.shape[1] >= MOST else np.pad(near[~full], ((0, 0), (0, MOST - near.shape[1])), constant_values=-1)
            if full.any():
                table[n[full]] = _diverse(n[full], near[full], sims[full], self.vectors, MOST)

    def walk(self, queries: np.ndarray, width: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the ``width`` best found for every query, by falling similarity; -1 and -inf fill up."""
        top = self.layers[-1]
        size = len(top) if len(self.layers) > 1 or upto is None else upto
        sims = queries @ self.vectors[:size].T
        entry = np.argmax(sims, axis=1)[:, None]
        if len(self.layers) == 1:
            k = min(4, size)
            entry = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        for layer in self.layers[-2:0:-1]:
            entry = self._beam(layer, len(layer), queries, entry, 4)[0]
        return self._beam(self.layers[0], len(self.layers[0]) if upto is None else upto, queries, entry, width)

    def _beam(self, table: np.ndarray, size: int, queries: np.ndarray, entry: np.ndarray, width: int, expand: int = 4):
        n, m = len(queries), min(entry.shape[1], width)
        seen = np.zeros((n, size + 1), bool)  # the last place stands for no node
        seen[:, size] = True
        nodes, sims = np.full((n, width), size), np.full((n, width), -np.inf, np.float32)
        first = np.where((entry[:, :m] >= 0) & (entry[:, :m] < size), entry[:, :m], size)
        nodes[:, :m] = first
        sims[:, :m] = np.where(first < size, np.matmul(self.vectors[np.minimum(first, size - 1)], queries[:, :, None])[:, :, 0], -np.inf)
        np.put_along_axis(seen, first, True, axis=1)
        done = nodes == size
        while True:
            rows = np.flatnonzero(~done.all(axis=1))
            if not len(rows):
                break
            # The beam is kept by falling similarity, so the first open nodes are the best ones.
            open_ = np.argsort(done[rows], axis=1, kind="stable")[:, :expand]
            fresh = ~np.take_along_axis(done[rows], open_, axis=1)
            at = np.take_along_axis(nodes[rows], open_, axis=1)
            part = done[rows]
            np.put_along_axis(part, open_, True, axis=1)
            done[rows] = part
            near = np.where(fresh[:, :, None], table[np.minimum(at, size - 1)], -1).reshape(len(rows), -1).astype(np.int64)
            near = np.sort(np.where((near >= 0) & (near < size), near, size), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = size
            near[np.take_along_axis(seen[rows], near, axis=1)] = size
            seen[rows[:, None], near] = True
            used = np.flatnonzero((near < size).any(axis=0))
            if not len(used):
                continue
            near = near[:, used]
            close = np.matmul(self.vectors[np.minimum(near, size - 1)], queries[rows][:, :, None])[:, :, 0]
            close[near == size] = -np.inf
            all_sims = np.concatenate((sims[rows], close), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            sims[rows] = np.take_along_axis(all_sims, order, axis=1)
            nodes[rows] = np.take_along_axis(np.concatenate((nodes[rows], near), axis=1), order, axis=1)
            done[rows] = np.take_along_axis(np.concatenate((done[rows], near == size), axis=1), order, axis=1)
        return np.where(nodes == size, -1, nodes), sims


def linked(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) with a cosine of at least ``least``, verified on the double-precision unit rows, a step of queries at a time."""
    for lo in range(0, len(queries), STEP):
        asked = np.arange(lo, min(lo + STEP, len(queries)))
        wide = width
        while len(asked):
            # The widest beam is the shard; a widened one that looks at as many links as the shard has vectors gains nothing over it.
            if wide * 8 >= len(exact) or (wide > width and wide * MOST >= len(exact)):
                q, node = np.nonzero(queries[asked] @ exact.T >= least)
                yield asked[q], node
                break
            nodes, sims = graph.walk(queries[asked].astype(np.float32), wide)
            short = (nodes >= 0).all(axis=1) & (sims.min(axis=1) >= least - 1e-4)
            q, at = np.nonzero((sims >= least - 1e-4) & (nodes >= 0) & ~short[:, None])
            node = nodes[q, at]
            near = np.einsum("ij,ij->i", queries[asked[q]], exact[node]) >= least
            yield asked[q[near]], node[near]
            asked, wide = asked[short], wide * 8


def _star(pairs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) from every linked place to the smallest place of its component; places stand for ``ids``, which may repeat."""
    distinct, place = np.unique(ids, return_inverse=True)
    label = np.arange(len(distinct))
    while True:
        before = label.copy()
        for a, b in pairs:
            a, b = place[a], place[b]
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return distinct[moved], distinct[label[moved]]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as rows, shorter ones filled with zeros; single precision where it holds them exactly."""
    lengths = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(vectors.flatten())
    with np.errstate(over="ignore"):
        single = out.astype(np.float32)
    return single if (single.astype(np.float64) == out).all() else out


def _indexed(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("order").combine_chunks()
        raw = _matrix(table["vec"].chunk(0), width)
        graph = Graph(unit_rows(raw).astype(np.float32))
        payload = pack(table["cid"].to_numpy(), table["copies"].to_numpy(), raw.ravel(), np.array([len(x) for x in graph.layers]),
                       *[x.ravel() for x in graph.layers])
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "index": pa.array([payload], pa.binary())})
    return run


def _blocked(width: int):
    def run(table: pa.Table) -> pa.Table:
        raw = _matrix(table["vec"].combine_chunks(), width)
        payload = pack(table["cid"].to_numpy(), table["copies"].to_numpy(), raw.ravel())
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "asked": pa.array([payload], pa.binary())})
    return run


class _Cells:
    """Decodes (index, asked) rows; an index that comes again is kept."""

    def __init__(self, width: int):
        self.width, self.last = width, None

    def read(self, shard: int, index: bytes, asked: bytes):
        if shard != self.last:
            self.ids, self.copies, raw, sizes, *layers = unpack(index)
            self.exact = unit_rows(raw.reshape(-1, self.width))
            self.graph = Graph(self.exact.astype(np.float32), [x.reshape(n, MOST) for n, x in zip(sizes, layers)])
            self.last = shard
        ids, copies, raw = unpack(asked)
        return ids, copies, unit_rows(raw.reshape(-1, self.width))


def _audited(width: int, least: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(width)
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, queries = cells.read(row["shard"], row["index"], row["asked"])
                # A query's own vector is no link.
                own = ids[:, None] == cells.ids[None, :]
                links = int(((queries @ cells.exact.T >= least) & ~own).sum())
                found = sum(int((ids[q] != cells.ids[n]).sum()) for q, n in linked(cells.graph, cells.exact, queries, least, beam))
                yield pa.RecordBatch.from_pydict({"links": pa.array([links], pa.int64()), "found": pa.array([found], pa.int64())})
    return run


def _searched(width: int, least: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(width)
        for batch in batches:
            for row in batch.to_pylist():
                ids, copies, queries = cells.read(row["shard"], row["index"], row["asked"])
                count, back = np.zeros(len(ids), np.int64), np.zeros(len(cells.ids), np.int64)
                pairs = []
                for q, node in linked(cells.graph, cells.exact, queries, least, beam):
                    other = ids[q] != cells.ids[node]
                    q, node = q[other], node[other]
                    np.add.at(count, q, cells.copies[node])
                    if row["both"]:
                        np.add.at(back, node, copies[q])
                    pairs.append((q, node + len(ids)))
                    if sum(len(x) for x, _ in pairs) > 2_000_000:
                        pairs = [_placed(pairs, len(ids) + len(cells.ids))]
                has, had = np.flatnonzero(count), np.flatnonzero(back)
                a, b = _star(pairs, np.concatenate((ids, cells.ids)))
                # One table for both results: links of a vector (b is null), and star links (n is null).
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.concatenate((ids[has], cells.ids[had], a)), pa.int64()),
                    "b": pa.concat_arrays([pa.nulls(len(has) + len(had), pa.int64()), pa.array(b, pa.int64())]),
                    "n": pa.concat_arrays([pa.array(count[has]), pa.array(back[had]), pa.nulls(len(a), pa.int64())])})
    return run


def _placed(pairs: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with at most one pair per place."""
    return _star(pairs, np.arange(size))


def shard_number(n: int) -> int:
    """Shards for ``n`` vectors."""
    return max(1, ceil(n / (LARGER * SHARD)), min(FEW, ceil(n / SHARD)))


def _cells(blocks: DataFrame, shards: DataFrame, shard_count: int, per: int = 0) -> DataFrame:
    """Every query block beside every shard, by an equality join on cells of a grid whose sides have ``GRID`` groups at most.

    With ``per``, the blocks are cuts of the shards, so many of each: a block meets its own shard, and of two shards one, by turns, has
    the other's blocks.  ``both`` tells that links found there stand for both directions.
    """
    rows = columns = min(GRID, shard_count)
    asked = blocks.select("block", "asked", F.pmod("block", F.lit(rows)).alias("__r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("__k"))
    given = shards.select("shard", "index", F.pmod("shard", F.lit(columns)).alias("__k"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("__r"))
    pairs = asked.join(given, [asked["__r"] == given["__r"], asked["__k"] == given["__k"]])
    if not per:
        return pairs.select("shard", "index", "asked", F.lit(False).alias("both"))
    home, shard = F.expr(f"block div {per}"), F.col("shard")
    turn = (home < shard) == ((home + shard) % 2 == 0)
    return pairs.filter((home == shard) | turn).select("shard", "index", "asked", (home != shard).alias("both"))


def usable(vector: Column) -> Column:
    """True for a vector with finite numbers only, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(``id_col``, ``n_links``, ``component_id``, ``kept``), one row per row of ``df``.

    Rows are linked where a search finds them with a cosine of at least ``least`` (above 0) in double precision; equal vectors always are.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links reach, itself included,
    and ``kept`` tells whether that is the row's own.  ``recall`` is the share of links that the audited sample (``AUDITED`` vectors, by hash)
    must have found; the width of the search doubles until it has.

    Vectors that are null, empty, all zero or hold null or non-finite components link with nothing.  A missing component of a
    shorter vector counts as zero.  Rows that repeat an id count as they are; null ids come last: a component has one only if it has
    no other, and such rows are kept.  Ties at the threshold are links.  An empty table gives an empty result; other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("vec"))
    good = rows.filter(usable(F.col("vec")))
    # Trailing zeros change nothing, so equal vectors of different lengths are one.
    plain = F.expr("slice(vec, 1, size(vec) - coalesce(array_position(transform(reverse(vec), x -> x <> 0), true) - 1, 0))")
    good = good.withColumn("vec", F.transform(plain, lambda x: x + F.lit(0.0)))
    distinct = good.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = settled(distinct.withColumn("cid", F.monotonically_increasing_id()), "hnsw-vectors")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    shard_count = shard_number(n)
    per = max(1, ceil(n / shard_count / BLOCK))
    order = F.xxhash64("cid")
    dealt = classes.select("cid", "copies", "vec", order.alias("order"), F.pmod(order, F.lit(shard_count)).alias("shard"))
    shards = settled(dealt.groupBy("shard").applyInArrow(_indexed(width), "shard long, index binary"), "hnsw-graphs")

    def blocks(block: Column, of: DataFrame = dealt) -> DataFrame:
        return of.select("cid", "copies", "vec", block.alias("block")).groupBy("block").applyInArrow(_blocked(width), "block long, asked binary")

    def cut(count: int) -> Column:
        return F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(count))

    sample = settled(blocks(cut(4), dealt.filter(F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(max(n, 1))) < AUDITED)), "hnsw-audited")
    beam = WIDTH
    while n and beam * 8 < SHARD:
        seen = (_cells(sample, shards, shard_count).mapInArrow(_audited(width, least, beam), "links long, found long")
                .agg(F.sum("links").alias("links"), F.sum("found").alias("found")).first())
        if (seen["found"] or 0) >= recall * (seen["links"] or 0):
            break
        beam *= 2
    cells = _cells(settled(blocks(F.col("shard") * per + cut(per)), "hnsw-queries"), shards, shard_count, per)
    found = settled(cells.mapInArrow(_searched(width, least, beam), "a long, b long, n long"), "hnsw-links")
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    roots = components(found.filter("b is not null").select("a", "b").distinct()).withColumnRenamed("node", "cid")
    named = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(counts, "cid", "left")
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(smallest, "root").select("vec", "component", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    done = good.join(named, "vec").select("id", "n_links", F.col("component"))
    alone = rows.filter(~usable(F.col("vec"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return done.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"),
                                          F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
