"""Alignment of two tokenisers over the same bytes, with corpus-wide counts of linked id pairs.

A text becomes tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) over one byte string,
a space and the text.  Byte places where tokens of both end cut it into groups; every A token of
a group is linked to every B token of it.  An id pair counts once per document that holds it linked.

All of it is Arrow work inside tasks: token lists are flattened with their parent indices, ends are
segmented cumulative sums of token lengths, common ends come from an Acero hash join on document-end
keys, links from a second one on groups, and ``Table.group_by`` counts the pairs of a chunk of
documents.  Spark merges the chunks' counts.  A chunk is one stored row with its distinct pairs; it
gets the corpus-wide count of each of them back, once, and sums them per document.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_counts import PIECES, byte_letters
from .chunks import from_bytes, to_bytes
from .storing import settled
from .words import column, small_batches

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
BATCH_BYTES = 2_000_000
#: Links that one join makes at a time, and distinct (document, pair) rows after which a chunk is closed.
LINKS, CHUNK_PAIRS = 4_000_000, 2_000_000
#: Code points up to which the quicker of two encoders of the same vocabulary is used; it is not made for endless runs.
QUICK_CHARS = 200_000
MARK = "▁"


class _Both:
    """The two tokenisers with the bytes of every token."""

    def __init__(self, byte_spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(byte_spec)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters, spec = byte_letters(), json.loads(byte_spec)
        names = {t["content"] for t in spec.get("added_tokens", [])}
        by_id = sorted((i, t) for t, i in self.first.get_vocab().items())
        a = [b""] * (by_id[-1][0] + 1)
        for i, t in by_id:
            a[i] = t.encode() if t in names else bytes(map(letters.__getitem__, t))
        b = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(MARK, " ").encode())
        self.bytes = pa.array(a, pa.large_binary()), pa.array(b, pa.large_binary())
        self.sizes = tuple(np.asarray(pc.binary_length(x), np.int64) for x in self.bytes)
        self.quick = self._quick(spec, {t: i for i, t in enumerate(a) if t}, names)

    @staticmethod
    def _quick(spec: dict, ranks: dict[bytes, int], names: set[str]):
        """The same vocabulary by ranks, where ids follow the order of the merges; None where they don't."""
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][x + y] for x, y in merges]
        plain = (spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"]
                 and before.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges"))
        if not plain or sorted(set(order)) != order or len(order) + 256 + len(names) != len(ranks):
            return None
        import tiktoken
        special = {n.encode() for n in names}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks={t: i for t, i in ranks.items() if t not in special}, special_tokens={})

    def _first_ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.quick is not None and len(text) <= QUICK_CHARS:
            return self.quick.encode_to_numpy(" " + text, disallowed_special=())
        return np.array(self.first.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """Token ids of every text by A and B; texts without characters have none."""
        a = [self._first_ids(t) for t in texts]
        b = self.second.encode(texts, num_threads=1)
        b = [x if t else [] for x, t in zip(b, texts)]
        flat = (np.concatenate(a).astype(np.int64) if a else np.empty(0, np.int64),
                np.fromiter(chain.from_iterable(b), np.int64, sum(map(len, b))))
        return tuple(pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int64()), pa.array(f))
                     for ids, f in zip((a, b), flat))


@lru_cache(maxsize=1)
def _both(byte_spec: str, model: bytes) -> _Both:
    return _Both(byte_spec, model)


def _spelt(lists: pa.LargeListArray, token_bytes: pa.Array) -> pa.Array:
    """The joined bytes of every token list."""
    return pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, token_bytes.take(lists.values)), pa.scalar(b"", pa.large_binary()))


def _only(lists: pa.LargeListArray, keep: np.ndarray) -> pa.LargeListArray:
    """The lists with those emptied that are not kept."""
    lengths = np.where(keep, np.diff(np.asarray(lists.offsets)), 0)
    flat = lists.values.filter(pa.array(keep).take(pc.list_parent_indices(lists)))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int64()), flat)


def _ends(lists: pa.LargeListArray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(document of every token, byte place at which it ends): a cumulative sum cut at the documents."""
    doc = pc.list_parent_indices(lists)
    total = np.concatenate(([0], np.asarray(pc.cumulative_sum(pa.array(sizes[np.asarray(lists.values)])), np.int64)))
    before = total[np.asarray(lists.offsets)]
    return doc, pa.array(total[1:] - before[np.asarray(doc)])


def _groups(a: pa.LargeListArray, b: pa.LargeListArray, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of every A token, of every B token, document of every group); a group ends where both end."""
    tables = []
    for name, lists, size in (("a", a, sizes[0]), ("b", b, sizes[1])):
        doc, end = _ends(lists, size)
        key = pc.add(pc.multiply(doc.cast(pa.int64()), 1 << 40), end)
        tables.append(pa.table({"key": key, name: pa.array(np.arange(len(key)))}))
    met = tables[0].join(tables[1], keys="key", join_type="inner", use_threads=False)
    out = []
    for name, lists in (("a", a), ("b", b)):
        last = np.zeros(len(lists.values), np.int64)
        last[met[name].to_numpy()] = 1
        out.append(np.cumsum(last) - last)
        if name == "a":
            owner = np.asarray(pc.list_parent_indices(lists))[last > 0]
    return out[0], out[1], owner


def _tally(group: np.ndarray, ids: np.ndarray, name: str) -> pa.Table:
    """(group, id, how often), in order of groups."""
    rows = pa.table({"group": group, name: ids}).group_by(["group", name], use_threads=False).aggregate([([], "count_all")])
    return rows.rename_columns(["group", name, f"n_{name}"]).sort_by("group")


def _pairs(a: pa.Table, b: pa.Table, owner: np.ndarray) -> pa.Table:
    """(doc, pair, links) from the tallied groups: distinct id pairs (A's id in the upper 32 bits) of every document."""
    if not a.num_rows:
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    wide = np.bincount(b["group"].to_numpy(), minlength=len(owner))[a["group"].to_numpy()]
    made = np.cumsum(wide)
    cuts = np.unique(np.searchsorted(made, np.arange(0, int(made[-1]) + LINKS, LINKS)))
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = a.slice(lo, hi - lo)
        groups = part["group"].to_numpy()
        others = b["group"].to_numpy()
        near = b.slice(x := np.searchsorted(others, groups[0]), np.searchsorted(others, groups[-1], side="right") - x)
        met = part.join(near, keys="group", join_type="inner", use_threads=False)
        rows = pa.table({
            "doc": owner[met["group"].to_numpy()].astype(np.int64),
            "pair": pc.bit_wise_or(pc.shift_left(met["a"], 32), met["b"]), "links": pc.multiply(met["n_a"], met["n_b"])})
        found.append(_summed(rows))
    return _summed(pa.concat_tables(found)) if len(found) > 1 else found[0]


def _summed(rows: pa.Table) -> pa.Table:
    return (rows.group_by(["doc", "pair"], use_threads=False).aggregate([("links", "sum")])
            .rename_columns(["doc", "pair", "links"]))


def _joined(ids: pa.Array, group: np.ndarray, groups: int) -> pa.Array:
    """Decimal ids of every group, comma between."""
    at = pa.array(np.searchsorted(group, np.arange(groups + 1)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(at, ids.cast(pa.large_string())), pa.scalar(",", pa.large_string()))


def _written(a, b, group_a, group_b, owner: np.ndarray, docs: int) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` per document."""
    each = pc.binary_join_element_wise(_joined(a.values, group_a, len(owner)), _joined(b.values, group_b, len(owner)),
                                       pa.scalar("|", pa.large_string()))
    at = pa.array(np.searchsorted(owner, np.arange(docs + 1)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(at, each), pa.scalar(";", pa.large_string()))


def _aligned(batch: pa.RecordBatch, both: _Both) -> pa.RecordBatch:
    """Counts, written groups and distinct pairs of every document of a batch."""
    texts = pc.fill_null(column(batch, "__text").cast(pa.large_string()), "")
    lists = both.encode(texts.to_pylist())
    whole = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    sound = np.asarray(pc.greater(pc.binary_length(texts), 0))
    for x, token_bytes in zip(lists, both.bytes):
        sound = sound & np.asarray(pc.equal(_spelt(x, token_bytes), whole))
    a, b = (_only(x, sound) for x in lists)
    n = batch.num_rows
    group_a, group_b, owner = _groups(a, b, both.sizes)
    links = np.zeros(len(owner), np.int64)
    if len(owner):
        links = np.bincount(group_a, minlength=len(owner)) * np.bincount(group_b, minlength=len(owner))
    pairs = _pairs(_tally(group_a, np.asarray(a.values), "a"), _tally(group_b, np.asarray(b.values), "b"), owner)
    order = np.lexsort((pairs["pair"].to_numpy(), pairs["doc"].to_numpy()))
    at = pa.array(np.searchsorted(pairs["doc"].to_numpy()[order], np.arange(n + 1)), pa.int32())
    pair_lists = [pa.ListArray.from_arrays(at, pa.array(pairs[c].to_numpy()[order])) for c in ("pair", "links")]
    per_doc = np.bincount(owner, weights=links, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
    kept = [x for x in batch.schema.names if x != "__text"]
    return pa.RecordBatch.from_arrays(
        [column(batch, x) for x in kept]
        + [pa.array(np.diff(np.asarray(a.offsets))), pa.array(np.diff(np.asarray(b.offsets))),
           pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(per_doc),
           _written(a, b, group_a, group_b, owner, n).cast(pa.string()), *pair_lists],
        names=kept + ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])


def _chunk(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    """One row for some documents: their columns with pairs as places in the chunk's sorted pairs, and these with their counts."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    lists = rows["pairs"].combine_chunks()
    tally = (pa.table({"pair": lists.flatten()}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair"))
    pairs = tally["pair"].to_numpy()
    where = np.searchsorted(pairs, lists.flatten().to_numpy()).astype(np.int32)
    coded = pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32()), pa.array(where))
    rows = rows.set_column(rows.schema.get_field_index("pairs"), "pairs", coded)
    at = pa.array([0, len(pairs)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), pa.array([to_bytes(rows.to_batches()[0])], pa.binary()),
         pa.ListArray.from_arrays(at, pa.array(pairs)), pa.ListArray.from_arrays(at, pa.array(tally["count_all"].to_numpy()))],
        names=["chunk", "rows", "pairs", "n"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    pairs = number = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            pairs += len(column(batch, "pairs").flatten())
        if pairs >= CHUNK_PAIRS:
            yield _chunk(held, number)
            held, pairs, number = [], 0, number + 1
    if held:
        yield _chunk(held, number)


def _finished(names: list[str]):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = from_bytes(chunks["rows"][0].as_py())
        order = np.argsort(answers["pair"].to_numpy())
        # An answer per (chunk, pair), in the order of the chunk's pairs.
        count, best = answers["count"].to_numpy()[order], answers["best"].to_numpy(zero_copy_only=False)[order]
        lists = rows["pairs"].combine_chunks()
        at, pair = np.asarray(lists.offsets), np.asarray(lists.values)
        links = np.asarray(rows["links"].combine_chunks().values)

        def sums(values: np.ndarray) -> pa.Array:
            total = np.concatenate(([0], np.cumsum(values)))
            return pa.array(total[at[1:]] - total[at[:-1]])
        extra = {"n_best": sums(links * best[pair]) if len(pair) else sums(links), "count_sum": sums(links * count[pair]) if len(pair) else sums(links)}
        return pa.table({n: extra[n] if n in extra else rows[n] for n in names})
    return run


def align(df: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
          groups: Callable[[Column], Column] = lambda written: written) -> DataFrame:
    """(``id_col``, kept columns, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``) for every row.

    ``groups`` is the alignment written as ``a1,a2|b1;a3|b2,b3`` with the ids of A and B in order.  The parameter of that
    name may replace it by an expression of it (a hash, say) before anything is stored.  ``n_best`` counts
    the links whose pair is in most documents among the pairs of its A id, ties included; ``count_sum`` adds the pairs' counts over all links.

    Vocabulary files are read on the driver and sent to the tasks (a few MB).  Strings of special tokens in texts are plain text.
    Null and empty texts, and texts that the tokens of A or of B do not spell, have no tokens, zeros and an empty ``groups``.
    Repeated rows and null ids are documents of their own and count as such.  A very long text is encoded whole in one task.
    An empty table gives an empty result; columns that are not named are not read.
    """
    keep = [c for c in dict.fromkeys(keep) if c != id_col]
    if set(keep) & set(NAMES):
        raise ValueError(f"kept columns clash with result columns: {sorted(set(keep) & set(NAMES))}")
    with open(byte_vocabulary, encoding="utf-8") as file, open(piece_model, "rb") as model:
        shared = df.sparkSession.sparkContext.broadcast((file.read(), model.read()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(*shared.value)
        for batch in small_batches(batches, "__text", BATCH_BYTES):
            yield _aligned(batch, both)

    # Kept columns are numbered on the way, so that their names cannot clash with those used here.
    given = [id_col, *keep]
    rows = df.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(given)], F.col(f"`{text_col}`").alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    counts = "n_a long, n_b long, n_groups long, n_links long"
    found = rows.mapInArrow(encoded, f"{kinds}, {counts}, groups string, pairs array<long>, links array<long>").withColumn("groups", groups(F.col("groups")))
    written = found.schema["groups"].dataType.simpleString()
    table = settled(found.mapInArrow(_chunks, "chunk long, rows binary, pairs array<long>, n array<long>"), "alignment-chunks")
    asked = table.select(F.col("chunk").alias("of"), F.inline(F.arrays_zip("pairs", "n"))).withColumnRenamed("pairs", "pair")
    total = settled(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts").withColumn("a", F.shiftright("pair", 32))
    most = total.groupBy("a").agg(F.max("count").alias("most"))
    known = total.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("of", "pair").join(known, "pair")
    names = [f"__c{i}" for i in range(len(given))] + ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    done = (table.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("of"))
            .applyInArrow(_finished(names), f"{kinds}, {counts}, n_best long, count_sum long, groups {written}"))
    return done.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(given)], *NAMES)
