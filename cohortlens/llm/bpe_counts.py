"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair encoding.

Inside one piece of the pre-tokeniser, the encoding of a prefix ends in exactly one token,
and that token follows the encoding of a shorter prefix of the same piece.  So one pass over
the bytes stores, per prefix, its last token and its count: ``count[i] = count[i - len(t)] + 1``
for the one token ``t`` that ends at ``i`` and may follow the last token before it.  Two tokens
may follow each other when byte-pair encoding leaves their joined bytes as these two.

Pieces recur, so a task keeps their tables; a document is a running sum over its pieces.
Truncation and budget questions are lookups in the table, nothing is encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import column, small_batches

# Fixed value: how byte-level vocabularies split text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Piece tables that a task keeps at most; beyond it they are built anew.
KEPT = 1_000_000
LONGEST_KEPT = 64


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte in a byte-level vocabulary: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Totals(dict):
    """Token count of whole pieces, built when first asked for and forgotten when there are too many."""

    def __init__(self, counts):
        super().__init__()
        self.counts = counts

    def __missing__(self, piece: str) -> int:
        total = self.counts(piece.encode())[-1]
        if len(piece) <= LONGEST_KEPT:
            if len(self) > KEPT:
                self.clear()
            self[piece] = total
        return total


class PrefixCounter:
    """Counts for one vocabulary file of kind byte-level BPE (``tokenizers`` JSON)."""

    def __init__(self, spec: dict):
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = (spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"]
                 and before.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout")
                 and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix"))
        if not plain:
            raise ValueError("only byte-level BPE without normaliser is supported")
        letters = byte_letters()
        known = set(model["vocab"])
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in known:
                self.rank[bytes(map(letters.__getitem__, a)), bytes(map(letters.__getitem__, b))] = i
        specials = [t for t in spec.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in specials):
            raise ValueError("added tokens with side conditions are not supported")
        names = {t["content"] for t in specials}
        # Only tokens that encoding leaves whole can be the last of a prefix; single bytes always are.
        tokens = {bytes(map(letters.__getitem__, t)) for t in known - names}
        self.tokens = {t for t in tokens if len(t) == 1 or self._merged(t) == (t,)} | {bytes([b]) for b in range(256)}
        self.longest = max(map(len, self.tokens))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(names, key=len, reverse=True)))) if names else None
        self.pieces = regex.compile(PIECES)
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.tables: dict[str, np.ndarray] = {}
        self.totals = _Totals(self.byte_counts)
        self.blank = regex.compile(r"\s+")

    def _merged(self, raw: bytes) -> tuple[bytes, ...]:
        """Byte-pair encoding of a short byte string: the lowest-ranked pair first, leftmost among equals."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def _may_follow(self, last: bytes, token: bytes) -> bool:
        key = (last, token)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 4 * KEPT:
                self.follows.clear()
            known = self.follows[key] = self._merged(last + token) == key
        return known

    def byte_counts(self, raw: bytes) -> list[int]:
        """Token count of every byte prefix of one piece, the empty one first."""
        counts, last, tokens = [0], [b""], self.tokens
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                token = raw[start:end]
                if token in tokens and (not start or self._may_follow(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def piece_table(self, piece: str) -> np.ndarray:
        """Token count of every code point prefix of one piece, the empty one first.

        A prefix of a contraction such as ``'l`` of ``'ll`` is no piece itself; it counts as its own pieces.
        """
        table = self.tables.get(piece)
        if table is None:
            if piece[0] == "'" and len(piece) > 2 and self.pieces.findall(piece[:2]) != [piece[:2]]:
                table = np.array([self.plain_total(piece[:i]) for i in range(len(piece) + 1)], np.int64)
            else:
                counts = np.array(self.byte_counts(piece.encode()), np.int64)
                table = counts[np.cumsum([0, *(len(c.encode()) for c in piece)])]
            if len(piece) <= LONGEST_KEPT:
                if len(self.tables) > KEPT // 8:
                    self.tables.clear()
                self.tables[piece] = table
        return table

    def _plain_table(self, text: str) -> np.ndarray:
        out, before, blank, blank_before = [np.zeros(1, np.int64)], 0, "", 0
        for piece in self.pieces.findall(text):
            table = before + self.piece_table(piece)
            if blank and self.blank.match(piece[0]):
                # Cut right after this character, it would belong to the run of white space before it.
                table[1] = blank_before + self.totals[blank + piece[0]]
            out.append(table[1:])
            blank, blank_before = (piece, before) if self.blank.fullmatch(piece) else ("", 0)
            before += self.totals[piece]
        return np.concatenate(out)

    def table(self, text: str) -> np.ndarray:
        """Token count of every code point prefix of a whole text, the empty one first."""
        out, before, at = [np.zeros(1, np.int64)], 0, 0
        for stop, special in self._cuts(text):
            # Inside a special string, the text so far is ordinary text.
            table = before + self._plain_table(text[at:stop] + special[:-1])
            out.append(table[1:])
            before += self.plain_total(text[at:stop])
            if special:
                before += 1
                out.append(np.array([before]))
            at = stop + len(special)
        return np.concatenate(out)

    def _cuts(self, text: str) -> Iterator[tuple[int, str]]:
        if self.specials is not None:
            for m in self.specials.finditer(text):
                yield m.start(), m.group()
        yield len(text), ""

    def plain_total(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.pieces.findall(text)))

    def within(self, text: str, limit: int) -> tuple[int, int]:
        """(token count, largest number of code points whose count is within ``limit``).

        Every prefix that ends in a piece has at least the tokens before that piece (or before the white space
        that ends there), so only the few pieces around the limit need their tables.
        """
        total, at = 0, 0
        safe = (0, 0)  # last piece start after no white space, within the limit: place and count
        reach = 0      # end of the last piece that can hold a prefix within the limit
        low = 0
        for stop, special in self._cuts(text):
            pieces = self.pieces.findall(text[at:stop])
            place = at
            for i, piece in enumerate(pieces):
                if low > limit:
                    total += sum(map(self.totals.__getitem__, pieces[i:]))
                    break
                if low == total <= limit:
                    safe = (place, total)
                place += len(piece)
                reach = place
                # A run of white space can take the first character of the next piece.
                low = total if self.blank.match(piece) and self.blank.fullmatch(piece) else total + self.totals[piece]
                total += self.totals[piece]
            at = stop + len(special)
            if special:
                reach = at if low <= limit else reach
                total += 1
                low = total
        if total <= limit:
            return total, len(text)
        table = safe[1] + self.table(text[safe[0]:reach])
        return total, safe[0] + int(np.flatnonzero(table <= limit)[-1])


@lru_cache(maxsize=2)
def counter(spec: str) -> PrefixCounter:
    return PrefixCounter(json.loads(spec))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fits_chars``) for every row.

    ``vocabulary`` is the path of a byte-level BPE file on the driver (its text, a few MB at most, goes with the tasks).
    ``fits_chars`` is the longest prefix, in code points, whose exact count is within ``limit``.
    Null counts as the empty text: zero tokens.  Repeated rows give repeated rows; an empty table gives an
    empty result; other columns are not read.
    """
    spec = df.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(spec.value)
        for batch in small_batches(batches, "__text"):
            texts = [t or "" for t in column(batch, "__text").to_pylist()]
            found = [own.within(t, limit) for t in texts]
            tokens = np.array([n for n, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "__id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens),
                 pa.array(tokens > limit), pa.array([k for _, k in found], pa.int64())],
                names=["__id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])
    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .mapInArrow(run, f"__id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
            .withColumnRenamed("__id", id_col))


def prefix_tables(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``counts``): the whole table of every text, ``counts[i]`` for its first ``i`` code points."""
    spec = df.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(spec.value)
        for batch in small_batches(batches, "__text", 2_000_000):
            tables = [own.table(t or "") for t in column(batch, "__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array([t.tolist() for t in tables], pa.list_(pa.int64()))],
                                             names=["__id", "counts"])
    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .mapInArrow(run, f"__id {kind}, counts array<long>").withColumnRenamed("__id", id_col))
