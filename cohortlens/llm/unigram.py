"""Encoding into the pieces of a SentencePiece file by Viterbi search, and decoding back.

The pieces stand in a double-array trie.  A text is normalised as the library does without
rules (space becomes the marker U+2581, one marker in front), cut where no piece can cross, and
each distinct unit gets the segmentation with the highest sum of log scores.  A
character without piece becomes its UTF-8 bytes.  All new units of a batch are searched
together: position by position, numpy walks the trie for every unit at once.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import column, small_batches

MARK = "▁"
#: Fixed value: an unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Distinct units that a task keeps.
KEPT = 200_000
#: Units of more bytes are searched one by one.
TOGETHER = 256


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", each_byte)


class DoubleArray:
    """Double-array trie of byte strings: child ``c`` of ``node`` is ``base[node] + c + 1`` if ``check`` there is ``node``."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key in sorted(keys):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][byte]
            value[node] = keys[key]
        size = 2 * len(children) + 1024
        base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        place, low, top, queue = {0: 0}, 1, 1, [0]
        out[0] = value[0]
        for node in queue:
            kids = children[node]
            if not kids:
                continue
            codes = np.array(list(kids), np.int64) + 1
            while low < size and not free[low]:
                low += 1
            while max(top, low + 4096) + 600 > size:
                base, check, out = (np.concatenate((a, np.full(size, f, np.int32))) for a, f in ((base, 0), (check, -1), (out, -1)))
                free = np.concatenate((free, np.ones(size, bool)))
                size = len(free)
            # First fit among the lowest free slots; if there is none, behind everything that is taken.
            least = int(codes.min())
            tries = np.flatnonzero(free[low:low + (1 if len(codes) == 1 else 4096)]) + low - least
            tries = tries[tries > 0]
            fits = np.flatnonzero(free[tries[:, None] + codes].all(1)) if len(tries) else tries
            start = int(tries[fits[0]]) if len(fits) else max(1, top - least + 1)
            top = max(top, start + int(codes.max()) + 1)
            mine = place[node]
            base[mine] = start
            for byte, kid in kids.items():
                at = start + byte + 1
                free[at], check[at], out[at], place[kid] = False, mine, value[kid], at
                queue.append(kid)
        # A step from any node stays inside the arrays.
        self.base, self.check, self.value = (a[:top + 258].copy() for a in (base, check, out))

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that is a prefix of ``text[start:]``, shortest first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for end in range(start, len(text)):
            at = int(base[node]) + text[end] + 1
            if check[at] != node:
                return
            node = at
            if value[node] >= 0:
                yield end + 1, int(value[node])


class Pieces:
    """The vocabulary of one SentencePiece file (any model type: its pieces and scores are what counts)."""

    def __init__(self, model: bytes):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if (lib.normalize(" a  bÄＡ "), lib.normalize("")) != (f"{MARK}{MARK}a{MARK}{MARK}bÄＡ{MARK}", ""):
            raise ValueError("only models with a leading marker and without normalisation rules are supported")
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(size)]
        byte = [lib.is_byte(i) for i in range(size)]
        self.byte_id = np.full(256, -1, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_id[int(names[i][3:5], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("the file has no byte pieces to fall back on")
        normal = {names[i].encode(): i for i in range(size) if not special[i] and not byte[i]}
        self.score = np.array([lib.get_score(i) for i in range(size)])
        self.unknown_score = min(self.score[i] for i in normal.values()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(normal)
        texts = [p.decode() for p in normal]
        if any(MARK in t.lstrip(MARK) for t in texts):
            raise ValueError("a piece continues over a marker")
        joined = {c for t in texts if len(t) > 1 for c in t}
        alone = "".join(chr(c) for c in range(32) if chr(c) not in joined)
        # No piece crosses from another character to a marker, nor touches a character that only stands alone.
        self.units = re.compile(f"{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+|[{re.escape(alone)}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        surface = [b"" if lib.is_control(i) or lib.is_unused(i) else " ⁇ ".encode() if lib.is_unknown(i) else
                   bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.surface_at = np.concatenate(([0], np.cumsum([len(s) for s in surface])))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.is_byte = np.array(byte)
        self.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "ids", "ends", "count", "used")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)  # unit k has ids[ends[k]:ends[k + 1]]
        self.count = self.used = 0

    def _keep(self, units: Sequence[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids), np.int32)))
        while self.count + len(units) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(len(self.ends), np.int64)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.ends[self.count + 1:self.count + 1 + len(units)] = self.used + np.cumsum(lengths)
        self.index.update(zip(units, range(self.count, self.count + len(units))))
        self.count, self.used = self.count + len(units), self.used + len(ids)

    def add(self, units: Sequence[str]) -> None:
        """Search new units and keep their ids."""
        short = [u for u in units if len(u) * 4 <= TOGETHER or len(u.encode()) <= TOGETHER]
        if short:
            short.sort(key=lambda u: -len(u.encode()))
            self._keep(short, *self._together([u.encode() for u in short]))
        known = set(short)
        for u in units:
            if u not in known:
                ids = self.search(u.encode())
                self._keep([u], np.array(ids, np.int32), np.array([len(ids)]))

    def search(self, raw: bytes) -> list[int]:
        """Best segmentation of one unit; on ties the one whose last piece starts first."""
        n = len(raw)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        start = 0
        while start < n:
            char = 1 + sum(raw[start] >= b for b in (0xC0, 0xE0, 0xF0))
            single = False
            for end, piece in self.trie.prefixes(raw, start):
                single |= end == start + char
                if best[start] + self.score[piece] > best[end]:
                    best[end], back[end] = best[start] + self.score[piece], (start, piece)
            if not single and best[start] + self.unknown_score > best[start + char]:
                best[start + char], back[start + char] = best[start] + self.unknown_score, (start, -1)
            start += char
        out: list[int] = []
        while n:
            start, piece = back[n]
            out.extend([piece] if piece >= 0 else self.byte_id[list(raw[start:n])][::-1].tolist())
            n = start
        return out[::-1]

    def _together(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same search for many units, longest first: (ids, number of ids of each unit)."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        length = np.array([len(r) for r in raw], np.int64)
        joined = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        text_at = np.concatenate(([0], np.cumsum(length)[:-1]))
        at = text_at + np.arange(len(raw))  # a unit of n bytes has n + 1 positions
        total = int(length.sum()) + len(raw)
        best, back, piece = np.full(total, -np.inf), np.zeros(total, np.int64), np.full(total, -1, np.int32)
        best[at] = 0.0

        def relax(target: np.ndarray, score: np.ndarray, source: np.ndarray, which: np.ndarray | int) -> None:
            better = score > best[target]
            target = target[better]
            best[target], back[target] = score[better], source[better]
            piece[target] = which[better] if isinstance(which, np.ndarray) else which

        for start in range(int(length[0])):
            live = int(np.searchsorted(-length, -start, side="left"))  # units with more than `start` bytes
            first = joined[text_at[:live] + start]
            unit = np.flatnonzero((first & 0xC0) != 0x80)  # pieces start at characters
            if not len(unit):
                continue
            lead = first[unit]
            char = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            source = at[unit] + start
            single = np.zeros(len(unit), bool)
            row, node, depth = np.arange(len(unit)), np.zeros(len(unit), np.int64), 0
            while len(row):
                row_ok = length[unit[row]] > start + depth
                row, node = row[row_ok], node[row_ok]
                child = base[node].astype(np.int64) + joined[text_at[unit[row]] + start + depth] + 1
                ok = check[child] == node
                row, node, depth = row[ok], child[ok], depth + 1
                found = value[node]
                hit = found >= 0
                if hit.any():
                    rows, which = row[hit], found[hit]
                    single[rows[char[rows] == depth]] = True
                    relax(source[rows] + depth, best[source[rows]] + self.score[which], source[rows], which)
            lost = np.flatnonzero(~single)
            if len(lost):
                relax(source[lost] + char[lost], best[source[lost]] + self.unknown_score, source[lost], -1)
        units, places, rounds = [], [], 0
        who, cur = np.arange(len(raw)), at + length
        while len(who):
            units.append(who)
            places.append(cur)
            cur = back[cur]
            more = cur > at[who]
            who, cur, rounds = who[more], cur[more], rounds + 1
        unit, place = np.concatenate(units), np.concatenate(places)
        order = np.lexsort((place, unit))
        unit, place = unit[order], place[order]
        ids = piece[place]
        width = np.where(ids < 0, place - back[place], 1)
        out = np.repeat(ids, width)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            inner = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
            source = np.repeat(back[place] - unit, width) + inner  # place in `joined`
            out[lost] = self.byte_id[joined[source[lost]]]
        return out, np.bincount(unit, weights=width, minlength=len(raw)).astype(np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        if self.count > KEPT:
            self.clear()
        cut = [self.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.add([u for u in set().union(*cut) if u not in self.index])
        look = self.index.__getitem__
        sizes = np.array([len(c) for c in cut], np.int64)
        unit = np.fromiter((i for c in cut for i in map(look, c)), np.int64, int(sizes.sum()))
        ids, lengths = gather(self.ids, self.ends, unit)
        words = np.concatenate(([0], np.cumsum(lengths)))
        return ids, words[np.concatenate(([0], np.cumsum(sizes)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id sequences: markers become spaces, the leading one goes, bytes that are no UTF-8 become U+FFFD."""
        raw, lengths = gather(self.surface, self.surface_at, ids)
        at = np.concatenate(([0], np.cumsum(lengths)))[offsets]
        raw = raw.tobytes()
        out = []
        silent = np.concatenate(([0], np.cumsum(lengths == 0)))[offsets]
        for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if silent[i] < silent[i + 1]:  # control pieces stand between bytes: decode what is between them by itself
                own, size = ids[offsets[i]:offsets[i + 1]], lengths[offsets[i]:offsets[i + 1]]
                runs = [r[size[r] > 0] for r in np.split(np.arange(len(own)), np.flatnonzero(size == 0))]
                text = "".join(raw_of(self, own[r]).decode("utf-8", "each_byte") for r in runs)
                first = own[size > 0][:1]
                out.append(text[1:] if len(first) and not self.is_byte[first[0]] and text[:1] == " " else text)
                continue
            head = offsets[i] < offsets[i + 1] and not self.is_byte[ids[offsets[i]]] and raw[lo:lo + 1] == b" "
            out.append(raw[lo + bool(head):hi].decode("utf-8", "each_byte"))
        return out


def raw_of(pieces: Pieces, ids: np.ndarray) -> bytes:
    return gather(pieces.surface, pieces.surface_at, ids)[0].tobytes()


def gather(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``flat[ends[k]:ends[k + 1]]`` for every k of ``which``, joined, and their lengths."""
    start, lengths = ends[which], ends[which + 1] - ends[which]
    shift = np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(len(shift))], lengths


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def _shared(df: DataFrame, model: str):
    """The vocabulary is built on the driver and broadcast: a few MB, bounded by the model file."""
    return df.sparkSession.sparkContext.broadcast(_pieces(model))


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
           check: bool = False) -> DataFrame:
    """(``id_col``, kept columns, ``n_tokens``, ``n_byte_tokens``, ``ids``) for every row.

    With ``check``, also ``round_trip``: the ids decode to the text (false for a null text).
    Null and empty texts have no ids.  Repeated rows give repeated rows; an empty table gives an empty result.
    """
    if {"ids", "n_tokens", "n_byte_tokens", "round_trip"} & set(keep):
        raise ValueError("a kept column has the name of a result column")
    shared = _shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, "__text", 2_000_000):
            texts = column(batch, "__text").to_pylist()
            ids, at = own.encode(texts)
            same = [pa.array([t == d for t, d in zip(texts, own.decode(ids.astype(np.int64), at))])] if check else []
            low = np.concatenate(([0], np.cumsum(own.is_byte[ids])))[at]
            yield pa.RecordBatch.from_arrays(
                [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
                + [pa.array(np.diff(at)), pa.array(np.diff(low)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))] + same,
                names=[n for n in batch.schema.names if n != "__text"] + ["n_tokens", "n_byte_tokens", "ids"] + ["round_trip"] * check)
    rows = df.select(F.col(id_col).alias("__id"), *keep, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return (rows.mapInArrow(run, f"{kinds}, n_tokens long, n_byte_tokens long, ids array<int>" + ", round_trip boolean" * check).withColumnRenamed("__id", id_col))


def decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``ids_col`` replaced by the decoded ``text_col``; null ids give null."""
    shared = _shared(df, model)
    others = [c for c in df.columns if c != ids_col]
    if text_col in others:
        raise ValueError(f"{text_col} is already a column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lists = column(part, "__ids")
                full = pc.fill_null(lists, pa.scalar([], lists.type))
                at = np.asarray(full.offsets, np.int64)
                texts = own.decode(np.asarray(full.values[at[0]:at[-1]], np.int64), at - at[0])
                gone = np.asarray(lists.is_null())
                yield pa.RecordBatch.from_arrays(
                    [c for c, n in zip(part.columns, part.schema.names) if n != "__ids"]
                    + [pa.array([None if g else t for t, g in zip(texts, gone)], pa.string())],
                    names=[n for n in part.schema.names if n != "__ids"] + [text_col])
    rows = df.select(*others, F.col(ids_col).alias("__ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__ids")
    return rows.mapInArrow(run, f"{kinds}, `{text_col}` string")
