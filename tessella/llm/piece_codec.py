"""Operator 4: encoding and decoding with merge-type SentencePiece vocabularies.

A text becomes symbols of one character each; all adjacent pairs that form a
vocabulary piece wait on an agenda ordered by score, then by position. The best
pair merges, its new neighbours join the agenda, until none is left. Symbols
outside the vocabulary fall back to bytes.

No piece of such a vocabulary has a space mark after another character or a line
break, so the agenda runs over the units between those places. The distinct units
of a batch are found with Arrow; those that repeat come from a memo of two
generations, bounded in bytes, which keeps no long unit. The agendas of new units
of equal length are rows of one array, which all take their best pair at a time;
a long unit has a heap of its own. Every new unit is compared with the
sentencepiece library, together per Arrow batch, and so is one whole text per
batch; a difference raises.

Defined results: a null text is an empty one, with no ids; rows keep their
multiplicity; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches
from tessella.llm.pieces_memo import slabs

MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: Symbols of the longest unit that shares an array, and of the longest that is remembered.
SHORT, LONGEST = 24, 64
#: What an entry of the memo takes besides unit and ids, about.
ENTRY = 240


class PieceCodec:
    """Agenda encoder and decoder for one model file."""

    def __init__(self, path: str, memo_bytes: int = 40 << 20):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(m[1], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i) and (m := _BYTE.match(p))}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i in special if lib.is_control(i)}
        self.unknown = lib.unk_id()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError(f"{path}: pieces cross spaces or lines; units can't be cut")
        self._pairs()
        self.memo_bytes, self.held = memo_bytes, 0
        #: By unit: ids in decimal, and the decoded form where it isn't the unit itself.
        self.young: dict[bytes, tuple[str, str | None]] = {}
        self.old: dict[bytes, tuple[str, str | None]] = {}

    def _pairs(self) -> None:
        """Symbols of characters, and the pairs of symbols that merge: pieces have their ids, other characters in pieces follow."""
        symbol = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbol.setdefault(c, len(self.pieces) + len(symbol))
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)  # characters of no piece, by code point
        for p, i in symbol.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        found = [(symbol[p[:k]] << 32 | symbol[p[k:]], r, symbol[p]) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        found.sort()
        keys, ranks, merged = zip(*found)
        self.pair_keys = np.array(keys, dtype=np.int64)
        self.pair_ranks, self.pair_merged = np.array(ranks, dtype=np.float64), np.array(merged, dtype=np.int32)

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (infinite for none) and the merged symbol."""
        key = a.astype(np.int64) << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (b >= 0)
        return np.where(hit, self.pair_ranks[at], np.inf), self.pair_merged[at]

    def _agendas(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ends the agendas of units of equal length, a row of symbols each: yields (rows, their symbols)."""
        rows, now = np.arange(len(symbols)), symbols
        ranks, merged = self._looked_up(now[:, :-1], now[:, 1:])
        while len(rows):
            if now.shape[1] == 1:
                yield rows, now
                return
            best = ranks.argmin(axis=1)  # the leftmost of equals
            more = np.isfinite(ranks[np.arange(len(rows)), best])
            if not more.all():
                yield rows[~more], now[~more]
                rows, now, ranks, merged, best = (x[more] for x in (rows, now, ranks, merged, best))
                if not len(rows):
                    return
            every, last = np.arange(len(rows)), now.shape[1] - 2
            now[every, best] = merged[every, best]
            at = np.arange(last + 1)
            now = np.take_along_axis(now, at + (at > best[:, None]), axis=1)
            if not last:
                continue
            at = np.arange(last)
            at = at + (at >= best[:, None])
            ranks, merged = np.take_along_axis(ranks, at, axis=1), np.take_along_axis(merged, at, axis=1)
            for side in (best - 1, best):
                i = np.flatnonzero((side >= 0) & (side < last))
                ranks[i, side[i]], merged[i, side[i]] = self._looked_up(now[i, side[i]], now[i, side[i] + 1])

    def encoded(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit, its spaces written as marks."""
        out: list = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        for n, places in by_length.items():
            if n > SHORT:
                for i in places:
                    out[i] = self.agenda(units[i])
                continue
            text = "".join([units[i] for i in places]).encode("utf-32-le")
            for rows, symbols in self._agendas(self.symbol_of[np.frombuffer(text, dtype="<u4")].reshape(-1, n)):
                plain = ((symbols >= 0) & (symbols < len(self.pieces))).all(axis=1)
                for row, found, good in zip(rows.tolist(), symbols.tolist(), plain.tolist()):
                    # a unit with characters of no piece is rare, and goes again by itself
                    out[places[row]] = found if good else self.agenda(units[places[row]])
        return out

    def agenda(self, text: str) -> list[int]:
        """Ids of one unit."""
        rank, sym = self.rank, list(text)
        n = len(sym)
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                heap.append((r, i, i + 1, sym[i] + sym[i + 1]))
        if heap:
            heapq.heapify(heap)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            pop, push, get = heapq.heappop, heapq.heappush, rank.get
            while heap:
                _, i, j, merged = pop(heap)
                left = sym[i]
                if left is None or after[i] != j or sym[j] is None or left + sym[j] != merged:
                    continue
                sym[i], sym[j] = merged, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    pair = merged + sym[k]
                    if (r := get(pair)) is not None:
                        push(heap, (r, i, k, pair))
                h = before[i]
                if h >= 0:
                    pair = sym[h] + merged
                    if (r := get(pair)) is not None:
                        push(heap, (r, h, i, pair))
        out, ids = [], self.ids
        for s in sym:
            if s is None:
                continue
            i = ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def show(self, ids: list[int]) -> str:
        """The surface of some ids; byte pieces join, bad bytes show as U+FFFD."""
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.hidden:
                out.append(self.pieces[i].replace(MARK, " "))
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Codes of all units, where each text's codes begin, and the unit of each code.

        A unit is a run of spaces and what follows, or a line break and what follows; a
        text has one space more in front.
        """
        raw_texts = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        at = np.concatenate(([0], np.cumsum([len(t) for t in raw_texts])))
        raw = np.frombuffer(b"".join(raw_texts), dtype=np.uint8)
        space = raw == 32
        opens = raw == 10
        opens[1:] |= space[1:] & ~space[:-1]
        opens[at[:-1][at[:-1] < len(raw)]] = True
        start = np.flatnonzero(opens)
        offsets = np.append(start, len(raw)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        return units.indices.to_numpy(), np.searchsorted(start, at), units.dictionary.to_pylist()

    def _values(self, units: list[bytes]) -> list[tuple[str, str | None]]:
        young, old = self.young, self.old
        out = [young.get(u) for u in units]
        new = []
        for i in [i for i, v in enumerate(out) if v is None]:
            out[i] = old.get(units[i])
            if out[i] is None:
                new.append(i)
            else:
                self._hold(units[i], out[i])
        surfaces = [units[i].decode() for i in new]
        for i, text, ids in zip(new, surfaces, self._checked(surfaces)):
            shown = None if self.byte_of.keys().isdisjoint(ids) and self.unknown not in ids else self.show(ids)
            out[i] = (",".join(map(str, ids)), None if shown == text else shown)
            if len(units[i]) <= LONGEST:
                self._hold(units[i], out[i])
        return out

    def _hold(self, unit: bytes, value: tuple[str, str | None]) -> None:
        if self.held > self.memo_bytes // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[unit] = value
        self.held += len(unit) + len(value[0]) + ENTRY

    def _checked(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit, compared with the library, which puts a mark in front of each text."""
        if not units:
            return []
        found, mark = self.encoded([u.replace(" ", MARK) for u in units]), self.ids[MARK]
        expected = self.library.encode([u if u[0] == "\n" else u[1:] for u in units], num_threads=1)
        for unit, ids, other in zip(units, found, expected):
            if ids != other and [mark, *ids] != other and (unit, ids) != (" ", [mark]):
                raise AssertionError(f"agenda and library differ on {unit!r}")
        return found

    def batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids in decimal, joined by commas, and its decoded form."""
        for part in slabs(texts):
            codes, at, units = self._coded(part)
            values = self._values(units)
            ids, codes = [v[0] for v in values], codes.tolist()
            odd = {c: v[1] for c, v in enumerate(values) if v[1] is not None}
            for i, text in enumerate(part):
                mine = codes[at[i] : at[i + 1]]
                if odd and not odd.keys().isdisjoint(mine):
                    decoded = "".join([odd[c] if c in odd else units[c].decode() for c in mine])
                    decoded = decoded[1:] if decoded.startswith(" ") else decoded
                else:  # every unit decodes to itself, so the text does
                    decoded = text.replace(MARK, " ")
                yield ",".join(map(ids.__getitem__, mine)), decoded

    def check(self, text: str, ids: str, decoded: str) -> None:
        expected = self.library.encode(text)
        if ",".join(map(str, expected)) != ids or self.library.decode(expected) != decoded:
            raise AssertionError("agenda and library differ on a whole text")


@lru_cache(maxsize=1)
def _codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _encode(path: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts, ids_sha, text_sha, all_ids, all_texts = [], [], [], [], []
            for n, (ids, decoded) in enumerate(codec.batch(texts)):
                if n == 0:
                    codec.check(texts[0], ids, decoded)
                counts.append(ids.count(",") + 1 if ids else 0)
                if keep_text:
                    all_ids.append([int(i) for i in ids.split(",")] if ids else [])
                    all_texts.append(decoded)
                else:
                    ids_sha.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            columns = [b.column(0), pa.array(counts, pa.int64())]
            if keep_text:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names = ["doc_id", "n_tokens", "ids", "decoded"]
            else:
                columns += [pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_decode(docs: DataFrame, model_path: str, digests: bool = True) -> DataFrame:
    """Ids of every text and their decoded form: as digests, or whole (``ids``, ``decoded``)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if digests:
        return rows.mapInArrow(_encode(model_path, False), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(_encode(model_path, True), "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")
