"""Byte-level BPE by dynamic programming over prefixes (plain Python helpers of operator 13).

The BPE encoding of a piece has, for each of its prefixes, one last token. A
suffix-link automaton of the vocabulary gives all tokens that end at a byte, the
longest first; the last token of a prefix is the one that is compatible with the
last token of what stands before it. Following these back from the end gives the ids.

Two tokens are compatible if encoding their joined bytes gives just the two. Seen
from the seam, the left token is a chain of ever shorter right ends, the right
one a chain of left ends; each part lives from the merge that made it to the merge
that uses it up. The tokens are compatible if no two parts that live at the same
time can be merged before one of them is used up.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex

#: Fixed value: the split that byte-level vocabularies of this kind are trained with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the longest piece that is remembered, and what an entry takes besides its text and ids, about.
LONGEST, ENTRY = 64, 200
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings: itself where it is printable, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens as bytes, how they are merged, and which pairs are compatible."""

    def __init__(self, spec: dict):
        model = spec["model"]
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        split = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("this is no plain byte-level BPE vocabulary")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items() if all(c in byte_of for c in t)}
        self.born = {i: -1 for i, b in self.bytes_of.items() if len(b) == 1}
        if len(self.born) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = ids[left], ids[right], ids[left + right]
            if made in self.born or a not in self.born or b not in self.born:
                raise ValueError("a token is made twice, or before its parts")
            self.born[made], self.parts[made], self.rank[a, b] = rank, (a, b), rank
        self._compatible: dict[tuple[int, int], bool] = {}
        self.reachable = {i for i in self.born if i not in self.parts}
        for made, (a, b) in self.parts.items():  # in the order of merges, so that parts come first
            if a in self.reachable and b in self.reachable and self._apart(a, b, self.born[made]):
                self.reachable.add(made)

    def _apart(self, a: int, b: int, until: int) -> bool:
        """True if no merge across the seam between a and b comes before the time ``until``."""
        x, y, x_used, y_used = a, b, until, until
        while True:
            rank = self.rank.get((x, y))
            # of equal merges the left one is first: x goes to its left neighbour, but y stays for x
            if rank is not None and rank < x_used and (rank <= y_used if y_used != until else rank < until):
                return False
            if self.born[x] > self.born[y]:
                x_used, x = self.born[x], self.parts[x][1]
            elif y in self.parts:
                y_used, y = self.born[y], self.parts[y][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self._compatible.get((a, b))
        if found is None:
            if len(self._compatible) > 400_000:
                self._compatible.clear()
            found = self._compatible[a, b] = self._apart(a, b, NEVER)
        return found


class PrefixBpe:
    """Ids of texts as little-endian uint32 bytes, as the tokenizers library gives them without begin, end or padding."""

    def __init__(self, path: str, memo_bytes: int = 40 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.vocabulary = Vocabulary(spec)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not handled")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        for i in self.vocabulary.reachable:
            token = self.vocabulary.bytes_of[i].decode("latin-1")
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.known: set[str] = set()
        self.odd: set[str] = set()
        self.memo = _Memo(self, memo_bytes)
        spelled = {**self.vocabulary.bytes_of, **{i: t.encode() for t, i in self.special.items()}}
        sizes = np.zeros(max(spelled) + 1, dtype=np.int64)
        for i, b in spelled.items():
            sizes[i] = len(b)
        self.starts, self.sizes = np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes
        self.spelling = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(len(sizes))), dtype=np.uint8)

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece: the last token of every prefix, then back from the end."""
        last = [(0, -1)] * (len(raw) + 1)
        compatible, filled = self.vocabulary.compatible, 0
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if filled == end:  # a shorter one that ends at the same byte
                continue
            before = last[end - size][1]
            if before < 0 or compatible(before, token):
                last[end] = (size, token)
                filled = end
        out, at = [], len(raw)
        while at:
            size, token = last[at]
            out.append(token)
            at -= size
        return out[::-1]

    def _same_split(self, c: str) -> bool:
        """True if the pattern here and the library agree on the class of a character."""
        for probe in (f"a{c}a", f"1{c}1", f".{c}.", f" {c} x", f"{c}{c} {c}"):
            own = ["".join(self.letters[b] for b in p.encode()) for p in self.split.findall(probe)]
            if own != [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(probe)]:
                return False
        return True

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens; by the library itself where it holds characters on which the two differ."""
        characters = set(text)
        for c in characters - self.known:
            self.known.add(c)
            if not self._same_split(c):
                self.odd.add(c)
        if self.odd.isdisjoint(characters):
            return self.split.findall(text)
        return [bytes(self.byte_of[c] for c in p).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        parts = self.cuts.split(text) if self.cuts and any(s in text for s in self.special) else [text]
        ids = self.memo.__getitem__
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(ids, self.pieces(p))) for p in parts if p)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; bytes that are no character become U+FFFD."""
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        sizes = self.sizes[i]
        ends = np.cumsum(sizes)
        raw = self.spelling[np.repeat(self.starts[i] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return raw.decode("utf-8", "replace").encode("utf-8")

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; the shortest that isn't empty is compared with the library."""
        tried = min((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]), default=None)
        for i, t in enumerate(texts):
            ids = self.encode(t)
            if i == tried and ids != self.by_library(t):
                raise AssertionError("ids differ from the library's")
            yield ids


class _Memo(dict):
    """Ids of pieces, in two generations bounded in bytes."""

    def __init__(self, bpe: PrefixBpe, most: int):
        super().__init__()
        self.bpe, self.most, self.held, self.old = bpe, most, 0, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.bpe.piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= LONGEST:
            if self.held > self.most // 2:
                self.old, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
            self.held += len(piece) + len(ids) + ENTRY
        return ids
