"""Word-by-word use of a tokenizers vocabulary that drops white space.

Such a vocabulary never forms a token across the groups of its own split pattern
(a contraction, letters, one digit, other marks), so a text's ids are those of its
groups in order. Groups repeat, and each is encoded by the library once while it
stays in a memo of two generations, bounded in bytes.

The groups of a batch are found with numpy by the class of each character. The
classes are asked of the vocabulary's own normalizer and split, for characters up
to U+052F other than combining marks; nothing composes among those, and they are
put in lower case one by one. A text with any other character, or with the string
of a special token, is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters whose classes are known, and the classes.
KNOWN = 0x530
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
#: Bytes of text that are looked at together, and of the longest group that is remembered.
SLAB, LONGEST = 1 << 20, 64
#: What an entry of the memo takes besides key and ids, about.
ENTRY = 160


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def contractions(spec: dict) -> list[str]:
    """The endings that the split pattern keeps with an apostrophe; raises for vocabularies of another kind."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split, norm = steps[0], [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = split.get("pattern", {}).get("Regex", "").split("|")
    fits = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and norm == ["NFC", "Replace", "Lowercase"]
    if not fits or parts[-3:] != [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] or not spec["model"].get("end_of_word_suffix"):
        raise ValueError("tokens may cross white space in this vocabulary, or its groups are others")
    if any(not p.startswith("'") or not p[1:].isalpha() for p in parts[:-3]):
        raise ValueError("the split pattern has unknown parts")
    return [p[1:] for p in parts[:-3]]


def character_classes(tokenizer) -> np.ndarray:
    """The class of each lower-case character below KNOWN, as the vocabulary's own steps show it."""
    normal, split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
    shapes = {((0, 3),): LETTER, ((0, 1), (1, 2), (2, 3)): NUMBER, ((0, 1), (1, 3)): OTHER, ((0, 1),): SPACE}
    out = np.full(0x800, UNKNOWN, dtype=np.uint8)
    for i in range(KNOWN):
        c = chr(i)
        n = normal(c)
        kind = shapes.get(tuple(at for _, at in split("a" + n + n)), UNKNOWN)
        if not unicodedata.category(c).startswith("M") and n == (" " if kind == SPACE else c):
            out[i] = kind
    for i in range(0x20000):  # a capital has to become what Python makes of it
        c, low = chr(i), chr(i).lower()
        if c != low and len(low) == 1 and ord(low) < KNOWN and normal(c) != low:
            out[ord(low)] = UNKNOWN
    return out


class PieceMemo:
    """Ids (as little-endian uint32 bytes) and counts of texts."""

    def __init__(self, path: str, memo_bytes: int = 40 << 20):
        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        self.endings = [e.encode() for e in contractions(spec)]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.classes = character_classes(self.tokenizer)
        suffix = spec["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(suffix)
        self.memo_bytes, self.held = memo_bytes, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _kinds(self, raw: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        kind = self.classes[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            high = raw[lead].astype(np.int32)
            found = np.where(high < 0xE0, self.classes[((high & 31) << 6 | raw[np.minimum(lead + 1, len(raw) - 1)] & 63) & 0x7FF], UNKNOWN)
            kind[lead] = found
            tail = (raw & 0xC0) == 0x80
            kind[tail] = kind[np.maximum.accumulate(np.where(tail, 0, np.arange(len(raw))))[tail]]
        return kind

    def _groups(self, raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each group of the split pattern."""
        opens = np.empty(len(raw), dtype=bool)
        opens[:1] = True
        opens[1:] = kind[1:] != kind[:-1]
        opens |= (kind == NUMBER) & ((raw & 0xC0) != 0x80)
        start = np.flatnonzero(opens)
        size = np.diff(start, append=len(raw))
        first = kind[start]
        for i in np.flatnonzero((raw[start] == 0x27) & (size == 1)).tolist():
            if i + 1 < len(start) and first[i + 1] == LETTER:
                follows = raw[start[i + 1] : start[i + 1] + size[i + 1]][:8].tobytes()
                ending = next((e for e in self.endings if follows.startswith(e)), None)
                if ending:
                    size[i] += len(ending)
                    start[i + 1] += len(ending)
                    size[i + 1] -= len(ending)
        use = (first != SPACE) & (size > 0)
        return start[use], size[use]

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
        """Codes of all groups, where each text's codes begin, the ids of each code, and the texts that have to go to the library."""
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        low = [t.replace("Σ", "σ").lower().encode() for t in texts]
        while True:
            for i in whole:
                low[i] = b""
            at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
            raw = np.frombuffer(b"\n".join([*low, b""]), dtype=np.uint8)
            kind = self._kinds(raw)
            strange = np.flatnonzero(kind == UNKNOWN)
            if not len(strange):
                break
            whole += np.unique(np.searchsorted(at, strange, side="right") - 1).tolist()
        start, size = self._groups(raw, kind)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        data = raw[kind != SPACE]
        groups = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return groups.indices.to_numpy(), np.searchsorted(start, at), self._ids(groups.dictionary.to_pylist()), whole

    def _ids(self, groups: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(g) for g in groups]
        new = []
        for i in [i for i, v in enumerate(out) if v is None]:
            out[i] = old.get(groups[i])
            if out[i] is None:
                new.append(i)
            else:
                self._hold(groups[i], out[i])
        for i, ids in zip(new, self._encode([groups[i].decode() for i in new])):
            out[i] = ids
            if len(groups[i]) <= LONGEST:
                self._hold(groups[i], ids)
        return out

    def _hold(self, group: bytes, ids: bytes) -> None:
        if self.held > self.memo_bytes // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[group] = ids
        self.held += len(group) + len(ids) + ENTRY

    def _encode(self, groups: list[str]) -> Iterator[bytes]:
        for at in range(0, len(groups), 4096):
            chunk = groups[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(chunk) and cuts[-1] == len(ids):  # each ends with a piece that ends a word
                raw, start = ids.tobytes(), 0
                for end in (cuts * 4).tolist():
                    yield raw[start:end]
                    start = end
            else:
                yield from (self.whole(g) for g in chunk)

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as uint32 bytes; the first text is compared with the library."""
        for n, part in enumerate(slabs(texts)):
            codes, at, ids, whole = self._coded(part)
            codes, other = codes.tolist(), set(whole)
            for i, text in enumerate(part):
                found = self.whole(text) if i in other else b"".join(map(ids.__getitem__, codes[at[i] : at[i + 1]]))
                if n == i == 0 and found != self.whole(text):
                    raise AssertionError("memo and library differ")
                yield found

    def counts(self, texts: list[str]) -> Iterator[int]:
        """The number of ids of each text; the first text is compared with the library."""
        for n, part in enumerate(slabs(texts)):
            codes, at, ids, whole = self._coded(part)
            sums = np.concatenate(([0], np.cumsum(np.array([len(x) // 4 for x in ids], dtype=np.int64)[codes])))
            found = sums[at[1:]] - sums[at[:-1]]
            for i in whole:
                found[i] = len(self.whole(part[i])) // 4
            if n == 0 and found[0] != len(self.whole(part[0])) // 4:
                raise AssertionError("memo and library differ")
            yield from found.tolist()


def slabs(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about SLAB characters together; a longer one alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLAB:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
