"""Words in a trie of letter-group counts, searched with a budget of one surplus and one deficit (numpy helpers of operator 12).

Words are strings of Latin-1 bytes, one per code point. A word's vector has the
number of its letters in each group. Words that differ by one inserted, missing or
replaced letter have vectors that differ by at most one up in one group and one down in
another, so a search that walks the groups in order and spends at most that finds
all of them. The trie is the sorted table of vectors: a node is a range of rows
that agree on the groups so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Groups in the order in which the trie branches: single letters, frequent ones first, then the others by code point.
LETTERS = "enatiorhsulcdmgfpbwyvkzxqj"
OTHERS = 6
GROUPS = len(LETTERS) + OTHERS
#: Vector pairs that are compared at once, and word pairs that are looked at together.
BLOCK, PAIRS = 1 << 13, 1 << 20

_GROUP = np.array([LETTERS.find(chr(b)) if chr(b) in LETTERS else len(LETTERS) + b % OTHERS for b in range(256)])


def vectors(words: list[bytes]) -> np.ndarray:
    """(words, GROUPS) counts; those over 127 stay there, which can only add candidates."""
    out = np.zeros(len(words) * GROUPS, dtype=np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = _GROUP[np.frombuffer(b"".join(words), dtype=np.uint8)]
    out += np.bincount(np.repeat(np.arange(len(words)), sizes) * GROUPS + letters, minlength=len(out))
    return np.minimum(out, 127).astype(np.int8).reshape(-1, GROUPS)


class Words:
    """Words with their vectors, each distinct vector once, and the hashes of their halves."""

    def __init__(self, words: list[bytes]):
        self.words = words
        found, owner = np.unique(vectors(words), axis=0, return_inverse=True)
        self.vectors = found
        order = np.argsort(owner.ravel(), kind="stable")
        self.members = order
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(owner.ravel(), minlength=len(found)))))
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        halves = lambda cut: np.array([cut(w) for w in words], dtype=np.int64)
        self.head, self.tail = halves(lambda w: hash(w[: len(w) // 2])), halves(lambda w: hash(w[len(w) - len(w) // 2 :]))
        # of a word that is compared with one shorter by a letter
        self.short_head, self.short_tail = halves(lambda w: hash(w[: (len(w) - 1) // 2])), halves(lambda w: hash(w[len(w) - (len(w) - 1) // 2 :]))


def near_vectors(stored: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of stored, row of asked) of vectors within one surplus and one deficit. ``stored`` is sorted."""
    none = np.zeros(len(asked), dtype=np.int8)
    todo = [(0, len(stored), 0, np.arange(len(asked)), none, none)]
    while todo:
        lo, hi, level, who, over, under = todo.pop()
        if level == GROUPS or (hi - lo) * len(who) <= BLOCK:
            gap = asked[who, None, level:] - stored[None, lo:hi, level:]
            up, down = np.maximum(gap, 0).sum(2, dtype=np.int16) + over[:, None], np.maximum(-gap, 0).sum(2, dtype=np.int16) + under[:, None]
            a, s = np.nonzero((up <= 1) & (down <= 1))
            if len(a):
                yield s + lo, who[a]
            continue
        column = stored[lo:hi, level]
        cuts = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]))
        counts = asked[who, level]
        for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            gap = counts - column[at]
            up, down = over + np.maximum(gap, 0), under + np.maximum(-gap, 0)
            stay = np.flatnonzero((up <= 1) & (down <= 1))
            if len(stay):
                todo.append((lo + at, lo + to, level + 1, who[stay], up[stay], down[stay]))


def one_apart(a: bytes, b: bytes) -> bool:
    """True if exactly one letter is inserted, missing or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def _expanded(stored: Words, asked: Words, s: np.ndarray, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (stored word, asked word) of pairs of vectors, at most about PAIRS at a time."""
    ns, na = np.diff(stored.starts)[s], np.diff(asked.starts)[a]
    large = ns * na > PAIRS  # many words of one vector each: some stored ones at a time
    for k in np.flatnonzero(large).tolist():
        own = stored.members[stored.starts[s[k]] : stored.starts[s[k] + 1]]
        others = asked.members[asked.starts[a[k]] : asked.starts[a[k] + 1]]
        rows = max(1, PAIRS // len(others))
        for lo in range(0, len(own), rows):
            some = own[lo : lo + rows]
            yield np.repeat(some, len(others)), np.tile(others, len(some))
    s, a, ns, na = s[~large], a[~large], ns[~large], na[~large]
    ends = np.cumsum(ns * na)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        size = (ns * na)[at:to]
        which = np.repeat(np.arange(at, to), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield stored.members[stored.starts[s[which]] + k // na[which]], asked.members[asked.starts[a[which]] + k % na[which]]
        at = to


def near_pairs(stored: Words, asked: Words) -> Iterator[tuple[int, int]]:
    """(stored word, asked word) of all words that are one letter apart."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def verified() -> Iterator[tuple[int, int]]:
        s, a = (np.concatenate(x) for x in zip(*held))
        for i, j in _expanded(stored, asked, s, a):
            gap = stored.sizes[i] - asked.sizes[j]
            same = (gap == 0) & ((stored.head[i] == asked.head[j]) | (stored.tail[i] == asked.tail[j]))
            same |= (gap == 1) & ((stored.short_head[i] == asked.head[j]) | (stored.short_tail[i] == asked.tail[j]))
            same |= (gap == -1) & ((stored.head[i] == asked.short_head[j]) | (stored.tail[i] == asked.short_tail[j]))
            keep = np.flatnonzero(same)
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                if one_apart(stored.words[x], asked.words[y]):
                    yield x, y

    for s, a in near_vectors(stored.vectors, asked.vectors):
        held.append((s, a))
        size += len(s)
        if size > PAIRS:
            yield from verified()
            held, size = [], 0
    if held:
        yield from verified()
