"""Hashes of lines, of their halves and of their one-word deletions (numpy helpers)."""

from __future__ import annotations

import numpy as np

from tessella.llm.shingles import _mix, words_at

#: Unless a caller says otherwise, lines of fewer words are compared exactly only: one word of few is much of a line.
NEAR_WORDS = 8

_U = np.uint64
_C1, _C2, _K = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0x8EBC6AF09C88C6E3)
_C1_INVERSE = _U(pow(int(_C1), -1, 1 << 64))
_p1 = _p2 = np.ones(1, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _p1, _p2
    if n > len(_p1):
        one = np.ones(1, dtype=_U)
        _p1, _p2 = (np.concatenate((one, np.cumprod(np.full(2 * n, c)))) for c in (_C1, _C2))
    return _p1, _p2


def reach(n: np.ndarray) -> np.ndarray:
    """Words of a compared half: the largest power of two that is at most n / 2."""
    return (1 << np.floor(np.log2(np.maximum(n, 2) / 2)).astype(np.int64)).astype(np.int64)


def lines_of(text: bytes, near_words: int = NEAR_WORDS) -> tuple[np.ndarray, ...]:
    """For the lines that have words: number, words, two hashes of all words; and per half key the line's index and the key.

    Two lines within one word's edit agree on the first or on the last half of the
    shorter one, so they share a half key. Both lengths name the half the same way,
    as each line also gives the half of a line one word shorter.
    """
    w, starts = words_at(text)
    none = np.empty(0, dtype=np.int64)
    if not len(w):
        return none, none, none, none, none, none
    breaks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    n = np.diff(np.concatenate((first, [len(w)])))
    place = np.arange(len(w)) - np.repeat(first, n)
    p1, p2 = _powers(int(n.max()) + 1)
    whole = w * p1[place]
    h1 = _mix(np.add.reduceat(whole, first) + n.astype(_U))
    h2 = _mix(np.add.reduceat(_mix(w ^ _K) * p2[place], first) ^ n.astype(_U))
    owners, keys = [], []
    near = n >= near_words
    for h, use in ((reach(n), near), (reach(n - 1), near & (n > near_words) & (reach(n - 1) != reach(n)))):
        if not use.any():
            continue
        each = np.repeat(h, n)
        head = np.add.reduceat(np.where(place < each, whole, _U(0)), first)
        back = place - np.repeat(n - h, n)
        tail = np.add.reduceat(np.where(back >= 0, w * p1[np.maximum(back, 0)], _U(0)), first)
        at = np.flatnonzero(use)
        for side, values in ((1, head), (2, tail)):
            owners.append(at)
            keys.append(_mix(values[at] + (h[at] * 4 + side).astype(_U) * _K).view(np.int64))
    owner = np.concatenate(owners) if owners else none
    key = np.concatenate(keys) if keys else none
    return line[first], n, h1.view(np.int64), h2.view(np.int64), owner, key


def runs(sizes: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer one alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(sizes))] if len(sizes) else out


def lines_of_many(texts: list[bytes], near_words: int = NEAR_WORDS) -> tuple[np.ndarray, ...]:
    """``lines_of`` for texts at once, with the text of each line in front."""
    line, n, h1, h2, owner, key = lines_of(b"\n".join(texts), near_words)
    lines = np.cumsum([t.count(b"\n") + 1 for t in texts])
    text = np.searchsorted(lines, line, side="right")
    return text, line - np.concatenate(([0], lines))[text], n, h1, h2, owner, key


def deletions(line: bytes) -> np.ndarray:
    """Hash of a line's words, then the hash with each word left out, as int64."""
    w, _ = words_at(line)
    n = len(w)
    p1, _ = _powers(n + 1)
    parts = w * p1[:n]
    before = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(parts)))
    total = before[-1]
    without = before[:-1] + (total - before[1:]) * _C1_INVERSE
    lengths = np.full(n + 1, n - 1, dtype=_U)
    lengths[0] = n
    return _mix(np.concatenate(([total], without)) + lengths * _K).view(np.int64)


def one_edit(a: list[str], b: list[str]) -> bool:
    """True if at most one word is inserted, left out or replaced between a and b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]
