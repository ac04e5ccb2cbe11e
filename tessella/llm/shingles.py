"""Word shingles of a text as 64-bit hashes, and MinHash labels of a shingle set (numpy helpers)."""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bits of one MinHash value in a label.
VALUE_BITS = 12

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(64, dtype=_U)
with np.errstate(over="ignore"):
    _powers[1:] = np.cumprod(np.full(63, _BASE))
_STEPS = _powers[1 : WIDTH + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word of a UTF-8 text, in order."""
    return words_at(text)[0]


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte positions of the words."""
    global _powers
    raw = np.frombuffer(text, dtype=np.uint8)
    none = np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
    if not len(raw):
        return none
    space = _SPACE[raw]
    inside = np.concatenate(([True], space, [True]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return none
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_powers):
        _powers = np.concatenate(([_U(1)], np.cumprod(np.full(2 * longest, _BASE))))
    kept = raw[~space].astype(_U) + _U(1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    return _mix(np.add.reduceat(kept * _powers[place], first) + lengths.astype(_U)), starts


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of runs of WIDTH words; fewer words make one shingle; no words, none."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    if n < WIDTH:
        return _mix(np.array([np.add.reduce(w * _STEPS[:n])], dtype=_U) ^ _U(n))
    total = w[: n - WIDTH + 1] * _STEPS[0]
    for k in range(1, WIDTH):
        total += w[k : n - WIDTH + 1 + k] * _STEPS[k]
    return np.unique(_mix(total))


def hash_family(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 2**63, count, dtype=np.int64).astype(_U) * _U(2)
    return draw() | _U(1), draw()


def labels(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], trees: int, depth: int) -> np.ndarray:
    """One label per tree: ``depth`` MinHash values of VALUE_BITS each, first value in the highest bits."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=_U)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048, None] ^ b) * a).min(axis=0), out=least)
    values = (_mix(least) >> _U(64 - VALUE_BITS)).reshape(trees, depth)
    out = np.zeros(trees, dtype=_U)
    for k in range(depth):
        out = (out << _U(VALUE_BITS)) | values[:, k]
    return out.astype(np.int64)


def merged(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the sets in order, and the set of each."""
    if not sets:
        return np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    return values[order], owners[order]


def overlaps_with(s: np.ndarray, values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of one set with the n sets that were merged."""
    lo = np.searchsorted(values, s, "left")
    width = np.searchsorted(values, s, "right") - lo
    at = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
    return np.bincount(owners[at], minlength=n)


def common_depths(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many first values two rows of labels share in each tree."""
    return sum(((a ^ b) >> (VALUE_BITS * k) == 0).astype(np.int64) for k in range(depth))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    n = len(sets)
    if n == 2:
        out = np.diag([len(s) for s in sets]).astype(np.int64)
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(values)) > 1
    rank = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], rank[column[use]]
    out = np.zeros((n, n), dtype=np.int64)
    width = max(256, (1 << 22) // n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, [lo, lo + width])
        slab = np.zeros((n, width), dtype=np.float32)
        slab[row[s:e], column[s:e] - lo] = 1
        out += (slab @ slab.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out
