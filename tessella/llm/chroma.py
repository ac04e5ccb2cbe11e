"""Chroma fingerprints of sampled audio (numpy helpers).

Frames of the signal become energies of the twelve pitch classes. Rectangle sums
over (frame, class), taken from an integral image, are compared in pairs; each of
16 comparisons gives two bits, so a frame position packs into one integer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

FRAME, HOP = 1024, 256
CLASSES, FILTERS = 12, 16
#: Frames that the widest filter covers.
SPAN = 16
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


@lru_cache(maxsize=8)
def _class_matrix(rate: int) -> np.ndarray:
    """Spectrum bins to pitch classes, between 55 Hz and a little below half the rate."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hz), CLASSES), dtype=np.float32)
    use = np.flatnonzero((hz >= 55) & (hz <= 0.45 * rate))
    out[use, np.round(12 * np.log2(hz[use] / 440)).astype(int) % CLASSES] = 1
    return out


def frames(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frame, class) energies, each frame scaled to length 1; fewer samples than a frame give none."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES), dtype=np.float32)
    cut = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(cut * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    chroma = power.astype(np.float32) @ _class_matrix(rate)
    norm = np.linalg.norm(chroma, axis=1, keepdims=True)
    return np.where(norm > 1e-6, chroma / np.maximum(norm, 1e-6), 0)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of each comparison, spread by rule over both axes."""
    return [(i % 5, (5 * i) % 9, 3 + i % 2, 4 * (1 + i % 4)) for i in range(FILTERS)]


def _box(image: np.ndarray, t: np.ndarray, w: int, y: int, h: int) -> np.ndarray:
    return image[t + w, y + h] - image[t, y + h] - image[t + w, y] + image[t, y]


def fingerprint(chroma: np.ndarray) -> np.ndarray:
    """One uint32 per frame position that the widest filter fits on."""
    n = len(chroma) - SPAN + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    wide = np.concatenate((chroma, chroma[:, :CLASSES]), axis=1)  # classes wrap around
    image = np.zeros((len(chroma) + 1, 2 * CLASSES + 1), dtype=np.float64)
    image[1:, 1:] = wide.cumsum(0).cumsum(1)
    t = np.arange(n)
    out = np.zeros(n, dtype=np.uint32)
    for i, (kind, y, h, w) in enumerate(filters()):
        half = w // 2
        if kind == 0:  # early against late
            a, b = _box(image, t, half, y, h), _box(image, t + half, w - half, y, h)
        elif kind == 1:  # low against high classes
            a, b = _box(image, t, w, y, h), _box(image, t, w, y + h, h)
        elif kind == 2:  # one diagonal against the other
            a = _box(image, t, half, y, h) + _box(image, t + half, w - half, y + h, h)
            b = _box(image, t, half, y + h, h) + _box(image, t + half, w - half, y, h)
        elif kind == 3:  # middle classes against those around
            a, b = _box(image, t, w, y + h, h), (_box(image, t, w, y, h) + _box(image, t, w, y + 2 * h, h)) / 2
        else:  # middle frames against those around
            third = w // 4
            a = _box(image, t + third, w - 2 * third, y, h)
            b = _box(image, t, third, y, h) + _box(image, t + w - third, third, y, h)
        value = np.log((1 + a) / (1 + b))
        level = (value > -0.15).astype(int) + (value > 0) + (value > 0.15)
        out |= _GRAY[level] << np.uint32(2 * i)
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and compared positions when a[i] lies on b[i + offset]."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()), hi - lo


class Stack:
    """The fingerprints of a block of recordings, for sums of bit errors at every offset.

    Over bits as +1 and -1, the sum of products at an offset is the agreeing bits less the
    differing ones. The sums at all offsets come from the spectra of both sides: products
    by frequency, added up over the 32 bits, and turned back. Sums are whole numbers far
    below the precision used, so rounding gives the counts exactly.
    """

    #: Positions of the recordings that are compared at once, sums held at once, and bytes of spectra kept from query to query.
    HELD, SUMS, KEPT = 12_288, 5 << 18, 64 << 20
    #: Longest transform that is turned back by a matrix, and longest in single precision.
    SHORT, SINGLE = 256, 1024

    def __init__(self, prints: list[np.ndarray]):
        lengths = np.array([len(p) for p in prints], dtype=np.int64)
        self.parts, self.kept = [], {}
        for like in np.unique(-(-lengths[lengths > 0] // 16)).tolist():
            at = np.flatnonzero(-(-lengths // 16) == like)
            for some in np.array_split(at, -(-len(at) * 16 * like // self.HELD)):
                if len(some):
                    self.parts.append((some, lengths[some], [prints[i] for i in some]))

    def _spectra(self, part: int, n: int) -> np.ndarray:
        """(frequency, real parts of 32 bits before imaginary ones, recording) of a part's recordings."""
        if (part, n) not in self.kept:
            both = np.concatenate(_spectra(self.parts[part][2], n), axis=2)
            both = np.ascontiguousarray(both.transpose(0, 2, 1))
            self.kept = {k: v for k, v in self.kept.items() if k[0] != part}
            if sum(v.nbytes for v in self.kept.values()) + both.nbytes > self.KEPT:
                return both
            self.kept[part, n] = both
        return self.kept[part, n]

    def matches(self, queries: list[np.ndarray], min_overlap: int, max_error: float) -> list[np.ndarray]:
        """(query, place in the block, offset, bit error rate, positions) columns of all that align, each pair by the best of its offsets.

        At least ``min_overlap`` positions are compared, or the whole of the shorter recording.
        """
        lengths = np.array([len(q) for q in queries], dtype=np.int64)
        found, asked = [], {}
        for part, (places, sizes, _) in enumerate(self.parts):
            longest = int(sizes.max())
            for m in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == m)
                least = np.minimum(min(min_overlap, m), sizes)
                shifts = np.arange(int(least.min()) - m, longest - int(least.min()) + 1)
                n = _transform_length(m + longest - int(least.min()))
                overlap = np.minimum(m, sizes - shifts[:, None]) - np.maximum(0, -shifts)[:, None]
                judged = (overlap >= least) & (overlap > 0)
                theirs = self._spectra(part, n)[:, None]
                bound = np.where(judged, 32 * overlap * (1 - 2 * max_error) - 0.5, np.inf).astype(theirs.dtype)
                few = max(1, self.SUMS // (n * max(64, len(places))))
                for k in range(0, len(at), few):
                    if (m, n, k, few) not in asked:
                        ours = _conjugate([queries[i] for i in at[k : k + few]], n)
                        if sum(v.nbytes for v in asked.values()) + ours.nbytes <= self.KEPT:
                            asked[m, n, k, few] = ours
                    else:
                        ours = asked[m, n, k, few]
                    sums = _turned_back(np.matmul(ours, theirs), shifts, n)
                    q, r, *best = _best(sums, bound, overlap, shifts, max_error)
                    found.append((at[k + q], places[r], *best))
        if not found:
            return [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64, np.int64)]
        columns = [np.concatenate(c) for c in zip(*found)]
        order = np.lexsort((columns[1], columns[0]))
        return [c[order] for c in columns]

    def aligned(self, query: np.ndarray, min_overlap: int, max_error: float) -> list[tuple[int, int, float, int]]:
        """(place in the block, offset, bit error rate, positions) of each recording that aligns with one query."""
        return list(zip(*(c.tolist() for c in self.matches([query], min_overlap, max_error)[1:])))


def _transform_length(least: int) -> int:
    """At least ``least``, of eight lengths an octave, so that recordings of like lengths share spectra."""
    step = 1 << max(0, least.bit_length() - 4)
    return -(-least // step) * step


def _spectra(prints: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts, each (frequency, recording, bit), of the bits as +1 and -1, with zeros after a recording's end."""
    signs = np.zeros((len(prints), n, 32), dtype=np.float32 if n <= Stack.SINGLE else np.float64)
    for row, p in zip(signs, prints):
        row[: len(p)] = np.unpackbits(p.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1) * 2.0 - 1
    out = np.fft.rfft(signs, axis=1).transpose(1, 0, 2)
    return out.real, out.imag


def _conjugate(prints: list[np.ndarray], n: int) -> np.ndarray:
    """(frequency, 2, query, 64): factors that give the real and the imaginary part of a query's conjugate times a recording."""
    real, imag = _spectra(prints, n)
    return np.stack((np.concatenate((real, imag), axis=2), np.concatenate((-imag, real), axis=2)), axis=1)


def _turned_back(products: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """(offset, query, recording): the sums at ``shifts`` of products (frequency, 2, query, recording)."""
    f = np.arange(len(products))
    if n > Stack.SHORT:
        return np.fft.irfft(products[:, 0] + 1j * products[:, 1], n, axis=0)[shifts % n]
    angle = 2 * np.pi * np.outer(shifts, f) / n
    back = np.stack((np.cos(angle), -np.sin(angle)), axis=2) * np.where((f == 0) | (2 * f == n), 1, 2)[:, None] / n
    sums = back.reshape(len(shifts), -1).astype(products.dtype) @ products.reshape(2 * len(products), -1)
    return sums.reshape(len(shifts), *products.shape[2:])


def _best(sums: np.ndarray, bound: np.ndarray, overlap: np.ndarray, shifts: np.ndarray, max_error: float) -> tuple[np.ndarray, ...]:
    """(query, recording, offset, bit error rate, positions) of the pairs with an offset within the rate: least rate, most positions, least offset."""
    hits = np.flatnonzero(sums >= bound[:, None])
    s, q, r = np.unravel_index(hits, sums.shape)
    size = overlap[s, r]
    wrong = np.rint((32 * size - sums.ravel()[hits]) / 2).astype(np.int64)
    rate = wrong / (32 * size)
    order = np.lexsort((s, -size, rate, r, q))
    order = order[(wrong <= max_error * 32 * size)[order]]
    pair = (q * sums.shape[2] + r)[order]
    order = order[np.diff(pair, prepend=-1) != 0]
    return q[order], r[order], shifts[s[order]], rate[order], size[order]
