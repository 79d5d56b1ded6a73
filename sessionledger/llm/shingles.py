"""Hashes of words and word shingles of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64, run_starts

CHUNK = 1 << 21  # bytes hashed at a time; memory does not grow with a text
ODD = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo 2^64."""
    if base not in _powers or len(_powers[base]) <= n:
        step = np.full(max(n, CHUNK) + 1, base, np.uint64)
        step[0] = 1
        _powers[base] = np.multiply.accumulate(step)
    return _powers[base]


class Rolling:
    """Polynomial hashes of any stretch of a byte array."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * powers(ODD, n)[:n], out=self.sums[1:])
        self.inverse = powers(pow(ODD, -1, 1 << 64), n)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start])


def _cuts(raw: np.ndarray, at: np.ndarray):
    """Stretches of about CHUNK bytes that split no word and end no text early."""
    pos, n = 0, len(raw)
    while pos < n:
        stop = min(n, pos + CHUNK)
        while stop < n and not BLANK[raw[stop]]:
            nxt = int(at[np.searchsorted(at, stop)])
            gap = BLANK[raw[stop : min(nxt, stop + CHUNK)]]
            hit = int(gap.argmax()) if gap.any() else len(gap)
            stop += hit
            if stop == nxt:
                break
        yield pos, stop
        pos = stop


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of non-blank bytes) and its text's number.
    ``at``: byte offsets of the texts."""
    starts_all, hashes = [], []
    for lo, hi in _cuts(raw, at):
        part = raw[lo:hi]
        full = ~BLANK[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[[0, -1]] = True
        inner = at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo
        edge[inner] = True
        start = full.copy()
        start[1:] &= ~full[:-1] | edge[1:-1]
        stop = full.copy()
        stop[:-1] &= ~full[1:] | edge[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        hashes.append(Rolling(part).of(s, e))
        starts_all.append(s + lo)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(at, np.concatenate(starts_all), "right") - 1


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words and its text's number. A text of
    fewer words has one shingle, all of them; a text without words none."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(first)
    number = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    of = np.repeat(np.arange(n_docs), number)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    out = np.zeros(len(of), np.uint64)
    last = first[of + 1]
    padded = np.append(words, np.zeros(size, np.uint64))
    for k in range(size):
        w = padded[at + k]
        out = mix64(out ^ np.where(at + k < last, w, np.uint64(k + 1)))
    return out, of


def bags(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text in order, their counts and text numbers."""
    hashes = hashes.copy()
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for s, e in zip(bounds[:-1], bounds[1:]):
        hashes[s:e].sort()
    starts = run_starts(hashes, doc)
    return hashes[starts], np.diff(np.append(starts, len(hashes))), doc[starts]
