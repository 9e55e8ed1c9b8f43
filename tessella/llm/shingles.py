"""Hashed word shingles of whole texts, vectorised over batches of bytes."""

from __future__ import annotations

import numpy as np

_ALL = (1 << 64) - 1
_BASE = 0x2545F4914F6CDD1D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at once; a longer word is hashed whole.
STRIDE = 1 << 20

_grown: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, `n` of them at least; a worker keeps the longest run that it has needed."""
    if not _grown or len(_grown[0]) < n:
        size = 1 << max(21, int(n - 1).bit_length())
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            made.append(np.cumprod(step, dtype=np.uint64))
        _grown[:] = made
    return _grown[0], _grown[1]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, A-Z lower-cased, and the n + 1 offsets of each text's words.

    Long input is hashed by strides that end between words.
    """
    hashes, starts, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + STRIDE)
        while stop < len(raw) and _WORD[raw[stop - 1]] and _WORD[raw[stop]]:
            gap = np.flatnonzero(~_WORD[raw[stop : stop + STRIDE]])
            stop = stop + int(gap[0]) if len(gap) else min(len(raw), stop + STRIDE)
        own, places = _stride_hashes(raw[at:stop], offsets[(offsets > at) & (offsets < stop)] - at)
        hashes.append(own)
        starts.append(places + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _stride_hashes(raw: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a stride; `inner` are the starts of texts within it."""
    powers, inverse = _powers(len(raw))
    inside = _WORD[raw]
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    before[inner] = False
    after[inner - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    spread = scramble(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))[_LOWER[raw]]
    spread *= powers[: len(raw)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
    hashes = (sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return scramble(hashes), starts


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: runs of `size` words, or all its words if fewer; none without words."""
    factors = [np.uint64(pow(0x9FB21C651E98DF25, i + 1, 1 << 64)) for i in range(size)]
    n = len(words)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for i, factor in enumerate(factors):
        runs += words[i : i + len(runs)] * factor
    runs = scramble(runs + np.uint64(size))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = sum(int(w) * int(f) for w, f in zip(words[a:b], factors, strict=False)) & _ALL
            out.append(scramble(np.array([(short + (b - a)) & _ALL], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
