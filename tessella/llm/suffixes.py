"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import math

import numpy as np

from tessella.llm.shingles import _powers, scramble

_SALT = np.uint64(0xA24BAED4963EE407)
_SPREAD = scramble(np.arange(1 << 12, dtype=np.uint64) + _SALT)
#: Reduced strings over more letters are written with two digits a letter, so that a letter's bucket is never tiny.
LETTERS = 1 << 10
STRIDE = 1 << 18


def _place_type(n: int) -> type:
    """Places take four bytes wherever they fit: at most some ten such arrays of a text stand at once."""
    return np.int32 if n < 1 << 31 else np.int64


def prefix_sums(text: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring of `text` follows."""
    powers, _ = _powers(len(text))
    small = not len(text) or int(text.max()) < len(_SPREAD)
    sums = np.zeros(len(text) + 1, np.uint64)
    for start in range(0, len(text), STRIDE):
        part = text[start : start + STRIDE]
        spread = _SPREAD[part] if small else scramble(part.astype(np.uint64) + _SALT)
        np.multiply(spread, powers[start : start + len(part)], out=sums[start + 1 : start + 1 + len(part)])
    return np.cumsum(sums, out=sums)


def hashes(sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    _, inverse = _powers(len(sums))
    return (sums[start + size] - sums[start]) * inverse[start]


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (type S); the end of the text is smaller than all."""
    n = len(text)
    step = np.full(n, -1, np.int8)
    step[:-1] = (text[1:] > text[:-1]).view(np.int8) - (text[1:] < text[:-1]).view(np.int8)
    # a run of equal letters has the type of its last one
    last = np.arange(n, dtype=_place_type(n))
    last[step == 0] = n
    np.minimum.accumulate(last[::-1], out=last[::-1])
    return step[last] > 0


def _leftmost(small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


class _Buckets:
    """The order under construction: a bucket per letter, larger suffixes from its front, smaller ones from its back."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        self.text, self.size, n = text, size, len(text)
        self.previous = np.concatenate([text[-1:], text[:-1]])  # each suffix's letter before; the first one's is set by the pass
        self.ends = np.cumsum(np.bincount(text, minlength=size))
        self.begins = np.r_[0, self.ends[:-1]]
        kind = _place_type(n)
        self.order = np.empty(n, kind)
        first = np.arange(n, dtype=kind)
        first[1:][text[1:] == text[:-1]] = 0
        np.maximum.accumulate(first, out=first)
        self.before = np.subtract(np.arange(n, dtype=kind), first, out=first)  # equal letters to the left

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """The order of all suffixes, induced from that of the leftmost-smaller ones; each suffix is moved once a pass.

        Going up the letters, each suffix puts the larger one before it at the front of that one's bucket; going down,
        each puts the smaller one before it at the back.
        """
        text, order, begins, ends = self.text, self.order, self.begins, self.ends
        letters = text[seeds]
        seeds = seeds[np.argsort(letters, kind="stable")]
        bounds = np.r_[0, np.cumsum(np.bincount(letters, minlength=self.size))].tolist()
        head, n = begins.copy(), len(text)
        order[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
        full = begins.copy()
        self.previous[0] = 0
        for c, a in enumerate(begins.tolist()):
            block = seeds[bounds[c] : bounds[c + 1]]
            if head[c] > a:
                large = self._with_runs(order[a : head[c]])
                full[c] = a + len(large)
                order[a : full[c]] = large
                block = np.concatenate([large, block])
            if len(block):
                self._put(block, head, c, 1)
        tail = ends.copy()
        self.previous[0] = self.size - 1
        for c in range(self.size - 1, -1, -1):
            b = int(ends[c])
            block = order[begins[c] : full[c]][::-1]
            if tail[c] < b:
                lower = self._with_runs(order[tail[c] : b][::-1])
                order[b - len(lower) : b] = lower[::-1]
                block = np.concatenate([lower, block])
            if len(block):
                self._put(block, tail, c, -1)
        return order

    def _with_runs(self, block: np.ndarray) -> np.ndarray:
        """The suffixes of a bucket that others put there, and after them those that they put into it themselves: the
        ones before them in a run of the letter, the nearest first.
        """
        more = self.before.take(block)
        if not more.any():
            return block
        lengths = more + 1
        k = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return (np.repeat(block, lengths) - k)[np.argsort(k, kind="stable")]

    def _put(self, block: np.ndarray, free: np.ndarray, c: int, step: int) -> None:
        """Put the suffixes before those of a block, if of the pass's type, at the free places of their letters."""
        letters = self.previous.take(block)
        wanted = np.flatnonzero(letters > c if step > 0 else letters < c)
        if not len(wanted):
            return
        letters = letters.take(wanted)
        by = letters.argsort(kind="stable")
        letters, places = letters.take(by), block.take(wanted.take(by)) - 1
        if self.size <= LETTERS:
            counts = np.bincount(letters, minlength=self.size)
            shift = free - step * (counts.cumsum() - counts)
            at = shift.take(letters) + step * np.arange(len(letters))
            free += step * counts
        else:
            heads = np.concatenate([[0], np.flatnonzero(letters[1:] != letters[:-1]) + 1])
            counts = np.concatenate([heads[1:], [len(letters)]]) - heads
            own = letters[heads]
            at = np.repeat(free[own] - step * heads, counts) + step * np.arange(len(letters))
            free[own] += step * counts
        self.order[at if step > 0 else at - 1] = places


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes of `text` in order, the end of the text being smaller than any letter.

    The leftmost-smaller substrings are sorted by a first induction and named; while names are shared, the string of the
    names is sorted the same way, down to any depth; its order seeds the final induction. A name beyond LETTERS letters is
    written as two digits, which keeps the order of suffixes that start at a first digit.
    """
    text = np.asarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    size = int(text.max()) + 1
    text = text.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int64)  # short ones sort by radix
    small = classify(text)
    left = _leftmost(small).astype(_place_type(n))
    del small
    buckets = _Buckets(text, size)
    first = buckets.induce(left)
    if len(left) < 2:
        return first
    is_left = np.zeros(n, bool)
    is_left[left] = True
    ordered = first[is_left[first]]
    del is_left, first
    names, count = _named(text, left, ordered)
    if count < len(left):
        if count > LETTERS and 5 * len(left) <= 2 * n:
            base = math.isqrt(count - 1) + 1
            digits = suffix_array(np.stack([names // base, names % base], axis=1).ravel())
            ordered = left[digits[digits % 2 == 0] // 2]
        else:
            ordered = left[suffix_array(names)]
    return buckets.induce(ordered)


def _named(text: np.ndarray, left: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Each leftmost-smaller substring's name by its order, equal ones alike, and the number of names.

    Substrings run to the next leftmost-smaller place inclusive; that to the end of the text has no equal.
    """
    m = len(left)
    lengths = np.r_[left[1:] + 1, len(text)] - left
    key = hashes(prefix_sums(text), left, lengths)
    at = np.searchsorted(left, ordered)
    same = (key[at[1:]] == key[at[:-1]]) & (lengths[at[1:]] == lengths[at[:-1]]) & (at[1:] != m - 1) & (at[:-1] != m - 1)
    names = np.empty(m, np.int64)
    names[at] = np.cumsum(np.r_[0, ~same])
    return names, int(names.max()) + 1


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place in the text: the length of the common prefix of a suffix and the one before it in the order.

    Where the letters before both are equal, the length is that of the place before less one; only at the other places
    are prefixes compared, by hashes of doubling and then halving length, all of those places at once.
    """
    n = len(text)
    out = np.zeros(n, _place_type(n))
    if n < 2:
        return out
    other = np.full(n, -1, out.dtype)
    other[order[1:]] = order[:-1]
    reducible = np.zeros(n, bool)
    reducible[1:] = (other[1:] > 0) & (other[:-1] >= 0)
    for start in range(0, n, STRIDE):
        at = start + np.flatnonzero(reducible[start : start + STRIDE])
        reducible[at] = text[at - 1] == text[other[at] - 1]
    own = np.flatnonzero(~reducible & (other >= 0))
    sums = prefix_sums(text)
    for start in range(0, len(own), STRIDE):
        some = own[start : start + STRIDE]
        out[some] = _common(sums, some, other[some].astype(np.int64), n)
    del sums, other
    last = np.arange(n, dtype=out.dtype)
    last[reducible] = 0
    np.maximum.accumulate(last, out=last)
    out = out[last]
    last -= np.arange(n, dtype=last.dtype)
    last[~reducible] = 0
    return out + last


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    length, room = np.zeros(len(a), np.int64), n - np.maximum(a, b)
    less_than = np.zeros(len(a), np.int64)  # a prefix is shorter than what was found and the step that failed

    def tried(rows: np.ndarray, step: int) -> np.ndarray:
        rows = rows[length[rows] + step <= room[rows]]
        x, y = a[rows] + length[rows], b[rows] + length[rows]
        rows = rows[hashes(sums, x, step) == hashes(sums, y, step)]
        length[rows] += step
        return rows

    going, step = np.arange(len(a)), 8
    while len(going):
        less_than[going] = step
        going = tried(going, step)
        step *= 2
    while step > 1:
        step //= 2
        tried(np.flatnonzero(less_than > step), step)
    return length
