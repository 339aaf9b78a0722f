"""Suffix arrays by induced sorting, and the lengths of common prefixes, on numpy arrays.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost smaller ones (LMS) are sorted
first, and the order of all others is induced from them in one pass up and one pass down. The passes go through the
alphabet a symbol at a time, and what a symbol's bucket induces is moved as a whole, in rounds for runs of one symbol.
Moves are stable sorts of 16-bit symbols, which numpy does by counting (radix), so the induction is linear.
LMS substrings get names in sorted order. If names repeat, the string of names is sorted in turn; as its alphabet is
about as large as the string, that is done by doubling ranks up to `depth` bytes, beyond which callers don't look.
"""

from __future__ import annotations

import numpy as np


def _types(x: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; x ends in a sentinel below all else."""
    n = len(x)
    at = np.where(x[:-1] != x[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = x[at] < x[at + 1]
    return out


class _Buckets:
    """Places where the buckets of the symbols begin or end, moved on as entries come in."""

    def __init__(self, at: np.ndarray, step: int, into: np.ndarray):
        self.at, self.step, self.into = at.copy(), step, into

    def put(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        s, c = suffixes[order], symbols[order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        count = np.diff(np.append(first, len(c)))
        nth = np.arange(len(c)) - np.repeat(first, count)
        if self.step > 0:
            self.into[self.at[c] + nth] = s
        else:
            self.into[self.at[c] - 1 - nth] = s
        self.at[c[first]] += self.step * count


def _induce(x: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in an order that agrees with that of `lms`."""
    n = len(x)
    count = np.bincount(x, minlength=size)
    ends = np.cumsum(count)
    begins = ends - count
    sa = np.full(n, -1, np.int64)
    up = _Buckets(begins, 1, sa)
    by = x[lms]
    order = np.argsort(by, kind="stable")
    lms, by = lms[order], by[order]
    lo, hi = np.searchsorted(by, np.arange(size)), np.searchsorted(by, np.arange(size), "right")
    present = np.flatnonzero(count)
    for c in present:
        done = begins[c]
        while done < up.at[c]:
            got = sa[done : up.at[c]] - 1
            done = up.at[c]
            got = got[got >= 0]
            got = got[~small[got]]
            if len(got):
                up.put(got, x[got])
        got = lms[lo[c] : hi[c]] - 1
        got = got[got >= 0]
        if len(got):
            up.put(got, x[got])
    larger_end = up.at.copy()
    down = _Buckets(ends, -1, sa)
    sa[0] = n - 1  # the sentinel, the only suffix of its bucket
    for c in present[::-1]:
        done = ends[c]
        while done > down.at[c]:
            got = sa[down.at[c] : done][::-1] - 1
            done = down.at[c]
            got = got[got >= 0]
            got = got[small[got]]
            if len(got):
                down.put(got, x[got])
        got = sa[begins[c] : larger_end[c]][::-1] - 1
        got = got[got >= 0]
        got = got[small[got]]
        if len(got):
            down.put(got, x[got])
        if c == x[n - 1] and n > 1 and small[n - 2]:
            down.put(np.array([n - 2]), x[n - 2 : n - 1])
    return sa


def _doubled(names: np.ndarray, steps: int) -> np.ndarray:
    """The order of the suffixes of `names`, by their first 2**steps symbols at least; only those that are still tied
    are moved."""
    n = len(names)
    order = np.argsort(names)
    live, key = np.arange(n), names[order]
    rank = np.zeros(n, np.int64)
    width = 1
    while True:
        fresh = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(fresh)
        rank[order[live]] = np.repeat(live[first], np.diff(np.append(first, len(live))))
        live = live[~(fresh & np.append(fresh[1:], True))]
        if not len(live) or steps <= 0:
            return order
        tied = order[live]
        after = np.minimum(tied + width, n)
        key = rank[tied] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        moved = np.argsort(key, kind="stable")  # nearly in order
        order[live] = tied[moved]
        key = key[moved]
        width *= 2
        steps -= 1


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the bytes, in order of their first `depth` bytes at least."""
    x = np.append(data.astype(np.int16) + 1, np.int16(0))
    small = _types(x)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        sa = _induce(x, small, lms, 257)
        sorted_lms = sa[is_lms[sa]]
        place = np.zeros(len(x), np.int64)
        place[lms] = np.arange(len(lms))
        length = np.diff(np.append(lms, len(x) - 1)) + 1
        a, b = sorted_lms[:-1], sorted_lms[1:]
        la = length[place[a]]
        same = la == length[place[b]]
        live, t = np.flatnonzero(same), 0
        while len(live):
            eq = x[a[live] + t] == x[b[live] + t]
            same[live[~eq]] = False
            t += 1
            live = live[eq]
            live = live[la[live] > t]
        names = np.zeros(len(x), np.int64)
        names[sorted_lms] = np.append(0, np.cumsum(~same))
        reduced = names[lms]
        if len(lms) > 1 and reduced.max() + 1 < len(lms):
            lms = lms[_doubled(reduced, max(1, int(np.ceil(np.log2(depth / 2 + 2)))))]
        else:
            lms = lms[np.argsort(reduced, kind="stable")]
    return _induce(x, small, lms, 257)[1:]


def common_prefixes(data: np.ndarray, order: np.ndarray, rest: np.ndarray, consecutive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of `order`, permuted to text positions: the suffix before it, and the length of their common prefix.

    Where the suffix before p is one behind that before p - 1, the length is one less than at p - 1; only the other
    places, the irreducible ones, are compared, eight bytes at a time. `rest`: the bytes from a position to the end
    of its piece, which no prefix goes beyond; `consecutive`: whether p - 1 is a suffix of `order` too.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    hard = at[~(consecutive[at] & (before[at - 1] >= 0) & (before[at] == before[at - 1] + 1) & (data[at - 1] == data[before[at] - 1]))]
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word |= padded[j : n + j] << np.uint64(8 * j)
    a, b = hard, before[hard]
    most = np.minimum(rest[a], rest[b])
    got = np.zeros(len(hard), np.int64)
    live = np.arange(len(hard))
    while len(live):
        x = word[a[live] + got[live]] ^ word[b[live] + got[live]]
        equal = x == 0
        off = live[~equal]
        low = x[~equal]
        low = low & (~low + np.uint64(1))
        got[off] += np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[equal]
        got[live] += 8
        live = live[got[live] < most[live]]
    got = np.minimum(got, most)
    lengths = np.zeros(n, np.int64)
    if len(hard):
        last = np.searchsorted(hard, at, "right") - 1
        lengths[at] = np.maximum(got[last] - (at - hard[last]), 0)
    return before, lengths
