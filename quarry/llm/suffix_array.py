"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are S (smaller than the next) or L (larger). The leftmost S suffixes of each run (LMS) are sorted by their
substrings, recursively where substrings repeat; all others are induced from them in two linear sweeps. A sweep visits
the buckets of first symbols in turn; within a bucket everything known so far is handled as one wave, so Python's cost
follows the symbols and not the suffixes. A reduced string with a large alphabet is ordered by rank doubling instead.
"""

from __future__ import annotations

import numpy as np

from quarry.llm.fm_index import suffix_order


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; t ends with its only smallest symbol."""
    n = len(t)
    at = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = t[turn] < t[np.minimum(turn + 1, n - 1)]
    return small


def _ranks(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted groups: rank within the group, first place and size of each."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    size = np.diff(np.append(first, len(groups)))
    return np.arange(len(groups)) - np.repeat(first, size), first, size


def _induce(t: np.ndarray, k: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    n = len(t)
    count = np.bincount(t, minlength=k)
    end = np.cumsum(count)
    start = end - count
    n_large = np.bincount(t[~small], minlength=k)
    sa = np.full(n, -1, np.int64)
    lms = lms[np.argsort(t[lms], kind="stable")]
    lms_count = np.bincount(t[lms], minlength=k)
    lms_end = np.cumsum(lms_count)
    present = np.flatnonzero(count)

    ptr = start.copy()

    def push_large(cur: np.ndarray) -> None:
        p = cur - 1
        p = p[(p >= 0) & ~small[p]]
        if len(p):
            p = p[np.argsort(t[p], kind="stable")]
            c = t[p]
            rank, first, size = _ranks(c)
            sa[ptr[c] + rank] = p
            ptr[c[first]] += size

    for c in present:
        i = start[c]
        while i < ptr[c]:
            j = ptr[c]
            push_large(sa[i:j].copy())
            i = j
        if lms_count[c]:
            push_large(lms[lms_end[c] - lms_count[c] : lms_end[c]])

    ptr = end.copy()
    sa[0] = n - 1
    ptr[t[n - 1]] = start[t[n - 1]]

    def push_small(cur: np.ndarray) -> None:
        p = cur - 1
        p = p[(p >= 0) & small[p]]
        if len(p):
            p = p[np.argsort(t[p], kind="stable")]
            c = t[p]
            rank, first, size = _ranks(c)
            sa[ptr[c] - 1 - rank] = p
            ptr[c[first]] -= size

    for c in present[:0:-1]:  # the last symbol's bucket induces nothing here
        j = end[c]
        while j > ptr[c]:
            i = ptr[c]
            push_small(sa[i:j][::-1].copy())
            j = i
        if n_large[c]:
            push_small(sa[start[c] : start[c] + n_large[c]][::-1].copy())
    return sa


def _same_neighbours(t: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For neighbours in at: are the substrings of the given sizes equal?"""
    same = size[1:] == size[:-1]
    a, b, m = at[:-1][same], at[1:][same], size[:-1][same]
    if len(m):
        base = np.cumsum(m) - m
        step = np.arange(int(m.sum())) - np.repeat(base, m)
        equal = t[np.repeat(a, m) + step] == t[np.repeat(b, m) + step]
        same[same] = np.logical_and.reduceat(equal, base)
    return same


def _sorted(t: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    if n < 256 or k > max(1024, n // 64):
        return suffix_order(t)
    small = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, k, small, lms)
    by_substring = sa[is_lms[sa]]
    size = np.zeros(n, np.int64)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    new = ~_same_neighbours(t * 2 + small, by_substring, size[by_substring])
    names = np.concatenate([[0], np.cumsum(new)])
    if names[-1] + 1 < len(lms):
        name_at = np.zeros(n, np.int64)
        name_at[by_substring] = names
        by_substring = lms[_sorted(name_at[lms], int(names[-1]) + 1)]
    return _induce(t, k, small, by_substring)


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a byte string in order; a suffix that ends sorts first."""
    t = np.append(raw.astype(np.int64) + 1, 0)
    return _sorted(t, 257)[1:]


def permuted_common_prefixes(raw: np.ndarray, sa: np.ndarray, upto: int) -> np.ndarray:
    """By text position: the length, up to `upto`, that a suffix shares with the one before it in order.

    Where the bytes before both suffixes are equal, the length is one less than at the position before; only the other
    positions are compared, eight bytes at a time."""
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    reducible = (here > 0) & (before > 0)
    reducible[reducible] = raw[here[reducible] - 1] == raw[before[reducible] - 1]
    # a capped length at the position before says nothing about this one beyond the cap, so all chains restart there
    at = np.flatnonzero(~reducible & (before >= 0))
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (n + 8,), (1,))
    value = np.zeros(n, np.int64)
    live, length = at, np.zeros(len(at), np.int64)
    slot = np.arange(len(at))
    while len(live):
        a, b = live + length[slot], before[live] + length[slot]
        inside = (a < n) & (b < n)
        x = np.ones(len(live), np.uint64)
        x[inside] = words[a[inside]] ^ words[b[inside]]
        low = x & (~x + np.uint64(1))
        more = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        room = np.minimum(n - a, n - b)
        length[slot] += np.minimum(more, np.maximum(room, 0))
        go = (x == 0) & (room > 8)
        live, slot = live[go], slot[go]
    value[at] = length
    last = np.maximum.accumulate(np.where(~reducible, here, -1))
    value = np.where(reducible, np.maximum(value[last] - (here - last), 0), value)
    return np.minimum(value, upto)
