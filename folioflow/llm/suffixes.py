"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes as smaller or larger than their right neighbour, sorts the leftmost-smaller
substrings by inducing, names them, sorts the string of names recursively, and induces the whole array from that
order. On bytes the inducing goes bucket by bucket: everything a bucket holds is taken in waves, one wave for each
step of a run of equal bytes, and dealt to the later buckets by a stable radix sort. So each suffix is moved once a pass. The
strings of names have large alphabets; their arrays are scanned in steps, each as long as it doesn't reach into places that it
fills itself.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour; the last, the sentinel, counts as such."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    small = np.ones(n, bool)
    if len(differs):
        near = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
        small[:-1] = t[near] < t[near + 1]
    return small


def _deal(items: np.ndarray, keys: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append the items to their keys' queues, in order."""
    if not len(items):
        return
    order = np.argsort(keys, kind="stable")
    items, keys = items[order], keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        queues[keys[a]].append(items[a:b])


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that the order of the leftmost-smaller suffixes (or substrings) ``lms`` induces."""
    none = np.empty(0, np.int64)
    join = lambda q: np.concatenate(q) if q else none
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    larges: list[list[np.ndarray]] = [[] for _ in range(size)]
    smalls: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(lms, t[lms], seeds)
    done_large: list[np.ndarray] = [none] * size
    for c in range(size):
        wave, taken = join(larges[c]), []
        while len(wave):
            taken.append(wave)
            j = wave[wave > 0] - 1
            j = j[~small[j]]
            k = t[j]
            same = k == c
            _deal(j[~same], k[~same], larges)
            wave = j[same]
        done_large[c] = join(taken)
        seed = join(seeds[c])
        j = seed[seed > 0] - 1
        _deal(j, t[j], larges)
    done_small: list[np.ndarray] = [none] * size
    for c in range(size - 1, -1, -1):
        wave, taken = join(smalls[c]), []
        if c == t[-1]:
            wave = np.array([len(t) - 1])
        while len(wave):
            taken.append(wave)
            j = wave[wave > 0] - 1
            j = j[small[j]]
            k = t[j]
            same = k == c
            _deal(j[~same], k[~same], smalls)
            wave = j[same]
        done_small[c] = join(taken)[::-1]
        large = done_large[c][::-1]
        j = large[large > 0] - 1
        j = j[small[j]]
        _deal(j, t[j], smalls)
    return np.concatenate([x for c in range(size) for x in (done_large[c], done_small[c])])


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, equal for equal ones, given their sorted order."""
    length = np.append(np.diff(lms) + 1, 1)
    at = np.searchsorted(lms, order)
    size = length[at]
    same = np.zeros(len(order), bool)
    like = np.flatnonzero(size[1:] == size[:-1]) + 1
    if len(like):
        n = size[like]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = t[np.repeat(order[like], n) + within] == t[np.repeat(order[like - 1], n) + within]
        same[like] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    named = np.cumsum(~same) - 1
    out = np.empty(len(lms), np.int64)
    out[at] = named
    return out, int(named[-1]) + 1 if len(named) else 0


def _ranks(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.append(True, k[1:] != k[:-1])
    at = np.arange(len(k))
    out = np.empty(len(k), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def _induce_far(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same inducing over a large alphabet, in steps of many suffixes.

    The scan goes along the array. A step takes what stands before the first place that this step itself would fill, and
    so puts everything in the order of the scan; with large alphabets such places are far ahead. ``ends`` has the ends of the
    buckets.
    """
    n = len(s)
    sa = np.full(n, -1, np.int64)
    tail = ends.copy()
    back = lms[::-1]
    key = s[back]
    sa[tail[key] - 1 - _ranks(key)] = back
    for side in (1, -1):
        free = np.concatenate(([0], ends[:-1])) if side > 0 else ends - 1
        flag = small if side < 0 else ~small
        at, step = (0, 512) if side > 0 else (n - 1, 512)
        if side < 0:
            free = free.copy()
            sa[small[np.maximum(sa, 0)] & (sa >= 0)] = -1  # the seeds give way to the smaller suffixes induced
            sa[0] = n - 1
            free[s[n - 1]] -= 1
        while 0 <= at < n:
            to = min(n, at + step) if side > 0 else max(-1, at - step)
            block = sa[at:to] if side > 0 else sa[to + 1 : at + 1][::-1]
            j = block - 1
            ok = (j >= 0) & (block >= 0)
            ok[ok] = flag[j[ok]]
            where, j = np.flatnonzero(ok), j[ok]
            if len(j):
                key = s[j]
                goal = free[key] + side * _ranks(key)
                near = (goal < to) if side > 0 else (goal > to)
                if near.any():
                    # Stop before the nearest place that is filled from here; what comes to stand there is read later.
                    stop = int(goal[near].min() if side > 0 else goal[near].max())
                    keep = where < abs(stop - at)
                    j, key, goal = j[keep], key[keep], goal[keep]
                    to = stop
                    step = max(32, step // 2)
                else:
                    step = min(8192, step * 2)
                sa[goal] = j
                np.add.at(free, key, side)
            else:
                step = min(8192, step * 2)
            at = to
    return sa


def _large_alphabet(s: np.ndarray, size: int) -> np.ndarray:
    """Induced sorting of a string over 0..size-1 whose last character is its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=size))
    first = _induce_far(s, small, lms, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names, distinct = _names(s, lms, order)
    if distinct < len(lms):
        order = lms[_large_alphabet(names, distinct)]
    return _induce_far(s, small, order, ends)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes (uint8)."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    t = np.zeros(n + 1, np.int16)
    t[:n] = text
    t[:n] += 1
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = _induce(t, small, lms, 257)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names, distinct = _names(t, lms, order)
    if distinct < len(lms):
        order = lms[_large_alphabet(names, distinct)]
    return _induce(t, small, order, 257)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix in text order, how long it agrees with the suffix before it in the suffix array.

    Where the bytes before the two suffixes are equal, too, the value is one less than the one to the left; only the others,
    the irreducible ones, are found by comparing, and these add up to n log n at most.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    reducible = (i > 0) & (before > 0)
    reducible[reducible] = text[i[reducible] - 1] == text[before[reducible] - 1]
    start = np.flatnonzero(~reducible)
    todo = start[before[start] >= 0]
    padded = np.concatenate([text.astype(np.int16), np.full(65, -1, np.int16)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 64)
    length = np.zeros(n, np.int64)
    while len(todo):
        nxt = []
        for k in range(0, len(todo), 20_000):
            p = todo[k : k + 20_000]
            a, b = p + length[p], before[p] + length[p]
            unlike = view[np.minimum(a, n)] != view[np.minimum(b, n)]
            unlike |= view[np.minimum(a, n)] < 0
            stop = unlike.any(axis=1)
            length[p] += np.where(stop, unlike.argmax(axis=1), 64)
            nxt.append(p[~stop])
        todo = np.concatenate(nxt)
    left = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.maximum(length[left] - (i - left), 0)
