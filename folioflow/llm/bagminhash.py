"""BagMinHash: signatures of multisets whose registers agree with the probability of the weighted Jaccard similarity.

Every shingle has, for each dyadic interval of weights (0, 1], (1, 2], (2, 4], ..., a Poisson process of points in
time, each with a register and a place in the interval; it depends on the shingle and the interval alone. A multiset
that holds the shingle w times sees the points at places up to w. A register's value is the time of the first point
it sees. Two multisets agree in a register exactly if the first point under the larger of their weights is one that
both see, which has the probability sum of minima / sum of maxima.

The processes are run in rounds over all shingles of many texts at once, and only as far as a text's registers can still
change: after a time of (ln m + ``SLACK``) / weight all registers are set with probability 1 - e^-``SLACK``; the few texts
that aren't done run on to twice the time. So the work is about m * ln m points and one look at each shingle.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import xxhash

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
SLACK = 4.0
SHINGLE = 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words(dict):
    """Hashes of words, kept up to a bound, and only while a task runs."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = Words()


def forget() -> None:
    """Drops what is kept between batches. Workers outlive their tasks, so tasks call this at their end."""
    _words.clear()


def shingles(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted hashes of its word shingles, repeats included.

    A text of one to four words has one shingle of all of them; a text without words has none. ``bytes.split`` splits
    at exactly the space and the five ASCII line and tab characters.
    """
    each = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(x) for x in each], dtype=np.int64)
    h = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(each)), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    full = np.full(max(0, len(h) - SHINGLE + 1), SHINGLE, np.uint64)
    for i in range(SHINGLE):
        full = mix(full * GOLDEN + h[i : i + len(full)])
    out = []
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= SHINGLE:
            s = full[a : a + n - SHINGLE + 1].copy()
            s.sort()
        else:
            s = np.full(min(n, 1), n, np.uint64)
            for i in range(n):
                s = mix(s * GOLDEN + h[a + i])
        out.append(s)
    return out


def counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of several texts: which text, hash, weight."""
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    s = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], s[at], np.diff(np.append(at, len(s)))


def signatures(parts: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of m times (float64) for each text, given its sorted shingles; infinite for texts without any."""
    doc, s, w = counted(parts)
    total = np.bincount(doc, weights=w, minlength=len(parts))
    out = np.full((len(parts), m), np.inf)
    until = (math.log(m) + SLACK) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        own = todo[doc]
        _run(doc[own], s[own], w[own], until, out, m)
        todo &= ~np.isfinite(out).all(axis=1)
        until = until * 2
    return out


def _run(doc: np.ndarray, s: np.ndarray, w: np.ndarray, until: np.ndarray, out: np.ndarray, m: int) -> None:
    flat = out.reshape(-1)
    for j in range(64):
        low = 0 if j == 0 else 1 << (j - 1)
        some = w > low
        if not some.any():
            return
        d, left = doc[some], w[some] - low
        cells = 1 if j == 0 else low
        z = mix(s[some] ^ np.uint64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        end, x = until[d], np.zeros(len(d))
        while len(d):
            x = x - np.log1p(-((z >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / (m * cells)
            on = x <= end
            d, left, z, end, x = d[on], left[on], z[on], end[on], x[on]
            v = mix(z + GOLDEN)
            at = d * m + ((v >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            if cells > 1:
                seen = (v & np.uint64(cells - 1)).astype(np.int64) < left
                np.minimum.at(flat, at[seen], x[seen])
            else:
                np.minimum.at(flat, at, x)
            z = mix(v + GOLDEN)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    if not len(a) or not len(b):
        return 0.0
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], k[j]).sum())
    return both / (len(a) + len(b) - both)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key a band for each signature."""
    v = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.zeros(v.shape[:2], np.uint64)
    for r in range(ROWS):
        key = mix(key * GOLDEN + v[:, :, r])
    return key.view(np.int64)


def short(sig: np.ndarray) -> np.ndarray:
    """The registers as 16-bit hashes, to estimate similarities by."""
    return (mix(sig.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
