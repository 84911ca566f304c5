"""Matching blocks of the pairs in an Arrow batch, many pairs at once, as arrays.

Grams of `LEVELS` tokens are known by mixed numbers and compared token by token where they meet; what meets on a diagonal
makes runs, and in rounds each gap gives its longest run and splits. A pair whose grams meet more than `MOST` times first
gets longer grams, then its diagonals one by one, so memory is bounded by the runs. Tokens are numbered within a slice of
a batch; nulls are equal.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lengths of the grams that meet, one level after the other; the last must be 1.
LEVELS = (8, 2, 1)
#: Tokens of the pairs that are looked at together, and places that may meet at once.
SLICE, MOST = 1 << 18, 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(first, count):
    """first, first + 1, ... (count of them) for each, in one array."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class _Side:
    """Tokens as numbers, and their grams."""

    def __init__(self, codes):
        self.codes, self.of = codes, {1: _mixed(codes.astype(np.uint64) + _ODD)}

    def grams(self, k):
        """A number for the k tokens from each place on (k a power of 2)."""
        if k not in self.of:
            half = self.grams(k // 2)
            whole = half * _ODD
            whole[: max(len(half) - k // 2, 0)] += half[k // 2 :]
            self.of[k] = _mixed(whole)
        return self.of[k]


def _meet(a, b, gaps, k, stable=False):
    """For each place of a in the gaps where k tokens start: its first place among those of b in order of their grams, and
    how many are equal."""
    i1, i2, j1, j2 = gaps
    pi, pj = _ranges(i1, i2 - i1 - k + 1), _ranges(j1, j2 - j1 - k + 1)
    own = lambda n: np.repeat(np.arange(len(i1)), n - k + 1)
    ga, gb = own(i2 - i1), own(j2 - j1)
    ka, kb = (_mixed(x.grams(k)[p] + g.astype(np.uint64) * _ODD) for x, p, g in ((a, pi, ga), (b, pj, gb)))
    order = np.argsort(kb, kind="stable" if stable else None)
    kb = kb[order]
    first = np.flatnonzero(np.concatenate(([True], kb[1:] != kb[:-1])))
    count = np.diff(np.append(first, len(kb)))
    at = np.minimum(np.searchsorted(kb[first], ka), len(first) - 1)
    return pi, pj[order], ga, gb[order], first[at], np.where(kb[first][at] == ka, count[at], 0)


def _runs(a, b, gaps, k):
    """(i, j, n) of the runs of k tokens or more in the gaps; None if too many places meet."""
    pi, pj, ga, gb, first, count = _meet(a, b, gaps, k)
    if count.sum() > MOST:
        return None
    i, g = np.repeat(pi, count), np.repeat(ga, count)
    at = _ranges(first, count)
    j = pj[at]
    same = g == gb[at]
    for n in range(k):
        same &= a.codes[i + n] == b.codes[j + n]
    i, j = i[same], j[same]
    wide = len(a.codes) + 1
    key = np.sort((j - i + len(a.codes)) * wide + i)
    start = np.flatnonzero(np.concatenate(([True], np.diff(key) != 1))) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(key))) + k - 1
    i = key[start] % wide
    return i, key[start] // wide - len(a.codes) + i, n


def _by_diagonal(a, b, gaps, k):
    """As _runs, one diagonal after the other."""
    found = []
    for i1, i2, j1, j2 in zip(*gaps):
        for d in range(j1 - i2 + 1, j2 - i1):
            low, high = max(i1, j1 - d), min(i2, j2 - d)
            if high - low >= k:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (a.codes[low:high] == b.codes[low + d : high + d]).view(np.int8), [0]))))
                n = edge[1::2] - edge[::2]
                i = low + edge[::2][n >= k]
                found.append((i, i + d, n[n >= k]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _longest(runs, gap, width, k):
    """Blocks of all gaps: of each its longest run, the first in i, then in j; then left and right of it."""
    i, j, n = runs
    order = np.argsort(gap, kind="stable")
    i, j, n, gap = i[order], j[order], n[order], gap[order]
    found = [(np.empty(0, np.int64),) * 3]
    while len(i):
        new = np.concatenate(([True], gap[1:] != gap[:-1]))
        start, own = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.maximum.reduceat(n, start)
        place = np.minimum.reduceat(np.where(n == size[own], i * width + j, np.iinfo(np.int64).max), start)
        found.append((place // width, place % width, size))
        x, y, s = (v[own] for v in found[-1])
        left = np.minimum(np.minimum(n, x - i), y - j)
        cut = np.maximum(np.maximum(x + s - i, y + s - j), 0)
        p, q = left >= k, n - cut >= k
        i, j, n, gap = (np.concatenate(v) for v in ((i[p], (i + cut)[q]), (j[p], (j + cut)[q]), (left[p], (n - cut)[q]), (2 * own[p], 2 * own[q] + 1)))
        order = np.argsort(gap, kind="stable")
        i, j, n, gap = i[order], j[order], n[order], gap[order]
    return tuple(np.concatenate(v) for v in zip(*found))


def _single(a, b, gaps):
    """Blocks of one token: the next is the first that lies after the last one taken in its gap."""
    pi, pj, ga, gb, first, count = _meet(a, b, gaps, 1, stable=True)
    there = np.flatnonzero(count)
    out, gap, after = [], -1, 0
    if len(there):
        places, codes = pj.tolist(), b.codes
        for i, g, x, y in zip(pi[there].tolist(), ga[there].tolist(), first[there].tolist(), (first + count)[there].tolist()):
            if g != gap:
                gap, after = g, 0
            at = bisect.bisect_left(places, after, x, y)
            if at < y and codes[places[at]] == a.codes[i] and gb[at] == g:
                out.append((i, places[at]))
                after = places[at] + 1
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j, np.ones(len(i), np.int64)


def _joined(blocks, ends):
    """Blocks and the ends of pairs in order, neighbours joined; which of them are ends."""
    (i, j, n), (ei, ej) = blocks, ends
    order = np.argsort(np.concatenate((2 * i + 1, 2 * ei)), kind="stable")
    i, j, n = (np.concatenate(x)[order] for x in ((i, ei), (j, ej), (n, np.zeros(len(ei), np.int64))))
    follows = np.zeros(len(i), bool)
    follows[1:] = (n[1:] > 0) & (n[:-1] > 0) & ((i + n)[:-1] == i[1:]) & ((j + n)[:-1] == j[1:])
    heads = np.flatnonzero(~follows)
    return i[heads], j[heads], np.add.reduceat(n, heads) if len(heads) else n


def _between(blocks, k):
    """The gaps before blocks that have room for k tokens on both sides."""
    i, j, n = blocks
    i1, j1 = (np.concatenate(([0], (x + n)[:-1])) for x in (i, j))
    room = (i - i1 >= k) & (j - j1 >= k)
    return i1[room], i[room], j1[room], j[room]


def _level(a, b, blocks, ends, k, one):
    """Blocks with those that common runs of k tokens add; None if the pairs are too many for one go."""
    gaps = _between(blocks, k)
    if not len(gaps[0]):
        return blocks
    if k == 1:
        found = _single(a, b, gaps)
    else:
        runs = _runs(a, b, gaps, k)
        if runs is None and not one:
            return None
        if runs is None and (gaps[1] - gaps[0]).max() >= 4 * k:
            blocks = _level(a, b, blocks, ends, 4 * k, one)
            gaps = _between(blocks, k)
            runs = _runs(a, b, gaps, k) if len(gaps[0]) else (np.empty(0, np.int64),) * 3
        if runs is None:
            runs = _by_diagonal(a, b, gaps, k)
        found = _longest(runs, np.searchsorted(gaps[0], runs[0], "right"), len(b.codes) + 1, k)
    real = blocks[2] > 0
    return _joined(tuple(np.concatenate((x[real], y)) for x, y in zip(blocks, found)), ends)


def _of_pairs(a, b, ao, bo):
    """i, j, size of the blocks of pairs a[ao[n]:ao[n + 1]], b[bo[n]:bo[n + 1]], counted through all pairs; 0: a pair's end."""
    x, y, ends = _Side(a), _Side(b), (ao[1:], bo[1:])
    blocks = (*ends, np.zeros(len(ends[0]), np.int64))
    for k in LEVELS:
        blocks = _level(x, y, blocks, ends, k, len(ao) == 2)
        if blocks is None:
            half = len(ao) // 2
            parts = [_of_pairs(a[p[0] : p[-1]], b[q[0] : q[-1]], p - p[0], q - q[0]) for p, q in ((ao[: half + 1], bo[: half + 1]), (ao[half:], bo[half:]))]
            return tuple(np.concatenate((parts[0][c], parts[1][c] + n)) for c, n in enumerate((ao[half], bo[half], 0)))
    return blocks


def _first_equal(a, b, ao, bo):
    """For each pair the first one that is equal to it."""
    sums = []
    for codes, at in ((a, ao), (b, bo)):
        place = np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
        sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(codes.astype(np.uint64) + place.astype(np.uint64) * _ODD)))))
    known = [(s[at[1:]] - s[at[:-1]]) for s, at in zip(sums, (ao, bo))]
    _, first, which = np.unique(_mixed(known[0] * _ODD + known[1]), return_index=True, return_inverse=True)
    first = first[which.reshape(-1)]
    rows = np.flatnonzero(first != np.arange(len(first)))
    same = np.ones(len(rows), bool)
    for codes, at in ((a, ao), (b, bo)):
        n = np.diff(at)
        same &= n[rows] == n[first[rows]]
    for codes, at in ((a, ao), (b, bo)):
        n = np.where(same, np.diff(at)[rows], 0)
        off = np.repeat(np.arange(len(rows)), n)[codes[_ranges(at[rows], n)] != codes[_ranges(at[first[rows]], n)]]
        same[off] = False
    first[rows[~same]] = rows[~same]
    return first


def _taken(offsets, rows):
    """Places of the items of some rows, and the rows' offsets."""
    n = np.diff(offsets)[rows]
    return _ranges(offsets[rows], n), np.concatenate(([0], np.cumsum(n)))


def blocks_of(a: pa.Array, b: pa.Array):
    """For lists a and b of a batch: rows' offsets, i, j, size of their blocks, each row's last (ends, 0). Equal pairs of a
    slice are matched once."""
    lengths = [np.asarray(pc.fill_null(pc.list_value_length(x), 0), dtype=np.int64) for x in (a, b)]
    total, low, counts, out = np.cumsum(lengths[0] + lengths[1]), 0, [], []
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + SLICE, "right")))
        ao, bo = (np.concatenate(([0], np.cumsum(n[low:high]))) for n in lengths)
        tokens = pa.concat_arrays([x.slice(low, high - low).flatten() for x in (a, b)]).dictionary_encode("encode")
        codes = np.asarray(tokens.indices).astype(np.int64)
        codes = codes[: ao[-1]], codes[ao[-1] :]
        first = _first_equal(*codes, ao, bo)
        kinds, which = np.unique(first, return_inverse=True)
        (pa_, ko), (pb_, lo) = _taken(ao, kinds), _taken(bo, kinds)
        i, j, n = _of_pairs(codes[0][pa_], codes[1][pb_], ko, lo)
        row = np.cumsum(n == 0) - (n == 0)  # a pair's end is its last
        i, j = i - ko[row], j - lo[row]
        at = np.concatenate(([0], np.flatnonzero(n == 0) + 1))
        every, to = _taken(at, which.reshape(-1))
        counts.append(np.diff(to))
        out.append((i[every], j[every], n[every]))
        low = high
    i, j, n = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
    return np.concatenate(([0], *map(np.cumsum, [np.concatenate(counts)] if counts else []))), i, j, n
