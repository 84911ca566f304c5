"""Suffix arrays by induced sorting, with the permuted common prefixes of neighbours; numpy, one shard at a time."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour. The last symbol is the unique smallest."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    nearest = np.full(n, n - 1, np.int64)
    at = np.searchsorted(differs, np.arange(n - 1))
    inside = at < len(differs)
    nearest[:-1][inside] = differs[at[inside]]
    small = np.zeros(n, bool)
    j = nearest[:-1][inside]
    small[:-1][inside] = s[j] < s[j + 1]
    small[-1] = True
    return small


def _deal(to: dict, symbols: np.ndarray, suffixes: np.ndarray) -> None:
    """Appends suffixes to the lists of their first symbols, keeping their order."""
    if not len(suffixes):
        return
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for at, part in zip(np.concatenate([[0], cuts]), np.split(suffixes, cuts)):
        to[int(symbols[at])].append(part)


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in the order that the order of the seeds (leftmost-smaller suffixes) induces: the larger suffixes
    bucket by bucket from the left, then the smaller ones from the right. A bucket is worked on at once; what it puts
    into itself follows in rounds."""
    empty = np.zeros(0, np.int32)
    join = lambda parts: np.concatenate(parts) if parts else empty
    of_seeds, larger = {c: [] for c in range(alphabet)}, {c: [] for c in range(alphabet)}
    _deal(of_seeds, s[seeds], seeds)
    for c in range(alphabet):
        parts = larger[c]
        now = join(parts)
        while len(now):
            before = now[now > 0] - 1
            now = before[(s[before] == c) & ~small[before]]
            if len(now):
                parts.append(now)
        larger[c] = join(parts)
        every = np.concatenate([larger[c], join(of_seeds[c])])
        before = every[every > 0] - 1
        first = s[before]
        go = (first > c) & ~small[before]
        _deal(larger, first[go], before[go])
    smaller = {c: [] for c in range(alphabet)}  # from the right end of each bucket
    for c in range(alphabet - 1, -1, -1):
        parts = smaller[c] if c else [np.array([len(s) - 1], np.int32)]
        now = join(parts)
        while len(now):
            before = now[now > 0] - 1
            now = before[(s[before] == c) & small[before]]
            if len(now):
                parts.append(now)
        smaller[c] = join(parts)
        every = np.concatenate([smaller[c], larger[c][::-1]])
        before = every[every > 0] - 1
        first = s[before]
        go = (first < c) & small[before]
        _deal(smaller, first[go], before[go])
    return np.concatenate([x for c in range(alphabet) for x in (larger[c], smaller[c][::-1])])


def _same_substrings(s: np.ndarray, small: np.ndarray, seed: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each seed in `order` has the same leftmost-smaller substring as the one before it."""
    n = len(s)
    ends = np.full(n, n - 1, np.int32)
    starts = np.flatnonzero(seed)
    ends[starts[:-1]] = starts[1:]
    a, b = order[:-1], order[1:]
    size = ends[a] - a
    same = (ends[b] - b) == size
    live, step = np.flatnonzero(same), 0
    while len(live):
        same[live] = s[a[live] + step] == s[b[live] + step]
        step += 1
        live = live[same[live] & (step <= size[live])]
    return np.concatenate([[False], same])


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Start positions of the suffixes of s in order. s ends with its only 0.

    Alphabets above 4,096 (recursion over names) rank by doubling instead of bucket rounds.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    if alphabet > 4096:
        return _doubled(s)
    small = _types(s)
    seed = np.zeros(n, bool)
    seed[1:] = small[1:] & ~small[:-1]
    starts = np.flatnonzero(seed).astype(np.int32)
    if len(starts) <= 1:
        return _induce(s, small, starts, alphabet)
    rough = _induce(s, small, starts, alphabet)
    order = rough[seed[rough]]
    names = np.cumsum(~_same_substrings(s, small, seed, order)) - 1
    if names[-1] + 1 < len(starts):
        name_of = np.zeros(n, np.int32)
        name_of[order] = names
        order = starts[suffix_array(name_of[starts], int(names[-1]) + 1)]
    return _induce(s, small, order, alphabet)


def _doubled(s: np.ndarray) -> np.ndarray:
    rank, width, n = s.astype(np.int64), 1, len(s)
    while True:
        after = np.zeros(n, np.int64)
        after[:-width or n] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1:
            return order.astype(np.int32)
        rank, width = new, 2 * width


def permuted_prefixes(s: np.ndarray, order: np.ndarray, stop: int, most: int) -> np.ndarray:
    """For each position (text order): symbols that its suffix shares with the one before it in the order, at most
    `most`, symbols up to `stop` (separators) ending the comparison."""
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    plcp = np.zeros(n, np.uint8)
    live = np.flatnonzero(before >= 0)
    for k in range(most):
        i, j = live + k, before[live] + k
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        live = live[(s[i] == s[j]) & (s[i] > stop)]
        plcp[live] = k + 1
        if not len(live):
            break
    return plcp
