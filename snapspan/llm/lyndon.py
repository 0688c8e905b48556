"""Suffix sorting by grouping: Lyndon-prefix groups in descending order, then each group's order in one pass."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a string of integers in ascending order; a suffix that is a prefix of another comes first.

    First phase: suffixes start grouped by their first symbol. Groups are taken from the highest down. Each member points at the
    nearest suffix before it in a lower group; what is pointed at starts with its own prefix followed by the prefix of the group, once for each
    pointer, so it leaves its group for a new one right above, those with more pointers further up. In the end a group
    holds the suffixes with one longest Lyndon prefix. Second phase: from the smallest suffix on, the suffixes whose
    next smaller suffix it is take the next place of their group. Both are linear; no string is renamed or sorted again.
    """
    n = len(symbols) + 1
    _, rank = np.unique(symbols, return_inverse=True)
    rank = np.append(rank + 1, 0)  # an end that is below all symbols
    place = np.argsort(rank, kind="stable")
    where = np.empty(n, np.int64)
    where[place] = np.arange(n)
    starts = np.searchsorted(rank[place], np.arange(rank.max() + 2))
    group = starts[rank].tolist()
    size = [0] * n
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b > a:
            size[a] = b - a
    place, where = place.tolist(), where.tolist()
    before = [-1] * n

    top = n - 1
    while top >= 0:
        low = group[place[top]]
        pointed: dict[int, int] = {}
        for i in sorted(place[low : top + 1]) if top > low else (place[top],):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_count: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for p in by_count[k]:
                    g = group[p]
                    size[g] -= 1
                    end, at = g + size[g], where[p]
                    other = place[end]
                    place[at], place[end] = other, p
                    where[other], where[p] = at, end
                    moved[g] = moved.get(g, 0) + 1
                for p in by_count[k]:
                    g = group[p]
                    group[p] = g + size[g]
                for g, m in moved.items():
                    size[g + size[g]] = m
        top = low - 1

    out, done, front = [0] * n, [False] * n, list(range(n))
    out[0], done[n - 1] = n - 1, True
    front[group[n - 1]] += 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = True
            j = before[j]
    return np.array(out[1:], np.int64)
