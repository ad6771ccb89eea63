"""Suffix arrays by linear grouping on Lyndon prefixes.

Every suffix belongs to the group of its longest Lyndon prefix. Groups are
handled from high to low: a suffix of the current group looks left, over
previous-smaller pointers, for the nearest suffix of a lower group, and the
suffixes found so are split off upwards from their groups, those first that
precede more repeats. Each suffix is handled once. Afterwards the smallest
suffixes hand out the places within the groups in order. Nothing is renamed
and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (any integers), in order; a suffix sorts before its extensions."""
    ranks = np.asarray(symbols, dtype=np.int64)
    n = len(ranks)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(ranks, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ranks[order]) != 0])
    sizes = np.diff(np.r_[first, n])
    # A group is named by the first place it takes up in the result.
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(first, sizes)
    group: list[int] = group_of.tolist()
    by_place = order.tolist()
    size, members, ending = [0] * n, [()] * n, [0] * n
    for g, count in zip(first.tolist(), sizes.tolist()):
        size[g], members[g], ending[g + count - 1] = count, by_place[g : g + count], g
    smaller = [-1] * n

    end = n - 1
    while end >= 0:
        current = ending[end]
        end = current - 1
        own = members[current]
        if size[current] == 1:
            s = own[0] if len(own) == 1 else next(s for s in own if group[s] == current)
            p = s - 1
            while p >= 0 and group[p] > current:
                p = smaller[p]
            smaller[s] = p
            if p >= 0 and size[old := group[p]] > 1:
                size[old] = left = size[old] - 1
                new = old + left
                size[new], members[new], ending[new], ending[new - 1] = 1, (p,), new, old
                group[p] = new
            continue
        repeats: dict[int, int] = {}
        for s in sorted(s for s in own if group[s] == current):
            p = s - 1
            while p >= 0 and group[p] > current:
                p = smaller[p]
            if p >= 0 and group[p] == current:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                repeats[p] = repeats.get(p, 0) + 1
        if not repeats:
            continue
        split: dict[tuple[int, int], list[int]] = {}
        for p, times in repeats.items():
            split.setdefault((times, group[p]), []).append(p)
        for (_, old), suffixes in sorted(split.items(), reverse=True):
            left = size[old] - len(suffixes)
            if not left:
                continue
            new = old + left
            ending[new + len(suffixes) - 1] = new
            ending[new - 1] = old
            size[old], size[new] = left, len(suffixes)
            members[new] = suffixes
            for p in suffixes:
                group[p] = new

    result = [0] * n
    free = list(range(n))
    placed = bytearray(n)
    at, k = n, 0
    while True:
        s = at - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            result[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = smaller[s]
        if k == n:
            return np.array(result, np.int64)
        at = result[k]
        k += 1


def common_prefixes(symbols: np.ndarray, suffixes: np.ndarray, most: int | None = None) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order (0 for the first), or ``most`` if longer."""
    symbols = np.asarray(symbols)
    n = len(symbols)
    common = np.zeros(n, np.int64)
    live = np.arange(1, n)
    d = 0
    while len(live) and (most is None or d < most):
        a, b = suffixes[live - 1] + d, suffixes[live] + d
        fits = np.maximum(a, b) < n
        live, a, b = live[fits], a[fits], b[fits]
        live = live[symbols[a] == symbols[b]]
        common[live] += 1
        d += 1
    return common
