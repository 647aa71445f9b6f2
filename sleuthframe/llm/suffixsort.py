"""Suffix sorting by linear grouping construction (Baier 2016), for integer alphabets.

Phase 1 sorts suffixes into groups of equal longest Lyndon prefixes: groups are taken in
descending order; each suffix of a group finds its previous smaller one by following the
pointers of suffixes already done, and those parents' prefixes are extended by the group's.
Phase 2 emits each group's order by one pass over the growing suffix array.  Nothing is
renamed or sorted recursively.  Symbols and counts are dealt into buckets, never compared, so
both phases are linear in the length of the text and its largest symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

_UNKNOWN = -2


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(group, previous): start of each suffix's final group in the suffix array, and its previous smaller suffix (-1: none).

    ``text`` ends with its unique smallest symbol.
    """
    n = len(text)
    dealt: list[list[int]] = [[] for _ in range(max(text, default=-1) + 1)]
    for i, symbol in enumerate(text):
        dealt[symbol].append(i)
    order = [i for those in dealt for i in those]
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for rank, i in enumerate(order):
        if rank and text[i] != text[order[rank - 1]]:
            start = rank
        place[i], group[i] = rank, start
        size[start] += 1
    previous = [_UNKNOWN] * n
    end = n
    while end > 0:
        first = group[order[end - 1]]
        members = order[first:end]
        extended: dict[int, int] = {}
        for i in members:
            # To the left of a member may stand others of its group: all of a row share the smaller one before them.
            row, at = [], i
            while previous[at] == _UNKNOWN:
                row.append(at)
                p = at - 1
                while p >= 0 and group[p] > first:
                    p = previous[p]
                if p < 0 or group[p] < first:
                    break
                at = p
            else:
                p = previous[at]
            for x in row:
                previous[x] = p
            p = previous[i]
            if p >= 0:
                extended[p] = extended.get(p, 0) + 1
        # A prefix followed by more copies of the group's is larger: most copies go to the far end of their group.
        by_count: dict[int, list[int]] = {}
        for j, count in extended.items():
            by_count.setdefault(count, []).append(j)
        for count in range(max(by_count, default=0), 0, -1):
            moved: dict[int, list[int]] = {}
            for j in by_count.get(count, ()):
                g = group[j]
                last = g + size[g] - 1
                other, at = order[last], place[j]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
                size[g] -= 1
                moved.setdefault(g, []).append(j)
            for g, those in moved.items():
                new = g + size[g]
                for j in those:
                    group[j] = new
                size[new] = len(those)
        end = first
    return group, previous


def suffix_array(text: Sequence[int]) -> list[int]:
    """Suffixes of ``text`` in order; it ends with its unique smallest symbol."""
    n = len(text)
    if not n:
        return []
    group, previous = lyndon_groups(text)
    out, done, free = [-1] * n, [False] * n, list(range(n))
    out[0], done[n - 1] = n - 1, True
    free[0] = 1
    for rank in range(n):
        s = out[rank] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = previous[s]
    return out


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix in ``order`` with the one before it (Kasai et al. 2001)."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out
