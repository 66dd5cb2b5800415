"""Suffix arrays by a linear grouping construction.

Phase 1 groups the suffixes by their longest Lyndon prefix. Groups are
processed in descending order; each suffix of a group finds its parent, the
previous suffix of a smaller group, by previous-smaller pointers. The group's
Lyndon word extends the parents' prefix, so parents that have it once, twice,
and so on leave their group for new ones just after it, in that order.

Phase 2 emits the suffixes in order: those of one group have the same Lyndon
prefix and so are in the order of the suffixes that follow it. Taking suffixes
as they are emitted, each puts the ones whose prefix ends where it begins at
the next free place of their group. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text) -> list[int]:
    """The starts of the suffixes of a sequence of integers, in lexicographic order."""
    values = np.asarray(text, dtype=np.int64)
    n = len(values)
    if n == 0:
        return []
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    flat = order.tolist()
    bounds = [*cuts.tolist(), n]
    members = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]  # by group
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    # Groups are in a linked list from small to large.
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    parent = [-1] * n
    done = bytearray(n)
    at = len(members) - 1
    chain: list[int] = []  # the groups from large to small
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        chain.append(at)
        if len(own) > 1:
            own.sort()
        times: dict[int, int] = {}
        for i in own:
            # Every suffix that is done lies in this group or a greater one; its pointer leads past them.
            j = i - 1
            while j >= 0 and done[j]:
                j = parent[j]
            parent[i] = j
            done[i] = 1
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if len(times) == 1:
            for j in times:
                p = group[j]
                if len(members[p]) > 1:
                    _after(p, [j], members, group, below, above)
        elif times:
            split: dict[tuple[int, int], list[int]] = {}
            for j, c in times.items():
                split.setdefault((group[j], c), []).append(j)
            for (p, _), js in sorted(split.items(), reverse=True):  # the most times first: later ones come below it
                _after(p, js, members, group, below, above)
        at = below[at]
    # Phase 2. ends[s] leads through the suffixes whose Lyndon prefix ends where s begins.
    ends, nexts = [-1] * (n + 1), [-1] * n
    open_: list[int] = []
    for i in range(n):  # a node's subtree is closed by the first later position that isn't below it
        p = parent[i]
        while open_ and open_[-1] != p:
            k = open_.pop()
            nexts[k] = ends[i]
            ends[i] = k
        open_.append(i)
    for k in open_:
        nexts[k] = ends[n]
        ends[n] = k
    start = [0] * len(members)
    total = 0
    for g in reversed(chain):
        start[g] = total
        total += len(members[g])
    out = [0] * n
    s, r = n, 0
    while True:
        k = ends[s]
        while k >= 0:
            g = group[k]
            out[start[g]] = k
            start[g] += 1
            k = nexts[k]
        if r == n:
            return out
        s = out[r]
        r += 1


def _after(p: int, js: list[int], members, group, below, above) -> None:
    """Move suffixes from group p to a new group just above it."""
    g = len(members)
    members.append(js)
    for j in js:
        group[j] = g
    up = above[p]
    below.append(p)
    above.append(up)
    above[p] = g
    if up >= 0:
        below[up] = g
