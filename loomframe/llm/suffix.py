"""Linear-time suffix grouping: suffixes are grouped by their Lyndon prefixes, then each group's order is emitted."""

from __future__ import annotations


def suffix_order(t: list[int]) -> list[int]:
    """The suffix array of t, whose last symbol must be smaller than all others.

    Phase 1 takes the groups from the highest down. For each suffix of the group at hand, the nearest earlier suffix
    of a lower group is its previous-smaller pointer (found over the pointers of suffixes done before). The suffixes
    pointed at have prefixes that go on with the group's prefix: those with more pointers rank higher, and all rank
    just above what is left of their own group. No group is ever renamed: a split appends one.
    Phase 2 runs up the order: the suffixes whose prefix ends where a sorted suffix begins are next in their groups.
    """
    n = len(t)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(t):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    size = [len(m) for m in members]
    last = len(members) - 1
    below = list(range(-1, last))
    above = [*range(1, last + 1), -1]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    before, done = [-1] * n, bytearray(n + 1)
    order = []
    g = last
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        order.append(g)
        for i in own:
            done[i] = 1
        runs: dict[int, list[int]] = {}
        at, count = -1, 0
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j == at:
                count += 1
            else:
                if at >= 0:
                    runs.setdefault(count, []).append(at)
                at, count = j, 1
        if at >= 0:
            runs.setdefault(count, []).append(at)
        for count in sorted(runs, reverse=True) if len(runs) > 1 else runs:
            parts: dict[int, list[int]] = {}
            for j in runs[count]:
                h = group[j]
                if h in parts:
                    parts[h].append(j)
                else:
                    parts[h] = [j]
            for h, part in parts.items():
                k = len(part)
                if k == size[h]:
                    continue
                new = len(members)
                members.append(part)
                size.append(k)
                size[h] -= k
                up = above[h]
                below.append(h)
                above.append(up)
                above[h] = new
                if up >= 0:
                    below[up] = new
                for j in part:
                    group[j] = new
        g = below[g]
    front, start = [0] * len(members), 0
    for g in reversed(order):
        front[g] = start
        start += size[g]
    out, placed = [-1] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = before[j]
    return out
