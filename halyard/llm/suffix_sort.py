"""Suffix sorting by grouping, in linear time."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in ascending order. s ends with a number smaller than all others.

    First part: groups, highest first. A suffix's group stands for a prefix that all its members share. When a group is done, each member's
    nearest predecessor in a lower group (found along links to previous smaller ones) has its prefix prolonged by the group's; those met
    more often go higher. At the end a group holds the suffixes with one longest Lyndon prefix. Second part: from the smallest suffix
    on, the suffix one to the left and the chain of its links take the next places in their groups. Nothing is renamed or solved anew.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    at, group, end = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        if s[i] != s[order[first]]:
            end[first] = k
            first = k
        at[i], group[i] = k, first
    if n:
        end[first] = n
    before, jump = [-1] * n, list(range(-1, n - 1))
    high = n
    while high:
        low = group[order[high - 1]]
        met: dict[int, int] = {}
        for i in sorted(order[low:high]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = jump[p]
            q = i - 1
            while q > p:  # later walks skip what this one saw
                q, jump[q] = jump[q], p
            before[i] = jump[i] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        chosen, times = list(met), 1
        while chosen:
            moved: dict[int, int] = {}
            for p in chosen:
                g = group[p]
                k = moved.get(g, 0) + 1
                moved[g] = k
                here, back = at[p], end[g] - k
                other = order[back]
                order[here], order[back] = other, p
                at[other], at[p] = here, back
            for g, k in moved.items():
                cut = end[g] - k
                if cut != g:
                    end[cut], end[g] = end[g], cut
                    for x in order[cut : end[cut]]:
                        group[x] = cut
            times += 1
            chosen = [p for p in chosen if met[p] >= times]
        high = low
    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    if n:
        out[0] = n - 1
        placed[n - 1] = 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = before[i]
    return out
