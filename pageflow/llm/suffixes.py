"""Suffix arrays by linear grouping (G. Baier, "Linear-time suffix sorting", CPM 2016).

Suffixes are first grouped by their Lyndon prefix: groups are processed from
the highest down, and each moves the suffixes its previous-smaller pointers
name to new groups just above their old ones.  A second pass emits the order
within the groups, again along the pointers.  No symbol is renamed on the way.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: list[int], order: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Group start, Lyndon prefix length and previous smaller suffix of each suffix.

    ``order``: the suffixes by first symbol, which becomes scratch space.  A
    group is named by its first place; places of a group are contiguous.
    """
    n = len(text)
    place = [0] * n
    group = [0] * n
    size = [0] * n
    start = 0
    for k, suffix in enumerate(order):
        if k and text[suffix] != text[order[k - 1]]:
            start = k
        place[suffix] = k
        group[suffix] = start
        size[start] += 1
    length = [1] * n
    smaller = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        followers: dict[int, int] = {}
        for suffix in members:
            at = suffix - 1
            while at >= 0 and group[at] >= start:
                at = smaller[at]
            smaller[suffix] = at
            if at >= 0:
                followers[at] = followers.get(at, 0) + 1
        word = length[members[0]]
        moves: dict[tuple[int, int], list[int]] = {}
        for at, times in followers.items():
            moves.setdefault((times, group[at]), []).append(at)
        for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            moved = moves[times, old]
            top = old + size[old]
            fresh = top - len(moved)
            for at in moved:
                top -= 1
                other, here = order[top], place[at]
                order[here], place[other] = other, here
                order[top], place[at] = at, top
                group[at] = fresh
                length[at] += times * word
            if fresh != old:
                size[old] -= len(moved)
                size[fresh] = len(moved)
        end = start
    return group, length, smaller


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in ascending order; an end of text is smaller than any symbol."""
    n = len(text)
    symbols = text.tolist()
    group, length, smaller = lyndon_groups(symbols, np.argsort(text, kind="stable").tolist())
    free = list(range(n))
    out = [0] * n
    for k in range(-1, n):
        suffix = out[k] if k >= 0 else n
        at = suffix - 1
        while at >= 0 and at + length[at] == suffix:
            name = group[at]
            out[free[name]] = at
            free[name] += 1
            at = smaller[at]
    return np.array(out, np.int64)
