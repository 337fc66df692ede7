"""Suffix arrays by linear grouping, and what long repeats cover in a bounded set of texts.

Suffixes are grouped by their longest Lyndon prefix without comparing strings. Groups
begin as those of equal first symbols and are taken in descending order. Each suffix of a
group finds the previous smaller one, by pointers that skip what is larger; the suffixes
so found have their context prolonged by the group's, once for each that names them, and
so split off from their group, to directly after it. When all groups are done they are in
the order of their Lyndon prefixes, and the suffixes of a group follow the order of what
comes after that prefix. So one pass over the array, as it grows, emits the order: behind
suffix s come, in their groups, those whose next smaller suffix is s, which the
previous-smaller pointers from s - 1 lead through. Nothing is renamed or recursed into.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """Each suffix's group (where the group begins in the order of all suffixes) and its previous smaller suffix (-1: none)."""
    n = len(text)
    values = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else np.asarray(text, np.int64)
    order = np.argsort(values, kind="stable")
    member = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    ranked = values[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n]
    begin = np.repeat(first, last - first)
    group = np.empty(n, np.int64)
    group[order] = begin
    group = group.tolist()
    end = dict(zip(first.tolist(), last.tolist()))
    prev = [-1] * n
    at = n
    while at:
        start = group[member[at - 1]]
        own = sorted(member[start:at])
        count: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in count.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[k]:
                # To the tail of its group; what was moved before in this round stands there already.
                g = group[j]
                m = moved[g] = moved.get(g, 0) + 1
                to = end[g] - m
                other, was = member[to], place[j]
                member[to], member[was] = j, other
                place[j], place[other] = to, was
            for g, m in moved.items():
                new = end[g] - m
                if new == g:
                    continue  # the whole group is prolonged alike
                end[new] = end[g]
                end[g] = new
                for p in range(new, new + m):
                    group[member[p]] = new
        at = start
    return group, prev


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes in ascending order; a proper prefix comes first."""
    n = len(text)
    group, prev = lyndon_groups(text)
    free = {g: g for g in set(group)}
    out = [-1] * n
    for at in range(-1, n):
        s = n if at < 0 else out[at]  # the empty suffix is the least of all
        stop = prev[s] if s < n else -1
        j = s - 1
        while j > stop:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = prev[j]
    return out


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """How many symbols each suffix of the order shares with the one before it."""
    n = len(text)
    rank = [0] * n
    for r, s in enumerate(order):
        rank[s] = r
    out, h = [0] * n, 0
    for s in range(n):
        if rank[s]:
            t = order[rank[s] - 1]
            while s + h < n and t + h < n and text[s + h] == text[t + h]:
                h += 1
            out[rank[s]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each byte of each text, whether the string of `length` bytes that starts there starts anywhere else too.

    All texts are sorted together in this process, so this is for sets of bounded size.
    """
    joined: list[int] = []
    begin = []
    for k, t in enumerate(texts):
        begin.append(len(joined))
        joined += t
        joined.append(256 + k)  # a symbol of its own ends each text, so no match crosses it
    order = suffix_array(joined)
    shared = np.array([*common_prefixes(joined, order), 0], np.int64)
    hit = np.zeros(len(joined), bool)
    hit[order] = (shared[:-1] >= length) | (shared[1:] >= length)
    return [hit[b : b + len(t)] for b, t in zip(begin, texts)]


def repeated_cover(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its bytes such a string covers."""
    out = []
    for own in repeated_starts(texts, length):
        edge = np.zeros(len(own) + length + 1, np.int64)
        at = np.flatnonzero(own)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        out.append(np.cumsum(edge)[: len(own)] > 0)
    return out
