"""Suffix array by linear grouping, without recursion or renaming.

Phase one sorts suffixes into groups by their longest Lyndon prefix.  Groups
are taken from the greatest down; for each suffix of a group the pointer to the
nearest earlier suffix of a lower group is found by following earlier pointers,
and the suffixes pointed to move, by how many copies of the group's prefix
follow them, into new groups behind the rest of theirs.  Phase two walks the
suffixes in order and writes every suffix whose Lyndon prefix ends there to the
next free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of non-negative integers in lexicographic order; the end sorts before any symbol."""
    n = len(symbols)
    first = np.argsort(symbols, kind="stable")
    new = np.r_[True, np.diff(symbols[first]) != 0] if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    group = np.empty(n, np.int64)
    group[first] = np.repeat(starts, np.diff(np.r_[starts, n]))
    sa, place = first.tolist(), np.argsort(first, kind="stable").tolist()
    group, size = group.tolist(), [0] * n
    for s, c in zip(starts.tolist(), np.diff(np.r_[starts, n]).tolist(), strict=True):
        size[s] = c
    lower = [-1] * n  # nearest earlier suffix of a lower group
    end = n - 1
    while end >= 0:
        g = group[sa[end]]
        if g == end:
            s = sa[end]
            p = s - 1
            while p >= 0 and group[p] > g:
                p = lower[p]
            lower[s] = p
            if p >= 0:
                _raise(p, sa, place, group, size)
            end = g - 1
            continue
        copies: dict[int, int] = {}
        for s in sorted(sa[g : end + 1]):
            p = s - 1
            while p >= 0 and group[p] > g:
                p = lower[p]
            if p >= 0 and group[p] == g:  # another copy right before: goes on to where the copies begin
                p = lower[p]
            lower[s] = p
            if p >= 0:
                copies[p] = copies.get(p, 0) + 1
        if len(copies) == 1:
            _raise(next(iter(copies)), sa, place, group, size)
        elif copies:
            most = max(copies.values())
            if most == 1:
                _raise_all(list(copies), sa, place, group, size)
            else:
                by: dict[int, list[int]] = {}
                for p, c in copies.items():
                    by.setdefault(c, []).append(p)
                for c in sorted(by, reverse=True):
                    _raise_all(by[c], sa, place, group, size)
        end = g - 1
    out, free = [0] * n, list(range(n))
    done = bytearray(n)
    for i in range(-1, n):
        p = (n if i < 0 else out[i]) - 1
        while p >= 0 and not done[p]:
            done[p] = 1
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = lower[p]
    return np.array(out, np.int64)


def _raise(p: int, sa: list, place: list, group: list, size: list) -> None:
    """Move one suffix behind the rest of its group, into a group of its own."""
    g = group[p]
    c = size[g] - 1
    if c:
        last, at = g + c, place[p]
        q = sa[last]
        sa[at], place[q] = q, at
        sa[last], place[p] = p, last
        size[g], size[last], group[p] = c, 1, last


def _raise_all(ps: list, sa: list, place: list, group: list, size: list) -> None:
    """Move suffixes behind the rest of their groups; those of one group make one new group."""
    for p in ps:
        g = group[p]
        c = size[g] = size[g] - 1
        last, at = g + c, place[p]
        if last != at:
            q = sa[last]
            sa[at], place[q] = q, at
            sa[last], place[p] = p, last
    start = {g: g + size[g] for g in {group[p] for p in ps}}  # a group that moves whole stays where it was
    for p in ps:
        group[p] = new = start[group[p]]
        size[new] += 1


def common(data: np.ndarray, left: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix but the first in order: the bytes that it shares with the one before, `most` at most; left: the bytes that a suffix has."""
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(np.uint64).ravel()
    a, b = sa[:-1], sa[1:]
    out = np.full(len(a), most, np.int64)
    at = np.arange(len(a))
    for off in range(0, most, 8):
        x = words[a[at] + off] ^ words[b[at] + off]
        end = x != 0
        low = x[end] & (~x[end] + np.uint64(1))  # the lowest bit that differs: bytes are read with the first one lowest
        out[at[end]] = off + (np.bitwise_count(low - np.uint64(1)) >> 3)
        at = at[~end]
    return np.minimum(np.minimum(out, most), np.minimum(left[a], left[b]))
