"""Suffix arrays by linear grouping, for many texts in lockstep.

Phase 1 takes the groups of each text in descending order. For every suffix of the group it finds the nearest
suffix before it in a lower group (the previous-smaller pointer); suffixes pointed at leave their groups and
form new ones right above, ordered by how many pointers they got. In the end the suffixes of a group share
their Lyndon prefix. Phase 2 takes the groups in ascending order and emits each in the order of what follows
the Lyndon prefix, which lies in a lower group or earlier in the same one: no ranks are ever renamed.

Each numpy operation serves the current group of every text, so the cost of a step is shared by thousands of
small texts.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] values), then those of starts[1], ..."""
    ends = sizes.cumsum()
    out = np.arange(ends[-1] if len(ends) else 0)
    out += (starts - ends + sizes).repeat(sizes)
    return out


def runs(x: np.ndarray) -> np.ndarray:
    """Indexes where a run of equal values begins."""
    begins = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=begins[1:])
    return begins.nonzero()[0]


def lengths(first: np.ndarray, n: int) -> np.ndarray:
    """Lengths of runs that begin at first, of n values in all."""
    out = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=out[:-1])
    out[-1:] = n - first[-1:]
    return out


def first_groups(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by text, then symbol; and each position's group, named by its first slot."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(symbols, kind="stable")
    while True:  # least significant digits first, 16 bits at a time
        order = order[np.argsort((text[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        if not text.any():
            break
        text = text >> 16
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = runs(own[order] * 65536 + symbols[order])
    group = np.empty(len(symbols), np.int64)
    group[order] = starts.repeat(lengths(starts, len(symbols)))
    return order, group


def lyndon_groups(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: slots (positions by group), group and length of the Lyndon prefix of each position."""
    slots, group = first_groups(symbols, bounds)
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[slots] = np.arange(n)
    size = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(group[slots] == np.arange(n))
    size[starts] = lengths(starts, n)
    length = np.ones(n, np.int64)
    before = np.empty(n, np.int64)
    marked = np.zeros(n, bool)
    low, high = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    while True:
        start = group[slots[high - 1]]
        going = start > low  # the lowest group is the end mark alone
        low, high, start = low[going], high[going], start[going]
        if not len(low):
            return slots, group, length
        count = high - start
        member = slots[ranges(start, count)]
        own = np.arange(len(low)).repeat(count)
        floor, own_group = low.repeat(count), start.repeat(count)
        pointer = member - 1
        before[member] = pointer
        open_ = ((pointer >= floor) & (group[pointer] >= own_group)).nonzero()[0]
        while len(open_):
            onward = before[pointer[open_]]
            pointer[open_] = onward
            before[member[open_]] = onward
            open_ = open_[(onward >= floor[open_]) & (group[onward] >= own_group[open_])]
        found = pointer >= floor
        hit, hit_own = pointer[found], own[found]
        high = start
        if not len(hit):
            continue
        order = np.argsort(hit, kind="stable")
        hit, hit_own = hit[order], hit_own[order]
        first = runs(hit)
        times = lengths(first, len(hit))
        hit, hit_own = hit[first], hit_own[first]
        length[hit] += times * length[member[count.cumsum() - 1]][hit_own]
        # the pointed-at suffixes move to the end of their groups, those with more pointers last
        key = group[hit] * (n + 1) + times
        order = np.argsort(key, kind="stable")
        hit, key = hit[order], key[order]
        old = group[hit]
        first = runs(old)
        leaving = lengths(first, len(hit))
        of = old[first]
        tail = of + size[of] - leaving
        to = ranges(tail, leaving)
        was, there = place[hit], slots[to]
        marked[hit] = True
        pushed = there[~marked[there]]
        marked[hit] = False
        free = was[was < tail.repeat(leaving)]
        slots[free], place[pushed] = pushed, free
        slots[to], place[hit] = hit, to
        size[of] -= leaving
        first = runs(key)
        size[to[first]] = new = lengths(first, len(hit))
        group[hit] = to[first].repeat(new)


def suffix_array(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions in suffix order, text by text. Text i is symbols[bounds[i]:bounds[i + 1]] and ends with a symbol smaller than any other in it."""
    n = len(symbols)
    slots, group, length = lyndon_groups(symbols, bounds)
    after = np.arange(n) + length
    starts = np.flatnonzero(group[slots] == np.arange(n))
    sizes = lengths(starts, n)
    rank = np.full(n + 1, -1, np.int64)
    rank[slots[starts[sizes == 1]]] = starts[sizes == 1]
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return slots
    # step k emits the k-th lowest group (of two or more suffixes) of every text
    text = np.searchsorted(bounds, starts, side="right")
    begin = runs(text)
    step = np.arange(len(starts)) - np.repeat(begin, lengths(begin, len(starts)))
    order = np.argsort(step, kind="stable")
    starts, sizes, step = starts[order], sizes[order], step[order]
    places = ranges(starts, sizes)
    members, of = slots[places], np.repeat(starts, sizes)
    cuts = np.append(np.concatenate([[0], np.cumsum(sizes)])[runs(step)], len(places))
    follow = after[members]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        known = rank[follow[a:b]]
        if known.min() >= 0:
            rank[members[a:b][np.argsort(of[a:b] * (n + 1) + known, kind="stable")]] = places[a:b]
            continue
        member, own, next_ = members[a:b], of[a:b], follow[a:b]
        filled = own.copy()  # the next free slot of each member's group
        while len(member):
            known = rank[next_]
            ready = known >= 0
            order = np.argsort(own[ready] * (n + 1) + known[ready], kind="stable")
            now, at = member[ready][order], own[ready][order]
            first = runs(at)
            count = lengths(first, len(at))
            rank[now] = filled[ready][order] + np.arange(len(at)) - np.repeat(first, count)
            grown = np.zeros(len(own), np.int64)
            where = np.searchsorted(at[first], own)
            inside = where < len(first)
            inside[inside] = at[first][where[inside]] == own[inside]
            grown[inside] = count[where[inside]]
            rest = ~ready
            member, own, next_, filled = member[rest], own[rest], next_[rest], (filled + grown)[rest]
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out
