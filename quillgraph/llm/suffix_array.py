"""Suffix array by linear grouping construction.

Suffixes are grouped by their Lyndon prefix (the longest Lyndon word a suffix starts with), groups in the
order of those words. Within a group, the order is that of what follows the prefix, which is the next
smaller suffix.

Grouping starts from the first symbols. Groups are taken in descending order; each suffix of a group
points to the nearest suffix before it that is in a smaller group. A suffix that is pointed to has a
Lyndon prefix which goes on with the group's, so it moves to a group just above its own, those pointed to
most often highest. Ordering then takes the suffixes from the smallest on: every suffix
whose prefix ends where the current one starts is next in its group, and these are found along the
same pointers. Nothing is renamed and there is no recursion.

`suffix_array` takes one text, group by group. `suffix_orders` takes many texts in step, with the same groups
and pointers held in arrays over all of them, so that each step handles one whole group of every text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Symbols of the texts that are sorted together.
TOGETHER = 1 << 18
#: Steps over several texts pay from so many bytes for each byte of the longest.
STEP_BYTES = 40


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes, ascending. A suffix that is a prefix of another comes first."""
    n = len(text) + 1  # the empty suffix, which is the least, stands for the end
    if n == 1:
        return []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    order, place, start, size = [n - 1], [0] * n, [0] * n, [0] * (n + 1)
    size[0] = 1
    for c in sorted(by_symbol):
        members, at = by_symbol[c], len(order)
        size[at] = len(members)
        for k, i in enumerate(members, at):
            place[i], start[i] = k, at
        order += members
    before = [-1] * n
    end = n
    # index -1 is the empty suffix, which is in the smallest group and placed first, so that searches to the left end there
    while end > 1:
        s = order[end - 1]
        first = start[s]
        if first == end - 1:
            end = first
            p = s - 1
            while start[p] >= first:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = start[p]
                left = size[g] - 1
                if left:
                    size[g] = left
                    to = g + left
                    at, other = place[p], order[to]
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
                    start[p], size[to] = to, 1
            continue
        group, end = order[first:end], first
        group.sort()
        pointed: dict[int, int] = {}
        for s in group:
            p = s - 1
            while start[p] >= first:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        most = max(pointed.values())
        if most == 1:
            levels = [list(pointed)]
        else:
            levels = [[] for _ in range(most)]
            for p, k in pointed.items():
                levels[most - k].append(p)
        for level in levels:
            for p in level:
                g = start[p]
                size[g] -= 1
                to = g + size[g]
                if to != place[p]:
                    at, other = place[p], order[to]
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
            fresh = [(p, start[p] + size[start[p]]) for p in level]
            for _, g in fresh:
                size[g] = 0
            for p, g in fresh:
                start[p] = g
                size[g] += 1
    # start[s] is where the group of s begins, and from now on its next free place
    placed = bytearray(n)
    head = list(range(n + 1))
    placed[n - 1] = 1
    for i in range(n):
        p = order[i] - 1
        while not placed[p]:
            g = start[p]
            at = head[g]
            order[at] = p
            head[g] = at + 1
            placed[p] = 1
            p = before[p]
    return order[1:]


def suffix_orders(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of many texts at once, laid end to end: starts within `flat`, ascending for each text.

    flat: the texts' symbols (0 to 255) one after the other; sizes: how many each text has, at least one.
    Every step takes the next group of each text, so a step's work is that of whole groups of many texts.
    """
    texts, lengths = len(sizes), sizes + 1  # before its symbols each text has a place for the empty suffix, which searches to the left end at
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = int(lengths.sum())
    code = np.repeat(np.arange(texts) * 257, lengths)
    real = np.ones(n, bool)
    real[base] = False
    code[real] += flat.astype(np.int64) + 1
    order = np.argsort(code, kind="stable")
    first = _firsts(code[order])
    counts = np.diff(np.append(first, n))
    place, start, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    place[order], start[order], size[first] = np.arange(n), np.repeat(first, counts), counts
    before, moved = np.arange(n) - 1, np.zeros(n, bool)
    end, active = base + lengths, np.arange(texts)
    while len(active):
        lo = start[order[end[active] - 1]]
        held = end[active] - lo
        end[active] = lo
        s = order[ranges(lo, held)]
        floor, empty = np.repeat(lo, held), np.repeat(base[active], held)
        p = s - 1
        ahead = np.flatnonzero(start[p] >= floor)
        while len(ahead):  # members of one group are skipped by ever longer steps
            q = before[p[ahead]]
            p[ahead] = before[s[ahead]] = q
            ahead = ahead[start[q] >= floor[ahead]]
        before[s] = p
        u, pointed = np.unique(p[p != empty], return_counts=True)
        if len(u):
            _split(u, pointed, order, place, start, size, moved)
        active = active[lo > base[active] + 1]
    return _emit(order, start, before, base, sizes) - 1 - np.repeat(np.arange(texts), sizes)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def ranges(lo: np.ndarray, held: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ..., then lo[1], ...: held[i] numbers from each lo[i]."""
    return np.repeat(lo - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))


def _split(u, pointed, order, place, start, size, moved) -> None:
    """Moves suffixes that are pointed to into groups just above their own, those pointed to most often highest."""
    by = np.lexsort((pointed, start[u]))
    u, pointed, group = u[by], pointed[by], start[u[by]]
    first = _firsts(group)
    touched, groups = np.diff(np.append(first, len(u))), group[first]
    top = groups + size[groups] - touched
    slots, was = ranges(top, touched), place[u]
    there = order[slots]
    moved[u] = True
    aside, freed = there[~moved[there]], was[was < np.repeat(top, touched)]
    moved[u] = False
    order[freed], place[aside] = aside, freed
    order[slots], place[u] = u, slots
    fresh = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (pointed[1:] != pointed[:-1])]))
    number = np.diff(np.append(fresh, len(u)))
    size[groups] -= touched
    size[slots[fresh]] = number
    start[u] = np.repeat(slots[fresh], number)


def _emit(order, start, before, base, sizes) -> np.ndarray:
    """Places every suffix within its group, from the smallest on: what ends where the current one starts is next."""
    placed, head = np.zeros(len(order), bool), np.arange(len(order) + 1)
    placed[base] = True
    by_size = np.argsort(-sizes, kind="stable")
    longest = -sizes[by_size]
    last = base + sizes
    for i in range(-int(longest[0]) + 1):
        now = by_size[: np.searchsorted(longest, -i, side="right")]
        p = last[now] if i == 0 else order[base[now] + i] - 1
        p = p[~placed[p]]
        while len(p):
            g = start[p]
            at = head[g]
            order[at] = p
            head[g] = at + 1
            placed[p] = True
            p = before[p]
            p = p[~placed[p]]
    real = np.ones(len(order), bool)
    real[base] = False
    return order[real]


def suffix_arrays(texts: list[bytes]) -> np.ndarray:
    """The suffix arrays of texts that are laid end to end: starts in what they make together, ascending for each text.

    Texts of like size are taken together; a long one by itself goes group by group.
    """
    size = np.array([len(t) for t in texts], np.int64)
    at, out = np.cumsum(size) - size, np.empty(int(size.sum()), np.int64)
    by_size = np.argsort(size, kind="stable")
    by_size = by_size[size[by_size] > 0]
    sorted_size, total = size[by_size], np.cumsum(size[by_size])
    i = 0
    while i < len(by_size):
        below = int(total[i - 1]) if i else 0
        j = max(i + 1, int(min(np.searchsorted(sorted_size, max(2 * sorted_size[i], 64), side="right"), np.searchsorted(total, below + TOGETHER, side="right"))))
        chosen, sizes = by_size[i:j], sorted_size[i:j]
        if total[j - 1] - below < STEP_BYTES * sizes[-1]:
            for k in chosen:
                out[at[k] : at[k] + size[k]] = np.array(suffix_array(texts[k]), np.int64) + at[k]
        else:
            order = suffix_orders(np.frombuffer(b"".join(texts[k] for k in chosen), np.uint8), sizes)
            out[ranges(at[chosen], sizes)] = order + np.repeat(at[chosen] - (np.cumsum(sizes) - sizes), sizes)
        i = j
    return out
