"""Suffix arrays by linear grouping, for many short sequences side by side.

The suffixes of a sequence are sorted in two phases, neither of which renames anything recursively:

1. Suffixes are grouped by their first symbol. The groups are processed from the
   highest to the lowest. For every suffix of a group the previous smaller one is
   found, the nearest before it in a lower group, by following the pointers of those in between.
   The suffixes pointed at have the group's prefix next in their own Lyndon prefix, once for each pointer: they
   leave their group for new ones right behind it, in the order of the number of pointers.
   In the end every group holds the suffixes of one Lyndon prefix.
2. The order within the groups is emitted from the lowest suffix on: when a suffix takes its place in
   the array, those whose Lyndon prefix ends where it begins take the next places of their groups.

All sequences advance together, one group or place of each at a time, so the work of a step is
done on arrays. It is linear in the symbols; the number of steps is that of the longest sequence, so sequences of similar
length belong together.
"""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, .. for each of the sizes, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix arrays, one behind the other, of sequences that lie one behind the other.

    Entries are positions in ``symbols``. Every sequence ends in a symbol smaller than all others of it.
    """
    n = len(symbols)
    bases = np.cumsum(lengths) - lengths
    base = np.repeat(bases, lengths)
    array = np.lexsort((symbols, base))
    ordered, owner = symbols[array], base[array]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    size = np.zeros(n + 1, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[array] = np.repeat(starts, size[starts])
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    # The length of the Lyndon prefix that a suffix is known to have.
    prefix = np.ones(n, np.int64)
    smaller = np.arange(n) - 1
    pointed = np.zeros(n, bool)
    top, low = bases + lengths, bases
    while len(top):
        current = group[array[top - 1]]
        members = array[spread(current, top - current)]
        level = np.repeat(current, top - current)
        floor = np.repeat(low, top - current)
        lengths_ = prefix[members]
        back = smaller[members]
        while True:
            inside = back >= floor
            climbing = inside & (group[np.where(inside, back, 0)] >= level)
            if not climbing.any():
                break
            back = np.where(climbing, smaller[back], back)
            smaller[members] = back
        found, first, times = np.unique(back[inside], return_index=True, return_counts=True)
        if len(found):
            added = lengths_[inside][first]
            order = np.lexsort((times, group[found]))
            found, times, added = found[order], times[order], added[order]
            home = group[found]
            prefix[found] += times * added
            change = np.ones(len(found), bool)
            change[1:] = home[1:] != home[:-1]
            first_of = np.flatnonzero(change)
            moved = np.diff(np.append(first_of, len(found)))
            homes = home[first_of]
            stay = size[homes] - moved
            tails = np.repeat(homes + stay, moved)
            slots = tails + (np.arange(len(found)) - np.repeat(first_of, moved))
            # Who stays but sits in the tail changes places with who leaves the head.
            pointed[found] = True
            there = array[slots]
            settle = there[~pointed[there]]
            pointed[found] = False
            old = place[found]
            vacated = old[old < tails]
            array[vacated] = settle
            place[settle] = vacated
            array[slots] = found
            place[found] = slots
            size[homes] = stay
            change[1:] |= times[1:] != times[:-1]
            heads = np.flatnonzero(change)
            counts = np.diff(np.append(heads, len(found)))
            group[found] = np.repeat(slots[heads], counts)
            size[slots[heads]] = counts
        alive = current > low
        top, low = current[alive], low[alive]
    return _emit(group, prefix, bases, lengths)


def _emit(group: np.ndarray, prefix: np.ndarray, bases: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order within the groups, from their Lyndon prefixes."""
    n = len(group)
    after = np.arange(n) + prefix
    ends = np.repeat(bases + lengths, lengths)
    # Suffixes by where their Lyndon prefix ends; that of a sequence's last symbol ends the sequence.
    by_end = np.argsort(np.where(after < ends, after, n), kind="stable")
    counts = np.bincount(after[after < ends], minlength=n)
    first = np.cumsum(counts) - counts
    out = np.full(n, -1, np.int64)
    free = np.arange(n)
    out[bases] = bases + lengths - 1
    step, left, many = 0, bases, lengths
    while len(left):
        now = out[left + step]
        children = by_end[spread(first[now], counts[now])]
        homes = group[children]
        out[free[homes]] = children
        free[homes] += 1
        step += 1
        alive = many > step
        left, many = left[alive], many[alive]
    return out
