"""Suffix arrays by Larsson-Sadakane refinement, and Kasai's common prefixes, in numpy.

Several texts share one array of symbols; each ends with a separator of its
own, so no suffix equals another and no common prefix crosses a text.
"""

from __future__ import annotations

import numpy as np


def suffix_array(first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and for each place the depth at which it split from the one before it.

    first: a key for each suffix that sorts it by its first `depth` symbols. The
    common prefix of a place and the one before is at least its depth of
    splitting and less than twice that; 0 stands for less than `depth`.
    """
    n = len(first)
    order = np.argsort(first)
    keys = first[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    split = np.zeros(n, np.int32)
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    new = np.append(new, True)
    slots = np.flatnonzero(~(new[:-1] & new[1:]))
    h = depth
    while len(slots):
        at = order[slots]
        group = rank[at]
        both = (group << 32) | rank[at + h]
        turn = np.argsort(both)
        at, both = at[turn], both[turn]
        order[slots] = at
        fresh = np.ones(len(slots) + 1, bool)
        fresh[1:-1] = both[1:] != both[:-1]
        old = np.ones(len(slots), bool)
        old[1:] = (both[1:] >> 32) != (both[:-1] >> 32)
        split[slots[fresh[:-1] & ~old]] = h
        heads = np.flatnonzero(fresh[:-1])
        rank[at] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        slots = slots[~(fresh[:-1] & fresh[1:])]
        h *= 2
    return order, split


def common_prefixes(symbols: np.ndarray, order: np.ndarray, split: np.ndarray, least: int) -> np.ndarray:
    """Length of the common prefix of each place and the one before, where it is at least `least`, else 0.

    Kasai's rule in text order: where the symbols before two neighbours agree,
    the prefix is one shorter than that of the suffix before; only the others
    are compared symbol by symbol.
    """
    n = len(order)
    lcp = np.zeros(n, np.int64)
    slots = np.flatnonzero(2 * split.astype(np.int64) > least)
    slots = slots[slots > 0]
    if not len(slots):
        return lcp
    at, before = order[slots], order[slots - 1]
    turn = np.argsort(at)
    at, before, slots = at[turn], before[turn], slots[turn]
    known = split[slots].astype(np.int64)
    follows = np.zeros(len(at), bool)
    follows[1:] = (at[1:] == at[:-1] + 1) & (before[1:] > 0)
    follows[1:] &= symbols[at[1:] - 1] == symbols[before[1:] - 1]
    lead = np.flatnonzero(~follows)
    length = known[lead].copy()
    a, b = at[lead], before[lead]
    live = np.arange(len(lead))
    while len(live):
        width = int(min(max(1, (1 << 18) // len(live)), 4096))
        reach = np.arange(width)
        x, y = a[live] + length[live], b[live] + length[live]
        left, right = np.minimum(x[:, None] + reach, n - 1), np.minimum(y[:, None] + reach, n - 1)
        differ = symbols[left] != symbols[right]
        differ |= left == right
        some = differ.any(1)
        length[live] += np.where(some, differ.argmax(1), width)
        live = live[~some]
    full = np.zeros(len(at), np.int64)
    full[lead] = length
    owner = lead[np.cumsum(~follows) - 1]
    full = full[owner] - (at - at[owner])
    lcp[slots] = np.where(full >= least, full, 0)
    return lcp


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
