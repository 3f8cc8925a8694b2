"""Suffix arrays in numpy over many short sequences at once.

The sequences lie one behind the other in one array of symbols.  Suffixes end
with their sequence, so no match crosses a limit.  Ranks come from prefix
doubling in which only groups that are not yet single are sorted again.
"""

from __future__ import annotations

import numpy as np


def _order(key: np.ndarray) -> np.ndarray:
    """Positions in the order of ``key``; ties by position where the packed sort, which is faster, fits into 63 bits."""
    n = len(key)
    shift = max(1, n.bit_length())
    if int(key.max(initial=0)) < 1 << (63 - shift):
        return np.sort((key << shift) | np.arange(n)) & ((1 << shift) - 1)
    return np.argsort(key, kind="stable")


def suffix_order(symbol: np.ndarray, end: np.ndarray, group: np.ndarray | None = None, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(order, ranks, rank) of all suffixes.

    ``end[i]`` is the limit of the sequence that position ``i`` is in.  With
    ``group``, suffixes are ordered within groups of sequences only.  ``ranks[k]``
    is equal for two positions if and only if their first 2**k symbols are; suffixes that equal each
    other to their ends are ordered by position.  With ``depth``, only that many
    symbols count.
    """
    n = len(symbol)
    key = symbol.astype(np.int64)
    if group is not None:
        key = group.astype(np.int64) * (int(key.max(initial=0)) + 1) + key
    order = _order(key)
    rank = np.empty(n, dtype=np.int64)
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = np.flatnonzero(new)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    ranks = [rank.copy()]
    single = np.diff(np.append(at, n)) == 1
    active = order[~np.repeat(single, np.diff(np.append(at, n)))]
    h = 1
    longest = int((end - np.arange(n)).max(initial=0))
    while len(active) and h < longest and (depth is None or 2 * h <= depth):
        beyond = active + h
        second = np.where(beyond < end[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        old = rank[active]
        o = _order(old * (n + 2) + second)
        active, old, second = active[o], old[o], second[o]
        head = np.ones(len(active), dtype=bool)
        head[1:] = old[1:] != old[:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        index = np.arange(len(active))
        base = np.maximum.accumulate(np.where(head, index, 0))
        first = np.maximum.accumulate(np.where(new, index, 0))
        rank[active] = old + first - base
        sizes = np.diff(np.append(np.flatnonzero(new), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        ranks.append(rank.copy())
        h *= 2
    if len(active):  # suffixes that are equal to their ends
        o = np.lexsort((active, rank[active]))
        active = active[o]
        old = rank[active]
        index = np.arange(len(active))
        head = np.ones(len(active), dtype=bool)
        head[1:] = old[1:] != old[:-1]
        rank[active] = old + index - np.maximum.accumulate(np.where(head, index, 0))
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, ranks, rank


def common_prefix(a: np.ndarray, b: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes at ``a`` and ``b``; -1 in either counts as none."""
    there = (a >= 0) & (b >= 0)
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    a0, b0 = np.where(there, a, 0), np.where(there, b, 0)
    n = len(ranks[0])
    length = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a0 + length, b0 + length
        inside = there & (x + (1 << k) <= end[a0]) & (y + (1 << k) <= end[b0])
        equal = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        length += equal.astype(np.int64) << k
    return length



def smaller_neighbours(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place in ``a``, the nearest place before and the nearest behind that has a smaller value; -1 where there is none.

    Every place points to its neighbour and follows the pointers of what is not
    smaller, all places at once; what lies between is known not to be smaller.
    """
    def before(x: np.ndarray) -> np.ndarray:
        to = np.arange(-1, len(x) - 1)
        open_ = np.flatnonzero(to >= 0)
        while len(open_):
            at = to[open_]
            open_ = open_[x[at] > x[open_]]
            to[open_] = to[to[open_]]
            open_ = open_[to[open_] >= 0]
        return to

    behind = len(a) - 1 - before(a[::-1])[::-1]
    return before(a), np.where(behind < len(a), behind, -1)


def previous_factors(order: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(longest, earlier): of each position of ``order``, in that order, the longest factor that also starts at an earlier position, and that position or -1.

    The earlier match that is longest is one of the two nearest smaller positions
    in suffix order.
    """
    if not len(order):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low, high = smaller_neighbours(order)
    left, right = np.where(low >= 0, order[low], -1), np.where(high >= 0, order[high], -1)
    a, b = common_prefix(order, left, end, ranks), common_prefix(order, right, end, ranks)
    return np.maximum(a, b), np.where(a >= b, left, right)
