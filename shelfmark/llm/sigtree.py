"""Signature trees over token sets, and the dual traversal that joins two of them.

A leaf is one set; an inner node holds the OR of its children's token bitmaps
and the range of their sizes. Two nodes can only hold a linked pair if the bits
that they share, and the tokens that may hide behind shared bits, allow the
overlap that their smallest sizes demand; other node pairs are pruned. Bitmaps
have a bit for each token of the unit where that fits, and are folded otherwise;
``slack`` counts what folding may hide, so pruning never loses a pair.

``links`` gives all linked pairs. ``connections`` gives pairs that connect the
same sets: all sets are compared with one in the middle first, and node pairs
whose sets are connected already are pruned as well, so a unit of k near copies
costs on the order of k comparisons.
"""

from __future__ import annotations

import numpy as np

from . import groups

FANOUT = 8
MAX_BITS = 1 << 16
BATCH_WORDS = 1 << 19
_NONE = np.empty(0, np.int64)


class Tree:
    """Levels from the leaves up: bitmaps, least size, greatest size, slack, and
    the least and greatest label of what is connected."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, slack: np.ndarray, label: np.ndarray):
        self.levels = [(bitmaps, sizes, sizes, slack, label, label)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, hidden, first, last = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(hidden, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at),
            ))


def bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bitmaps of the sets over their common tokens, what folding may hide in
    each, and whether nothing is folded."""
    sizes = np.array([len(s) for s in sets])
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    width = min(MAX_BITS, -(-len(tokens) // 64) * 64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    dense = np.zeros((len(sets), width // 8), np.uint8)
    bit = code % width
    np.bitwise_or.at(dense, (owner, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    words = dense.view(np.uint64)
    return words, sizes - np.bitwise_count(words).sum(1).astype(np.int64), len(tokens) <= width


def _bound(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the pairs (i, j) of two levels may hold a pair with
    den * overlap >= num * union that isn't connected yet."""
    out = (x[4][i] != y[5][j]) | (x[5][i] != y[4][j])
    open_ = np.flatnonzero(out)
    step = max(1, BATCH_WORDS // x[0].shape[1])
    for k in range(0, len(open_), step):
        at = open_[k : k + step]
        a, b = i[at], j[at]
        common = np.bitwise_count(x[0][a] & y[0][b]).sum(1).astype(np.int64) + np.minimum(x[3][a], y[3][b])
        most = np.minimum(common, np.minimum(x[2][a], y[2][b]))
        # overlap o of sizes s, t: den * o >= num * (s + t - o)
        out[at] = (den + num) * most >= num * (x[1][a] + y[1][b])
    return out


def candidates(x: Tree, y: Tree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that survive; pairs i < j where ``x`` is ``y``."""
    same = x is y
    i = j = np.zeros(1, np.int64)
    dx, dy = len(x.levels) - 1, len(y.levels) - 1
    while True:
        keep = _bound(x.levels[dx], y.levels[dy], i, j, num, den)
        i, j = i[keep], j[keep]
        if dx == 0 and dy == 0 or not len(i):
            break
        if dx >= dy or dy == 0:
            n = len(x.levels[dx - 1][1])
            i, j = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(j, FANOUT)
            fits = i < n
            i, j, dx = i[fits], j[fits], dx - 1
        if same or dy > dx:
            n = len(y.levels[dy - 1][1])
            i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            fits = j < n
            i, j, dy = i[fits], j[fits], dy - 1
        if same:
            fits = i <= j
            i, j = i[fits], j[fits]
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The overlap of two sets in order, by a search of the smaller one's tokens."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def _right(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.array([(den + num) * _shared(sets[a], sets[b]) >= num * (len(sets[a]) + len(sets[b])) for a, b in zip(i.tolist(), j.tolist())], bool)


def _prepared(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the filled sets in the order of size and smallest token, so that
    neighbours make tight nodes, and the sets in that order."""
    full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return full, []
    first = np.array([sets[k][0] for k in full], np.uint64)
    sizes = np.array([len(sets[k]) for k in full])
    order = full[np.lexsort((first, sizes))]
    return order, [sets[k] for k in order]


def _across(words: np.ndarray, sizes: np.ndarray, slack: np.ndarray, label: np.ndarray, num: int, den: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if side is None:
        tree = Tree(words, sizes, slack, label)
        return candidates(tree, tree, num, den)
    one, two = np.flatnonzero(~side), np.flatnonzero(side)
    if not len(one) or not len(two):
        return _NONE, _NONE
    i, j = candidates(*(Tree(words[k], sizes[k], slack[k], label[k]) for k in (one, two)), num, den)
    return one[i], two[j]


def links(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``sets`` with den * overlap >= num * union; with ``side``
    (booleans) only pairs across it. Empty sets link with nothing."""
    order, own = _prepared(sets)
    if len(order) < 2:
        return _NONE, _NONE
    words, slack, exact = bitmaps(own)
    sizes = np.array([len(s) for s in own])
    # every set has a label of its own, so only bounds prune; a leaf's pair with itself is no pair
    i, j = _across(words, sizes, slack, np.arange(len(own)), num, den, None if side is None else side[order])
    if not exact and len(i):
        right = _right(own, i, j, num, den)
        i, j = i[right], j[right]
    return order[i], order[j]


def connections(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs that connect what ``links`` connects."""
    order, own = _prepared(sets)
    if len(order) < 2:
        return _NONE, _NONE
    words, slack, exact = bitmaps(own)
    sizes = np.array([len(s) for s in own])
    side = None if side is None else side[order]
    found_i, found_j = [], []
    label = np.arange(len(own))

    def note(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        found_i.append(i)
        found_j.append(j)
        label = groups.labels(len(own), np.concatenate(found_i), np.concatenate(found_j))

    # the set in the middle first
    middle = len(own) // 2
    leaf = (words, sizes, sizes, slack, label, label)
    others = np.flatnonzero(np.arange(len(own)) != middle if side is None else side != side[middle])
    hub = np.full(len(others), middle)
    near = _bound(leaf, leaf, hub, others, num, den)
    hub, others = hub[near], others[near]
    if not exact:
        right = _right(own, hub, others, num, den)
        hub, others = hub[right], others[right]
    note(hub, others)
    i, j = _across(words, sizes, slack, label, num, den, side)
    while len(i):
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        if exact:
            note(i, j)
            break
        # one pair of each set at a time: what it connects need not be compared
        _, at = np.unique(i, return_index=True)
        right = _right(own, i[at], j[at], num, den)
        note(i[at][right], j[at][right])
        i, j = np.delete(i, at), np.delete(j, at)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return order[i], order[j]
