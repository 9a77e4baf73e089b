"""Signature trees: which sets of a collection have a Jaccard similarity of at least a share.

Leaves hold one set's token bitmap, its size and its surplus (tokens less bits). A node holds the OR of its
children's bitmaps, their range of sizes and largest surplus. Two sets share at most as many tokens as their
bitmaps share bits, plus the lesser surplus, so a pair of nodes whose bound misses what the least sizes need is
dropped with all pairs below it. The traversal descends both trees at once, depth first and many node pairs at
a time; pairs that reach the leaves are counted exactly.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
#: Node pairs that one step looks at.
STEP = 4096


def need(total: np.ndarray | int, num: int, den: int):
    """Least overlap of two sets of `total` tokens together whose similarity is at least num / den."""
    return -((-num * total) // (num + den))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def sketches(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """One number for each set, equal for sets that are alike: its least token among those that few sets hold."""
    flat = np.concatenate(sets)
    if not len(flat):
        return np.zeros(len(sets), np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    count = np.diff(np.append(np.flatnonzero(new), len(flat)))
    common = np.empty(len(flat), bool)
    common[order] = np.repeat(count > max(FANOUT, len(sets) // 64), count)
    out = np.full(len(sets), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, owner[~common], flat[~common])
    return out


class Tree:
    def __init__(self, sets: list[np.ndarray], bits: int):
        n = len(sets)
        self.n, words = n, bits // 64
        maps = np.zeros((n, words), np.uint64)
        shift = np.uint64(64 - (bits.bit_length() - 1))
        for i, s in enumerate(sets):
            at = (s * np.uint64(0x9E3779B97F4A7C15)) >> shift
            one = np.zeros(bits, np.uint8)
            one[at.astype(np.int64)] = 1
            maps[i] = np.packbits(one, bitorder="little").view(np.uint64)
        size = np.array([len(s) for s in sets], np.int64)
        surplus = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, surplus)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, surplus = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(surplus, at)))


class Links:
    """A spanning forest of the links met so far: pairs known to be connected need no count."""

    def __init__(self, labels: np.ndarray):
        _, self.label = np.unique(labels, return_inverse=True)
        self.pairs: list[tuple[int, int]] = []

    def add(self, i: int, j: int) -> None:
        a, b = sorted((self.label[i], self.label[j]))
        self.pairs.append((i, j))
        self.label[self.label == b] = a

    def ranges(self, width: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, part = np.arange(0, n, width), self.label[first : first + n]
        return np.minimum.reduceat(part, at), np.maximum.reduceat(part, at)


def similar(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j), i < j, enough to connect whatever the similar pairs connect.

    Sets are sorted arrays of distinct tokens. Sets of equal `labels` count as connected. With `split`, only
    pairs of a set before it and one from it on are looked at.
    """
    n = len(sets)
    links = Links(np.arange(n) if labels is None else np.asarray(labels))
    if n < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)

    def count(i: int, j: int) -> None:
        if links.label[i] != links.label[j] and overlap(sets[i], sets[j]) >= need(int(size[i] + size[j]), num, den):
            links.add(min(i, j), max(i, j))

    if n <= FANOUT:
        for i in range(n):
            for j in range(i + 1, n):
                if (split is None or i < split <= j) and den * min(size[i], size[j]) >= num * max(size[i], size[j]):
                    count(i, j)
        return links.pairs

    first = sketches(sets, size)
    halves = [np.arange(n)] if split is None else [np.arange(split), np.arange(split, n)]
    orders = [h[np.lexsort((size[h], first[h]))] for h in halves if len(h)]
    if split is not None and len(orders) < 2:
        return []
    order = np.concatenate(orders)
    sets = [sets[i] for i in order]
    size = size[order]
    links.label = links.label[order]
    # wide enough that two nodes of FANOUT sets that have nothing in common share fewer bits than a link needs
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * FANOUT * FANOUT * max(size.mean(), 1))), 10, 15))
    if split is None:
        left = right = Tree(sets, bits)
        at = (0, 0)
    else:
        left, right = Tree(sets[:split], bits), Tree(sets[split:], bits)
        at = (0, split)
    top = max(len(left.levels), len(right.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > STEP:
            stack.append((level, a[STEP:], b[STEP:]))
            a, b = a[:STEP], b[:STEP]
        la, lb = (t.levels[min(level, len(t.levels) - 1)] for t in (left, right))
        ranges = [links.ranges(FANOUT ** min(level, len(t.levels) - 1), f, t.n) for t, f in ((left, at[0]), (right, at[1]))]
        (min_a, max_a), (min_b, max_b) = ranges
        open_ = ~((min_a[a] == max_a[a]) & (min_b[b] == max_b[b]) & (min_a[a] == min_b[b]))
        open_ &= (den * la[2][a] >= num * lb[1][b]) & (den * lb[2][b] >= num * la[1][a])
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        most = np.bitwise_count(la[0][a] & lb[0][b]).sum(1, dtype=np.int64) + np.minimum(la[3][a], lb[3][b])
        most = np.minimum(most, np.minimum(la[2][a], lb[2][b]))
        keep = most >= need(la[1][a] + lb[1][b], num, den)
        a, b = a[keep], b[keep]
        if level == 0:
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if left is not right or i < j:
                    count(i + at[0], j + at[1])
            continue
        sides = []
        for x, t in ((a, left), (b, right)):
            if level > len(t.levels) - 1:
                sides.append([x])
            else:
                n_below = len(t.levels[level - 1][0])
                sides.append([np.where(x * FANOUT + f < n_below, x * FANOUT + f, -1) for f in range(FANOUT)])
        xs, ys = [], []
        for x in sides[0]:
            for y in sides[1]:
                ok = (x >= 0) & (y >= 0)
                if left is right:
                    ok &= x <= y
                xs.append(x[ok])
                ys.append(y[ok])
        stack.append((level - 1, np.concatenate(xs), np.concatenate(ys)))
    back = [(int(order[i]), int(order[j])) for i, j in links.pairs]
    return [(min(p), max(p)) for p in back]
