"""Signature trees: nodes of records with bitmaps of their tokens combined by OR, and ranges of their sizes.

A record is a set of tokens of which only its size and a bitmap are known here
(bit k is set if a token hashes to k). Two records share at most as many tokens
as both bitmaps have bits in common plus the lesser excess of size over bits, as
every further token of a common bit is an excess one. For nodes the same holds of
their combined bitmaps and greatest excess. A dual traversal drops pairs of nodes
whose greatest possible overlap is too small for any of their records.

Many trees are built and traversed at once, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Children of a node, and pairs of nodes that are compared at once.
FAN, AT_ONCE = 8, 1 << 15


@dataclass
class Level:
    """Nodes of a level; the children of node k, in the level below, are first[k] to first[k + 1]."""

    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    excess: np.ndarray
    own: np.ndarray
    tree: np.ndarray
    first: np.ndarray
    record: np.ndarray  # the first record of each node

    def __len__(self) -> int:
        return len(self.tree)


def _levels(tree: np.ndarray, bits: np.ndarray, size: np.ndarray, own: np.ndarray) -> list[Level]:
    """Levels of trees of records in order, records first, until every tree has one node."""
    excess = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
    levels = [Level(bits, size, size, excess, own, tree, np.arange(len(tree) + 1), np.arange(len(tree)))]
    while True:
        below = levels[-1]
        starts = np.flatnonzero(np.append(True, below.tree[1:] != below.tree[:-1]))
        if len(starts) == len(below):
            return levels
        place = np.arange(len(below)) - np.repeat(starts, np.diff(np.append(starts, len(below))))
        first = np.flatnonzero(place % FAN == 0)
        levels.append(Level(
            np.bitwise_or.reduceat(below.bits, first), np.minimum.reduceat(below.least, first), np.maximum.reduceat(below.most, first), np.maximum.reduceat(below.excess, first),
            np.logical_or.reduceat(below.own, first), below.tree[first], np.append(first, len(below)), below.record[first],
        ))


class Forest:
    """Trees of records that are ordered by tree; records of one tree that are alike should be neighbours.

    percent is the least similarity of a pair (shared tokens in percent of all);
    own says which records may be the only one of a pair that is its own.
    """

    def __init__(self, tree: np.ndarray, bits: np.ndarray, size: np.ndarray, own: np.ndarray, percent: int):
        self.levels, self.percent = _levels(tree, bits, size.astype(np.int64), own), percent

    def _possible(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether records of nodes x and y may be similar enough."""
        f, out = self.levels[level], np.zeros(len(x), bool)
        for at in range(0, len(x), AT_ONCE):
            a, b = x[at : at + AT_ONCE], y[at : at + AT_ONCE]
            some = f.own[a] | f.own[b]
            some &= (100 * f.most[b] >= self.percent * f.least[a]) & (100 * f.most[a] >= self.percent * f.least[b])
            k = np.flatnonzero(some)
            a, b = a[k], b[k]
            shared = np.bitwise_count(f.bits[a] & f.bits[b]).sum(1, dtype=np.int64) + np.minimum(f.excess[a], f.excess[b])
            shared = np.minimum(shared, np.minimum(f.most[a], f.most[b]))
            out[at + k] = (100 + self.percent) * shared >= self.percent * (f.least[a] + f.least[b])
        return out

    def _one_label(self, level: int, labels: np.ndarray) -> np.ndarray:
        """The label of each node, or -1 where its records have several."""
        starts = self.levels[level].record
        least = np.minimum.reduceat(labels, starts)
        return np.where(least == np.maximum.reduceat(labels, starts), least, -1)

    def _descend(self, level: int, x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, number of the pair that they come from) of records below pairs of nodes that have different labels and may be similar enough."""
        ones = [self._one_label(k, labels) for k in range(level + 1)]
        stack = [(level, x, y, np.arange(len(x)))]
        while stack:
            level, x, y, origin = stack.pop()
            if len(x) > AT_ONCE:
                stack += [(level, x[k : k + AT_ONCE], y[k : k + AT_ONCE], origin[k : k + AT_ONCE]) for k in range(0, len(x), AT_ONCE)]
                continue
            apart = (ones[level][x] < 0) | (ones[level][x] != ones[level][y])
            x, y, origin = x[apart], y[apart], origin[apart]
            keep = self._possible(level, x, y)
            x, y, origin = x[keep], y[keep], origin[keep]
            if not len(x):
                continue
            if level == 0:
                yield x, y, origin
                continue
            first = self.levels[level].first
            across, down = first[x + 1] - first[x], first[y + 1] - first[y]
            pair = np.repeat(np.arange(len(x)), across * down)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(across * down) - across * down, across * down)
            stack.append((level - 1, first[x[pair]] + place // down[pair], first[y[pair]] + place % down[pair], origin[pair]))

    def _siblings(self, level: int, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes of one parent, in trees that are joined with themselves."""
        f, above = self.levels[level], self.levels[level + 1] if level + 1 < len(self.levels) else None
        if above is None:
            return np.zeros(0, np.intp), np.zeros(0, np.intp)
        parent = np.repeat(np.arange(len(above)), np.diff(above.first))
        found = []
        for d in range(1, FAN):
            x = np.flatnonzero((parent[:-d] == parent[d:]) & joined[f.tree[:-d]]) if d < len(f) else np.zeros(0, np.intp)
            found.append((x, x + d))
        return tuple(np.concatenate(s) for s in zip(*found))

    def pairs(self, labels: np.ndarray, joined: np.ndarray, roots: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of records that have different labels and may be similar enough, within joined trees and between the roots' trees."""
        for level in range(len(self.levels)):
            for x, y, _ in self._descend(level, *self._siblings(level, joined), labels):
                yield x, y
        for x, y, _ in self._descend(len(self.levels) - 1, *roots, labels):
            yield x, y

    def spanning(self, joined: np.ndarray, roots: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of those pairs, about one for each record, that connect most of what all of them connect: what is connected already is not
        compared again, of two nodes that are each connected their first records are tried first, and a record gets one partner in a node."""
        labels = np.arange(len(self.levels[0]))
        between = [(level, *self._siblings(level, joined)) for level in range(len(self.levels))]
        for level, x, y in [*between, (len(self.levels) - 1, *roots)]:
            if level:
                one, record = self._one_label(level, labels), self.levels[level].record
                whole = (one[x] >= 0) & (one[y] >= 0) & (one[x] != one[y])
                a, b = record[x[whole]], record[y[whole]]
                met = self._possible(0, a, b)
                yield a[met], b[met]
                labels = connected(labels, a[met], b[met])
            found = [np.zeros((3, 0), np.intp), *(np.stack(f) for f in self._descend(level, x, y, labels))]
            a, b, origin = np.concatenate(found, axis=1)
            if len(a):  # of each record of the second node, one partner
                origin *= level > 0
                by = np.lexsort((a, b, origin))
                a, b, origin = a[by], b[by], origin[by]
                new = np.append(True, (b[1:] != b[:-1]) | (origin[1:] != origin[:-1]))
                yield a[new], b[new]
                labels = connected(labels, a[new], b[new])


def connected(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after records a[k] and b[k] have been connected; labels are record numbers, the smallest of those connected."""
    parent = np.arange(len(labels))
    while True:
        x, y = parent[labels[a]], parent[labels[b]]
        if (x == y).all():
            return parent[labels]
        least = np.minimum(x, y)
        np.minimum.at(parent, x, least)
        np.minimum.at(parent, y, least)
        while (parent != parent[parent]).any():
            parent = parent[parent]
