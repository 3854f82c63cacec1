"""A signature tree over sets of 64-bit hashes, and the dual traversal of two trees.

A leaf is one set; every node above holds the OR of its children's bitmaps, the range of their
set sizes, the largest number of set members that share a bit with another, and the range of
their labels.  Two nodes are given up when no two sets below them can be similar enough: their
sizes are too far apart, or the bits they share plus the members hidden behind shared bits are
fewer than the least overlap needed; also when all sets below carry one label.  A tree covers a
block of bounded size inside a Spark task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
_CHUNK_BYTES = 8 << 20


@dataclass
class Level:
    bits: np.ndarray  # nodes x 64-bit words
    small: np.ndarray
    large: np.ndarray
    hidden: np.ndarray
    label_from: np.ndarray
    label_to: np.ndarray


class Tree:
    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, width: int):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.sets = [sets[i] for i in order]
        self.labels = labels[order]
        self.order = order
        sizes = np.array([len(s) for s in self.sets], np.int64)
        flags = np.zeros((len(sets), width), np.uint8)
        members = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        flags[np.repeat(np.arange(len(sets)), sizes), (members & np.uint64(width - 1)).astype(np.int64)] = 1
        self._build(np.packbits(flags, axis=1, bitorder="little").view(np.uint64), sizes)

    @classmethod
    def of_bits(cls, bits: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> Tree:
        """A tree over bitmaps alone, folded to the narrowest of them."""
        tree = cls.__new__(cls)
        width = min(len(b) for b in bits)
        tree.sets, tree.order = [], np.argsort(sizes, kind="stable")
        tree.labels = labels[tree.order]
        folded = np.stack([np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in bits])
        tree._build(folded[tree.order], sizes[tree.order])
        return tree

    def _build(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        hidden = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [Level(bits, sizes, sizes, hidden, self.labels, self.labels)]
        while len(self.levels[-1].small) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below.small), FANOUT)
            self.levels.append(
                Level(
                    np.bitwise_or.reduceat(below.bits, at, axis=0),
                    np.minimum.reduceat(below.small, at),
                    np.maximum.reduceat(below.large, at),
                    np.maximum.reduceat(below.hidden, at),
                    np.minimum.reduceat(below.label_from, at),
                    np.maximum.reduceat(below.label_to, at),
                )
            )

    def raised(self, height: int) -> list[Level]:
        return self.levels + [self.levels[-1]] * (height - len(self.levels))


def width_for(largest: int) -> int:
    """Bits of a signature for sets of so many members."""
    return max(256, min(1 << 16, 1 << (2 * largest - 1).bit_length()))


def _possible(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold two sets with 100 * intersection >= percent * union."""
    keep = (percent * b.small[j] <= 100 * a.large[i]) & (percent * a.small[i] <= 100 * b.large[j])
    keep &= ~((a.label_from[i] == a.label_to[i]) & (b.label_from[j] == b.label_to[j]) & (a.label_from[i] == b.label_from[j]))
    at = np.flatnonzero(keep)
    step = max(1, _CHUNK_BYTES // (a.bits.shape[1] * 8))
    for k in range(0, len(at), step):
        own = at[k : k + step]
        x, y = i[own], j[own]
        shared = np.bitwise_count(a.bits[x] & b.bits[y]).sum(axis=1, dtype=np.int64)
        most = shared + np.minimum(a.hidden[x], b.hidden[y])
        keep[own] = (100 + percent) * most >= percent * (a.small[x] + b.small[y])
    return keep


def candidates(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (positions in either tree) that the dual traversal can't rule out.

    ``a is b`` asks for the pairs inside one tree, each once.
    """
    height = max(len(a.levels), len(b.levels))
    left, right = a.raised(height), b.raised(height)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(height - 1, -1, -1):
        keep = _possible(left[level], right[level], i, j, percent)
        if level == 0 and a is b:
            keep &= i < j
        i, j = i[keep], j[keep]
        if level and len(i):
            i, j = _children(i, j, left, right, level)
            if a is b:
                i, j = i[i <= j], j[i <= j]
    return i, j


def _children(i, j, left: list[Level], right: list[Level], level: int) -> tuple[np.ndarray, np.ndarray]:
    def below(nodes: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
        if levels[level] is levels[level - 1]:  # a raised root stands for itself
            return nodes, nodes + 1
        return nodes * FANOUT, np.minimum(nodes * FANOUT + FANOUT, len(levels[level - 1].small))

    (i0, i1), (j0, j1) = below(i, left), below(j, right)
    counts = (i1 - i0) * (j1 - j0)
    pair = np.repeat(np.arange(len(i)), counts)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
    wide = (j1 - j0)[pair]
    return i0[pair] + place // wide, j0[pair] + place % wide


def bitmap(members: np.ndarray) -> np.ndarray:
    """The bitmap of one set; a narrower one is the OR of its parts."""
    width = width_for(max(1, len(members)))
    flags = np.zeros(width, np.uint8)
    flags[(members & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _root(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = y
    return x


def possible_links(tree: Tree, percent: int, up: dict[int, int]) -> list[tuple[int, int]]:
    """Label pairs that the traversal can't rule out, as a spanning forest on top of ``up``."""
    out = []
    i, j = candidates(tree, tree, percent)
    for p, q in zip(tree.labels[i].tolist(), tree.labels[j].tolist(), strict=True):
        r, s = _root(up, p), _root(up, q)
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((p, q))
    return out


def links(a: Tree, b: Tree, percent: int) -> list[tuple[int, int]]:
    """Label pairs joined by some pair of sets, as a spanning forest: each candidate is verified by
    its exact intersection unless earlier links already connect its two labels."""
    i, j = candidates(a, b, percent)
    up: dict[int, int] = {}
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = _root(up, int(a.labels[x])), _root(up, int(b.labels[y]))
        if p == q:
            continue
        s, t = a.sets[x], b.sets[y]
        both = len(np.intersect1d(s, t, assume_unique=True))
        if 100 * both >= percent * (len(s) + len(t) - both):
            up[max(p, q)] = min(p, q)
            out.append((int(a.labels[x]), int(b.labels[y])))
    return out
