"""Taking many rows down many trees of thresholds.

Only the order of a feature's values and thresholds matters on the way down, so values become ranks among the thresholds, small numbers of which many
fit a processor's register. The first ``TOP`` levels of a tree compare whole columns: the decisions of all nodes of a level are found, and those of the nodes
that rows did reach are picked out by the decisions above. Only below that each row looks up its own node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

TOP = 5
STEPS = 4  # down a tree before the rows that are in leaves are put aside
CHUNK = 32_768  # rows that go down together
# A packed node is its child below, what its cut lacks to the greatest rank, and its feature: a rank above the cut, added to it, carries one to the child.
_CUT, _BELOW = 16, 38
_FEATURES, _MOST = (1 << _CUT) - 1, (1 << (_BELOW - _CUT)) - 1


@dataclass
class Ranks:
    """Ranks of rows: a contiguous column for each feature, and all row by row."""

    columns: np.ndarray
    flat: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, columns: np.ndarray) -> Ranks:
        return cls(columns, np.ascontiguousarray(columns.T).ravel(), np.arange(columns.shape[1]) * len(columns))


@dataclass
class Tree:
    """Nodes from the root on, level by level, the node above behind the one below. A leaf is its own child, which nothing passes."""

    packed: np.ndarray
    inner: np.ndarray
    top: dict[tuple[int, ...], tuple[int, int]]  # the nodes of the first levels by the decisions that lead there: feature and cut
    entry: np.ndarray  # the node that the decisions of the first levels lead to
    steps: int  # at most so many levels are below the first ones

    @classmethod
    def of(cls, feature: np.ndarray, cut: np.ndarray, below: np.ndarray, top: int = TOP) -> Tree:
        """``below`` counts from the root, a leaf's feature is -1, and the child above is the one after."""
        feature, cut, below = (np.asarray(x, np.int64) for x in (feature, cut, below))
        inner = feature >= 0
        if len(feature) >= 1 << (63 - _BELOW) or feature.max() > _FEATURES or cut.max() >= _MOST:
            raise ValueError("a tree, its features or its cuts are too many")
        packed = np.where(inner, below, np.arange(len(feature))) << _BELOW | np.where(inner, _MOST - cut, 0) << _CUT | np.where(inner, feature, 0)
        found: dict[tuple[int, ...], tuple[int, int]] = {}
        level: dict[tuple[int, ...], int] = {(): 0}
        for _ in range(top):
            found |= {path: (int(feature[node]), int(cut[node])) for path, node in level.items() if inner[node]}
            level = {(*path, side): int(below[node]) + side if inner[node] else node for path, node in level.items() for side in (0, 1)}
        entry = np.zeros(1 << top, np.int64)
        for path, node in level.items():
            entry[sum(side << k for k, side in enumerate(path))] = node
        left, steps = np.unique(entry), 0
        while len(left := left[inner[left]]):
            left, steps = np.concatenate([below[left], below[left] + 1]), steps + 1
        return cls(packed, inner, found, entry, steps)

    def _decisions(self, columns: np.ndarray, taken: list[np.ndarray | None], path: tuple[int, ...], depth: int) -> np.ndarray | None:
        """What the nodes ``depth`` levels below the given one decide, for the rows each would get; None: nothing is above a cut."""
        if path not in self.top:
            return None
        if not depth:
            feature, cut = self.top[path]
            return columns[feature] > cut
        here = taken[len(path)]
        low = self._decisions(columns, taken, (*path, 0), depth - 1)
        if here is None:
            return low
        high = self._decisions(columns, taken, (*path, 1), depth - 1)
        if low is None:
            return high if high is None else high & here
        if high is None:
            return low & ~here
        high ^= low
        high &= here
        high ^= low
        return high

    def leaves(self, ranks: Ranks, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or of the rows asked for, counted from the root."""
        taken: list[np.ndarray | None] = []
        code = np.zeros(ranks.columns.shape[1], np.uint8)
        for k in range(len(self.entry).bit_length() - 1):
            taken.append(self._decisions(ranks.columns, taken, (), k))
            if taken[k] is not None:
                code |= taken[k].view(np.uint8) << np.uint8(k)
        at = self.entry.take(code if rows is None else code.take(rows))
        done, open_, start, left = at, None, ranks.start if rows is None else ranks.start.take(rows), self.steps
        while left > 0:
            for _ in range(min(left, STEPS)):
                node = self.packed.take(at)
                place = node & _FEATURES
                place += start
                node += np.left_shift(ranks.flat.take(place), _CUT, dtype=np.int64)
                node >>= _BELOW
                at = node
            left -= STEPS
            if open_ is None:
                done = at
            else:
                done[open_] = at
            if left > 0:
                still = np.flatnonzero(self.inner.take(at))
                if not len(still):
                    break
                open_ = still if open_ is None else open_[still]
                start, at = start[still], at[still]
        return done


@dataclass
class Descent:
    """Trees given by thresholds."""

    cuts: list[np.ndarray]  # thresholds of each feature, in order
    trees: list[Tree]
    nodes: list[np.ndarray]  # the given number of each node of a tree, as the tree counts them

    @classmethod
    def of(cls, feature: np.ndarray, threshold: np.ndarray, below: np.ndarray, above: np.ndarray, heads: Sequence[int], features: int) -> Descent:
        """A row goes below if its value is at most the threshold. Leaves have feature -1; children are given by their numbers in all the arrays."""
        cuts = [np.unique(threshold[feature == f]) for f in range(features)]
        trees, nodes = [], []
        for head in heads:
            levels = [np.array([head])]
            while len(inner := levels[-1][feature[levels[-1]] >= 0]):
                levels.append(np.stack([below[inner], above[inner]], 1).ravel())
            order = np.concatenate(levels)
            f = feature[order].astype(np.int64)
            cut = np.zeros(len(order), np.int64)
            for k in np.unique(f[f >= 0]):
                cut[f == k] = np.searchsorted(cuts[k], threshold[order[f == k]])
            trees.append(Tree.of(f, cut, np.where(f >= 0, 2 * np.cumsum(f >= 0) - 1, -1)))
            nodes.append(order)
        return cls(cuts, trees, nodes)

    def ranks(self, values: np.ndarray) -> Ranks:
        """How many thresholds are below each value [row, feature]; not-a-number is above all."""
        most = max((len(c) for c in self.cuts), default=0)
        kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
        return Ranks.of(np.stack([np.searchsorted(c, values[:, i], "left").astype(kind) for i, c in enumerate(self.cuts)]))

    def by_tree(self, values: np.ndarray) -> list[np.ndarray]:
        """The values of the given nodes (along the last axis) as each tree counts them."""
        return [np.ascontiguousarray(values[..., n]) for n in self.nodes]


def in_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, ``CHUNK`` rows at a time or a few more."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        parts.append(batch)
        if sum(p.num_rows for p in parts) >= CHUNK:
            yield pa.concat_batches(parts)
            parts = []
    if parts:
        yield pa.concat_batches(parts)


def floats(column: pa.Array) -> np.ndarray:
    """Numbers of any kind as doubles, not-a-number for null."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64)
