"""Random forests on tables of any size: rows are binned once into blocks that stay where they are.

Nodes of more than ``SMALL_ROWS`` drawn rows are cut by class counts that all tasks add up; a smaller node is finished by one task, which gets its rows.
A tree draws each row a Poisson number of times, told by the hash of the row's features and the tree, so that trees depend neither on how rows are
spread nor on how many trees grow at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.operators import descent
from duskwatch.operators.boosting import bin_edges, packed
from duskwatch.operators.forest import grow_tree

SMALL_ROWS = 1 << 18  # drawn rows of a node that go to one task
MOST_MOVED = 400_000_000  # rows of all trees whose small nodes are finished at once
MOST_CELLS = 1 << 24  # counts that a task holds of all trees whose wide nodes are cut at once
BLOCKS = 8  # that are counted together
SEED = 42
_SUMS = "tree int, counts binary"
_CUTS = "tree int, slot int, feature int, cut int, n_below array<bigint>, n_above array<bigint>"
_MEMBERS = "tree int, node int, bins binary, labels binary, times binary"
_PARTS = "tree int, node int, feature binary, cut binary, below binary, shares binary"
# At most so many draws for each value of a uniform number: the Poisson distribution of mean one.
_TIMES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_LIMITS = np.ceil(_TIMES * 2.0**53).astype(np.uint64)


@dataclass
class Tree:
    """Nodes in the order they were made; the node above stands behind the one below. Feature -1: a leaf, or not cut yet."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    below: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    shares: list[np.ndarray | None] = field(default_factory=lambda: [None])
    wide: dict[int, int] = field(default_factory=dict)  # nodes to be cut by the counts of all tasks, and how many features were tried
    small: list[int] = field(default_factory=list)  # nodes to be finished by one task
    parts: list[tuple] = field(default_factory=list)  # the trees below those, as arrays

    def finished(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All nodes as arrays. A small node is the root of its part; the part's other nodes are put behind those there are."""
        columns = [np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.below, np.int32), np.array(self.shares, np.float64)]
        held, size = [[c] for c in columns], len(self.feature)
        for node, feature, cut, below, shares in self.parts:
            own = (feature, cut, np.where(below >= 0, below - 1 + size, -1).astype(np.int32), shares.reshape(-1, columns[3].shape[1]))
            for column, pieces, values in zip(columns, held, own, strict=True):
                column[node] = values[0]
                pieces.append(values[1:])
            size += len(feature) - 1
        return tuple(np.concatenate(pieces) for pieces in held)


@dataclass
class Growing:
    """What tasks need to know of a tree: its nodes, the slot of each wide node, the features each slot looks at [draw, slot]."""

    down: descent.Tree
    slot: np.ndarray
    looked: np.ndarray
    small: np.ndarray

    @classmethod
    def of(cls, tree: Tree, number: int, n_features: int, drawn: int, seed: int) -> Growing:
        slot, small = np.full(len(tree.feature), -1), np.zeros(len(tree.feature), bool)
        looked = np.full((drawn, len(tree.wide)), -1)
        for i, (node, tried) in enumerate(tree.wide.items()):
            slot[node] = i
            order = np.random.default_rng([seed, number, node]).permutation(n_features)[tried : tried + drawn]
            looked[: len(order), i] = order
        small[tree.small] = True
        return cls(descent.Tree.of(*(np.array(x) for x in (tree.feature, tree.cut, tree.below))), slot, looked, small)


def drawn_times(marks: np.ndarray, number: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    x = marks.view(np.uint64) + np.uint64((seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    times = np.zeros(len(x), np.uint8)
    for limit in _LIMITS[:4]:
        times += (x >= limit).view(np.uint8)
    often = np.flatnonzero(times == 4)
    times[often] = np.searchsorted(_LIMITS, x.take(often), "right")
    return times


def cuts_of(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For class counts [slot, bin, class] the best cut of each slot by Gini impurity and its score, -inf where nothing can be cut; the lowest of equal cuts."""
    low = np.cumsum(counts, 1)
    high = low[:, -1:] - low
    left, right = low * weights, high * weights
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2).sum(2) / left.sum(2) + (right**2).sum(2) / right.sum(2)
    gain[(low.sum(2) == 0) | (high.sum(2) == 0)] = -np.inf
    cut = gain.argmax(1)
    return gain[np.arange(len(cut)), cut], cut


def _opened(batch: pa.RecordBatch, i: int, n_features: int) -> tuple[descent.Ranks, np.ndarray, np.ndarray]:
    bins, labels, marks = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((1, np.uint8), (2, np.int32), (3, np.int64)))
    return descent.Ranks.of(np.ascontiguousarray(bins.reshape(-1, n_features).T)), labels.astype(np.uint8), marks


def _in_groups(trees: dict[int, Tree], cells: int) -> Iterator[dict[int, Tree]]:
    """The trees that have wide nodes, as many at a time as have ``MOST_CELLS`` counts; ``cells`` is what a node has."""
    group: dict[int, Tree] = {}
    held = 0
    for number, tree in trees.items():
        if tree.wide:
            if group and held + len(tree.wide) * cells > MOST_CELLS:
                yield group
                group, held = {}, 0
            group[number] = tree
            held += len(tree.wide) * cells
    if group:
        yield group


def _cut_wide(blocks: DataFrame, trees: dict[int, Tree], n_features: int, classes: int, weights: np.ndarray, drawn: int, depth: int, seed: int) -> None:
    """Cut the wide nodes of all trees once."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast({k: Growing.of(t, k, n_features, drawn, seed) for k, t in trees.items()})

    def add_up(batches):
        held = {number: np.zeros((drawn, tree.looked.shape[1] * 256 * classes), np.int64) for number, tree in sent.value.items()}
        some = False
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCKS):
                some = True
                opened = [_opened(batch, i, n_features) for i in range(first, min(first + BLOCKS, batch.num_rows))]
                for number, tree in sent.value.items():
                    found: list[tuple[np.ndarray, ...]] = []
                    for ranks, labels, marks in opened:
                        times = drawn_times(marks, number, seed)
                        mine = np.flatnonzero(times)
                        slot = tree.slot.take(tree.down.leaves(ranks, mine))
                        if slot.min(initial=0) < 0:
                            kept = np.flatnonzero(slot >= 0)
                            mine, slot = mine.take(kept), slot.take(kept)
                        start = ranks.start.take(mine)
                        base = slot * (256 * classes) + labels.take(mine)
                        looks = [looked.take(slot) for looked in tree.looked]
                        keys = [base + ranks.flat.take(start + f).astype(np.int64) * classes for f in looks]
                        found.append((times.take(mine).astype(np.float64), *keys, *(f >= 0 for f in looks)))
                    times, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
                    for total, key, has in zip(held[number], rest[:drawn], rest[drawn:], strict=True):
                        everything = has.all()
                        counted = np.bincount(key if everything else key[has], times if everything else times[has], len(total))
                        np.add(total, counted, out=total, casting="unsafe")
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([t.astype(np.int32).tobytes() for t in held.values()], pa.binary())], names=["tree", "counts"])

    def choose(group):
        number = group.column(0)[0].as_py()
        looked = sent.value[number].looked
        counts = np.zeros(looked.size * 256 * classes, np.int64)
        for part in group.column(1):
            counts += np.frombuffer(part.as_py(), np.int32)
        counts = counts.reshape(*looked.shape, 256, classes)
        score, cut = (np.stack(x) for x in zip(*(cuts_of(c, weights) for c in counts), strict=True))
        score[looked < 0] = -np.inf
        best, slots = score.argmax(0), np.arange(looked.shape[1])
        found = score[best, slots] > -np.inf
        where = cut[best, slots]
        low = [counts[best[s], s, : where[s] + 1].sum(0) for s in slots]
        high = [counts[best[s], s, where[s] + 1 :].sum(0) for s in slots]
        feature = np.where(found, looked[best, slots], -1)
        columns = [np.full(len(slots), number, np.int32), slots.astype(np.int32), feature.astype(np.int32), where.astype(np.int32)]
        return pa.Table.from_arrays([*(pa.array(c) for c in columns), *(pa.array([x.tolist() for x in side], pa.list_(pa.int64())) for side in (low, high))], names=["tree", "slot", "feature", "cut", "n_below", "n_above"])

    told = blocks.mapInArrow(add_up, _SUMS).groupBy("tree").applyInArrow(choose, _CUTS).collect()
    waiting = {k: list(t.wide.items()) for k, t in trees.items()}
    for r in told:
        tree = trees[r["tree"]]
        node, tried = waiting[r["tree"]][r["slot"]]
        del tree.wide[node]
        if r["feature"] >= 0:
            tree.feature[node], tree.cut[node], tree.below[node] = r["feature"], r["cut"], len(tree.feature)
            for counts in (r["n_below"], r["n_above"]):
                _add_node(tree, np.array(counts), weights, tree.depth[node] + 1, depth)
        elif tried + drawn < n_features:
            tree.wide[node] = tried + drawn
    sent.destroy()


def _add_node(tree: Tree, counts: np.ndarray, weights: np.ndarray, at_depth: int, depth: int) -> None:
    node, total = len(tree.feature), counts * weights
    for column, value in ((tree.feature, -1), (tree.cut, 0), (tree.below, -1), (tree.depth, at_depth), (tree.shares, total / max(total.sum(), 1e-300))):
        column.append(value)
    if at_depth < depth and (counts > 0).sum() > 1:
        if counts.sum() > SMALL_ROWS:
            tree.wide[node] = 0
        else:
            tree.small.append(node)


def _sorted_rows(bins: np.ndarray, labels: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by their bins (the last feature's first), labels and times. Rows that fit 64 bits are sorted as numbers."""
    columns = [times, labels, *bins.T]
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 64:
        order = np.lexsort(columns)
        return bins[order], labels[order], times[order]
    packed = np.zeros(len(times), np.uint64)
    for column, width in zip(reversed(columns), reversed(bits), strict=True):
        packed <<= np.uint64(width)
        packed |= column
    packed.sort()
    told = []
    for width in bits:
        told.append((packed & np.uint64((1 << width) - 1)).astype(np.uint8))
        packed >>= np.uint64(width)
    return np.stack(told[2:], 1), told[1], told[0]


def _finish_small(blocks: DataFrame, trees: dict[int, Tree], n_features: int, classes: int, weights: np.ndarray, drawn: int, depth: int, seed: int) -> None:
    """Grow what is below the small nodes of all trees, each in one task."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast({k: (Growing.of(t, k, n_features, drawn, seed), np.array(t.depth)) for k, t in trees.items() if t.small})

    def members(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ranks, labels, marks = _opened(batch, i, n_features)
                bins = ranks.flat.reshape(-1, n_features)
                for number, (tree, _) in sent.value.items():
                    times = drawn_times(marks, number, seed)
                    mine = np.flatnonzero(times)
                    at = tree.down.leaves(ranks, mine)
                    kept = np.flatnonzero(tree.small.take(at))
                    if not len(kept):
                        continue
                    mine, at = mine.take(kept), at.take(kept)
                    order = np.argsort(at.astype(np.uint16) if len(tree.small) <= 65_536 else at, kind="stable")
                    mine, at = mine.take(order), at.take(order)
                    ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1
                    told = [(number, int(at[a]), bins[mine[a:b]].tobytes(), labels[mine[a:b]].tobytes(), times[mine[a:b]].tobytes()) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
                    kinds = [pa.int32()] * 2 + [pa.binary()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), kinds, strict=True)], names=["tree", "node", "bins", "labels", "times"])

    def grow(group):
        number, node = group.column(0)[0].as_py(), group.column(1)[0].as_py()
        bins, labels, times = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint8) for c in (2, 3, 4))
        bins, labels, times = _sorted_rows(bins.reshape(-1, n_features), labels, times)  # so that sums don't depend on the order of arrival
        labels = labels.astype(np.int64)
        level = int(sent.value[number][1][node])
        made = grow_tree(bins, labels, times * weights[labels], classes, np.random.default_rng([seed, number, node]), drawn, depth - level)
        cells = (made.feature.astype(np.int16), made.cut.astype(np.uint8), made.below.astype(np.int32), made.shares.astype(np.float64))
        columns = [pa.array([number], pa.int32()), pa.array([node], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)]
        return pa.Table.from_arrays(columns, names=["tree", "node", "feature", "cut", "below", "shares"])

    groups = sum(len(t.small) for t in trees.values())
    tasks = max(1, min(groups, 8 * spark.sparkContext.defaultParallelism))
    told = blocks.mapInArrow(members, _MEMBERS).repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(grow, _PARTS)
    for r in sorted(told.collect(), key=lambda r: (r["tree"], r["node"])):
        cells = (np.frombuffer(r[c], t) for c, t in (("feature", np.int16), ("cut", np.uint8), ("below", np.int32), ("shares", np.float64)))
        trees[r["tree"]].parts.append((r["node"], *cells))
    sent.destroy()


@dataclass
class Forest:
    """Trees as arrays, and the bin edges of their features. Bounded by the number and the depth of the trees."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    edges: list[np.ndarray]
    classes: int


def fit(rows: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, classes: int = 2, seed: int = SEED) -> Forest:
    """A forest on all ``rows``, classes (numbers below ``classes``) weighted to equal sums."""
    features = list(features)
    edges = bin_edges(rows, features)
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = packed(rows.repartition(tasks), features, label, edges, 1)
    sizes = {r["y"]: r["n"] for r in rows.groupBy(F.col(f"`{label}`").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect() if r["y"] is not None}
    n = sum(sizes.values())
    weights = np.array([n / (len(sizes) * sizes[c]) if c in sizes else 0.0 for c in range(classes)])
    drawn = max(1, int(math.sqrt(len(features))))
    at_once = max(1, min(trees, MOST_MOVED // max(n, 1)))
    shares = weights * [sizes.get(c, 0) for c in range(classes)] / max(n, 1)
    settings = (len(features), classes, weights, drawn, depth, seed)
    grown = {k: Tree(shares=[shares]) for k in range(trees)}
    if len(sizes) > 1:
        for tree in grown.values():
            if n > SMALL_ROWS:
                tree.wide[0] = 0
            else:
                tree.small.append(0)
    while any(t.wide for t in grown.values()):
        for group in list(_in_groups(grown, drawn * 256 * classes)):
            _cut_wide(blocks, group, *settings)
    for first in range(0, trees, at_once):
        batch = {k: grown[k] for k in range(first, min(first + at_once, trees)) if grown[k].small}
        if batch:
            _finish_small(blocks, batch, *settings)
    return Forest([t.finished() for t in grown.values()], edges, classes)


def score(forest: Forest, rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``truth, predicted, p`` of all rows that have a label: the class with the greatest share (the lowest of equal ones), and the share of class 1."""
    spark = rows.sparkSession
    blocks = packed(rows.repartition(2 * spark.sparkContext.defaultParallelism), list(features), label, forest.edges, 1)
    down = [descent.Tree.of(feature, cut, below) for feature, cut, below, _ in forest.trees]
    sent: Broadcast = spark.sparkContext.broadcast((down, [np.ascontiguousarray(t[3].T) for t in forest.trees], forest.classes))
    n_features = len(features)

    def run(batches):
        down, shares, classes = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                ranks, labels, _ = _opened(batch, i, n_features)
                total = np.zeros((classes, len(labels)))
                for tree, told in zip(down, shares, strict=True):
                    leaves = tree.leaves(ranks)
                    for sums, of_class in zip(total, told, strict=True):
                        sums += of_class.take(leaves)
                total /= len(down)
                yield pa.RecordBatch.from_arrays([pa.array(labels.astype(np.int32)), pa.array(total.argmax(0).astype(np.int32)), pa.array(total[1])], names=["truth", "predicted", "p"])

    return blocks.mapInArrow(run, "truth int, predicted int, p double")
