"""Random forests without a depth limit, for training tables whose size is capped.

A training table of flows holds a fixed number of rows of each class at most (``cap_per_class``), however many flows there are. Such a
table, binned to a byte a value, is what every task gets; trees are what is dealt to tasks, those of all folds of a cross-validation at once.
A tree grows level by level: one sort for each drawn feature finds the best cut of all nodes of a level. ``MOST_ROWS`` is checked; a larger table is
for the forests of ``models.fit_forest``, which pass over distributed rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.descent import Descent, floats, in_chunks
from duskwatch.session import cut_lineage, dealt

BINS = 255
MOST_ROWS = 1_000_000  # rows of a training table that is sent to every task: a byte for each value
SEED = 42
_NODES = "tree int, node int, feature int, threshold double, below int, above int, shares array<double>"


@dataclass
class Table:
    """A capped training table in the order of its rows' hashes: binned values, labels, and where bins end."""

    bins: np.ndarray
    labels: np.ndarray
    edges: list[np.ndarray]
    classes: int
    fold: np.ndarray | None = None
    row: np.ndarray | None = None


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between a feature's distinct values: all midpoints, or as many as there are bins, at equal shares of the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = distinct[:-1] + (distinct[1:] - distinct[:-1]) / 2
    if len(middle) < bins:
        return middle
    below = np.cumsum(counts)[:-1]
    wanted = len(values) * np.arange(1, bins) / bins
    return middle[np.unique(np.minimum(np.searchsorted(below, wanted), len(middle) - 1))]


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers: a value is in bin c or a lower one if it is at most ``edges[c]``."""
    return np.stack([np.searchsorted(e, values[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def load_table(rows: DataFrame, features: Sequence[str], label: str, fold: str | None = None, bins: int = BINS) -> Table:
    """The capped table ``rows``; a larger one than ``MOST_ROWS`` is refused."""
    names = [*features, label, *([fold] if fold else [])]
    ordered = rows.select(*[F.col(f"`{n}`") for n in names])
    if ordered.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a training table of more than {MOST_ROWS} rows")
    table = ordered.orderBy(F.xxhash64(*[F.col(f"`{n}`") for n in features]), *[F.col(f"`{n}`") for n in names]).toArrow()
    values = np.stack([table.column(i).to_numpy().astype(np.float64) for i in range(len(features))], axis=1) if table.num_rows else np.zeros((0, len(features)))
    labels = table.column(len(features)).to_numpy().astype(np.int64)
    edges = [bin_edges(values[:, i], bins) for i in range(len(features))]
    return Table(
        binned(values, edges), labels, edges, int(labels.max(initial=0)) + 1,
        table.column(len(features) + 1).to_numpy().astype(np.int64) if fold else None, np.arange(len(labels)),
    )


def class_weights(labels: np.ndarray, classes: int) -> np.ndarray:
    """n / (classes * rows of the class), over the classes that occur."""
    counts = np.bincount(labels, minlength=classes)
    return np.where(counts > 0, len(labels) / (max(1, (counts > 0).sum()) * np.maximum(counts, 1)), 0.0)


@dataclass
class Tree:
    feature: np.ndarray  # -1 for a leaf
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    shares: np.ndarray


def _in_order(at: np.ndarray, values: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by node and value, equal ones as they come, and those as one number; numbers of up to two bytes are sorted by their digits."""
    if nodes <= 256:
        key = at.astype(np.uint16)
        key <<= 8
        key |= values.astype(np.uint16)
        order = np.argsort(key, kind="stable")
    else:
        key = at * 256 + values
        order = np.argsort(values.astype(np.uint8), kind="stable")
        order = order.take(np.argsort(at.astype(np.uint16 if nodes <= 65_536 else np.int64).take(order), kind="stable"))
    return order, key.take(order)


def best_cuts(at: np.ndarray, values: np.ndarray, labels: np.ndarray, weights: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node (``at`` says which one a row is in) the best cut of ``values`` by Gini impurity, and its score; -inf where nothing can be cut."""
    nodes, classes = totals.shape
    score, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
    if not len(at):
        return score, cut
    order, key = _in_order(at, values, nodes)
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own, ordered = labels.take(order), weights.take(order)
    cells = np.stack([np.cumsum(np.add.reduceat(ordered * (own == c), heads)) for c in range(classes)], axis=1)
    key = key[heads].astype(np.int64)
    node = key >> 8
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    begin = np.concatenate([np.zeros((1, classes)), cells])[first]
    left = cells - np.repeat(begin, np.diff(np.append(first, len(node))), axis=0)
    right = totals[node] - left
    last = np.append(node[1:] != node[:-1], True)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2).sum(1) / left.sum(1) + (right**2).sum(1) / right.sum(1)
    gain[last] = -np.inf
    top = np.maximum.reduceat(gain, first)
    where = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(node)))))
    chosen = where[np.unique(node[where], return_index=True)[1]]  # the lowest of equal cuts
    score[node[first]] = top
    cut[node[chosen]] = key[chosen] & 255
    return score, cut


def grow_tree(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, classes: int, rng: np.random.Generator, drawn: int | None = None, depth: int | None = None) -> Tree:
    """A tree grown until nodes are pure or cannot be cut, or have the given depth. Each node looks at ``drawn`` features (the square root of all), and at more only until one can be cut."""
    n_features = bins.shape[1]
    drawn = drawn or max(1, int(np.sqrt(n_features)))
    rows = np.flatnonzero(weights > 0)
    bins, y, w = bins[rows], labels[rows], weights[rows]
    at = np.zeros(len(rows), np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    made, count, level = 0, 1, 0
    while count:
        flat, start = bins.ravel(), np.arange(len(bins)) * n_features
        totals = np.bincount(at * classes + y, w, count * classes).reshape(count, classes)
        open_ = ((totals > 0).sum(1) > 1) & (depth is None or level < depth)
        level += 1
        order = np.argsort(rng.random((count, n_features)), axis=1)
        best, feature, cut = np.full(count, -np.inf), np.full(count, -1), np.zeros(count, np.int64)
        for k in range(n_features):
            looking = open_ if k < drawn else open_ & (feature < 0)
            if not looking.any():
                break
            mine = slice(None) if looking.all() else np.flatnonzero(looking.take(at))
            here = at[mine]
            score, where = best_cuts(here, flat.take(start[mine] + order[:, k].take(here)), y[mine], w[mine], totals)
            better = looking & (score > best)
            best[better], cut[better], feature[better] = score[better], where[better], order[better, k]
        split = feature >= 0
        below = np.full(count, -1)
        below[split] = made + count + 2 * np.arange(int(split.sum()))
        sums = totals.sum(1, keepdims=True)
        parts.append((feature, cut, below, np.where(split, below + 1, -1), totals / np.where(sums > 0, sums, 1)))
        if not split.all():
            stay = np.flatnonzero(split.take(at))
            bins, y, w, at, start = bins.take(stay, axis=0), y.take(stay), w.take(stay), at.take(stay), start.take(stay)
        high = flat.take(start + feature.take(at)) > cut.take(at)
        made += count
        at = below.take(at) - made + high
        count = 2 * int(split.sum())
    return Tree(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Class shares of each row's leaf."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        here = at[rows]
        rows = rows[tree.feature[here] >= 0]
        here = at[rows]
        at[rows] = np.where(bins[rows, tree.feature[here]] > tree.cut[here], tree.above[here], tree.below[here])
    return tree.shares[at]


def _tree_of(table: Table, keep: np.ndarray, number: int, fold: int, seed: int) -> Tree:
    """Tree ``number`` of a forest on the rows ``keep``: a bootstrap sample, weighted by class."""
    rng = np.random.default_rng([seed, fold + 1, number])
    labels = table.labels[keep]
    times = np.bincount(rng.integers(0, max(len(labels), 1), len(labels)), minlength=len(labels))
    return grow_tree(table.bins[keep], labels, times * class_weights(labels, table.classes)[labels], table.classes, rng)


def out_of_fold(rows: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, trees: int, seed: int = SEED) -> DataFrame:
    """(fold, row, label, shares): for each row the class shares that the forest of the other folds gives it.

    All trees of all folds are dealt to tasks; a task adds up what its trees say of a fold's rows.
    """
    spark = rows.sparkSession
    table = load_table(rows, features, label, fold)
    sent = spark.sparkContext.broadcast(table)

    def grow(batches):
        data = sent.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number in batch.column(0).to_pylist():
                own, tree = divmod(number, trees)
                made = _tree_of(data, np.flatnonzero(data.fold != own), tree, own, seed)
                told = walk(made, data.bins[data.fold == own])
                sums[own] = sums[own] + told if own in sums else told
        for own, total in sums.items():
            which = np.flatnonzero(data.fold == own)
            columns = [pa.array(np.full(len(which), own, np.int32)), pa.array(which), pa.array(data.labels[which])]
            columns += [pa.array(np.ascontiguousarray(total[:, c])) for c in range(data.classes)]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "row", "label", *[f"p{c}" for c in range(data.classes)]])

    schema = "fold int, row bigint, label bigint, " + ", ".join(f"p{c} double" for c in range(table.classes))
    tasks = 2 * spark.sparkContext.defaultParallelism
    told = spark.range(0, folds * trees, 1, tasks).mapInArrow(grow, schema)
    shares = F.array(*[F.sum(f"p{c}") / trees for c in range(table.classes)]).alias("shares")
    return told.groupBy("fold", "row").agg(F.first("label").alias("label"), shares)


def fit(rows: DataFrame, features: Sequence[str], label: str, trees: int, seed: int = SEED) -> DataFrame:
    """The forest as a written table of nodes: a row goes below if its value is at most the threshold; leaves have feature -1."""
    spark = rows.sparkSession
    table = load_table(rows, features, label)
    sent = spark.sparkContext.broadcast(table)

    def grow(batches):
        data = sent.value
        everything = np.arange(len(data.labels))
        for batch in batches:
            for number in batch.column(0).to_pylist():
                t = _tree_of(data, everything, number, -1, seed)
                n = len(t.feature)
                threshold = [float(data.edges[f][c]) if f >= 0 else None for f, c in zip(t.feature.tolist(), t.cut.tolist(), strict=True)]
                columns = [np.full(n, number, np.int32), np.arange(n, dtype=np.int32), t.feature.astype(np.int32), pa.array(threshold, pa.float64()), t.below.astype(np.int32), t.above.astype(np.int32), pa.array(list(t.shares), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["tree", "node", "feature", "threshold", "below", "above", "shares"])

    return cut_lineage(spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(grow, _NODES))


@dataclass
class Walks:
    """Nodes of many trees to walk rows down: a step takes a row to ``below``, or to the node after it."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray

    @classmethod
    def of(cls, feature: np.ndarray, threshold: np.ndarray, below: np.ndarray, above: np.ndarray) -> Walks:
        inner = feature >= 0
        if (above[inner] != below[inner] + 1).any():
            raise ValueError("a node's two children do not follow each other")
        return cls(feature, threshold, below, above)

    def descent(self, heads: Sequence[int], features: int) -> Descent:
        """The trees below the nodes ``heads``."""
        return Descent.of(self.feature, self.threshold, self.below, self.above, heads, features)

    def leaves(self, values: np.ndarray, head: int) -> np.ndarray:
        """The leaf of each row below the node ``head``. A value that is not a number is above every threshold."""
        down = self.descent([head], values.shape[1])
        return down.nodes[0].take(down.trees[0].leaves(down.ranks(values)))


def score(nodes: DataFrame, rows: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """``keep..., shares`` of every row: the mean of its leaves' class shares. The node table is bounded by trees and training rows, so it is broadcast."""
    table = nodes.orderBy("tree", "node").toArrow()
    tree, feature, below, above = (table.column(n).to_numpy().astype(np.int64) for n in ("tree", "feature", "below", "above"))
    heads = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    base = np.repeat(heads, np.diff(np.append(heads, len(tree))))
    shares = np.array(table.column("shares").to_pylist(), np.float64)
    down = Walks.of(feature, table.column("threshold").to_numpy(), below + base, above + base).descent(heads.tolist(), len(features))
    sent = rows.sparkSession.sparkContext.broadcast((down, down.by_tree(shares.T)))

    def run(batches):
        down, shares = sent.value
        for batch in in_chunks(batches):
            ranks = down.ranks(np.stack([floats(batch.column(len(keep) + i)) for i in range(len(features))], axis=1))
            total = np.zeros((len(shares[0]), batch.num_rows))
            for tree, told in zip(down.trees, shares, strict=True):
                leaves = tree.leaves(ranks)
                for sums, of_class in zip(total, told, strict=True):
                    sums += of_class.take(leaves)
            ends = np.arange(0, total.size + 1, len(total), dtype=np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array((total.T / len(down.trees)).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), found], names=[*keep, "shares"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return dealt(rows.select(*dict.fromkeys([*keep, *features]))).select(*keep, *features).mapInArrow(run, f"{kinds}{', ' if keep else ''}shares array<double>")
