"""Boosted trees as one softmax model: every round adds a tree per class, fitted to first and second derivatives of the loss.

Rows are binned once and packed into blocks, which stay where they are. A level of all nodes of a round that have many rows is one job: tasks add up the
derivatives of their blocks by (feature, class, node, bin), the sums are shuffled by feature, and each feature's best cuts come back, a number that the
model's settings bound. Nodes of at most ``SMALL_ROWS`` rows are finished together in one job at the end of the round, each by a task that gets its rows.
Derivatives are added as whole numbers of 2^-30, so the trees depend neither on how rows are spread nor on which of the two ways a node was cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.forest import binned
from duskwatch.session import cut_lineage

BINS = 255
SKETCH_ERROR = 1 / (8 * BINS)  # of the ranks that bin edges are taken at; none on tables of a few hundred rows
BLOCK_ROWS = 32_768
SMALL_ROWS = 65_536  # of a node whose rows go to one task
WRITE_EVERY = 5  # rounds after which the rows' margins are written; those of later rounds are added when a block is read
SCALE = 1 << 30  # sums of up to 2^33 rows fit a long
SEED = 42
_BLOCKS = "n int, bins binary, labels binary, marks binary, margins binary"
_SUMS = "feature int, cells binary, g binary, h binary, n binary"
_CUTS = "feature int, class int, node int, cut int, gain double, g_below bigint, h_below bigint, n_below bigint, g bigint, h bigint, n bigint"
_MEMBERS = "class int, node int, bins binary, g binary, h binary"
_PARTS = "class int, node int, feature int, cut int, value double"
_NODES = "round int, class int, node int, feature int, threshold double, value double"


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 6
    step: float = 0.1
    row_share: float = 0.8
    feature_share: float = 0.8
    penalty: float = 1.0  # added to the second derivatives of a leaf
    least: float = 1.0  # second derivatives that each side of a cut needs
    seed: int = SEED


@dataclass
class Trees:
    """The trees of one round, nodes numbered as in a heap: below 2 i + 1, above 2 i + 2. Leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    drawn: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    wide: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # nodes to be cut by the sums of all tasks
    small: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # nodes to be finished by one task

    @classmethod
    def empty(cls, classes: int, depth: int) -> Trees:
        shape = (classes, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape))


def drawn_features(features: int, classes: int, number: int, settings: Settings) -> np.ndarray:
    """Which features each class's tree of a round may cut, at least one."""
    order = np.random.default_rng([settings.seed, number]).permuted(np.tile(np.arange(features), (classes, 1)), axis=1)
    return order < max(1, int(features * settings.feature_share))


def drawn_rows(marks: np.ndarray, number: int, settings: Settings) -> np.ndarray:
    """Which rows a round looks at, told by the hash of each row's features, so that equal rows go together."""
    x = marks.view(np.uint64) + np.uint64((settings.seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)) < np.uint64(int(settings.row_share * 2**53))


def walk(trees: Trees, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row has reached in the tree of each class after ``depth`` steps: [class, row]."""
    rows = np.arange(len(bins))
    at = np.zeros((len(trees.feature), len(bins)), np.int64)
    for k, here in enumerate(at):
        for _ in range(depth):
            feature = trees.feature[k, here]
            here[:] = np.where(feature >= 0, 2 * here + 1 + (bins[rows, feature] > trees.cut[k, here]), here)
    return at


def derivatives(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the softmax loss by each class's margin, in units of 1 / ``SCALE``: [row, class]."""
    p = np.exp(margins - margins.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    first = p.copy()
    first[np.arange(len(labels)), labels] -= 1
    return np.rint(first * SCALE), np.rint(np.maximum(2 * p * (1 - p), 1e-16) * SCALE)


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """At most ``BINS`` values of each feature at equal shares of its rows."""
    shares = [(i + 1) / (BINS + 1) for i in range(BINS)]
    found = rows.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"f{i}") for i, c in enumerate(features)])
    told = found.approxQuantile([f"f{i}" for i in range(len(features))], shares, SKETCH_ERROR)
    return [np.unique(np.array(t, np.float64)) for t in told]


def packed(rows: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray], classes: int) -> DataFrame:
    """The rows in blocks of binned values, labels, hashes and margins (zero at first), made where the rows are; rows without a label are left out."""
    n_features = len(features)
    values = [F.col(f"`{c}`").cast("double") for c in features]
    sent = rows.filter(F.col(f"`{label}`").isNotNull()).select(
        *[v.alias(f"f{i}") for i, v in enumerate(values)], F.col(f"`{label}`").cast("int").alias("label"), F.xxhash64(*values).alias("mark")
    )

    def block(parts):
        table = pa.Table.from_batches(parts)
        columns = [table.column(i).to_numpy().astype(np.float64) for i in range(n_features)]
        n = table.num_rows
        cells = [binned(np.stack(columns, 1), edges).tobytes(), table.column(n_features).to_numpy().astype(np.int32).tobytes(), table.column(n_features + 1).to_numpy().tobytes(), np.zeros((n, classes)).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["n", "bins", "labels", "marks", "margins"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(start, BLOCK_ROWS)
                if held and held + piece.num_rows > BLOCK_ROWS:
                    yield block(parts)
                    parts, held = [], 0
                parts.append(piece)
                held += piece.num_rows
        if held:
            yield block(parts)

    return cut_lineage(sent.mapInArrow(run, _BLOCKS))


def _opened(batch: pa.RecordBatch, i: int, n_features: int, classes: int, pending: Sequence[Trees], depth: int):
    """Block ``i`` of a batch: bins, labels, hashes, and margins with the trees added that came after they were written."""
    n = batch.column(0)[i].as_py()
    bins, labels, marks, margins = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in enumerate((np.uint8, np.int32, np.int64, np.float64), 1))
    bins, margins = bins.reshape(n, n_features), margins.reshape(n, classes).copy()
    for trees in pending:
        at = walk(trees, bins, depth)
        for k in range(classes):
            margins[:, k] += trees.value[k, at[k]]
    return bins, labels, marks, margins


def _level_cuts(blocks: DataFrame, tasks: int, n_features: int, classes: int, pending: list[Trees], growing: Trees, level: int, number: int, settings: Settings) -> list:
    """The best cut of each open node of a level among each task's features."""
    nodes, first = 2**level, 2**level - 1

    def add_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bins, labels, marks, margins = _opened(batch, i, n_features, classes, pending, settings.depth)
                kept = drawn_rows(marks, number, settings)
                bins = bins[kept]
                g, h = derivatives(margins[kept], labels[kept])
                at = walk(growing, bins, level)
                sums: dict[int, list[tuple[np.ndarray, ...]]] = {}
                for k in range(classes):
                    mine = np.flatnonzero(growing.wide[k, at[k]])
                    features = np.flatnonzero(growing.drawn[k])
                    key = ((np.arange(len(features)) * nodes + at[k, mine, None] - first) * 256 + bins[np.ix_(mine, features)]).ravel()
                    size = len(features) * nodes * 256
                    times = np.bincount(key, minlength=size)
                    seen = np.flatnonzero(times)
                    added = [np.bincount(key, np.repeat(x[mine, k], len(features)), size)[seen].astype(np.int64) for x in (g, h)] + [times[seen]]
                    ends = np.searchsorted(seen, np.arange(len(features) + 1) * nodes * 256)
                    for f, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        cells = (seen[a:b] - f * nodes * 256 + k * nodes * 256).astype(np.int32)
                        sums.setdefault(int(features[f]), []).append((cells, *(x[a:b] for x in added)))
                told = {f: [np.concatenate(x).tobytes() for x in zip(*parts, strict=True)] for f, parts in sums.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(told), pa.int32()), *[pa.array([t[c] for t in told.values()], pa.binary()) for c in range(4)]], names=["feature", "cells", "g", "h", "n"]
                )

    def choose(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for feature, *sums in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if feature not in held:
                    held[feature] = np.zeros((3, classes * nodes * 256), np.int64)
                # No cell occurs twice in a row.
                for total, told in zip(held[feature], sums[1:], strict=True):
                    total[np.frombuffer(sums[0], np.int32)] += np.frombuffer(told, np.int64)
        best = _best((f, best_cuts(*held[f].reshape(3, classes, nodes, 256), settings)) for f in sorted(held))
        if best:
            kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.int64()] * 6
            names = ["feature", "class", "node", "cut", "gain", "g_below", "h_below", "n_below", "g", "h", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*best.values(), strict=True), kinds, strict=True)], names=names)

    return blocks.mapInArrow(add_up, _SUMS).repartition(tasks, "feature").mapInArrow(choose, _CUTS).collect()


def _best(cuts: Iterable[tuple[int, list[tuple]]]) -> dict[tuple[int, int], tuple]:
    """(feature, class, node, cut, gain, sums) with the greatest gain for each (class, node), the lowest feature of equal ones. Features come in order."""
    best: dict[tuple[int, int], tuple] = {}
    for feature, found in cuts:
        for cut in found:
            if cut[:2] not in best or cut[3] > best[cut[:2]][4]:
                best[cut[:2]] = (feature, *cut)
    return best


def best_cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, settings: Settings) -> list[tuple]:
    """(class, node, cut, gain, sums below, sums of the node) of one feature's histograms [class, node, bin]; the lowest of equal cuts, -1 where none gains anything."""
    below = [np.cumsum(x, 2) for x in (g, h, n)]
    below_g, below_h, _ = below
    whole = [x[:, :, -1:] for x in below]
    all_g, all_h, _ = whole

    def strength(first, second):
        return (first / SCALE) ** 2 / (second / SCALE + settings.penalty)

    gain = strength(below_g, below_h) + strength(all_g - below_g, all_h - below_h) - strength(all_g, all_h)
    gain[(below_h < settings.least * SCALE) | (all_h - below_h < settings.least * SCALE)] = -np.inf
    cut = gain.argmax(2)
    top = np.take_along_axis(gain, cut[:, :, None], 2)[:, :, 0]
    none = ~(top > 1e-12)
    told = [np.where(none, -1, cut), np.where(none, 0.0, top), *[np.take_along_axis(x, cut[:, :, None], 2)[:, :, 0] for x in below], *[x[:, :, 0] for x in whole]]
    return [(int(k), int(node), *(x[k, node].item() for x in told)) for k, node in np.argwhere(whole[2][:, :, 0] > 0)]


def _place(trees: Trees, k: int, here: int, cut: tuple, settings: Settings) -> None:
    """Cut a node (gain, sums as in ``best_cuts``): it and the leaves it gets. A root without a cut becomes a leaf."""
    feature, where, _, g_below, h_below, n_below, g, h, n = cut
    if where >= 0:
        trees.feature[k, here], trees.cut[k, here], trees.value[k, here] = feature, where, 0.0
        for side, (first, second) in enumerate(((g_below, h_below), (g - g_below, h - h_below))):
            trees.value[k, 2 * here + 1 + side] = -settings.step * (first / SCALE) / (second / SCALE + settings.penalty)
    elif not here:
        trees.value[k, 0] = -settings.step * (g / SCALE) / (h / SCALE + settings.penalty)


def subtree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, drawn: np.ndarray, levels: int, settings: Settings) -> Trees:
    """A tree of one class on the given rows, as deep as ``levels``."""
    made = Trees.empty(1, levels)
    at = np.zeros(len(bins), np.int64)  # the place in the level; -1 in a leaf
    features = np.flatnonzero(drawn).tolist()
    for level in range(levels):
        nodes, first = 2**level, 2**level - 1
        held = np.flatnonzero(at >= 0)

        def sums(f, at=at[held], held=held, nodes=nodes):
            key = at * 256 + bins[held, f]
            return [np.bincount(key, w, nodes * 256).astype(np.int64).reshape(1, nodes, 256) for w in (g[held], h[held], None)]

        best = _best((f, best_cuts(*sums(f), settings)) for f in features)
        for (_, node), (feature, _, _, *cut) in best.items():
            _place(made, 0, first + node, (feature, *cut), settings)
        feature = made.feature[0, first + at[held]]
        at[held] = np.where(feature >= 0, 2 * at[held] + (bins[held, feature] > made.cut[0, first + at[held]]), -1)
    return made


def _with_margins(blocks: DataFrame, n_features: int, classes: int, pending: list[Trees], depth: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            margins = [_opened(batch, i, n_features, classes, pending, depth)[3].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(margins, pa.binary())], names=["n", "bins", "labels", "marks", "margins"])

    return cut_lineage(blocks.mapInArrow(run, _BLOCKS))


def _finish(blocks: DataFrame, n_features: int, classes: int, pending: list[Trees], growing: Trees, number: int, settings: Settings) -> None:
    """Grow what is below the small nodes of all classes; each has at most ``SMALL_ROWS`` rows, which one task gets."""
    groups = int(growing.small.sum())

    def members(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bins, labels, marks, margins = _opened(batch, i, n_features, classes, pending, settings.depth)
                kept = drawn_rows(marks, number, settings)
                bins = bins[kept]
                g, h = derivatives(margins[kept], labels[kept])
                at = walk(growing, bins, settings.depth)
                told = []
                for k in range(classes):
                    for node in np.flatnonzero(growing.small[k]).tolist():
                        mine = np.flatnonzero(at[k] == node)
                        if len(mine):
                            told.append((k, node, bins[mine].tobytes(), g[mine, k].tobytes(), h[mine, k].tobytes()))
                if told:
                    kinds = [pa.int32()] * 2 + [pa.binary()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), kinds, strict=True)], names=["class", "node", "bins", "g", "h"])

    def grow(group):
        k, top = group.column(0)[0].as_py(), group.column(1)[0].as_py()
        bins, g, h = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in ((2, np.uint8), (3, np.float64), (4, np.float64)))
        made = subtree(bins.reshape(-1, n_features), g, h, growing.drawn[k], settings.depth - int(np.log2(top + 1)), settings)
        nodes, feature, cut, value = [], [], [], []
        open_ = [(0, top)]
        while open_:
            own, here = open_.pop()
            f = int(made.feature[0, own])
            if own or f >= 0 or not top:  # a small node that stays a leaf keeps the value it has
                nodes.append(here), feature.append(f), cut.append(int(made.cut[0, own])), value.append(float(made.value[0, own]))
            if f >= 0:
                open_ += [(2 * own + side, 2 * here + side) for side in (1, 2)]
        columns = [pa.array([k] * len(nodes), pa.int32()), *[pa.array(c, pa.int32()) for c in (nodes, feature, cut)], pa.array(value, pa.float64())]
        return pa.Table.from_arrays(columns, names=["class", "node", "feature", "cut", "value"])

    tasks = min(groups, 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    for r in blocks.mapInArrow(members, _MEMBERS).repartition(tasks, "class", "node").groupBy("class", "node").applyInArrow(grow, _PARTS).collect():
        growing.feature[r["class"], r.node], growing.cut[r["class"], r.node], growing.value[r["class"], r.node] = r.feature, r.cut, r.value


def _grown(blocks: DataFrame, rows: int, tasks: int, n_features: int, classes: int, pending: list[Trees], number: int, settings: Settings) -> Trees:
    """One round: a tree for each class."""
    trees = Trees.empty(classes, settings.depth)
    trees.drawn = drawn_features(n_features, classes, number, settings)
    trees.wide, trees.small = np.zeros(trees.feature.shape, bool), np.zeros(trees.feature.shape, bool)
    (trees.small if rows <= SMALL_ROWS else trees.wide)[:, 0] = True
    for level in range(settings.depth):
        if not trees.wide.any():
            break
        found = _level_cuts(blocks, tasks, n_features, classes, pending, trees, level, number, settings)
        by_feature = ((c.feature, [(c["class"], c.node, c.cut, c.gain, c.g_below, c.h_below, c.n_below, c.g, c.h, c.n)]) for c in sorted(found, key=lambda c: c.feature))
        trees.wide[:] = False
        for (k, node), (feature, _, _, *cut) in _best(by_feature).items():
            here = 2**level - 1 + node
            _place(trees, k, here, (feature, *cut), settings)
            if cut[0] >= 0 and level + 1 < settings.depth:
                for side, n in ((1, cut[4]), (2, cut[7] - cut[4])):
                    (trees.small if n <= SMALL_ROWS else trees.wide)[k, 2 * here + side] = True
    if trees.small.any():
        _finish(blocks, n_features, classes, pending, trees, number, settings)
    return trees


def fit(rows: DataFrame, features: Sequence[str], label: str, classes: int, settings: Settings | None = None) -> DataFrame:
    """The model as a written table of nodes: a row goes below if its value is at most the threshold; leaves have feature -1 and a value.

    ``label`` is the class number, below ``classes``. Values that are null or NaN go above every threshold. A table without rows gives equal
    probabilities; rows that occur often count as often.
    """
    settings = settings or Settings()
    features = list(features)
    edges = bin_edges(rows, features)
    blocks = packed(rows, features, label, edges, classes)
    spark = rows.sparkSession
    count, held = blocks.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, min(len(features), count, 4 * spark.sparkContext.defaultParallelism))
    pending: list[Trees] = []
    made: list[tuple] = []
    for number in range(settings.rounds if count else 0):
        if len(pending) == WRITE_EVERY:
            blocks, pending = _with_margins(blocks, len(features), classes, pending, settings.depth), []
        trees = _grown(blocks, held, tasks, len(features), classes, pending, number, settings)
        pending.append(trees)
        for k in range(classes):
            open_ = [0]
            while open_:
                here = open_.pop()
                f = int(trees.feature[k, here])
                made.append((number, k, here, f, float(edges[f][trees.cut[k, here]]) if f >= 0 else None, float(trees.value[k, here])))
                if f >= 0:
                    open_ += [2 * here + 1, 2 * here + 2]
    return cut_lineage(spark.createDataFrame(made, _NODES).coalesce(1))


def score(nodes: DataFrame, rows: DataFrame, features: Sequence[str], classes: int, *keep: str) -> DataFrame:
    """``keep..., shares`` of every row: the softmax of its margins. The node table is bounded by rounds, classes and depth, so it is broadcast."""
    table = nodes.orderBy("round", "class", "node").toArrow()
    number, kind, node, feature = (table.column(n).to_numpy().astype(np.int64) for n in ("round", "class", "node", "feature"))
    deepest = int(np.log2(node.max(initial=0) + 1))
    shape = (int(number.max(initial=-1)) + 1, classes, int(node.max(initial=0)) + 1)
    where = number, kind, node
    grid = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape)
    for target, column in zip(grid, ("feature", "threshold", "value"), strict=True):
        target[where] = feature if column == "feature" else np.nan_to_num(table.column(column).to_numpy())
    sent = rows.sparkSession.sparkContext.broadcast(grid)

    def run(batches):
        feature, threshold, value = sent.value
        for batch in batches:
            n = batch.num_rows
            values = np.stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))], axis=1)
            margins, rows_ = np.zeros((n, classes)), np.arange(n)
            for r in range(feature.shape[0]):
                for k in range(classes):
                    at = np.zeros(n, np.int64)
                    for _ in range(deepest):
                        f = feature[r, k, at]
                        at = np.where(f >= 0, 2 * at + 1 + ~(values[rows_, f] <= threshold[r, k, at]), at)
                    margins[:, k] += value[r, k, at]
            shares = np.exp(margins - margins.max(1, keepdims=True))
            shares /= shares.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(list(shares), pa.list_(pa.float64()))], names=[*keep, "shares"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    chosen = rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("double").alias(f"__f{i}") for i, c in enumerate(features)])
    return chosen.mapInArrow(run, f"{kinds}{', ' if keep else ''}shares array<double>")
