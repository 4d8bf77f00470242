"""Forests grown level by level against trees grown node by node."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import forest, models


def gini_gain(left, right):
    return sum((side**2).sum() / side.sum() for side in (left, right))


def plain_cut(values, labels, weights, classes):
    """The best cut of one node, by trying all."""
    best = (-np.inf, None)
    for cut in np.unique(values)[:-1]:
        left = np.bincount(labels[values <= cut], weights[values <= cut], classes)
        right = np.bincount(labels[values > cut], weights[values > cut], classes)
        gain = gini_gain(left, right)
        if gain > best[0]:
            best = (gain, cut)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_cuts_of_a_level(seed):
    rng = np.random.default_rng(seed)
    n, nodes, classes = 300, 7, 3
    at, values, labels = rng.integers(0, nodes, n), rng.integers(0, 12, n), rng.integers(0, classes, n)
    values[at == 3] = 5
    weights = rng.integers(1, 4, n).astype(float)
    totals = np.bincount(at * classes + labels, weights, nodes * classes).reshape(nodes, classes)
    score, cut = forest.best_cuts(at, values, labels, weights, totals)
    for node in range(nodes):
        own = at == node
        gain, where = plain_cut(values[own], labels[own], weights[own], classes)
        assert score[node] == pytest.approx(gain)
        if where is not None:
            assert cut[node] == where


def plain_tree(bins, labels, weights, classes):
    """Grown node by node, all features looked at; the partition of the rows."""
    totals = np.bincount(labels, weights, classes)
    if (totals > 0).sum() <= 1:
        return [tuple(np.round(totals / totals.sum(), 9))]
    found = [plain_cut(bins[:, f], labels, weights, classes) for f in range(bins.shape[1])]
    best = max(range(len(found)), key=lambda f: found[f][0])
    if found[best][1] is None:
        return [tuple(np.round(totals / totals.sum(), 9))]
    low = bins[:, best] <= found[best][1]
    return plain_tree(bins[low], labels[low], weights[low], classes) + plain_tree(bins[~low], labels[~low], weights[~low], classes)


def test_a_whole_tree():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 200, (250, 1)).astype(np.uint8)
    labels, weights = rng.integers(0, 3, 250), rng.integers(1, 3, 250).astype(float)
    tree = forest.grow_tree(bins, labels, weights, 3, np.random.default_rng(1), drawn=1)
    leaves = [tuple(np.round(s, 9)) for f, s in zip(tree.feature, tree.shares) if f < 0]
    assert sorted(leaves) == sorted(plain_tree(bins, labels, weights, 3))
    shares = forest.walk(tree, bins)
    for value in np.unique(bins):
        own = bins[:, 0] == value
        mix = np.bincount(labels[own], weights[own], 3)
        assert np.allclose(shares[own], mix / mix.sum())  # no depth limit: a leaf for each value, or its label alone


def test_bins():
    assert forest.bin_edges(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    values = np.random.default_rng(2).normal(size=5000)
    edges = forest.bin_edges(values)
    assert len(edges) == forest.BINS - 1 and np.bincount(np.searchsorted(edges, values)).max() <= 2 * 5000 / forest.BINS
    assert forest.binned(np.array([[1.0], [1.5], [1.6]]), [np.array([1.5])]).ravel().tolist() == [0, 0, 1]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(float(a), float(b), int((a * b > 0) + (a > 1))) for a, b in rng.normal(size=(600, 2))]
    return spark.createDataFrame(data, "a DOUBLE, b DOUBLE, Label INT")


def test_stored_nodes_score_as_the_trees_do(spark, rows):
    nodes = forest.fit(rows, ["a", "b"], "Label", trees=7)
    table = forest.load_table(rows, ["a", "b"], "Label")
    told = sum(forest.walk(forest._tree_of(table, table.row, t, -1, forest.SEED), table.bins) for t in range(7)) / 7
    keyed = rows.withColumn("k", F.xxhash64("a", "b"))
    got = {r.k: r.shares for r in forest.score(nodes, keyed, ["a", "b"], "k").collect()}
    order = [r.k for r in keyed.orderBy(F.xxhash64("a", "b"), "a", "b", "Label").collect()]
    assert np.allclose([got[k] for k in order], told)
    assert (np.argmax(told, 1) == table.labels).mean() > 0.97
    predicted = models.predict_deep(nodes, rows, ["a", "b"], "Label").collect()
    assert all(abs(sum(r[3:]) - 1) < 1e-9 and r[r.prediction_number + 3] == max(r[3:]) for r in predicted)


def test_folds_are_scored_by_the_others(spark, rows):
    placed = rows.withColumn("fold", F.pmod(F.xxhash64("a"), F.lit(3)).cast("int"))
    table = forest.load_table(placed, ["a", "b"], "Label", "fold")
    got = {(r.fold, r.row): (r.label, r.shares) for r in forest.out_of_fold(placed.repartition(5), ["a", "b"], "Label", "fold", 3, 4).collect()}
    assert len(got) == 600
    for fold in range(3):
        trees = [forest._tree_of(table, np.flatnonzero(table.fold != fold), t, fold, forest.SEED) for t in range(4)]
        own = np.flatnonzero(table.fold == fold)
        told = sum(forest.walk(t, table.bins[own]) for t in trees) / 4
        assert np.allclose([got[fold, int(i)][1] for i in own], told)
        assert [got[fold, int(i)][0] for i in own] == table.labels[own].tolist()


def test_a_table_that_is_not_capped_is_refused(rows, monkeypatch):
    monkeypatch.setattr(forest, "MOST_ROWS", 100)
    with pytest.raises(ValueError, match="training table"):
        forest.load_table(rows, ["a", "b"], "Label")


def test_scoring_uses_all_cores(spark):
    """The rows of a file with one row group were scored by one task."""
    rows = spark.range(200).selectExpr("id", "double(id % 50) AS a", "double(id % 7) AS b", "int(id % 50 > 20) AS y").coalesce(1)
    scored = forest.score(forest.fit(rows, ["a", "b"], "y", 5), rows, ["a", "b"], "id", "a")
    assert scored.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in scored.collect()) == list(range(200))


def test_walks_of_stored_nodes_end_in_the_leaves_of_single_steps():
    """Also for rows in a leaf long before others, and values above every threshold."""
    rng = np.random.default_rng(3)
    bins, labels = rng.integers(0, 250, (3_000, 3)).astype(np.uint8), rng.integers(0, 3, 3_000)
    tree = forest.grow_tree(bins, labels, np.ones(3_000), 3, np.random.default_rng(1))
    head = 5  # nodes of another tree come first
    feature = np.append(np.full(head, -1), tree.feature)
    threshold = np.append(np.full(head, np.nan), np.where(tree.feature >= 0, tree.cut.astype(float), np.nan))
    below, above = (np.append(np.full(head, -1), x + head) for x in (tree.below, tree.above))
    values = rng.integers(0, 250, (900, 3)).astype(float)
    values[::50, rng.integers(0, 3)] = np.inf
    got = forest.Walks.of(feature, threshold, below, above).leaves(values, head)
    for row, leaf in zip(values, got, strict=True):
        at = head
        while feature[at] >= 0:
            at = below[at] if row[feature[at]] <= threshold[at] else above[at]
        assert at == leaf
    assert len(forest.Walks.of(feature, threshold, below, above).leaves(values[:0], head)) == 0
    with pytest.raises(ValueError, match="children"):
        forest.Walks.of(feature, threshold, above, below)


def test_missing_values_go_above(spark):
    rows = spark.range(300).selectExpr("double(id % 10) AS a", "double(id % 3) AS b", "int(id % 10 > 5) AS y")
    nodes = forest.fit(rows, ["a", "b"], "y", 5)
    asked = spark.sql("SELECT 1 AS k, double('NaN') AS a, double('NaN') AS b UNION ALL SELECT 2, null, null UNION ALL SELECT 3, double('Infinity'), double('Infinity')")
    assert len({tuple(r.shares) for r in forest.score(nodes, asked, ["a", "b"], "k").collect()}) == 1
