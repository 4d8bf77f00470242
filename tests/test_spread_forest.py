"""Forests on spread rows: any number of nodes cut by all tasks, any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import forest, spread_forest


def flows(spark, n=3000):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 500, n), rng.integers(0, 40, n), rng.integers(0, 2, n)
    y = ((a > 250) ^ (b > 20)).astype(int)
    return spark.createDataFrame([(float(i), float(j), float(k), int(v)) for i, j, k, v in zip(a, b, c, y)], "a DOUBLE, b DOUBLE, c DOUBLE, y INT")


def same(one, other):
    return all(np.array_equal(x, y) for t, u in zip(one.trees, other.trees, strict=True) for x, y in zip(t, u, strict=True))


def test_wide_and_small_nodes(spark, monkeypatch):
    rows = flows(spark)
    train, test = rows.filter("a % 5 > 0"), rows.filter("a % 5 = 0")
    for small, moved in ((1 << 18, 1 << 30), (150, 1 << 30), (0, 5_000)):
        monkeypatch.setattr(spread_forest, "SMALL_ROWS", small)
        monkeypatch.setattr(spread_forest, "MOST_MOVED", moved)
        made = spread_forest.fit(train, ["a", "b", "c"], "y", 8, 10)
        again = spread_forest.fit(train.repartition(5), ["a", "b", "c"], "y", 8, 10)
        assert same(made, again)
        assert max(depth_of(t) for t in made.trees) <= 10
        told = spread_forest.score(made, test, ["a", "b", "c"], "y").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("right"), F.min("p"), F.max("p")).first()
        assert told["n"] == test.count() and told["right"] > 0.9 and told[2] >= 0 and told[3] <= 1


def depth_of(tree):
    feature, _, below, _ = tree
    level, deepest = [0], 0
    while level := [x for node in level if feature[node] >= 0 for x in (below[node], below[node] + 1)]:
        deepest += 1
    return deepest


def test_cuts_are_those_of_the_sorted_way():
    rng = np.random.default_rng(1)
    at, values, labels = rng.integers(0, 4, 400), rng.integers(0, 9, 400), rng.integers(0, 2, 400)
    values[at == 2] = 5
    weights = np.array([0.7, 1.9])
    counts = np.bincount((at * 256 + values) * 2 + labels, minlength=4 * 256 * 2).reshape(4, 256, 2)
    score, cut = spread_forest.cuts_of(counts, weights)
    wanted, where = forest.best_cuts(at, values, labels, weights[labels], counts.sum(1) * weights)
    assert score == pytest.approx(wanted)
    assert np.array_equal(cut[wanted > -np.inf], where[wanted > -np.inf])


def test_one_class_and_nothing_to_cut(spark):
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a DOUBLE, y INT")
    assert {r["p"] for r in spread_forest.score(spread_forest.fit(one, ["a"], "y", 3, 5), one, ["a"], "y").collect()} == {1.0}
    flat = spark.createDataFrame([(1.0, 0), (1.0, 1)] * 50, "a DOUBLE, y INT")
    assert {r["predicted"] for r in spread_forest.score(spread_forest.fit(flat, ["a"], "y", 3, 5), flat, ["a"], "y").collect()} <= {0, 1}


def test_draws_are_those_of_a_poisson():
    times = spread_forest.drawn_times(np.arange(200_000) * 7919, 3, 42)
    assert np.bincount(times, minlength=3)[:3] / len(times) == pytest.approx([0.3679, 0.3679, 0.1839], abs=0.005)


def test_trees_do_not_depend_on_how_many_are_counted_at_once(spark, monkeypatch):
    """All trees shared one job for each cut only if all of their rows could be moved at once."""
    rows = flows(spark, 1500)
    monkeypatch.setattr(spread_forest, "SMALL_ROWS", 100)
    made = spread_forest.fit(rows, ["a", "b", "c"], "y", 5, 6)
    groups = []
    in_groups = spread_forest._in_groups
    monkeypatch.setattr(spread_forest, "_in_groups", lambda *args: groups.append(list(in_groups(*args))) or groups[-1])
    monkeypatch.setattr(spread_forest, "MOST_MOVED", 1)
    assert same(made, spread_forest.fit(rows, ["a", "b", "c"], "y", 5, 6))
    assert all(len(g) == 1 for g in groups)
    monkeypatch.setattr(spread_forest, "MOST_CELLS", 1)
    assert same(made, spread_forest.fit(rows, ["a", "b", "c"], "y", 5, 6))
    assert groups[-1] and all(len(g) == 1 for g in groups[-1]) and max(map(len, groups)) == 5


def test_draws_are_those_of_uniform_numbers():
    marks = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 300_000)
    x = marks.view(np.uint64) + np.uint64((42 * 1_000_003 + 8) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    uniform = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    before = marks.copy()
    assert np.array_equal(spread_forest.drawn_times(marks, 7, 42), np.searchsorted(spread_forest._TIMES, uniform, "right"))
    assert np.array_equal(marks, before)


@pytest.mark.parametrize("features", [3, 9])
def test_rows_sorted_as_numbers(features):
    """Nine features of a byte don't fit a number."""
    rng = np.random.default_rng(features)
    bins, labels, times = rng.integers(0, 256, (500, features)).astype(np.uint8), rng.integers(0, 3, 500).astype(np.uint8), rng.integers(1, 9, 500).astype(np.uint8)
    bins[:200] = bins[200:400]
    order = np.lexsort((times, labels, *bins.T))
    for got, wanted in zip(spread_forest._sorted_rows(bins, labels, times), (bins, labels, times), strict=True):
        assert np.array_equal(got, wanted[order])


@pytest.mark.parametrize("nodes", [1, 256, 257, 70_000])
def test_order_by_node_and_value(nodes):
    rng = np.random.default_rng(nodes)
    at, values = rng.integers(0, nodes, 5_000), rng.integers(0, 256, 5_000).astype(np.uint8)
    order, key = forest._in_order(at, values, nodes)
    assert np.array_equal(order, np.argsort(at * 256 + values, kind="stable"))
    assert np.array_equal(key, (at * 256 + values)[order])
