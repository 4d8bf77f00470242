"""Softmax boosting over blocks against a booster written row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import boosting
from duskwatch.operators.boosting import SCALE, Settings
from duskwatch.operators.forest import binned

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-20, 20, (2, 300)) / 4
    c = rng.integers(0, 3, 300)
    data = [(float(x), float(y), None if z == 0 and x > 4 else float(z), int((x * y > 0) + (z == 2))) for x, y, z in zip(a, b, c)]
    return spark.createDataFrame(data + data[:40], "a DOUBLE, b DOUBLE, c DOUBLE, Label INT")


def plain_tree(bins, g, h, features, settings, depth, tree, at=0):
    """Grown node by node, every cut tried; ``tree`` gets (node, feature, cut) or (node, value)."""
    best = None
    if depth:
        whole = (g.sum() / SCALE) ** 2 / (h.sum() / SCALE + settings.penalty)
        for f in features:
            for cut in range(256):
                low = bins[:, f] <= cut
                sides = [(g[s].sum() / SCALE, h[s].sum() / SCALE) for s in (low, ~low)]
                if min(s[1] for s in sides) < settings.least:
                    continue
                gain = sum(x**2 / (y + settings.penalty) for x, y in sides) - whole
                if gain > 1e-12 and (best is None or gain > best[0]):
                    best = (gain, f, cut)
    if best is None:
        tree[at] = (-1, None, -settings.step * (g.sum() / SCALE) / (h.sum() / SCALE + settings.penalty))
        return
    tree[at] = (best[1], best[2], 0.0)
    low = bins[:, best[1]] <= best[2]
    for side, keep in enumerate((low, ~low)):
        plain_tree(bins[keep], g[keep], h[keep], features, settings, depth - 1, tree, 2 * at + 1 + side)


def plain_model(bins, labels, marks, classes, settings):
    margins, model = np.zeros((len(labels), classes)), []
    for number in range(settings.rounds):
        p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
        g, h = p - np.eye(classes)[labels], 2 * p * (1 - p)
        kept = boosting.drawn_rows(marks, number, settings)
        drawn = boosting.drawn_features(bins.shape[1], classes, number, settings)
        for k in range(classes):
            tree: dict = {}
            plain_tree(bins[kept], np.rint(g[kept, k] * SCALE), np.rint(h[kept, k] * SCALE), np.flatnonzero(drawn[k]), settings, settings.depth, tree)
            model.append(tree)
            for i, row in enumerate(bins):
                at = 0
                while tree[at][0] >= 0:
                    at = 2 * at + 1 + int(row[tree[at][0]] > tree[at][1])
                margins[i, k] += tree[at][2]
    return model, np.exp(margins) / np.exp(margins).sum(1, keepdims=True)


def arrays(rows):
    table = rows.select(*FEATURES, "Label", F.xxhash64(*FEATURES).alias("mark")).toPandas()
    edges = boosting.bin_edges(rows, FEATURES)
    return edges, binned(table[FEATURES].to_numpy(float), edges), table["Label"].to_numpy(), table["mark"].to_numpy()


@pytest.mark.parametrize(("share", "small"), [(1.0, 65_536), (0.7, 100), (0.7, 0)])
def test_equal_to_plain_boosting(spark, rows, monkeypatch, share, small):
    """Whole trees in one task, large nodes by sums and small ones in one task, and all by sums."""
    monkeypatch.setattr(boosting, "SMALL_ROWS", small)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    settings = Settings(rounds=5, depth=3, step=0.5, row_share=share, feature_share=share)
    nodes = boosting.fit(rows.repartition(3), FEATURES, "Label", 3, settings)
    edges, bins, labels, marks = arrays(rows)
    model, shares = plain_model(bins, labels, marks, 3, settings)
    got = {(r["round"], r["class"], r["node"]): r for r in nodes.collect()}
    assert len(got) == sum(map(len, model))
    for i, tree in enumerate(model):
        for node, (feature, cut, value) in tree.items():
            r = got[divmod(i, 3) + (node,)]
            assert r.feature == feature and r.value == pytest.approx(value)
            assert feature < 0 or r.threshold == edges[feature][cut]
    scored = boosting.score(nodes, rows.withColumn("mark", F.xxhash64(*FEATURES)), FEATURES, 3, "mark").collect()
    told = dict(zip(marks.tolist(), shares))
    assert len(scored) == 340 and all(np.allclose(r.shares, told[r.mark]) for r in scored)
    assert (shares.argmax(1) == labels).mean() > 0.9


def test_trees_do_not_depend_on_partitions(rows):
    settings = Settings(rounds=3, depth=3)
    one, many = (boosting.fit(rows.repartition(n), FEATURES, "Label", 3, settings).orderBy("round", "class", "node").collect() for n in (1, 7))
    assert one == many


def test_no_rows_one_class_and_missing_values(spark, rows):
    settings = Settings(rounds=2, depth=2)
    none = boosting.fit(rows.limit(0), FEATURES, "Label", 3, settings)
    assert none.count() == 0
    told = boosting.score(none, rows.limit(2), FEATURES, 3).collect()
    assert all(r.shares == pytest.approx([1 / 3] * 3) for r in told)
    alone = spark.createDataFrame([(None, float("nan"), 1.0, 1)] * 30 + [(1.0, 2.0, None, None)], rows.schema)
    nodes = boosting.fit(alone, FEATURES, "Label", 2, settings)
    assert {(r["class"], r["feature"]) for r in nodes.collect()} == {(0, -1), (1, -1)}  # one leaf each
    shares = boosting.score(nodes, alone, FEATURES, 2).collect()
    assert len(shares) == 31 and all(r.shares[1] > 0.5 for r in shares)
