"""Rows down many trees at once: the same leaves as by single steps."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from duskwatch.operators import descent, isolation


def grown(rng, features, deepest, numbers):
    """A tree of thresholds, nodes numbered in no order: feature, threshold, below, above."""
    nodes = []

    def add(depth):
        at = len(nodes)
        nodes.append([-1, np.nan, -1, -1])
        if depth < deepest and rng.random() < 0.8:
            sides = [add(depth + 1), add(depth + 1)]
            order = (0, 1) if rng.random() < 0.5 else (1, 0)
            nodes[at] = [int(rng.integers(0, features)), float(rng.choice(numbers)), sides[order[0]], sides[order[1]]]
        return at

    add(0)
    return tuple(np.array(x) for x in zip(*nodes, strict=True))


def single_steps(feature, threshold, below, above, row, head):
    at = head
    while feature[at] >= 0:
        at = below[at] if row[feature[at]] <= threshold[at] else above[at]
    return at


@pytest.mark.parametrize("numbers", [np.arange(0, 40, 0.5), np.linspace(-3, 3, 70_000)])
def test_leaves_are_those_of_single_steps(numbers):
    """Trees of any depth, one of a single leaf, few and many thresholds, missing and infinite values."""
    rng = np.random.default_rng(5)
    made = [grown(rng, 4, deepest, numbers) for deepest in (0, 1, 3, 5, 9, 14)]
    heads = np.concatenate([[0], np.cumsum([len(t[0]) for t in made])])[:-1]
    feature, threshold, below, above = (np.concatenate([t[c] + (h if c > 1 else 0) for t, h in zip(made, heads, strict=True)]) for c in range(4))
    values = rng.choice(numbers, (400, 4))
    values[::9, 1], values[::11, 2], values[::13, 3] = np.nan, np.inf, -np.inf
    down = descent.Descent.of(feature, threshold, below, above, heads.tolist(), 4)
    ranks = down.ranks(values)
    for tree, nodes, head in zip(down.trees, down.by_tree(np.arange(len(feature))), heads, strict=True):
        assert nodes[tree.leaves(ranks)].tolist() == [single_steps(feature, threshold, below, above, row, head) for row in values]
        assert len(tree.leaves(down.ranks(values[:0]))) == 0


def test_chunks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(descent, "CHUNK", 25)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 10))], names=["x"]) for a in range(0, 70, 10)]
    told = list(descent.in_chunks(batches))
    assert [b.num_rows for b in told] == [30, 30, 10]
    assert [x for b in told for x in b.column(0).to_pylist()] == list(range(70))


def test_normality_is_that_of_steps_of_whole_columns():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3_000, 14))
    names = [f"f{i}" for i in range(14)]
    grow = isolation._grow(names, 1)
    nodes = pd.concat([grow(pd.DataFrame(data[rng.integers(0, len(data), 256)], columns=names).assign(tree=t)) for t in range(20)], ignore_index=True)
    start = nodes.groupby("tree").cumcount().to_numpy()
    base = np.arange(len(nodes)) - start
    feature, threshold, below, above, depth = (nodes[c].to_numpy() for c in ("feature", "threshold", "below", "above", "depth"))
    below, above, roots, rows = below + base, above + base, np.flatnonzero(start == 0), np.arange(len(data))
    total = np.zeros(len(data))
    for root in roots:
        at = np.full(len(data), root)
        while (inner := feature[at] >= 0).any():
            at = np.where(inner, np.where(data[rows, feature[at]] <= threshold[at], below[at], above[at]), at)
        total += depth[at]
    down = descent.Descent.of(feature, threshold, below, above, roots.tolist(), 14)
    assert np.array_equal(isolation._normality(down, down.by_tree(depth), 10.0, data), -np.exp2(-total / (len(roots) * 10.0)))
