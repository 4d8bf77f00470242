import hashlib
import os
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

from duskwatch.llm import mixing as M  # noqa: E402


def shared_out(sizes, weights=(5, 2, 1), budget=1.5, repeats=2):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = budget * sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: repeats * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        more = {s for s in names if s not in full and target[s] > repeats * sizes[s]}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "é", "Z", None, "zz", "0"][: 2 + seed]), rng.choice([0, 1, 5, 100, 4000])) for _ in range(40)]
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    got = {r.source: (r.source_size, r.target) for r in M.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    assert {s: v[0] for s, v in got.items()} == dict(sizes)
    for s, t in shared_out(sizes).items():
        assert got[s][1] == pytest.approx(t, rel=1e-9, abs=1e-6)


def test_mix_of_many(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", (i * 37) % 90) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    first = {r.doc_id: r for r in M.mix(df.repartition(5)).collect()}
    again = {r.doc_id: r for r in M.mix(df.repartition(2)).collect()}
    assert first == again and len(first) == len(rows)
    taken, target = defaultdict(int), {}
    for i, s, n in rows:
        r = first[i]
        assert r.size == n and r.taken in (0, n, 2 * n) and r.taken == r.copies * n
        taken[s] += r.taken
        target[s] = r.target
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    assert {s: pytest.approx(t) for s, t in shared_out(sizes).items()} == target
    assert all(abs(taken[s] - target[s]) <= 90 for s in target)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 90


def test_the_queue_by_brute_force(spark):
    rows = [(i, "ab"[i % 2], 1 + i % 5) for i in range(60)]
    target = shared_out(Counter({s: sum(n for _, t, n in rows if t == s) for s in "ab"}))
    turns = []
    for s in "ab":
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(f"{M.SEED}:{r[0]}".encode()).hexdigest(), r[0]))
        total, served = sum(r[2] for r in own), 0
        for copy in (0, 1):
            for i, _, n in own:
                served += n
                turns.append(((served - n / 2) / target[s], s, copy, i, n))
        assert served == 2 * total
    left, wanted = 1.5 * sum(r[2] for r in rows), Counter()
    for _, _, _, i, n in sorted(turns):
        if left < n / 2:
            break
        left -= n
        wanted[i] += n
    got = {r.doc_id: r.taken for r in M.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")).collect() if r.taken}
    assert got == dict(wanted)


def test_words_and_edges(spark):
    got = M.sized(edge_rows.documents(spark), digest=True).collect()
    assert sorted([(r.doc_id, r.source, r.size, r.text_sha256) for r in got], key=str) == sorted(
        [(i, s, len((t or "").encode().split()), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, s, _ in edge_rows.rows()], key=str
    )
    mixed = M.mix(M.sized(edge_rows.documents(spark))).collect()
    assert len(mixed) == len(edge_rows.rows()) and all(r.taken <= 2 * r.size for r in mixed)
    assert M.mix(M.sized(edge_rows.no_documents(spark))).count() == 0
    blank = spark.createDataFrame([(1, None, 0), (2, "a", 0), (3, None, None)], "doc_id bigint, source string, size bigint")
    assert [(r.taken, r.target) for r in M.mix(blank).collect()] == [(0, 0.0)] * 3


def test_documents_of_the_mix(spark):
    docs = edge_rows.documents(spark)
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns
    wanted = Counter()
    for r in M.mix(M.sized(docs, digest=True)).collect():
        wanted[(r.doc_id, r.source, r.text_sha256)] += r.copies
    found = Counter((r.doc_id, r.source, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect())
    assert found == +wanted
    assert M.mixed_documents(edge_rows.no_documents(spark)).count() == 0
