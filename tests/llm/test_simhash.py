import os
import random
import re
import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

from duskwatch.llm import simhash as S  # noqa: E402
from duskwatch.llm.components import components  # noqa: E402


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def grouped(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def crowd(seed=0, centres=40, around=12, flips=6):
    rng = np.random.default_rng(seed)
    found = []
    for centre in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(around):
            x = centre
            for bit in rng.integers(0, 64, rng.integers(0, flips)):
                x ^= np.uint64(1) << np.uint64(bit)
            found.append(x)
    return np.unique(np.array(found, np.uint64))


def close_pairs(fps, radius):
    return {(i, i + 1 + int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)}


def test_fingerprint():
    rng = random.Random(2)
    for text in ["", " \t\n", "One", "One TWO", "a b c", "ÄÖ x y z\x1cw é"] + ["".join(rng.choice("abAB é\n\t") for _ in range(200)) for _ in range(30)]:
        for width in (3, 5):
            assert S.fingerprint(text.encode(), width) == plain_fingerprint(text, width)


@pytest.mark.parametrize("radius", [1, 2, 5, 8])
@pytest.mark.parametrize("parts", [None, 2, 4])
def test_every_close_pair_is_met(radius, parts, monkeypatch):
    if parts and parts > radius + 1:
        pytest.skip("a partition would never be probed")
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 3000)
    fps = crowd()
    plan = S.ProbePlan(fps[:200], len(fps) * 500, radius, parts)
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    units, _ = plan.allocate(fps)
    assert (units.sum(1) == radius + 1).all()
    if parts == 2 and radius > 5:
        fps = fps[:150]
    keys, whose, roles = plan.keys(fps)
    order = np.argsort(keys, kind="stable")
    met = set()
    for a, b, far in S._verified(keys[order], fps[whose[order]], roles[order], radius):
        x, y = np.searchsorted(fps, a), np.searchsorted(fps, b)
        met |= {(int(min(p)), int(max(p))) for p in zip(x, y, strict=True)}
        use = S.forest(a, b, far)
        assert grouped(len(fps), zip(x, y, strict=True)) == grouped(len(fps), zip(x[use], y[use], strict=True))
    assert met == close_pairs(fps, radius)


@pytest.mark.parametrize(("radius", "run_rows"), [(2, 2_000_000), (2, 3), (6, 50)])
def test_links_connect_what_brute_force_does(spark, radius, run_rows):
    fps = crowd(seed=3, centres=25, around=20)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = S.links(df, radius, run_rows=run_rows).collect()
    spot = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = [(spot[r.a], spot[r.b]) for r in found]
    true = close_pairs(fps, radius)
    assert {(min(p), max(p)) for p in pairs} <= true
    assert grouped(len(fps), pairs) == grouped(len(fps), true)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100)] + [(200 + i, 200) for i in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(90)] + [(7, 7), (None, 3), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = grouped(401, real)
    assert got == {n: want[n] for e in real for n in e}
    assert components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").count() == 0


def test_groups(spark):
    rows = edge_rows.rows() + [(30 + i, edge_rows.rows()[3][1] + f" {i}", "en", "a", 1) for i in range(4)]
    df = spark.createDataFrame(rows, edge_rows.SCHEMA).withColumnRenamed("n_chars", "fp")
    got = sorted([tuple(r) for r in S.near_duplicates(df).collect()], key=str)
    fps = np.array([plain_fingerprint(t or "") for _, t, *_ in rows], np.uint64)
    root = grouped(len(rows), close_pairs(fps, 2))
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    assert got == sorted([(rows[i][0], f"{int(fps[i]):016x}", least[root[i]]) for i in range(len(rows))], key=str)
    assert S.near_duplicates(edge_rows.no_documents(spark)).count() == 0


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = np.array([S.fingerprint((r.text or "").encode()) for r in rows], np.uint64)
    root = grouped(len(rows), close_pairs(fps, 2))
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r.doc_id), r.doc_id)
    assert {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()} == {r.doc_id: least[root[i]] for i, r in enumerate(rows)}


def near_copies(rng, groups, copies, edits):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for group in range(groups):
        base = [rng.choice(words) for _ in range(400)]
        for copy in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(400)] = rng.choice(words)
            rows.append((group * 1000 + rng.randrange(1000) * 10_000 + copy, " ".join(text), "en", "a", 1))
    return rows + [(5_000_000_000 + i, " ".join(rng.choice(words) for _ in range(200)), "en", "a", 1) for i in range(40)]


@pytest.mark.parametrize("partitions", [1, 200])
def test_documents_that_stay(spark, partitions):
    rows = near_copies(random.Random(11), 3, 150, 4)
    docs = spark.createDataFrame(rows, edge_rows.SCHEMA).repartition(5)
    fps = np.array([plain_fingerprint(t) for _, t, *_ in rows], np.uint64)
    root = grouped(len(rows), close_pairs(fps, S.RADIUS))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        stay = sorted(r.doc_id for r in S.drop_near_duplicates(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert stay == sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))
    assert 40 < len(stay) < len(rows) / 2


def test_documents_that_stay_at_the_edges(spark):
    docs = edge_rows.documents(spark)
    got = S.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted([r.doc_id for r in got.collect()], key=str)
    # Texts without words are one group; equal texts are one group; the rest differ.
    assert kept == sorted([1, None, 3, 4, 6, 7, 9, 10], key=str)
    assert S.drop_near_duplicates(edge_rows.no_documents(spark)).count() == 0
