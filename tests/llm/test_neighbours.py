import numpy as np
import pytest

from duskwatch.llm import neighbours as N


def exact(ids, v, queries, k):
    found = {}
    for q in queries:
        at = [i for i, x in enumerate(ids) if x == q][0]
        scores = [(-(float((v[at] * v[i]).sum())), ids[i]) for i in range(len(ids)) if ids[i] != q]
        found[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return found


@pytest.mark.parametrize("settings", [{}, {"block": 64}, {"depth": 2, "visits": 6}])
def test_recall_on_given_vectors(spark, sf_dir, settings):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    queries = [i for i in ids if i % 20 == 0]
    want = exact(ids, v, queries, 20)
    got = N.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, **settings).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(queries)
    hits = 0
    score = {q: dict(exact_all) for q, exact_all in ((q, exact(ids, v, [q], len(ids))[q]) for q in queries)}
    for q, found in by.items():
        assert [r.rank for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert all(abs(r.score - score[q][r.vec_id]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(queries)) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    rows += [(100 + i, [2.0, 2.0]) for i in range(60)] + [(40 + i, [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS tree", "2 AS leaf", "3 AS score", "4 AS id").repartition(3)
    got = N.nearest(df, df.filter("vec_id % 20 = 0"), 20, sample=40).collect()
    fine = {i: v for i, v in rows if i is not None and v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(fine)
    want = exact(ids, np.array([fine[i] for i in ids]), [i for i in ids if i % 20 == 0], 20)
    assert {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == want
    assert len(got) == 20 * len(want)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in N.nearest(few, few.filter("vec_id = 0"), 20).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]
    none = few.filter("vec_id > 9")
    assert N.nearest(none, none).count() == 0 and N.nearest(few, none).count() == 0


def test_a_query_that_finds_too_few_searches_on(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = N.nearest(df, df.filter("vec_id % 50 = 0"), 150, visits=1).collect()
    want = exact(list(range(200)), v, [0, 50, 100, 150], 150)
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == {q: [i for i, _ in w] for q, w in want.items()}
