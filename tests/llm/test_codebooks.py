import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm import codebooks as C
from duskwatch.llm.common import join_by_key

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def expected(rows, parts=8, entries=16, rounds=6):
    """All distances of all rounds, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = {}
    for i, (_, v, _) in enumerate(kept):
        whole.setdefault(len(v), []).append((i, [max(-int(C.LARGEST), min(int(C.LARGEST), math.floor(x * 4096))) for x in v]))
    codes, errors, shas = [""] * len(kept), [0] * len(kept), [""] * len(kept)
    for length, own in whole.items():
        edges = [length * p // parts for p in range(parts + 1)]
        first = sorted(own, key=lambda o: (kept[o[0]][0] is None, kept[o[0]][0] or 0, kept[o[0]][1]))[:entries]
        books = [[o[1][a:b] for o in first] for a, b in zip(edges, edges[1:], strict=False)]

        def nearest(part, book):
            return min((sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

        for r in range(rounds + 1):
            found = [[nearest(v[a:b], book) for a, b, book in zip(edges, edges[1:], books, strict=False)] for _, v in own]
            if r == rounds:
                break
            for p, book in enumerate(books):
                members = defaultdict(list)
                for (_, v), f in zip(own, found, strict=True):
                    members[f[p][1]].append(v[edges[p] : edges[p + 1]])
                for e, m in members.items():
                    book[e] = [sum(column) // len(m) for column in zip(*m, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
        for (i, _), f in zip(own, found, strict=True):
            codes[i], errors[i], shas[i] = "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), sha
    by_label = Counter()
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    return sorted([(r[0], c, min(e, C.LONG_MAX), min(by_label[r[2]], C.LONG_MAX), s) for r, c, e, s in zip(kept, codes, errors, shas, strict=True)], key=str)


def rows_of(seed, n, length):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(length)], rng.choice((0, 1, 1, 1, None))) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("seed,n,length", [(1, 120, 64), (2, 9, 16), (3, 60, 11), (4, 40, 3)])
def test_codes(spark, seed, n, length):
    rows = rows_of(seed, n, length)
    got = C.compress(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(rows)


def test_edges(spark):
    rows = rows_of(5, 30, 8)
    rows += [(1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [float("nan")] * 8, 0), (4, [float("inf")] * 8, 0), (5, [], 2), (None, [0.25] * 8, None), (7, [0.5] * 8, 1), (7, [0.5] * 8, 1), (7, [-0.5] * 8, 1)]
    rows += [(1000 + i, [0.125 * i] * 5, 3) for i in range(4)] + [(2000, [1e30, -1e30] * 4, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("code", "error", "length", "vector", "rows", "total", "__key"):
        df = df.withColumn(name, F.lit(1))
    assert sorted([tuple(r) for r in C.compress(df.repartition(3)).collect()], key=str) == expected(rows)
    assert C.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_search_visits_entries_by_sum():
    rng = np.random.default_rng(7)
    parts, entries = rng.integers(-800, 800, (500, 8)), rng.integers(-800, 800, (16, 8))
    entries[3] = entries[9] = entries[14] - [1, -1, 0, 0, 0, 0, 0, 0]  # equal entries and equal sums
    parts[:16] = entries
    which, best, computed = C.nearest_entries(parts, entries)
    far = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (which == far.argmin(1)).all() and (best == far.min(1)).all()
    assert computed < 0.9 * far.size
    large, few, _ = C.nearest_entries(parts * 10**12, entries * 10**12)
    assert (large == which).all() and [int(x) for x in few] == [int(x) * 10**24 for x in best]


def test_decoding():
    book = [np.array([[4096, 0], [8192, 4096]]), np.array([[0, 2048]])]
    assert C.decode("0100", book).tolist() == [2.0, 1.0, 0.0, 0.5]


def test_join_of_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 500) for i in range(3000)], "i int, k int")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))
    got = {(r.i, r.k, r.s) for r in join_by_key(rows, table, "k", "n", share=10).collect()}
    sums = {r.k: r.s for r in table.collect()}
    assert got == {(i, k, sums[k]) for i, k in ((i, None if i % 3 == 0 else i % 500) for i in range(3000))}
