import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

from duskwatch.llm import exact_dedup as X  # noqa: E402


def expected(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    found = []
    for i, text, *_ in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        found.append((i, keep, len(own), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups(spark, bits):
    got = X.exact_duplicates(edge_rows.documents(spark), bits=bits)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == expected(edge_rows.rows())


def test_clashing_hashes_do_not_join_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.choice([10, 3000, 9000]))) for _ in range(60)]
    rows = [(i, texts[i % 60], "en", "a", 1) for i in range(150)]
    df = spark.createDataFrame(rows, edge_rows.SCHEMA)
    got = X.exact_duplicates(df, bits=2)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == expected(rows)


def test_rows_that_stay(spark):
    docs = edge_rows.documents(spark)
    kept = X.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({r[1] or "" for r in edge_rows.rows()})
    assert {(r.doc_id, r.text) for r in kept.collect()} >= {(8, edge_rows.rows()[5][1]), (9, "x" * 5000)}


def test_no_rows(spark):
    assert X.exact_duplicates(edge_rows.no_documents(spark)).count() == 0
    assert X.drop_exact_duplicates(edge_rows.no_documents(spark)).count() == 0


def test_cuts_depend_on_the_text_alone():
    rng = np.random.default_rng(1)
    a, b = rng.integers(97, 123, 50_000, dtype=np.uint8), rng.integers(97, 123, 7_000, dtype=np.uint8)
    alone = X.cut_texts(a, np.array([0, len(a)]))[0]
    after = X.cut_texts(np.concatenate([b, a]), np.array([0, len(b), len(b) + len(a)]))[1]
    assert [x - len(b) for x in after] == alone
    sizes = np.diff([0, *alone])
    assert sizes.max() <= X.MAX_CHUNK and sizes[:-1].min() >= X.MIN_CHUNK and alone[-1] == len(a)
    assert 900 < sizes.mean() < 2200
    # A changed byte moves the cuts near it only.
    c = a.copy()
    c[25_000] ^= 1
    assert len(set(alone) ^ set(X.cut_texts(c, np.array([0, len(c)]))[0])) <= 8
    flat = X.cut_texts(np.full(20_000, 97, np.uint8), np.array([0, 0, 20_000, 20_000]))
    assert flat[0] == [] and flat[2] == [] and flat[1][-1] == 20_000 and max(np.diff([0, *flat[1]])) <= X.MAX_CHUNK
