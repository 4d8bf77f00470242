import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

from duskwatch.llm import quality as Q  # noqa: E402
from duskwatch.llm import toxicity as T  # noqa: E402

LARGER = "/root/testdata/sf0.1"


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / max(ones.sum() * (~ones).sum(), 1)


@pytest.mark.skipif(not os.path.exists(LARGER), reason="needs the larger tables")
@pytest.mark.parametrize(("module", "label", "least"), [(Q, "quality", 0.98), (T, "toxic", 0.95)])
def test_held_out_documents(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in module.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    marks = [(got[r.doc_id].score, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    scores, truth = (np.array(x) for x in zip(*marks, strict=True))
    assert area(scores, truth) >= least
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for i, r in got.items())


@pytest.mark.parametrize("module", [Q, T])
@pytest.mark.parametrize("pairs", [None, [], [(3, 1, 1)]])
def test_edges(spark, module, pairs):
    docs = edge_rows.documents(spark)
    labels = edge_rows.labels(spark) if pairs is None else edge_rows.labels(spark, pairs) if pairs else edge_rows.labels(spark).limit(0)
    got = module.scored(docs, labels).collect()
    assert sorted([r.doc_id for r in got], key=str) == sorted([r[0] for r in edge_rows.rows()], key=str)
    assert all(0 <= r.score <= 1 and r.held_out is not None and r.predicted in (0, 1) for r in got)
    empty = [r.score for r in got if r.doc_id in (1, 2, 5)]
    assert max(empty) - min(empty) < 0.5
    assert module.scored(edge_rows.no_documents(spark), labels).count() == 0


def test_the_fold_teaches_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "good words here" if i in ids else "other text there", "en", "a", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i in ids else 1, 1 if i in ids else 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, edge_rows.SCHEMA)
    assert {r.score for r in Q.scored(docs, labels).collect()} == {1.0}  # only label 1 is left to learn
    assert max(r.score for r in T.scored(docs, labels).collect()) < 0.1


def test_votes_by_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA!!", "x*** y%%%"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    terms = Q.squeezed_counts(pa.array(texts))
    labels = np.array([i % 3 > 0 for i in range(80)], int)
    space = Q.Space(terms, labels, {0: 50, 1: 500})
    own = space._unit(space._weighed(terms) @ space.basis)
    for i, score in enumerate(space.scores(terms)):
        near = space.vectors @ own[i]
        best = np.argsort(-near)[: Q.NEIGHBOURS]
        votes = np.clip(near[best], 1e-3, None) ** Q.SHARPNESS * np.where(labels[best], 500 / labels.sum(), 50 / (80 - labels.sum()))
        assert score == pytest.approx((votes * labels[best]).sum() / votes.sum(), abs=0.02)
    one = np.concatenate([Q.term_counts(pa.array([t])) for t in texts])
    assert np.allclose(one, Q.term_counts(pa.array(texts)), atol=1e-5)  # a text's terms don't depend on its neighbours


def test_gradients():
    rng = np.random.default_rng(0)
    net = T.Network([np.zeros(T.WORD_BUCKETS), np.zeros(T.GRAM_BUCKETS), np.zeros(T.GRAM_BUCKETS)])
    x = rng.normal(size=(3, T.WINDOW, T.INPUTS)).astype(np.float32)
    mask = (np.arange(T.WINDOW)[None] < np.array([[32], [5], [20]])).astype(np.float32)
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])
    g, d_x = net.gradients(x, mask, y, w)

    def loss():
        states = np.concatenate([net._run(x @ net.p[f"W{d}"] + net.p[f"c{d}"], mask, d) for d in "fb"], axis=2)
        p = T._sigmoid(net._pooled(states, mask)[0].astype(float))
        return float((-w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 3)

    for where, grad in [(net.p[k], g[k]) for k in net.p] + [(x, d_x)]:
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        before, step = where[at], 1e-2
        where[at] = before + step
        up = loss()
        where[at] = before - step
        down = loss()
        where[at] = before
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.05, abs=1e-4)


def test_windows_cover_all_words_and_texts_are_read_apart():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "Two", "üÄé", "a", "x***", "..."]) for _ in range(n)) for n in (0, 1, 31, 32, 33, 56, 57, 300)]
    together = T.Words(pa.array(texts))
    spans, text = together.windows()
    for i, t in enumerate(texts):
        words = range(together.first[i], together.first[i + 1])
        covered = {w for (a, n), j in zip(spans.tolist(), text.tolist(), strict=True) if j == i for w in range(a, a + n)}
        assert covered == set(words) and all(n <= T.WINDOW for (_, n), j in zip(spans.tolist(), text.tolist(), strict=True) if j == i)
        alone = T.Words(pa.array([t]))
        assert alone.words.tolist() == together.words[words.start : words.stop].tolist()
        assert alone.grams4.tolist() == together.grams4[(together.of4 >= words.start) & (together.of4 < words.stop)].tolist()
