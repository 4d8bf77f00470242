import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

from duskwatch.llm import jaccard as J  # noqa: E402

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width=5):
    words = [w.decode() for w in (text or "").translate(_LOWER).encode().split()]
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def expected(rows, percent=80):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_token = {}
    for i, s in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(i)
    pairs = {(i, j) for own in by_token.values() for i in own for j in own if i < j}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)], key=str)


def crowds(seed):
    """Passages that many documents share, documents made of passages, near copies from close to far, and exact copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(4000)]
    passages = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    rows = []
    for group in range(4):
        base = [rng.choice(words) for _ in range(150)] + passages[0] * (group % 2)
        for copy in range(60):
            text = list(base)
            for _ in range(rng.randrange(1, 9)):
                text[rng.randrange(150)] = rng.choice(words)
            rows.append(" ".join(text))
    rows += [" ".join(sum(rng.sample(passages, rng.randint(1, 5)), []) + [rng.choice(words) for _ in range(rng.randrange(40))]) for _ in range(120)]
    rows += [" ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 5, 30, 300)))) for _ in range(60)]
    rows += [rows[0]] * 80
    rng.shuffle(rows)
    return [(1000 + i * 7 % 997 * 10 + i % 10, t, "en", "a", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_groups(spark, seed, small, monkeypatch):
    if small:
        for name, value in {"BLOCK_SETS": 8, "GROUP_SETS": 4, "QUERIES_AT_ONCE": 3, "TOKENS_AT_ONCE": 3_000, "FILTER_BITS": 1 << 16}.items():
            monkeypatch.setattr(J, name, value)
    rows = crowds(seed)
    df = spark.createDataFrame(rows, edge_rows.SCHEMA).repartition(6)
    got = sorted([tuple(r) for r in J.jaccard_groups(df).collect()], key=str)
    assert got == expected(rows)
    assert len(rows) / 4 < len({r[2] for r in got}) < len(rows) * 3 / 4  # there are links and there are lonely rows


def test_edges(spark):
    docs = edge_rows.documents(spark)
    got = sorted([tuple(r) for r in J.jaccard_groups(docs).collect()], key=str)
    assert got == expected(edge_rows.rows())
    assert J.jaccard_groups(edge_rows.no_documents(spark)).count() == 0


def test_sets():
    for text in ("", " \t", "a", "A b C d", "a b c d e f a b c d e f", "x " * 500, "É é É a"):
        assert len(J.shingle_set(text.encode())) == len(plain_set(text))
    assert set(J.shingle_set(b"a b c d E f").tolist()) >= set(J.shingle_set(b"A  B\tc d e").tolist())
    assert not set(J.shingle_set(b"a b c d e").tolist()) & set(J.shingle_set(b"b a c d e").tolist())


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("aBcé") for _ in range(rng.choice((1, 3, 9, 63, 64, 65, 200)))) for _ in range(400)]
    text = " ".join(words) + "\t" + "A" * 3000 + " \n " + "b" * 2999 + " c  d"
    whole = J.shingle_set(text.encode())
    assert len(whole) == len(plain_set(text))
    for size in (10, 64, 1000, 2999, 3000, 3001):
        monkeypatch.setattr(J, "SLICE_BYTES", size)
        assert np.array_equal(J.shingle_set(text.encode()), whole)
    # Words beyond 64 bytes are not told apart by places that repeat.
    a, b = "x" + "y" * 64, "y" * 64 + "x"
    assert not np.array_equal(J.shingle_set(a.encode()), J.shingle_set(b.encode()))


def test_links_and_bounds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.sort(np.unique(np.concatenate([base[rng.random(100) < 0.93], rng.integers(0, 2**63, 6, dtype=np.uint64)]))) for _ in range(40)]
    sets += [np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(10)]
    alike = {(i, j) for i in range(50) for j in range(i + 1, 50) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    found = J.links_inside(sets)
    assert set(found) <= alike
    group = J.Sets(sets[:20])
    for i in range(50):
        own = group.own(sets[i])
        inside = set(group.linked(own, len(sets[i]), np.arange(20), 80).tolist()) - {i}
        assert inside == {j for j in range(20) if (min(i, j), max(i, j)) in alike}
        if inside:
            assert len(own) >= J.needed(len(sets[i]))


def test_copies_that_are_not_near_enough_are_not_paired(spark, monkeypatch):
    """Of a crowd of texts that share four fifths of their shingles, each opened every group of the crowd."""
    monkeypatch.setattr(J, "GROUP_SETS", 4)
    rng = random.Random(5)
    base, asked = [f"w{i}" for i in range(150)], []
    rows = []
    for copy in range(120):
        text = list(base)
        for place in rng.sample(range(0, 150, 7), 4):
            text[place] = f"c{copy}x{place}"
        rows.append((copy, " ".join(text), "en", "a", 1))
    rows += [(500, " ".join(base), "en", "a", 1), (501, " ".join([*base[:-1], "end"]), "en", "a", 1)]
    opened = J.open_groups

    def counted(grouped, candidates, *args):
        asked.append(candidates.count())
        return opened(grouped, candidates, *args)

    monkeypatch.setattr(J, "open_groups", counted)
    got = sorted(tuple(r) for r in J.jaccard_groups(spark.createDataFrame(rows, edge_rows.SCHEMA).repartition(4)).collect())
    assert sorted(got, key=str) == expected(rows)
    assert asked[0] < len(rows)
