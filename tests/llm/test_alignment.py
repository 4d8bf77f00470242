import collections
import hashlib
import os
import sys

import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

from duskwatch.llm import alignment as A  # noqa: E402

VOCABULARIES = A.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    import tokenizers

    first = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = A.byte_alphabet()

    def of(text):
        """Both token streams, cut where tokens of both end, with every pair that ends together."""
        if not text:
            return 0, 0, 0, "", collections.Counter()
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return 0, 0, 0, "", collections.Counter()
        ends = []
        for tokens in (a_bytes, b_bytes):
            at, own = 0, {}
            for i, t in enumerate(tokens):
                at += len(t)
                own[at] = i + 1
            ends.append(own)
        groups, links, i, j = [], collections.Counter(), 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            k, m = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links[a[k - 1], b[m - 1]] += 1
            i, j = k, m
        return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    return of


def expected(plain, rows):
    made = [(r[0], *plain(r[1])) for r in rows]
    counts = collections.Counter()
    for m in made:
        counts.update(m[5])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        [
            (i, a, b, g, sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[1]]), sum(n * counts[p] for p, n in links.items()), sha)
            for i, a, b, g, sha, links in made
        ],
        key=str,
    )


ODD = ["a", " ", "  x  y ", "▁", "a▁b", "<|endoftext|> <s> <0x41>", "x" * 3000, "\n\n a\tb  c", "\x00", "Ünï 😀 漢字 it's 've", "word " * 400]


@pytest.mark.parametrize("memo", [200_000, 3])
def test_rows(spark, plain, memo, monkeypatch):
    monkeypatch.setattr(A, "MEMO_WINDOWS", memo)
    monkeypatch.setattr(A, "PAIRS_HELD", 50)
    rows = edge_rows.rows() + [(100 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, edge_rows.SCHEMA).withColumnRenamed("n_chars", "pairs").repartition(3)
    got = A.align_tokens(docs, VOCABULARIES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(plain, rows)
    assert A.align_tokens(edge_rows.no_documents(spark), VOCABULARIES).count() == 0


def test_given_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted([tuple(r) for r in A.align_tokens(docs, VOCABULARIES).collect()], key=str)
    assert got == expected(plain, [(r.doc_id, r.text) for r in docs.collect()])


def test_windows_are_remembered(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    aligner = A.Aligner(*VOCABULARIES())
    first = aligner.texts(texts)
    aligned = aligner.aligned
    again = aligner.texts(texts)
    assert aligner.aligned == aligned > 0 and first[3] == again[3]


def test_equal_keys_of_different_windows(spark, monkeypatch, plain):
    monkeypatch.setattr(A, "_window_keys", lambda ids, starts, counts: (counts % 2).astype("uint64"))
    texts = ["some words here and there", "other words, some odd", "x"]
    found = A.Aligner(*VOCABULARIES()).texts(texts)
    assert found[3] == [plain(t)[3] for t in texts]


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    tokens = A.PieceTokens(public_tokenizers.path("piece_bpe_32k.model"))
    text = "some words  with  spaces\n and lines é 漢字 " * 60
    whole = list(tokens.encode([text])[0])
    monkeypatch.setattr(A, "PIECE_CHARS", 50)
    assert len(tokens._parts(text)) > 20 and tokens.encode([text])[0] == whole


def test_pairs_are_bounded_by_the_vocabularies():
    a, b = VOCABULARIES()
    assert A.pair_bound([b"ab", b"b", b""], [b"b", b"cab", b"b"]) == 6  # ab-b and b-b twice each, ab-cab, b-cab
    assert A.pair_bound(a.token_bytes, b.token_bytes) < 1_000_000
