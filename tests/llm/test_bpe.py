import base64
import hashlib
import os
import random
import struct
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

from duskwatch.llm import bpe, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "abcdrestvml'  \t\n\x1c\x85\xa0 1٢é漢'.!=~​"


@pytest.fixture(scope="module")
def raw():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def judge(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, length, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, length)))
        text = text.encode("ascii", "ignore").decode() if i % 3 == 0 else text
        yield rng.choice("ab= é") * rng.randint(40, 300) + text if i % 40 == 0 else text


def test_codec(raw, judge):
    codec = bpe.Codec(raw, bpe.PUBLIC_PATTERN)
    for text in texts(1500, 40):
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == judge.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def expected(judge, text):
    ids = judge.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("window", "overlap"), [(65_536, 1_024), (300, 60), (40, 20)])
def test_documents(spark, judge, window, overlap):
    got = bpe.encode_documents(edge_rows.documents(spark), PATH, window_chars=window, overlap_chars=overlap).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(i, *expected(judge, t)) for i, t, *_ in edge_rows.rows()], key=str)


def test_windows_that_seldom_agree(spark, judge):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts(150, 900, 9))]
    got = bpe.encode_documents(spark.createDataFrame(rows, edge_rows.SCHEMA), PATH, window_chars=24, overlap_chars=8, with_ids=True).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: expected(judge, t) for i, t, *_ in rows}
    assert {r.doc_id: r.ids for r in got} == {i: judge.encode_ordinary(t) for i, t, *_ in rows}


def test_decoding_and_no_rows(spark, judge):
    docs = edge_rows.documents(spark).select("doc_id", "text")
    back = bpe.decode_ids(bpe.encode_documents(docs, PATH, with_ids=True), PATH).select("doc_id", "decoded").collect()
    assert sorted([(r.doc_id, bytes(r.decoded)) for r in back], key=str) == sorted([(i, (t or "").encode()) for i, t, *_ in edge_rows.rows()], key=str)
    assert bpe.encode_documents(edge_rows.no_documents(spark), PATH).count() == 0


def test_edits_leave_the_tree_of_the_edited_text(raw, judge, monkeypatch):
    codec, rng = bpe.Codec(raw, bpe.PUBLIC_PATTERN), random.Random(8)
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    for text in texts(1500, 60, 5):
        monkeypatch.setattr(token_counts, "AHEAD", rng.choice([1, 3, 8, 300]))
        tree = token_counts.CountTree(codec, text)
        for _ in range(4):
            at, delete, insert = rng.randint(0, len(text) + 1), rng.choice([0, 0, 1, 3, 10, 80]), "".join(rng.choice(LETTERS) for _ in range(rng.choice([0, 1, 2, 9])))
            at = min(at, len(text))
            text = text[:at] + insert + text[at + delete :]
            tree.edit(at, delete, insert)
            assert tree.text == text
            assert [n for block in tree.lengths for n in block] == list(map(len, codec.pieces(text)))
            assert (tree.total, tree.chars[1]) == (len(judge.encode_ordinary(text)), len(text))


def test_an_edit_reencodes_little(raw):
    tree = token_counts.CountTree(bpe.Codec(raw, bpe.PUBLIC_PATTERN), edge_rows.long_text())
    tree.edit(100_000, 5, "another word")
    assert 0 < tree.encoded < 200


def test_edited_documents(spark, judge):
    docs = edge_rows.documents(spark).withColumn("edits", token_counts.drawn_edits())
    docs = docs.withColumn("edits", F.when(F.col("doc_id") == 6, F.lit(None)).otherwise(F.col("edits")))
    rows = {(r.doc_id, r.text): r.edits for r in docs.collect()}
    wanted = []
    for (i, text), edits in rows.items():
        text = now = text or ""
        for e in edits or ():
            at = max(0, min(e["at"], len(now)))
            now = now[:at] + e["insert"] + now[min(len(now), at + e["delete"]) :]
        wanted.append((i, len(judge.encode_ordinary(text)), len(judge.encode_ordinary(now)), len(now)))
    got = token_counts.count_with_edits(docs, PATH).select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited").collect()
    assert {tuple(r) for r in got} == set(wanted) and len(got) == len(edge_rows.rows())
    odd = spark.createDataFrame([(1, "some text", [None, (None, 1, "x"), (2, None, None), (-5, 2, "Y"), (99, 9, "z")]), (2, None, None)], "doc_id int, text string, edits array<struct<at:int,delete:int,insert:string>>")
    assert [r.n_chars_edited for r in token_counts.count_with_edits(odd, PATH).orderBy("doc_id").collect()] == [len("Yme textz"), 0]
    empty = edge_rows.no_documents(spark).withColumn("edits", token_counts.drawn_edits())
    assert token_counts.count_with_edits(empty, PATH).count() == 0
