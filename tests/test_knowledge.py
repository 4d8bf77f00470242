import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import knowledge, retrieval


def test_chunks_cover_every_word_within_the_limit(spark):
    rng = random.Random(1)
    texts = [
        " ".join(f"w{n}" + ("." if rng.random() < 0.1 else "") for n in range(size)) for size in (1, 80, 81, 512, 513, 2000)
    ] + ["", "  \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    chunks = knowledge.chunk_documents(df, "text", "id").collect()
    assert all(0 < c["n_words"] <= 512 for c in chunks)
    for i, text in enumerate(texts):
        mine = [c for c in chunks if c["id"] == i]
        assert {w for c in mine for w in c["text"].split()} == set(text.split())
    assert len([c for c in chunks if c["id"] == 3]) == 1


def test_sections_use_only_their_own_heading(spark):
    content = "# h\n## CVE-2024-1 - One\n**CVSS Severity:** HIGH\n## CWE-79 - inside\n\n## CVE-2024-22 - Two\nx"
    df = spark.createDataFrame([("cve/cve_selected.md", content)], "path STRING, content STRING")
    docs = knowledge.documents_from_markdown(df).collect()
    assert [d["doc_key"] for d in docs] == ["CVE-2024-1", "CVE-2024-22"]
    assert "CWE-79" in docs[0]["text"] and docs[0]["metadata"]["cvss_severity"] == "HIGH"


def test_page_without_categories_stays_whole(spark):
    content = "## NIST CSF 2.0 - Page 3\n**Detected CSF Identifiers:** GV.OC-01\ntext"
    df = spark.createDataFrame([("nist/nist_csf_2_0.md", content)], "path STRING, content STRING")
    doc = knowledge.documents_from_markdown(df).first()
    assert (doc["doc_key"], doc["metadata"]["identifiers"]) == ("3", "GV.OC-01")


QUERY = "query_id BIGINT, text STRING, vector ARRAY<DOUBLE>"
FOUND = "query_id BIGINT, chunk_id BIGINT, score DOUBLE, document_type STRING, doc_key STRING, source STRING"


def ranked(spark, text, found, **options):
    queries = spark.createDataFrame([(1, text, [1.0])], QUERY)
    rows = [(1, i, *f) for i, f in enumerate(found)]
    out = retrieval.rank_candidates(spark.createDataFrame(rows, FOUND), queries, **options)
    return [(r["source"], r["score"]) for r in out.orderBy("position").collect()]


def test_exact_id_outranks_similarity(spark):
    found = [(0.9, "soc_knowledge", "a", "a"), (0.3, "cve", "CVE-2024-7", "cve seven"), (0.8, "cve", "CVE-2024-8", "cve eight")]
    assert ranked(spark, "what is cve-2024-7?", found) == [("cve seven", 0.3), ("a", 0.9), ("cve eight", 0.8)]


def test_one_chunk_per_document_and_thresholds(spark):
    found = [(0.9, "cwe", "CWE-1", "x"), (0.85, "cwe", "CWE-1", "x"), (0.54, "cwe", "CWE-2", "y"), (0.53, "cwe", "CWE-3", "z"), (0.1, "cwe", "CWE-4", "w")]
    assert ranked(spark, "q", found) == [("x", 0.9), ("y", 0.54)]
    assert ranked(spark, "q", [(0.19, "cwe", "CWE-1", "x")]) == []


def test_nearest_chunks_in_blocks_equal_one_pass(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    chunks = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "chunk_id BIGINT, embedding ARRAY<FLOAT>").repartition(4)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors[:10])], "query_id BIGINT, vector ARRAY<DOUBLE>")
    one = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.nearest_chunks(queries, chunks, 3).collect()}
    many = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.nearest_chunks(queries, chunks, 3, query_block=3, chunk_block=7).collect()}
    assert one == many and all(one[i, 1] == i for i in range(10)) and len(one) == 30


def test_no_questions_give_no_rows(spark):
    chunks = spark.createDataFrame([(1, [1.0])], "chunk_id BIGINT, embedding ARRAY<FLOAT>")
    assert retrieval.nearest_chunks(spark.createDataFrame([], "query_id BIGINT, vector ARRAY<DOUBLE>"), chunks, 3).count() == 0


def test_equal_scores_go_to_the_lower_chunk(spark):
    chunks = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "chunk_id BIGINT, embedding ARRAY<FLOAT>").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id BIGINT, vector ARRAY<DOUBLE>")
    assert sorted(r["chunk_id"] for r in retrieval.nearest_chunks(queries, chunks, 4).collect()) == [0, 1, 2, 3]


def test_changed_files_only(spark):
    files = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "path STRING, content STRING")
    old = knowledge.file_fingerprints(files, "v1", "m")
    edited = spark.createDataFrame([("a.md", "x"), ("b.md", "z"), ("c.md", "n")], "path STRING, content STRING")
    now = knowledge.file_fingerprints(edited, "v1", "m")
    assert {r["path"] for r in knowledge.changed_files(edited, now, old).collect()} == {"b.md", "c.md"}


@pytest.mark.parametrize("raw,expected", [("a &amp; b\n  c", "a & b c"), ("&lt;x&gt;&nbsp;y", "<x> y"), (None, "")])
def test_catalog_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t STRING")
    assert df.select(knowledge.clean_catalog_text(F.col("t"))).first()[0] == expected


def test_catalogue_rows_are_dealt_to_all_cores(spark, sf_dir):
    """A small file is one task of a scan, whatever is done with its rows."""
    from duskwatch.plans import knowledge_queries
    from duskwatch.plans.views import table

    rows = knowledge_queries._weaknesses(spark, sf_dir)
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert rows.count() == table(spark, sf_dir, "part").count()
