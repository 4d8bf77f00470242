import hashlib
import os
import sys
from collections import Counter

import pytest
from oracle_check import compare, connect

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from duskwatch.llm import catalog, mixing, quality, simhash  # noqa: E402
from duskwatch.llm.common import cut_lineage  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = found = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found = cut_lineage(stage(spark, found, SF))
        tables.append(found)
    return tables


def test_stages_in_order(spark, stages):
    raw, good, single, apart, mixed, encoded = stages
    assert all(t.columns == raw.columns for t in stages[1:5])
    space = quality.fit_space(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.with_quality(raw, space).filter("score >= 0.3").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    ones = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in ones) >= 0.97 * len(ones)
    last = {}
    for r in good.collect():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())
    least = {r.doc_id: r.component_id for r in simhash.near_duplicates(single).collect()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(least.values()))
    wanted = {r.doc_id: r.copies for r in mixing.mix(mixing.sized(apart, digest=True)).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == wanted
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert Counter(r.doc_id for r in encoded.collect()) == wanted
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in encoded.collect())


def test_run_gives_the_stages_result(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns
    assert Counter((r.doc_id, r.ids_sha256) for r in got.collect()) == Counter((r.doc_id, r.ids_sha256) for r in stages[-1].collect())


@pytest.mark.parametrize("some", [True, False])
def test_edges(spark, tmp_path, some):
    docs = edge_rows.documents(spark) if some else edge_rows.no_documents(spark)
    edge_rows.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, str(tmp_path)))
        assert docs.columns == names, name
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == (docs.count() > 0)


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_sql(spark, sf_dir, name):
    for folder in (sf_dir, SF):
        state, note = compare(spark, connect(folder), folder, name, catalog.QUERIES[name], catalog.ORACLE[name])
        assert state == "ok", note


def test_catalogue():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} and "pipeline" in names
    assert set(catalog.ORACLE) <= set(__spark_entry__.oracle_sql())
