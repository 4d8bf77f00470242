"""Queries of this subpackage and the SQL that states their result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from duskwatch.llm import alignment, bpe, codebooks, exact_dedup, jaccard, mixing, neighbours, pages, pii, quality, simhash, token_counts, toxicity
from duskwatch.llm.common import documents, prepare, table

RANKS = "byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@_query("op1_quality_votes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by the votes of its nearest labelled ones."""
    return quality.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@_query("op3_nearest_vectors")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id divides by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


@_query("op4_exact_dedup", EXACT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op5_pseudonyms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms for the personal data in it."""
    return pii.pseudonymise(documents(spark, sf_dir))


@_query("op6_edit_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text before and after edits that are drawn from the documents themselves."""
    docs = documents(spark, sf_dir).withColumn("edits", token_counts.drawn_edits())
    return token_counts.count_with_edits(docs, public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN)


@_query("op7_weighted_mix", mixing.mixing_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a weighted mix takes of each document."""
    return mixing.mix(mixing.sized(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


@_query("op8_toxic_windows")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by its highest window."""
    return toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_query("op9_simhash_groups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and the groups that links within two bits make."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@_query("op10_page_texts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.main_texts(table(spark, sf_dir, "pages"))


@_query("op11_jaccard_groups", jaccard.jaccard_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every text's shingle set and the groups that links of 0.8 or more make."""
    return jaccard.jaccard_groups(documents(spark, sf_dir))


@_query("op12_aligned_tokens")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens by two tokenizers, grouped and linked where they end together."""
    vocabularies = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return alignment.align_tokens(documents(spark, sf_dir), vocabularies)


@_query("op13_vector_codes", codebooks.codebook_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code by codebooks of integer parts, and its error."""
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
