"""Vector search over chunks and ranking of what it finds."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.functions import rules
from duskwatch.operators.knowledge import requested_ids

# Rows of a block; every block of queries meets every block of chunks in a task of its own.
QUERY_BLOCK = 4_096
CHUNK_BLOCK = 16_384
AT_ONCE = 256  # queries of a block that are compared at once


def _unit(rows: Sequence) -> np.ndarray:
    m = np.vstack([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best_of_block(k: int, columns: Sequence[str]):
    """The ``k`` most similar chunks of one block for each query of another."""

    def best(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or chunks.empty:
            return pd.DataFrame(columns=list(columns))
        chunks = chunks.sort_values("chunk_id", ignore_index=True)  # equal scores go to the lower id
        asked, known = _unit(queries["vector"]), _unit(chunks["embedding"]).T
        found = []
        for at in range(0, len(asked), AT_ONCE):
            scores = asked[at : at + AT_ONCE] @ known
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows = chunks.iloc[top.ravel()].drop(columns="embedding")
            ids = np.repeat(queries["query_id"].to_numpy()[at : at + AT_ONCE], top.shape[1])
            found.append(rows.assign(query_id=ids, score=np.take_along_axis(scores, top, axis=1).ravel())[list(columns)])
        return pd.concat(found, ignore_index=True)

    return best


def _blocks(df: DataFrame, key: str, size: int) -> int:
    """In how many blocks of about ``size`` rows the rows are cut."""
    return max(1, math.ceil(df.agg(F.count(F.lit(1))).first()[0] / size))


def nearest_chunks(
    queries: DataFrame, chunks: DataFrame, k: int, keep: Sequence[str] = (), query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK
) -> DataFrame:
    """Exact ``k`` most similar chunks (cosine) per query: ``query_id, chunk_id, score, keep..., rank``.

    ``queries`` has ``query_id, vector`` and ``chunks`` has ``chunk_id, embedding``. Both sides are cut into blocks by
    hash and every pair of blocks is one group, so one plan serves any number of either and none of them travels through
    the driver. A block hands on ``k`` rows per query. No queries give no rows.
    """
    many_queries, many_chunks = _blocks(queries, "query_id", query_block), _blocks(chunks, "chunk_id", chunk_block)
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    asked = queries.select("query_id", "vector", block("query_id", many_queries).alias("qb"), every(many_chunks).alias("cb"))
    known = chunks.select("chunk_id", "embedding", *keep, block("chunk_id", many_chunks).alias("cb"), every(many_queries).alias("qb"))
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("score", T.DoubleType())]
    fields += [chunks.schema[c] for c in ("chunk_id", *keep)]
    best = _best_of_block(k, [f.name for f in fields])

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return best(q.drop(columns=["qb", "cb"]), c.drop(columns=["qb", "cb"]))

    found = asked.groupBy("qb", "cb").cogroup(known.groupBy("qb", "cb")).applyInPandas(run, T.StructType(fields))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    limit: int = rules.SEARCH_LIMIT,
    min_score: float = rules.MIN_SCORE,
    relative: float = rules.RELATIVE_THRESHOLD,
) -> DataFrame:
    """Ranked sources per query: ``query_id, position, source, score, document_type, exact``.

    ``queries`` has ``query_id, text, vector``; ``chunks`` has ``chunk_id, embedding,
    document_type, doc_key, source``.
    """
    found = nearest_chunks(queries, chunks, max(5 * limit, 20), ("document_type", "doc_key", "source"))
    return rank_candidates(found, queries, limit=limit, min_score=min_score, relative=relative)


def rank_candidates(
    found: DataFrame,
    queries: DataFrame,
    *,
    limit: int = rules.SEARCH_LIMIT,
    min_score: float = rules.MIN_SCORE,
    relative: float = rules.RELATIVE_THRESHOLD,
) -> DataFrame:
    """Boost ids named in the query, keep one chunk per document, apply both thresholds."""
    asked = queries.select("query_id", requested_ids(F.col("text")).alias("ids"))
    identified = F.col("document_type").isin("cve", "cwe", "mitre_attack", "nist_csf")
    df = found.filter(F.col("score") >= min_score).join(asked, "query_id")
    df = df.withColumn("exact", F.array_contains("ids", F.upper("doc_key")) & F.col("document_type").isin("cve", "cwe", "mitre_attack"))
    df = df.withColumn("ranking", F.col("score") + F.col("exact").cast("int"))
    df = df.withColumn("unit", F.when(identified, F.col("doc_key")).otherwise(F.col("source")))
    order = [F.desc("ranking"), F.desc("score"), F.asc("chunk_id")]
    per_unit = Window.partitionBy("query_id", "document_type", "unit").orderBy(*order)
    df = df.withColumn("nth", F.row_number().over(per_unit)).filter(F.col("nth") == 1)
    best = F.max("score").over(Window.partitionBy("query_id"))
    df = df.withColumn("best", best).filter((F.col("score") >= F.col("best") * relative) | F.col("exact"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return (
        df.withColumn("position", position)
        .filter(F.col("position") <= limit)
        .select("query_id", "position", "source", "score", "document_type", "exact", "chunk_id")
    )


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label: ``label, vector`` (as many rows as labels)."""
    each = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("vector"))
