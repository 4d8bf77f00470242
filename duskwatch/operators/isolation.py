"""Isolation forest over flow features.

Every tree sees a small random sample, so the sample of each tree is drawn with Spark,
trees are grown in parallel, one group per tree, and the forest is a table of nodes whose
size depends on the number of trees only. Scoring walks the trees on column batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.operators.descent import Descent, floats, in_chunks
from duskwatch.session import cut_lineage

TREES = 300
SAMPLE = 256
CONTAMINATION = 0.01
SEED = 42
_NODE = "tree int, node int, feature int, threshold double, below int, above int, depth double"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


# --- scaling ---------------------------------------------------------------
def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, mean, std`` (population); a constant feature has std 1."""
    wide = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    entries = [
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}")).alias("std"))
        for f in features
    ]
    return wide.select(F.inline(F.array(*entries)))


def scale(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features centred and divided by their deviation. ``stats`` has one row per feature."""
    known = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    return df.withColumns({f: (F.col(f) - known[f][0]) / known[f][1] for f in features})


# --- growing ---------------------------------------------------------------
def tree_samples(df: DataFrame, features: Sequence[str], trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``tree`` and features: for each tree ``size`` rows drawn without replacement.

    Rows are drawn by hashes of their values (and a number that tells equal rows apart), so a sample depends neither on
    how rows are dealt to tasks nor on which run draws it. Rows whose hash lies in the lowest share that holds a few times the rows
    needed make a pool; each is offered to several trees, all different, and a tree takes the offers with the lowest
    hashes. On a small table share and offers reach everything.
    """
    counted = df.groupBy(*features).agg(F.count(F.lit(1)).alias("__n"))
    n = df.count()
    wanted = trees * size
    share = min(1.0, 4.0 * wanted / max(n, 1))
    offers = min(trees, math.ceil(2.0 * wanted / max(n * share, 1.0)))
    each = counted.select(*features, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))).alias("__copy"))
    hashed = each.withColumn("__h", F.xxhash64(F.lit(seed), *features, "__copy"))
    pool = hashed.filter(F.shiftrightunsigned("__h", 1) < F.lit(int(share * 2.0**63) if share < 1 else 2**63 - 1))
    # Steps that share no divisor with the number of trees never come back to a tree early.
    steps = [k for k in range(1, trees + 1) if math.gcd(k, trees) == 1]
    step = F.element_at(F.array(*[F.lit(k) for k in steps]), (F.pmod(F.xxhash64("__h", F.lit("step")), F.lit(len(steps))) + 1).cast("int"))
    nth = F.explode(F.sequence(F.lit(0), F.lit(offers - 1)))
    offered = pool.withColumn("__step", step).withColumn("__nth", nth)
    offered = offered.withColumn("tree", F.pmod(F.xxhash64("__h", F.lit("tree")) % trees + F.col("__nth") * F.col("__step"), F.lit(trees)).cast("int"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "__h"), "__h")
    return cut_lineage(offered.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= size).select("tree", *features))


def _grow(features: Sequence[str], seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        pdf = pdf.sort_values(list(features), ignore_index=True)  # so the tree doesn't depend on the order of arrival
        rng = np.random.default_rng([seed, tree])
        data = pdf[list(features)].to_numpy(dtype=float)
        deepest = int(np.ceil(np.log2(max(len(data), 2))))
        nodes: list[list[float]] = []
        waiting = [(np.arange(len(data)), 0, -1, 0)]
        while waiting:
            rows, depth, parent, side = waiting.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][side] = at
            part = data[rows]
            varied = part.max(axis=0) > part.min(axis=0)
            if depth >= deepest or len(rows) <= 1 or not varied.any():
                nodes.append([tree, at, -1, 0.0, -1, -1, depth + float(mean_path(len(rows)))])
                continue
            feature = int(rng.choice(np.flatnonzero(varied)))
            values = part[:, feature]
            threshold = float(rng.uniform(values.min(), values.max()))
            below = values <= threshold
            nodes.append([tree, at, feature, threshold, -1, -1, 0.0])
            waiting.append((rows[~below], depth + 1, at, 5))
            waiting.append((rows[below], depth + 1, at, 4))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "below", "above", "depth"])

    return grow


def grow_forest(scaled: DataFrame, features: Sequence[str], trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Node table of the forest: at most ``2 * size`` rows per tree."""
    samples = tree_samples(scaled, features, trees, size, seed)
    return samples.groupBy("tree").applyInPandas(_grow(features, seed), _NODE)


def save_forest(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NODE).parquet(path)


def save_scorer(nodes: DataFrame, stats: DataFrame, offset: float, path: str) -> None:
    """All that scoring needs: nodes, scaler and offset, as tables below ``path``."""
    save_forest(nodes, f"{path}/nodes")
    stats.write.mode("overwrite").parquet(f"{path}/scaler")
    nodes.sparkSession.createDataFrame([(float(offset),)], "offset double").write.mode("overwrite").parquet(f"{path}/offset")


def score_with_saved(df: DataFrame, path: str, features: Sequence[str], *keep: str, size: int = SAMPLE) -> DataFrame:
    """``keep...``, normality and verdict of every row by a stored scorer; nothing is fitted."""
    spark = df.sparkSession
    scaled = scale(df, spark.read.parquet(f"{path}/scaler"), features)
    offset = spark.read.schema("offset double").parquet(f"{path}/offset").first()["offset"]
    return judge(score(scaled, load_forest(read_forest(spark, f"{path}/nodes"), size), features, *keep), offset)


# --- scoring ---------------------------------------------------------------
@dataclass
class Forest:
    """Trees as arrays; a leaf's feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    norm: float


def load_forest(nodes: DataFrame, size: int = SAMPLE) -> Forest:
    """The node table as arrays. Its size is fixed by trees and sample size, not by data."""
    pdf = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
    start = pdf.groupby("tree").cumcount().to_numpy()
    base = np.arange(len(pdf)) - start
    return Forest(
        feature=pdf["feature"].to_numpy(),
        threshold=pdf["threshold"].to_numpy(),
        below=pdf["below"].to_numpy() + base,
        above=pdf["above"].to_numpy() + base,
        depth=pdf["depth"].to_numpy(),
        roots=np.flatnonzero(start == 0),
        norm=float(mean_path(size)),
    )


def _normality(down: Descent, depths: Sequence[np.ndarray], norm: float, values: np.ndarray) -> np.ndarray:
    """-1 for the most isolated rows up to 0 for the most ordinary ones."""
    total, ranks = np.zeros(len(values)), down.ranks(values)
    for tree, depth in zip(down.trees, depths, strict=True):
        total += depth.take(tree.leaves(ranks))
    return -np.exp2(-total / (len(down.trees) * norm))


def score(scaled: DataFrame, forest: Forest, features: Sequence[str], *keep: str) -> DataFrame:
    """``keep...`` and ``normality`` of every row."""
    down = Descent.of(forest.feature, forest.threshold, forest.below, forest.above, forest.roots.tolist(), len(features))
    shared = scaled.sparkSession.sparkContext.broadcast((down, down.by_tree(forest.depth), forest.norm))
    needed = list(dict.fromkeys([*keep, *features]))
    places = [needed.index(f) for f in features]
    kept = [needed.index(c) for c in keep]

    def run(batches):
        for batch in in_chunks(batches):
            told = _normality(*shared.value, np.stack([floats(batch.column(i)) for i in places], axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(told)], names=[*keep, "normality"])

    kinds = ", ".join(f"`{c}` {scaled.schema[c].dataType.simpleString()}" for c in keep)
    return scaled.select(*needed).mapInArrow(run, f"{kinds}{', ' if kinds else ''}normality double")


def offset_of(scored: DataFrame, contamination: float = CONTAMINATION) -> float:
    """Score below which the given share of the training rows lies.

    Taken from a quantile sketch with a rank error below one in a hundred thousand rows.
    """
    value = scored.agg(F.percentile_approx("normality", contamination, 100_000).alias("q")).first()
    return float(value["q"])


def judge(scored: DataFrame, offset: float) -> DataFrame:
    """Decision value, anomaly flag and name; below zero is an anomaly."""
    decision = F.col("normality") - F.lit(offset)
    return scored.withColumn("anomaly_score", decision).withColumn("is_anomaly", decision < 0).withColumn(
        "prediction", F.when(decision < 0, "ANOMALY").otherwise("NORMAL")
    )
