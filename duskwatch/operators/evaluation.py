"""Model quality from prediction tables, by counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined) and the confusion counts."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "rows",
        _ratio(F.col("tn") + F.col("tp"), F.col("rows")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class seen as label or prediction."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
            )
        ),
        (F.col("y") == F.col("p")).alias("hit"),
    )
    per_class = sides.groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("claimed").alias("claimed"),
        F.sum(F.when(F.col("hit"), F.col("support")).otherwise(0)).alias("hits"),
    )
    precision, recall = _ratio(F.col("hits"), F.col("claimed")), _ratio(F.col("hits"), F.col("support"))
    return per_class.select("class", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), "support", "hits")


def weighted_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 over all classes."""
    report = class_report(df, label, predicted)
    n = F.sum("support")
    return report.agg(
        n.alias("rows"),
        (F.sum("hits") / n).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("precision", "recall", "f1")],
    )


def roc_auc(df: DataFrame, label: str, score: str, buckets: int = 512) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in order.

    Rows are counted per distinct score before anything is ordered. Scores are cut into
    ranges of similar size, so the running count of negatives is a sum over lower ranges
    plus a local sum, and no single task orders all scores.
    """
    y = F.col(label) == 1
    per_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    cuts = sorted(set(df.select(F.col(score).cast("double").alias("s")).approxQuantile("s", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    if cuts:
        splitter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="s", outputCol="bucket")
        ranged = splitter.transform(per_score)
    else:
        ranged = per_score.withColumn("bucket", F.lit(0.0))
    totals = ranged.groupBy("bucket").agg(F.sum("neg").alias("bucket_neg"))
    lower = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("bucket_neg").over(lower), F.lit(0)).alias("below"))
    inside = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    ordered = ranged.join(offsets, "bucket").withColumn("beaten", F.col("below") + local)
    wins = F.sum(F.col("pos") * (F.col("beaten") + F.col("neg") / 2))
    return ordered.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"), F.sum("pos").alias("positives"))


def roc_auc_weighted(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """One-versus-rest areas averaged by class size; ``scores[c]`` is the score of class c."""
    parts: DataFrame | None = None
    for number, score in enumerate(scores):
        one = df.withColumn("is_class", (F.col(label) == number).cast("int"))
        area = roc_auc(one, "is_class", score).withColumn("class", F.lit(number))
        parts = area if parts is None else parts.unionByName(area)
    if parts is None:
        raise ValueError("no score columns given")
    return parts.agg((F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc"))


def fold_summary(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return results.select(F.inline(entries)).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds")
    )


def anomaly_rate(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    hit = F.count_if(F.col(flag))
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), (n - hit).alias("normal"), hit.alias("anomalies"), F.try_divide(hit, n).alias("anomaly_rate"))
