"""Structured Streaming jobs.

Windows over plain counts use watermarks. The two rules that look at earlier incidents
(repeat suppression, correlation) run per micro-batch with the batch operators, on the
new rows plus the stored rows of the last few minutes. That keeps their exact semantics,
spreads a hot key over time cells as in batch, and needs no state besides the output
table. That table is partitioned by hour and micro-batch: a batch opens the hours that it
can look back to and no others, and a repeated batch replaces what it wrote before.
Stage tables of a micro-batch are removed when it ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from duskwatch.functions import rules
from duskwatch.operators import correlate, normalise, suppress
from duskwatch.session import cut_lineage, folder_exists, run_folder, scratch


def start(writer: DataStreamWriter, checkpoint: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Start a writer: once over everything available, or in steady intervals."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def run_available(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Process all data there is now and stop."""
    start(writer, run_folder(spark, "offsets")).awaitTermination()


def epoch_path(folder: str, epoch: int) -> str:
    return f"{folder}/epoch={epoch}"


HOUR_US = 3_600_000_000


def _hour(column: str = "created_at"):
    """Whole hours since the epoch, the first partition of a stored table."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / HOUR_US).cast("bigint")


def write_epoch(rows: DataFrame, folder: str, epoch: int) -> None:
    """Rows of a micro-batch below ``hour=`` and ``epoch=``; the same batch again replaces them."""
    parts = rows.withColumn("hour", _hour()).withColumn("epoch", F.lit(epoch))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "epoch").parquet(folder)


def stored_before(spark: SparkSession, folder: str, epoch: int, since_us: int, until_us: int) -> DataFrame | None:
    """Rows of earlier micro-batches from the hours between two moments; other hours are neither listed nor opened."""
    hours = range(since_us // HOUR_US, until_us // HOUR_US + 1)
    paths = [p for p in (f"{folder}/hour={h}" for h in hours) if folder_exists(spark, p)]
    if not paths:
        return None
    rows = spark.read.option("basePath", folder).parquet(*paths)
    return rows.filter((F.col("epoch") < epoch) & (F.unix_micros(F.col("created_at").cast("timestamp")) >= since_us)).drop("hour", "epoch")


def normalise_stream(events: DataFrame, incidents: str, quarantine: str, normaliser: Callable[[DataFrame], DataFrame] = normalise.normalise_network_alerts) -> DataStreamWriter:
    """Raw sensor events to incident rows, rejects to a quarantine folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        with scratch(batch.sparkSession):
            judged = cut_lineage(normaliser(batch))
            good, bad = normalise.split_rejects(judged)
            good.write.mode("overwrite").parquet(epoch_path(incidents, epoch))
            bad.write.mode("overwrite").parquet(epoch_path(quarantine, epoch))

    return events.writeStream.foreachBatch(write)


def severity_windows(incidents: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Incidents per severity and tumbling window; rows later than ``delay`` are dropped."""
    timed = incidents.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
    return (
        timed.groupBy(F.window("at", window).alias("w"), F.lower("severity").alias("severity"))
        .agg(F.count(F.lit(1)).alias("incidents"))
        .select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "severity", "incidents")
    )


def request_rates(requests: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Request rate and mean latency over the trailing five minutes, at every minute."""
    timed = requests.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return (
        timed.groupBy(F.window("at", "5 minutes", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("duration_s").alias("duration_sum"))
        .select(
            F.unix_micros("w.end").alias("window_end_us"),
            "requests",
            (F.col("requests") / 300.0).alias("rate_per_second"),
            (F.col("duration_sum") / F.col("requests")).alias("mean_latency"),
        )
    )


def append_parquet(df: DataFrame, folder: str) -> DataStreamWriter:
    return df.writeStream.outputMode("append").format("parquet").option("path", folder)


def update_parquet(df: DataFrame, folder: str) -> DataStreamWriter:
    """Every change of a window as it happens, so that windows still open when the input ends are there too; ``latest`` reads them."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(epoch_path(folder, epoch))

    return df.writeStream.outputMode("update").foreachBatch(write)


def latest(spark: SparkSession, folder: str, *key: str) -> DataFrame:
    """The last state of each window of a table that ``update_parquet`` wrote."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    values = [c for c in rows.columns if c not in ("epoch", *key)]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "epoch").alias("last"))
    return last.select(*key, "last.*")


def _reach(batch: DataFrame, minutes: int) -> tuple[int, int] | None:
    """The moments between which stored rows can matter for the batch."""
    ends = batch.agg(F.min("created_at").alias("low"), F.max("created_at").alias("high"))
    ends = ends.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("low", "high")]).first()
    return None if ends["low"] is None else (ends["low"] - minutes * 60_000_000, ends["high"])


def suppress_stream(incidents: DataFrame, kept: str, repeats: str) -> DataStreamWriter:
    """Kept incidents and repeats of a stream of incidents, which arrive in time order."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            batch = cut_lineage(batch)
            reach = _reach(batch, rules.REPEAT_WINDOW_MINUTES)
            earlier = stored_before(spark, kept, epoch, *reach) if reach else None
            verdicts = suppress.suppress_repeats(batch, kept_before=earlier)
            judged = cut_lineage(batch.join(verdicts, "id", "left"))
            write_epoch(judged.filter(F.col("duplicate_of").isNull()).drop("duplicate_of"), kept, epoch)
            write_epoch(judged.filter(F.col("duplicate_of").isNotNull()).select("id", "duplicate_of", "created_at"), repeats, epoch)

    return incidents.writeStream.foreachBatch(write)


def correlate_stream(incidents: DataFrame, labelled: str) -> DataStreamWriter:
    """Incidents with correlation ids; earlier incidents pass theirs on to new ones."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            batch = cut_lineage(batch)
            reach = _reach(batch, rules.CORRELATION_WINDOW_MINUTES)
            earlier = stored_before(spark, labelled, epoch, *reach) if reach else None
            fresh = batch.withColumn("correlation_id", F.lit(None).cast("string"))
            if earlier is not None:
                fresh = fresh.unionByName(earlier)
            out = correlate.correlate(cut_lineage(fresh))
            write_epoch(out.join(batch.select("id"), "id", "left_semi"), labelled, epoch)

    return incidents.writeStream.foreachBatch(write)
