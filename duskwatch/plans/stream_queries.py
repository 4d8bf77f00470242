"""Streaming jobs run over the given tables until nothing is left, then read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from duskwatch.plans.catalog import ORACLE, query
from duskwatch.plans.views import oracle, stream_view, view
from duskwatch.session import cut_lineage, run_folder
from duskwatch.sources import sensors
from duskwatch.streaming import jobs

LOGS = 4


def _eve_stream(spark, sf_dir):
    folder = run_folder(spark, "eve-lines")
    view(spark, sf_dir, "eve_line_v").select("raw").write.text(folder)
    return folder


@query(
    "stream_network_alerts",
    oracle("eve_line_v", "SELECT CASE user_id % 5 WHEN 3 THEN 'high' ELSE CAST(user_id % 5 AS VARCHAR) END AS severity_number, count(*) AS alerts FROM eve_line_v WHERE kind = 0 GROUP BY 1"),
)
def stream_network_alerts(spark, sf_dir):
    out = run_folder(spark, "alerts")
    alerts = sensors.stream_network_events(spark, _eve_stream(spark, sf_dir)).select("alert.severity", "timestamp")
    jobs.run_available(spark, jobs.append_parquet(alerts, out))
    return spark.read.parquet(out).groupBy(F.col("severity").cast("string").alias("severity_number")).agg(F.count(F.lit(1)).alias("alerts"))


def _write_logs(lines, folder, parts):
    """Each task writes its lines to a log of its own, those of earlier parts first; a later call with more parts makes the logs grow."""
    from duskwatch.sources.tail import open_store

    def write(batches):
        store, root = open_store(folder)
        store.create_dir(root)
        number = TaskContext.get().partitionId()
        rows = 0
        with store.open_output_stream(f"{root}/eve-{number}.json") as out:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    out.write(raw.replace("\n", " ").encode() + b"\n")
                    rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([rows])], names=["rows"])

    dealt = lines.filter(F.col("event_id") % 3 < parts).repartition(LOGS, "event_id").sortWithinPartitions(F.col("event_id") % 3, "event_id")
    dealt.select("raw").mapInArrow(write, "rows bigint").agg(F.sum("rows")).collect()


@query(
    "stream_network_tail",
    oracle("eve_line_v", """SELECT CASE user_id % 5 WHEN 3 THEN 'high' ELSE CAST(user_id % 5 AS VARCHAR) END AS severity_number, count(*) AS alerts
      FROM eve_line_v WHERE kind = 0 AND event_id % 3 > 0 GROUP BY 1"""),
)
def stream_network_tail(spark, sf_dir):
    """Logs that grow between runs of a stream: what stood in them before it started is passed over, all that is added arrives once."""
    folder, out, offsets = (run_folder(spark, name) for name in ("eve-logs", "alerts", "offsets"))
    lines = cut_lineage(view(spark, sf_dir, "eve_line_v").select("event_id", "raw"))
    for parts in (1, 2, 3):
        _write_logs(lines, folder, parts)
        alerts = sensors.tail_network_events(spark, folder, prefix="eve-").select("alert.severity", "timestamp")
        jobs.start(jobs.append_parquet(alerts, out), offsets).awaitTermination()
    return spark.read.schema("severity string").parquet(out).groupBy(F.col("severity").alias("severity_number")).agg(F.count(F.lit(1)).alias("alerts"))


_TITLE = "coalesce(CASE WHEN event_id % 3 <> 0 THEN 'sig ' || word END, 'Suricata network alert')"


@query(
    "stream_normalise",
    oracle("eve_line_v", f"""SELECT 'incident' AS kind, {_TITLE} AS what, count(*) AS rows FROM eve_line_v WHERE kind = 0 GROUP BY ALL
      UNION ALL SELECT 'reject', CASE WHEN kind = 4 THEN 'not a JSON object' ELSE 'event type is not alert' END, count(*) FROM eve_line_v WHERE kind IN (1, 2, 4) GROUP BY ALL"""),
)
def stream_normalise(spark, sf_dir):
    from duskwatch.schemas import EVE_EVENT

    incidents, quarantine = run_folder(spark, "incidents"), run_folder(spark, "quarantine")
    events = sensors.parse_lines(stream_view(spark, sf_dir, "eve_line_v").select("event_id", "raw"), "raw", EVE_EVENT)
    jobs.run_available(spark, jobs.normalise_stream(events, incidents, quarantine))
    good = spark.read.parquet(incidents).select(F.lit("incident").alias("kind"), F.col("title").alias("what"))
    bad = spark.read.parquet(quarantine).select(F.lit("reject").alias("kind"), F.col("reject_reason").alias("what"))
    return good.unionByName(bad).groupBy("kind", "what").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_severity_windows",
    oracle("incidents_v", """SELECT * FROM (SELECT epoch_us(created_at) // 600000000 * 600000000 AS start_us, epoch_us(created_at) // 600000000 * 600000000 + 600000000 AS end_us, severity, count(*) AS incidents
      FROM incidents_v GROUP BY ALL) w"""),
)
def stream_severity_windows(spark, sf_dir):
    out = run_folder(spark, "severity")
    counts = jobs.severity_windows(stream_view(spark, sf_dir, "incidents_v"))
    jobs.run_available(spark, jobs.update_parquet(counts, out))
    return jobs.latest(spark, out, "start_us", "end_us", "severity")


@query(
    "stream_request_rates",
    oracle("request_log_v", """SELECT * FROM (SELECT epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) + 60000000 * (k.k + 1) AS window_end_us, count(*) AS requests,
      round(count(*) / 300.0, 9) AS rate_per_second, round(sum(duration_s) / count(*), 9) AS mean_latency
      FROM request_log_v, (VALUES (0), (1), (2), (3), (4)) k(k) GROUP BY 1) w"""),
)
def stream_request_rates(spark, sf_dir):
    out = run_folder(spark, "rates")
    jobs.run_available(spark, jobs.update_parquet(jobs.request_rates(stream_view(spark, sf_dir, "request_log_v")), out))
    return jobs.latest(spark, out, "window_end_us").withColumns({c: F.round(c, 9) for c in ("rate_per_second", "mean_latency")})


@query("stream_suppress_repeats", ORACLE["suppress_repeats"] and f"SELECT * FROM ({ORACLE['suppress_repeats']}) r WHERE duplicate_of IS NOT NULL")
def stream_suppress_repeats(spark, sf_dir):
    kept, repeats = run_folder(spark, "kept"), run_folder(spark, "repeats")
    jobs.run_available(spark, jobs.suppress_stream(stream_view(spark, sf_dir, "incidents_v"), kept, repeats))
    return spark.read.parquet(repeats).select("id", "duplicate_of")


@query("stream_correlation", ORACLE["correlation_ids"])
def stream_correlation(spark, sf_dir):
    labelled = run_folder(spark, "labelled")
    jobs.run_available(spark, jobs.correlate_stream(stream_view(spark, sf_dir, "incidents_v"), labelled))
    return spark.read.parquet(labelled).select("id", "correlation_id")
