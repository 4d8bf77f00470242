"""Operational metrics, counters and gauges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.functions.columns import micros, norm


def _elapsed(later: str, earlier: str) -> Column:
    """Microseconds between two times; null when one is missing or the order is wrong."""
    us = micros(F.col(later)) - micros(F.col(earlier))
    return F.when(us >= 0, us)


def incident_times(incidents: DataFrame) -> DataFrame:
    """Seconds to detect and to resolve, per incident."""
    return incidents.select(
        "id",
        (_elapsed("detected_at", "event_timestamp") / 1e6).alias("mttd_seconds"),
        (_elapsed("resolved_at", "detected_at") / 1e6).alias("mttr_seconds"),
    )


def _operational() -> list[Column]:
    mttd, mttr = _elapsed("detected_at", "event_timestamp"), _elapsed("resolved_at", "detected_at")
    return [
        F.count(F.lit(1)).alias("total_incidents"),
        F.count(mttd).alias("incidents_with_mttd"),
        F.count(mttr).alias("incidents_with_mttr"),
        (F.avg(mttd) / 1e6).alias("average_mttd_seconds"),
        (F.avg(mttr) / 1e6).alias("average_mttr_seconds"),
    ]


def _quality() -> list[Column]:
    # A missing disposition is not 'unknown', so it counts as reviewed.
    reviewed = F.count_if(~F.col("disposition").eqNullSafe("unknown"))
    false_positive = F.count_if(F.col("disposition") == "false_positive")
    return [
        reviewed.alias("reviewed_incidents"),
        false_positive.alias("false_positive_count"),
        F.count_if(F.col("disposition") == "true_positive").alias("true_positive_count"),
        (F.try_divide(false_positive, reviewed) * 100).alias("false_positive_rate"),
    ]


def _severity_counts() -> list[Column]:
    return [F.count_if(F.lower("severity") == s).alias(f"severity_{s}") for s in rules.SEVERITIES]


def global_metrics(incidents: DataFrame) -> DataFrame:
    return incidents.agg(*_operational())


def quality_metrics(incidents: DataFrame) -> DataFrame:
    return incidents.agg(*_quality())


def severity_distribution(incidents: DataFrame) -> DataFrame:
    """``severity, incidents`` for the four levels, zero when absent."""
    counts = incidents.agg(*_severity_counts())
    pairs = [F.struct(F.lit(s).alias("severity"), F.col(f"severity_{s}").alias("incidents")) for s in rules.SEVERITIES]
    return counts.select(F.inline(F.array(*pairs)))


def dashboard(incidents: DataFrame) -> DataFrame:
    """Operational, quality and severity figures from one scan, as one row."""
    return incidents.agg(*_operational(), *_quality(), *_severity_counts())


def gauges(incidents: DataFrame) -> DataFrame:
    """Scrape form of the dashboard: ``metric, label, value`` with NaN for no value."""
    board = dashboard(incidents)
    plain = [c for c in board.columns if not c.startswith("severity_")]
    rows = [(c, "", c) for c in plain] + [("incidents_by_severity", s, f"severity_{s}") for s in rules.SEVERITIES]
    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(label).alias("label"),
            F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias("value"),
        )
        for metric, label, c in rows
    ]
    return board.select(F.inline(F.array(*entries)))


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """Total and one count per condition, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def _is(column: str, *values: str) -> Column:
    return norm(F.col(column)).isin(*values)


def alert_totals(alerts: DataFrame) -> DataFrame:
    return counters(
        alerts,
        critical=_is("severity", "critical"),
        high=_is("severity", "high"),
        open=_is("status", *rules.OPEN_ALERT_STATUSES),
    )


def incident_totals(incidents: DataFrame) -> DataFrame:
    return counters(
        incidents,
        critical=_is("severity", "critical"),
        high=_is("severity", "high"),
        waiting=_is("workflow_status", "waiting_for_human"),
    )


def report_totals(reports: DataFrame) -> DataFrame:
    return counters(
        reports,
        critical=_is("risk_level", "critical"),
        high=_is("risk_level", "high"),
        human_review=_is("human_review_status", "waiting_for_human", "pending"),
        anomalies=F.col("ml_is_anomaly"),
    )


def action_totals(actions: DataFrame) -> DataFrame:
    return counters(
        actions,
        pending=_is("status", "pending"),
        simulated=_is("status", "simulated"),
        executed=_is("status", "executed"),
        blocked=_is("status", "blocked_by_safety"),
    )


def analysis_totals(analyses: DataFrame) -> DataFrame:
    return counters(
        analyses,
        critical=_is("risk_level", "critical"),
        high=_is("risk_level", "high"),
        review_required=F.col("human_approval_required"),
        technique_valid=F.col("mitre_valid"),
    )


def request_totals(requests: DataFrame) -> DataFrame:
    """Requests per method, path and status, with summed latency."""
    return requests.groupBy("method", "path", "status_code").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("duration_s").alias("duration_sum")
    )


def trailing_rates(requests: DataFrame, window_minutes: int = 5, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """Request rate and mean latency over the trailing window, at every minute.

    Requests are first summed per minute, so what is repeated for the overlapping
    windows is one row per minute and not one per request.
    """
    keys = dict(keys or {})
    names = list(keys)
    minute = F.window("ts", "1 minute")
    per_minute = (
        requests.withColumns(keys)
        .groupBy(minute.alias("minute"), *names)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("duration_s").alias("s"))
    )
    first = F.col("minute.end")
    ends = F.sequence(first, first + F.expr(f"INTERVAL {window_minutes - 1} MINUTES"), F.expr("INTERVAL 1 MINUTE"))
    return (
        per_minute.select(F.explode(ends).alias("window_end"), "n", "s", *names)
        .groupBy("window_end", *names)
        .agg(F.sum("n").alias("requests"), F.sum("s").alias("duration_sum"))
        .withColumn("rate_per_second", F.col("requests") / (60.0 * window_minutes))
        .withColumn("mean_latency", F.col("duration_sum") / F.col("requests"))
    )


def audit_counts(events: DataFrame) -> DataFrame:
    """Security events per type and outcome."""
    return events.groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("events"))
