"""Filters, faceted text search and newest-first lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.functions.columns import norm
from duskwatch.functions.risk import severity_rank

# Fields each list page searches and the facets it offers.
ALERT_FIELDS = ("id", "title", "description", "source", "severity", "status")
ALERT_FACETS = ("severity", "status", "source")
INCIDENT_FIELDS = (
    "id", "title", "description", "source", "hostname", "source_ip", "destination_ip", "username", "assigned_to",
    "correlation_id", "workflow_status",
)
INCIDENT_FACETS = ("severity", "status", "source", "workflow_status")
REPORT_FIELDS = (
    "id", "incident_id", "ai_analysis_id", "thread_id", "title", "summary", "risk_level", "ml_prediction", "ml_engine",
    "mitre_technique", "mitre_name", "recommendation", "response_status", "human_review_status",
)
REPORT_FACETS = ("risk_level", "response_status", "human_review_status")
ACTION_FIELDS = ("id", "incident_id", "action_type", "target", "status")
ACTION_FACETS = ("status", "action_type")
ANALYSIS_FIELDS = (
    "id", "incident_id", "summary", "explanation", "recommendation", "risk_level", "mitre_technique", "mitre_name",
    "response_status", "human_review_status", "thread_id", "model_used",
)
ANALYSIS_FACETS = ("risk_level", "response_status", "human_review_status")


def faceted_search(df: DataFrame, fields: Sequence[str], text: str = "", facets: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with ``text`` in any field and every facet equal; 'all' turns a facet off.

    Fields the table does not carry are skipped.
    """
    wanted = text.strip().lower()
    if wanted:
        hits = F.lit(False)
        for f in fields:
            if f in df.columns:
                hits = hits | norm(F.col(f)).contains(wanted)
        df = df.filter(hits)
    for column, value in (facets or {}).items():
        if value != "all":
            df = df.filter(norm(F.col(column)) == value.strip().lower())
    return df


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-empty values of each facet column: ``facet, value``."""
    entries = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(entries)).filter(F.col("value") != "").distinct()


def with_workflow_status(incidents: DataFrame, status: str | None = None) -> DataFrame:
    """All incidents or those in one workflow state, newest id first."""
    if status is not None:
        incidents = incidents.filter(F.col("workflow_status") == status)
    return incidents.orderBy(F.desc("id"))


def of_incident(df: DataFrame, incident_id: int) -> DataFrame:
    """Analyses, reports or actions of one incident, newest id first."""
    return df.filter(F.col("incident_id") == incident_id).orderBy(F.desc("id"))


def retry_batch(incidents: DataFrame, size: int = rules.RETRY_BATCH) -> DataFrame:
    """Ids of the oldest rate-limited incidents."""
    return incidents.filter(F.col("workflow_status") == "rate_limited").select("id").orderBy("id").limit(size)


def newest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` newest rows by the given columns."""
    return df.orderBy(*[F.desc(c) for c in by]).limit(n)


def latest_analysis(analyses: DataFrame, *columns: str) -> DataFrame:
    """The analysis with the highest id of each incident."""
    keep = [c for c in (columns or analyses.columns) if c not in ("incident_id", "id")]
    best = F.max_by(F.struct("id", *keep), "id").alias("a")
    return analyses.groupBy("incident_id").agg(best).select("incident_id", F.col("a.id").alias("analysis_id"), *[f"a.{c}" for c in keep])


def incident_label(incident_id: Column) -> Column:
    """``INC-0042``; longer numbers are not cut."""
    digits = incident_id.cast("string")
    return F.concat(F.lit("INC-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def overview_search(incidents: DataFrame, analyses: DataFrame, text: str = "", n: int = 5) -> DataFrame:
    """Newest incidents whose label, text, network fields or latest technique contain ``text``."""
    joined = incidents.join(
        latest_analysis(analyses, "mitre_technique", "mitre_name").withColumnRenamed("incident_id", "id"), "id", "left"
    )
    wanted = text.strip().lower()
    if wanted:
        fields = (
            "title", "description", "source", "source_ip", "destination_ip", "hostname", "severity", "workflow_status",
            "mitre_technique", "mitre_name",
        )
        hits = F.lower(incident_label(F.col("id"))).contains(wanted)
        for f in fields:
            hits = hits | F.coalesce(F.lower(F.col(f)).contains(wanted), F.lit(False))
        joined = joined.filter(hits)
    return newest(joined, n, "detected_at", "id")


def latest_model_report(reports: DataFrame) -> DataFrame:
    """The newest successful report that has results of all three engines."""
    complete = (
        (F.col("ml_status") == "success")
        & F.col("random_forest_prediction").isNotNull()
        & F.col("xgboost_prediction").isNotNull()
        & F.col("isolation_forest_prediction").isNotNull()
    )
    return newest(reports.filter(complete), 1, "id")


def recent_techniques(analyses: DataFrame, n: int = 5) -> DataFrame:
    """Newest analysis of each valid technique, newest ``n``."""
    valid = F.col("mitre_valid") & (F.col("mitre_technique") != "") & (F.col("mitre_technique") != "UNKNOWN")
    best = F.max_by(F.struct("id", "incident_id", "mitre_name"), "id").alias("a")
    per_technique = analyses.filter(valid).groupBy("mitre_technique").agg(best).select("mitre_technique", "a.*")
    return newest(per_technique, n, "id")


def latest_traced_analysis(analyses: DataFrame, incidents: DataFrame) -> DataFrame:
    """The newest analysis with a stage trace, and its incident."""
    last = newest(analyses.filter(F.col("trace_length") > 0), 1, "id").select(
        F.col("id").alias("analysis_id"), "incident_id", "trace_length"
    )
    found = incidents.select(F.col("id").alias("incident_id"), "title", "severity")
    return last.join(found, "incident_id", "left")


def by_severity(df: DataFrame) -> DataFrame:
    """Critical, high, medium, low, then anything else."""
    return df.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank")


