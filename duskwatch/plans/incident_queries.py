"""Lists, searches, counters and metrics over the derived incident tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.functions.columns import micros
from duskwatch.operators import metrics, search
from duskwatch.plans import sqltext
from duskwatch.plans.catalog import query
from duskwatch.plans.views import oracle, view
from duskwatch.session import run_folder
from duskwatch.sources import sinks

_MTTD = "CASE WHEN detected_at >= event_timestamp THEN epoch_us(detected_at) - epoch_us(event_timestamp) END"
_MTTR = "CASE WHEN resolved_at >= detected_at THEN epoch_us(resolved_at) - epoch_us(detected_at) END"
_OPERATIONAL = f"""count(*) AS total_incidents, count({_MTTD}) AS incidents_with_mttd, count({_MTTR}) AS incidents_with_mttr,
  avg({_MTTD}) / 1e6 AS average_mttd_seconds, avg({_MTTR}) / 1e6 AS average_mttr_seconds"""
_QUALITY = """count(*) FILTER (WHERE disposition IS DISTINCT FROM 'unknown') AS reviewed_incidents,
  count(*) FILTER (WHERE disposition = 'false_positive') AS false_positive_count,
  count(*) FILTER (WHERE disposition = 'true_positive') AS true_positive_count,
  count(*) FILTER (WHERE disposition = 'false_positive') / nullif(count(*) FILTER (WHERE disposition IS DISTINCT FROM 'unknown'), 0) * 100
    AS false_positive_rate"""
_SEVERITIES = ", ".join(f"count(*) FILTER (WHERE lower(severity) = '{s}') AS severity_{s}" for s in rules.SEVERITIES)


def _search_sql(source: str, fields, text: str, facets: dict[str, str], out: str) -> str:
    hits = " OR ".join(f"contains({sqltext.norm(f)}, {sqltext.quoted(text)})" for f in fields)
    conds = [f"({hits})"] + [f"{sqltext.norm(c)} = {sqltext.quoted(v)}" for c, v in facets.items() if v != "all"]
    return oracle(source, f"SELECT {out} FROM {source} WHERE {' AND '.join(conds)}")


def _register_search(name: str, source: str, fields, text: str, facets: dict[str, str], out: list[str], skip=()) -> None:
    usable = [f for f in fields if f not in skip]

    @query(name, _search_sql(source, usable, text, facets, ", ".join(out)))
    def run(spark, sf_dir):
        return search.faceted_search(view(spark, sf_dir, source), fields, text, facets).select(*out)


_register_search(
    "alert_search", "alerts_v", search.ALERT_FIELDS, "value 1", {"severity": "medium", "status": "all", "source": "wazuh"},
    ["id", "title", "description", "source", "severity", "status"],
)
_register_search(
    "incident_search", "incidents_v", search.INCIDENT_FIELDS, "10.0.0.3",
    {"severity": "high", "status": "open", "source": "all", "workflow_status": "completed"},
    ["id", "title", "description", "severity", "source"], skip=("assigned_to", "correlation_id"),
)
_register_search(
    "report_search", "report_v", search.REPORT_FIELDS, "t10", {"risk_level": "high", "response_status": "all", "human_review_status": "pending"},
    ["id", "incident_id", "title", "risk_level", "mitre_technique"],
)
_register_search(
    "action_search", "action_v", search.ACTION_FIELDS, "10.0.1", {"status": "pending", "action_type": "all"},
    ["id", "incident_id", "action_type", "target"],
)
_register_search(
    "analysis_search", "analysis_v", search.ANALYSIS_FIELDS, "technique 1",
    {"risk_level": "all", "response_status": "blocked", "human_review_status": "rejected"},
    ["id", "incident_id", "risk_level", "mitre_name"],
)


@query("incident_list", oracle("incidents_v", "SELECT id, title, workflow_status FROM incidents_v WHERE workflow_status = 'waiting_for_human'"))
def incident_list(spark, sf_dir):
    return search.with_workflow_status(view(spark, sf_dir, "incidents_v"), "waiting_for_human").select("id", "title", "workflow_status")


_LATEST = """latest AS (SELECT incident_id, max(id) AS analysis_id, arg_max(coalesce(mitre_technique, '~'), id) AS technique,
  arg_max(coalesce(mitre_name, '~'), id) AS name FROM analysis_v GROUP BY incident_id)"""


@query(
    "overview_search",
    oracle("incidents_v analysis_v", "").rstrip()
    + f""", {_LATEST}
    SELECT i.id, i.title, nullif(l.technique, '~') AS mitre_technique FROM incidents_v i LEFT JOIN latest l ON l.incident_id = i.id
    WHERE contains(lower('INC-' || CASE WHEN i.id < 1000 THEN lpad(CAST(i.id AS VARCHAR), 4, '0') ELSE CAST(i.id AS VARCHAR) END), '101')
      OR contains(lower(i.title), '101') OR contains(lower(i.description), '101') OR contains(lower(i.source), '101')
      OR contains(lower(coalesce(i.source_ip, '')), '101') OR contains(lower(coalesce(i.destination_ip, '')), '101')
      OR contains(lower(coalesce(i.hostname, '')), '101') OR contains(lower(i.severity), '101') OR contains(lower(i.workflow_status), '101')
      OR contains(lower(coalesce(l.technique, '')), '101') OR contains(lower(coalesce(l.name, '')), '101')
    ORDER BY i.detected_at DESC, i.id DESC LIMIT 5""",
)
def overview_search(spark, sf_dir):
    found = search.overview_search(view(spark, sf_dir, "incidents_v"), view(spark, sf_dir, "analysis_v"), "101")
    return found.select("id", "title", "mitre_technique")


@query(
    "latest_analysis",
    oracle("analysis_v", """SELECT a.incident_id, a.id AS analysis_id, a.risk_level, a.mitre_technique FROM analysis_v a
      JOIN (SELECT incident_id, max(id) AS id FROM analysis_v GROUP BY incident_id) m USING (incident_id, id)"""),
)
def latest_analysis(spark, sf_dir):
    return search.latest_analysis(view(spark, sf_dir, "analysis_v"), "risk_level", "mitre_technique")


@query("retry_batch", oracle("incidents_v", "SELECT id FROM incidents_v WHERE workflow_status = 'rate_limited' ORDER BY id LIMIT 5"))
def retry_batch(spark, sf_dir):
    return search.retry_batch(view(spark, sf_dir, "incidents_v"))


@query("reports_of_incident", oracle("report_v", "SELECT id, incident_id, title FROM report_v WHERE incident_id = 7"))
def reports_of_incident(spark, sf_dir):
    return search.of_incident(view(spark, sf_dir, "report_v"), 7).select("id", "incident_id", "title")


@query("facet_values", oracle("incidents_v", "\nUNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM incidents_v WHERE {c} <> ''" for c in search.INCIDENT_FACETS)))
def facet_values(spark, sf_dir):
    return search.facet_values(view(spark, sf_dir, "incidents_v"), search.INCIDENT_FACETS)


def _register_newest(name: str, source: str, n: int, by: list[str], out: list[str]) -> None:
    order = ", ".join(f"{c} DESC" for c in by)

    @query(name, oracle(source, f"SELECT {', '.join(out)} FROM {source} ORDER BY {order} LIMIT {n}"))
    def run(spark, sf_dir):
        return search.newest(view(spark, sf_dir, source), n, *by).select(*out)


_register_newest("recent_incidents", "incidents_v", 5, ["detected_at", "id"], ["id", "title", "severity"])
_register_newest("recent_alerts", "alerts_v", 5, ["created_at", "id"], ["id", "title", "severity"])
_register_newest("recent_actions", "action_v", 4, ["created_at", "id"], ["id", "action_type", "target"])
_register_newest("recent_reports", "report_v", 4, ["id"], ["id", "title", "risk_level"])


@query(
    "latest_model_report",
    oracle("report_v", """SELECT id, incident_id, ml_prediction, ml_engine FROM report_v WHERE ml_status = 'success'
      AND random_forest_prediction IS NOT NULL AND xgboost_prediction IS NOT NULL AND isolation_forest_prediction IS NOT NULL
      ORDER BY id DESC LIMIT 1"""),
)
def latest_model_report(spark, sf_dir):
    return search.latest_model_report(view(spark, sf_dir, "report_v")).select("id", "incident_id", "ml_prediction", "ml_engine")


@query(
    "recent_techniques",
    oracle("analysis_v", """SELECT mitre_technique, max(id) AS id, arg_max(incident_id, id) AS incident_id, arg_max(mitre_name, id) AS mitre_name
      FROM analysis_v WHERE mitre_valid AND mitre_technique <> '' AND mitre_technique <> 'UNKNOWN'
      GROUP BY mitre_technique ORDER BY 2 DESC LIMIT 5"""),
)
def recent_techniques(spark, sf_dir):
    return search.recent_techniques(view(spark, sf_dir, "analysis_v"))


@query(
    "latest_traced_analysis",
    oracle("analysis_v incidents_v", """SELECT a.id AS analysis_id, a.incident_id, a.trace_length, i.title, i.severity FROM analysis_v a
      LEFT JOIN incidents_v i ON i.id = a.incident_id WHERE a.trace_length > 0 ORDER BY a.id DESC LIMIT 1"""),
)
def latest_traced_analysis(spark, sf_dir):
    return search.latest_traced_analysis(view(spark, sf_dir, "analysis_v"), view(spark, sf_dir, "incidents_v"))


@query(
    "severity_order",
    oracle("alerts_v", f"""SELECT severity, {sqltext.severity_rank("severity")} AS severity_rank, count(*) AS alerts FROM alerts_v GROUP BY ALL"""),
)
def severity_order(spark, sf_dir):
    counted = view(spark, sf_dir, "alerts_v").groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))
    return search.by_severity(counted)


@query("incident_times", oracle("incidents_v", f"SELECT id, ({_MTTD}) / 1e6 AS mttd_seconds, ({_MTTR}) / 1e6 AS mttr_seconds FROM incidents_v"))
def incident_times(spark, sf_dir):
    return metrics.incident_times(view(spark, sf_dir, "incidents_v"))


@query("global_metrics", oracle("incidents_v", f"SELECT {_OPERATIONAL} FROM incidents_v"))
def global_metrics(spark, sf_dir):
    return metrics.global_metrics(view(spark, sf_dir, "incidents_v"))


@query("quality_metrics", oracle("incidents_v", f"SELECT {_QUALITY} FROM incidents_v"))
def quality_metrics(spark, sf_dir):
    return metrics.quality_metrics(view(spark, sf_dir, "incidents_v"))


@query(
    "severity_distribution",
    oracle("incidents_v", f"""SELECT s.severity, count(i.id) AS incidents FROM (VALUES {", ".join(f"('{s}')" for s in rules.SEVERITIES)}) s(severity)
      LEFT JOIN incidents_v i ON lower(i.severity) = s.severity GROUP BY s.severity"""),
)
def severity_distribution(spark, sf_dir):
    return metrics.severity_distribution(view(spark, sf_dir, "incidents_v"))


@query("dashboard", oracle("incidents_v", f"SELECT {_OPERATIONAL}, {_QUALITY}, {_SEVERITIES} FROM incidents_v"))
def dashboard(spark, sf_dir):
    return metrics.dashboard(view(spark, sf_dir, "incidents_v"))


_PLAIN_GAUGES = (
    "total_incidents incidents_with_mttd incidents_with_mttr average_mttd_seconds average_mttr_seconds "
    "reviewed_incidents false_positive_count true_positive_count false_positive_rate"
).split()


@query(
    "gauges",
    oracle("incidents_v", "")
    + f""", board AS (SELECT {_OPERATIONAL}, {_QUALITY}, {_SEVERITIES} FROM incidents_v)
    """
    + " UNION ALL ".join(
        [f"SELECT '{g}' AS metric, '' AS label, coalesce(CAST({g} AS DOUBLE), 'NaN'::DOUBLE) AS value FROM board" for g in _PLAIN_GAUGES]
        + [f"SELECT 'incidents_by_severity', '{s}', CAST(severity_{s} AS DOUBLE) FROM board" for s in rules.SEVERITIES]
    ),
)
def gauges(spark, sf_dir):
    return metrics.gauges(view(spark, sf_dir, "incidents_v"))


def _totals_sql(source: str, **conds: str) -> str:
    parts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in conds.items())
    return oracle(source, f"SELECT count(*) AS total, {parts} FROM {source}")


def _in(column: str, *values: str) -> str:
    return f"{sqltext.norm(column)} IN ({sqltext.text_list(values)})"


@query(
    "alert_totals",
    _totals_sql("alerts_v", critical=_in("severity", "critical"), high=_in("severity", "high"), open=_in("status", *rules.OPEN_ALERT_STATUSES)),
)
def alert_totals(spark, sf_dir):
    return metrics.alert_totals(view(spark, sf_dir, "alerts_v"))


@query(
    "incident_totals",
    _totals_sql("incidents_v", critical=_in("severity", "critical"), high=_in("severity", "high"), waiting=_in("workflow_status", "waiting_for_human")),
)
def incident_totals(spark, sf_dir):
    return metrics.incident_totals(view(spark, sf_dir, "incidents_v"))


@query(
    "report_totals",
    _totals_sql("report_v", critical=_in("risk_level", "critical"), high=_in("risk_level", "high"),
                human_review=_in("human_review_status", "waiting_for_human", "pending"), anomalies="ml_is_anomaly"),
)
def report_totals(spark, sf_dir):
    return metrics.report_totals(view(spark, sf_dir, "report_v"))


@query(
    "action_totals",
    _totals_sql("action_v", pending=_in("status", "pending"), simulated=_in("status", "simulated"),
                executed=_in("status", "executed"), blocked=_in("status", "blocked_by_safety")),
)
def action_totals(spark, sf_dir):
    return metrics.action_totals(view(spark, sf_dir, "action_v"))


@query(
    "analysis_totals",
    _totals_sql("analysis_v", critical=_in("risk_level", "critical"), high=_in("risk_level", "high"),
                review_required="human_approval_required", technique_valid="mitre_valid"),
)
def analysis_totals(spark, sf_dir):
    return metrics.analysis_totals(view(spark, sf_dir, "analysis_v"))


@query(
    "request_totals",
    oracle("request_log_v", """SELECT method, path, status_code, count(*) AS requests, round(sum(duration_s), 6) AS duration_sum
      FROM request_log_v GROUP BY ALL"""),
)
def request_totals(spark, sf_dir):
    return metrics.request_totals(view(spark, sf_dir, "request_log_v")).withColumn("duration_sum", F.round("duration_sum", 6))


@query(
    "trailing_rates",
    oracle("request_log_v", """SELECT epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) + 60000000 * (k.k + 1) AS window_end_us, count(*) AS requests,
      round(count(*) / 300.0, 9) AS rate_per_second, round(sum(duration_s) / count(*), 9) AS mean_latency
      FROM request_log_v, (VALUES (0), (1), (2), (3), (4)) k(k) GROUP BY 1"""),
)
def trailing_rates(spark, sf_dir):
    return metrics.trailing_rates(view(spark, sf_dir, "request_log_v")).select(
        micros(F.col("window_end")).alias("window_end_us"),
        "requests",
        F.round("rate_per_second", 9).alias("rate_per_second"),
        F.round("mean_latency", 9).alias("mean_latency"),
    )


@query("audit_counts", oracle("audit_v", "SELECT event_type, outcome, count(*) AS events FROM audit_v GROUP BY ALL"))
def audit_counts(spark, sf_dir):
    return metrics.audit_counts(view(spark, sf_dir, "audit_v"))


# --- inserts with defaults, read back -----------------------------------------
@query("stored_incidents", oracle("incidents_v", "SELECT id, CASE WHEN id % 2 = 0 THEN severity ELSE 'medium' END AS severity, 'open' AS status, 'unknown' AS disposition, 'pending' AS workflow_status FROM incidents_v"))
def stored_incidents(spark, sf_dir):
    path = run_folder(spark, "incidents")
    rows = view(spark, sf_dir, "incidents_v").select("id", "title", F.when(F.col("id") % 2 == 0, F.col("severity")).alias("severity"))
    sinks.append_incidents(rows, path)
    return spark.read.parquet(path).select("id", "severity", "status", "disposition", "workflow_status")


@query("stored_alerts", oracle("alerts_v", "SELECT id, CASE WHEN id % 3 = 0 THEN 'medium' ELSE severity END AS severity, CASE WHEN id % 2 = 0 THEN 'new' ELSE status END AS status FROM alerts_v"))
def stored_alerts(spark, sf_dir):
    path = run_folder(spark, "alerts")
    severity, status = F.when(F.col("id") % 3 != 0, F.col("severity")), F.when(F.col("id") % 2 != 0, F.col("status"))
    sinks.append_alerts(view(spark, sf_dir, "alerts_v").select("id", "title", severity.alias("severity"), status.alias("status")), path)
    return spark.read.parquet(path).select("id", "severity", "status")


@query("stored_analyses", oracle("analysis_v", "SELECT id, incident_id, coalesce(mitre_valid AND id % 2 = 0, FALSE) AS mitre_valid, FALSE AS human_approval_required, 0 AS correlated_incident_count FROM analysis_v"))
def stored_analyses(spark, sf_dir):
    path = run_folder(spark, "analyses")
    valid = F.when(F.col("id") % 2 == 0, F.col("mitre_valid"))
    sinks.append_analyses(view(spark, sf_dir, "analysis_v").select("id", "incident_id", "summary", valid.alias("mitre_valid")), path)
    return spark.read.parquet(path).select("id", "incident_id", "mitre_valid", "human_approval_required", "correlated_incident_count")


@query("stored_reports", oracle("report_v", "SELECT id, incident_id, title, ml_status, 0 AS correlated_incident_count FROM report_v"))
def stored_reports(spark, sf_dir):
    path = run_folder(spark, "reports")
    sinks.append_reports(view(spark, sf_dir, "report_v").select("id", "incident_id", "title", "ml_status"), path)
    return spark.read.parquet(path).select("id", "incident_id", "title", "ml_status", "correlated_incident_count")
