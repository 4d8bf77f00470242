"""Response, workflow-state and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions import risk, rules
from duskwatch.functions.net import is_blockable_ip
from duskwatch.operators import correlate, lifecycle, response, responses, search
from duskwatch.operators.enrich import validate_techniques
from duskwatch.plans import sqltext
from duskwatch.plans.catalog import query
from duskwatch.plans.correlation_queries import _LABEL_CTES, _labelled
from duskwatch.plans.views import oracle, oracle_ctes, view
from duskwatch.session import cut_lineage, run_folder
from duskwatch.sources import committed, sinks


def _cases(spark, sf_dir):
    """Incidents with their latest analysis."""
    latest = search.latest_analysis(view(spark, sf_dir, "analysis_v"), "risk_level", "recommendation", "summary", "mitre_technique", "mitre_name")
    return view(spark, sf_dir, "incidents_v").withColumnRenamed("id", "incident_id").join(latest, "incident_id")


_HIGH = "('high', 'critical')"
_CASES = """last AS (SELECT incident_id, max(id) AS id FROM analysis_v GROUP BY incident_id),
cases AS (SELECT i.id AS incident_id, i.title, i.description, i.severity, i.hostname, i.source_ip, i.username, a.risk_level, a.recommendation, a.summary,
    lower(trim(i.severity)) IN ('high', 'critical') OR lower(trim(a.risk_level)) IN ('high', 'critical') AS high
  FROM incidents_v i JOIN last l ON l.incident_id = i.id JOIN analysis_v a ON a.id = l.id),
decided AS (SELECT c.*, d.approved AS human_approved, d.comment FROM cases c LEFT JOIN decision_v d USING (incident_id)),
answered AS (SELECT *, CASE WHEN high THEN coalesce(human_approved, FALSE) ELSE TRUE END AS ok FROM decided)"""
_BANNED = {k: sqltext.text_list(rules.UNUSABLE_TARGETS + rules.UNUSABLE_BY_KIND[k]) for k in rules.UNUSABLE_BY_KIND}
_V4 = r"'^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$'"


def _safe_ip(c: str) -> str:
    return (
        f"(coalesce(regexp_matches(trim({c}), {_V4}), FALSE) AND NOT starts_with(trim({c}), '127.') AND trim({c}) <> '0.0.0.0' "
        f"AND NOT coalesce(TRY_CAST(split_part(trim({c}), '.', 1) AS INT) BETWEEN 224 AND 239, FALSE))"
    )


def _safe_sql(kind: str, target: str) -> str:
    return f"""CASE {kind} WHEN 'isolate_endpoint' THEN {sqltext.norm(target)} NOT IN ({_BANNED["isolate_endpoint"]}) WHEN 'block_ip' THEN {_safe_ip(target)}
      WHEN 'disable_user' THEN {sqltext.norm(target)} NOT IN ({_BANNED["disable_user"]}) ELSE TRUE END"""


_ACTIONS = f"""wanted AS (SELECT *, lower(recommendation) AS r FROM answered),
kinds AS (SELECT *, CASE WHEN contains(r, 'isolate') THEN 'isolate_endpoint' WHEN contains(r, 'block') AND contains(r, 'ip') THEN 'block_ip'
  WHEN contains(r, 'disable') AND (contains(r, 'user') OR contains(r, 'account')) THEN 'disable_user'
  WHEN contains(r, 'notify') OR contains(r, 'notification') THEN 'send_notification' ELSE 'create_ticket' END AS kind FROM wanted),
candidates AS (SELECT *, CASE kind WHEN 'isolate_endpoint' THEN hostname WHEN 'block_ip' THEN source_ip WHEN 'disable_user' THEN username
  WHEN 'send_notification' THEN 'soc-team' ELSE coalesce(hostname, 'incident-' || incident_id) END AS cand FROM kinds),
judged AS (SELECT *, CASE kind WHEN 'isolate_endpoint' THEN {sqltext.norm("cand")} NOT IN ({_BANNED["isolate_endpoint"]}) WHEN 'block_ip' THEN {_safe_ip("cand")}
  ELSE cand IS NOT NULL END AS usable FROM candidates),
proposed AS (SELECT *, CASE WHEN usable THEN kind ELSE 'create_ticket' END AS action_type,
  CASE WHEN usable THEN cand ELSE coalesce(hostname, 'incident-' || incident_id) END AS target FROM judged)"""
_SOURCES = "incidents_v analysis_v decision_v"


@query(
    "route_by_risk",
    oracle_ctes(_SOURCES, _CASES, "SELECT incident_id, CASE WHEN high THEN 'human_review' ELSE 'response' END AS next_stage FROM cases"),
)
def route_by_risk(spark, sf_dir):
    return response.route_by_risk(_cases(spark, sf_dir)).select("incident_id", "next_stage")


@query(
    "route_by_approval",
    oracle_ctes(_SOURCES, _CASES, "SELECT incident_id, human_approved, CASE WHEN human_approved THEN 'response' ELSE 'report' END AS next_stage FROM decided WHERE high"),
)
def route_by_approval(spark, sf_dir):
    reviewed = response.route_by_risk(_cases(spark, sf_dir)).filter(F.col("next_stage") == "human_review")
    return response.route_by_approval(reviewed, view(spark, sf_dir, "decision_v")).select("incident_id", "human_approved", "next_stage")


def _answered(spark, sf_dir):
    return response.respond(response.route_by_approval(_cases(spark, sf_dir), view(spark, sf_dir, "decision_v")))


@query(
    "responses",
    oracle_ctes(_SOURCES, _CASES, """SELECT incident_id, recommendation, lower(trim(risk_level)) AS analysed_risk, FALSE AS automatic_execution,
      high AS human_approval_required, ok AS response_approved, CASE WHEN ok THEN 'approved_for_response' ELSE 'blocked' END AS response_status FROM answered"""),
)
def respond(spark, sf_dir):
    return _answered(spark, sf_dir).select(
        "incident_id", "recommendation", "analysed_risk", "automatic_execution", "human_approval_required", "response_approved", "response_status"
    )


@query("propose_actions", oracle_ctes(_SOURCES, f"{_CASES}, {_ACTIONS}", "SELECT incident_id, action_type, target FROM proposed WHERE ok"))
def propose_actions(spark, sf_dir):
    return response.propose_actions(_answered(spark, sf_dir).filter("response_approved")).select("incident_id", "action_type", "target")


_STORED = "stored AS (SELECT incident_id, action_type, target, high AS requires_approval FROM proposed WHERE ok)"


@query(
    "store_actions_once",
    oracle_ctes(_SOURCES + " action_v", f"{_CASES}, {_ACTIONS}, {_STORED}", """SELECT s.incident_id, s.action_type, s.target, 'approved' AS status, s.requires_approval, TRUE AS approved
      FROM stored s WHERE NOT EXISTS (SELECT 1 FROM action_v a WHERE a.incident_id = s.incident_id AND a.action_type = s.action_type AND a.target = s.target)"""),
)
def store_actions_once(spark, sf_dir):
    rows = response.stored_actions(_answered(spark, sf_dir))
    return sinks.unstored(rows, view(spark, sf_dir, "action_v"), ["incident_id", "action_type", "target"])


@query(
    "store_actions_committed",
    oracle_ctes(_SOURCES, f"{_CASES}, {_ACTIONS}, {_STORED}", "SELECT incident_id, action_type, target, requires_approval FROM stored"),
)
def store_actions_committed(spark, sf_dir):
    """Actions appended by a run that saw only those that need no approval, by one that saw all, and by a rerun: the table holds each once."""
    path = run_folder(spark, "actions")
    rows = cut_lineage(response.stored_actions(_answered(spark, sf_dir)).select("incident_id", "action_type", "target", "requires_approval"))
    for batch in (rows.filter("NOT requires_approval"), rows, rows):
        committed.append_committed(batch, path, ["incident_id", "action_type", "target"])
    stored = committed.read_committed(spark, path)
    return rows if stored is None else stored


@query(
    "action_creation_log",
    oracle_ctes(_SOURCES, f"{_CASES}, {_ACTIONS}, {_STORED}", """SELECT incident_id, action_type, target, 'created' AS event_type, NULL::VARCHAR AS previous_status, 'pending' AS new_status FROM stored
      UNION ALL SELECT incident_id, action_type, target, 'approved', 'pending', 'approved' FROM stored"""),
)
def action_creation_log(spark, sf_dir):
    return response.creation_log(response.stored_actions(_answered(spark, sf_dir)))


_DECIDE = f"""decided AS (SELECT a.*, d.approved AS decision, {_safe_sql("a.action_type", "a.target")} AS safe FROM action_v a LEFT JOIN decision_v d USING (incident_id)),
settled AS (SELECT *, CASE WHEN decision IS NULL THEN status WHEN NOT decision THEN 'rejected' WHEN NOT safe THEN 'blocked_by_safety' ELSE 'approved' END AS new_status,
  CASE WHEN decision IS NULL THEN approved ELSE decision AND safe END AS new_approved FROM decided)"""


@query("decide_actions", oracle_ctes("action_v decision_v", _DECIDE, "SELECT id, incident_id, new_status, new_approved FROM settled"))
def decide_actions(spark, sf_dir):
    return response.decide_actions(view(spark, sf_dir, "action_v"), view(spark, sf_dir, "decision_v")).select("id", "incident_id", "new_status", "new_approved")


@query(
    "action_transition_log",
    oracle_ctes("action_v decision_v", _DECIDE, """SELECT id AS action_id, incident_id, new_status AS event_type, status AS previous_status, new_status
      FROM settled WHERE new_status IS DISTINCT FROM status"""),
)
def action_transition_log(spark, sf_dir):
    decided = response.decide_actions(view(spark, sf_dir, "action_v"), view(spark, sf_dir, "decision_v"))
    return response.transition_log(decided)


@query(
    "execution_outcomes",
    oracle("action_v", f"""SELECT id, CASE WHEN requires_approval AND approved IS DISTINCT FROM TRUE THEN 'approval_required'
      WHEN NOT ({_safe_sql("action_type", "target")}) THEN 'blocked_by_safety'
      WHEN {sqltext.norm("target")} = '' OR (action_type = 'send_notification' AND {sqltext.norm("target")} IN ({_BANNED["send_notification"]})) THEN 'execution_failed'
      ELSE 'simulated' END AS outcome FROM action_v"""),
)
def execution_outcomes(spark, sf_dir):
    return response.execution_outcomes(view(spark, sf_dir, "action_v")).select("id", "outcome")


@query(
    "target_safety",
    oracle("action_v", f"""SELECT id, {_safe_ip("target")} AS ip_ok, {sqltext.norm("target")} NOT IN ({_BANNED["isolate_endpoint"]}) AS endpoint_ok,
      {sqltext.norm("target")} NOT IN ({_BANNED["disable_user"]}) AS user_ok, {sqltext.norm("target")} NOT IN ({_BANNED["send_notification"]}) AS notify_ok FROM action_v"""),
)
def target_safety(spark, sf_dir):
    t = F.col("target")
    return view(spark, sf_dir, "action_v").select(
        "id",
        is_blockable_ip(t).alias("ip_ok"),
        risk.usable_target(t, "isolate_endpoint").alias("endpoint_ok"),
        risk.usable_target(t, "disable_user").alias("user_ok"),
        risk.usable_target(t, "send_notification").alias("notify_ok"),
    )


@query(
    "actions_with_incident",
    oracle("action_v incidents_v", "SELECT id, incident_id, action_type FROM action_v a WHERE EXISTS (SELECT 1 FROM incidents_v i WHERE i.id = a.incident_id)"),
)
def actions_with_incident(spark, sf_dir):
    known = view(spark, sf_dir, "incidents_v").select(F.col("id").alias("incident_id"))
    return view(spark, sf_dir, "action_v").join(known, "incident_id", "left_semi").select("id", "incident_id", "action_type")


@query(
    "action_history",
    oracle("action_log_v", """SELECT id, action_id, event_type, previous_status, new_status, lag(new_status) OVER w AS before,
      lag(new_status) OVER w IS NOT DISTINCT FROM previous_status AS consistent FROM action_log_v WINDOW w AS (PARTITION BY action_id ORDER BY id)"""),
)
def action_history(spark, sf_dir):
    return lifecycle.action_history(view(spark, sf_dir, "action_log_v")).select(
        "id", "action_id", "event_type", "previous_status", "new_status", "before", "consistent"
    )


@query(
    "resolved_times",
    oracle_ctes("status_change_v", """seq AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY changed_at, change_id) AS rn
        FROM status_change_v WHERE status IS NOT NULL AND status <> ''),
      open_at AS (SELECT incident_id, coalesce(max(rn) FILTER (WHERE status NOT IN ('resolved', 'closed')), 0) AS rn, arg_max(status, rn) AS status FROM seq GROUP BY incident_id)""",
    """SELECT o.incident_id, epoch_us(min(s.changed_at) FILTER (WHERE s.rn > o.rn)) AS resolved_us, o.status FROM open_at o JOIN seq s USING (incident_id) GROUP BY o.incident_id, o.status"""),
)
def resolved_times(spark, sf_dir):
    return lifecycle.resolved_times(view(spark, sf_dir, "status_change_v"))


@query(
    "workflow_states",
    oracle("workflow_event_v", "SELECT incident_id, arg_max(workflow_status, (changed_at, event_id)) AS workflow_status FROM workflow_event_v GROUP BY incident_id"),
)
def workflow_states(spark, sf_dir):
    return lifecycle.latest_states(view(spark, sf_dir, "workflow_event_v"))


@query(
    "workflow_transitions",
    oracle("workflow_event_v", """SELECT from_status, to_status, count(*) AS moves FROM (SELECT coalesce(lag(workflow_status) OVER (PARTITION BY incident_id ORDER BY event_id), 'pending') AS from_status,
      workflow_status AS to_status FROM workflow_event_v) m GROUP BY ALL"""),
)
def workflow_transitions(spark, sf_dir):
    return lifecycle.transition_counts(view(spark, sf_dir, "workflow_event_v"))


@query(
    "retry_cycle",
    oracle_ctes("incidents_v", """batch AS (SELECT id FROM incidents_v WHERE workflow_status = 'rate_limited' ORDER BY id LIMIT 5),
      tried AS (SELECT b.id, CASE i.severity WHEN 'low' THEN 'completed' WHEN 'medium' THEN 'rate_limited' ELSE 'failed' END AS outcome FROM batch b JOIN incidents_v i USING (id))""",
    "SELECT id, outcome FROM tried t WHERE NOT EXISTS (SELECT 1 FROM tried e WHERE e.id < t.id AND e.outcome = 'rate_limited')"),
)
def retry_cycle(spark, sf_dir):
    incidents = view(spark, sf_dir, "incidents_v")
    outcome = F.when(F.col("severity") == "low", "completed").when(F.col("severity") == "medium", "rate_limited").otherwise("failed")
    return lifecycle.retry_cycle(search.retry_batch(incidents), incidents.select("id", outcome.alias("outcome")))


@query(
    "run_end_states",
    oracle("incidents_v", """SELECT id, CASE WHEN workflow_status = 'rate_limited' THEN 'rate_limited' WHEN severity = 'critical' AND status = 'open' THEN 'failed'
      WHEN workflow_status = 'waiting_for_human' THEN 'waiting_for_human' ELSE 'completed' END AS workflow_status FROM incidents_v"""),
)
def run_end_states(spark, sf_dir):
    """The state in which a run ends, by its failure (if any) and whether it waits for a person."""
    limited = F.col("workflow_status") == "rate_limited"
    failure = F.when(limited, "rate_limit").when((F.col("severity") == "critical") & (F.col("status") == "open"), "error")
    state = lifecycle.run_state(failure, F.col("workflow_status") == "waiting_for_human")
    return view(spark, sf_dir, "incidents_v").select("id", state.alias("workflow_status"))


@query("stage_traces", oracle("stage_v", "SELECT incident_id, string_agg(stage, ' > ' ORDER BY seq) AS agent_trace FROM (SELECT DISTINCT incident_id, seq, stage FROM stage_v) s GROUP BY incident_id"))
def stage_traces(spark, sf_dir):
    return lifecycle.stage_traces(view(spark, sf_dir, "stage_v")).withColumn("agent_trace", F.array_join("agent_trace", " > "))


# --- analysis responses ----------------------------------------------------
def _q(text: str) -> str:
    return sqltext.quoted(text)


_TECH = sqltext.keyword_case(sqltext.joined("title", "description"), rules.TECHNIQUE_FALLBACKS, "")
_EXPL = f"CASE WHEN has_intel THEN {_q(rules.EXPLANATION_WITH_INTEL)} ELSE {_q(rules.EXPLANATION_PLAIN)} END"
_SEVERITY_RISK = "CASE severity WHEN 'informational' THEN 'low' WHEN 'High' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'medium' END"


@query(
    "normalise_responses",
    oracle("response_v", f"""SELECT incident_id, CASE kind WHEN 2 THEN 'incomplete' WHEN 3 THEN 'unparsed' ELSE 'ok' END AS parse_state,
      CASE kind WHEN 0 THEN 'S ' || event_type WHEN 1 THEN {_q(rules.SUMMARY_PREFIX)} || title || '. ' || description WHEN 2 THEN {_q(rules.INCOMPLETE_ANALYSIS["summary"])}
        WHEN 3 THEN {_q(rules.UNPARSED_ANALYSIS["summary"])} WHEN 4 THEN 'a b' ELSE 'x' END AS summary,
      CASE kind WHEN 0 THEN 'high' WHEN 1 THEN {_SEVERITY_RISK} WHEN 4 THEN 'critical' ELSE 'medium' END AS risk_level,
      CASE kind WHEN 0 THEN 'E' WHEN 1 THEN {_EXPL} WHEN 2 THEN {_q(rules.INCOMPLETE_ANALYSIS["explanation"])} WHEN 3 THEN {_q(rules.UNPARSED_ANALYSIS["explanation"])}
        WHEN 4 THEN '{{"k": "v"}}' ELSE {_EXPL} END AS explanation,
      CASE kind WHEN 0 THEN 'R' WHEN 1 THEN '1. first' || chr(10) || '2. second' WHEN 4 THEN '1. step: do it' WHEN 5 THEN {_q(rules.RECOMMENDATION_DEFAULT)}
        ELSE {_q(rules.FALLBACK_RECOMMENDATION)} END AS recommendation,
      CASE kind WHEN 0 THEN 'T1000 - x' WHEN 1 THEN {_TECH} WHEN 4 THEN {_TECH} WHEN 5 THEN 'T2' ELSE 'Unknown' END AS mitre_technique FROM response_v"""),
)
def normalise_responses(spark, sf_dir):
    rows = view(spark, sf_dir, "response_v").drop("kind", "event_type")
    return responses.normalise_responses(rows).drop("title", "description", "severity", "has_intel")


@query(
    "risk_synonyms",
    oracle("response_v", f"SELECT incident_id, {_SEVERITY_RISK} AS risk FROM response_v"),
)
def risk_synonyms(spark, sf_dir):
    return view(spark, sf_dir, "response_v").select("incident_id", risk.normal_risk(F.col("severity"), F.lit(None)).alias("risk"))


@query("fallback_technique", oracle("response_v", f"SELECT incident_id, {_TECH} AS technique FROM response_v"))
def fallback_technique(spark, sf_dir):
    return view(spark, sf_dir, "response_v").select("incident_id", risk.fallback_technique(F.col("title"), F.col("description")).alias("technique"))


# --- reports and stored analyses -------------------------------------------
def _report_inputs(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    marked = correlate.mark_correlated(labelled).filter("is_primary").drop("primary_id", "is_primary")
    groups = correlate.correlation_summary(labelled)
    analyses = search.latest_analysis(view(spark, sf_dir, "analysis_v"), "risk_level", "recommendation", "summary", "mitre_technique", "thread_id").drop("analysis_id")
    looked_up = validate_techniques(analyses.select("incident_id", "mitre_technique"), view(spark, sf_dir, "technique_v")).select(
        "incident_id", "technique_id", F.col("name").alias("technique_name"), F.col("valid").alias("technique_valid")
    )
    ml = view(spark, sf_dir, "report_v").groupBy("incident_id").agg(
        F.max_by(F.struct("ml_status", "ml_prediction", "ml_engine", "ml_is_anomaly", "ml_anomaly_score", "ml_probabilities"), "id").alias("m")
    ).select("incident_id", "m.*")
    traces = lifecycle.stage_traces(view(spark, sf_dir, "stage_v"))
    documents = view(spark, sf_dir, "kb_v").select("doc_key").distinct()
    found = analyses.select("incident_id", F.upper("mitre_technique").alias("doc_key")).join(documents, "doc_key")
    sources = found.groupBy("incident_id").agg(F.array_sort(F.collect_set("doc_key")).alias("rag_sources"))
    return marked, groups, analyses.drop("mitre_technique"), looked_up, view(spark, sf_dir, "decision_v"), ml, traces, sources


_REPORT_SQL = oracle_ctes(
    "incidents_v analysis_v decision_v report_v technique_v stage_v kb_v",
    f"""{_LABEL_CTES.strip()},
summary AS (SELECT correlation_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n, count(*) - 1 AS others FROM labelled GROUP BY correlation_id),
last AS (SELECT incident_id, max(id) AS id FROM analysis_v GROUP BY incident_id),
lastml AS (SELECT incident_id, max(id) AS id FROM report_v GROUP BY incident_id),
cases AS (SELECT l.id AS incident_id, l.title, l.description, l.severity, l.hostname, l.source_ip, l.username, l.correlation_id, s.sources, s.n, s.others,
    a.summary, a.risk_level, a.recommendation, nullif(upper(a.mitre_technique), '') AS technique_id, t.name AS mitre_name,
    m.ml_status, m.ml_prediction, m.ml_engine, m.ml_is_anomaly, m.ml_anomaly_score, m.ml_probabilities, a.thread_id, g.agent_trace, k.doc_key AS rag_sources,
    lower(trim(l.severity)) IN {_HIGH} OR lower(trim(coalesce(a.risk_level, 'medium'))) IN {_HIGH} AS high
  FROM labelled l JOIN primaries p ON p.primary_id = l.id JOIN summary s ON s.correlation_id = l.correlation_id
  LEFT JOIN last x ON x.incident_id = l.id LEFT JOIN analysis_v a ON a.id = x.id LEFT JOIN technique_v t ON t.technique_id = upper(a.mitre_technique)
  LEFT JOIN lastml y ON y.incident_id = l.id LEFT JOIN report_v m ON m.id = y.id
  LEFT JOIN (SELECT incident_id, string_agg(stage, ' > ' ORDER BY seq) AS agent_trace FROM (SELECT DISTINCT incident_id, seq, stage FROM stage_v) s GROUP BY incident_id) g ON g.incident_id = l.id
  LEFT JOIN (SELECT DISTINCT doc_key FROM kb_v) k ON k.doc_key = upper(a.mitre_technique)),
decided AS (SELECT c.*, d.approved AS human_approved, d.comment FROM cases c LEFT JOIN decision_v d USING (incident_id)),
answered AS (SELECT *, CASE WHEN high THEN coalesce(human_approved, FALSE) ELSE TRUE END AS ok FROM decided),
{_ACTIONS.replace("lower(recommendation)", "lower(coalesce(recommendation, ''))")}""",
    f"""SELECT incident_id, title, {sqltext.attack()} AS attack_type, coalesce(summary, 'No summary available') AS summary, coalesce(risk_level, lower(severity)) AS risk_level,
      coalesce(ml_status, 'not_available') AS ml_status, ml_prediction, ml_engine, ml_is_anomaly, ml_anomaly_score, ml_probabilities, thread_id, coalesce(agent_trace, '') AS agent_trace, coalesce(rag_sources, '') AS rag_sources, technique_id, mitre_name, mitre_name IS NOT NULL AS mitre_valid, recommendation,
      CASE WHEN high THEN 'human_review' ELSE 'response' END AS next_stage, high AS human_approval_required,
      CASE WHEN NOT high THEN 'not_required' WHEN human_approved THEN 'approved' ELSE 'rejected' END AS human_review_status, CASE WHEN high THEN comment END AS human_comment,
      CASE WHEN ok THEN 'approved_for_response' ELSE 'blocked' END AS response_status, CASE WHEN ok THEN action_type END AS action_type, CASE WHEN ok THEN target END AS action_target,
      correlation_id, CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'single_source' END AS correlation_confidence, others AS correlated_incident_count, sources
    FROM proposed""",
)


@query("incident_reports", _REPORT_SQL)
def incident_reports(spark, sf_dir):
    reports = response.build_reports(*_report_inputs(spark, sf_dir))
    return reports.withColumn("sources", F.array_join("sources", ",")).withColumn("agent_trace", F.array_join("agent_trace", " > ")).withColumn("rag_sources", F.array_join("rag_sources", ","))


@query(
    "store_analyses_once",
    oracle("analysis_v report_v", """SELECT thread_id, id, incident_id, summary, risk_level, recommendation FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY id) AS n FROM analysis_v) a
      WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM report_v r WHERE r.thread_id = a.thread_id AND r.ml_status = 'success')"""),
)
def store_analyses_once(spark, sf_dir):
    stored = view(spark, sf_dir, "report_v").filter(F.col("ml_status") == "success").select("thread_id")
    fresh = sinks.unstored(view(spark, sf_dir, "analysis_v"), stored, ["thread_id"], ["id"])
    return fresh.select("thread_id", "id", "incident_id", "summary", "risk_level", "recommendation")
