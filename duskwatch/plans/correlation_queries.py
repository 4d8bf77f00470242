"""Repeat suppression and cross-sensor correlation over the derived incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import risk, rules
from duskwatch.functions.columns import micros
from duskwatch.operators import correlate, normalise, suppress
from duskwatch.plans import sqltext
from duskwatch.plans.catalog import query
from duskwatch.plans.views import oracle, oracle_ctes, table, view
from duskwatch.session import cut_lineage


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled incidents, written once since most queries read them more than once."""
    return cut_lineage(correlate.correlate(view(spark, sf_dir, "incidents_v")))


# Parent of each incident: newest 20 earlier rows of another source, then equal activity.
_RELATED_CTES = f"""
inc AS MATERIALIZED (SELECT *, epoch_us(created_at) AS t, {sqltext.activity()} AS act,
  CASE WHEN source_ip IS NOT NULL AND destination_ip IS NOT NULL THEN 'pair' WHEN source_ip IS NOT NULL THEN 'source'
    WHEN destination_ip IS NOT NULL THEN 'destination' WHEN hostname IS NOT NULL THEN 'host' END AS kind FROM incidents_v),
cand AS MATERIALIZED (
  SELECT a.id, a.kind, a.act, b.id AS other_id, b.act AS other_act, b.t AS other_t
  FROM inc a JOIN inc b ON a.kind = 'pair' AND least(a.source_ip, a.destination_ip) = least(b.source_ip, b.destination_ip)
    AND greatest(a.source_ip, a.destination_ip) = greatest(b.source_ip, b.destination_ip)
    AND b.source <> a.source AND b.t BETWEEN a.t - 300000000 AND a.t AND (b.t, b.id) < (a.t, a.id)
  UNION ALL SELECT a.id, a.kind, a.act, b.id, b.act, b.t FROM inc a JOIN inc b ON a.kind = 'source' AND a.source_ip = b.source_ip
    AND b.source <> a.source AND b.t BETWEEN a.t - 300000000 AND a.t AND (b.t, b.id) < (a.t, a.id)
  UNION ALL SELECT a.id, a.kind, a.act, b.id, b.act, b.t FROM inc a JOIN inc b ON a.kind = 'destination' AND a.destination_ip = b.destination_ip
    AND b.source <> a.source AND b.t BETWEEN a.t - 300000000 AND a.t AND (b.t, b.id) < (a.t, a.id)
  UNION ALL SELECT a.id, a.kind, a.act, b.id, b.act, b.t FROM inc a JOIN inc b ON a.kind = 'host' AND a.hostname = b.hostname
    AND b.source <> a.source AND b.t BETWEEN a.t - 300000000 AND a.t AND (b.t, b.id) < (a.t, a.id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other_t DESC, other_id DESC) AS rn FROM cand),
related AS MATERIALIZED (SELECT id, kind, arg_min(other_id, rn) AS related_id FROM ranked WHERE rn <= 20 AND act = other_act GROUP BY id, kind)
"""

_LABEL_CTES = (
    _RELATED_CTES
    + """,
walk AS (SELECT id, related_id AS node, 1 AS hops FROM related
  UNION ALL SELECT w.id, r.related_id, w.hops + 1 FROM walk w JOIN related r ON w.node = r.id),
roots AS (SELECT id, arg_max(node, hops) AS root_id FROM walk GROUP BY id),
labelled AS MATERIALIZED (SELECT i.* , concat('SOC-', md5(CAST(coalesce(r.root_id, i.id) AS VARCHAR))) AS correlation_id
  FROM inc i LEFT JOIN roots r ON i.id = r.id),
primaries AS (SELECT correlation_id, arg_min(id, (created_at, id)) AS primary_id FROM labelled GROUP BY correlation_id)
"""
)


def _labelled_oracle(sql: str) -> str:
    return oracle_ctes("incidents_v", _LABEL_CTES, sql)


@query("related_incidents", oracle_ctes("incidents_v", _RELATED_CTES, "SELECT id, related_id, kind FROM related"))
def related_incidents(spark, sf_dir):
    return correlate.related_incidents(view(spark, sf_dir, "incidents_v")).drop("t")


@query("correlation_ids", _labelled_oracle("SELECT id, correlation_id FROM labelled"))
def correlation_ids(spark, sf_dir):
    return correlate.correlate(view(spark, sf_dir, "incidents_v")).select("id", "correlation_id")


@query(
    "correlated_members",
    _labelled_oracle("""SELECT p.primary_id, l.id, l.source, l.title, l.severity, epoch_us(l.created_at) AS created_us
      FROM labelled l JOIN primaries p USING (correlation_id) WHERE l.id <> p.primary_id"""),
)
def correlated_members(spark, sf_dir):
    members = correlate.correlated_evidence(_labelled(spark, sf_dir))
    return members.select("primary_id", "id", "source", "title", "severity", micros(F.col("created_at")).alias("created_us"))


@query(
    "correlated_evidence",
    _labelled_oracle("""SELECT p.primary_id, l.id, l.source, l.title, l.description, l.severity, l.status, l.hostname,
      l.source_ip, l.destination_ip, l.username, l.workflow_status, l.correlation_id
      FROM labelled l JOIN primaries p USING (correlation_id) WHERE l.id <> p.primary_id"""),
)
def correlated_evidence(spark, sf_dir):
    return correlate.correlated_evidence(_labelled(spark, sf_dir)).drop("created_at")


@query(
    "correlation_summary",
    _labelled_oracle("""SELECT correlation_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
      count(DISTINCT source) AS source_count, count(*) - 1 AS correlated_incident_count,
      CASE WHEN count(DISTINCT source) >= 3 THEN 'high' WHEN count(DISTINCT source) = 2 THEN 'medium' ELSE 'single_source' END AS confidence
      FROM labelled GROUP BY correlation_id"""),
)
def correlation_summary(spark, sf_dir):
    return correlate.correlation_summary(_labelled(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(
    "correlation_group_rollup",
    _labelled_oracle(f"""SELECT correlation_id, count(*) AS incident_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
      arg_min(severity, ({sqltext.severity_rank("severity")}, created_at, id)) AS highest_severity,
      epoch_us(min(created_at)) AS first_seen_us, epoch_us(max(created_at)) AS last_seen_us
      FROM labelled GROUP BY correlation_id"""),
)
def correlation_group_rollup(spark, sf_dir):
    return rollup(correlate.correlate(view(spark, sf_dir, "incidents_v")))


def rollup(labelled: DataFrame) -> DataFrame:
    return correlate.group_rollup(labelled).select(
        "correlation_id",
        "incident_count",
        F.array_join("sources", ",").alias("sources"),
        "highest_severity",
        micros(F.col("first_seen")).alias("first_seen_us"),
        micros(F.col("last_seen")).alias("last_seen_us"),
    )


@query(
    "correlation_group_addresses",
    _labelled_oracle("""SELECT DISTINCT correlation_id, 'source' AS role, source_ip AS address FROM labelled WHERE source_ip <> ''
      UNION ALL SELECT DISTINCT correlation_id, 'destination', destination_ip FROM labelled WHERE destination_ip <> ''"""),
)
def correlation_group_addresses(spark, sf_dir):
    return correlate.group_addresses(_labelled(spark, sf_dir))


@query("primary_incident", _labelled_oracle("SELECT correlation_id, primary_id FROM primaries"))
def primary_incident(spark, sf_dir):
    return correlate.primary_incidents(correlate.correlate(view(spark, sf_dir, "incidents_v")))


@query(
    "mark_correlated",
    _labelled_oracle("""SELECT l.id, l.correlation_id, l.id = p.primary_id AS is_primary,
      CASE WHEN l.id = p.primary_id THEN l.workflow_status ELSE 'correlated' END AS workflow_status
      FROM labelled l JOIN primaries p USING (correlation_id)"""),
)
def mark_correlated(spark, sf_dir):
    return correlate.mark_correlated(_labelled(spark, sf_dir)).select("id", "correlation_id", "is_primary", "workflow_status")


def _keep_chain_oracle(fields: tuple[str, ...], sensor: str) -> str:
    """Row by row per (source, title), carrying the incidents kept in the last two minutes."""
    alive = "list_filter(c.kept, lambda k: k.t >= r.t - 120000000)"
    hit = " AND ".join(f"(r.{f} IS NULL OR k.{f} = r.{f})" for f in fields)
    found = f"list_filter(c.kept, lambda k: k.t >= r.t - 120000000 AND {hit})"
    me = "struct_pack(t := r.t, id := r.id, " + ", ".join(f"{f} := r.{f}" for f in fields) + ")"
    first = "struct_pack(t := t, id := id, " + ", ".join(f"{f} := {f}" for f in fields) + ")"
    return f"""
    {sensor}_rows AS MATERIALIZED (SELECT id, source, title, epoch_us(created_at) AS t, {", ".join(fields)},
      row_number() OVER (PARTITION BY source, title ORDER BY created_at, id) AS rn
      FROM incidents_v WHERE source = '{sensor}'),
    {sensor}_chain AS (
      SELECT title, rn, id, CAST(NULL AS BIGINT) AS duplicate_of, [{first}] AS kept FROM {sensor}_rows WHERE rn = 1
      UNION ALL
      SELECT r.title, r.rn, r.id, list_max(list_transform({found}, lambda k: k.id)),
        CASE WHEN len({found}) = 0 THEN list_append({alive}, {me}) ELSE {alive} END
      FROM {sensor}_chain c JOIN {sensor}_rows r ON r.title = c.title AND r.rn = c.rn + 1)
    """


_CHAINS = ", ".join(
    [
        _keep_chain_oracle(suppress.HOST_FIELDS, rules.HOST_SENSOR),
        _keep_chain_oracle(suppress.NETWORK_FIELDS, rules.NETWORK_SENSOR),
    ]
)


@query(
    "suppress_repeats",
    oracle_ctes(
        "incidents_v",
        _CHAINS,
        f"""SELECT id, duplicate_of FROM {rules.HOST_SENSOR}_chain
        UNION ALL SELECT id, duplicate_of FROM {rules.NETWORK_SENSOR}_chain""",
    ),
)
def suppress_repeats(spark, sf_dir):
    return suppress.suppress_repeats(view(spark, sf_dir, "incidents_v"))


@query(
    "classify_activity",
    oracle("incidents_v", f"SELECT id, {sqltext.activity()} AS activity FROM incidents_v"),
)
def classify_activity(spark, sf_dir):
    return view(spark, sf_dir, "incidents_v").select("id", risk.activity(F.col("title"), F.col("description")).alias("activity"))


@query(
    "classify_attack_type",
    f"""SELECT doc_id, {sqltext.attack("source", "text")} AS attack_type FROM documents""",
)
def classify_attack_type(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", risk.attack_type(F.col("source"), F.col("text")).alias("attack_type"))


@query(
    "triage",
    oracle(
        "incidents_v",
        f"""SELECT id, 'triaged' AS status, {sqltext.norm("coalesce(severity, 'medium')")} AS severity,
        upper({sqltext.norm("coalesce(severity, 'medium')")}) AS priority, {sqltext.attack()} AS attack_type FROM incidents_v""",
    ),
)
def triage(spark, sf_dir):
    return normalise.triage(view(spark, sf_dir, "incidents_v")).select("id", "status", "severity", "priority", "attack_type")
