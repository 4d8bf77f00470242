"""Sensor normalisation and indicator queries."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from duskwatch.functions import net, risk, rules
from duskwatch.functions.columns import micros
from duskwatch.operators import enrich, indicators, models, normalise
from duskwatch.plans import sqltext
from duskwatch.plans.catalog import query
from duskwatch.plans.correlation_queries import _LABEL_CTES, _labelled
from duskwatch.plans.views import oracle, oracle_ctes, table, view
from duskwatch.schemas import EVE_EVENT, HOST_ALERT
from duskwatch.sources import sensors

# --- host sensor -----------------------------------------------------------
_HOST = """good AS (SELECT event_id, CASE WHEN kind = 2 THEN NULL WHEN json_type(raw, '$._source') = 'OBJECT' THEN json_extract(raw, '$._source') ELSE CAST(raw AS JSON) END AS b, kind FROM
  (SELECT event_id, kind, CASE WHEN kind = 2 THEN '{}' ELSE raw END AS raw FROM host_line_v) x),
f AS (SELECT event_id, kind, b->>'$.rule.id' AS rule_id, b->>'$.rule.level' AS level, nullif(b->>'$.rule.description', '') AS rule_text,
  nullif(b->>'$.agent.name', '') AS agent_name, b->>'$.agent.ip' AS agent_ip, nullif(b->>'$.data.hostname', '') AS data_host,
  nullif(b->>'$.data.srcip', '') AS s1, nullif(b->>'$.data.src_ip', '') AS s2, nullif(b->>'$.data.source_ip', '') AS s3,
  nullif(b->>'$.data.dstip', '') AS d1, b->>'$.data.command' AS command, nullif(b->>'$.data.dstuser', '') AS dstuser,
  nullif(b->>'$.full_log', '') AS full_log, nullif(b->>'$.message', '') AS message, b->>'$.timestamp' AS stamp FROM good WHERE kind > 3)"""
_LAST_IP = "list_last(regexp_extract_all(coalesce({0}, ''), '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b'))"


@query(
    "normalise_host_alerts",
    oracle_ctes("host_line_v", _HOST, f"""
    SELECT event_id, coalesce(rule_text, '{rules.HOST_DEFAULT_TITLE}') AS title,
      coalesce(full_log, message, rule_text, '{rules.HOST_DEFAULT_TITLE}') AS description,
      CASE WHEN coalesce(TRY_CAST(level AS INT), 0) >= 12 THEN 'critical' WHEN coalesce(TRY_CAST(level AS INT), 0) >= 8 THEN 'high'
        WHEN coalesce(TRY_CAST(level AS INT), 0) >= 4 THEN 'medium' ELSE 'low' END AS severity,
      '{rules.HOST_SENSOR}' AS source, coalesce(agent_name, data_host) AS hostname,
      coalesce(s1, s2, s3, CASE WHEN rule_id = '100100' THEN agent_ip END) AS source_ip,
      coalesce(d1, CASE WHEN rule_id = '100100' THEN coalesce({_LAST_IP.format("command")}, {_LAST_IP.format("full_log")}) END) AS destination_ip,
      dstuser AS username,
      CASE stamp WHEN '2024-02-04T14:25:34.416117Z' THEN 1707056734416117 WHEN '2022-02-07T02:00:00+02:00' THEN 1644192000000000 END AS event_us,
      coalesce(TRY_CAST(level AS INT), 0) AS rule_level, CASE event_id % 5 WHEN 2 THEN 'T1110' WHEN 3 THEN 'T1,T2' ELSE '' END AS mitre FROM f"""),
)
def normalise_host_alerts(spark, sf_dir):
    lines = view(spark, sf_dir, "host_line_v").drop("kind")
    good, _ = normalise.split_rejects(normalise.normalise_host_alerts(sensors.parse_lines(lines, "raw", HOST_ALERT)))
    return good.select(
        "event_id", "title", "description", "severity", "source", "hostname", "source_ip", "destination_ip", "username",
        micros(F.col("event_timestamp")).alias("event_us"), "rule_level", F.array_join("mitre_ids", ",").alias("mitre"),
    )


@query(
    "host_alert_rejects",
    oracle("host_line_v", """SELECT event_id, CASE kind WHEN 2 THEN 'not a JSON object' ELSE 'no recognised alert field' END AS reject_reason
      FROM host_line_v WHERE kind <= 3"""),
)
def host_alert_rejects(spark, sf_dir):
    lines = view(spark, sf_dir, "host_line_v").drop("kind")
    _, bad = normalise.split_rejects(normalise.normalise_host_alerts(sensors.parse_lines(lines, "raw", HOST_ALERT)))
    return bad.select("event_id", "reject_reason")


# --- network sensor --------------------------------------------------------
@query(
    "normalise_network_alerts",
    oracle("eve_line_v", f"""
    SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN 'sig ' || word END, '{rules.NETWORK_DEFAULT_TITLE}') AS title,
      concat_ws('; ', CASE WHEN event_id % 4 <> 0 THEN 'Category: ' || word END,
        CASE WHEN user_id % 4 <> 0 THEN 'Source: 10.0.0.' || (user_id % 6) || ':' || (1000 + user_id) END,
        'Destination: 10.0.1.' || (user_id % 2), 'Protocol: TCP', CASE WHEN event_id % 3 <> 0 THEN 'Signature ID: ' || (2000000 + user_id) END) AS description,
      CASE user_id % 5 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'medium' END AS severity,
      CASE WHEN user_id % 4 <> 0 THEN '10.0.0.' || (user_id % 6) END AS source_ip, '10.0.1.' || (user_id % 2) AS destination_ip,
      1704067200000000 + 1000000 * (event_id % 10) AS event_us
    FROM eve_line_v WHERE kind = 0"""),
)
def normalise_network_alerts(spark, sf_dir):
    lines = view(spark, sf_dir, "eve_line_v").select("event_id", "raw")
    good, _ = normalise.split_rejects(normalise.normalise_network_alerts(sensors.parse_lines(lines, "raw", EVE_EVENT)))
    return good.select(
        "event_id", "title", "description", "severity", "source_ip", "destination_ip", micros(F.col("event_timestamp")).alias("event_us")
    )


@query(
    "network_alert_rejects",
    oracle("eve_line_v", """SELECT event_id, CASE WHEN kind = 4 THEN 'not a JSON object' ELSE 'event type is not alert' END AS reject_reason
      FROM eve_line_v WHERE kind IN (1, 2, 4)"""),
)
def network_alert_rejects(spark, sf_dir):
    lines = view(spark, sf_dir, "eve_line_v").select("event_id", "raw")
    _, bad = normalise.split_rejects(normalise.normalise_network_alerts(sensors.parse_lines(lines, "raw", EVE_EVENT)))
    return bad.select("event_id", "reject_reason")


@query(
    "alerts_as_flows",
    oracle("eve_line_v", """SELECT event_id, 0.0::DOUBLE AS destination_port, 0.0::DOUBLE AS duration_seconds, 0.0::DOUBLE AS total_packets, 0.0::DOUBLE AS packets_per_second, 0.0::DOUBLE AS alerted
      FROM eve_line_v WHERE kind = 0"""),
)
def alerts_as_flows(spark, sf_dir):
    """Network alerts as the flow model is offered them: what they lack is zero."""
    lines = view(spark, sf_dir, "eve_line_v").select("event_id", "raw")
    alerts = sensors.parse_lines(lines, "raw", EVE_EVENT).filter(~sensors.unreadable() & (F.col("event_type") == "alert"))
    features = sensors.flow_features(sensors.flow_events(models.alerts_as_flows(alerts)), "event_id")
    return features.select("event_id", "destination_port", "duration_seconds", "total_packets", "packets_per_second", "alerted")


@query("flow_scan_counts", oracle("eve_line_v", "SELECT count(*) FILTER (WHERE kind = 1) AS extracted, count(*) FILTER (WHERE kind = 4) AS skipped FROM eve_line_v"))
def flow_scan_counts(spark, sf_dir):
    lines = view(spark, sf_dir, "eve_line_v").select("event_id", "raw")
    return sensors.scan_counts(sensors.parse_lines(lines, "raw", EVE_EVENT))


@query(
    "flow_features",
    oracle_ctes("eve_line_v", """d AS (SELECT *, CASE WHEN gap_s % 3 = 0 THEN 9.0 ELSE gap_s + 0.5 END AS seconds FROM eve_line_v WHERE kind = 1)""", """
    SELECT event_id, CAST(user_id AS DOUBLE) AS destination_port, CAST(seconds AS DOUBLE) AS duration_seconds,
      CAST(user_id AS DOUBLE) AS pkts_to_server, CAST(user_id % 7 AS DOUBLE) AS pkts_to_client,
      CAST(user_id * 100 AS DOUBLE) AS bytes_to_server, CAST(0 AS DOUBLE) AS bytes_to_client,
      CAST(user_id + user_id % 7 AS DOUBLE) AS total_packets, CAST(user_id * 100 AS DOUBLE) AS total_bytes,
      round((user_id + user_id % 7) / CAST(seconds AS DOUBLE), 9) AS packets_per_second, round(user_id * 100 / CAST(seconds AS DOUBLE), 9) AS bytes_per_second,
      1.0::DOUBLE AS syn_flag, 0.0::DOUBLE AS fin_flag, 0.0::DOUBLE AS psh_flag, CAST(gap_s % 2 = 0 AS DOUBLE) AS ack_flag,
      CAST(event_id % 10 = 1 AS DOUBLE) AS alerted FROM d"""),
)
def flow_features(spark, sf_dir):
    lines = view(spark, sf_dir, "eve_line_v").select("event_id", "raw")
    flows = sensors.flow_events(sensors.parse_lines(lines, "raw", EVE_EVENT))
    return sensors.flow_features(flows, "event_id").withColumns(
        {c: F.round(c, 9) for c in ("packets_per_second", "bytes_per_second")}
    )


@query(
    "alerts_from_incidents",
    oracle("incidents_v", "SELECT id AS incident_id, title, description, source, severity, 'new' AS status FROM incidents_v"),
)
def alerts_from_incidents(spark, sf_dir):
    return normalise.alerts_from_incidents(view(spark, sf_dir, "incidents_v")).drop("created_at")


# --- indicators ------------------------------------------------------------
# RE2 knows only ASCII word characters: letters beyond ASCII are made '_' first, a word
# character no indicator can contain.
_PLAIN = "regexp_replace({0}, '[^\\P{{L}}a-zA-Z]', '_', 'g')"


def _indicator_ctes(source: str, key: str, text: str) -> str:
    suffixes = sqltext.text_list(rules.FILE_SUFFIXES)
    hashes = " UNION ALL ".join(
        f"SELECT {key}, '{kind}' AS hash_type, lower(unnest(regexp_extract_all(plain, '{pattern}'))) AS value FROM src" for kind, pattern in rules.HASHES
    )
    octets = "list_filter(string_split(value, '.'), lambda o: TRY_CAST(o AS INT) BETWEEN 0 AND 255 AND (o = '0' OR o[1] <> '0'))"
    return f"""
    src AS MATERIALIZED (SELECT *, {text} AS txt, {_PLAIN.format(text)} AS plain FROM {source}),
    raw_ip AS (SELECT {key}, unnest(regexp_extract_all(plain, '{rules.IPV4}')) AS value FROM src),
    ips AS (SELECT DISTINCT {key}, value FROM raw_ip WHERE len({octets}) = 4),
    urls AS (SELECT DISTINCT {key}, regexp_replace(value, '[.,);\\]}}]+$', '') AS value FROM
      (SELECT {key}, unnest(regexp_extract_all(txt, '(?i)https?://[^\\s"''<>]+')) AS value FROM src) u),
    hosts AS (SELECT {key}, lower(regexp_replace(regexp_replace(regexp_extract(value, '(?i)^https?://([^/?#]*)', 1), '^.*@', ''), ':[^:\\]]*$', '')) AS value FROM urls),
    names AS (SELECT {key}, lower(unnest(regexp_extract_all(plain, '{rules.DOMAIN}'))) AS value FROM src),
    domains AS (SELECT {key}, value FROM names WHERE NOT regexp_matches(value, '(^|\\.)-|-(\\.|$)') AND list_last(string_split(value, '.')) NOT IN ({suffixes})
      UNION SELECT {key}, value FROM hosts WHERE regexp_matches(value, '^([a-z0-9-]+\\.)+[a-z]{{2,63}}$')),
    hashes AS (SELECT DISTINCT {key}, hash_type, value FROM ({hashes}) h)
    """


_TEXT_IOCS = _indicator_ctes("text_v", "kind, text_id", "text")
for _name, _cte in (("extract_ips", "ips"), ("extract_urls", "urls"), ("extract_domains", "domains")):

    def _register(name=_name, cte=_cte):
        kind = {"ips": "ip", "urls": "url", "domains": "domain"}[cte]

        @query(name, oracle_ctes("text_v", _TEXT_IOCS, f"SELECT kind, text_id, value FROM {cte}"))
        def run(spark, sf_dir):
            found = indicators.text_indicators_of(view(spark, sf_dir, "text_v"), "text", kind, "kind", "text_id")
            return found.select("kind", "text_id", "value")

    _register()


@query("extract_hashes", oracle_ctes("text_v", _TEXT_IOCS, "SELECT kind, text_id, hash_type, value FROM hashes"))
def extract_hashes(spark, sf_dir):
    found = indicators.text_indicators_of(view(spark, sf_dir, "text_v"), "text", "hash", "kind", "text_id")
    return found.select("kind", "text_id", "hash_type", "value")


@query(
    "indicator_counts",
    oracle_ctes("text_v", _TEXT_IOCS, """SELECT kind, text_id, count(*) FILTER (WHERE t = 'ip') AS ip_count, count(*) FILTER (WHERE t = 'domain') AS domain_count,
      count(*) FILTER (WHERE t = 'url') AS url_count, count(*) FILTER (WHERE t = 'hash') AS hash_count FROM (
        SELECT kind, text_id, 'ip' AS t FROM ips UNION ALL SELECT kind, text_id, 'domain' FROM domains UNION ALL SELECT kind, text_id, 'url' FROM urls
        UNION ALL SELECT kind, text_id, 'hash' FROM (SELECT DISTINCT kind, text_id, value FROM hashes) h) a GROUP BY ALL"""),
)
def indicator_counts(spark, sf_dir):
    found = indicators.text_indicators(view(spark, sf_dir, "text_v"), "text", "kind", "text_id")
    return indicators.counts_by_type(found, "kind", "text_id")


_GATHERED = (
    _LABEL_CTES
    + """,
named AS (SELECT id, correlation_id, source, unnest(list_distinct(list_filter([source_ip, destination_ip]
    || regexp_extract_all(title || ' ' || description, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'), lambda v: v IS NOT NULL))) AS value FROM labelled),
gathered AS (SELECT p.primary_id, 'ip' AS ioc_type, n.value, n.id AS incident_id, n.source,
    CASE WHEN n.id = p.primary_id THEN 'primary' ELSE 'correlated' END AS role FROM named n JOIN primaries p USING (correlation_id))
"""
)


@query("group_indicators", oracle_ctes("incidents_v", _GATHERED, "SELECT primary_id, ioc_type, value, incident_id, source, role FROM gathered"))
def group_indicators(spark, sf_dir):
    return indicators.group_indicators(_labelled(spark, sf_dir)).drop("hash_type")


@query(
    "indicator_observations",
    oracle_ctes("incidents_v", _GATHERED, "SELECT DISTINCT ioc_type, value, incident_id, source, role FROM gathered"),
)
def indicator_observations(spark, sf_dir):
    return indicators.observations(indicators.group_indicators(_labelled(spark, sf_dir)))


# --- enrichment ------------------------------------------------------------
_V4 = "TRY_CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + TRY_CAST(split_part({c}, '.', 2) AS BIGINT) * 65536 + TRY_CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + TRY_CAST(split_part({c}, '.', 4) AS BIGINT)"
_V4_OK = "regexp_matches({c}, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"


def _scope_sql(c: str) -> str:
    def between(nets):
        spans = [ipaddress.ip_network(n) for n in nets]
        return " OR ".join(f"n BETWEEN {int(s.network_address)} AND {int(s.broadcast_address)}" for s in spans)

    return f"""CASE WHEN NOT {_V4_OK.format(c=c)} THEN 'invalid' WHEN {between(net.PRIVATE_V4)} THEN 'private'
      WHEN ({between(net.NOT_GLOBAL_V4)}) AND NOT ({between(net.GLOBAL_ANYWAY_V4)}) THEN 'non-public' ELSE 'public' END"""


_CUSTOMER_IPS = """
addresses AS (SELECT DISTINCT 'ip' AS ioc_type, CASE c_custkey % 5 WHEN 0 THEN concat('10.0.0.', CAST(c_custkey % 8 AS STRING))
    WHEN 1 THEN concat('8.8.', CAST(c_custkey % 3 AS STRING), '.', CAST(c_custkey % 300 AS STRING)) WHEN 2 THEN concat('100.64.0.', CAST(c_nationkey AS STRING))
    WHEN 3 THEN concat('203.0.', CAST(c_custkey % 120 AS STRING), '.7') ELSE concat('192.0.0.', CAST(c_custkey % 12 AS STRING)) END AS value FROM customer)
"""


def _addresses(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")

    def mod(n: int):
        return (key % n).cast("string")

    value = (
        F.when(key % 5 == 0, F.concat(F.lit("10.0.0."), mod(8)))
        .when(key % 5 == 1, F.concat(F.lit("8.8."), mod(3), F.lit("."), mod(300)))
        .when(key % 5 == 2, F.concat(F.lit("100.64.0."), nation))
        .when(key % 5 == 3, F.concat(F.lit("203.0."), mod(120), F.lit(".7")))
        .otherwise(F.concat(F.lit("192.0.0."), mod(12)))
    )
    return c.select(F.lit("ip").alias("ioc_type"), value.alias("value")).distinct()


@query(
    "ip_scope",
    f"WITH {_CUSTOMER_IPS}, v AS (SELECT *, {_V4.format(c='value')} AS n FROM addresses) SELECT value, {_scope_sql('value')} AS scope FROM v".replace("STRING", "VARCHAR"),
)
def ip_scope(spark, sf_dir):
    return enrich.with_scope(_addresses(spark, sf_dir)).select("value", "scope")


def _verdicts(name: str) -> str:
    return {
        "abuse": "CASE WHEN abuse_score < 25 THEN 'SAFE' WHEN abuse_score < 75 THEN 'SUSPICIOUS' ELSE 'MALICIOUS' END",
        "engine": "CASE WHEN malicious >= 5 THEN 'MALICIOUS' WHEN malicious >= 1 OR suspicious >= 1 THEN 'SUSPICIOUS' ELSE 'SAFE' END",
        "pulse": "CASE WHEN pulse_count = 0 THEN 'SAFE' WHEN ioc_type = 'hash' AND pulse_count >= 5 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END",
        "internal": "CASE WHEN match_count > 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END",
    }[name]


_FEEDS = """
feeds AS (SELECT 'ip' AS ioc_type, CASE WHEN s_suppkey % 2 = 0 THEN concat('10.0.0.', CAST(s_suppkey % 8 AS VARCHAR))
    ELSE concat('8.8.', CAST(s_suppkey % 3 AS VARCHAR), '.', CAST(s_suppkey % 300 AS VARCHAR)) END AS value,
  max(s_suppkey % 101) AS abuse_score, sum(s_suppkey % 3) AS malicious, sum(s_nationkey % 2) AS suspicious, count(*) AS pulse_count,
  count(*) FILTER (WHERE s_acctbal > 5000) AS match_count FROM supplier GROUP BY ALL)
"""


def _feeds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    value = F.when(key % 2 == 0, F.concat(F.lit("10.0.0."), (key % 8).cast("string"))).otherwise(
        F.concat(F.lit("8.8."), (key % 3).cast("string"), F.lit("."), (key % 300).cast("string"))
    )
    feed = s.groupBy(F.lit("ip").alias("ioc_type"), value.alias("value")).agg(
        F.max(key % 101).alias("abuse_score"),
        F.sum(key % 3).alias("malicious"),
        F.sum(F.col("s_nationkey") % 2).alias("suspicious"),
        F.count(F.lit(1)).alias("pulse_count"),
        F.count_if(F.col("s_acctbal") > 5000).alias("match_count"),
    )
    return {p: feed for p in enrich.PROVIDERS}


_ANSWERS = {enrich.ABUSE: "abuse", enrich.ENGINES: "engine", enrich.PULSES: "pulse", enrich.INTERNAL: "internal"}
_ENRICH_SQL = f"""WITH {_CUSTOMER_IPS.replace("STRING", "VARCHAR")}, {_FEEDS},
known AS (SELECT a.ioc_type, a.value, {_V4.format(c="a.value")} AS n, coalesce(f.abuse_score, 0) AS abuse_score, coalesce(f.malicious, 0) AS malicious,
  coalesce(f.suspicious, 0) AS suspicious, coalesce(f.pulse_count, 0) AS pulse_count, coalesce(f.match_count, 0) AS match_count
  FROM addresses a LEFT JOIN feeds f USING (ioc_type, value)),
scoped AS (SELECT *, {_scope_sql("value")} AS scope FROM known)
""" + " UNION ALL ".join(
    f"""SELECT ioc_type, value, scope, '{p}' AS provider, CASE WHEN {skip} THEN 'skipped' ELSE 'success' END AS status,
    CASE WHEN scope = 'invalid' THEN '{rules.INVALID_IP_REASON}' WHEN {skip} THEN '{rules.NON_PUBLIC_REASON}' END AS reason,
    CASE WHEN NOT ({skip}) THEN {_verdicts(v)} END AS risk FROM scoped"""
    for p, v in _ANSWERS.items()
    for skip in ["scope = 'invalid'" if p == enrich.INTERNAL else "scope <> 'public'"]
)


@query("enrich_indicators", _ENRICH_SQL)
def enrich_indicators(spark, sf_dir):
    return enrich.enrich(_addresses(spark, sf_dir), _feeds(spark, sf_dir))


@query(
    "indicator_pulses",
    """SELECT ioc_type, value, position, name, id FROM (SELECT 'ip' AS ioc_type, '10.0.0.' || (s_suppkey % 8) AS value, s_suppkey AS position, s_name AS name, s_suppkey * 7 AS id,
      row_number() OVER (PARTITION BY s_suppkey % 8 ORDER BY s_suppkey) AS nth FROM supplier) p WHERE nth <= 10""",
)
def indicator_pulses(spark, sf_dir):
    key = F.col("s_suppkey")
    pulses = table(spark, sf_dir, "supplier").select(
        F.lit("ip").alias("ioc_type"), F.concat(F.lit("10.0.0."), (key % 8).cast("string")).alias("value"), key.alias("position"), F.col("s_name").alias("name"), (key * 7).alias("id")
    )
    return enrich.pulses_kept(pulses)


@query(
    "indicator_matches",
    """SELECT ioc_type, value, position, id, category, comment, event_id, event_info FROM (SELECT 'domain' AS ioc_type, 'h' || (c_custkey % 5) || '.example.com' AS value, c_custkey AS position,
      c_custkey * 3 AS id, c_mktsegment AS category, c_name AS comment, c_nationkey AS event_id, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS event_info,
      row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) AS nth FROM customer) m WHERE nth <= 20""",
)
def indicator_matches(spark, sf_dir):
    key = F.col("c_custkey")
    matches = table(spark, sf_dir, "customer").select(
        F.lit("domain").alias("ioc_type"), F.concat(F.lit("h"), (key % 5).cast("string"), F.lit(".example.com")).alias("value"), key.alias("position"), (key * 3).alias("id"),
        F.col("c_mktsegment").alias("category"), F.col("c_name").alias("comment"), F.col("c_nationkey").alias("event_id"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("event_info"),
    )
    return enrich.matches_kept(matches)


@query(
    "enrich_text_indicators",
    oracle_ctes("text_v", _TEXT_IOCS + ", seen AS (SELECT DISTINCT 'domain' AS ioc_type, value FROM domains UNION SELECT DISTINCT 'url', value FROM urls UNION SELECT DISTINCT 'hash', value FROM hashes)",
    f"""SELECT ioc_type, value, p.provider, CASE p.provider WHEN '{enrich.INTERNAL}' THEN 'not_configured' ELSE 'success' END AS status,
      CASE WHEN p.provider = '{enrich.INTERNAL}' THEN 'UNKNOWN' WHEN (length(value) + ascii(value)) % 2 = 1 THEN 'SAFE'
        WHEN p.provider = '{enrich.ENGINES}' THEN CASE WHEN length(value) % 7 >= 5 THEN 'MALICIOUS' WHEN length(value) % 7 >= 1 THEN 'SUSPICIOUS' ELSE 'SAFE' END
        WHEN ascii(value) % 9 = 0 THEN 'SAFE' WHEN ioc_type = 'hash' AND ascii(value) % 9 >= 5 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS risk
      FROM seen, (VALUES ('{enrich.ENGINES}'), ('{enrich.PULSES}'), ('{enrich.INTERNAL}')) p(provider)"""),
)
def enrich_text_indicators(spark, sf_dir):
    found = indicators.text_indicators(view(spark, sf_dir, "text_v"), "text", "kind", "text_id").filter(F.col("ioc_type") != "ip")
    # Half of the indicators are known to the feeds, with figures from their own text.
    size, first = F.char_length("value"), F.ascii("value")
    feed = found.filter((size + first) % 2 == 0).select("ioc_type", "value").distinct()
    feed = feed.select("*", F.lit(0).alias("abuse_score"), (size % 7).alias("malicious"), F.lit(0).alias("suspicious"), (first % 9).alias("pulse_count"))
    feeds = {p: feed for p in enrich.PROVIDERS if p != enrich.INTERNAL}
    return enrich.enrich(found, feeds).select("ioc_type", "value", "provider", "status", "risk")


@query(
    "provider_verdicts",
    oracle_ctes("", _FEEDS.strip(), f"""SELECT value, {_verdicts("abuse")} AS abuse_risk, {_verdicts("engine")} AS engine_risk, {_verdicts("pulse")} AS pulse_risk,
      {_verdicts("internal")} AS internal_risk FROM feeds"""),
)
def provider_verdicts(spark, sf_dir):
    feed = next(iter(_feeds(spark, sf_dir).values()))
    return feed.select(
        "value",
        risk.abuse_verdict(F.col("abuse_score")).alias("abuse_risk"),
        risk.engine_verdict(F.col("malicious"), F.col("suspicious")).alias("engine_risk"),
        risk.pulse_verdict(F.col("ioc_type"), F.col("pulse_count")).alias("pulse_risk"),
        risk.internal_verdict(F.lit(True), F.col("match_count")).alias("internal_risk"),
    )


@query(
    "cached_lookup",
    oracle("incidents_v", """SELECT l.id, arg_max(c.id, (c.created_at, c.id)) AS cached_id
      FROM (SELECT id, source_ip, created_at FROM incidents_v WHERE source_ip IS NOT NULL AND source <> 'EDR') l
      LEFT JOIN (SELECT id, source_ip, created_at FROM incidents_v WHERE source_ip IS NOT NULL AND source = 'EDR') c
        ON c.source_ip = l.source_ip AND c.created_at BETWEEN l.created_at - INTERVAL 900 SECOND AND l.created_at
      GROUP BY l.id"""),
)
def cached_lookup(spark, sf_dir):
    rows = view(spark, sf_dir, "incidents_v").filter(F.col("source_ip").isNotNull()).select(
        F.col("source_ip").alias("ioc"), micros(F.col("created_at")).alias("t"), "id", "source"
    )
    lookups = rows.filter(F.col("source") != "EDR").drop("source")
    cache = rows.filter(F.col("source") == "EDR").select("ioc", "t", "id", F.struct("id").alias("payload"))
    return enrich.cached_lookup(lookups, cache).select("id", F.col("found.id").alias("cached_id"))


@query(
    "validate_techniques",
    oracle("analysis_v technique_v", """SELECT a.id, t2.tid AS technique_id, t.name, t.name IS NOT NULL AS valid FROM analysis_v a
      JOIN (SELECT id, nullif(upper(trim(split_part(coalesce(mitre_technique || ' - ' || mitre_name, mitre_technique, ''), ' ', 1))), '') AS tid FROM analysis_v) t2 USING (id)
      LEFT JOIN technique_v t ON t.technique_id = t2.tid"""),
)
def validate_techniques(spark, sf_dir):
    claim = F.coalesce(F.concat_ws(" - ", F.col("mitre_technique"), F.col("mitre_name")), F.lit(""))
    claims = view(spark, sf_dir, "analysis_v").withColumn("mitre_technique", claim)
    return enrich.validate_techniques(claims, view(spark, sf_dir, "technique_v")).select("id", "technique_id", "name", "valid")
