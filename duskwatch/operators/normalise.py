"""Raw sensor records to incident rows, with rejects kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import risk, rules
from duskwatch.functions.columns import first_truthy, norm, parse_iso_utc, truthy
from duskwatch.schemas import HOST_BODY_FIELDS
from duskwatch.sources.sensors import unreadable

REJECT = "reject_reason"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def split_rejects(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of a frame with a ``reject_reason`` column."""
    return judged.filter(F.col(REJECT).isNull()).drop(REJECT), judged.filter(F.col(REJECT).isNotNull())


def _last_ipv4(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rules.IPV4), F.lit(0)), F.lit(-1))


def listed(value: Column) -> Column:
    """A list's JSON text as a list; any other text as a list of it; nothing as an empty list."""
    return F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))


def normalise_host_alerts(raw: DataFrame, lab_pair: tuple[str, str] | None = None) -> DataFrame:
    """Host-sensor alerts (``schemas.HOST_ALERT``) to incident columns plus ``reject_reason``.

    ``lab_pair`` is an optional (destination, source) pair filled in for scans seen by the
    manager's own agent; it is off unless given. Other columns of ``raw`` are passed on.
    """
    body_fields = HOST_BODY_FIELDS
    body = F.coalesce(F.col("_source"), F.struct(*body_fields))
    passed = [c for c in raw.columns if c not in body_fields and c not in ("_source", "_corrupt_record")]
    df = raw.select(*passed, "_corrupt_record", F.col("_source").isNotNull().alias("wrapped"), body.alias("b"))

    recognised = F.lit(False)
    for f in body_fields:
        recognised = recognised | F.col(f"b.{f}").isNotNull()
    reject = (
        F.when(unreadable(), "not a JSON object")
        .when(~recognised, "no recognised alert field")
    )

    rule, agent, data = F.col("b.rule"), F.col("b.agent"), F.col("b.data")
    is_scan = F.coalesce(rule["id"] == rules.SCAN_RULE_ID, F.lit(False))
    source_ip = first_truthy(data["srcip"], data["src_ip"], data["source_ip"])
    source_ip = F.coalesce(source_ip, F.when(is_scan, first_truthy(agent["ip"], data["agent_ip"], data["host_ip"])))
    destination_ip = first_truthy(data["dstip"], data["dst_ip"], data["destination_ip"])
    scan_target = F.coalesce(_last_ipv4(data["command"]), _last_ipv4(F.col("b.full_log")))
    destination_ip = F.coalesce(destination_ip, F.when(is_scan, scan_target))
    if lab_pair:
        is_local = is_scan & (agent["id"] == rules.LOCAL_AGENT_ID) & (destination_ip == lab_pair[0])
        source_ip = F.coalesce(source_ip, F.when(is_local, F.lit(lab_pair[1])))
    title = F.coalesce(truthy(rule["description"]), F.lit(rules.HOST_DEFAULT_TITLE))
    return df.select(
        *passed,
        title.alias("title"),
        F.coalesce(first_truthy(F.col("b.full_log"), F.col("b.message")), title).alias("description"),
        risk.severity_from_level(rule["level"]).alias("severity"),
        F.lit("open").alias("status"),
        F.lit(rules.HOST_SENSOR).alias("source"),
        first_truthy(agent["name"], data["hostname"], F.col("b.predecoder.hostname")).alias("hostname"),
        source_ip.alias("source_ip"),
        destination_ip.alias("destination_ip"),
        first_truthy(data["srcuser"], data["dstuser"], data["user"], data["username"]).alias("username"),
        parse_iso_utc(F.col("b.timestamp")).alias("event_timestamp"),
        rule["id"].alias("rule_id"),
        F.coalesce(rule["level"].try_cast("int"), F.lit(0)).alias("rule_level"),
        listed(rule["mitre"]["id"]).alias("mitre_ids"),
        listed(rule["mitre"]["technique"]).alias("mitre_techniques"),
        listed(rule["mitre"]["tactic"]).alias("mitre_tactics"),
        reject.alias(REJECT),
    )


def normalise_network_alerts(raw: DataFrame) -> DataFrame:
    """Network-sensor events (``schemas.EVE_EVENT``) to incident columns plus ``reject_reason``."""
    known = {"event_type", "timestamp", "src_ip", "dest_ip", "src_port", "dest_port", "proto", "alert", "flow", "tcp", "_corrupt_record"}
    passed = [c for c in raw.columns if c not in known]
    alert = F.col("alert")

    def endpoint(label: str, ip: str, port: str) -> Column:
        suffix = F.coalesce(F.concat(F.lit(":"), F.col(port).cast("string")), F.lit(""))
        return F.concat(F.lit(f"{label}: "), truthy(F.col(ip)), suffix)

    described = F.concat_ws(
        "; ",
        F.concat(F.lit("Category: "), truthy(alert["category"])),
        endpoint("Source", "src_ip", "src_port"),
        endpoint("Destination", "dest_ip", "dest_port"),
        F.concat(F.lit("Protocol: "), truthy(F.col("proto"))),
        F.concat(F.lit("Signature ID: "), alert["signature_id"].cast("string")),
    )
    reject = (
        F.when(unreadable(), "not a JSON object")
        .when(~F.col("event_type").eqNullSafe("alert"), "event type is not alert")
    )
    return raw.select(
        *passed,
        F.coalesce(truthy(alert["signature"]), F.lit(rules.NETWORK_DEFAULT_TITLE)).alias("title"),
        F.coalesce(truthy(described), F.lit(rules.NETWORK_DEFAULT_DESCRIPTION)).alias("description"),
        risk.severity_from_number(alert["severity"].try_cast("int")).alias("severity"),
        F.lit("open").alias("status"),
        F.lit(rules.NETWORK_SENSOR).alias("source"),
        _none().alias("hostname"),
        F.col("src_ip").alias("source_ip"),
        F.col("dest_ip").alias("destination_ip"),
        _none().alias("username"),
        parse_iso_utc(F.col("timestamp")).alias("event_timestamp"),
        alert["signature_id"].try_cast("bigint").alias("signature_id"),
        reject.alias(REJECT),
    )


def triage(incidents: DataFrame) -> DataFrame:
    severity = norm(F.coalesce(F.col("severity"), F.lit("medium")))
    return incidents.select(
        "id",
        F.lit("triaged").alias("status"),
        severity.alias("severity"),
        F.upper(severity).alias("priority"),
        risk.attack_type(F.col("title"), F.col("description")).alias("attack_type"),
    )


def alerts_from_incidents(incidents: DataFrame) -> DataFrame:
    """The alert row stored beside each new incident."""
    return incidents.select(
        F.col("id").alias("incident_id"),
        "title",
        "description",
        "source",
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.lit("new").alias("status"),
        "created_at",
    )


def with_incident_defaults(rows: DataFrame) -> DataFrame:
    """Fill the defaults a new incident row gets."""
    now = F.current_timestamp().cast("timestamp_ntz")
    defaults = {
        "severity": F.lit("medium"),
        "status": F.lit("open"),
        "disposition": F.lit("unknown"),
        "workflow_status": F.lit("pending"),
        "detected_at": now,
        "created_at": now,
    }
    return _filled(rows, defaults)


def _filled(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()})


def with_alert_defaults(rows: DataFrame) -> DataFrame:
    """Fill the defaults a new alert row gets."""
    return _filled(rows, {"severity": F.lit("medium"), "status": F.lit("new"), "created_at": F.current_timestamp().cast("timestamp_ntz")})


def with_analysis_defaults(rows: DataFrame) -> DataFrame:
    """Fill the defaults a new analysis row gets."""
    no = F.lit(False)
    return _filled(rows, {"mitre_valid": no, "human_approval_required": no, "correlated_incident_count": F.lit(0), "created_at": F.current_timestamp().cast("timestamp_ntz")})


def with_report_defaults(rows: DataFrame) -> DataFrame:
    """Fill the defaults a new report row gets."""
    return _filled(rows, {"correlated_incident_count": F.lit(0), "created_at": F.current_timestamp().cast("timestamp_ntz")})
