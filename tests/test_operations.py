"""Metrics, response, lifecycle and response-text rules on literal rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import enrich, lifecycle, metrics, response, responses, search

T0 = datetime(2024, 1, 1)


def times_frame(spark, rows):
    schema = "id INT, event_timestamp TIMESTAMP_NTZ, detected_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ, disposition STRING, severity STRING"
    return spark.createDataFrame(rows, schema)


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def test_global_and_quality_metrics(spark):
    rows = [
        (1, at(0), at(10), at(110), "false_positive", "HIGH"),
        (2, at(0), at(30), at(170), "true_positive", "low"),
        (3, at(50), at(40), at(30), "unknown", "odd"),
        (4, None, at(0), None, None, "critical"),
    ]
    m = metrics.dashboard(times_frame(spark, rows)).first()
    assert (m["incidents_with_mttd"], m["average_mttd_seconds"], m["average_mttr_seconds"]) == (2, 20.0, 120.0)
    assert m["reviewed_incidents"] == 3 and m["false_positive_rate"] == pytest.approx(100 / 3)
    levels = {r["severity"]: r["incidents"] for r in metrics.severity_distribution(times_frame(spark, rows)).collect()}
    assert levels == {"critical": 1, "high": 1, "medium": 0, "low": 1}


def test_metrics_of_no_rows(spark):
    m = metrics.dashboard(times_frame(spark, [])).first()
    assert m["total_incidents"] == 0 and m["average_mttd_seconds"] is None and m["false_positive_rate"] is None
    gauges = {r["metric"]: r["value"] for r in metrics.gauges(times_frame(spark, [])).collect()}
    assert gauges["average_mttr_seconds"] != gauges["average_mttr_seconds"]


def changes(spark, statuses):
    rows = [(i, 1, s, at(i)) for i, s in enumerate(statuses)]
    df = spark.createDataFrame(rows, "change_id BIGINT, incident_id BIGINT, status STRING, changed_at TIMESTAMP_NTZ")
    return lifecycle.resolved_times(df).first()


@pytest.mark.parametrize(
    "statuses,second",
    [(["open", "resolved", "closed"], 1), (["resolved", "open"], None), (["resolved", "open", "closed", None], 2), (["resolved", None, "resolved"], 0)],
)
def test_resolved_time(spark, statuses, second):
    us = changes(spark, statuses)["resolved_us"]
    base = int(T0.timestamp()) * 1_000_000 if T0.tzinfo else 1704067200 * 1_000_000
    assert us == (None if second is None else base + second * 1_000_000)


def test_previous_value_across_blocks(spark):
    df = spark.createDataFrame([(1, i, f"s{i}") for i in range(0, 50, 3)], "k INT, id BIGINT, v STRING")
    got = {r["id"]: r["before"] for r in lifecycle.previous_in_key(df, "k", "id", "v", block_ids=10).collect()}
    assert got == {i: (f"s{i - 3}" if i else None) for i in range(0, 50, 3)}


def test_retry_cycle_stops_at_first_still_limited(spark):
    batch = spark.createDataFrame([(i,) for i in range(5)], "id INT")
    outcomes = spark.createDataFrame([(0, "completed"), (1, "failed"), (2, "rate_limited"), (3, "completed")], "id INT, outcome STRING")
    got = {r["id"]: r["outcome"] for r in lifecycle.retry_cycle(batch, outcomes).collect()}
    assert got == {0: "completed", 1: "failed", 2: "rate_limited"}


CASE = "incident_id INT, hostname STRING, source_ip STRING, username STRING, recommendation STRING"


@pytest.mark.parametrize(
    "case,expected",
    [
        ((1, "web1", None, None, "Isolate the host"), ("isolate_endpoint", "web1")),
        ((1, "unknown", None, None, "isolate it"), ("create_ticket", "unknown")),
        ((1, None, None, None, "isolate it"), ("create_ticket", "incident-1")),
        ((1, "web1", "8.8.8.8", None, "Block the script"), ("block_ip", "8.8.8.8")),
        ((1, "web1", "127.0.0.1", None, "block IP"), ("create_ticket", "web1")),
        ((1, None, None, "unknown", "disable the account"), ("disable_user", "unknown")),
        ((1, None, None, None, "disable the user"), ("create_ticket", "incident-1")),
        ((1, None, None, None, "notify people"), ("send_notification", "soc-team")),
        ((1, None, None, None, None), ("create_ticket", "incident-1")),
    ],
)
def test_proposed_action(spark, case, expected):
    row = response.propose_actions(spark.createDataFrame([case], CASE)).first()
    assert (row["action_type"], row["target"]) == expected


def test_approval_and_execution(spark):
    rows = [
        (1, 1, "block_ip", "127.0.0.1", "pending", True, None),
        (2, 2, "block_ip", "9.9.9.9", "pending", True, None),
        (3, 3, "disable_user", "N/A", "pending", True, None),
        (4, 4, "send_notification", "unknown-target", "approved", False, None),
        (5, 5, "create_ticket", "x", "pending", True, None),
    ]
    df = spark.createDataFrame(rows, "id INT, incident_id INT, action_type STRING, target STRING, status STRING, requires_approval BOOLEAN, approved BOOLEAN")
    yes = spark.createDataFrame([(1, True), (2, True), (3, True), (5, False)], "incident_id INT, approved BOOLEAN")
    decided = {r["id"]: (r["new_status"], r["new_approved"]) for r in response.decide_actions(df, yes).collect()}
    assert decided == {1: ("blocked_by_safety", False), 2: ("approved", True), 3: ("blocked_by_safety", False), 4: ("approved", None), 5: ("rejected", False)}
    approved = df.withColumn("approved", F.col("id") != 5)
    got = {r["id"]: r["outcome"] for r in response.execution_outcomes(approved).collect()}
    assert got == {1: "blocked_by_safety", 2: "simulated", 3: "blocked_by_safety", 4: "execution_failed", 5: "approval_required"}
    results = spark.createDataFrame([(2, True, False, True)], "id INT, success BOOLEAN, simulated BOOLEAN, executed BOOLEAN")
    assert {r["id"]: r["outcome"] for r in response.execution_outcomes(approved, results).collect()}[2] == "executed"


def analysed(spark, content, title="Nmap scan", severity="high", intel=False):
    df = spark.createDataFrame([(1, content, title, "d", severity, intel)], "id INT, content STRING, title STRING, description STRING, severity STRING, has_intel BOOLEAN")
    return responses.normalise_responses(df).first()


GOOD = {"summary": "s", "risk_level": "severe", "explanation": "e", "recommendation": "r", "mitre_technique": "T1"}


def test_last_complete_object_wins(spark):
    text = f"{json.dumps({**GOOD, 'summary': 'first'})} text {json.dumps(GOOD)} {{\"summary\": 1}} {{broken"
    r = analysed(spark, text)
    assert (r["parse_state"], r["summary"], r["risk_level"]) == ("ok", "s", "high")


def test_nested_object_and_many_braces(spark):
    text = "{" * 300 + json.dumps({"outer": GOOD})
    assert analysed(spark, text)["summary"] == "s"


def test_fallback_rows(spark):
    assert analysed(spark, "nothing")["parse_state"] == "unparsed"
    assert analysed(spark, '{"a": 1}')["parse_state"] == "incomplete"
    r = analysed(spark, json.dumps({**GOOD, "risk_level": "?", "mitre_technique": "", "recommendation": ["a", "", "b "]}))
    assert (r["risk_level"], r["mitre_technique"], r["recommendation"]) == ("high", "T1046 - Network Service Discovery", "1. a\n2. b")


def test_enrichment_gating(spark):
    iocs = spark.createDataFrame([("ip", "8.8.8.8"), ("ip", "10.0.0.1"), ("ip", "bad"), ("domain", "a.b"), ("ip", "8.8.8.8")], "ioc_type STRING, value STRING")
    feed = spark.createDataFrame([("ip", "8.8.8.8", 80, 6, 0, 1, 1), ("ip", "10.0.0.1", 99, 9, 9, 9, 0)],
                                 "ioc_type STRING, value STRING, abuse_score INT, malicious INT, suspicious INT, pulse_count INT, match_count INT")
    got = {(r["value"], r["provider"]): (r["status"], r["risk"]) for r in enrich.enrich(iocs, {p: feed for p in enrich.PROVIDERS}).collect()}
    assert len(got) == 4 * 3 + 3
    assert got["8.8.8.8", enrich.ABUSE] == ("success", "MALICIOUS")
    assert got["10.0.0.1", enrich.ABUSE] == ("skipped", None)
    assert got["10.0.0.1", enrich.INTERNAL] == ("success", "SAFE")
    assert got["bad", enrich.INTERNAL] == ("skipped", None)
    as_map = enrich.provider_map(enrich.enrich(iocs, {p: feed for p in enrich.PROVIDERS}))
    assert as_map.filter("value = 'a.b'").first()["providers"][enrich.PULSES]["status"] == "success"


def test_search_and_labels(spark):
    df = spark.createDataFrame([(7, " Web login ", "High"), (12345, "x", "low")], "id INT, title STRING, severity STRING")
    assert [r["id"] for r in search.faceted_search(df, ("id", "title"), " LOGIN", {"severity": "high "}).collect()] == [7]
    assert search.faceted_search(df, ("id", "title"), "", {"severity": "all"}).count() == 2
    assert [r[0] for r in df.select(search.incident_label(F.col("id"))).collect()] == ["INC-0007", "INC-12345"]
