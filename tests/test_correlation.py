import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duskwatch.functions import risk, rules
from duskwatch.operators import correlate, suppress
from duskwatch.plans.views import view

START = datetime(2024, 1, 1)
SCHEMA = (
    "id BIGINT, title STRING, description STRING, severity STRING, source STRING, hostname STRING, source_ip STRING,"
    " destination_ip STRING, username STRING, workflow_status STRING, created_at TIMESTAMP_NTZ"
)


def incident(i, seconds, source="Wazuh", title="Nmap scan", src="10.0.0.1", dst="10.0.0.2", host=None, user=None):
    return (i, title, "", "high", source, host, src, dst, user, "pending", START + timedelta(seconds=seconds))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "title,description,expected",
    [
        ("Nmap scan", None, "network_scan"),
        ("sshd: failed", "x", "authentication"),
        ("uri seen", None, "http"),
        ("Trojan found", None, "malware"),
        (None, None, "generic"),
        ("scan of HTTP server by port scan", None, "network_scan"),
    ],
)
def test_activity(spark, title, description, expected):
    df = spark.createDataFrame([(title, description)], "t STRING, d STRING")
    assert df.select(risk.activity(F.col("t"), F.col("d"))).first()[0] == expected


@pytest.mark.parametrize(
    "title,expected",
    [
        ("Credential stuffing", "credential_stuffing"),
        ("Password spray", "password_spraying"),
        ("SSH brute force", "brute_force"),
        ("SQLi attempt", "sql_injection"),
        ("stored XSS", "xss"),
        ("Remote code execution", "rce"),
        ("Mass encryption of files", "ransomware"),
        ("Backdoor", "malware"),
        ("nmap", "port_scan"),
        ("DDoS flood", "ddos"),
        ("Elevation of privilege", "privilege_escalation"),
        ("Lateral movement", "lateral_movement"),
        ("Data exfil", "data_exfiltration"),
        ("Malicious insider", "insider_threat"),
        ("C2 beacon", "command_and_control"),
        ("Something else", "unknown"),
    ],
)
def test_attack_type(spark, title, expected):
    df = spark.createDataFrame([(title,)], "t STRING")
    assert df.select(risk.attack_type(F.col("t"), F.lit(None))).first()[0] == expected


def related(df, **options):
    return {r["id"]: r["related_id"] for r in correlate.related_incidents(df, **options).collect()}


def test_pair_in_either_direction_and_window_edge(spark):
    rows = [incident(1, 0), incident(2, 300, "Suricata", src="10.0.0.2", dst="10.0.0.1"), incident(3, 601, "EDR")]
    assert related(frame(spark, rows)) == {2: 1}


def test_newest_candidates_are_cut_before_the_activity_test(spark):
    match = [incident(1, 0, "Suricata")]
    noise = [incident(10 + i, 1 + i, "EDR", title="Policy notice") for i in range(19)]
    asking = [incident(99, 100)]
    assert related(frame(spark, match + noise + asking))[99] == 1
    noise.append(incident(40, 50, "EDR", title="Policy notice"))
    assert 99 not in related(frame(spark, match + noise + asking))


def test_own_source_rows_do_not_use_up_candidates(spark):
    rows = [incident(1, 0, "Suricata")] + [incident(10 + i, 1 + i, title="Policy notice") for i in range(40)] + [incident(99, 100)]
    assert related(frame(spark, rows))[99] == 1


def test_row_without_source_matches_any_source_but_is_no_candidate(spark):
    rows = [incident(1, 0), incident(2, 10, None), incident(3, 20, "Suricata")]
    assert related(frame(spark, rows)) == {2: 1, 3: 1}


def brute_force_related(rows):
    acts = {}
    for r in rows:
        text = f" {r[1].lower()}  "
        acts[r[0]] = next((n for n, words in rules.ACTIVITY_RULES if any(w in text for w in words)), "generic")
    out = {}
    for r in rows:
        t, src, dst, host = r[10], r[6], r[7], r[5]
        pool = []
        for c in rows:
            if not ((c[10], c[0]) < (t, r[0]) and c[10] >= t - timedelta(minutes=5) and c[4] is not None and c[4] != r[4]):
                continue
            if src and dst:
                ok = (c[6], c[7]) in ((src, dst), (dst, src))
            elif src:
                ok = c[6] == src
            elif dst:
                ok = c[7] == dst
            else:
                ok = bool(host) and c[5] == host
            if ok:
                pool.append(c)
        pool = sorted(pool, key=lambda c: (c[10], c[0]), reverse=True)[: rules.CORRELATION_CANDIDATES]
        hit = next((c for c in pool if acts[c[0]] == acts[r[0]]), None)
        if hit:
            out[r[0]] = hit[0]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_related_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        incident(
            i, rng.randrange(2400), rng.choice(["Wazuh", "Suricata", "EDR", None]), rng.choice(["Nmap", "login", "notice"]),
            rng.choice(["a", "b", "", None]), rng.choice(["a", "b", None]), rng.choice(["h", None]),
        )
        for i in range(500)
    ]
    expected = brute_force_related(rows)
    assert related(frame(spark, rows)) == expected
    assert related(frame(spark, rows), cell_us=300_000_000) == expected


def test_ids_are_inherited_and_known_ids_kept(spark):
    df = frame(spark, [incident(1, 0), incident(2, 10, "Suricata"), incident(3, 20), incident(4, 4000)])
    ids = {r["id"]: r["correlation_id"] for r in correlate.correlate(df).collect()}
    assert ids[1] == ids[2] == ids[3] != ids[4]
    assert ids[1].startswith("SOC-")
    known = df.withColumn("correlation_id", F.when(F.col("id") == 1, "SOC-known"))
    ids = {r["id"]: r["correlation_id"] for r in correlate.correlate(known).collect()}
    assert ids[1] == ids[2] == ids[3] == "SOC-known"


def test_long_chains_resolve_to_their_first_row(spark):
    rng = random.Random(6)
    rows, root = [], {i: i for i in range(3)}
    for i in range(3, 600):
        parent = rng.randrange(max(0, i - 8), i)
        root[i] = root[parent]
        rows.append((i, parent, i * 1000))
    parents = spark.createDataFrame(rows, "id BIGINT, parent_id BIGINT, t BIGINT")
    got = {r["id"]: r["root_id"] for r in correlate.resolve_roots(parents).collect()}
    assert got == {i: root[i] for i in range(3, 600)}


def test_summary_and_primary(spark):
    rows = [incident(2, 0), incident(1, 0, "Suricata"), incident(3, 5, "EDR")]
    df = frame(spark, rows).withColumn("correlation_id", F.lit("SOC-x"))
    s = correlate.correlation_summary(df).first()
    assert (s["source_count"], s["confidence"], s["sources"]) == (3, "high", ["EDR", "Suricata", "Wazuh"])
    marked = {r["id"]: (r["is_primary"], r["workflow_status"]) for r in correlate.mark_correlated(df).collect()}
    assert marked == {1: (True, "pending"), 2: (False, "correlated"), 3: (False, "correlated")}


# --- repeat suppression ----------------------------------------------------
def brute_force_repeats(rows, fields_by_source, before=()):
    names = ("id", "title", "description", "severity", "source", "hostname", "source_ip", "destination_ip", "username", "ws", "created_at")
    kept = [dict(zip(names, r)) for r in before]
    out = {}
    for r in sorted((dict(zip(names, r)) for r in rows), key=lambda r: (r["created_at"], r["id"])):
        if r["source"] not in fields_by_source:
            continue
        hits = [
            k["id"]
            for k in kept
            if k["source"] == r["source"]
            and k["title"] == r["title"]
            and k["created_at"] >= r["created_at"] - timedelta(minutes=2)
            and all(not r[f] or k[f] == r[f] for f in fields_by_source[r["source"]])
        ]
        out[r["id"]] = max(hits) if hits else None
        if not hits:
            kept.append(r)
    return out


def verdicts(df, **options):
    return {r["id"]: r["duplicate_of"] for r in suppress.suppress_repeats(df, **options).collect()}


def test_chain_keeps_every_third_minute(spark):
    df = frame(spark, [incident(i, 60 * i) for i in range(7)])
    assert verdicts(df) == {0: None, 1: 0, 2: 0, 3: None, 4: 3, 5: 3, 6: None}


def test_missing_field_matches_anything(spark):
    rows = [incident(1, 0, host="h", user="u"), incident(2, 10, host=None, user=None), incident(3, 20, host="other", user="u")]
    assert verdicts(frame(spark, rows)) == {1: None, 2: 1, 3: None}


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    # Times ascend with the id, as ids are given out on arrival.
    times = sorted(rng.randrange(3600) for _ in range(600))
    rows = [
        incident(
            i, t, rng.choice(["Wazuh", "Wazuh", "Suricata", "EDR"]), rng.choice(["A", "A", "B"]),
            rng.choice(["a", "b", "", None]), rng.choice(["a", None]), rng.choice(["h", "g", None]), rng.choice(["u", None]),
        )
        for i, t in enumerate(times)
    ]
    expected = brute_force_repeats(rows, suppress.FIELDS_BY_SENSOR)
    df = frame(spark, rows)
    assert verdicts(df) == expected
    assert verdicts(df, span_us=300_000_000) == expected


def test_hot_key_split_into_spans(spark):
    rng = random.Random(5)
    times = sorted(rng.uniform(0, 7200) for _ in range(3000))
    rows = [incident(i, t) for i, t in enumerate(times)]
    assert verdicts(frame(spark, rows), span_us=600_000_000) == brute_force_repeats(rows, suppress.FIELDS_BY_SENSOR)


def test_incidents_kept_earlier_suppress(spark):
    before = [incident(1, 0), incident(2, 30, src=None)]
    rows = [incident(10, 60), incident(11, 100, src=None), incident(12, 130), incident(13, 400)]
    got = verdicts(frame(spark, rows), kept_before=frame(spark, before))
    assert got == brute_force_repeats(rows, suppress.FIELDS_BY_SENSOR, before)


def test_tasks_grow_with_the_incidents(spark, sf_dir, monkeypatch):
    """Merged to as many tasks as there are cores, a task's sorts grew with the table."""
    rows = view(spark, sf_dir, "incidents_v")
    expected = sorted(map(tuple, correlate.related_incidents(rows).collect()))
    monkeypatch.setattr(correlate, "TASK_INCIDENTS", 3)
    related = correlate.related_incidents(rows)
    assert related.rdd.getNumPartitions() == -(-rows.count() // 3)
    assert sorted(map(tuple, related.collect())) == expected
