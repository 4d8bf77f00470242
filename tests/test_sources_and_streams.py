import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from duskwatch.operators import correlate, knowledge, normalise, suppress
from duskwatch.sources import datasets as flow_files
from duskwatch.sources import knowledge as catalogues
from duskwatch.sources import sensors, sinks
from duskwatch.streaming import jobs

HOST = {"timestamp": "2025-02-04T14:25:34Z", "rule": {"id": "5710", "level": 12, "description": "SSH brute force", "mitre": {"id": ["T1110"]}},
        "agent": {"id": "001", "name": "web1"}, "data": {"srcip": "1.2.3.4", "srcuser": "root"}, "full_log": "log"}


def host(spark, tmp_path, *alerts, **options):
    file = tmp_path / "alerts.json"
    file.write_text("\n".join(a if isinstance(a, str) else json.dumps(a) for a in alerts))
    return normalise.split_rejects(normalise.normalise_host_alerts(sensors.read_host_alerts(spark, str(file)), **options))


def test_host_alert(spark, tmp_path):
    good, bad = host(spark, tmp_path, HOST, {"_source": HOST}, {}, {"_source": {}}, {"x": 1}, "broken{")
    rows = good.collect()
    assert len(rows) == 2 and bad.count() == 4
    assert {(r["severity"], r["hostname"], r["source_ip"], r["username"], r["rule_level"]) for r in rows} == {("critical", "web1", "1.2.3.4", "root", 12)}
    assert rows[0]["mitre_ids"] == ["T1110"]


def test_scan_rule_and_lab_pair(spark, tmp_path):
    scan = {"rule": {"id": "100100"}, "agent": {"id": "000"}, "data": {"command": "nmap 9.9.9.9 192.168.66.149"}}
    assert host(spark, tmp_path, scan)[0].select("source_ip", "destination_ip").first() == (None, "192.168.66.149")
    pair = host(spark, tmp_path, scan, lab_pair=("192.168.66.149", "192.168.66.144"))[0].first()
    assert pair["source_ip"] == "192.168.66.144" and pair["title"] == "Wazuh security alert"


def test_flow_csv_with_repeated_header(spark, tmp_path):
    file = tmp_path / "f.csv"
    file.write_text(" A , Fwd Header Length,Fwd Header Length, Label\n1,2,3,BENIGN\n4,5,6, DDoS \n")
    df = flow_files.read_flow_csv(spark, str(file))
    assert df.columns == ["A", "Fwd Header Length", "Fwd Header Length.1", "Label"] and df.count() == 2
    with pytest.raises(AnalysisException):
        flow_files.read_flow_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="missing required"):
        flow_files.read_unsw_csv(spark, str(file))


def test_catalogue_scans(spark, tmp_path):
    cves = tmp_path / "cves"
    cves.mkdir()
    record = {"cveMetadata": {"cveId": "CVE-2024-1", "state": "PUBLISHED"}, "containers": {"cna": {"descriptions": [{"lang": "en", "value": " d "}]}}}
    (cves / "CVE-2024-1.json").write_text(json.dumps(record, indent=1))
    (cves / "CVE-2024-2.json").write_text("{not json")
    (cves / "other.json").write_text(json.dumps(record))
    fields = knowledge.cve_fields(catalogues.read_cve_records(spark, str(cves)))
    assert [(r["cve_id"], r["title"], r["description"]) for r in fields.collect()] == [("CVE-2024-1", "CVE-2024-1", "d")]
    assert knowledge.render_cve(fields).first()["text"] == "## CVE-2024-1 - CVE-2024-1\n\n**CVE ID:** CVE-2024-1\n**State:** PUBLISHED\n\n### Description\nd"

    xml = tmp_path / "cwe.xml"
    xml.write_text('<?xml version="1.0"?><Cat xmlns="http://c/7"><Weaknesses><Weakness ID="79" Name="XSS" Status="Stable"><Description>a &lt; b</Description>'
                   '<Common_Consequences><Consequence><Scope>S</Scope><Impact>I &amp;amp; J</Impact></Consequence></Common_Consequences></Weakness></Weaknesses></Cat>')
    row = knowledge.weakness_fields(catalogues.read_weaknesses(spark, str(xml))).first()
    assert (row["cwe_id"], row["description"], row["consequences"], row["related"]) == ("CWE-79", "a < b", ["S I & J"], [])

    bundle = tmp_path / "b.json"
    bundle.write_text(json.dumps({"type": "bundle", "objects": [
        {"type": "attack-pattern", "name": "N", "external_references": [{"source_name": "mitre-attack", "external_id": "T1", "url": "u"}]},
        {"type": "attack-pattern", "name": "R", "revoked": True, "external_references": [{"source_name": "mitre-attack", "external_id": "T2"}]}]}))
    live = knowledge.technique_fields(catalogues.read_technique_objects(spark, str(bundle))).collect()
    assert [(r["technique_id"], r["tactics"]) for r in live] == [("T1", [])]


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "kb" / "notes").mkdir(parents=True)
    (tmp_path / "kb" / "notes" / "a.md").write_text("text")
    (tmp_path / "kb" / "blank.md").write_text(" \n")
    (tmp_path / "kb" / "x.txt").write_text("no")
    assert [(r["path"], r["content"]) for r in catalogues.read_markdown_tree(spark, str(tmp_path / "kb")).collect()] == [("notes/a.md", "text")]


def test_files_of_one_row_each(spark, tmp_path):
    folder = tmp_path / "files"
    files = spark.createDataFrame([("a/x.md", "É\ntext\r\n"), ("a/blank.md", " \n"), ("b/c/null.md", None), ("b/y.txt", "no")], "path STRING, content STRING")
    for _ in range(2):
        sinks.write_files(files, str(folder))
    assert sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()) == ["a/blank.md", "a/x.md", "b/c/null.md", "b/y.txt"]
    assert [tuple(r) for r in catalogues.read_markdown_tree(spark, str(folder)).collect()] == [("a/x.md", "É\ntext\r\n")]
    sinks.write_files(files, f"file://{folder}-2")
    assert catalogues.read_markdown_tree(spark, f"{folder}-2").count() == 1


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k INT, v STRING")
    assert sinks.append_once(rows, path, ["k"]).count() == 2
    assert sinks.append_once(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), path, ["k"]).count() == 1
    assert spark.read.parquet(path).count() == 3


def test_incident_defaults_and_sections(spark, tmp_path):
    sinks.append_incidents(spark.createDataFrame([(1, None)], "id INT, severity STRING"), str(tmp_path / "i"))
    row = spark.read.parquet(str(tmp_path / "i")).first()
    assert (row["severity"], row["status"], row["disposition"], row["workflow_status"]) == ("medium", "open", "unknown", "pending")
    sections = spark.createDataFrame([("b", "two"), ("a", "one")], "doc_key STRING, text STRING")
    sinks.write_sections(sections, str(tmp_path / "s"))
    sinks.write_section_text(sections, str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert spark.read.text(str(tmp_path / "st")).filter("value = 'one'").count() == 1


def staged(spark, folder, rows, schema, parts):
    """Rows as files that a stream reads one by one, in time order."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


SCHEMA = "id BIGINT, title STRING, description STRING, source STRING, severity STRING, hostname STRING, source_ip STRING, destination_ip STRING, username STRING, created_at TIMESTAMP_NTZ"


def stream_rows():
    start = datetime(2024, 1, 1)
    out = []
    for i in range(120):
        source = ("Wazuh", "Suricata")[i % 2]
        out.append((i, "Nmap" if i % 3 else "login", "", source, "high", "h" if i % 5 else None, f"10.0.0.{i % 2}", "10.0.1.1", "u" if i % 4 else None, start + timedelta(seconds=17 * i)))
    return out


def test_stream_suppression_equals_batch(spark, tmp_path):
    rows = stream_rows()
    stream = staged(spark, tmp_path / "in", rows, SCHEMA, 3)
    kept, repeats = str(tmp_path / "kept"), str(tmp_path / "repeats")
    jobs.run_available(spark, jobs.suppress_stream(stream, kept, repeats))
    batch = {r["id"]: r["duplicate_of"] for r in suppress.suppress_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r["id"]: r["duplicate_of"] for r in spark.read.parquet(repeats).collect()} == {k: v for k, v in batch.items() if v is not None}
    assert spark.read.parquet(kept).select(F.max("epoch")).first()[0] == 2


def test_stream_correlation_equals_batch(spark, tmp_path):
    rows = stream_rows()
    stream = staged(spark, tmp_path / "in", rows, SCHEMA, 3)
    out = str(tmp_path / "out")
    jobs.run_available(spark, jobs.correlate_stream(stream, out))
    batch = {r["id"]: r["correlation_id"] for r in correlate.correlate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r["id"]: r["correlation_id"] for r in spark.read.parquet(out).collect()} == batch


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    t = datetime(2024, 1, 1)
    minutes = [("high", 0), ("HIGH", 1), ("low", 120), ("low", 121), ("high", 2), ("low", 240)]
    rows = [(severity, t + timedelta(minutes=m)) for severity, m in minutes]
    # A batch drops what was late when the batch before it began.
    stream = staged(spark, tmp_path / "in", rows, "severity STRING, created_at TIMESTAMP_NTZ", len(rows))
    out = str(tmp_path / "out")
    jobs.run_available(spark, jobs.update_parquet(jobs.severity_windows(stream), out))
    got = {(r["severity"], r["incidents"]) for r in jobs.latest(spark, out, "start_us", "end_us", "severity").collect()}
    # The last window is still open when the input ends, and is there all the same.
    assert got == {("high", 2), ("low", 2), ("low", 1)}


def test_a_late_batch_opens_recent_hours_only(spark, tmp_path):
    out, start = str(tmp_path / "out"), datetime(2024, 1, 1)
    for epoch in range(6):
        rows = spark.createDataFrame([(epoch, start + timedelta(hours=epoch))], "id BIGINT, created_at TIMESTAMP_NTZ")
        jobs.write_epoch(rows, out, epoch)
    moment = int((start - datetime(1970, 1, 1)).total_seconds() * 1e6) + 5 * jobs.HOUR_US
    rows = jobs.stored_before(spark, out, 9, moment - 120_000_000, moment)
    assert len(rows.inputFiles()) == 2 and [r["id"] for r in rows.collect()] == [5]
    assert jobs.stored_before(spark, out, 9, moment - 40 * jobs.HOUR_US, moment - 30 * jobs.HOUR_US) is None


def test_stage_tables_go_when_a_micro_batch_ends(spark, tmp_path):
    import os

    stream = staged(spark, tmp_path / "in", stream_rows(), SCHEMA, 3)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    jobs.run_available(spark, jobs.correlate_stream(stream, str(tmp_path / "out")))
    assert {n for n in set(os.listdir(folder)) - before if n.startswith(("job-", "stage-"))} == set()


def test_odd_field_types_cost_no_alert(spark, tmp_path):
    lines = [{"event_type": "alert", "src_ip": "1.1.1.1", "src_port": "443", "alert": {"severity": "high"}}, {"event_type": "alert", "src_port": 1, "alert": {"severity": "1"}},
             {"event_type": "alert", "alert": {"severity": 2}}, {"event_type": "alert", "alert": "text"}]
    file = tmp_path / "eve.json"
    file.write_text("\n".join(json.dumps(x) for x in lines) + "\n[1]\n")
    good, bad = normalise.split_rejects(normalise.normalise_network_alerts(sensors.read_network_events(spark, str(file))))
    assert sorted(r["severity"] for r in good.collect()) == ["critical", "high", "medium", "medium"] and bad.count() == 1
    wrapped = {**HOST, "_source": "text", "rule": {**HOST["rule"], "mitre": {"id": "T1110"}}}
    good, bad = host(spark, tmp_path, wrapped, {**HOST, "agent": "x"})
    assert [r["mitre_ids"] for r in good.collect()] == [["T1110"]] * 2 and bad.count() == 0


def test_each_line_is_parsed_once(spark):
    from duskwatch.schemas import HOST_ALERT

    lines = spark.createDataFrame([("{}",)], "raw STRING")
    good, _ = normalise.split_rejects(normalise.normalise_host_alerts(sensors.parse_lines(lines, "raw", HOST_ALERT)))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(rule") == 1


def test_small_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """A deep tree, hidden names, encodings, empty and broken files; no task for each few dozen files."""
    deep = tmp_path / "tree" / "a" / "b"
    deep.mkdir(parents=True)
    record = json.dumps({"cveMetadata": {"cveId": "CVE-2024-É", "state": "PUBLISHED"}, "containers": {"cna": {}}}, ensure_ascii=False)
    for name, raw in (("CVE-1", record.encode()), ("CVE-2", record.encode("utf-8-sig")), ("CVE-3", record.encode("utf-16")), ("CVE-4", b""), ("CVE-5", record.encode()[:40]), (".CVE-6", record.encode()), ("cve-7", record.encode())):
        (deep / f"{name}.json").write_bytes(raw)
    (tmp_path / "tree" / "_hidden").mkdir()
    (tmp_path / "tree" / "_hidden" / "CVE-8.json").write_bytes(record.encode())
    for root in (str(tmp_path / "tree"), f"file://{tmp_path}/tree/"):
        assert [r["cveMetadata"]["cveId"] for r in catalogues.read_cve_records(spark, root).collect()] == ["CVE-2024-É"] * 3
    sinks.write_files(spark.range(2_000).selectExpr("concat(id % 3, '/', id, '.md') AS path", "concat('text ', id) AS content"), str(tmp_path / "many"))
    many = catalogues.read_markdown_tree(spark, str(tmp_path / "many"))
    assert many.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in many.collect()} == {(f"{i % 3}/{i}.md", f"text {i}") for i in range(2_000)}
