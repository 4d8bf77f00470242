"""Derived security tables over the given star-schema tables.

Each view is one SQL text used on both engines. ``@t(x)`` names an input table,
``@us``/``@ts`` convert between timestamps and microseconds, `` @div `` is
integer division, ``@arr(`` an array constructor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from duskwatch.session import dealt, prepare

_EVENT_US = "(1704067200000000 + (@us(ts) - 1704067200000000) @div 20"

VIEWS: dict[str, str] = {}

VIEWS["incidents_v"] = f"""
SELECT event_id AS id,
  CASE event_type WHEN 'error' THEN 'Nmap port scan detected' WHEN 'signup' THEN 'sshd: brute force login'
    WHEN 'view' THEN 'HTTP request cleartext' WHEN 'purchase' THEN 'Trojan malware beacon' ELSE 'Policy notice' END AS title,
  concat('value ', CAST(CAST(floor(value) AS INT) AS STRING), ' from 10.0.0.', CAST(user_id % 6 AS STRING)) AS description,
  CASE WHEN value >= 60 THEN 'critical' WHEN value >= 30 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN event_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'unknown' END AS disposition,
  CASE event_id % 3 WHEN 0 THEN 'Wazuh' WHEN 1 THEN 'Suricata' ELSE 'EDR' END AS source,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('host-', CAST(user_id % 4 AS STRING)) END AS hostname,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id % 6 AS STRING)) END AS source_ip,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('10.0.1.', CAST(user_id % 2 AS STRING)) END AS destination_ip,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('u', CAST(user_id % 3 AS STRING)) END AS username,
  CASE event_id % 6 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'waiting_for_human' ELSE 'completed' END AS workflow_status,
  @ts({_EVENT_US} - 5000000)) AS event_timestamp,
  @ts({_EVENT_US})) AS detected_at,
  @ts({_EVENT_US})) AS created_at,
  CASE WHEN event_id % 5 = 0 THEN @ts({_EVENT_US} + 1000000 * (event_id % 97))) END AS resolved_at
FROM @t(events)
"""

VIEWS["alerts_v"] = f"""
SELECT event_id AS id, concat(event_type, ' alert') AS title,
  concat('value ', CAST(CAST(floor(value) AS INT) AS STRING)) AS description,
  CASE event_id % 3 WHEN 0 THEN 'Wazuh' WHEN 1 THEN 'Suricata' ELSE 'EDR' END AS source,
  CASE WHEN value >= 60 THEN 'Critical' WHEN value >= 30 THEN 'high' WHEN value >= 10 THEN ' medium' ELSE 'low' END AS severity,
  CASE event_id % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'New' WHEN 2 THEN 'closed' WHEN 3 THEN 'in_progress'
    WHEN 4 THEN 'investigating' WHEN 5 THEN '' ELSE 'resolved' END AS status,
  @ts({_EVENT_US})) AS created_at
FROM @t(events)
"""

VIEWS["analysis_v"] = f"""
SELECT event_id + 1000000 AS id, event_id % 2500 AS incident_id,
  concat('summary of ', event_type) AS summary, concat('because value is ', CAST(CAST(floor(value) AS INT) AS STRING)) AS explanation,
  CASE event_id % 6 WHEN 0 THEN 'Isolate the endpoint now' WHEN 1 THEN 'Block the source IP' WHEN 2 THEN 'Disable the user account'
    WHEN 3 THEN 'Notify the team' WHEN 4 THEN 'block the script' ELSE 'Review logs' END AS recommendation,
  CASE WHEN value >= 60 THEN 'critical' WHEN value >= 30 THEN 'High' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN '' ELSE concat('T', CAST(1000 + user_id % 40 AS STRING)) END AS mitre_technique,
  CASE WHEN event_id % 9 <= 2 THEN NULL ELSE concat('technique ', CAST(user_id % 40 AS STRING)) END AS mitre_name,
  (event_id % 9 > 2 AND event_id % 2 = 0) AS mitre_valid,
  (value >= 30) AS human_approval_required,
  CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'Pending' ELSE NULL END AS human_review_status,
  CASE event_id % 4 WHEN 0 THEN 'approved_for_response' WHEN 1 THEN 'blocked' ELSE 'not_executed' END AS response_status,
  concat('thread-', CAST(event_id % 4000 AS STRING)) AS thread_id, 'model-a' AS model_used,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 3 + 4 END AS trace_length,
  @ts({_EVENT_US} + 2000000)) AS created_at
FROM @t(events)
"""

VIEWS["report_v"] = f"""
SELECT event_id + 2000000 AS id, event_id % 2500 AS incident_id, event_id + 1000000 AS ai_analysis_id,
  concat('thread-', CAST(event_id % 4000 AS STRING)) AS thread_id, concat(event_type, ' report') AS title,
  concat('summary of ', event_type) AS summary,
  CASE WHEN value >= 60 THEN 'critical' WHEN value >= 30 THEN 'High' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE event_id % 5 WHEN 0 THEN 'not_available' WHEN 1 THEN 'failed' ELSE 'success' END AS ml_status,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'DDoS' ELSE 'BENIGN' END AS ml_prediction,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'hybrid' ELSE 'isolation_forest' END AS ml_engine,
  CASE WHEN event_id % 5 < 2 THEN NULL ELSE event_id % 10 = 7 END AS ml_is_anomaly,
  CASE WHEN event_id % 5 >= 2 THEN CAST(event_id % 100 AS DOUBLE) / 128 END AS ml_anomaly_score,
  CASE event_id % 5 WHEN 2 THEN 'DDoS=0.75 BENIGN=0.25' WHEN 3 THEN 'DDoS=0.5 BENIGN=0.5' END AS ml_probabilities,
  CASE WHEN event_id % 5 IN (2, 3) THEN 'DDoS' END AS random_forest_prediction,
  CASE WHEN event_id % 5 = 2 THEN 'DDoS' END AS xgboost_prediction,
  CASE WHEN event_id % 5 >= 2 THEN 'NORMAL' END AS isolation_forest_prediction,
  CASE event_id % 9 WHEN 0 THEN NULL ELSE concat('T', CAST(1000 + user_id % 40 AS STRING)) END AS mitre_technique,
  CASE event_id % 9 WHEN 0 THEN NULL ELSE concat('technique ', CAST(user_id % 40 AS STRING)) END AS mitre_name,
  'Review logs' AS recommendation,
  CASE event_id % 4 WHEN 0 THEN 'approved_for_response' WHEN 1 THEN 'blocked' ELSE 'not_executed' END AS response_status,
  CASE event_id % 4 WHEN 0 THEN 'waiting_for_human' WHEN 1 THEN 'rejected' WHEN 2 THEN 'Pending' ELSE NULL END AS human_review_status,
  @ts({_EVENT_US} + 3000000)) AS created_at
FROM @t(events)
"""

VIEWS["action_v"] = """
SELECT o_orderkey AS id, o_custkey AS incident_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'isolate_endpoint' WHEN '2-HIGH' THEN 'block_ip' WHEN '3-MEDIUM' THEN 'disable_user'
    WHEN '4-NOT SPECIFIED' THEN 'send_notification' ELSE 'create_ticket' END AS action_type,
  CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Unknown ' WHEN 3 THEN '127.0.0.1' WHEN 4 THEN '224.0.0.5'
    WHEN 5 THEN '0.0.0.0' WHEN 6 THEN 'n/a' WHEN 7 THEN '999.1.2.3' WHEN 8 THEN 'unknown-user'
    ELSE concat('10.0.', CAST(o_custkey % 200 AS STRING), '.', CAST(o_orderkey % 250 AS STRING)) END AS target,
  CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'simulated' WHEN 3 THEN 'executed'
    WHEN 4 THEN 'blocked_by_safety' ELSE 'rejected' END AS status,
  (o_orderkey % 3 <> 0) AS requires_approval,
  CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN TRUE ELSE FALSE END AS approved,
  @ts(@us(o_orderdate) + o_orderkey) AS created_at
FROM @t(orders)
"""

VIEWS["action_log_v"] = """
SELECT o_orderkey AS id, o_custkey AS action_id, o_custkey AS incident_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'approved' WHEN 2 THEN 'simulated' ELSE 'executed' END AS event_type,
  CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'pending' ELSE 'approved' END AS previous_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'simulated' ELSE 'executed' END AS new_status,
  @ts(@us(o_orderdate)) AS created_at
FROM @t(orders)
"""

VIEWS["status_change_v"] = """
SELECT o_orderkey AS change_id, o_custkey AS incident_id,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'closed' ELSE 'investigating' END
    ELSE CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'open' END END AS status,
  @ts(@us(o_orderdate)) AS changed_at
FROM @t(orders)
"""

VIEWS["decision_v"] = """
SELECT event_id AS incident_id, (event_id % 2 = 0) AS approved, concat('comment ', event_type) AS comment
FROM @t(events) WHERE event_id % 4 <> 3
"""

VIEWS["flow_v"] = """
SELECT l_orderkey AS flow_id, l_linenumber AS line_no, CAST(l_suppkey % 1024 AS DOUBLE) AS destination_port,
  l_quantity AS pkts_to_server, CAST(l_partkey % 50 AS DOUBLE) AS pkts_to_client,
  l_extendedprice AS bytes_to_server, l_extendedprice * l_discount AS bytes_to_client,
  CAST(l_orderkey % 30 AS DOUBLE) AS duration_seconds,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS alerted
FROM @t(lineitem)
"""

VIEWS["feed_v"] = """
SELECT 'ip' AS ioc_type, concat('10.0.0.', CAST(s_suppkey % 8 AS STRING)) AS value,
  MAX(CAST(s_suppkey % 101 AS INT)) AS abuse_score, SUM(CAST(s_suppkey % 3 AS INT)) AS malicious, COUNT(*) AS pulse_count
FROM @t(supplier) GROUP BY concat('10.0.0.', CAST(s_suppkey % 8 AS STRING))
"""

VIEWS["kb_v"] = """
SELECT vec_id AS chunk_id, embedding,
  CASE vec_id % 4 WHEN 0 THEN 'cve' WHEN 1 THEN 'cwe' WHEN 2 THEN 'mitre_attack' ELSE 'soc_knowledge' END AS document_type,
  CASE vec_id % 4 WHEN 0 THEN concat('CVE-2024-', CAST(1000 + vec_id % 40 AS STRING)) WHEN 1 THEN concat('CWE-', CAST(vec_id % 40 AS STRING))
    WHEN 2 THEN concat('T', CAST(1000 + vec_id % 40 AS STRING)) ELSE concat('doc-', CAST(vec_id % 25 AS STRING)) END AS doc_key
FROM @t(embeddings)
"""

VIEWS["request_log_v"] = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, concat('/', event_type) AS path,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value / 1000 AS duration_s, ts
FROM @t(events)
"""

VIEWS["audit_v"] = """
SELECT event_id AS id, concat('auth.', event_type) AS event_type,
  CASE WHEN event_id % 7 = 0 THEN 'failure' ELSE 'success' END AS outcome,
  concat('user-', CAST(user_id AS STRING)) AS actor_subject, 'incident' AS resource_type, CAST(event_id % 100 AS STRING) AS resource_id, ts
FROM @t(events)
"""

VIEWS["technique_v"] = """
SELECT concat('T', CAST(1000 + p_partkey AS STRING)) AS technique_id, p_name AS name, p_type AS description FROM @t(part)
"""

VIEWS["text_v"] = """
SELECT doc_id AS text_id, 'document' AS kind, text FROM @t(documents)
UNION ALL SELECT page_id AS text_id, 'page' AS kind, concat(url, ' ', html) AS text FROM @t(pages)
"""


# Host-sensor alert lines: some empty, some unreadable, a third wrapped in _source.
VIEWS["host_line_v"] = """
SELECT event_id, kind,
  CASE kind WHEN 0 THEN '{}' WHEN 1 THEN '{"_source":{}}' WHEN 2 THEN 'no json here' WHEN 3 THEN '{"foo": 1}'
    ELSE CASE event_id % 3 WHEN 0 THEN concat('{"_source":', body, '}') WHEN 1 THEN concat('{"_source":"none",', substr(body, 2)) ELSE body END END AS raw
FROM (
  SELECT event_id, event_id % 20 AS kind, concat(
    '{"rule":{"id":"', CASE WHEN event_id % 5 = 0 THEN '100100' ELSE '5710' END, '","level":',
    CASE event_id % 6 WHEN 0 THEN '"x"' WHEN 1 THEN '3' WHEN 2 THEN '7' WHEN 3 THEN '"11"' WHEN 4 THEN '12' ELSE '15' END,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"description":"', event_type, ' rule"') END,
    CASE event_id % 5 WHEN 2 THEN ',"mitre":{"id":"T1110"}' WHEN 3 THEN ',"mitre":{"id":["T1","T2"]}' WHEN 4 THEN ',"mitre":"none"' ELSE '' END,
    '},"agent":{"id":"00', CAST(user_id % 3 AS STRING), '","name":"', CASE WHEN event_id % 8 = 0 THEN '' ELSE concat('agent', CAST(user_id % 4 AS STRING)) END,
    '","ip":"10.9.0.', CAST(user_id % 9 AS STRING), '"},"data":{',
    CASE event_id % 4 WHEN 0 THEN '"src_ip":"10.0.0.1"' WHEN 1 THEN '"srcip":"","source_ip":"10.0.0.2"' WHEN 2 THEN '"command":"nmap 10.1.1.1 then 10.2.2.2"' ELSE '"dstip":"10.3.3.3"' END,
    ',"dstuser":"u', CAST(user_id % 5 AS STRING), '","hostname":"h', CAST(user_id % 6 AS STRING), '"}',
    CASE WHEN event_id % 3 = 1 THEN ',"full_log":"seen from 10.7.7.7"' WHEN event_id % 3 = 2 THEN ',"message":"a message"' ELSE '' END,
    ',"timestamp":"', CASE event_id % 4 WHEN 0 THEN '2024-02-04T14:25:34.416117Z' WHEN 1 THEN '2022-02-07T02:00:00+02:00' WHEN 2 THEN 'yesterday' ELSE '' END, '"}') AS body, user_id
  FROM @t(events)) b
"""

# Network-sensor lines: alerts, flows, other events, blank and broken lines.
VIEWS["eve_line_v"] = """
SELECT event_id, kind, gap_s, user_id, value, event_type AS word,
  CASE kind
    WHEN 0 THEN concat('{"event_type":"alert","timestamp":"2024-01-01T00:00:0', CAST(event_id % 10 AS STRING), '+0000"',
      CASE WHEN user_id % 4 = 0 THEN '' ELSE concat(',"src_ip":"10.0.0.', CAST(user_id % 6 AS STRING), CASE WHEN event_id % 2 = 0 THEN '","src_port":"' ELSE '","src_port":' END,
        CAST(1000 + user_id AS STRING), CASE WHEN event_id % 2 = 0 THEN '"' ELSE '' END) END,
      ',"dest_ip":"10.0.1.', CAST(user_id % 2 AS STRING), '","proto":"TCP","alert":{"category":"', CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END,
      '"', CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',"signature":"sig ', event_type, '","signature_id":', CAST(2000000 + user_id AS STRING)) END,
      ',"severity":', CASE user_id % 5 WHEN 3 THEN '"high"' WHEN 1 THEN '"1"' ELSE CAST(user_id % 5 AS STRING) END, '}}')
    WHEN 1 THEN concat('{"event_type":"flow","dest_port":', CAST(user_id AS STRING), ',"flow":{"pkts_toserver":', CAST(user_id AS STRING),
      ',"pkts_toclient":', CAST(user_id % 7 AS STRING), ',"bytes_toserver":', CAST(user_id * 100 AS STRING),
      CASE WHEN gap_s % 3 = 0 THEN ',"start":"2024-01-01T10:00:00.000000+0000"'
        ELSE concat(',"start":"2024-01-01T10:00:00.000000+0000","end":"2024-01-01T10:00:', lpad(CAST(gap_s AS STRING), 2, '0'), '.500000+0000"') END,
      ',"age":9,"alerted":', CASE WHEN event_id % 10 = 1 THEN 'true' ELSE 'false' END, '},"tcp":{"syn":true,"ack":', CASE WHEN gap_s % 2 = 0 THEN 'true' ELSE 'false' END, '}}')
    WHEN 2 THEN '{"event_type":"dns"}' WHEN 3 THEN '   ' ELSE '{"event_type": "flow", broken' END AS raw
FROM (SELECT event_id, event_id % 5 AS kind, user_id % 60 AS gap_s, user_id, value, event_type FROM @t(events)) e
"""


# Analysis responses: good, fenced, listed, placeholder-filled, incomplete and unreadable ones.
VIEWS["response_v"] = """
SELECT event_id AS incident_id, kind, event_type, title, description, severity, (user_id % 2 = 0) AS has_intel,
  CASE kind
    WHEN 0 THEN concat('Sure.', chr(10), '```json', chr(10), '{"summary":" S ', event_type, ' ","risk_level":"Severe","explanation":"E","recommendation":"R","mitre_technique":"T1000 - x"}', chr(10), '```')
    WHEN 1 THEN concat('{"summary":"old","risk_level":"low","explanation":"o","recommendation":"o","mitre_technique":"o"} then {"summary":"...","risk_level":"odd","explanation":"","recommendation":["first ",""," second"],"mitre_technique":""} done')
    WHEN 2 THEN '{"summary":"only"} and {"a":{"b":1}}'
    WHEN 3 THEN 'no object { at all'
    WHEN 4 THEN '{"wrap":{"summary":["a"," b"],"risk_level":"very high","explanation":{"k":"v"},"recommendation":{"step":" do it ","none":""},"mitre_technique":null}}'
    ELSE '{"summary":"x","risk_level":"MODERATE","explanation":"Technical explanation","recommendation":"...","mitre_technique":"T2"} {"summary":"later"}' END AS content
FROM (SELECT event_id, event_id % 6 AS kind, event_type, user_id,
    CASE event_type WHEN 'error' THEN 'Nmap port scan detected' WHEN 'signup' THEN 'sshd: brute force login' ELSE 'Policy notice' END AS title,
    concat('value ', CAST(CAST(floor(value) AS INT) AS STRING)) AS description,
    CASE WHEN value >= 60 THEN 'informational' WHEN value >= 30 THEN 'High' WHEN value >= 10 THEN 'medium' ELSE 'none' END AS severity
  FROM @t(events)) e
"""

VIEWS["workflow_event_v"] = """
SELECT o_orderkey AS event_id, o_custkey AS incident_id, @ts(@us(o_orderdate)) AS changed_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'waiting_for_human' WHEN '3-MEDIUM' THEN 'completed'
    WHEN '4-NOT SPECIFIED' THEN 'rate_limited' ELSE 'failed' END AS workflow_status
FROM @t(orders)
"""

VIEWS["stage_v"] = """
SELECT l_orderkey AS incident_id, l_linenumber AS seq, CASE l_linenumber WHEN 1 THEN 'Triage' WHEN 2 THEN 'Machine Learning'
  WHEN 3 THEN 'Threat Intelligence' WHEN 4 THEN 'Investigation' WHEN 5 THEN 'Human Review' WHEN 6 THEN 'Response' ELSE 'Report' END AS stage
FROM @t(lineitem)
"""


# Vulnerability records, some rejected, some scored only by an additional publisher.
VIEWS["cve_line_v"] = """
SELECT p_partkey, concat('{"cveMetadata":{"cveId":"CVE-2024-', CAST(10000 + p_partkey AS STRING), '","state":"', CASE WHEN p_partkey % 10 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END,
  '","assignerShortName":"', p_type, '","datePublished":"2024-01-02"},"containers":{"cna":{', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('"title":"', p_name, '",') END,
  '"descriptions":[{"lang":"fr","value":"fr ', p_type, '"}', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(',{"lang":"en","value":" en ', p_type, ' "}') END,
  '],"problemTypes":[{"descriptions":[{"cweId":"CWE-', CAST(p_size AS STRING), '"},{"cweId":"CWE-', CAST(p_size AS STRING), '"}]},{"descriptions":[{"cweId":"CWE-79"},{"type":"text"}]}],',
  '"metrics":[{"format":"CVSS"}', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(',{"cvssV3_1":{"version":"3.1","baseScore":', CAST(p_size % 10 AS STRING), '.5,"baseSeverity":"HIGH","vectorString":"AV:N"}}') END,
  '],"affected":[{"vendor":" ', p_brand, '","product":"', p_name, '"},{"vendor":"', p_brand, '","product":"', p_name, '"},{"product":"alone"},{"vendor":"","product":""}],"references":[',
  '{"url":"https://r/', CAST(p_partkey AS STRING), '/1"},{"url":" https://r/2 "},{"url":"https://r/2"},{"url":""},{"url":"https://r/3"},{"url":"https://r/4"},{"url":"https://r/5"},',
  '{"url":"https://r/6"},{"url":"https://r/7"},{"url":"https://r/8"},{"url":"https://r/9"},{"url":"https://r/10"},{"url":"https://r/11"}]},',
  '"adp":[{"metrics":[]},{"metrics":[{"cvssV4_0":{"baseScore":', CAST(p_size % 9 AS STRING), ',"baseSeverity":"LOW"}}]}]}}') AS raw
FROM @t(part)
"""

VIEWS["technique_line_v"] = """
SELECT p_partkey, concat('{"type":"', CASE WHEN p_partkey % 7 = 0 THEN 'malware' ELSE 'attack-pattern' END, '","name":"', p_name, '","description":" ', p_type, chr(92), 'r', chr(92), 'nline two ",',
  '"revoked":', CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE 'false' END, CASE WHEN p_partkey % 11 = 0 THEN ',"x_mitre_deprecated":true' ELSE '' END,
  ',"external_references":[{"source_name":"capec","external_id":"CAPEC-1"}', CASE WHEN p_partkey % 13 = 0 THEN '' ELSE
    concat(',{"source_name":"mitre-attack","external_id":"T', CAST(1000 + p_partkey AS STRING), '","url":"https://t/', CAST(p_partkey AS STRING), '"}') END,
  '],"kill_chain_phases":[{"kill_chain_name":"mitre-attack","phase_name":"persistence"},{"kill_chain_name":"other","phase_name":"zzz"},{"kill_chain_name":"mitre-attack","phase_name":"',
  lower(p_type), '"},{"kill_chain_name":"mitre-attack","phase_name":"persistence"}]}') AS raw
FROM @t(part)
"""

VIEWS["weakness_line_v"] = """
SELECT p_partkey, concat('<Weakness ID="', CAST(p_partkey AS STRING), '" Name="', p_name, '" Abstraction="Base" Structure="Simple"', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' Status="Draft"' END, '>',
  '<Description>Some  ', p_type, ' &amp;lt;text&amp;gt;</Description>', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<Likelihood_Of_Exploit>High</Likelihood_Of_Exploit>' END,
  '<Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="', CAST(p_size AS STRING), '"/><Related_Weakness CWE_ID="7"/></Related_Weaknesses>',
  '<Common_Consequences><Consequence><Scope>Integrity</Scope><Impact>', p_brand, '</Impact></Consequence><Consequence><Scope>Access</Scope></Consequence></Common_Consequences>',
  '<Potential_Mitigations><Mitigation><Phase>Design</Phase><Description>Check  input.</Description></Mitigation></Potential_Mitigations>',
  '<Observed_Examples><Observed_Example><Reference>CVE-1</Reference><Description>bad ', p_name, '</Description></Observed_Example><Observed_Example><Reference>CVE-2</Reference></Observed_Example></Observed_Examples>',
  '</Weakness>') AS raw
FROM @t(part)
"""

# One markdown file per document, of eight kinds.
VIEWS["kb_file_v"] = """
SELECT doc_id, kind, text, CASE kind WHEN 0 THEN 'mitre/mitre_enterprise_attack.md' WHEN 1 THEN 'cwe/cwe_weaknesses.md' WHEN 2 THEN 'cve/cve_selected.md'
    WHEN 3 THEN 'wazuh/wazuh_soc_reference.md' WHEN 4 THEN 'suricata/suricata_soc_reference.md' WHEN 5 THEN 'runbooks/some_runbook.md'
    WHEN 6 THEN 'nist/nist_csf_2_0.md' ELSE concat('notes/n', CAST(doc_id AS STRING), '.md') END AS path,
  CASE kind
    WHEN 0 THEN concat('# Head', chr(10), chr(10), '## T', CAST(1000 + doc_id % 9000 AS STRING), ' - First technique', chr(10), text, chr(10), '## T1001.002 - Second', chr(10), 'tail ## T1 - no', chr(10), '## CWE-1 - not here', chr(10))
    WHEN 1 THEN concat('## CWE-', CAST(doc_id AS STRING), ' - Weak', chr(10), '**Abstraction:** Base', chr(10), '**Status:** Draft ', chr(10), text, chr(10), '## CWE-2 - Other', chr(10), '**Likelihood of Exploit:** High', chr(10))
    WHEN 2 THEN concat('intro', chr(10), '## CVE-2024-', CAST(doc_id AS STRING), ' - Hole', chr(10), '**CWE:** CWE-79, CWE-80', chr(10), '**CVSS Base Score:** 9.8', chr(10), '**CVSS Severity:** CRITICAL', chr(10), '**Published:** 2024-01-02', chr(10), text)
    WHEN 3 THEN concat('## WAZUH-rules-', CAST(doc_id AS STRING), ' - Rule levels', chr(10), '**Official Source:** https://docs', chr(10), text, chr(10), '## WAZUH-x - Wazuh agents', chr(10), 'b')
    WHEN 4 THEN concat('## SURICATA-eve - EVE output', chr(10), text, chr(10), '## SURICATA-y - suricata rules', chr(10), '**Official Source:** https://d2')
    WHEN 5 THEN concat('# Runbook', chr(10), CASE WHEN doc_id % 16 = 5 THEN '' ELSE '**Runbook ID:** RB-1' END, chr(10), '**Incident Type:** Phishing', chr(10), '**MITRE ATT&CK:** T1566', chr(10), text, chr(10))
    WHEN 6 THEN concat('# CSF', chr(10), '## NIST CSF 2.0 - Page 1', chr(10), '**Detected CSF Functions:** GOVERN', chr(10), text, chr(10), '## NIST CSF 2.0 - Page 2', chr(10), 'pre', chr(10),
      '• Organizational Context (GV.OC): ', text, ' GV.OC-03 GV.OC-01 GV.OC-03 ID.AM-01', chr(10), '• Asset Management (ID.AM): assets ID.AM-02', chr(10))
    ELSE text END AS content
FROM (SELECT doc_id, doc_id % 8 AS kind, text FROM @t(documents)) d
"""

VIEWS["page_text_v"] = """
SELECT doc_id AS page, concat('NIST CSWP 29  The NIST Cybersecurity Framework (CSF) 2.0', chr(13), chr(10), 'February 26,  2024', chr(10), chr(10), chr(10), chr(10), text,
  CASE doc_id % 3 WHEN 0 THEN ' GV.OC-02 and ID.AM plus GV.OC-02 Govern' WHEN 1 THEN ' detect and respond  RS.MA-01' ELSE '' END) AS text
FROM @t(documents)
"""

VIEWS["runbook_v"] = """
SELECT concat('rb-', CAST(p_partkey AS STRING)) AS id, p_name AS title, concat('T', CAST(1000 + p_size AS STRING), ' - ', p_type) AS mitre,
  @arr(concat('Look at ', p_brand), 'Second sign') AS detection, @arr('Ask') AS triage, @arr('Dig', p_type) AS investigation, @arr('Hold') AS containment,
  @arr('Clean') AS eradication, @arr('Restore', 'Watch') AS recovery
FROM @t(part)
"""


# Flows with a traffic class, for the supervised models.
VIEWS["traffic_v"] = """
SELECT l_orderkey AS flow_id, CAST(l_suppkey % 1024 AS DOUBLE) AS destination_port, CAST(l_orderkey % 30 AS DOUBLE) AS duration_seconds,
  l_quantity AS pkts_to_server, CAST(l_partkey % 50 AS DOUBLE) AS pkts_to_client, l_extendedprice AS bytes_to_server, l_extendedprice * l_discount AS bytes_to_client,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS syn_flag, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS fin_flag,
  CASE WHEN l_linenumber > 4 THEN 1.0 ELSE 0.0 END AS psh_flag, CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END AS ack_flag,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 1.0 ELSE 0.0 END AS alerted,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN 'DDoS' WHEN l_quantity < 8 THEN 'PortScan' WHEN l_linestatus = 'F' AND l_discount >= 0.08 THEN 'FTP-Patator'
    WHEN l_linenumber > 4 AND l_tax > 0.04 THEN 'SSH-Patator' ELSE 'BENIGN' END AS label
FROM @t(lineitem)
"""

# The same flows as rows of another dataset: its names, text values, repeated headers.
VIEWS["flow_2018_v"] = """
SELECT CAST(l_suppkey % 1024 AS STRING) AS `Dst Port`, CAST(l_orderkey % 30 AS STRING) AS `Flow Duration`, CAST(CAST(l_quantity AS INT) AS STRING) AS `Tot Fwd Pkts`,
  CAST(l_linenumber AS STRING) AS `Fwd Header Len`,
  CASE WHEN l_orderkey % 30 = 0 THEN 'Infinity' WHEN l_orderkey % 30 = 1 THEN 'NaN' WHEN l_orderkey % 30 = 2 THEN 'abc' ELSE CAST(CAST(l_partkey AS INT) AS STRING) END AS `Flow Byts/s`,
  CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_linenumber * 2 AS STRING) END AS `Flow Pkts/s`, '6' AS Protocol, '01/01/2018' AS `Timestamp`,
  CASE WHEN l_orderkey % 100 = 3 THEN 'Label' WHEN l_returnflag = 'R' THEN ' Bot ' WHEN l_returnflag = 'A' THEN 'benign' ELSE 'Benign' END AS Label
FROM @t(lineitem)
"""

VIEWS["unsw_v"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS dur, CAST(o_custkey % 50 AS DOUBLE) AS sbytes, CAST(o_custkey % 7 AS DOUBLE) AS rate,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS proto, CASE o_orderpriority WHEN '1-URGENT' THEN 'http' WHEN '2-HIGH' THEN 'dns' ELSE '-' END AS service,
  CASE WHEN o_custkey % 3 = 0 THEN 'FIN' ELSE 'INT' END AS state, CASE WHEN o_totalprice > 200000 THEN 'DoS' ELSE 'Normal' END AS attack_cat,
  CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS label
FROM @t(orders)
"""


def _spark_sql(text: str) -> str:
    text = text.replace("{", "{{").replace("}", "}}")
    text = re.sub(r"@t\((\w+)\)", r"{\1}", text)
    text = re.sub(r"@us\(([^()]+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
    text = _call(text, "@ts(", "CAST(timestamp_micros(", " AS TIMESTAMP_NTZ)")
    return text.replace(" @div ", " div ").replace("@arr(", "array(")


def _duck_sql(text: str) -> str:
    text = re.sub(r"@t\((\w+)\)", r"\1", text)
    text = re.sub(r"@us\(([^()]+)\)", r"epoch_us(\1)", text)
    text = text.replace("@ts(", "make_timestamp(")
    return text.replace(" @div ", " // ").replace("@arr(", "list_value(").replace("`", '"')


def _call(text: str, opening: str, head: str, tail: str) -> str:
    """Rewrite ``opening ... )`` calls, matching the closing bracket."""
    while (at := text.find(opening)) >= 0:
        depth, end = 1, at + len(opening)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:at] + head + text[at + len(opening) : end - 1] + ")" + tail + text[end:]
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The derived view as a DataFrame. With ``spread`` its inputs' rows are dealt to all cores first, for work that takes long on each."""
    text = VIEWS[name]
    inputs = {t: dealt(table(spark, sf_dir, t)) if spread else table(spark, sf_dir, t) for t in set(re.findall(r"@t\((\w+)\)", text))}
    return spark.sql(_spark_sql(text), **inputs)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view over a stream of its (single) input table's files."""
    text = VIEWS[name]
    (source,) = set(re.findall(r"@t\((\w+)\)", text))
    files = prepare(spark).readStream.schema(table(spark, sf_dir, source).schema).option("pathGlobFilter", f"{source}.parquet")
    return spark.sql(_spark_sql(text), **{source: files.parquet(sf_dir)})


def oracle(names: str, query: str) -> str:
    """DuckDB text: the named views as common table expressions, then ``query``."""
    parts = [f"{n} AS ({_duck_sql(VIEWS[n]).strip()})" for n in names.split()]
    return f"WITH RECURSIVE {', '.join(parts)}\n{_duck_sql(query).strip()}" if parts else _duck_sql(query).strip()


def oracle_ctes(names: str, extra: str, query: str) -> str:
    """Like :func:`oracle` with further expressions ``extra`` (``name AS (...), ...``)."""
    parts = [f"{n} AS ({_duck_sql(VIEWS[n]).strip()})" for n in names.split()]
    return f"WITH RECURSIVE {', '.join([*parts, _duck_sql(extra).strip()])}\n{_duck_sql(query).strip()}"
