"""Explicit schemas of the tables and raw sensor records, as DDL text."""

INCIDENTS = (
    "id BIGINT, title STRING, description STRING, severity STRING, status STRING, disposition STRING, source STRING,"
    " hostname STRING, source_ip STRING, destination_ip STRING, username STRING, assigned_to STRING,"
    " workflow_status STRING, workflow_error STRING, workflow_thread_id STRING, correlation_id STRING,"
    " event_timestamp TIMESTAMP_NTZ, detected_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
)

ALERTS = (
    "id BIGINT, title STRING, description STRING, source STRING, severity STRING, status STRING, attack_type STRING,"
    " mitre_technique STRING, source_ip STRING, destination_ip STRING, created_at TIMESTAMP_NTZ"
)

ANALYSES = (
    "id BIGINT, incident_id BIGINT, summary STRING, risk_level STRING, explanation STRING, recommendation STRING,"
    " mitre_technique STRING, mitre_name STRING, mitre_valid BOOLEAN, rag_sources ARRAY<STRING>,"
    " human_approval_required BOOLEAN, human_approved BOOLEAN, human_review_status STRING, human_comment STRING,"
    " response_status STRING, correlation_id STRING, correlation_confidence STRING, correlated_incident_count INT,"
    " correlated_sources ARRAY<STRING>, thread_id STRING, agent_trace ARRAY<STRING>, model_used STRING,"
    " created_at TIMESTAMP_NTZ"
)

ACTIONS = (
    "id BIGINT, incident_id BIGINT, action_type STRING, target STRING, status STRING, requires_approval BOOLEAN,"
    " approved BOOLEAN, result STRING, executed_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
)

ACTION_LOGS = (
    "id BIGINT, action_id BIGINT, incident_id BIGINT, event_type STRING, previous_status STRING, new_status STRING,"
    " details STRING, created_at TIMESTAMP_NTZ"
)

AUDIT_LOGS = (
    "id BIGINT, event_type STRING, outcome STRING, actor_subject STRING, actor_source STRING, actor_email STRING,"
    " resource_type STRING, resource_id STRING, request_method STRING, request_path STRING, client_ip STRING,"
    " details STRING, created_at TIMESTAMP_NTZ"
)

# Scalars of sensor records are text, whatever the sensor wrote; a list's text is read as a list where it is used.
# Host-sensor alert body. The wrapper form carries the same body in ``_source``.
_HOST_BODY = (
    "rule STRUCT<id:STRING,level:STRING,description:STRING,"
    "mitre:STRUCT<id:STRING,technique:STRING,tactic:STRING>>,"
    " agent STRUCT<id:STRING,name:STRING,ip:STRING>,"
    " data STRUCT<srcip:STRING,src_ip:STRING,source_ip:STRING,dstip:STRING,dst_ip:STRING,destination_ip:STRING,"
    "srcuser:STRING,dstuser:STRING,user:STRING,username:STRING,hostname:STRING,command:STRING,"
    "agent_ip:STRING,host_ip:STRING>,"
    " predecoder STRUCT<hostname:STRING>, full_log STRING, message STRING, timestamp STRING"
)
HOST_BODY_FIELDS = ("rule", "agent", "data", "predecoder", "full_log", "message", "timestamp")
_NESTED_BODY = (
    _HOST_BODY.replace("rule STRUCT", "rule: STRUCT")
    .replace(" agent STRUCT", " agent: STRUCT")
    .replace(" data STRUCT", " data: STRUCT")
    .replace(" predecoder STRUCT", " predecoder: STRUCT")
    .replace(" full_log STRING", " full_log: STRING")
    .replace(" message STRING", " message: STRING")
    .replace(" timestamp STRING", " timestamp: STRING")
)
HOST_ALERT = f"{_HOST_BODY}, _source STRUCT<{_NESTED_BODY}>, _corrupt_record STRING"

# Network-sensor event lines: alerts and flows share one schema.
EVE_EVENT = (
    "event_type STRING, timestamp STRING, src_ip STRING, dest_ip STRING, src_port STRING, dest_port STRING, proto STRING,"
    " alert STRUCT<signature:STRING,signature_id:STRING,category:STRING,severity:STRING,gid:STRING,rev:STRING>,"
    " flow STRUCT<pkts_toserver:STRING,pkts_toclient:STRING,bytes_toserver:STRING,bytes_toclient:STRING,"
    "start:STRING,`end`:STRING,age:STRING,alerted:STRING>,"
    " tcp STRUCT<syn:STRING,fin:STRING,psh:STRING,ack:STRING>, _corrupt_record STRING"
)

CVE_RECORD = (
    "cveMetadata STRUCT<cveId:STRING,state:STRING,assignerShortName:STRING,datePublished:STRING,dateUpdated:STRING>,"
    " containers STRUCT<"
    "cna:STRUCT<title:STRING,"
    "descriptions:ARRAY<STRUCT<lang:STRING,value:STRING>>,"
    "problemTypes:ARRAY<STRUCT<descriptions:ARRAY<STRUCT<cweId:STRING>>>>,"
    "metrics:ARRAY<STRUCT<"
    "cvssV4_0:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>,"
    "cvssV3_1:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>,"
    "cvssV3_0:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>,"
    "cvssV2_0:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>>>,"
    "affected:ARRAY<STRUCT<vendor:STRING,product:STRING>>,"
    "references:ARRAY<STRUCT<url:STRING>>>,"
    "adp:ARRAY<STRUCT<metrics:ARRAY<STRUCT<"
    "cvssV4_0:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>,"
    "cvssV3_1:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>,"
    "cvssV3_0:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>,"
    "cvssV2_0:STRUCT<version:STRING,baseScore:STRING,baseSeverity:STRING,vectorString:STRING>>>>>>,"
    " _corrupt_record STRING"
)

_TECHNIQUE_FIELDS = (
    ("type", "STRING"),
    ("name", "STRING"),
    ("description", "STRING"),
    ("revoked", "BOOLEAN"),
    ("x_mitre_deprecated", "BOOLEAN"),
    ("external_references", "ARRAY<STRUCT<source_name:STRING,external_id:STRING,url:STRING>>"),
    ("kill_chain_phases", "ARRAY<STRUCT<kill_chain_name:STRING,phase_name:STRING>>"),
)
TECHNIQUE_OBJECT = ", ".join(f"{name} {kind}" for name, kind in _TECHNIQUE_FIELDS)
TECHNIQUE_BUNDLE = f"objects ARRAY<STRUCT<{', '.join(f'{name}: {kind}' for name, kind in _TECHNIQUE_FIELDS)}>>"

WEAKNESS_ROW = (
    "_ID STRING, _Name STRING, _Abstraction STRING, _Structure STRING, _Status STRING,"
    " Description STRING, Extended_Description STRING, Likelihood_Of_Exploit STRING,"
    " Common_Consequences STRUCT<Consequence:ARRAY<STRING>>,"
    " Potential_Mitigations STRUCT<Mitigation:ARRAY<STRING>>,"
    " Detection_Methods STRUCT<Detection_Method:ARRAY<STRING>>,"
    " Related_Weaknesses STRUCT<Related_Weakness:ARRAY<STRUCT<_CWE_ID:STRING,_Nature:STRING>>>,"
    " Observed_Examples STRUCT<Observed_Example:ARRAY<STRUCT<Reference:STRING,Description:STRING>>>"
)
