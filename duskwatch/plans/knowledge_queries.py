"""Knowledge base, chunk and retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.operators import knowledge, retrieval
from duskwatch.plans.catalog import query
from duskwatch.plans.views import oracle, oracle_ctes, table, view
from duskwatch.schemas import CVE_RECORD, TECHNIQUE_OBJECT, WEAKNESS_ROW
from duskwatch.session import run_folder
from duskwatch.sources import knowledge as catalogues
from duskwatch.sources import sinks
from duskwatch.sources.knowledge import page_texts
from duskwatch.sources.sensors import parse_lines

_NL = "chr(10)"

# --- markdown files to documents -------------------------------------------
_TAIL = r"regexp_replace(text, '\s+$', '')"
_DOCS = f"""
docs AS (
  SELECT doc_id, kind, path, 'mitre_attack' AS document_type, 'T' || (1000 + doc_id % 9000) AS doc_key, 'First technique' AS title,
    'MITRE ATT&CK T' || (1000 + doc_id % 9000) || ' - First technique' AS display_source,
    '## T' || (1000 + doc_id % 9000) || ' - First technique' || {_NL} || {_TAIL} AS text FROM kb_file_v WHERE kind = 0
  UNION ALL SELECT doc_id, kind, path, 'mitre_attack', 'T1001.002', 'Second', 'MITRE ATT&CK T1001.002 - Second',
    '## T1001.002 - Second' || {_NL} || 'tail ## T1 - no' || {_NL} || '## CWE-1 - not here' FROM kb_file_v WHERE kind = 0
  UNION ALL SELECT doc_id, kind, path, 'cwe', 'CWE-' || doc_id, 'Weak', 'CWE-' || doc_id || ' - Weak',
    '## CWE-' || doc_id || ' - Weak' || {_NL} || '**Abstraction:** Base' || {_NL} || '**Status:** Draft ' || {_NL} || {_TAIL} FROM kb_file_v WHERE kind = 1
  UNION ALL SELECT doc_id, kind, path, 'cwe', 'CWE-2', 'Other', 'CWE-2 - Other', '## CWE-2 - Other' || {_NL} || '**Likelihood of Exploit:** High' FROM kb_file_v WHERE kind = 1
  UNION ALL SELECT doc_id, kind, path, 'cve', 'CVE-2024-' || doc_id, 'Hole', 'CVE-2024-' || doc_id || ' - Hole',
    regexp_replace(substr(content, 7), '\\s+$', '') FROM kb_file_v WHERE kind = 2
  UNION ALL SELECT doc_id, kind, path, 'wazuh_documentation', 'WAZUH-rules-' || doc_id, 'Rule levels', 'Wazuh Rule levels',
    '## WAZUH-rules-' || doc_id || ' - Rule levels' || {_NL} || '**Official Source:** https://docs' || {_NL} || {_TAIL} FROM kb_file_v WHERE kind = 3
  UNION ALL SELECT doc_id, kind, path, 'wazuh_documentation', 'WAZUH-x', 'Wazuh agents', 'Wazuh agents', '## WAZUH-x - Wazuh agents' || {_NL} || 'b' FROM kb_file_v WHERE kind = 3
  UNION ALL SELECT doc_id, kind, path, 'suricata_documentation', 'SURICATA-eve', 'EVE output', 'Suricata EVE output',
    '## SURICATA-eve - EVE output' || {_NL} || {_TAIL} FROM kb_file_v WHERE kind = 4
  UNION ALL SELECT doc_id, kind, path, 'suricata_documentation', 'SURICATA-y', 'suricata rules', 'suricata rules',
    '## SURICATA-y - suricata rules' || {_NL} || '**Official Source:** https://d2' FROM kb_file_v WHERE kind = 4
  UNION ALL SELECT doc_id, kind, path, 'soc_runbook', CASE WHEN doc_id % 16 = 5 THEN 'some_runbook' ELSE 'RB-1' END, 'Phishing', 'SOC Runbook - Phishing',
    regexp_replace(content, '\\s+$', '') FROM kb_file_v WHERE kind = 5
  UNION ALL SELECT doc_id, kind, path, 'nist_csf', '1', '', 'NIST CSF 2.0 - Page 1', '## NIST CSF 2.0 - Page 1' || {_NL} || '**Detected CSF Functions:** GOVERN' || {_NL} || {_TAIL} FROM kb_file_v WHERE kind = 6
  UNION ALL SELECT doc_id, kind, path, 'nist_csf', 'GV.OC', 'Organizational Context', 'NIST CSF 2.0 GV.OC - Organizational Context',
    '• Organizational Context (GV.OC): ' || text || ' GV.OC-03 GV.OC-01 GV.OC-03 ID.AM-01' FROM kb_file_v WHERE kind = 6
  UNION ALL SELECT doc_id, kind, path, 'nist_csf', 'ID.AM', 'Asset Management', 'NIST CSF 2.0 ID.AM - Asset Management', '• Asset Management (ID.AM): assets ID.AM-02' FROM kb_file_v WHERE kind = 6
  UNION ALL SELECT doc_id, kind, path, 'soc_knowledge', path, path, path, content FROM kb_file_v WHERE kind = 7 AND regexp_matches(content, '\\S'))
"""


def _documents(spark, sf_dir):
    files = view(spark, sf_dir, "kb_file_v").select("doc_id", "path", "content")
    return knowledge.documents_from_markdown(files, "doc_id")


@query("markdown_documents", oracle_ctes("kb_file_v", _DOCS, "SELECT doc_id, path, document_type, doc_key, title, display_source, text FROM docs"))
def markdown_documents(spark, sf_dir):
    return _documents(spark, sf_dir).drop("metadata")


@query(
    "document_metadata",
    oracle_ctes("kb_file_v", _DOCS, """SELECT doc_id, doc_key, CASE document_type
        WHEN 'mitre_attack' THEN 'technique_id=' || doc_key || '|technique_name=' || title
        WHEN 'cwe' THEN CASE doc_key WHEN 'CWE-2' THEN CASE WHEN title = 'Other' THEN 'cwe_abstraction=|cwe_id=CWE-2|cwe_likelihood=High|cwe_status=|name=Other'
            ELSE 'cwe_abstraction=Base|cwe_id=CWE-2|cwe_likelihood=|cwe_status=Draft|name=Weak' END ELSE 'cwe_abstraction=Base|cwe_id=' || doc_key || '|cwe_likelihood=|cwe_status=Draft|name=Weak' END
        WHEN 'cve' THEN 'cve_id=' || doc_key || '|cvss_score=9.8|cvss_severity=CRITICAL|cwe_ids=CWE-79, CWE-80|name=Hole|published=2024-01-02'
        WHEN 'wazuh_documentation' THEN 'name=' || title || '|official_source=' || CASE title WHEN 'Rule levels' THEN 'https://docs' ELSE '' END || '|topic_id=' || doc_key
        WHEN 'suricata_documentation' THEN 'name=' || title || '|official_source=' || CASE title WHEN 'suricata rules' THEN 'https://d2' ELSE '' END || '|topic_id=' || doc_key
        WHEN 'soc_runbook' THEN 'incident_type=Phishing|mitre_mapping=T1566|runbook_id=' || doc_key || '|source_type=internal'
        WHEN 'nist_csf' THEN CASE doc_key WHEN '1' THEN 'category_id=|function=GOVERN|identifiers=|page=1'
          WHEN 'GV.OC' THEN 'category_id=GV.OC|function=GOVERN|identifiers=GV.OC, GV.OC-01, GV.OC-03|page=2' ELSE 'category_id=ID.AM|function=IDENTIFY|identifiers=ID.AM, ID.AM-02|page=2' END
        ELSE '' END AS metadata FROM docs"""),
)
def document_metadata(spark, sf_dir):
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _documents(spark, sf_dir).select("doc_id", "doc_key", F.array_join(pairs, "|").alias("metadata"))


# --- framework pages -------------------------------------------------------
_PAGES = r"""
cleaned AS (SELECT page, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    '(?i)NIST CSWP 29\s+The NIST Cybersecurity Framework \(CSF\) 2\.0', '', 'g'), '(?i)February 26,\s*2024', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM page_text_v),
coded AS (SELECT page, text, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[^\P{L}a-zA-Z]', '_', 'g'), '\b(?:GV|ID|PR|DE|RS|RC)\.[A-Z]{2}(?:-\d{2})?\b'))) AS codes,
  list_filter(['GOVERN', 'IDENTIFY', 'PROTECT', 'DETECT', 'RESPOND', 'RECOVER'], lambda f: contains(upper(text), f)) AS functions FROM cleaned WHERE text <> '')
"""


@query("page_sections", oracle_ctes("page_text_v", _PAGES, "SELECT page, text, array_to_string(functions, ', ') AS functions, array_to_string(codes, ', ') AS codes FROM coded"))
def page_sections(spark, sf_dir):
    pages = knowledge.page_sections(page_texts(view(spark, sf_dir, "page_text_v")))
    return pages.withColumns({c: F.array_join(c, ", ") for c in ("functions", "codes")})


@query(
    "render_pages",
    oracle_ctes("page_text_v", _PAGES, """SELECT page, '## NIST CSF 2.0 - Page ' || page || chr(10) || chr(10) || '**PDF Page:** ' || page || chr(10) || chr(10)
      || CASE WHEN len(functions) > 0 THEN '**Detected CSF Functions:** ' || array_to_string(functions, ', ') || chr(10) || chr(10) ELSE '' END
      || CASE WHEN len(codes) > 0 THEN '**Detected CSF Identifiers:** ' || array_to_string(codes, ', ') || chr(10) || chr(10) ELSE '' END
      || '### Content' || chr(10) || chr(10) || text AS content FROM coded"""),
)
def render_pages(spark, sf_dir):
    pages = knowledge.page_sections(page_texts(view(spark, sf_dir, "page_text_v")))
    content = knowledge.render_page(F.col("page"), F.col("functions"), F.col("codes"), F.col("text"))
    return pages.select("page", content.alias("content"))


# --- catalogue records -----------------------------------------------------
_CVE = """
cves AS (SELECT p_partkey, 'CVE-2024-' || (10000 + p_partkey) AS cve_id, CASE WHEN p_partkey % 4 = 0 THEN 'CVE-2024-' || (10000 + p_partkey) ELSE p_name END AS title,
  CASE WHEN p_partkey % 5 = 0 THEN 'fr ' || p_type ELSE 'en ' || p_type END AS description, CASE WHEN p_size = 79 THEN 'CWE-79' ELSE 'CWE-' || p_size || ', CWE-79' END AS cwe_ids,
  CASE WHEN p_partkey % 3 = 0 THEN 'cvssV4_0' ELSE '3.1' END AS cvss_version, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 9 AS VARCHAR) ELSE (p_size % 10) || '.5' END AS cvss_score,
  CASE WHEN p_partkey % 3 = 0 THEN 'LOW' ELSE 'HIGH' END AS cvss_severity, CASE WHEN p_partkey % 3 <> 0 THEN 'AV:N' END AS cvss_vector, p_brand || ' - ' || p_name AS product,
  'https://r/' || p_partkey || '/1' AS first_url, p_type AS assigner FROM part WHERE p_partkey % 10 <> 0)
"""
_URLS = ", ".join(f"'https://r/{n}'" for n in range(2, 11))


def _cves(spark, sf_dir):
    records = parse_lines(view(spark, sf_dir, "cve_line_v"), "raw", CVE_RECORD)
    return knowledge.cve_fields(records, "p_partkey")


@query(
    "cve_fields",
    f"""WITH {_CVE.strip()} SELECT cve_id, title, description, cwe_ids, cvss_version, cvss_score, cvss_severity, cvss_vector, product || ' | alone' AS products,
      array_to_string(list_value(first_url, {_URLS}), ' ') AS "references", '2024-01-02' AS published, assigner FROM cves""",
)
def cve_fields(spark, sf_dir):
    return _cves(spark, sf_dir).select(
        "cve_id", "title", "description", F.array_join("cwe_ids", ", ").alias("cwe_ids"), "cvss_version", "cvss_score", "cvss_severity",
        "cvss_vector", F.array_join("products", " | ").alias("products"), F.array_join("references", " ").alias("references"), "published", "assigner",
    )


@query(
    "render_cves",
    f"""WITH {_CVE.strip()} SELECT cve_id, '## ' || cve_id || ' - ' || title || {_NL} || {_NL} || '**CVE ID:** ' || cve_id || {_NL} || '**State:** PUBLISHED' || {_NL} || '**Assigner:** ' || assigner || {_NL}
      || '**Published:** 2024-01-02' || {_NL} || '**CWE:** ' || cwe_ids || {_NL} || '**CVSS Version:** ' || cvss_version || {_NL} || '**CVSS Base Score:** ' || cvss_score || {_NL}
      || '**CVSS Severity:** ' || cvss_severity || {_NL} || CASE WHEN cvss_vector IS NULL THEN '' ELSE '**CVSS Vector:** ' || cvss_vector || {_NL} END || {_NL}
      || '### Description' || {_NL} || description || {_NL} || {_NL} || '### Affected Products' || {_NL} || '- ' || product || {_NL} || '- alone' || {_NL} || {_NL}
      || '### References' || {_NL} || '- ' || array_to_string(list_value(first_url, {_URLS}), {_NL} || '- ') AS text FROM cves""",
)
def render_cves(spark, sf_dir):
    return knowledge.render_cve(_cves(spark, sf_dir)).select("cve_id", "text")


_TECHNIQUES = """
live AS (SELECT p_partkey, 'T' || (1000 + p_partkey) AS technique_id, p_name AS name, p_type || chr(10) || 'line two' AS description,
  array_to_string(list_sort(list_distinct(list_value('persistence', lower(p_type)))), ', ') AS tactics, 'https://t/' || p_partkey AS url
  FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0)
"""


def _techniques(spark, sf_dir):
    objects = view(spark, sf_dir, "technique_line_v").select(F.from_json("raw", TECHNIQUE_OBJECT).alias("o")).select("o.*")
    return knowledge.technique_fields(objects)


@query("technique_fields", f"WITH {_TECHNIQUES.strip()} SELECT technique_id, name, description, tactics, url FROM live")
def technique_fields(spark, sf_dir):
    return _techniques(spark, sf_dir).withColumn("tactics", F.array_join("tactics", ", "))


@query(
    "render_techniques",
    f"""WITH {_TECHNIQUES.strip()} SELECT technique_id, array_to_string(list_value('## ' || technique_id || ' - ' || name, '**Technique ID:** ' || technique_id, '**Name:** ' || name,
      '**Tactics:** ' || tactics, '### Description', description, '**MITRE reference:** ' || url, '---'), {_NL} || {_NL}) AS text FROM live""",
)
def render_techniques(spark, sf_dir):
    return knowledge.render_technique(_techniques(spark, sf_dir)).select("technique_id", "text")


def _weaknesses(spark, sf_dir):
    lines = view(spark, sf_dir, "weakness_line_v", spread=True)
    rows = lines.select(F.from_xml("raw", WEAKNESS_ROW, {"rowTag": "Weakness"}).alias("r")).select("r.*")
    return knowledge.weakness_fields(rows)


_WEAK = """
weak AS (SELECT 'CWE-' || p_partkey AS cwe_id, p_name AS name, 'Base' AS abstraction, 'Simple' AS structure, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Draft' END AS status,
  'Some ' || p_type || ' <text>' AS description, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'High' END AS likelihood, 'Integrity ' || p_brand || ' | Access' AS consequences,
  'Design Check input.' AS mitigations, 'CWE-' || p_size || ' (ChildOf) | CWE-7' AS related, 'CVE-1 - bad ' || p_name || ' | CVE-2' AS examples FROM part)
"""


@query("weakness_fields", f"WITH {_WEAK.strip()} SELECT * FROM weak")
def weakness_fields(spark, sf_dir):
    fields = _weaknesses(spark, sf_dir).drop("extended_description", "detections")
    return fields.withColumns({c: F.array_join(c, " | ") for c in ("consequences", "mitigations", "related", "examples")})


@query(
    "render_weaknesses",
    f"""WITH {_WEAK.strip()} SELECT cwe_id, array_to_string(list_filter(list_value('## ' || cwe_id || ' - ' || name, '**CWE ID:** ' || cwe_id, '**Name:** ' || name, '**Abstraction:** Base', '**Structure:** Simple',
      CASE WHEN status <> '' THEN '**Status:** ' || status END, CASE WHEN likelihood <> '' THEN '**Likelihood of Exploit:** ' || likelihood END, '### Description', description,
      '### Common Consequences', '- ' || replace(consequences, ' | ', {_NL} || '- '), '### Potential Mitigations', '- ' || mitigations,
      '### Related Weaknesses', '- ' || replace(related, ' | ', {_NL} || '- '), '### Observed Examples', '- ' || replace(examples, ' | ', {_NL} || '- '), '---'), lambda x: x IS NOT NULL), {_NL} || {_NL}) AS text FROM weak""",
)
def render_weaknesses(spark, sf_dir):
    return knowledge.render_weakness(_weaknesses(spark, sf_dir)).select("cwe_id", "text")


def _listed(c: str) -> str:
    return f"'- ' || array_to_string({c}, {_NL} || '- ')"


_STEPS = " || ".join(f"'## {s.capitalize()}' || {_NL} || {_NL} || {_listed(s)} || {_NL} || {_NL}" for s in knowledge.RUNBOOK_STEPS)
_EVIDENCE = f" || {_NL} || ".join(f"'- {e}'" for e in knowledge.RUNBOOK_EVIDENCE)


@query(
    "render_runbooks",
    oracle("runbook_v", f"""SELECT id, 'runbooks/' || replace(id, '-', '_') || '_runbook.md' AS path, '# SOC Runbook - ' || title || {_NL} || {_NL} || '**Document Type:** Internal SOC Runbook' || {_NL}
      || '**Runbook ID:** SOC-RUNBOOK-' || id || {_NL} || '**Incident Type:** ' || title || {_NL} || '**MITRE ATT&CK:** ' || mitre || {_NL} || {_NL} || {_STEPS}
      || '## Evidence to Preserve' || {_NL} || {_NL} || {_EVIDENCE} || {_NL} || {_NL} || '## Escalation' || {_NL} || {_NL} || '{knowledge.RUNBOOK_ESCALATION}' || {_NL} || {_NL}
      || '## Human-in-the-Loop' || {_NL} || {_NL} || '{knowledge.RUNBOOK_HUMAN}' || {_NL} AS content FROM runbook_v"""),
)
def render_runbooks(spark, sf_dir):
    return knowledge.render_runbook(view(spark, sf_dir, "runbook_v"))


# --- refresh, chunks, vectors ----------------------------------------------
def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


@query("file_fingerprints", "SELECT 'd/' || doc_id AS path, sha256('v1m51280' || 'd/' || doc_id || text) AS fingerprint FROM documents")
def file_fingerprints(spark, sf_dir):
    return knowledge.file_fingerprints(_files(spark, sf_dir), "v1", "m")


@query(
    "changed_files",
    "SELECT 'd/' || d.doc_id AS path FROM documents d WHERE d.lang <> 'en'",
)
def changed_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    now = knowledge.file_fingerprints(files, "v1", "m")
    kept = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    indexed = now.join(kept, "path", "left_semi")
    return knowledge.changed_files(files, now, indexed).select("path")


_SIZE, _OVERLAP = rules.CHUNK_TOKENS, rules.CHUNK_OVERLAP
_STRIDE = _SIZE - _OVERLAP


@query(
    "chunk_documents",
    rf"""WITH s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(
        string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2) || '|\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents) d),
    w AS (SELECT doc_id, i, string_split_regex(sentence, '\s+') AS words FROM s),
    p AS (SELECT doc_id, i, j, words[j * {_OVERLAP} + 1 : j * {_OVERLAP} + {_OVERLAP}] AS words FROM (SELECT *, unnest(range((len(words) + {_OVERLAP - 1}) // {_OVERLAP})) AS j FROM w) x),
    a AS (SELECT doc_id, i, j, array_to_string(words, ' ') AS text, len(words) AS n, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY i, j) - len(words) AS pos, sum(len(words)) OVER (PARTITION BY doc_id) AS total FROM p),
    c AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos + n - {_SIZE}) / {_STRIDE})) AS BIGINT), CAST(least(floor(pos / {_STRIDE}), greatest(ceil((total - {_OVERLAP}) / {_STRIDE}), 1) - 1) AS BIGINT) + 1)) AS chunk FROM a)
    SELECT doc_id, chunk, CAST(sum(n) AS INT) AS n_words, string_agg(text, ' ' ORDER BY i, j) AS text FROM c GROUP BY doc_id, chunk""",
)
def chunk_documents(spark, sf_dir):
    return knowledge.chunk_documents(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("text_vectors", "SELECT doc_id, TRUE AS terms_bounded, 1.0::DOUBLE AS norm FROM documents")
def text_vectors(spark, sf_dir):
    """Vectors of unit length with no more terms than the text has different words."""
    from pyspark.ml.functions import vector_to_array

    words = F.size(F.array_distinct(F.split(F.lower("text"), r"\s")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("n_words"))
    vectors = knowledge.text_vectors(docs, "text")
    values = vector_to_array("vector")
    return vectors.select(
        "doc_id",
        F.size(F.filter(values, lambda x: x != 0)).between(1, F.col("n_words")).alias("terms_bounded"),
        F.round(F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)), 9).alias("norm"),
    )


@query(
    "requested_ids",
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(p, '\bCVE-\d{4}-\d+\b') || regexp_extract_all(p, '\bCWE-\d+\b') || regexp_extract_all(p, '\bT\d{4}(?:\.\d{3})?\b'))), ' ') AS ids
    FROM (SELECT doc_id, regexp_replace(upper(text || ' see cve-2024-' || doc_id || ', CWE-' || n_chars || ' t' || (1000 + doc_id % 9000) || '.001'), '[^\P{L}a-zA-Z]', '_', 'g') AS p FROM documents) d""",
)
def requested_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = F.concat(
        F.col("text"), F.lit(" see cve-2024-"), F.col("doc_id").cast("string"), F.lit(", CWE-"), F.col("n_chars").cast("string"),
        F.lit(" t"), (1000 + F.col("doc_id") % 9000).cast("string"), F.lit(".001"),
    )
    return docs.select("doc_id", F.array_join(F.array_sort(knowledge.requested_ids(asked)), " ").alias("ids"))


@query("section_sink", f"WITH {_TECHNIQUES.strip()} SELECT technique_id AS doc_key, TRUE AS stored_text FROM live")
def section_sink(spark, sf_dir):
    """Sections written as a table and as text files, and read back."""
    sections = knowledge.render_technique(_techniques(spark, sf_dir)).select(F.col("technique_id").alias("doc_key"), "text")
    path = run_folder(spark, "sections")
    sinks.write_sections(sections, f"{path}/table")
    sinks.write_section_text(sections, f"{path}/text")
    lines = spark.read.text(f"{path}/text").select(F.col("value").alias("line")).distinct()
    stored = spark.read.parquet(f"{path}/table")
    heading = F.substring_index("text", "\n", 1)
    return stored.join(lines, heading == F.col("line"), "left").select("doc_key", F.col("line").isNotNull().alias("stored_text"))


@query("scan_cve_files", f"WITH {_CVE.strip()} SELECT cve_id, title, cwe_ids, cvss_version, cvss_score FROM cves")
def scan_cve_files(spark, sf_dir):
    """Each record written as a file of its own, beside files that are cut short and files of other names, and scanned."""
    path = run_folder(spark, "cves")
    rows = view(spark, sf_dir, "cve_line_v")
    number = F.col("p_partkey").cast("string")
    whole = rows.select(F.concat(F.pmod("p_partkey", F.lit(100)), F.lit("/CVE-"), number, F.lit(".json")).alias("path"), F.col("raw").alias("content"))
    cut = rows.filter("p_partkey % 17 = 3").select(F.concat(F.lit("cut/CVE-"), number, F.lit(".json")).alias("path"), F.expr("left(raw, length(raw) div 2)").alias("content"))
    other = rows.filter("p_partkey % 17 = 4").select(F.concat(F.lit("other/delta-"), number, F.lit(".json")).alias("path"), F.col("raw").alias("content"))
    sinks.write_files(whole.unionByName(cut).unionByName(other), path)
    fields = knowledge.cve_fields(catalogues.read_cve_records(spark, path))
    return fields.select("cve_id", "title", F.array_join("cwe_ids", ", ").alias("cwe_ids"), "cvss_version", "cvss_score")


@query("scan_markdown_tree", oracle("kb_file_v", r"SELECT doc_id || '/' || path AS path, content FROM kb_file_v WHERE regexp_matches(content, '\S')"))
def scan_markdown_tree(spark, sf_dir):
    """Every markdown file written to a tree of folders and scanned; blank ones and those of other kinds are left out."""
    path = run_folder(spark, "markdown")
    files = view(spark, sf_dir, "kb_file_v").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("path")).alias("path"), "content")
    others = files.filter("doc_id % 10 = 0").select(F.concat("path", F.lit(".txt")).alias("path"), "content")
    sinks.write_files(files.select("path", "content").unionByName(others), path)
    return catalogues.read_markdown_tree(spark, path)


@query("scan_weakness_file", f"WITH {_WEAK.strip()} SELECT cwe_id, name, status, likelihood FROM weak")
def scan_weakness_file(spark, sf_dir):
    """Weakness elements written as XML catalogues of 500 and scanned."""
    path = run_folder(spark, "weaknesses")
    lines = view(spark, sf_dir, "weakness_line_v").withColumn("part", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("raw"), F.lit(16))).orderBy("raw")))
    bundle = F.concat_ws("-", F.pmod(F.xxhash64("raw"), F.lit(16)), F.floor(F.col("part") / 500)).alias("bundle")
    whole = F.concat(F.lit("<Catalog><Weaknesses>"), F.array_join(F.collect_list("raw"), ""), F.lit("</Weaknesses></Catalog>"))
    lines.groupBy(bundle).agg(whole.alias("value")).write.partitionBy("bundle").text(path)
    return knowledge.weakness_fields(catalogues.read_weaknesses(spark, path)).select("cwe_id", "name", "status", "likelihood")


@query("scan_technique_bundle", f"WITH {_TECHNIQUES.strip()} SELECT technique_id, name FROM live")
def scan_technique_bundle(spark, sf_dir):
    """Technique objects written as bundles of 500 and scanned."""
    lines = view(spark, sf_dir, "technique_line_v").withColumn("bundle", F.floor(F.col("p_partkey") / 500))
    path = run_folder(spark, "bundles")
    bundles = lines.groupBy("bundle").agg(F.concat(F.lit('{"objects":['), F.array_join(F.collect_list("raw"), ","), F.lit("]}")).alias("value"))
    bundles.write.partitionBy("bundle").text(path)
    return knowledge.technique_fields(catalogues.read_technique_objects(spark, path)).select("technique_id", "name")


# --- retrieval: one question per label, its vector the label's mean ---------
_QUESTIONS = """
means AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) e GROUP BY ALL),
questions AS (SELECT label AS query_id, list(x ORDER BY pos) AS vector, 'about CVE-2024-' || (1000 + label) || ' and cwe-' || (1 + label) || ' or T' || (1002 + label) AS text FROM means GROUP BY label),
scored AS (SELECT q.query_id, q.text, k.chunk_id, k.document_type, k.doc_key, list_cosine_similarity(q.vector, k.embedding::DOUBLE[]) AS score FROM questions q, kb_v k),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
"""


def _ranked_sql(limit: int) -> str:
    return f"""
    hits AS (SELECT *, document_type IN ('cve', 'cwe', 'mitre_attack') AND regexp_matches(upper(text), '\\b' || doc_key || '\\b') AS exact
      FROM near WHERE rank <= {max(5 * limit, 20)} AND score >= {rules.MIN_SCORE}),
    units AS (SELECT *, score + exact::INT AS ranking, row_number() OVER (PARTITION BY query_id, document_type, doc_key ORDER BY score + exact::INT DESC, score DESC, chunk_id) AS nth FROM hits),
    best AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM units WHERE nth = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ranking DESC, score DESC, chunk_id) AS position FROM best
      WHERE score >= top * {rules.RELATIVE_THRESHOLD} OR exact)"""


def _questions(spark, sf_dir):
    centroids = retrieval.label_centroids(table(spark, sf_dir, "embeddings"))
    label = F.col("label").cast("bigint")
    text = F.concat(
        F.lit("about CVE-2024-"), (1000 + label).cast("string"), F.lit(" and cwe-"), (1 + label).cast("string"),
        F.lit(" or T"), (1002 + label).cast("string"),
    )
    return centroids.select(label.alias("query_id"), "vector", text.alias("text"))


def _chunks(spark, sf_dir):
    return view(spark, sf_dir, "kb_v").withColumn("source", F.col("doc_key"))


@query("nearest_chunks", oracle_ctes("kb_v", _QUESTIONS, "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM near WHERE rank <= 20"))
def nearest_chunks(spark, sf_dir):
    found = retrieval.nearest_chunks(_questions(spark, sf_dir), _chunks(spark, sf_dir), 20)
    return found.withColumn("score", F.round("score", 6))


@query(
    "knowledge_search",
    oracle_ctes("kb_v", f"{_QUESTIONS.strip()}, {_ranked_sql(rules.SEARCH_LIMIT)}",
                f"SELECT query_id, position, doc_key AS source, round(score, 6) AS score, document_type, exact FROM placed WHERE position <= {rules.SEARCH_LIMIT}"),
)
def knowledge_search(spark, sf_dir):
    ranked = retrieval.search(_questions(spark, sf_dir), _chunks(spark, sf_dir))
    return ranked.withColumn("score", F.round("score", 6)).drop("chunk_id")


@query(
    "question_sources",
    oracle_ctes("kb_v", f"{_QUESTIONS.strip()}, {_ranked_sql(rules.QUESTION_LIMIT)}",
                f"SELECT query_id, doc_key AS source, round(score, 6) AS score FROM placed WHERE position <= {rules.QUESTION_LIMIT}"),
)
def question_sources(spark, sf_dir):
    ranked = retrieval.search(_questions(spark, sf_dir), _chunks(spark, sf_dir), limit=rules.QUESTION_LIMIT)
    return ranked.select("query_id", "source", F.round("score", 6).alias("score"))
