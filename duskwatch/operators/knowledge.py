"""Knowledge base: catalogue records to sections, markdown to documents and chunks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from duskwatch.functions import rules
from duskwatch.functions.columns import let, strip, truthy

NEWLINE = "\n"


# --- text cleaning and identifiers -----------------------------------------
@pandas_udf(T.StringType())
def _unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(html.unescape, na_action="ignore")


def clean_catalog_text(c: Column) -> Column:
    """Entities decoded, white space collapsed, ends trimmed; null becomes empty."""
    return strip(F.regexp_replace(_unescape(F.coalesce(c, F.lit(""))), r"\s+", " "))


def clean_page_text(c: Column) -> Column:
    """Line ends unified, running head and date removed, spaces and blank lines collapsed."""
    text = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, r"(?i)NIST CSWP 29\s+The NIST Cybersecurity Framework \(CSF\) 2\.0", "")
    text = F.regexp_replace(text, r"(?i)February 26,\s*2024", "")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def framework_functions(text: Column) -> Column:
    """Function names found in the text, in framework order."""
    upper = F.upper(text)
    names = rules.FRAMEWORK_FUNCTIONS.values()
    return F.array_compact(F.array(*[F.when(upper.contains(n), F.lit(n)) for n in names]))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def framework_codes(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_found(text, rules.FRAMEWORK_CODE)))


def requested_ids(text: Column) -> Column:
    """CVE, CWE and technique ids named in a question."""
    upper = F.upper(text)
    return F.array_distinct(F.concat(*[_found(upper, p) for p in (rules.CVE_ID, rules.CWE_ID, rules.TECHNIQUE_ID)]))


def page_sections(pages: DataFrame) -> DataFrame:
    """Cleaned framework pages with the functions and codes they name."""
    cleaned = pages.withColumn("text", clean_page_text(F.col("text"))).filter(F.col("text") != "")
    return cleaned.withColumn("functions", framework_functions(F.col("text"))).withColumn("codes", framework_codes(F.col("text")))


def render_page(page: Column, functions: Column, codes: Column, text: Column) -> Column:
    listed = [
        F.when(F.size(values) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(values, ", "), F.lit(NEWLINE)))
        for label, values in (("Detected CSF Functions", functions), ("Detected CSF Identifiers", codes))
    ]
    number = page.cast("string")
    return F.concat_ws(
        NEWLINE,
        F.concat(F.lit("## NIST CSF 2.0 - Page "), number, F.lit(NEWLINE)),
        F.concat(F.lit("**PDF Page:** "), number, F.lit(NEWLINE)),
        *listed,
        F.concat(F.lit("### Content\n\n"), text),
    )


# --- catalogue records -----------------------------------------------------
def _first_truthy_of(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))), F.lit(1))


def _scored(metrics: Column) -> Column:
    """First scoring of a metrics list; newer score versions win within one entry."""

    def version(m: Column, key: str) -> Column:
        s = m[key]
        return F.when(
            s.isNotNull(),
            F.struct(
                F.coalesce(truthy(s["version"]), F.lit(key)).alias("version"),
                s["baseScore"].alias("score"),
                s["baseSeverity"].alias("severity"),
                s["vectorString"].alias("vector"),
            ),
        )

    keys = ("cvssV4_0", "cvssV3_1", "cvssV3_0", "cvssV2_0")
    each = F.transform(F.coalesce(metrics, F.array()), lambda m: F.coalesce(*[version(m, k) for k in keys]))
    return F.try_element_at(F.array_compact(each), F.lit(1))


def cve_fields(records: DataFrame, *keep: str) -> DataFrame:
    """Published records to flat fields."""
    meta, cna, adp = F.col("cveMetadata"), F.col("containers.cna"), F.col("containers.adp")
    none = F.array().cast("array<string>")
    english = F.transform(F.filter(cna["descriptions"], lambda d: d["lang"] == "en"), lambda d: d["value"])
    any_language = F.transform(cna["descriptions"], lambda d: d["value"])
    named = F.flatten(
        F.transform(
            cna["problemTypes"],
            lambda p: F.coalesce(F.transform(p["descriptions"], lambda d: d["cweId"]), F.array().cast("array<string>")),
        )
    )

    def product(a: Column) -> Column:
        return F.nullif(F.concat_ws(" - ", truthy(strip(a["vendor"])), truthy(strip(a["product"]))), F.lit(""))

    urls = F.transform(cna["references"], lambda r: truthy(strip(r["url"])))
    own = _scored(cna["metrics"])
    additional = F.try_element_at(
        F.filter(F.transform(F.coalesce(adp, F.array()), lambda a: _scored(a["metrics"])), lambda s: s["score"].isNotNull()),
        F.lit(1),
    )
    cvss = F.when(own["score"].isNotNull(), own).otherwise(additional)
    published = records.filter((meta["state"] == "PUBLISHED") & (meta["cveId"] != ""))
    return published.withColumn("cvss", cvss).select(
        *keep,
        meta["cveId"].alias("cve_id"),
        meta["state"].alias("state"),
        F.coalesce(truthy(cna["title"]), meta["cveId"]).alias("title"),
        F.coalesce(strip(F.coalesce(_first_truthy_of(english), _first_truthy_of(any_language))), F.lit("")).alias("description"),
        F.coalesce(F.array_distinct(F.filter(named, lambda c: c != "")), none).alias("cwe_ids"),
        F.col("cvss.version").alias("cvss_version"),
        F.col("cvss.score").alias("cvss_score"),
        F.col("cvss.severity").alias("cvss_severity"),
        F.col("cvss.vector").alias("cvss_vector"),
        F.coalesce(F.array_distinct(F.array_compact(F.transform(cna["affected"], product))), none).alias("products"),
        F.coalesce(F.slice(F.array_distinct(F.array_compact(urls)), 1, 10), none).alias("references"),
        F.coalesce(meta["datePublished"], F.lit("")).alias("published"),
        F.coalesce(meta["dateUpdated"], F.lit("")).alias("updated"),
        F.coalesce(meta["assignerShortName"], F.lit("")).alias("assigner"),
    )


def _line(label: str, value: Column) -> Column:
    """``**Label:** value``, or null (no line) when there is no value."""
    return F.when(value != "", F.concat(F.lit(f"**{label}:** "), value))


def _listing(title: str, items: Column) -> Column:
    return F.when(
        F.size(items) > 0, F.concat(F.lit(f"### {title}\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), NEWLINE), F.lit(NEWLINE))
    )


def render_cve(fields: DataFrame) -> DataFrame:
    """Adds ``text``: the section as markdown."""
    head = F.concat(F.lit("## "), F.col("cve_id"), F.lit(" - "), F.col("title"), F.lit(NEWLINE))
    text = F.concat_ws(
        NEWLINE,
        head,
        _line("CVE ID", F.col("cve_id")),
        _line("State", F.col("state")),
        _line("Assigner", F.col("assigner")),
        _line("Published", F.col("published")),
        _line("Updated", F.col("updated")),
        _line("CWE", F.array_join("cwe_ids", ", ")),
        _line("CVSS Version", F.col("cvss_version")),
        _line("CVSS Base Score", F.col("cvss_score")),
        _line("CVSS Severity", F.col("cvss_severity")),
        _line("CVSS Vector", F.col("cvss_vector")),
        F.lit(""),
        F.when(F.col("description") != "", F.concat(F.lit("### Description\n"), F.col("description"), F.lit(NEWLINE))),
        _listing("Affected Products", F.col("products")),
        _listing("References", F.col("references")),
    )
    return fields.withColumn("text", strip(text))


def technique_fields(objects: DataFrame, *keep: str) -> DataFrame:
    """Live attack patterns to flat fields."""
    own = F.try_element_at(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(1))
    phases = F.filter("kill_chain_phases", lambda p: (p["kill_chain_name"] == "mitre-attack") & (p["phase_name"] != ""))
    tactics = F.array_sort(F.array_distinct(F.transform(phases, lambda p: p["phase_name"])))
    text = F.replace(F.replace(F.coalesce("description", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    live = (
        (F.col("type") == "attack-pattern")
        & ~F.coalesce("revoked", F.lit(False))
        & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    )
    return (
        objects.filter(live)
        .withColumn("own", own)
        .filter(F.col("own.external_id") != "")
        .select(
            *keep,
            F.col("own.external_id").alias("technique_id"),
            F.coalesce("name", F.lit("Unknown technique")).alias("name"),
            strip(text).alias("description"),
            F.coalesce(tactics, F.array().cast("array<string>")).alias("tactics"),
            F.coalesce("own.url", F.lit("")).alias("url"),
        )
    )


def _block(*parts: Column) -> Column:
    """Paragraphs with a blank line between them; null parts are left out."""
    return F.concat_ws("\n\n", *parts)


def render_technique(fields: DataFrame) -> DataFrame:
    text = _block(
        F.concat(F.lit("## "), F.col("technique_id"), F.lit(" - "), F.col("name")),
        _line("Technique ID", F.col("technique_id")),
        _line("Name", F.col("name")),
        _line("Tactics", F.array_join("tactics", ", ")),
        F.when(F.col("description") != "", F.concat(F.lit("### Description\n\n"), F.col("description"))),
        _line("MITRE reference", F.col("url")),
        F.lit("---"),
    )
    return fields.withColumn("text", text)


# Tags of catalogue and xhtml elements; other angle brackets are text.
_TAG = r"</?(?:xhtml:\w+|[A-Z][A-Za-z_]*)(?:\s[^<>]*)?/?>"


def _element_text(c: Column) -> Column:
    """Text of an XML element that may hold child elements."""
    return clean_catalog_text(F.regexp_replace(F.coalesce(c, F.lit("")), _TAG, " "))


def weakness_fields(rows: DataFrame, *keep: str) -> DataFrame:
    """Catalogue elements to flat fields; entries without an id are left out."""
    flat = rows.filter(strip(F.col("_ID")) != "").select(
        *keep,
        F.concat(F.lit("CWE-"), strip(F.col("_ID"))).alias("cwe_id"),
        *[F.coalesce(strip(F.col(f"_{n}")), F.lit("")).alias(n.lower()) for n in ("Name", "Abstraction", "Structure", "Status")],
        _element_text(F.col("Description")).alias("description"),
        _element_text(F.col("Extended_Description")).alias("extended_description"),
        _element_text(F.col("Likelihood_Of_Exploit")).alias("likelihood"),
        _joined_items(F.col("Common_Consequences.Consequence")).alias("consequences"),
        _joined_items(F.col("Potential_Mitigations.Mitigation")).alias("mitigations"),
        _joined_items(F.col("Detection_Methods.Detection_Method")).alias("detections"),
        F.transform(
            F.filter(F.coalesce(F.col("Related_Weaknesses.Related_Weakness"), F.array()), lambda r: strip(r["_CWE_ID"]) != ""),
            lambda r: F.concat(
                F.lit("CWE-"), strip(r["_CWE_ID"]), F.coalesce(F.concat(F.lit(" ("), truthy(strip(r["_Nature"])), F.lit(")")), F.lit(""))
            ),
        ).alias("related"),
        _joined_items(
            F.transform(
                F.col("Observed_Examples.Observed_Example"),
                lambda e: F.nullif(F.concat_ws(" - ", truthy(strip(e["Reference"])), truthy(strip(e["Description"]))), F.lit("")),
            )
        ).alias("examples"),
    )
    lists = ("consequences", "mitigations", "detections", "examples")
    return flat.withColumns({c: F.filter(F.split(_unescape_once(F.col(c)), _ITEM), lambda i: i != "") for c in lists})


_ITEM = "\u001e"


def _joined_items(items: Column) -> Column:
    """List items without tags as one text, so entities are decoded once per row."""
    plain = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda i: F.regexp_replace(i, _TAG, " "))
    return F.array_join(F.array_compact(plain), _ITEM)


def _unescape_once(joined: Column) -> Column:
    text = F.regexp_replace(_unescape(joined), r"\s*\u001e\s*", _ITEM)
    return strip(F.regexp_replace(text, r"[^\S\u001e]+", " "))


def _paragraph_list(title: str, items: Column) -> Column:
    return F.when(
        F.size(items) > 0,
        F.concat(F.lit(f"### {title}\n\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), NEWLINE)),
    )


def render_weakness(fields: DataFrame) -> DataFrame:
    def section(title: str, column: str) -> Column:
        return F.when(F.col(column) != "", F.concat(F.lit(f"### {title}\n\n"), F.col(column)))

    text = _block(
        F.concat(F.lit("## "), F.col("cwe_id"), F.lit(" - "), F.col("name")),
        _line("CWE ID", F.col("cwe_id")),
        F.concat(F.lit("**Name:** "), F.col("name")),
        _line("Abstraction", F.col("abstraction")),
        _line("Structure", F.col("structure")),
        _line("Status", F.col("status")),
        _line("Likelihood of Exploit", F.col("likelihood")),
        section("Description", "description"),
        section("Extended Description", "extended_description"),
        _paragraph_list("Common Consequences", F.col("consequences")),
        _paragraph_list("Potential Mitigations", F.col("mitigations")),
        _paragraph_list("Detection Methods", F.col("detections")),
        _paragraph_list("Related Weaknesses", F.col("related")),
        _paragraph_list("Observed Examples", F.col("examples")),
        F.lit("---"),
    )
    return fields.withColumn("text", text)


# --- fixed values: closing parts every runbook has --------------------------
RUNBOOK_STEPS = ("detection", "triage", "investigation", "containment", "eradication", "recovery")
RUNBOOK_EVIDENCE = (
    "Alert and incident identifiers.",
    "Relevant timestamps.",
    "Source and destination IP addresses.",
    "User and host identifiers.",
    "Relevant process, network, and authentication telemetry.",
    "Threat-intelligence enrichment results.",
    "Analyst actions and response decisions.",
)
RUNBOOK_ESCALATION = (
    "Escalate when the incident is confirmed, affects critical assets, involves privileged accounts, "
    "causes significant business impact, or requires containment actions that need human approval."
)
RUNBOOK_HUMAN = "High-risk or disruptive response actions must be reviewed and approved by an authorized SOC analyst before execution."


def render_runbook(records: DataFrame) -> DataFrame:
    """Runbook records (id, title, mitre and one list per step) to markdown files."""

    def listed(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), NEWLINE)

    head = F.concat_ws(
        NEWLINE,
        F.lit("**Document Type:** Internal SOC Runbook"),
        F.concat(F.lit("**Runbook ID:** SOC-RUNBOOK-"), F.col("id")),
        F.concat(F.lit("**Incident Type:** "), F.col("title")),
        F.concat(F.lit("**MITRE ATT&CK:** "), F.col("mitre")),
    )
    steps = [F.concat(F.lit(f"## {s.capitalize()}\n\n"), listed(F.col(s))) for s in RUNBOOK_STEPS]
    evidence = F.lit("## Evidence to Preserve\n\n" + NEWLINE.join(f"- {e}" for e in RUNBOOK_EVIDENCE))
    text = _block(
        F.concat(F.lit("# SOC Runbook - "), F.col("title")),
        head,
        *steps,
        evidence,
        F.lit("## Escalation\n\n" + RUNBOOK_ESCALATION),
        F.lit("## Human-in-the-Loop\n\n" + RUNBOOK_HUMAN + NEWLINE),
    )
    file_name = F.concat(F.replace("id", F.lit("-"), F.lit("_")), F.lit("_runbook.md"))
    return records.select("id", F.concat(F.lit("runbooks/"), file_name).alias("path"), text.alias("content"))


# --- markdown files to documents -------------------------------------------
# --- fixed values: which file holds which kind of section -------------------
SECTION_FILES = {
    "mitre_attack": ("mitre/mitre_enterprise_attack.md", r"T\d{4}(?:\.\d{3})?"),
    "cwe": ("cwe/cwe_weaknesses.md", r"CWE-\d+"),
    "cve": ("cve/cve_selected.md", r"CVE-\d{4}-\d+"),
    "wazuh_documentation": ("wazuh/wazuh_soc_reference.md", r"WAZUH-[a-z0-9\-]+"),
    "suricata_documentation": ("suricata/suricata_soc_reference.md", r"SURICATA-[a-z0-9\-]+"),
}
FRAMEWORK_FILE = "nist/nist_csf_2_0.md"
SECTION_FIELDS = {
    "cwe": {"cwe_abstraction": "Abstraction", "cwe_status": "Status", "cwe_likelihood": "Likelihood of Exploit"},
    "cve": {"cwe_ids": "CWE", "cvss_score": "CVSS Base Score", "cvss_severity": "CVSS Severity", "published": "Published"},
    "wazuh_documentation": {"official_source": "Official Source"},
    "suricata_documentation": {"official_source": "Official Source"},
}
_PAGE = r"## NIST CSF 2\.0 - Page (\d+)\n"
_CATEGORY = r"•\s*(.+?)\s+\(((?:GV|ID|PR|DE|RS|RC)\.[A-Z]{2})\):"


def _label(text: Column, name: str) -> Column:
    """Value after ``**name:**``, empty when absent."""
    return strip(F.regexp_extract(text, rf"\*\*{re.escape(name)}:\*\*\s*(.+)", 1))


def _pieces(content: Column, heading: str) -> Column:
    """Parts of a text that begin with a heading, each up to the next heading."""
    parts = F.split(content, rf"(?m)(?=^{heading})", -1)
    return F.filter(parts, lambda p: p.rlike(rf"\A{heading}"))


def _metadata(**values: Column) -> Column:
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.array(*entries))


def file_kind(path: Column) -> Column:
    out = F.when(path == FRAMEWORK_FILE, "nist_csf")
    for kind, (file, _) in SECTION_FILES.items():
        out = out.when(path == file, kind)
    return out.when(path.rlike(r"^runbooks/.*_runbook\.md$"), "soc_runbook").otherwise("soc_knowledge")


def documents_from_markdown(files: DataFrame, *keep: str) -> DataFrame:
    """Files (``path, content``) to documents: one per section, page, runbook or plain file.

    Each file is cut by the heading of its own kind in a single pass. Columns:
    ``path, document_type, doc_key, title, display_source, text, metadata``.
    """
    path, content = F.col("path"), F.col("content")
    typed = files.select(*keep, "path", "content", file_kind(path).alias("document_type"))
    kind = F.col("document_type")

    pieces = F.when(kind == "nist_csf", _framework_pieces(content))
    for name, (_, ident) in SECTION_FILES.items():
        pieces = pieces.when(kind == name, _pieces(content, rf"## {ident} - .+?\n"))
    pieces = pieces.when(kind == "soc_runbook", F.array(strip(content))).otherwise(F.array(content))
    cut = typed.select(*keep, "path", "document_type", F.explode(pieces).alias("piece"))

    piece = F.col("piece")
    sectioned = kind.isin(*SECTION_FILES)
    text = F.when(kind == "soc_knowledge", piece).otherwise(strip(F.regexp_replace(piece, r"\A\u001d\d+\u001d", "")))
    cut = cut.withColumn("text", text).filter(F.col("text") != "")
    ident = F.regexp_extract(piece, r"\A## (\S+) - (.+?)\n", 1)
    name = strip(F.regexp_extract(piece, r"\A## (\S+) - (.+?)\n", 2))
    page = F.regexp_extract(piece, r"\A\u001d(\d+)\u001d", 1)
    category = F.regexp_extract(F.col("text"), rf"\A{_CATEGORY}", 2)
    category_name = strip(F.regexp_extract(F.col("text"), rf"\A{_CATEGORY}", 1))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    runbook_type = F.coalesce(truthy(_label(F.col("text"), "Incident Type")), stem)
    cut = cut.withColumns(
        {
            "doc_key": F.when(sectioned, ident)
            .when(kind == "nist_csf", F.coalesce(truthy(category), page))
            .when(kind == "soc_runbook", F.coalesce(truthy(_label(F.col("text"), "Runbook ID")), stem))
            .otherwise(F.col("path")),
            "title": F.when(sectioned, name)
            .when(kind == "nist_csf", category_name)
            .when(kind == "soc_runbook", runbook_type)
            .otherwise(F.col("path")),
            "page": page,
        }
    )
    key, title = F.col("doc_key"), F.col("title")

    def branded(brand: str) -> Column:
        return F.when(F.lower(title).startswith(brand.lower()), title).otherwise(F.concat(F.lit(f"{brand} "), title))

    display = (
        F.when(kind == "mitre_attack", F.concat(F.lit("MITRE ATT&CK "), key, F.lit(" - "), title))
        .when(kind.isin("cwe", "cve"), F.concat(key, F.lit(" - "), title))
        .when(kind == "wazuh_documentation", branded("Wazuh"))
        .when(kind == "suricata_documentation", branded("Suricata"))
        .when(kind == "soc_runbook", F.concat(F.lit("SOC Runbook - "), title))
        .when((kind == "nist_csf") & (title != ""), F.concat(F.lit("NIST CSF 2.0 "), key, F.lit(" - "), title))
        .when(kind == "nist_csf", F.concat(F.lit("NIST CSF 2.0 - Page "), F.col("page")))
        .otherwise(F.col("path"))
    )
    return cut.select(
        *keep, "path", "document_type", "doc_key", "title", display.alias("display_source"), "text", _all_metadata().alias("metadata")
    )


def _framework_pieces(content: Column) -> Column:
    """Category parts of each page, or the page itself; each led by its page number."""

    def of_page(page: Column) -> Column:
        number = F.regexp_extract(page, rf"\A{_PAGE}", 1)
        marked = F.concat(F.lit("\u001d"), number, F.lit("\u001d"))
        parts = _pieces(strip(page), _CATEGORY)
        chosen = F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(page)))
        return F.transform(chosen, lambda p: F.concat(marked, p))

    return F.flatten(F.transform(_pieces(content, _PAGE), of_page))


def _all_metadata() -> Column:
    """Key/value pairs read from a document's text, by its type."""
    kind, text, key, title = F.col("document_type"), F.col("text"), F.col("doc_key"), F.col("title")
    out = F.when(kind == "mitre_attack", _metadata(technique_id=key, technique_name=title))
    for name, id_name in (("cwe", "cwe_id"), ("cve", "cve_id"), ("wazuh_documentation", "topic_id"), ("suricata_documentation", "topic_id")):
        fields = {field: _label(text, label) for field, label in SECTION_FIELDS[name].items()}
        out = out.when(kind == name, _metadata(**{id_name: key, "name": title}, **fields))
    codes = F.array_sort(F.array_distinct(F.filter(_found(text, rules.FRAMEWORK_CODE), lambda c: c.startswith(F.concat(key, F.lit("-"))))))
    function = F.coalesce(*[F.when(key.startswith(p), F.lit(n)) for p, n in rules.FRAMEWORK_FUNCTIONS.items()], F.lit(""))
    has_category = title != ""
    framework = _metadata(
        page=F.col("page"),
        function=F.when(has_category, function).otherwise(_label(text, "Detected CSF Functions")),
        category_id=F.when(has_category, key).otherwise(""),
        identifiers=F.when(has_category, F.array_join(F.concat(F.array(key), codes), ", ")).otherwise(_label(text, "Detected CSF Identifiers")),
    )
    runbook = _metadata(runbook_id=key, incident_type=title, mitre_mapping=_label(text, "MITRE ATT&CK"), source_type=F.lit("internal"))
    return (
        out.when(kind == "nist_csf", framework)
        .when(kind == "soc_runbook", runbook)
        .otherwise(F.create_map().cast("map<string,string>"))
    )


# --- incremental refresh, chunks, vectors ----------------------------------
def file_fingerprints(files: DataFrame, version: str, model: str, chunk: int = rules.CHUNK_TOKENS, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """SHA-256 per file over index settings, path and content."""
    settings = F.lit(f"{version}{model}{chunk}{overlap}")
    return files.select("path", F.sha2(F.concat(settings, "path", "content"), 256).alias("fingerprint"))


def changed_files(files: DataFrame, fingerprints: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose fingerprint is not indexed yet; only these are built again."""
    stale = fingerprints.join(indexed.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")
    return files.join(stale.select("path"), "path", "left_semi")


CHUNK_MARK = "\u0001"  # set between chunks while they are put together; a text's own are read as blanks


def chunk_documents(docs: DataFrame, text: str, *keep: str, size: int = rules.CHUNK_TOKENS, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """Sentence-aware chunks of at most ``size`` words, neighbours sharing ``overlap``.

    Chunk ``k`` starts at word ``k * (size - overlap)`` and holds the sentences lying
    wholly inside. Sentences longer than the overlap are cut first, so every word is in
    at least one chunk. All of it happens inside the row and takes time in proportion to the text: a
    piece's place among all words gives the one or two chunks it belongs to, pieces are sorted by
    chunk and joined in one go. Nothing is shuffled.
    """
    stride = size - overlap

    def pieces(sentence: Column) -> Column:
        def cut(words: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(words), F.lit(overlap))
            return F.when(F.size(words) <= overlap, F.array(words)).otherwise(F.transform(starts, lambda s: F.slice(words, s, overlap)))

        return let(F.split(sentence, r"\s+"), cut)

    plain = F.translate(F.col(text), CHUNK_MARK, " ")
    sentences = F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")
    parts = F.flatten(F.transform(sentences, pieces))
    # Which words begin a piece; where they stand among all words is where the pieces start.
    heads = F.flatten(F.transform("parts", lambda words: F.transform(words, lambda _, i: i == 0)))
    starts = F.transform(F.filter(F.transform("heads", lambda head, i: F.struct(head.alias("head"), i.alias("at"))), lambda x: x["head"]), lambda x: x["at"])
    total = F.size("heads")
    last = F.greatest(F.ceil((total - overlap) / F.lit(stride)), F.lit(1)) - 1

    def homes(words: Column, i: Column) -> Column:
        at, n = F.get("starts", i), F.size(words)
        low = F.greatest(F.ceil((at + n - size) / F.lit(stride)), F.lit(0)).cast("bigint")
        high = F.least(F.floor(at / F.lit(stride)), F.col("last")).cast("bigint")
        # The piece's last word belongs to it as well, so its text comes along once for each chunk that holds it.
        one = lambda k: F.struct(k.alias("chunk"), i.alias("i"), n.alias("n"), F.array_join(words, " ").alias("text"))
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), one)).otherwise(F.array().cast("array<struct<chunk:bigint,i:int,n:int,text:string>>"))

    def glued(x: Column, j: Column) -> Column:
        before = F.get("placed", j - 1)["chunk"]
        return F.concat(F.when(j == 0, "").when(before != x["chunk"], CHUNK_MARK).otherwise(" "), x["text"])

    texts = F.split(F.array_join(F.transform("placed", glued), ""), CHUNK_MARK)
    chunks = F.arrays_zip(F.array_distinct(F.transform("placed", lambda x: x["chunk"])).alias("chunk"), texts.alias("text"))
    shaped = F.transform("chunks", lambda c: F.struct(c["chunk"].alias("chunk"), F.size(F.split(c["text"], " ")).alias("n_words"), c["text"].alias("text")))
    return (
        docs.filter(F.col(text).rlike(r"\S"))
        .select(*keep, parts.alias("parts"))
        .withColumn("heads", heads)
        .select(*keep, "parts", starts.alias("starts"), last.cast("bigint").alias("last"))
        .withColumn("placed", F.array_sort(F.flatten(F.transform("parts", homes))))
        .select(*keep, "placed", chunks.alias("chunks"))
        .select(*keep, F.inline(shaped))
    )


def text_vectors(docs: DataFrame, text: str, dims: int = 4096) -> DataFrame:
    """Unit-length weighted term vectors, for texts that bring no embedding."""
    words = Tokenizer(inputCol=text, outputCol="words").transform(docs)
    counted = HashingTF(inputCol="words", outputCol="counts", numFeatures=dims).transform(words)
    weighted = IDF(inputCol="counts", outputCol="weights").fit(counted).transform(counted)
    return Normalizer(inputCol="weights", outputCol="vector").transform(weighted).drop("words", "counts", "weights")

