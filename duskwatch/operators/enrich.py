"""Indicator enrichment from provider tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import net, risk, rules
from duskwatch.operators.timecells import last_before

# --- fixed values: provider names ------------------------------------------
ABUSE, ENGINES, PULSES, INTERNAL = "abuseipdb", "virustotal", "otx", "misp"
PROVIDERS = (ABUSE, ENGINES, PULSES, INTERNAL)
_FIGURES = {
    ABUSE: ("abuse_score",),
    ENGINES: ("malicious", "suspicious"),
    PULSES: ("pulse_count",),
    INTERNAL: ("match_count",),
}


def _verdict(provider: str, configured: bool) -> Column:
    if provider == ABUSE:
        return risk.abuse_verdict(F.col("abuse_score"))
    if provider == ENGINES:
        return risk.engine_verdict(F.col("malicious"), F.col("suspicious"))
    if provider == PULSES:
        return risk.pulse_verdict(F.col("ioc_type"), F.col("pulse_count"))
    return risk.internal_verdict(F.lit(configured), F.col("match_count"))


def with_scope(iocs: DataFrame) -> DataFrame:
    """Address scope of IP indicators, null for the other types."""
    return iocs.withColumn("scope", F.when(F.col("ioc_type") == "ip", net.ip_scope(F.col("value"))))


def enrich(iocs: DataFrame, feeds: Mapping[str, DataFrame]) -> DataFrame:
    """One row per distinct indicator and provider asked: status, reason and verdict.

    ``feeds`` maps provider names to tables keyed by (ioc_type, value). A provider
    without a row for an indicator knows nothing bad about it. An internal feed that is
    not given counts as not configured. Providers are joined on the distinct indicators,
    so however often one is seen it is looked up once.
    """
    known = with_scope(iocs.select("ioc_type", "value").distinct())
    for provider, feed in feeds.items():
        known = known.join(feed.select("ioc_type", "value", *_FIGURES[provider]), ["ioc_type", "value"], "left")
    for provider in PROVIDERS:
        for figure in _FIGURES[provider]:
            if figure not in known.columns:
                known = known.withColumn(figure, F.lit(None).cast("bigint"))

    invalid = F.coalesce(F.col("scope") == "invalid", F.lit(False))
    hidden = F.coalesce(F.col("scope").isin("private", "non-public"), F.lit(False))
    answers = []
    for provider in PROVIDERS:
        configured = provider in feeds
        skipped = invalid if provider == INTERNAL else invalid | hidden
        status = F.when(skipped, "skipped").when(F.lit(provider == INTERNAL and not configured), "not_configured").otherwise("success")
        reason = F.when(invalid, rules.INVALID_IP_REASON).when(skipped, rules.NON_PUBLIC_REASON)
        answer = F.struct(
            F.lit(provider).alias("provider"),
            status.alias("status"),
            reason.alias("reason"),
            F.when(~skipped, _verdict(provider, configured)).alias("risk"),
        )
        # Only addresses are put to the abuse list.
        answers.append(F.when(F.col("ioc_type") == "ip", answer) if provider == ABUSE else answer)
    return known.select("ioc_type", "value", "scope", F.inline(F.array_compact(F.array(*answers))))


def first_entries(entries: DataFrame, number: int) -> DataFrame:
    """The first ``number`` entries of each indicator by ``position``, one row each: entries (ioc_type, value, position and more)."""
    order = Window.partitionBy("ioc_type", "value").orderBy("position")
    return entries.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= number).drop("nth")


def pulses_kept(pulses: DataFrame, number: int = rules.PULSES_KEPT) -> DataFrame:
    """Pulses that a result names, of all that the provider lists for an indicator."""
    return first_entries(pulses, number).select("ioc_type", "value", "position", "name", "id")


def matches_kept(matches: DataFrame, number: int = rules.INTERNAL_MATCHES_KEPT) -> DataFrame:
    """Attributes of the internal feed that a result names."""
    return first_entries(matches, number).select("ioc_type", "value", "position", "id", "category", "comment", "event_id", "event_info")


def provider_map(enriched: DataFrame) -> DataFrame:
    """One row per indicator with a map provider -> (status, reason, risk); at most four entries."""
    entry = F.struct("provider", F.struct("status", "reason", "risk").alias("answer"))
    return enriched.groupBy("ioc_type", "value", "scope").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("providers")
    )


def cached_lookup(lookups: DataFrame, cache: DataFrame, ttl_seconds: int = rules.CACHE_SECONDS) -> DataFrame:
    """Newest cached result not older than the time to live, null where a new lookup is due.

    ``lookups`` has ``ioc, t, id``; ``cache`` has ``ioc, t, id`` and a struct ``payload``.
    """
    return last_before(lookups, cache, "ioc", ttl_seconds * 1_000_000, inclusive=True)


def validate_techniques(claims: DataFrame, techniques: DataFrame) -> DataFrame:
    """Technique id (first word of the claim, upper case) looked up in the reference table.

    ``techniques`` has ``technique_id, name, description``, ids distinct.
    """
    first_word = F.regexp_extract(F.coalesce("mitre_technique", F.lit("")), r"^([^ ]*)", 1)
    asked = claims.withColumn("technique_id", F.nullif(F.upper(F.trim(first_word)), F.lit("")))
    found = techniques.select("technique_id", "name", F.col("description").alias("technique_description"))
    return asked.join(found, "technique_id", "left").withColumn("valid", F.col("name").isNotNull())
