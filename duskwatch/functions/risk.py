"""Severity, verdict and classification columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.functions.columns import first_match, joined_text, norm


def activity(title: Column, description: Column) -> Column:
    text = F.concat(F.lit(" "), joined_text(title, description), F.lit(" "))
    return first_match(text, rules.ACTIVITY_RULES, rules.ACTIVITY_DEFAULT)


def attack_type(title: Column, description: Column) -> Column:
    return first_match(joined_text(title, description), rules.ATTACK_RULES, rules.ATTACK_DEFAULT)


def severity_from_level(level: Column) -> Column:
    """Host rule level; text that is no integer counts as level 0."""
    n = F.coalesce(level.try_cast("int"), F.lit(0))
    return F.when(n >= 12, "critical").when(n >= 8, "high").when(n >= 4, "medium").otherwise("low")


def severity_from_number(number: Column) -> Column:
    return F.when(number == 1, "critical").when(number == 2, "high").otherwise("medium")


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 99 for anything else."""
    s = norm(severity)
    out = F.when(s == rules.SEVERITIES[0], 0)
    for rank, name in enumerate(rules.SEVERITIES[1:], start=1):
        out = out.when(s == name, rank)
    return out.otherwise(99)


def is_high_risk(level: Column) -> Column:
    return norm(F.coalesce(level, F.lit("medium"))).isin(*rules.HIGH_RISK)


def abuse_verdict(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return (
        F.when(s < rules.ABUSE_SUSPICIOUS_FROM, rules.SAFE)
        .when(s < rules.ABUSE_MALICIOUS_FROM, rules.SUSPICIOUS)
        .otherwise(rules.MALICIOUS)
    )


def engine_verdict(malicious: Column, suspicious: Column) -> Column:
    bad, odd = F.coalesce(malicious, F.lit(0)), F.coalesce(suspicious, F.lit(0))
    return (
        F.when(bad >= rules.ENGINES_MALICIOUS_FROM, rules.MALICIOUS)
        .when((bad >= 1) | (odd >= 1), rules.SUSPICIOUS)
        .otherwise(rules.SAFE)
    )


def pulse_verdict(ioc_type: Column, pulses: Column) -> Column:
    n = F.coalesce(pulses, F.lit(0))
    return (
        F.when(n == 0, rules.SAFE)
        .when((ioc_type == "hash") & (n >= rules.HASH_PULSES_MALICIOUS_FROM), rules.MALICIOUS)
        .otherwise(rules.SUSPICIOUS)
    )


def internal_verdict(configured: Column, matches: Column) -> Column:
    return (
        F.when(~configured, rules.UNKNOWN_RISK)
        .when(F.coalesce(matches, F.lit(0)) > 0, rules.SUSPICIOUS)
        .otherwise(rules.SAFE)
    )


def _risk_synonym(level: Column) -> Column:
    text = norm(level)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(rules.RISK_SYNONYMS.items())])
    return F.coalesce(F.try_element_at(table, text), text)


def normal_risk(level: Column, severity: Column) -> Column:
    """Risk synonyms folded; else the incident severity; else medium."""
    risk, fallback = _risk_synonym(level), _risk_synonym(severity)
    return (
        F.when(risk.isin(*rules.SEVERITIES), risk).when(fallback.isin(*rules.SEVERITIES), fallback).otherwise("medium")
    )


def fallback_technique(title: Column, description: Column) -> Column:
    return first_match(joined_text(title, description), rules.TECHNIQUE_FALLBACKS, "")


def confidence(source_count: Column) -> Column:
    return F.when(source_count >= 3, "high").when(source_count == 2, "medium").otherwise("single_source")


def usable_target(target: Column, kind: str) -> Column:
    """False for blank or placeholder targets of an endpoint, user or notification action."""
    banned = rules.UNUSABLE_TARGETS + rules.UNUSABLE_BY_KIND[kind]
    return ~norm(target).isin(*banned)
