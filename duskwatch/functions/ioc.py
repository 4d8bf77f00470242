"""Indicator extraction from free text, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.functions import net, rules
from duskwatch.functions.columns import let


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def extract_ips(text: Column) -> Column:
    return _sorted_distinct(F.filter(_all(text, rules.IPV4), net.is_ipv4))


def extract_urls(text: Column) -> Column:
    trailing = r"[.,);\]}]+$"
    return _sorted_distinct(F.transform(_all(text, rules.URL), lambda u: F.regexp_replace(u, trailing, "")))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL: between the scheme and the path, without credentials or port."""
    authority = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", "")
    return F.lower(host)


def _plausible_domain(domain: Column) -> Column:
    labels = F.split(domain, r"\.")
    bad_edge = F.exists(labels, lambda p: p.startswith("-") | p.endswith("-"))
    return ~bad_edge & ~F.element_at(labels, -1).isin(*rules.FILE_SUFFIXES)


def extract_domains(text: Column, urls: Column | None = None) -> Column:
    """Names in the text plus the hosts of its URLs (given, or found here); the latter skip the file-name filter."""
    free = F.filter(F.transform(_all(text, rules.DOMAIN), F.lower), _plausible_domain)
    whole = r"^([a-z0-9-]+\.)+[a-z]{2,63}$"
    hosts = F.filter(F.transform(extract_urls(text) if urls is None else urls, url_host), lambda h: h.rlike(whole))
    return _sorted_distinct(F.concat(free, hosts))


def _hashes_of(text: Column, kind: str, pattern: str) -> Column:
    values = F.array_distinct(F.transform(_all(text, pattern), F.lower))
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("hash_type"), v.alias("value")))


def extract_hashes(text: Column) -> Column:
    """Distinct ``(hash_type, value)`` structs, shortest hash type first."""
    return F.concat(*[_hashes_of(text, kind, pattern) for kind, pattern in rules.HASHES])


def _typed(values: Column, kind: str) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value"), F.lit(None).cast("string").alias("hash_type")),
    )


def _typed_hashes(text: Column) -> Column:
    return F.transform(
        extract_hashes(text),
        lambda h: F.struct(F.lit("hash").alias("ioc_type"), h["value"].alias("value"), h["hash_type"].alias("hash_type")),
    )


def indicators_of(text: Column, kind: str) -> Column:
    """Indicators of one kind (ip, domain, url or hash), by its own patterns only."""
    if kind == "hash":
        return _typed_hashes(text)
    return _typed({"ip": extract_ips, "domain": extract_domains, "url": extract_urls}[kind](text), kind)


def indicators(text: Column) -> Column:
    """All indicators of a text as one array of ``(ioc_type, value, hash_type)``; its URLs are looked for once."""
    return let(
        extract_urls(text),
        lambda urls: F.concat(_typed(extract_ips(text), "ip"), _typed(extract_domains(text, urls), "domain"), _typed(urls, "url"), _typed_hashes(text)),
    )
