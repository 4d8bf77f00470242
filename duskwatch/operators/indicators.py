"""Indicators of compromise as tall tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import ioc
from duskwatch.functions.columns import truthy
from duskwatch.operators.correlate import primary_incidents

KINDS = ("ip", "domain", "url", "hash")


def text_indicators(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per distinct indicator of each text: ``keep..., ioc_type, value, hash_type``."""
    return df.select(*keep, F.inline(ioc.indicators(F.col(text))))


def text_indicators_of(df: DataFrame, text: str, kind: str, *keep: str) -> DataFrame:
    """The same for one kind of :data:`KINDS`, without looking for the others."""
    return df.select(*keep, F.inline(ioc.indicators_of(F.col(text), kind)))


def incident_indicators(incidents: DataFrame, *keep: str) -> DataFrame:
    """Indicators of title and description plus the explicit addresses, distinct per incident."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    explicit = F.transform(
        F.array_compact(F.array(truthy(F.col("source_ip")), truthy(F.col("destination_ip")))),
        lambda v: F.struct(F.lit("ip").alias("ioc_type"), v.alias("value"), F.lit(None).cast("string").alias("hash_type")),
    )
    found = F.array_distinct(F.concat(explicit, ioc.indicators(text)))
    return incidents.select(F.col("id").alias("incident_id"), *keep, F.inline(found))


def group_indicators(labelled: DataFrame) -> DataFrame:
    """Indicators each primary incident gathers from itself and its correlated incidents."""
    found = incident_indicators(labelled, "source", "correlation_id")
    role = F.when(F.col("incident_id") == F.col("primary_id"), "primary").otherwise("correlated")
    return found.join(primary_incidents(labelled), "correlation_id").select(
        "primary_id", "ioc_type", "value", "hash_type", "incident_id", "source", role.alias("role")
    )


def observations(gathered: DataFrame) -> DataFrame:
    """Distinct places an indicator was seen, one row each."""
    return gathered.select("ioc_type", "value", "incident_id", "source", "role").distinct()


def counts_by_type(found: DataFrame, *keys: str) -> DataFrame:
    """Number of distinct indicators per type, one column per type."""
    distinct = found.select(*keys, "ioc_type", "value").distinct()
    return distinct.groupBy(*keys).agg(*[F.count_if(F.col("ioc_type") == k).alias(f"{k}_count") for k in KINDS])
