"""Cross-sensor correlation: related incidents, groups, primaries and summaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import risk, rules
from duskwatch.functions.columns import micros, truthy
from duskwatch.operators.timecells import MICROS_PER_MINUTE, cell_of, cells_seen_from, width_for
from duskwatch.session import cut_lineage

TASK_INCIDENTS = 50_000  # whose entries one task sorts, on average


def tasks_for(incidents: DataFrame) -> int:
    """Tasks that grow in step with the rows, so that none gets more of them on a larger table; a number that is stated is not merged again."""
    return max(incidents.sparkSession.sparkContext.defaultParallelism, math.ceil(incidents.count() / TASK_INCIDENTS))


def _lookup_keys() -> Column:
    """Keys under which a row can be found, each with its kind (also the key's first word)."""
    both = F.col("source_ip").isNotNull() & F.col("destination_ip").isNotNull()
    pair = F.concat_ws("|", F.least("source_ip", "destination_ip"), F.greatest("source_ip", "destination_ip"))

    def entry(kind: str, value: Column) -> Column:
        named = F.concat(F.lit(f"{kind}|"), value)
        return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), named.alias("key")))

    return F.array_compact(
        F.array(
            entry("pair", F.when(both, pair)),
            entry("source", F.col("source_ip")),
            entry("destination", F.col("destination_ip")),
            entry("host", F.col("hostname")),
        )
    )


def _question_kind() -> Column:
    """Which key the row itself asks for; null when it has nothing to ask with."""
    src, dst = F.col("source_ip").isNotNull(), F.col("destination_ip").isNotNull()
    return (
        F.when(src & dst, "pair").when(src, "source").when(dst, "destination").when(F.col("hostname").isNotNull(), "host")
    )


def related_incidents(
    incidents: DataFrame,
    *,
    window_minutes: int = rules.CORRELATION_WINDOW_MINUTES,
    candidates: int = rules.CORRELATION_CANDIDATES,
    cell_us: int | None = None,
) -> DataFrame:
    """For each incident the one it is related to: ``id, related_id, kind, t``.

    Of the newest ``candidates`` earlier incidents of another source under the asked key
    within the window, the newest with the same activity. No pairs are formed: the newest
    row of another source and equal activity is carried along by running windows, and its
    rank among the candidates is a difference of running counts.
    """
    reach = window_minutes * MICROS_PER_MINUTE
    cell_us = cell_us or width_for(reach)
    rows = (
        incidents.select(
            "id",
            "source",
            truthy(F.col("source_ip")).alias("source_ip"),
            truthy(F.col("destination_ip")).alias("destination_ip"),
            truthy(F.col("hostname")).alias("hostname"),
            risk.activity(F.col("title"), F.col("description")).alias("act"),
            micros(F.col("created_at")).alias("t"),
        )
        .withColumn("asks", _question_kind())
        .withColumn("found_by", F.explode(_lookup_keys()))
        .withColumn("cell", F.explode(cells_seen_from(F.col("t"), reach, cell_us)))
        .select(
            F.col("found_by.kind").alias("kind"),
            F.col("found_by.key").alias("key"),
            "cell",
            "t",
            "id",
            "source",
            "act",
            ((F.col("asks") == F.col("found_by.kind")) & (F.col("cell") == cell_of(F.col("t"), cell_us))).alias("asking"),
            F.col("source").isNotNull().alias("usable"),
        )
    )
    group = ["key", "cell"]
    rows = rows.repartition(tasks_for(incidents), *group)
    earlier = (Window.unboundedPreceding, -1)

    in_group = Window.partitionBy(*group).orderBy("t", "id").rowsBetween(*earlier)
    same_act = Window.partitionBy(*group, "act").orderBy("t", "id")
    same_source = Window.partitionBy(*group, "source").orderBy("t", "id").rowsBetween(*earlier)
    me = F.struct("t", "id", "source", "before")
    rows = rows.withColumn("before", F.coalesce(F.count(F.when(F.col("usable"), 1)).over(in_group), F.lit(0)))
    rows = rows.withColumn("previous", F.last(F.when(F.col("usable"), me), ignorenulls=True).over(same_act.rowsBetween(*earlier)))
    # The last row of another source is the one before the current unbroken run of my source.
    run_starts = F.when(F.col("usable") & (F.col("previous.source") != F.col("source")), F.col("previous"))
    before_run = F.last(run_starts, ignorenulls=True).over(same_act.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("match", F.when(F.col("usable"), before_run).otherwise(F.col("previous")))
    rows = rows.withColumn("own_before", F.when(F.col("usable"), F.count(F.lit(1)).over(same_source)).otherwise(0))

    near = F.col("asking") & (F.col("t") - F.col("match.t") <= reach)
    between = F.col("before") - F.col("match.before") - 1
    # Too many rows in between to be sure: ask how many of them were of my own source.
    unsure = near & F.col("usable") & (between >= candidates)
    plain = F.struct(F.lit(False).alias("second"), F.col("before").alias("at"))
    second = F.struct(F.lit(True).alias("second"), F.col("match.before").alias("at"))
    rows = rows.withColumn("near", near).withColumn("between", between)
    rows = rows.withColumn("entry", F.explode(F.when(unsure, F.array(plain, second)).otherwise(F.array(plain))))
    upto = Window.partitionBy(*group, "source").orderBy("entry.at", "entry.second").rowsBetween(*earlier)
    own_until_match = F.count(F.when(~F.col("entry.second") & F.col("usable"), 1)).over(upto)
    others_between = F.col("between") - (F.col("own_before") - F.coalesce(own_until_match, F.lit(0)))
    rows = rows.withColumn("others", F.when(F.col("entry.second"), others_between).otherwise(F.col("between")))
    # Rows without a source have no own rows to discount; every row in between counts.
    return rows.filter(F.col("near") & (F.col("others") < candidates)).select(
        "id", F.col("match.id").alias("related_id"), "kind", "t"
    )


def resolve_roots(parents: DataFrame) -> DataFrame:
    """``id, parent_id`` forest to ``id, root_id`` by pointer doubling.

    Every round doubles the distance a pointer spans, so there are as many as the logarithm of the longest chain. A
    round works on the rows still open and writes those alone; rows that have reached their root were written when they
    did and are only looked up.
    """
    waiting = cut_lineage(parents.select("id", F.col("parent_id").alias("to")))
    settled: list[DataFrame] = []
    while True:
        open_step = waiting.select(F.col("id").alias("to"), F.col("to").alias("further"), F.lit(False).alias("known"))
        steps = [done.select(F.col("id").alias("to"), F.col("to").alias("further"), F.lit(True).alias("known")) for done in settled]
        step = reduce(DataFrame.unionByName, steps, open_step)
        # A target that is nobody's child is a root; so is what a settled target points at.
        moved = cut_lineage(
            waiting.join(step, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.coalesce("known", F.lit(True)).alias("settled"))
        )
        settled.append(moved.filter("settled").select("id", "to"))
        waiting = moved.filter(~F.col("settled")).select("id", "to")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, settled).select("id", F.col("to").alias("root_id"))


def correlation_id(root: Column) -> Column:
    return F.concat(F.lit("SOC-"), F.md5(root.cast("string")))


def correlate(incidents: DataFrame, **options) -> DataFrame:
    """Incidents with ``correlation_id``: inherited from the related one, else a new one.

    Ids already set stay and are inherited. New ids are a digest of the group's first
    incident, so a rerun gives the same ids.
    """
    known = "correlation_id" in incidents.columns
    related = related_incidents(incidents, **options)
    if known:
        unlabelled = incidents.filter(F.col("correlation_id").isNull()).select("id")
        related = related.join(unlabelled, "id", "left_semi")
    roots = resolve_roots(related.select("id", F.col("related_id").alias("parent_id")))
    out = incidents.withColumnRenamed("correlation_id", "known_id") if known else incidents
    out = out.join(roots, "id", "left").withColumn("root_id", F.coalesce("root_id", "id"))
    if known:
        labels = incidents.filter(F.col("correlation_id").isNotNull()).select(
            F.col("id").alias("root_id"), F.col("correlation_id").alias("root_label")
        )
        out = out.join(labels, "root_id", "left")
        label = F.coalesce("known_id", "root_label", correlation_id(F.col("root_id")))
        return out.withColumn("correlation_id", label).drop("known_id", "root_label", "root_id")
    return out.withColumn("correlation_id", correlation_id(F.col("root_id"))).drop("root_id")


def primary_incidents(labelled: DataFrame) -> DataFrame:
    """First incident by (created_at, id) of each correlation id."""
    first = F.min(F.struct("created_at", "id"))
    return (
        labelled.filter(F.col("correlation_id").isNotNull())
        .groupBy("correlation_id")
        .agg(first.alias("first"))
        .select("correlation_id", F.col("first.id").alias("primary_id"))
    )


def mark_correlated(labelled: DataFrame) -> DataFrame:
    """``is_primary``, and ``workflow_status`` 'correlated' for all but the primary."""
    out = labelled.join(primary_incidents(labelled), "correlation_id", "left")
    is_primary = F.coalesce(F.col("primary_id") == F.col("id"), F.lit(True))
    return out.withColumn("is_primary", is_primary).withColumn(
        "workflow_status", F.when(is_primary, F.col("workflow_status")).otherwise("correlated")
    )


EVIDENCE = (
    "id", "source", "title", "description", "severity", "status", "hostname", "source_ip", "destination_ip",
    "username", "workflow_status", "correlation_id", "created_at",
)


def correlated_evidence(labelled: DataFrame) -> DataFrame:
    """The other members of each primary incident's group, one row per member.

    Only primaries run the workflow, so members are listed once per group rather than
    once per pair.
    """
    return (
        labelled.join(primary_incidents(labelled), "correlation_id")
        .filter(F.col("id") != F.col("primary_id"))
        .select("primary_id", *EVIDENCE)
    )


def correlation_summary(labelled: DataFrame) -> DataFrame:
    """Sources, their number, confidence and member count per correlation id."""
    sources = F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source"))))
    return (
        labelled.filter(F.col("correlation_id").isNotNull())
        .groupBy("correlation_id")
        .agg(sources.alias("sources"), (F.count(F.lit(1)) - 1).alias("correlated_incident_count"))
        .withColumn("source_count", F.size("sources"))
        .withColumn("confidence", risk.confidence(F.col("source_count")))
    )


def group_rollup(labelled: DataFrame) -> DataFrame:
    """Size, sources, highest severity, first and last time per correlation id."""
    rank = F.when(F.col("severity") != "", 99 - risk.severity_rank(F.col("severity")))
    # Ties keep the first severity met in time order.
    worst = F.max(F.when(rank.isNotNull(), F.struct(rank.alias("r"), (-micros(F.col("created_at"))).alias("t"), (-F.col("id")).alias("i"), "severity")))
    return (
        labelled.filter(F.col("correlation_id").isNotNull())
        .groupBy("correlation_id")
        .agg(
            F.count(F.lit(1)).alias("incident_count"),
            F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"),
            worst.alias("worst"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
        .withColumn("highest_severity", F.coalesce("worst.severity", F.lit("unknown")))
        .drop("worst")
    )


def group_addresses(labelled: DataFrame) -> DataFrame:
    """Distinct addresses of each correlation id, one row per (id, role, address)."""
    pairs = F.array(
        F.struct(F.lit("source").alias("role"), F.col("source_ip").alias("address")),
        F.struct(F.lit("destination").alias("role"), F.col("destination_ip").alias("address")),
    )
    return (
        labelled.filter(F.col("correlation_id").isNotNull())
        .select("correlation_id", F.inline(pairs))
        .filter(F.col("address") != "")
        .distinct()
    )
