"""State histories: resolution times, workflow states, action logs, retries, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.functions.columns import micros

BLOCK_IDS = 1_000_000


def resolved_times(changes: DataFrame) -> DataFrame:
    """``incident_id, resolved_us, status`` after all changes.

    The time is that of the first resolved/closed change after the last change to any
    other status; changes without a status touch nothing.
    """
    at = F.struct(micros(F.col("changed_at")).alias("t"), F.col("change_id").alias("c"))
    explicit = changes.filter(F.col("status") != "").select("incident_id", "status", at.alias("at"))
    ended = F.col("status").isin(*rules.TERMINAL_STATUSES)
    last = explicit.groupBy("incident_id").agg(
        F.max(F.when(~ended, F.col("at"))).alias("reopened"), F.max_by("status", "at").alias("final_status")
    )
    after = F.col("reopened").isNull() | (F.col("at") > F.col("reopened"))
    return (
        explicit.join(last, "incident_id")
        .groupBy("incident_id", "final_status")
        .agg(F.min(F.when(ended & after, F.col("at"))).alias("first"))
        .select("incident_id", F.col("first.t").alias("resolved_us"), F.col("final_status").alias("status"))
    )


def previous_in_key(df: DataFrame, key: str, order: str, value: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``df`` with the ``value`` of the row before, per key and ordered by a whole number.

    Like ``lag``, but a long history is cut into blocks of the order number: inside a
    block the lag is local, and each block's last value is handed to the next one.
    """
    block = F.col(order) - F.pmod(order, F.lit(block_ids))
    cut = df.withColumn("block", block)
    ends = cut.groupBy(key, "block").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("last"))
    handed = ends.select(key, "block", F.lag("last").over(Window.partitionBy(key).orderBy("block")).alias("handed"))
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(key, "block").orderBy(order))
    return (
        cut.withColumn("inside", inside)
        .join(handed, [key, "block"], "left")
        .withColumn("before", F.coalesce("inside.v", F.when(F.col("inside").isNull(), F.col("handed.v"))))
        .drop("block", "inside", "handed")
    )


def action_history(logs: DataFrame) -> DataFrame:
    """Logs in id order with a check that each row starts where the one before ended."""
    return previous_in_key(logs, "action_id", "id", "new_status").withColumn(
        "consistent", F.col("before").eqNullSafe(F.col("previous_status"))
    )


def latest_states(events: DataFrame) -> DataFrame:
    """Newest workflow state per incident."""
    return events.groupBy("incident_id").agg(F.max_by("workflow_status", F.struct("changed_at", "event_id")).alias("workflow_status"))


def transition_counts(events: DataFrame) -> DataFrame:
    """How often each workflow state follows each other one; the first follows 'pending'."""
    moves = previous_in_key(events, "incident_id", "event_id", "workflow_status")
    return moves.groupBy(F.coalesce("before", F.lit("pending")).alias("from_status"), F.col("workflow_status").alias("to_status")).agg(
        F.count(F.lit(1)).alias("moves")
    )


def run_state(failure: Column, interrupted: Column) -> Column:
    """State a workflow run ends in; ``failure`` is null, 'rate_limit' or any other error."""
    return (
        F.when(failure == "rate_limit", "rate_limited")
        .when(failure.isNotNull(), "failed")
        .when(interrupted, "waiting_for_human")
        .otherwise("completed")
    )


def retry_cycle(batch: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes of one retry cycle: tried oldest first, stopping after the first still limited.

    ``batch`` has at most a handful of ids (see ``search.retry_batch``).
    """
    tried = batch.join(outcomes, "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))
    earlier = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((F.col("outcome") == "rate_limited").cast("int")).over(earlier), F.lit(0))
    return tried.withColumn("stopped", stopped).filter(F.col("stopped") == 0).select("id", "outcome")


def stage_traces(stages: DataFrame) -> DataFrame:
    """Stages of each run in order, as one list per run (a run has at most seven stages)."""
    steps = F.array_sort(F.collect_set(F.struct("seq", "stage")))
    return stages.groupBy("incident_id").agg(F.transform(steps, lambda s: s["stage"]).alias("agent_trace"))
