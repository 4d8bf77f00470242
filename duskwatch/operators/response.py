"""Response decisions, action safety, execution outcomes and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import risk, rules
from duskwatch.functions.columns import first_truthy, norm, strip, truthy
from duskwatch.functions.net import is_blockable_ip

# --- fixed values: action types --------------------------------------------
TICKET, ISOLATE, BLOCK, DISABLE, NOTIFY = (
    "create_ticket", "isolate_endpoint", "block_ip", "disable_user", "send_notification",
)
ACTION_TYPES = (TICKET, BLOCK, ISOLATE, DISABLE, NOTIFY)


def route_by_risk(cases: DataFrame) -> DataFrame:
    """``next_stage``: human review when the severity or the analysed risk is high."""
    high = risk.is_high_risk(F.col("severity")) | risk.is_high_risk(F.col("risk_level"))
    return cases.withColumn("next_stage", F.when(high, "human_review").otherwise("response"))


def route_by_approval(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """After review: approved cases go on to the response, all others to the report."""
    decided = decisions.select("incident_id", F.col("approved").alias("human_approved"), F.col("comment").alias("human_comment"))
    out = cases.join(decided, "incident_id", "left")
    return out.withColumn("next_stage", F.when(F.col("human_approved"), "response").otherwise("report"))


def _first_of(df: DataFrame, *names: str) -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return first_truthy(*present) if present else F.lit(None).cast("string")


def action_kind(recommendation: Column) -> Column:
    """Action type named by a recommendation. 'ip' is matched inside words too."""
    text = F.lower(F.coalesce(recommendation, F.lit("")))
    return (
        F.when(text.contains("isolate"), ISOLATE)
        .when(text.contains("block") & text.contains("ip"), BLOCK)
        .when(text.contains("disable") & (text.contains("user") | text.contains("account")), DISABLE)
        .when(text.contains("notify") | text.contains("notification"), NOTIFY)
        .otherwise(TICKET)
    )


def propose_actions(cases: DataFrame) -> DataFrame:
    """Action type and target for each case; an unusable target becomes a ticket.

    A user target only has to be present here; placeholders are refused at approval.
    """
    df = cases.withColumn("wanted", action_kind(F.col("recommendation")))
    case_label = F.concat(F.lit("incident-"), F.coalesce(F.col("incident_id").cast("string"), F.lit("unknown")))
    fallback = F.coalesce(_first_of(df, "hostname"), case_label)
    candidate = (
        F.when(F.col("wanted") == ISOLATE, _first_of(df, "hostname", "endpoint", "device_name", "target"))
        .when(F.col("wanted") == BLOCK, _first_of(df, "ip_address", "source_ip", "src_ip", "ip", "target"))
        .when(F.col("wanted") == DISABLE, _first_of(df, "username", "user", "account", "target"))
        .when(F.col("wanted") == NOTIFY, F.coalesce(_first_of(df, "notification_target"), F.lit(rules.NOTIFICATION_DEFAULT)))
        .otherwise(F.coalesce(_first_of(df, "hostname", "endpoint", "target"), case_label))
    )
    df = df.withColumn("candidate", candidate)
    usable = (
        F.when(F.col("wanted") == ISOLATE, risk.usable_target(F.col("candidate"), ISOLATE))
        .when(F.col("wanted") == BLOCK, is_blockable_ip(F.col("candidate")))
        .otherwise(F.col("candidate").isNotNull())
    )
    return (
        df.withColumn("usable", usable)
        .withColumn("action_type", F.when(F.col("usable"), F.col("wanted")).otherwise(TICKET))
        .withColumn("target", F.when(F.col("usable"), F.col("candidate")).otherwise(fallback))
        .drop("wanted", "candidate", "usable")
    )


def respond(cases: DataFrame) -> DataFrame:
    """Response status of each case. Low risk approves itself, high risk needs a human."""
    high = risk.is_high_risk(F.col("severity")) | risk.is_high_risk(F.col("risk_level"))
    approved = F.when(high, F.coalesce(F.col("human_approved"), F.lit(False))).otherwise(True)
    return (
        cases.withColumn("human_approval_required", high)
        .withColumn("response_approved", approved)
        .withColumn("analysed_risk", norm(F.coalesce(F.col("risk_level"), F.lit("medium"))))
        .withColumn("automatic_execution", F.lit(False))
        .withColumn("response_status", F.when(approved, "approved_for_response").otherwise("blocked"))
    )


def stored_actions(cases: DataFrame) -> DataFrame:
    """Action rows of approved cases, in the state they are first stored in."""
    proposed = propose_actions(cases.filter(F.col("response_approved")))
    needs = F.coalesce(F.col("human_approval_required"), F.lit(False))
    return proposed.select(
        "incident_id",
        "action_type",
        "target",
        F.lit("approved").alias("status"),
        needs.alias("requires_approval"),
        F.lit(True).alias("approved"),
    )


def target_is_safe() -> Column:
    """Safety of ``target`` for the three disruptive action types; others always pass."""
    target = F.col("target")
    return (
        F.when(F.col("action_type") == ISOLATE, risk.usable_target(target, ISOLATE))
        .when(F.col("action_type") == BLOCK, is_blockable_ip(target))
        .when(F.col("action_type") == DISABLE, risk.usable_target(target, DISABLE))
        .otherwise(True)
    )


def decide_actions(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve or reject actions: ``new_status`` and ``new_approved``; undecided ones stay."""
    decided = decisions.select("incident_id", F.col("approved").alias("decision"))
    df = actions.join(decided, "incident_id", "left").withColumn("safe", target_is_safe())
    status = (
        F.when(F.col("decision").isNull(), F.col("status"))
        .when(~F.col("decision"), "rejected")
        .when(~F.col("safe"), "blocked_by_safety")
        .otherwise("approved")
    )
    approved = F.when(F.col("decision").isNull(), F.col("approved")).otherwise(F.col("decision") & F.col("safe"))
    return df.withColumn("new_status", status).withColumn("new_approved", approved).drop("safe")


def execution_outcomes(actions: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """``outcome`` of executing each action.

    Without ``results`` this is a dry run: whatever passes every check is simulated. With
    a ``results`` table (``id, success, simulated, executed``) the reported results decide.
    """
    waiting = F.col("requires_approval") & ~F.coalesce(F.col("approved"), F.lit(False))
    kind, target = norm(F.col("action_type")), F.coalesce(F.col("target"), F.lit(""))
    refused = (
        (strip(target) == "")
        | ~kind.isin(*ACTION_TYPES)
        | ((kind == NOTIFY) & ~risk.usable_target(F.col("target"), NOTIFY))
    )
    df = actions
    if results is None:
        done = F.lit("simulated")
    else:
        df = df.join(results.select("id", "success", "simulated", "executed"), "id", "left")
        done = (
            F.when(~F.coalesce(F.col("success"), F.lit(False)), "execution_failed")
            .when(F.col("simulated"), "simulated")
            .when(F.col("executed"), "executed")
            .otherwise("completed")
        )
    outcome = (
        F.when(waiting, "approval_required")
        .when(~target_is_safe(), "blocked_by_safety")
        .when(refused, "execution_failed")
        .otherwise(done)
    )
    return df.withColumn("outcome", outcome)


def transition_log(decided: DataFrame) -> DataFrame:
    """Log rows of the actions whose status changed."""
    return decided.filter(~F.col("new_status").eqNullSafe(F.col("status"))).select(
        F.col("id").alias("action_id"),
        "incident_id",
        F.col("new_status").alias("event_type"),
        F.col("status").alias("previous_status"),
        "new_status",
    )


def creation_log(stored: DataFrame) -> DataFrame:
    """Log rows written when actions are stored: created, then approved where that holds."""
    created = F.struct(
        F.lit("created").alias("event_type"), F.lit(None).cast("string").alias("previous_status"), F.lit("pending").alias("new_status")
    )
    approved = F.struct(
        F.lit("approved").alias("event_type"), F.lit("pending").alias("previous_status"), F.lit("approved").alias("new_status")
    )
    events = F.when(F.col("approved"), F.array(created, approved)).otherwise(F.array(created))
    return stored.select("incident_id", "action_type", "target", F.inline(events))


def build_reports(
    incidents: DataFrame,
    groups: DataFrame,
    analyses: DataFrame,
    techniques: DataFrame,
    decisions: DataFrame,
    ml: DataFrame,
    traces: DataFrame,
    sources: DataFrame,
) -> DataFrame:
    """Final report rows: every stage joined to the incident that ran the workflow.

    ``incidents`` are the primaries with ``correlation_id``; ``groups`` their correlation
    summary; ``analyses`` (one per incident) carry the claimed technique already looked up
    in ``techniques``' columns; ``traces`` the stages each run went through, ``sources`` the knowledge it used; all joins are equi-joins on one row per key.
    """
    base = (
        incidents.withColumnRenamed("id", "incident_id")
        .join(groups, "correlation_id", "left")
        .join(analyses, "incident_id", "left")
        .join(techniques, "incident_id", "left")
        .join(ml, "incident_id", "left")
        .join(traces, "incident_id", "left")
        .join(sources, "incident_id", "left")
    )
    cases = respond(route_by_risk(route_by_approval(base, decisions)))
    needs = F.col("human_approval_required")
    actions = propose_actions(cases)
    return actions.select(
        "incident_id",
        F.coalesce(truthy(F.col("title")), F.lit("SOC Incident Report")).alias("title"),
        risk.attack_type(F.col("title"), F.col("description")).alias("attack_type"),
        F.coalesce("summary", F.lit("No summary available")).alias("summary"),
        F.coalesce("risk_level", norm(F.col("severity")), F.lit("unknown")).alias("risk_level"),
        F.coalesce("ml_status", F.lit("not_available")).alias("ml_status"),
        "ml_prediction",
        "ml_engine",
        "ml_is_anomaly",
        "ml_anomaly_score",
        "ml_probabilities",
        "thread_id",
        F.coalesce("agent_trace", F.array().cast("array<string>")).alias("agent_trace"),
        F.coalesce("rag_sources", F.array().cast("array<string>")).alias("rag_sources"),
        "technique_id",
        F.col("technique_name").alias("mitre_name"),
        F.coalesce("technique_valid", F.lit(False)).alias("mitre_valid"),
        "recommendation",
        "next_stage",
        needs.alias("human_approval_required"),
        F.when(~needs, "not_required").when(F.col("human_approved"), "approved").otherwise("rejected").alias("human_review_status"),
        F.when(needs, F.col("human_comment")).alias("human_comment"),
        "response_status",
        F.when(F.col("response_approved"), F.col("action_type")).alias("action_type"),
        F.when(F.col("response_approved"), F.col("target")).alias("action_target"),
        "correlation_id",
        F.coalesce("confidence", F.lit("single_source")).alias("correlation_confidence"),
        F.coalesce("correlated_incident_count", F.lit(0).cast("bigint")).alias("correlated_incident_count"),
        "sources",
    )
