"""How each ticket was handled. Everything is an associative aggregate over its traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import timefns as T
from ..functions import variants as V
from ..window import CohortWindow
from .scale import own_exchange, rank_rows


def is_transfer_response(response: Column, templates: tuple[str, ...] = K.TRANSFER_TEXTS) -> Column:
    """Normalised reply equals one of the approved, equally normalised templates."""
    approved = [X.normalized_template(t) for t in templates]
    return F.coalesce(X.normalize_transfer_text(response).isin(*approved), F.lit(False))


def is_malformed_output(output: Column) -> Column:
    return ~(V.is_object(output) & F.coalesce(V.type_of(output, "$.response") == "STRING", F.lit(False)))


def is_guardrail_or_system_only(output: Column, marker: Column) -> Column:
    """Blocked or violating output, the escalate marker, or only system agents at work."""
    agents_type = V.type_of(output, "$.agents_used")
    items = F.try_variant_get(output, "$.agents_used", "array<variant>")
    agents = V.strings_at(output, "$.agents_used")
    all_strings = (agents_type == "STRING") | (F.size(items) == F.size(agents))
    folded = F.transform(agents, lambda a: X.casefold(X.strip(X.nfkc(a))))
    system_only = (F.size(folded) > 0) & (F.size(F.array_except(folded, F.lit(list(K.SYSTEM_AGENTS)))) == 0)
    flagged = V.is_true(output, "$.blocked") | V.is_false(output, "$.passed") | V.is_truthy(output, "$.violation")
    return V.is_object(output) & F.coalesce(
        flagged | F.coalesce(marker == K.ESCALATE_MARKER, F.lit(False)) | F.coalesce(all_strings & system_only, F.lit(False)),
        F.lit(False),
    )


def output_flags(records: DataFrame, templates: tuple[str, ...] = K.TRANSFER_TEXTS) -> DataFrame:
    """Adds is_transfer, is_guardrail, is_malformed, is_ai; the payload can be dropped afterwards."""
    output = F.col("output")
    response = V.string_at(output, "$.response")
    staged = records.withColumn("__response", response)
    staged = staged.withColumn("__plain", X.normalize_transfer_text(F.col("__response")))
    approved = [X.normalized_template(t) for t in templates]
    staged = staged.withColumn("is_transfer", F.coalesce(F.col("__plain").isin(*approved), F.lit(False)))
    staged = staged.withColumn("is_guardrail", is_guardrail_or_system_only(output, F.col("__plain")))
    staged = staged.withColumn("is_malformed", is_malformed_output(output))
    answered = F.col("__response").isNotNull() & ~X.is_blank(F.col("__response"))
    technical = F.coalesce(F.col("__plain").isin(*K.TECHNICAL_MARKERS), F.lit(False))
    is_ai = F.coalesce(answered & ~F.col("is_guardrail") & ~technical & ~F.col("is_transfer"), F.lit(False))
    return staged.withColumn("is_ai", is_ai).drop("__response", "__plain")


def output_quality(is_malformed: Column, is_guardrail: Column) -> Column:
    return F.when(is_malformed, "malformed_output").when(is_guardrail, "guardrail_rule").otherwise("empty_or_technical")


def trace_order(traces: DataFrame) -> DataFrame:
    """Canonical position of every trace in its session, by (turn, ts, id)."""
    return rank_rows(
        traces, ["session_id"], [F.col("turn"), F.date_trunc("day", "ts")],
        [F.col("turn"), F.col("ts"), F.col("trace_id")], "position",
    )


def first_trace(traces: DataFrame, *columns: str) -> DataFrame:
    rest = [c for c in columns if c not in ("turn", "ts", "trace_id")]
    best = F.min(F.struct("turn", "ts", "trace_id", *rest)).alias("first")
    return traces.groupBy("session_id").agg(best).select("session_id", "first.*")


def duplicate_turns(traces: DataFrame) -> DataFrame:
    """Sessions in which some turn number occurs more than once."""
    counts = traces.groupBy("session_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("session_id").agg(F.max(F.col("n") > 1).alias("has_duplicate_turn"))


def ticket_facts(traces: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One aggregation pass: first, last, first classifiable and first transfer trace, and counts.

    Counting how often the customer came back needs no ordered walk: every AI reply except one
    that closes the ticket is followed by exactly one return, hence total AI replies minus the
    last trace's own.
    """
    rest = [c for c in carry if c in traces.columns]
    classifiable = F.col("is_transfer") | F.col("is_ai")
    position = F.struct("turn", "ts", "trace_id")
    return traces.groupBy("session_id").agg(
        F.min(F.struct("turn", "ts", "trace_id", "environment", "is_malformed", "is_guardrail", *rest)).alias("first"),
        F.min(F.when(classifiable, F.struct("turn", "ts", "trace_id", "is_ai"))).alias("deciding"),
        F.max(F.struct("turn", "ts", "trace_id", "is_ai")).alias("last"),
        F.min(F.when(F.col("is_transfer"), position)).alias("transfer"),
        F.count_if("is_ai").alias("ai_reply_count"),
        F.count(F.lit(1)).alias("turn_count"),
        F.max("is_malformed").alias("any_malformed"),
        F.max(F.col("turn") == 0).alias("has_turn_zero"),
    )


def with_follow_ups(traces: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts plus `reopened` (a trace after the deciding one, within 168 hours of the first) and
    `has_duplicate_turn`.

    The traces are joined to one fact row per ticket. The join key is re-encoded, so both sides
    and the aggregate above have exchanges of their own and AQE may split a hot ticket. The fact
    row travels on with the ticket's first trace only.
    """
    marks = facts.select(
        own_exchange("session_id").alias("__key"), F.col("first.ts").alias("__t0"),
        F.when(F.col("deciding").isNotNull(), F.struct("deciding.turn", "deciding.ts", "deciding.trace_id")).alias("__k"),
        F.struct("*").alias("__facts"),
    )
    rows = traces.select(own_exchange("session_id").alias("__key"), "turn", "ts", "trace_id", "session_id")
    joined = rows.join(marks, "__key")
    here = F.struct("turn", "ts", "trace_id")
    hit = F.coalesce((here > F.col("__k")) & T.within_reopen_window(F.col("ts"), F.col("__t0")), F.lit(False))
    is_first = (F.col("trace_id") == F.col("__facts.first.trace_id")) & (F.col("ts") == F.col("__t0")) & (
        F.col("turn") == F.col("__facts.first.turn"))
    marked = joined.select("session_id", "turn", hit.alias("hit"), F.when(is_first, F.col("__facts")).alias("facts"))
    turns = marked.groupBy("session_id", "turn").agg(
        F.max("hit").alias("hit"), F.count(F.lit(1)).alias("n"), F.max("facts").alias("facts"))
    tickets = turns.groupBy("session_id").agg(
        F.max("facts").alias("f"), F.max("hit").alias("reopened"), F.max(F.col("n") > 1).alias("has_duplicate_turn"))
    return tickets.select("f.*", "reopened", "has_duplicate_turn")


def classify_sessions(traces: DataFrame, window: CohortWindow, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per ticket. `traces` holds flagged rows; `carry` columns come from the first trace."""
    joined = with_follow_ups(traces, ticket_facts(traces, carry))
    decided = F.col("deciding").isNotNull()
    ai_first = decided & F.coalesce(F.col("deciding.is_ai"), F.lit(False))
    transferred = F.col("transfer").isNotNull()
    outcome = (
        F.when(ai_first & transferred, "ai_then_cs")
        .when(ai_first, "ai_end_to_end")
        .when(decided, "direct_cs")
        .otherwise("unclassified")
    )
    first_quality = output_quality(F.col("first.is_malformed"), F.col("first.is_guardrail"))
    own = F.when(decided, "valid").when(first_quality == "guardrail_rule", "valid").otherwise(first_quality)
    quality = (
        F.when(F.col("has_duplicate_turn"), "duplicate_turn")
        .when(~F.col("has_turn_zero"), "no_turn_zero")
        .when(F.col("any_malformed"), "malformed_output")
        .otherwise(own)
    )
    reason = F.when(~decided, F.when(first_quality == "malformed_output", "unknown").otherwise(first_quality)).when(
        ~ai_first, "direct_cs"
    )
    ts = F.col("first.ts")
    week = T.cohort_week(ts)
    rest = [c for c in carry if c in traces.columns]
    return joined.select(
        "session_id",
        F.col("first.trace_id").alias("turn0_trace_id"),
        ts.alias("turn0_ts"),
        week.alias("cohort_week"),
        T.score_anchor(week).alias("score_ts"),
        window.cohort_status(T.local_ts(ts)).alias("cohort_status"),
        ai_first.alias("ai_first"),
        reason.alias("no_ai_first_reason"),
        outcome.alias("outcome"),
        F.when(ai_first, F.col("ai_reply_count") - F.col("last.is_ai").cast("int")).alias("reopen_lifetime"),
        F.when(ai_first, F.col("reopened").cast("int")).alias("reopen_within_7d"),
        "ai_reply_count",
        F.col("transfer.trace_id").alias("first_transfer_trace_id"),
        quality.alias("data_quality"),
        F.col("first.environment").alias("environment"),
        T.is_weekend_start(ts).alias("is_weekend_start"),
        "turn_count",
        transferred.alias("transferred"),
        F.when(outcome == "direct_cs", F.col("reopened").cast("int")).alias("control_reopen_within_7d"),
        *[F.col(f"first.{c}").alias(c) for c in rest],
    )
