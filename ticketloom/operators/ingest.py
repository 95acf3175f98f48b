"""Raw traces to validated, narrow trace rows; rejects; candidate sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import timefns as T
from ..functions import variants as V
from ..window import CohortWindow


def filter_ticket_traces(raw: DataFrame) -> DataFrame:
    return raw.where(V.string_at(F.col("input"), "$.source") == "ticket")


def _key() -> Column:
    return F.struct("turn", "ts", "trace_id")


def dedupe_traces(raw: DataFrame, sequence: str) -> DataFrame:
    """First copy of every id in ingest order; rows without an id all stay.

    Repeated ids are found on (id, sequence) alone and are few, so the anti join normally
    broadcasts them and payloads are not shuffled; Spark checks their size at run time.
    """
    ids = raw.where(F.col("id") != "").groupBy("id").agg(F.min(sequence).alias("__first"), F.count(F.lit(1)).alias("__n"))
    again = ids.where("__n > 1").select(F.col("id").alias("__id"), "__first")
    return raw.join(again, (F.col("id") == F.col("__id")) & (F.col(sequence) > F.col("__first")), "left_anti")


def payload_hash(*columns: str) -> Column:
    """Hash of the canonical JSON of the given columns (VARIANT objects keep their keys sorted)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def dedupe_traces_strict(raw: DataFrame, payload: Column, sequence: str) -> tuple[DataFrame, DataFrame]:
    """Identical copies of an id collapse, conflicting copies are all dropped and counted."""
    hashed = raw.where(F.col("id") != "").select("id", payload.alias("__hash"), F.col(sequence).alias("__seq"))
    groups = hashed.groupBy("id").agg(
        F.min("__hash").alias("lo"), F.max("__hash").alias("hi"), F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    again = groups.where("__n > 1").select(F.col("id").alias("__id"), "__first", (F.col("lo") != F.col("hi")).alias("__conflict"))
    surplus = (F.col("id") == F.col("__id")) & (F.col("__conflict") | (F.col(sequence) > F.col("__first")))
    kept = raw.join(again, surplus, "left_anti")
    collisions = groups.agg(F.count_if(F.col("lo") != F.col("hi")).alias("collision_count"))
    return kept, collisions


def normalize_traces(raw: DataFrame) -> DataFrame:
    """All rows typed, with the first failed check in `reason` (null for valid rows)."""
    metadata, payload = F.col("metadata"), F.col("input")
    turn_type = V.type_of(metadata, "$.turn")
    turn = F.when(turn_type == "BIGINT", F.try_variant_get(metadata, "$.turn", "int"))
    helpdesk = V.string_at(payload, K.HELPDESK_ID_PATH)
    ts = T.parse_aware_timestamp(F.col("timestamp"))
    typed = raw.select(
        F.when(F.col("id") != "", F.col("id")).alias("trace_id"),
        F.when(F.col("sessionId") != "", F.col("sessionId")).alias("session_id"),
        ts.alias("ts"),
        turn.alias("turn"),
        F.coalesce(F.col("environment"), F.lit("")).alias("environment"),
        "input",
        "output",
        *[c for c in ("latency",) if c in raw.columns],
        turn_type.alias("__turn_type"),
        helpdesk.alias("__helpdesk"),
    )
    reason = (
        F.when(F.col("ts").isNull(), "invalid_timestamp")
        .when(F.col("trace_id").isNull(), "missing_trace_id")
        .when(F.col("session_id").isNull(), "missing_session_id")
        .when(F.col("__turn_type").isNull() | (F.col("__turn_type") == "VOID"), "missing_turn")
        .when(F.col("turn").isNull() | (F.col("turn") < 0), "invalid_turn")
        .when((F.col("__helpdesk") != "") & (F.col("__helpdesk") != F.col("session_id")), K.MISMATCH_REASON)
    )
    return typed.withColumn("reason", reason).drop("__turn_type", "__helpdesk")


def valid_records(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNull()).drop("reason")


def quality_issues(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNotNull()).select("reason", "session_id", "trace_id", "ts")


def first_issue_per_session(issues: DataFrame) -> DataFrame:
    """One issue per session: lowest (reason, trace id, time)."""
    order = F.struct(
        "reason",
        F.coalesce("trace_id", F.lit("")).alias("trace_key"),
        F.when(F.col("ts").isNull(), F.lit("")).otherwise(T.utc_iso(F.col("ts"))).alias("ts_key"),
        "trace_id",
        "ts",
    )
    picked = issues.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.min(order).alias("k"))
    return picked.select("k.reason", "session_id", "k.trace_id", "k.ts")


def exclude_invalid_sessions(records: DataFrame, issues: DataFrame) -> DataFrame:
    """One bad trace quarantines its ticket."""
    bad = issues.where(F.col("session_id").isNotNull()).select("session_id").distinct()
    return records.join(bad, "session_id", "left_anti")


def select_candidates(records: DataFrame, issues: DataFrame, window: CohortWindow) -> DataFrame:
    """(session_id, selection_group) with invalid_keyed, eligible and pre_window_start sessions."""
    status = window.cohort_status(T.local_ts(F.col("ts")))
    in_scope = status != "out_of_scope"
    before = T.local_date(F.col("ts")) < F.lit(window.start)
    grouped = records.groupBy("session_id").agg(
        F.min(F.struct("turn", "ts", "trace_id", in_scope.alias("inside"), before.alias("before"))).alias("first"),
        F.count_if(in_scope).alias("inside_rows"),
    )
    group = F.when(F.col("first.before") & (F.col("inside_rows") > 0), "pre_window_start").when(
        F.col("first.inside"), "eligible"
    )
    bad = first_issue_per_session(issues).select("session_id")
    good = grouped.select("session_id", group.alias("selection_group")).where("selection_group is not null")
    good = good.join(bad, "session_id", "left_anti")
    return good.unionByName(bad.select("session_id", F.lit("invalid_keyed").alias("selection_group")))


def eligible_records(records: DataFrame, issues: DataFrame, window: CohortWindow) -> DataFrame:
    chosen = select_candidates(records, issues, window).where("selection_group = 'eligible'").select("session_id")
    return records.join(chosen, "session_id", "left_semi")


def model_arm(payload: Column) -> Column:
    """Model under test, only for ticket traces."""
    return F.when(V.string_at(payload, "$.source") == "ticket", V.filled_string_at(payload, "$.model_info.model_core"))
