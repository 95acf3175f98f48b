"""Metrics as tall score rows with stable ids, and the acknowledgement check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timefns as T


def stable_score_id(project: str, analytics: str, taxonomy: str, subject: Column, name: Column) -> Column:
    return X.uuid5_url(F.concat_ws("|", F.lit(project), F.lit(analytics), F.lit(taxonomy), subject, name))


def event_id(score_id: Column, payload: Column) -> Column:
    """uuid5 over the score id and the hash of its canonical payload."""
    return X.uuid5_url(F.concat(score_id, F.lit("|"), F.sha2(payload, 256)))


def _item(name: str, text: Column | None, number: Column | None, kind: str) -> Column:
    return F.struct(
        F.lit(name).alias("name"), (text if text is not None else F.lit(None).cast("string")).alias("text_value"),
        (number.cast("double") if number is not None else F.lit(None).cast("double")).alias("number_value"), F.lit(kind).alias("data_type"))


def _finish(rows: DataFrame, project: str, analytics: str, taxonomy: str) -> DataFrame:
    """Adds ids to (subject, name, value ..., timestamp, environment, metadata) rows."""
    sid = stable_score_id(project, analytics, taxonomy, F.col("session_id"), F.col("name"))
    staged = rows.withColumn("id", sid)
    # Keys of the payload are in alphabetical order, as in canonical JSON.
    payload = F.to_json(F.struct(
        F.struct(F.col("data_type").alias("dataType"), "environment", "id", "metadata", "name", F.col("session_id").alias("sessionId"),
                 F.lit("API").alias("source"), F.col("text_value").alias("textValue"), F.col("number_value").alias("value")).alias("body"),
        T.utc_iso(F.col("score_ts")).alias("timestamp"), F.lit("score-create").alias("type")))
    return staged.withColumn("event_id", event_id(F.col("id"), payload)).withColumn("score_ts", F.col("score_ts"))


def session_scores(sessions: DataFrame, gate: DataFrame, project: str, analytics: str, taxonomy: str) -> DataFrame:
    """One row per ticket and metric; none at all when the structural gate is closed."""
    ai, transferred = F.col("ai_first"), F.col("transferred")
    normal = F.col("outcome").isin("ai_end_to_end", "ai_then_cs", "direct_cs")
    na = F.lit("not_applicable")
    items = F.array_compact(F.array(
        _item("ai_first", None, ai.cast("int"), "NUMERIC"), _item("ai_reply_count", None, F.col("ai_reply_count"), "NUMERIC"),
        _item("ticket_data_quality", F.col("data_quality"), None, "CATEGORICAL"),
        F.when(~ai & F.col("no_ai_first_reason").isNotNull(), _item("no_ai_first_reason", F.col("no_ai_first_reason"), None, "CATEGORICAL")),
        F.when(normal, _item("ticket_outcome", F.col("outcome"), None, "CATEGORICAL")),
        F.when(ai & F.col("reopen_lifetime").isNotNull(), _item("reopen_lifetime", None, F.col("reopen_lifetime"), "NUMERIC")),
        F.when(ai & F.col("reopen_within_7d").isNotNull(), _item("reopen_within_7d", None, F.col("reopen_within_7d"), "NUMERIC")),
        *[F.when(transferred, _item(n, na, None, "CATEGORICAL")) for n in ("transfer_business_category", "transfer_tpe_group", "transfer_guardrail_rule")]))
    metadata = F.map_filter(F.create_map(
        F.lit("analytics_version"), F.lit(analytics), F.lit("taxonomy_version"), F.lit(taxonomy), F.lit("session_id"), F.col("session_id"),
        F.lit("turn0_trace_id"), F.col("turn0_trace_id"), F.lit("turn0_timestamp"), T.utc_iso(F.col("turn0_ts")), F.lit("cohort_week"), F.col("cohort_week").cast("string"),
        F.lit("cohort_status"), F.col("cohort_status"), F.lit("first_transfer_trace_id"), F.col("first_transfer_trace_id"),
        F.lit("transfer_mode"), F.when(transferred & F.col("outcome").isin("direct_cs", "ai_then_cs"), F.col("outcome"))), lambda k, v: v.isNotNull())
    open_gate = gate.select("core_allowed").scalar()
    rows = sessions.where(open_gate).select("session_id", "score_ts", "environment", metadata.alias("metadata"), F.explode(items).alias("i"))
    return _finish(rows.select("session_id", "score_ts", "environment", "metadata", "i.*"), project, analytics, taxonomy)


def weekly_scores(weekly: DataFrame, gate: DataFrame, project: str, analytics: str, taxonomy: str) -> DataFrame:
    """One row per reported week and metric, rates with numerator and denominator."""
    rows = weekly.where(F.col("week_definition") == "mon_sun").where(gate.select("core_allowed").scalar())
    week = F.col("cohort_week").cast("string")
    seven = F.round(F.col("reopen_7d_rate") * F.col("reopen_7d_denominator"))
    life = F.round(F.col("reopen_lifetime_rate") * F.col("ai_first_count"))

    def item(name: str, value: str, numerator: Column | None = None, denominator: Column | None = None) -> Column:
        v, none = F.col(value), F.lit(None).cast("double")
        pair = [(numerator.cast("double") if numerator is not None else none), (denominator.cast("double") if denominator is not None else none)]
        return F.when(v.isNotNull(), F.struct(F.lit(f"weekly_cs_{name}").alias("name"), v.cast("double").alias("number_value"),
                                              pair[0].alias("numerator"), pair[1].alias("denominator")))

    count = F.col("ai_first_count")
    items = F.array_compact(F.array(
        item("total_tickets", "total_tickets"), item("ai_first_count", "ai_first_count"), item("ai_first_rate", "ai_first_rate", count, F.col("total_tickets")),
        *[item(f"{o}_count", f"{o}_count") for o in ("ai_end_to_end", "ai_then_cs", "direct_cs", "unclassified")],
        item("reopen_7d_rate", "reopen_7d_rate", seven, F.col("reopen_7d_denominator")), item("reopen_7d_denominator", "reopen_7d_denominator"),
        item("reopen_lifetime_rate", "reopen_lifetime_rate", life, count), item("ai_reply_p50", "ai_reply_p50"), item("ai_reply_p90", "ai_reply_p90"),
        item("ai_reply_max", "ai_reply_max")))
    maturity = F.when(F.col("reopen_7d_denominator").isNotNull(), "mature").otherwise("immature")
    spread = rows.select(week.alias("week"), "cohort_week", "cohort_status", maturity.alias("maturity"), "total_tickets", F.explode(items).alias("i")).select("*", "i.*")
    metadata = F.map_filter(F.create_map(
        F.lit("analytics_version"), F.lit(analytics), F.lit("taxonomy_version"), F.lit(taxonomy), F.lit("cohort_week"), F.col("week"), F.lit("cohort_status"), F.col("cohort_status"),
        F.lit("cohort_maturity"), F.col("maturity"), F.lit("session_count"), F.col("total_tickets").cast("string"), F.lit("numerator"), F.col("numerator").cast("bigint").cast("string"),
        F.lit("denominator"), F.col("denominator").cast("bigint").cast("string")), lambda k, v: v.isNotNull())
    flat = spread.select(
        F.concat(F.lit("weekly-cs-summary:"), "week").alias("session_id"), T.score_anchor(F.col("cohort_week")).alias("score_ts"), F.lit("default").alias("environment"),
        metadata.alias("metadata"), "name", F.lit(None).cast("string").alias("text_value"), "number_value", F.lit("NUMERIC").alias("data_type"), "numerator", "denominator")
    return _finish(flat, project, analytics, taxonomy)


def score_manifest(scores: DataFrame) -> DataFrame:
    """Manifest rows; `write_manifest` stores them as JSON lines."""
    return scores.select("id", "event_id", "name", "text_value", "number_value", "data_type", "session_id", T.utc_iso(F.col("score_ts")).alias("timestamp"), "environment", "metadata")


def write_manifest(scores: DataFrame, path: str) -> None:
    score_manifest(scores).write.mode("overwrite").json(path)


def acknowledge_check(requested: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Ids on one side only; the run is complete when there are none and counts agree."""
    a = requested.groupBy("id").agg(F.count(F.lit(1)).alias("requested"))
    b = acknowledged.groupBy("id").agg(F.count(F.lit(1)).alias("acknowledged"))
    joined = a.join(b, "id", "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("requested", "acknowledged")})
    return joined.where((F.col("requested") != 1) | (F.col("acknowledged") != 1))


def inventory_fingerprint(inventory: DataFrame, buckets: int = 4096) -> DataFrame:
    """Content hash of the inventory in two levels: one hash per id range, then one over those.

    Ids are split by hash, so no task holds the whole list; equal tables have equal fingerprints.
    """
    row = F.concat_ws("\u001f", "ticket_id", T.utc_iso(F.col("created_ts")))
    part = F.conv(F.substring(F.sha2("ticket_id", 256), 1, 8), 16, 10).cast("bigint") % buckets
    per_row = inventory.select(part.alias("part"), F.sha2(row, 256).alias("h"))
    # Row hashes are added as numbers, which needs no list per bucket and no order.
    pieces = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = per_row.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(pieces)])
    line = F.concat_ws("/", "part", "n", *[f"s{i}" for i in range(4)])
    listed = F.array_sort(F.collect_list(F.struct("part", line.alias("line"))))
    return sums.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), 256)).alias("fingerprint"), F.sum("n").alias("tickets"))
