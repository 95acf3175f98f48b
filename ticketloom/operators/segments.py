"""Breakdowns by ticket attribute, transfer diagnostics, coverage and privacy of intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from .enrich import resolve_tpe_status, skill_bucket, tpe_mapping, transfer_reason_code, unique_transstatus
from .weekly import by_definition


def project_intents(sessions: DataFrame) -> DataFrame:
    """Adds safe_intent: rare or unsafe labels become "other", a missing intent stays missing.

    The counts are one small row per label and are joined back; they are not a window over the
    label, so a label held by a third of all tickets is no problem.
    """
    safe = X.is_safe_intent(F.col("intent"))
    frequent = sessions.where(safe).groupBy("intent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= K.INTENT_MIN_COUNT)
    joined = sessions.join(frequent.select("intent", F.lit(True).alias("__frequent")), "intent", "left")
    value = F.when(F.col("intent").isNull() | (F.col("intent") == ""), None).when(F.col("__frequent"), F.col("intent")).otherwise(F.lit(K.OTHER_INTENT))
    return joined.withColumn("safe_intent", value).drop("__frequent")


def segment_value(name: str) -> Column:
    if name == "skill":
        return skill_bucket(F.col("skill_set"))
    if name == "intent":
        return X.safe_dimension(F.col("safe_intent"))
    if name == "tpe":
        return X.safe_dimension(unique_transstatus(F.col("tpe_signals")))
    return X.safe_dimension(F.col(name))


def segment_rows(sessions: DataFrame) -> DataFrame:
    """Finest grain (week, weekend flag, dimension, label): merged before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), segment_value(d).alias("label")) for d in K.SEGMENTS]))
    spread = sessions.select("cohort_week", "is_weekend_start", "ai_first", "transferred", "reopen_lifetime", pairs.alias("s"))
    return spread.groupBy("cohort_week", "is_weekend_start", "s.dimension", "s.label").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ai_first").alias("ai_first"),
        F.count_if("transferred").alias("transferred"), F.coalesce(F.sum("reopen_lifetime"), F.lit(0)).alias("reopen"))


def segment_breakdown(sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Overall (cohort_week null) and weekly buckets; the missing bucket is always present."""
    measures = ("total", "ai_first", "transferred", "reopen")
    fine = by_definition(segment_rows(project_intents(sessions)))
    names = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(K.NO_SKILL if d == "skill" else K.MISSING).alias("label")) for d in K.SEGMENTS]))
    weeks = calendar.select("week_definition", "cohort_week")
    grid = weeks.select("*", names.alias("s")).select("week_definition", "cohort_week", "s.*", *[F.lit(0).cast("bigint").alias(m) for m in measures])
    rows = fine.select("week_definition", "cohort_week", "dimension", "label", *measures).unionByName(grid)
    weekly = rows.groupBy("week_definition", "cohort_week", "dimension", "label").agg(*[F.sum(m).alias(m) for m in measures])
    total = weekly.groupBy("week_definition", "dimension", "label").agg(*[F.sum(m).alias(m) for m in measures])
    return weekly.unionByName(total.withColumn("cohort_week", F.lit(None).cast("date")))


# ---- transfer diagnostics -----------------------------------------------------------------


def trigger_grain(sessions: DataFrame) -> DataFrame:
    """Exclusive trigger of each transferred ticket; contradictory triggers become "unknown"."""
    rule, source, stage, skill, reason = (F.col(f"trigger_{c}") for c in ("rule", "source", "stage", "skill", "reason"))
    safe = X.safe_string(skill)
    is_skill = source == K.OBS_SKILL_GUARD
    good = (
        reason.isNotNull() & reason.isin(*[r for r in K.TRANSFER_REASONS if r != "unknown"]) & rule.isin(*K.GUARDRAIL_RULES)
        & source.isin(K.OBS_INPUT_GUARD, K.OBS_SKILL_GUARD, K.OBS_OUTPUT_GUARD)
        & F.when(is_skill, F.coalesce(stage.isin("input", "output"), F.lit(False))).otherwise(stage.isNull() & skill.isNull())
        & (skill.isNull() | safe.isNotNull()) & (reason == transfer_reason_code(rule, source, stage))
    )
    good = F.coalesce(good, F.lit(False))
    return sessions.withColumns({
        "reason": F.when(good, reason).otherwise("unknown"), "rule": F.when(good, rule), "source": F.when(good, source),
        "stage": F.when(good, stage), "trigger_skill_safe": F.when(good, safe)})


def _rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weekly counts plus the overall row (cohort_week null)."""
    weekly = by_definition(df).groupBy("week_definition", "cohort_week", *keys).agg(F.sum("count").alias("count"))
    total = weekly.groupBy("week_definition", *keys).agg(F.sum("count").alias("count"))
    return weekly.unionByName(total.withColumn("cohort_week", F.lit(None).cast("date")))


def transfer_triggers(sessions: DataFrame) -> DataFrame:
    rows = trigger_grain(sessions.where("transferred"))
    keys = ["reason", "rule", "source", "stage", "skill"]
    rows = rows.drop("skill").withColumnRenamed("trigger_skill_safe", "skill")
    return _rollup(rows.groupBy("cohort_week", "is_weekend_start", *keys).agg(F.count(F.lit(1)).alias("count")), keys)


def transfer_guardrails(sessions: DataFrame) -> DataFrame:
    """Overlapping rule counts: they do not add up to the transferred tickets."""
    rows = sessions.where("transferred").select("cohort_week", "is_weekend_start", F.explode(F.array_distinct("guardrail_rules")).alias("rule"))
    rows = rows.where(F.col("rule").isin(*K.GUARDRAIL_RULES))
    return _rollup(rows.groupBy("cohort_week", "is_weekend_start", "rule").agg(F.count(F.lit(1)).alias("count")), ["rule"])


def transfer_tpe(sessions: DataFrame) -> DataFrame:
    rows = sessions.where("transferred").select("cohort_week", "is_weekend_start", F.explode("tpe_signals").alias("p"))
    keys = ["transstatus", "step_result"]
    counts = _rollup(rows.groupBy("cohort_week", "is_weekend_start", "p.transstatus", "p.step_result").agg(F.count(F.lit(1)).alias("count")), keys)
    return resolve_tpe_status(counts, tpe_mapping(sessions.sparkSession))


def transfer_flags(sessions: DataFrame) -> DataFrame:
    """Denominator, tickets without any step result, and history-guard tickets."""
    step = F.exists("tpe_signals", lambda p: p["step_result"].isNotNull())
    rows = sessions.where("transferred").groupBy("cohort_week", "is_weekend_start").agg(
        F.count(F.lit(1)).alias("observed_transfer_denominator"), F.count_if(~step).alias("step_result_missing"),
        F.count_if("escalation_guard_blocked").alias("escalation_guard_blocked"))
    names = ["observed_transfer_denominator", "step_result_missing", "escalation_guard_blocked"]
    weekly = by_definition(rows).groupBy("week_definition", "cohort_week").agg(*[F.sum(n).alias(n) for n in names])
    total = weekly.groupBy("week_definition").agg(*[F.sum(n).alias(n) for n in names])
    return weekly.unionByName(total.withColumn("cohort_week", F.lit(None).cast("date")))


def tpe_option_label(tpe_rows: DataFrame) -> DataFrame:
    """Most frequent pair per code, or nothing when the code has several governed statuses."""
    grouped = tpe_rows.groupBy("transstatus").agg(
        F.min(F.struct((-F.col("count")).alias("c"), F.col("step_result").isNull().alias("n"), F.coalesce("step_result", F.lit("")).alias("s"),
                       "step_result", "status")).alias("b"),
        F.min("status").alias("lo"), F.max("status").alias("hi"))
    label = F.concat(F.coalesce("b.status", F.lit("Chưa phân loại")), F.lit(" ("), F.col("transstatus"), F.lit(" / "), F.coalesce("b.step_result", F.lit("—")), F.lit(")"))
    single = F.col("lo").isNull() | (F.col("lo") == F.col("hi"))
    return grouped.select("transstatus", F.when(single, label).alias("label"))


def coverage_rates(sessions: DataFrame) -> DataFrame:
    """Share of tickets that carry each attribute."""
    rows = project_intents(sessions).select(
        (segment_value("issue_category") != K.MISSING).alias("issue_category"), (segment_value("app") != K.MISSING).alias("app"),
        (F.size("tpe_signals") > 0).alias("tpe"), F.col("safe_intent").isNotNull().alias("intent"), (F.col("skill_count") > 0).alias("skill"))
    return rows.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in rows.columns])


def quality_label(value: Column) -> Column:
    return F.when(value.isin(*K.QUALITY_LABELS), value).otherwise(F.lit("unknown_quality_issue"))


def quality_rows(sessions: DataFrame, keyed: DataFrame, unkeyed: DataFrame) -> DataFrame:
    """Quality label of every session, quarantined session and unkeyed trace."""
    parts = [sessions.select(F.col("data_quality").alias("q")), keyed.select(F.col("reason").alias("q")), unkeyed.select(F.col("reason").alias("q"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(quality_label(F.col("q")).alias("quality"))


def quality_counts(sessions: DataFrame, keyed: DataFrame, unkeyed: DataFrame) -> DataFrame:
    return quality_rows(sessions, keyed, unkeyed).groupBy("quality").agg(F.count(F.lit(1)).alias("count"))
