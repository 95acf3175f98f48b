"""Model A/B comparison on the same ticket classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import timefns as T
from ..window import CohortWindow
from .classify import classify_sessions
from .enrich import attach_enrichment
from .scale import nearest_rank

DIMENSIONS = ("issue_category", "app", "product_code", "skill", "intent")


def metrics_rollup(calls: DataFrame, dims: list[str], grain: str | None = None) -> DataFrame:
    """Counts, token sums and exact latency percentiles by model, optionally per hour."""
    rows = calls.where(F.col("model").isNotNull())
    keys = list(dims)
    if grain:
        rows = rows.withColumn("bucket", F.date_trunc(grain, "ts").cast("timestamp_ntz"))
        keys.append("bucket")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("call_count"), *[F.sum(c).alias(c) for c in ("total_tokens", "input_tokens", "output_tokens")])
    ranks = nearest_rank(rows, keys, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95})
    return sums.join(ranks, keys, "left")


def ab_facts(traces: DataFrame, signals: DataFrame, window: CohortWindow, carry: tuple[str, ...]) -> DataFrame:
    """Per ticket: arm of its earliest read trace, outcome, sum of valid latencies, dimensions.

    Traces are read in time order, so "first seen" is the lowest (ts, id). Latencies are summed as
    decimals: the result does not depend on the order of partial sums.
    """
    armed = traces.where(F.col("arm").isNotNull())
    base = attach_enrichment(classify_sessions(armed, window, carry), armed, signals)
    valid = F.when(F.col("latency") >= 0, F.col("latency").cast("decimal(18,6)"))
    extra = armed.groupBy("session_id").agg(F.min(F.struct("ts", "trace_id", "arm")).alias("a"), F.sum(valid).cast("double").alias("latency"))
    joined = base.join(extra.select("session_id", F.col("a.arm").alias("arm"), "latency"), "session_id")
    return joined.select(
        F.col("session_id").alias("ticket_id"), "arm", "turn0_ts", "outcome", "ai_first", "transferred", "reopen_lifetime", "turn_count", "latency",
        *[F.coalesce(F.when(F.col(d) != "", F.col(d)), F.lit("unknown")).alias(d) for d in DIMENSIONS])


def unmatched_tickets(traces: DataFrame) -> DataFrame:
    """Tickets none of whose traces names a model."""
    return traces.where(F.col("arm").isNull()).select("session_id").distinct().join(
        traces.where(F.col("arm").isNotNull()).select("session_id"), "session_id", "left_anti")


def _fact_sums() -> list[Column]:
    out = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("ticket_count"), *[F.count_if(out == o).alias(o) for o in K.OUTCOMES],
        F.count_if("ai_first").alias("ai_first_count"), F.count_if("transferred").alias("transferred_count"),
        F.coalesce(F.sum("reopen_lifetime"), F.lit(0)).alias("reopen_count"), F.count("reopen_lifetime").alias("reopen_denominator"),
        F.sum("turn_count").alias("turn_total"),
    ]


def ab_arms(facts: DataFrame, calls: DataFrame, answers: DataFrame | None = None, arms: list[str] | None = None) -> DataFrame:
    """One row per arm; a given arm list filters, orders and keeps empty arms."""
    if arms is not None:
        facts = facts.where(F.col("arm").isin(arms))
    metrics = facts.groupBy("arm").agg(*_fact_sums())
    if arms is not None:
        order = facts.sparkSession.createDataFrame(list(enumerate(arms)), "arm_order int, arm string")
    else:
        order = metrics.select("arm", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("arm")).alias("arm_order"))
    ranks = nearest_rank(facts, ["arm"], "latency", {"latency_p50": 0.5, "latency_p95": 0.95})
    llm = metrics_rollup(calls, ["model"]).select(
        F.col("model").alias("arm"), F.col("call_count").alias("llm_call_count"), "input_tokens", "output_tokens", "total_tokens",
        (F.col("latency_p50") / 1000).alias("llm_latency_p50"), (F.col("latency_p95") / 1000).alias("llm_latency_p95"))
    joined = order.join(metrics, "arm", "left").join(ranks, "arm", "left").join(llm, "arm", "left")
    if answers is not None:
        votes = facts.select("ticket_id", "arm").join(answers.select("ticket_id", "satisfaction_bucket"), "ticket_id")
        votes = votes.groupBy("arm").agg(
            F.count(F.lit(1)).alias("csat_response_count"), F.count_if(F.col("satisfaction_bucket") == "positive").alias("csat_positive_count"),
            F.count_if(F.col("satisfaction_bucket") == "negative").alias("csat_negative_count"))
        joined = joined.join(votes, "arm", "left")
    else:
        joined = joined.withColumns({c: F.lit(0) for c in ("csat_response_count", "csat_positive_count", "csat_negative_count")})
    counts = [c for c in joined.columns if c not in ("arm", "arm_order") and "latency" not in c]
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    total = F.sum("ticket_count").over(W.partitionBy(F.lit(0)))
    return joined.withColumns({
        "share": F.when(total > 0, F.col("ticket_count") / total).otherwise(F.lit(0.0)),
        "low_sample": F.col("ticket_count") < K.MIN_ARM_SAMPLE})


def ab_daily(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """Per local day and arm: ticket metrics full-outer with tokens moved from UTC hours to local days."""
    days = facts.withColumn("date", T.local_date(F.col("turn0_ts")))
    counts = days.groupBy("date", "arm").agg(*_fact_sums())
    ranks = nearest_rank(days, ["date", "arm"], "latency", {"latency_p50": 0.5, "latency_p95": 0.95})
    hourly = calls.where(F.col("model").isNotNull()).groupBy("model", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("output_tokens").alias("output_tokens"))
    tokens = hourly.groupBy(T.local_date(F.col("hour")).alias("date"), F.col("model").alias("arm")).agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("output_tokens").alias("output_tokens"))
    joined = counts.join(ranks, ["date", "arm"], "left").join(tokens, ["date", "arm"], "full_outer")
    numbers = [c for c in joined.columns if c not in ("date", "arm", "latency_p50", "latency_p95")]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})


def ab_dimensions(facts: DataFrame) -> DataFrame:
    """Counts by value and arm for the eight most frequent values of each dimension."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]))
    spread = facts.select("arm", "outcome", pairs.alias("d"))
    counts = spread.groupBy("d.dimension", "d.value", "arm").agg(
        F.count(F.lit(1)).alias("ticket_count"), F.count_if(F.col("outcome") == "ai_end_to_end").alias("ai_end_to_end"))
    totals = counts.groupBy("dimension", "value").agg(F.sum("ticket_count").alias("n"))
    best = W.partitionBy("dimension").orderBy(F.desc("n"), F.asc("value"))
    top = totals.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= K.TOP_DIMENSION_VALUES).select("dimension", "value")
    return counts.join(top, ["dimension", "value"], "left_semi")


# Comparison rows as (key, kind, direction, numerator or value, denominator, rule).
_METRICS = (
    ("ticket_count", "number", "neutral", "ticket_count", "ticket_count", "value"),
    ("share", "rate", "neutral", "share", "ticket_count", "value"),
    ("ai_end_to_end", "rate", "higher", "ai_end_to_end", "ticket_count", "rate"),
    ("ai_first", "rate", "higher", "ai_first_count", "ticket_count", "rate"),
    ("transferred", "rate", "lower", "transferred_count", "ticket_count", "rate"),
    ("direct_cs", "rate", "lower", "direct_cs", "ticket_count", "rate"),
    ("reopen", "rate", "lower", "reopen_count", "reopen_denominator", "rate"),
    ("csat_positive", "rate", "higher", "csat_positive_count", "csat_response_count", "rate"),
    ("csat_neutral", "rate", "neutral", "csat_response_count - csat_positive_count - csat_negative_count", "csat_response_count", "rate"),
    ("csat_negative", "rate", "lower", "csat_negative_count", "csat_response_count", "rate"),
    ("latency_p50", "seconds", "lower", "latency_p50", "ticket_count", "value"),
    ("latency_p95", "seconds", "lower", "latency_p95", "ticket_count", "value"),
    ("llm_latency_p95", "seconds", "lower", "llm_latency_p95", "llm_call_count", "value"),
    ("llm_calls_per_ticket", "number", "lower", "llm_call_count", "ticket_count", "each"),
    ("tokens_per_ticket", "number", "lower", "total_tokens", "ticket_count", "each"),
    ("output_tokens_per_ticket", "number", "lower", "output_tokens", "ticket_count", "each"),
    ("turns_per_ticket", "number", "lower", "turn_total", "ticket_count", "each"),
)


def ab_metric_rows(arms: DataFrame) -> DataFrame:
    """Seventeen rows per arm; a rate is null below twenty samples."""
    items = []
    for key, kind, direction, value, den, rule in _METRICS:
        v, d = F.expr(value).cast("double"), F.col(den)
        shown = v if rule == "value" else F.when(d >= K.MIN_SHARE_SAMPLE, v / d) if rule == "rate" else F.when(d > 0, v / d)
        items.append(F.struct(F.lit(key).alias("metric"), F.lit(kind).alias("kind"), F.lit(direction).alias("direction"),
                              shown.alias("value"), d.cast("bigint").alias("denominator")))
    return arms.select("arm", "arm_order", F.explode(F.array(*items)).alias("m")).select("arm", "arm_order", "m.*")


def ab_delta(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Second arm against the first: points for rates, relative change otherwise."""
    a = rows.where(F.col("arm") == first).select("metric", "kind", "direction", F.col("value").alias("first_value"))
    b = rows.where(F.col("arm") == second).select("metric", F.col("value").alias("second_value"))
    joined = a.join(b, "metric")
    diff = F.col("second_value") - F.col("first_value")
    delta = F.when(F.col("kind") == "rate", diff).when(F.col("first_value") != 0, diff / F.col("first_value"))
    better = F.when((F.col("direction") == "neutral") | (delta == 0), None).when(F.col("direction") == "higher", delta > 0).otherwise(delta < 0)
    return joined.select("metric", "first_value", "second_value", delta.alias("delta"), F.when(delta.isNotNull(), better).alias("better"))


def ab_daily_series(daily: DataFrame) -> DataFrame:
    """Daily value per metric and arm on a gap-filled date axis; null under ten tickets."""
    tickets = F.col("ticket_count")
    rate = lambda c: F.when(tickets >= K.MIN_DAILY_SAMPLE, F.col(c) / tickets)
    enough = lambda c: F.when(tickets >= K.MIN_DAILY_SAMPLE, F.col(c))
    values = {
        "ai_end_to_end": rate("ai_end_to_end"), "ai_first": rate("ai_first_count"), "transferred": rate("transferred_count"),
        "direct_cs": rate("direct_cs"),
        "reopen": F.when(F.col("reopen_denominator") >= K.MIN_DAILY_SAMPLE, F.col("reopen_count") / F.col("reopen_denominator")),
        "latency_p50": enough("latency_p50"), "latency_p95": enough("latency_p95"), "turns_per_ticket": rate("turn_total"),
        "tokens_per_ticket": rate("total_tokens"), "output_tokens_per_ticket": rate("output_tokens"),
    }
    # Both axes come from an aggregated table: a few hundred days, a few arms.
    axes = daily.agg(F.collect_set("date").alias("dates"), F.collect_set("arm").alias("arms"))
    grid = axes.select(F.explode("dates").alias("date"), "arms").select("date", F.explode("arms").alias("arm"))
    filled = grid.join(daily, ["date", "arm"], "left")
    items = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])
    return filled.select("date", "arm", F.explode(items).alias("m")).select("date", "arm", "m.*")


def recent_models(traces: DataFrame, until: Column, days: int = 14) -> DataFrame:
    """Arms by distinct tickets in the last days, most active first."""
    recent = traces.where(F.col("arm").isNotNull() & (F.col("ts") >= until - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") < until))
    return recent.select("arm", "session_id").distinct().groupBy("arm").agg(F.count(F.lit(1)).alias("tickets")).orderBy(F.desc("tickets"), "arm")


LOOKBACKS = (14, 60, 180, 400)


def first_seen(calls: DataFrame, now: Column, margin_hours: int = 26) -> DataFrame:
    """Earliest hour per model over growing look-backs, from one scan.

    A hit too close to the edge of its look-back may be cut off, so the next one decides; the
    widest is final.
    """
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    edges = {d: now - F.make_dt_interval(days=F.lit(d)) for d in LOOKBACKS}
    rows = calls.where(F.col("model").isNotNull() & (F.col("ts") < now))
    # The reference clock is a literal, so every look-back is one conditional minimum.
    found = rows.groupBy("model").agg(*[F.min(F.when(F.col("ts") >= e, hour)).alias(f"h{d}") for d, e in edges.items()])
    answer = F.lit(None).cast("timestamp_ntz")
    used = F.lit(LOOKBACKS[-1])
    for d in reversed(LOOKBACKS):
        inside = F.col(f"h{d}") > edges[d] + F.make_dt_interval(hours=F.lit(margin_hours))
        if d == LOOKBACKS[-1]:
            answer = F.col(f"h{d}")
        else:
            answer = F.when(inside, F.col(f"h{d}")).otherwise(answer)
            used = F.when(inside, F.lit(d)).otherwise(used)
    return found.select("model", answer.alias("first_seen"), used.alias("lookback_days"), F.lit(True).alias("confirmed"))
