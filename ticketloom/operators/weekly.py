"""Weekly cohort metrics, gates, period comparison and the headline tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import formats as N
from ..functions import timefns as T
from ..window import CohortWindow, ntz
from .scale import histogram_rank

WEEKLY_COLUMNS = (
    "cohort_week", "cohort_status", "total_tickets", "ai_first_count", "ai_first_rate", "ai_end_to_end_count",
    "ai_then_cs_count", "direct_cs_count", "unclassified_count", "reopen_7d_rate", "reopen_7d_denominator",
    "reopen_lifetime_rate", "ai_reply_p50", "ai_reply_p90", "ai_reply_max", "as_of", "week_definition", "has_data",
    "reopen_lifetime_numerator", "reopen_lifetime_denominator", "ai_reply_mean_ai_first", "gt4_turn_with_cs",
    "gt4_turn_without_cs", "max_replies_rule_fired",
)


def calendar(spark: SparkSession, window: CohortWindow) -> DataFrame:
    """Every reported (week_definition, week) with its status and maturity: at most a few hundred rows."""
    rows = [
        (definition, week, window.effective_status(week, status, definition), window.is_mature(week, definition))
        for definition in K.WEEK_DEFINITIONS
        for week, status in window.weeks
    ]
    return spark.createDataFrame(rows, "week_definition string, cohort_week date, cohort_status string, mature boolean")


def by_definition(df: DataFrame) -> DataFrame:
    """Each row once per week definition it belongs to."""
    kinds = F.array(F.lit("mon_sun"), F.when(~F.col("is_weekend_start"), "mon_fri"))
    return df.withColumn("week_definition", F.explode(F.array_compact(kinds)))


def _sums(sessions: DataFrame) -> dict[str, Column]:
    gt4 = F.col("turn_count") > 3
    rule = F.array_contains("guardrail_rules", "max_replies_exceeded") if "guardrail_rules" in sessions.columns else F.lit(False)
    ai = F.col("ai_first")
    return {
        "total_tickets": F.count(F.lit(1)),
        "ai_first_count": F.count_if(ai),
        **{f"{o}_count": F.count_if(F.col("outcome") == o) for o in K.OUTCOMES},
        "reopen_7d_numerator": F.coalesce(F.sum(F.when(ai, F.col("reopen_within_7d"))), F.lit(0)),
        "reopen_7d_count": F.count(F.when(ai, F.col("reopen_within_7d"))),
        "reopen_lifetime_numerator": F.coalesce(F.sum(F.when(ai, F.col("reopen_lifetime"))), F.lit(0)),
        "reopen_lifetime_denominator": F.count(F.when(ai, F.col("reopen_lifetime"))),
        "ai_first_replies": F.coalesce(F.sum(F.when(ai, F.col("ai_reply_count"))), F.lit(0)),
        "gt4_turn_with_cs": F.count_if(gt4 & F.col("transferred")),
        "gt4_turn_without_cs": F.count_if(gt4 & ~F.col("transferred")),
        "max_replies_rule_fired": F.count_if(rule),
        "weekend_start_count": F.count_if("is_weekend_start"),
        "control_numerator": F.coalesce(F.sum("control_reopen_within_7d"), F.lit(0)),
        "control_denominator": F.count("control_reopen_within_7d"),
    }


def reply_histogram(sessions: DataFrame) -> DataFrame:
    """Counts per (definition, week, reply count): the one shuffle of the weekly report.

    There are few distinct reply counts, so the rows are merged before the shuffle and a week that
    holds most tickets is no larger than any other. Percentiles are read off the counts.
    """
    sums = _sums(sessions)
    fine = sessions.groupBy("cohort_week", "is_weekend_start", "ai_reply_count").agg(*[c.alias(n) for n, c in sums.items()])
    return by_definition(fine).groupBy("week_definition", "cohort_week", "ai_reply_count").agg(
        *[F.sum(n).alias(n) for n in sums])


def weekly_totals(sessions: DataFrame) -> DataFrame:
    """Observed weeks only, all numerators and denominators."""
    hist = reply_histogram(sessions)
    week = W.partitionBy("week_definition", "cohort_week")
    upto = week.orderBy("ai_reply_count").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumns({"__cum": F.sum("total_tickets").over(upto), "__n": F.sum("total_tickets").over(week)})
    names = [c for c in hist.columns if c not in ("week_definition", "cohort_week", "ai_reply_count", "__cum", "__n")]
    return hist.groupBy("week_definition", "cohort_week").agg(
        *[F.sum(n).alias(n) for n in names],
        histogram_rank(0.5, F.col("__cum"), F.col("__n"), F.col("ai_reply_count")).alias("ai_reply_p50"),
        histogram_rank(0.9, F.col("__cum"), F.col("__n"), F.col("ai_reply_count")).alias("ai_reply_p90"),
        F.max("ai_reply_count").alias("ai_reply_max"),
    )


def _ratio(numerator: str, denominator: str) -> Column:
    return F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator))


def weekly_summary(sessions: DataFrame, window: CohortWindow) -> DataFrame:
    """Both week definitions, one row per reported week; weeks without tickets are rows too."""
    totals = weekly_totals(sessions)
    counts = [c for c in totals.columns if c not in ("week_definition", "cohort_week", "ai_reply_p50", "ai_reply_p90", "ai_reply_max")]
    joined = calendar(sessions.sparkSession, window).join(totals, ["week_definition", "cohort_week"], "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return joined.select(
        "week_definition", "cohort_week", "cohort_status",
        (F.col("total_tickets") > 0).alias("has_data"), "total_tickets", "ai_first_count",
        F.coalesce(_ratio("ai_first_count", "total_tickets"), F.lit(0.0)).alias("ai_first_rate"),
        *[f"{o}_count" for o in K.OUTCOMES],
        F.when(F.col("mature"), _ratio("reopen_7d_numerator", "reopen_7d_count")).alias("reopen_7d_rate"),
        F.when(F.col("mature"), F.col("reopen_7d_count")).alias("reopen_7d_denominator"),
        _ratio("reopen_lifetime_numerator", "reopen_lifetime_denominator").alias("reopen_lifetime_rate"),
        "reopen_lifetime_numerator", "reopen_lifetime_denominator",
        _ratio("ai_first_replies", "ai_first_count").alias("ai_reply_mean_ai_first"),
        "ai_reply_p50", "ai_reply_p90", "ai_reply_max", "gt4_turn_with_cs", "gt4_turn_without_cs", "max_replies_rule_fired",
        ntz(window.as_of_utc).alias("as_of"),
    )


def nearest_rank_by_week(sessions: DataFrame) -> DataFrame:
    return weekly_totals(sessions).select("week_definition", "cohort_week", "ai_reply_p50", "ai_reply_p90")


def structural_gate(selection: DataFrame) -> DataFrame:
    """One row: share of invalid sessions; the job is blocked above five percent, not at it."""
    counts = selection.agg(
        F.count_if(F.col("selection_group") == "eligible").alias("valid_sessions"),
        F.count_if(F.col("selection_group") == "invalid_keyed").alias("invalid_sessions"),
    )
    total = F.col("valid_sessions") + F.col("invalid_sessions")
    rate = F.when(total > 0, F.col("invalid_sessions") / total).otherwise(F.lit(0.0))
    blocked = rate > K.STRUCTURAL_LIMIT
    return counts.select(
        "valid_sessions", "invalid_sessions", rate.alias("structural_invalid_rate"), (~blocked).alias("core_allowed"),
        (~blocked).alias("business_allowed"), (~blocked).alias("tpe_allowed"), (~blocked).alias("guardrail_allowed"),
        F.when(blocked, "structural_invalid_rate_gt_5pct").otherwise("").alias("reasons"),
    )


def view_totals(sessions: DataFrame) -> DataFrame:
    """Totals per definition (cohort_week null) and per week, from one aggregate."""
    sums = _sums(sessions)
    fine = sessions.groupBy("cohort_week", "is_weekend_start").agg(*[c.alias(n) for n, c in sums.items()])
    spread = by_definition(fine)
    weekly = spread.groupBy("week_definition", "cohort_week").agg(*[F.sum(n).alias(n) for n in sums])
    total = spread.groupBy("week_definition").agg(F.lit(None).cast("date").alias("cohort_week"), *[F.sum(n).alias(n) for n in sums])
    both = weekly.unionByName(total)
    return both.select(
        "week_definition", "cohort_week", F.col("total_tickets").alias("eligible_ticket_count"),
        (F.col("ai_then_cs_count") + F.col("direct_cs_count")).alias("transfer_total"),
        (F.col("gt4_turn_with_cs") + F.col("gt4_turn_without_cs")).alias("gt4_turn_total"),
        "gt4_turn_with_cs", "gt4_turn_without_cs", "max_replies_rule_fired", "weekend_start_count",
        *[F.col(f"{o}_count").alias(o) for o in K.OUTCOMES],
        F.col("ai_first_count"), F.coalesce(_ratio("ai_first_count", "total_tickets"), F.lit(0.0)).alias("ai_first_rate"),
        F.col("reopen_lifetime_numerator"), F.col("reopen_lifetime_denominator"),
        F.col("reopen_7d_numerator"), F.col("reopen_7d_count").alias("reopen_7d_denominator"),
    )


def data_range(weekly: DataFrame) -> DataFrame:
    empty = F.array_sort(F.collect_list(F.when(~F.col("has_data"), F.col("cohort_week"))))
    return weekly.groupBy("week_definition").agg(
        F.min(F.when(F.col("has_data"), F.col("cohort_week"))).alias("first_week_with_data"),
        F.array_join(F.transform(empty, lambda d: d.cast("string")), ",").alias("weeks_without_data"),
    )


def _cutoff(window: CohortWindow) -> int:
    """Finished days of the running week."""
    return (window.as_of_local.date() - window.wtd_start).days if window.wtd_start else 0


def same_days_of_weeks(sessions: DataFrame, window: CohortWindow) -> DataFrame:
    """The weekly report with every week cut to the days that the running week has finished."""
    cutoff = _cutoff(window)
    sliced = sessions.where((F.datediff(T.local_date(F.col("turn0_ts")), "cohort_week") < F.lit(cutoff)))
    usable = [d for d, last in (("mon_sun", 7), ("mon_fri", 5)) if 0 < cutoff < last]
    return weekly_summary(sliced, window).where(F.col("week_definition").isin(usable or [""]))


def same_period(sessions: DataFrame, window: CohortWindow) -> DataFrame:
    """Running week against the same weekdays of up to four earlier complete weeks.

    No rows when the running week has no finished day, is already complete, or has under two
    comparison weeks.
    """
    cutoff = _cutoff(window)
    weekly = same_days_of_weeks(sessions, window)
    base = weekly.where("cohort_status = 'complete' and total_tickets > 0")
    newest = W.partitionBy("week_definition").orderBy(F.desc("cohort_week"))
    base = base.withColumn("__rn", F.row_number().over(newest)).where("__rn <= 4")
    baseline = base.groupBy("week_definition").agg(
        F.count(F.lit(1)).alias("weeks_used"), F.avg("ai_first_rate").alias("baseline_ai_first_rate"),
        F.avg("reopen_lifetime_rate").alias("baseline_reopen_lifetime_rate")).where("weeks_used >= 2")
    current = weekly.where("cohort_status = 'wtd'").select(
        "week_definition", "cohort_week", "total_tickets", "ai_first_count", "ai_first_rate", "reopen_lifetime_rate",
        "reopen_lifetime_numerator", "reopen_lifetime_denominator")
    return current.join(baseline, "week_definition").select(
        "*", F.lit(window.wtd_start).alias("running_week"), F.lit(cutoff).alias("cutoff_weekday"))


def latest_and_previous_week(weekly: DataFrame) -> DataFrame:
    """Last observed week and the last complete observed week before it."""
    seen = weekly.where("has_data")
    latest = seen.groupBy("week_definition").agg(F.max("cohort_week").alias("latest_week"))
    done = seen.where("cohort_status = 'complete'").select("week_definition", "cohort_week")
    joined = latest.join(done, "week_definition", "left")
    earlier = F.when(F.col("cohort_week") < F.col("latest_week"), F.col("cohort_week"))
    return joined.groupBy("week_definition", "latest_week").agg(F.max(earlier).alias("previous_week"))


def week_set_rollup(weekly: DataFrame, weeks: list) -> DataFrame:
    """Any set of observed weeks re-aggregated from mergeable parts."""
    chosen = weekly.where(F.col("has_data") & F.col("cohort_week").isin(weeks))
    returned = F.coalesce(F.round(F.col("reopen_7d_rate") * F.col("reopen_7d_denominator")), F.lit(0)).cast("bigint")
    total = F.sum("total_tickets")
    weekdays = weekly.where("week_definition = 'mon_fri'").select("cohort_week", F.col("total_tickets").alias("__weekday_tickets"))
    chosen = chosen.join(weekdays, "cohort_week", "left")
    weekend = F.greatest(F.lit(0), F.col("total_tickets") - F.coalesce("__weekday_tickets", "total_tickets"))
    return chosen.groupBy("week_definition").agg(
        total.alias("eligible_ticket_count"),
        F.sum(F.col("ai_then_cs_count") + F.col("direct_cs_count")).alias("transfer_total"),
        *[F.sum(f"{o}_count").alias(o) for o in K.OUTCOMES],
        F.sum("ai_first_count").alias("ai_first_count"),
        F.when(total > 0, F.sum("ai_first_count") / total).otherwise(F.lit(0.0)).alias("ai_first_rate"),
        F.sum("reopen_lifetime_numerator").alias("reopen_lifetime_numerator"),
        F.sum("reopen_lifetime_denominator").alias("reopen_lifetime_denominator"),
        F.sum(returned).alias("reopen_7d_numerator"),
        F.coalesce(F.sum("reopen_7d_denominator"), F.lit(0)).alias("reopen_7d_denominator"),
        F.sum("gt4_turn_with_cs").alias("gt4_turn_with_cs"), F.sum("gt4_turn_without_cs").alias("gt4_turn_without_cs"),
        F.sum("max_replies_rule_fired").alias("max_replies_rule_fired"),
        F.sum(F.when(F.col("week_definition") == "mon_fri", 0).otherwise(weekend)).alias("weekend_start_count"),
    )


def scope_row(weekly: DataFrame) -> DataFrame:
    """Latest observed week per definition, as the base of the headline tables."""
    latest = latest_and_previous_week(weekly)
    return weekly.join(latest.select("week_definition", F.col("latest_week").alias("cohort_week")), ["week_definition", "cohort_week"])


def kpi_delta(weekly: DataFrame, period: DataFrame) -> DataFrame:
    """Change of both headline rates, in points: running weeks against the same period of earlier
    weeks, complete ones against the previous complete week. Moves under half a point are flat."""
    now = scope_row(weekly).alias("w")
    marks = latest_and_previous_week(weekly).select("week_definition", "previous_week")
    prev = weekly.select("week_definition", F.col("cohort_week").alias("previous_week"), F.col("ai_first_rate").alias("prev_ai"),
                         F.col("reopen_lifetime_rate").alias("prev_reopen"))
    same = period.select("week_definition", F.col("ai_first_rate").alias("cur_ai"), F.col("reopen_lifetime_rate").alias("cur_reopen"),
                         "baseline_ai_first_rate", "baseline_reopen_lifetime_rate", "weeks_used")
    joined = now.join(marks, "week_definition").join(prev, ["week_definition", "previous_week"], "left").join(same, "week_definition", "left")
    running = F.col("cohort_status") == "wtd"
    usable = running & F.col("weeks_used").isNotNull()
    rows = F.explode(F.array(
        F.struct(F.lit("AI First").alias("metric"), F.when(running, F.col("cur_ai")).otherwise(F.col("ai_first_rate")).alias("cur"),
                 F.when(usable, F.col("baseline_ai_first_rate")).when(~running, F.col("prev_ai")).alias("base")),
        F.struct(F.lit("Reopen sau AI First").alias("metric"), F.when(running, F.col("cur_reopen")).otherwise(F.col("reopen_lifetime_rate")).alias("cur"),
                 F.when(usable, F.col("baseline_reopen_lifetime_rate")).when(~running, F.col("prev_reopen")).alias("base")),
    ))
    spread = joined.select("week_definition", "cohort_week", running.alias("running"), "weeks_used", rows.alias("r"))
    delta = F.col("r.cur") - F.col("r.base")
    points = F.abs(delta) * 100
    against = F.when(F.col("running"), F.concat(F.lit("trung bình cùng kỳ "), F.col("weeks_used").cast("string"), F.lit(" tuần trước"))).otherwise("tuần trước")
    flat = points < 0.5
    text = F.when(flat, F.concat(F.col("r.metric"), F.lit(" gần như không đổi so với "), against, F.lit("."))).otherwise(
        F.concat(F.col("r.metric"), F.when(delta > 0, " tăng ").otherwise(" giảm "), N.points_text(points), F.lit(" điểm so với "), against, F.lit(".")))
    move = F.when(delta.isNull(), None).when(flat, "flat").when(delta > 0, "up").otherwise("down")
    return spread.select("week_definition", "cohort_week", F.col("r.metric").alias("metric"), F.round(delta, 9).alias("delta"), move.alias("direction"), text.alias("sentence"))


def decision_ledger(weekly: DataFrame) -> DataFrame:
    """Four headline cells of the latest observed week with their shares."""
    week = scope_row(weekly)
    transfer = F.col("ai_then_cs_count") + F.col("direct_cs_count")
    total = F.col("total_tickets")
    tail = F.concat(F.lit(" trong "), N.count_text(total), F.lit(" ticket tuần này"))

    def cell(name: str, value: Column, text: Column, support: Column, tone: Column) -> Column:
        return F.struct(F.lit(name).alias("cell"), value.alias("value"), text.alias("value_text"), support.alias("support"), tone.alias("tone"))

    gt4 = F.col("gt4_turn_without_cs")
    num, den = F.col("reopen_lifetime_numerator"), F.col("reopen_lifetime_denominator")
    cells = F.explode(F.array(
        cell("ai_first", F.col("ai_first_count"), N.count_text(F.col("ai_first_count")),
             F.when(total > 0, F.concat(N.rate_text(F.col("ai_first_count") / total), tail)), F.lit("brand")),
        cell("transfer", transfer, N.count_text(transfer), F.when(total > 0, F.concat(N.rate_text(transfer / total), tail)), F.lit("neutral")),
        cell("reopen", num, F.concat(N.count_text(num), F.lit(" lần")),
             F.when(den > 0, F.concat(N.average_text(num / den), F.lit(" lần/ticket · "), N.count_text(den), F.lit(" ticket AI First"))),
             F.when(num > 0, "warning").otherwise("neutral")),
        cell("gt4", gt4, N.count_text(gt4), F.when((gt4 > 0) & (total > 0), F.concat(N.rate_text(gt4 / total), tail)),
             F.when(gt4 > 0, "critical").otherwise("neutral")),
    ))
    return week.select("week_definition", "cohort_week", cells.alias("c")).select("week_definition", "cohort_week", "c.*")


def attention_items(weekly: DataFrame, gate: DataFrame) -> DataFrame:
    """Alerts: tickets stuck beyond three turns, and a blocked structural gate."""
    week = scope_row(weekly)
    stuck = week.where("gt4_turn_without_cs > 0").select(
        "week_definition", F.lit("attention-gt4").alias("item"), F.lit("critical").alias("severity"),
        F.concat(N.count_text(F.col("gt4_turn_without_cs")), F.lit(" ticket có hơn 3 lượt xử lý mà chưa chuyển CS")).alias("headline"))
    kinds = F.explode(F.lit(list(K.WEEK_DEFINITIONS))).alias("week_definition")
    blocked = gate.where("not core_allowed").select(
        kinds, F.lit("attention-gate").alias("item"), F.lit("critical").alias("severity"),
        F.concat(N.rate_text(F.col("structural_invalid_rate")), F.lit(" bản ghi lỗi cấu trúc, vượt ngưỡng 5%")).alias("headline"))
    return stuck.unionByName(blocked)


def weekly_report_export(weekly: DataFrame) -> DataFrame:
    """Fourteen text columns; a week without tickets says so and shows dashes, never zeros."""
    empty = F.col("total_tickets") == 0
    days = F.when(F.col("week_definition") == "mon_fri", 4).otherwise(6)
    label = F.concat(N.week_range_text(F.col("cohort_week"), days), F.when(F.col("cohort_status") == "wtd", " (WTD)").otherwise(""))

    def cell(text: Column, name: str) -> Column:
        return F.when(empty, F.lit(N.DASH)).otherwise(text).alias(name)

    count = lambda c: N.count_text(F.col(c))
    return weekly.select(
        "week_definition", "cohort_week", label.alias("Tuần"),
        F.when(empty, "Không có dữ liệu").otherwise(count("total_tickets")).alias("Tổng ticket"),
        cell(count("ai_first_count"), "AI First"), cell(N.rate_text(F.col("ai_first_rate")), "Tỷ lệ AI First"),
        cell(count("ai_end_to_end_count"), "AI xử lý trọn"), cell(count("ai_then_cs_count"), "AI trả lời rồi chuyển CS"),
        cell(count("direct_cs_count"), "Chuyển CS ngay từ đầu"),
        cell(N.count_text(F.col("ai_then_cs_count") + F.col("direct_cs_count")), "Tổng chuyển CS"),
        cell(count("reopen_lifetime_numerator"), "Reopen sau AI First"), cell(N.rate_text(F.col("reopen_lifetime_rate")), "Tỷ lệ reopen"),
        cell(N.average_text(F.col("ai_reply_mean_ai_first")), "AI phản hồi/ticket TB"),
        cell(count("gt4_turn_with_cs"), ">3 lượt xử lý + CS"), cell(count("gt4_turn_without_cs"), ">3 lượt xử lý chưa chuyển"),
        cell(count("unclassified_count"), "Chưa phân loại"),
    )
