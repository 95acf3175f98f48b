"""Help-desk messages against AI outcomes: human replies, reconciliation, entry coverage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import timefns as T
from .pages import OrderIndex, build_order_index
from .weekly import by_definition


def is_public_reply() -> Column:
    visible = ~F.col("incoming") & ~F.col("private") & (F.col("source") != 6)
    return F.coalesce(visible & (F.col("category").isNull() | (F.col("category") == 3)), F.lit(False))


def author_kind(roster: dict[str, tuple[int, ...]]) -> Column:
    """bot, human, excluded or unknown, from a roster small enough to be part of the plan."""
    author = F.col("author_id")
    kind = F.lit(None).cast("string")
    for name in ("bot", "human", "excluded"):
        if roster.get(name):
            kind = F.coalesce(kind, F.when(author.isin(*roster[name]), F.lit(name)))
    return F.coalesce(kind, F.lit("unknown"))


def roster_overlaps(roster: DataFrame) -> DataFrame:
    """Agents listed in more than one group: must be empty."""
    return roster.groupBy("agent_id").agg(F.count_distinct("agent_group").alias("groups"), F.min("agent_group").alias("first_group")).where("groups > 1")


def _reply_marks(messages: DataFrame, roster: dict) -> DataFrame:
    replies = messages.where(is_public_reply()).withColumn("kind", author_kind(roster))
    at = F.struct("created_ts", "message_id")
    when = lambda k: F.when(F.col("kind") == k, at)
    return replies.groupBy("ticket_id").agg(
        F.min(when("bot")).alias("first_bot"), F.max(when("human")).alias("last_human"), F.max(when("unknown")).alias("last_unknown"))


def human_reply_after_bot(messages: DataFrame, roster: dict) -> DataFrame:
    """true / false / null per ticket. "Any human after the first bot reply" is "the last human
    reply is later than the first bot reply", so one aggregate per ticket is enough."""
    marks = _reply_marks(messages, roster)
    state = (
        F.when(F.col("first_bot").isNull(), None)
        .when(F.col("last_human") > F.col("first_bot"), True)
        .when(F.col("last_unknown") > F.col("first_bot"), None)
        .otherwise(False)
    )
    return marks.select("ticket_id", F.col("first_bot").isNotNull().alias("has_bot"), state.alias("human_replied_after_ai"))


def _on_read_weeks(weekly: DataFrame, calendar: DataFrame, read_weeks: list[date], counts: list[str]) -> DataFrame:
    """One row for every reported week that the help desk has been read for, zeros included; unread weeks have none."""
    axis = calendar.where(F.col("cohort_week").isin(read_weeks)).select("week_definition", "cohort_week")
    return axis.join(weekly, ["week_definition", "cohort_week"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def reconcile_outcome(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """AI-only tickets with a safe id and their help-desk record, matched on ticket and cohort week."""
    population = sessions.where((F.col("outcome") == "ai_end_to_end") & X.is_safe_ticket_id(F.col("session_id"))).select("session_id", "cohort_week", "is_weekend_start")
    checked = records.select(F.col("ticket_id").alias("session_id"), "cohort_week", "human_replied_after_ai", F.lit(True).alias("__matched"))
    joined = population.join(checked, ["session_id", "cohort_week"], "left")
    return joined.withColumn("matched", F.coalesce("__matched", F.lit(False))).drop("__matched")


def reconciliation_weekly(reconciled: DataFrame, calendar: DataFrame, read_weeks: list[date]) -> DataFrame:
    value, matched = F.col("human_replied_after_ai"), F.col("matched")
    fine = reconciled.groupBy("cohort_week", "is_weekend_start").agg(
        F.count(F.lit(1)).alias("ai_end_to_end"), F.count("human_replied_after_ai").alias("checked_ticket_count"),
        F.count_if(value).alias("human_replied_after_ai"), F.count_if(matched & value.isNull()).alias("unresolved_ticket_count"))
    names = ["ai_end_to_end", "checked_ticket_count", "human_replied_after_ai", "unresolved_ticket_count"]
    weekly = by_definition(fine).groupBy("week_definition", "cohort_week").agg(*[F.sum(n).alias(n) for n in names])
    rate = F.when(F.col("checked_ticket_count") > 0, F.col("human_replied_after_ai") / F.col("checked_ticket_count"))
    return _on_read_weeks(weekly, calendar, read_weeks, names).withColumn("mismatch_rate", rate)


def classify_entry_coverage(inventory: DataFrame, tickets: DataFrame, messages: DataFrame, roster: dict, link: str = "ticket_id") -> DataFrame:
    """Six statuses per help-desk ticket. Messages are read only for tickets that need them.

    `link` names the inventory column that holds the message table's ticket id.
    """
    seen = tickets.select(F.col("session_id").alias("ticket_id"), "ai_first", "transferred", F.lit(True).alias("__seen"))
    base = inventory.join(seen, "ticket_id", "left")
    needs = F.col("__seen").isNull() | (~F.col("ai_first") & ~F.col("transferred"))
    wanted = base.where(needs).select(F.col(link).alias("ticket_id")).distinct()
    replies = messages.join(wanted, "ticket_id", "left_semi").where(is_public_reply()).withColumn("kind", author_kind(roster))
    marks = replies.groupBy(F.col("ticket_id").alias("__link")).agg(
        *[F.max(F.col("kind") == k).alias(f"has_{k}") for k in ("bot", "human", "unknown")])
    joined = base.join(marks, base[link] == marks["__link"], "left")
    has = {k: F.coalesce(f"has_{k}", F.lit(False)) for k in ("bot", "human", "unknown")}
    is_seen = F.col("__seen").isNotNull()
    status = (
        F.when(is_seen & F.col("ai_first") & ~F.col("transferred"), "ai_replied_only")
        .when(is_seen & F.col("ai_first"), "ai_replied_then_transferred")
        .when(is_seen & F.col("transferred"), "transferred_without_ai_reply")
        .when(is_seen, "invoked_no_result")
        .when(has["bot"] | has["unknown"], "unresolved")
        .otherwise("not_observed_invoked")
    )
    human = (
        F.when(status == "not_observed_invoked", has["human"])
        .when((status == "invoked_no_result") & has["human"], True)
        .when((status == "invoked_no_result") & ~has["unknown"], False)
    )
    return joined.select(
        "ticket_id", F.col("created_ts").alias("opened_ts"), T.cohort_week(F.col("created_ts")).alias("cohort_week"),
        T.is_weekend_start(F.col("created_ts")).alias("is_weekend_start"), status.alias("status"), human.alias("human_replied"))


def entry_coverage_weekly(records: DataFrame, calendar: DataFrame, read_weeks: list[date]) -> DataFrame:
    missed = F.col("status") == "not_observed_invoked"
    fine = records.groupBy("cohort_week", "is_weekend_start").agg(
        F.count(F.lit(1)).alias("ticket_count"), *[F.count_if(F.col("status") == s).alias(s) for s in K.ENTRY_STATUSES],
        F.count_if(missed & F.col("human_replied")).alias("not_observed_human_replied"),
        F.count_if(missed & ~F.col("human_replied")).alias("not_observed_no_human_reply"))
    names = [c for c in fine.columns if c not in ("cohort_week", "is_weekend_start")]
    weekly = by_definition(fine).groupBy("week_definition", "cohort_week").agg(*[F.sum(n).alias(n) for n in names])
    return _on_read_weeks(weekly, calendar, read_weeks, names)


def entry_coverage_order(records: DataFrame, path: str, definition: str = "mon_sun", weeks: list | None = None, status: str | None = None,
                         sort_by: str = "opened_ts", descending: bool = True) -> OrderIndex:
    """The stored order of the filtered help-desk tickets."""
    if definition not in K.WEEK_DEFINITIONS or sort_by not in ("opened_ts", "ticket_id"):
        raise ValueError("week definition or sort column is invalid")
    if status is not None and status not in K.ENTRY_STATUSES:
        raise ValueError("status is invalid")
    rows = records
    if weeks is not None:
        rows = rows.where(F.col("cohort_week").isin(weeks))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if definition == "mon_fri":
        rows = rows.where(~F.col("is_weekend_start"))
    number = F.col("ticket_id").cast("decimal(20,0)")
    keys = [F.col("opened_ts"), number] if sort_by == "opened_ts" else [number]
    return build_order_index(rows, [(k, descending) for k in keys], path)


def entry_coverage_page(order: OrderIndex, page: int = 1, page_size: int = 10) -> DataFrame:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page is invalid")
    return order.page(page, page_size)
