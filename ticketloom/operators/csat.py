"""Satisfaction surveys: attribution to the bot, matching to tickets, weekly roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from .scale import latest_before, number_rows
from .segments import segment_value
from .weekly import by_definition


def _with_reply_and_note(surveys: DataFrame, messages: DataFrame) -> DataFrame:
    """Latest public outgoing reply and latest automatic note strictly before each survey."""
    replies = messages.where(~F.col("incoming") & ~F.col("private") & (F.col("source") != 6)).select(
        "ticket_id", "created_ts", "message_id", "author_id")
    notes = messages.where("is_autorep_note").select("ticket_id", "created_ts", "message_id")
    found = latest_before(surveys, replies, "ticket_id", "created_ts", "created_ts", ["author_id"], "message_id", "reply")
    return latest_before(found, notes, "ticket_id", "created_ts", "created_ts", [], "message_id", "note")


def survey_attribution(surveys: DataFrame, messages: DataFrame, bot_ids: tuple[int, ...]) -> DataFrame:
    """Each survey with its class: included, other_agent or null_agent.

    A survey without an agent belongs to the latest public reply strictly before it and counts only
    if the bot wrote that reply. An automatic private note after that reply and before the survey
    takes the survey out again; "any note in between" is the same as "the latest note before the
    survey is later than the reply", so no interval join is needed.
    """
    rows = _with_reply_and_note(surveys, messages)
    bot = F.coalesce(F.col("reply.author_id").isin(*bot_ids), F.lit(False))
    note = F.coalesce(F.col("note.ts") > F.col("reply.ts"), F.lit(False))
    named = F.col("agent_id").isNotNull()
    kind = (
        F.when(named & ~F.col("agent_id").isin(*bot_ids), "other_agent")
        .when(~named & (~bot | note), "null_agent")
        .when(named & note, "other_agent")
        .otherwise("included")
    )
    return rows.select(
        *surveys.columns, F.col("reply.tie").alias("reply_id"), F.col("reply.ts").alias("reply_ts"),
        F.col("reply.author_id").alias("reply_author"), bot.alias("after_bot"), note.alias("note_between"), kind.alias("attribution"))


def survey_autorep_exclusion(attributed: DataFrame) -> DataFrame:
    return attributed.where(~F.col("note_between"))


def fetch_stats(attributed: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("attribution") == k)
    stats = attributed.agg(
        F.count(F.lit(1)).alias("all_responses"), count("included").alias("included"), count("other_agent").alias("other_agent"),
        count("null_agent").alias("null_agent"))
    return stats.withColumn("identity_ok", F.col("all_responses") == F.col("included") + F.col("other_agent") + F.col("null_agent"))


def satisfaction_bucket(rows: DataFrame, scales: dict[str, dict[str, tuple[int, ...]]]) -> DataFrame:
    """(survey, token) to bucket; an unknown survey or token fails the job."""
    pairs = [(survey, int(token), bucket) for survey, scale in scales.items() for bucket, tokens in scale.items() for token in tokens]
    table = rows.sparkSession.createDataFrame(pairs, "__survey string, __token int, satisfaction_bucket string")
    joined = rows.join(table, (rows["survey_id"] == table["__survey"]) & (rows["rating"] == table["__token"]), "left")
    checked = F.coalesce(F.col("satisfaction_bucket"), F.raise_error(F.concat(
        F.lit("rating token is not approved for survey "), F.col("survey_id"))).cast("string"))
    return joined.withColumn("satisfaction_bucket", checked).drop("__survey", "__token")


def responses(rows: DataFrame, scales: dict) -> DataFrame:
    """Stored response: hashed key, bucket and redacted comment; the raw text is dropped before the first join."""
    redacted = rows.select("source_id", "ticket_id", "survey_id", "responded_ts", "rating", X.redact_comment(F.col("feedback")).alias("comment_redacted"))
    return satisfaction_bucket(redacted, scales).select(
        X.response_key(F.col("source_id")).alias("response_key"), "ticket_id", "survey_id", "responded_ts",
        F.col("rating").alias("rating_raw"), "satisfaction_bucket", "comment_redacted")


def csat_to_tickets(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Answers matched to tickets with a safe id; the cohort week is the ticket's, not the answer's."""
    keep = ["cohort_week", "is_weekend_start", "outcome", *[c for c in ("skill_set", "issue_category") if c in sessions.columns]]
    tickets = sessions.where(X.is_safe_ticket_id(F.col("session_id"))).select(F.col("session_id").alias("ticket_id"), *keep)
    return answers.join(tickets, "ticket_id")


def _latest_flag(matched: DataFrame) -> DataFrame:
    last = matched.groupBy("ticket_id").agg(F.max(F.struct("responded_ts", "response_key")).alias("__last"))
    joined = matched.join(last, "ticket_id")
    is_last = (F.col("responded_ts") == F.col("__last.responded_ts")) & (F.col("response_key") == F.col("__last.response_key"))
    return joined.withColumn("is_latest", is_last).drop("__last")


def latest_response(answers: DataFrame) -> DataFrame:
    last = F.max(F.struct("responded_ts", "response_key", "satisfaction_bucket")).alias("l")
    return answers.groupBy("ticket_id").agg(last).select("ticket_id", "l.*")


def _bucket_counts() -> list[Column]:
    return [F.sum("n").alias("ticket_count"), *[F.sum(F.when(F.col("satisfaction_bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in K.CSAT_BUCKETS]]


def csat_weekly(matched: DataFrame) -> DataFrame:
    """Bucket counts per week and dimension at ticket grain (latest answer) and response grain.

    Dimension "all" has the value "all". Counted at the finest grain first.
    """
    flagged = _latest_flag(matched)
    dims = F.explode(F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("outcome").alias("dimension"), F.col("outcome").alias("value")),
        F.struct(F.lit("skill").alias("dimension"), segment_value("skill").alias("value")),
        F.struct(F.lit("issue_category").alias("dimension"), segment_value("issue_category").alias("value")),
    ))
    grains = F.explode(F.array_compact(F.array(F.lit("response"), F.when(F.col("is_latest"), "ticket"))))
    spread = flagged.withColumn("grain", grains).select("cohort_week", "is_weekend_start", "satisfaction_bucket", "grain", dims.alias("d"))
    fine = spread.groupBy("cohort_week", "is_weekend_start", "grain", "d.dimension", "d.value", "satisfaction_bucket").agg(F.count(F.lit(1)).alias("n"))
    return by_definition(fine).groupBy("week_definition", "cohort_week", "grain", "dimension", "value").agg(*_bucket_counts())


def csat_rollup(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("week_definition", "grain", "dimension", "value").agg(*[F.sum(c).alias(c) for c in ("ticket_count", *K.CSAT_BUCKETS)])


def refuse_repeats(answers: DataFrame) -> DataFrame:
    """The answers as they are; a response key that comes twice fails the job when the rows are read."""
    counted = answers.groupBy("response_key").agg(F.count(F.lit(1)).alias("__times"))
    once = F.when(F.col("__times") == 1, F.col("response_key")).otherwise(F.raise_error(F.lit("response identity is duplicated")).cast("string"))
    return answers.join(counted, "response_key").withColumn("response_key", once).select(*answers.columns)


def feedback_entries(matched: DataFrame) -> DataFrame:
    """Comments numbered n of total per ticket, the last one marked. Every answer is numbered, equal ones
    too; only answers with a comment are shown."""
    # equal answers are told apart by their text, and copies of one row by nothing that shows
    order = ["responded_ts", "response_key", "comment_redacted"]
    ranked = number_rows(matched, ["ticket_id"], order, "response_number")
    totals = ranked.groupBy("ticket_id").agg(F.max("response_number").alias("response_total"))
    joined = ranked.where("comment_redacted is not null").join(totals, "ticket_id")
    return joined.select(
        "ticket_id", "cohort_week", "responded_ts", "satisfaction_bucket", "outcome", segment_value("skill").alias("skill"),
        segment_value("issue_category").alias("issue_category"), F.col("comment_redacted").alias("text"), "response_number", "response_total",
        (F.col("response_number") == F.col("response_total")).alias("is_latest_for_ticket"))


def csat_state(sessions: DataFrame, answers: DataFrame, fetched_weeks: list | None = None) -> DataFrame:
    """Latest bucket, "unrated", or null when the ticket's week was not read."""
    last = latest_response(answers).select(F.col("ticket_id").alias("session_id"), "satisfaction_bucket")
    joined = sessions.join(last, "session_id", "left")
    state = F.coalesce("satisfaction_bucket", F.lit("unrated"))
    if fetched_weeks is not None:
        state = F.when(F.col("cohort_week").isin(fetched_weeks), state)
    return joined.withColumn("csat_satisfaction", state).drop("satisfaction_bucket")
