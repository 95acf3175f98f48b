"""Queries: satisfaction, help desk, A/B comparison, ticket list."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import timefns as T
from ..operators import abtest, csat, explorer, helpdesk, segments, weekly
from ..session import new_folder
from ..sources import readers
from ..window import CohortWindow, ntz
from . import fixtures as Fx
from .oracle_base import sql
from .q_metrics import _SEG
from .registry import query

_MSG = """msg AS (
  SELECT conv_id, CAST(conv_id + 1 AS VARCHAR) AS ticket_id, conv_id * 1000 + turn + 1 AS message_id, role = 'user' AS incoming,
         role = 'assistant' AND length(text) % 5 = 0 AS note, role = 'assistant' AND length(text) % 5 <> 0 AS reply,
         CASE WHEN role = 'assistant' THEN [1001, 1001, 2001, 9001][length(text) % 4 + 1] END AS author_id,
         TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id + INTERVAL 1 MINUTE * (turn * 10) AS created_ts
  FROM conversations
), svy AS (
  SELECT conv_id AS survey_key, CAST(conv_id + 1 AS VARCHAR) AS ticket_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id + INTERVAL 35 MINUTE AS created_ts
  FROM (SELECT DISTINCT conv_id FROM conversations)
), att0 AS (
  SELECT s.*, (SELECT arg_max(m.message_id, (m.created_ts, m.message_id)) FROM msg m WHERE m.ticket_id = s.ticket_id AND m.reply AND m.created_ts < s.created_ts) AS reply_id FROM svy s
), att AS (
  SELECT a.survey_key, a.ticket_id, a.created_ts, a.reply_id, r.created_ts AS reply_ts, r.author_id AS reply_author, coalesce(r.author_id = 1001, false) AS after_bot,
         r.created_ts IS NOT NULL AND EXISTS (SELECT 1 FROM msg n WHERE n.ticket_id = a.ticket_id AND n.note AND n.created_ts > r.created_ts AND n.created_ts < a.created_ts) AS note_between
  FROM att0 a LEFT JOIN msg r ON r.message_id = a.reply_id
), attc AS (SELECT *, CASE WHEN NOT after_bot OR note_between THEN 'null_agent' ELSE 'included' END AS attribution FROM att),
hum AS (
  SELECT ticket_id, min((created_ts, message_id)) FILTER (author_id = 1001) AS first_bot FROM msg WHERE reply GROUP BY 1
), hra AS (
  SELECT h.ticket_id, first_bot IS NOT NULL AS has_bot, CASE WHEN first_bot IS NULL THEN NULL
    WHEN EXISTS (SELECT 1 FROM msg m WHERE m.ticket_id = h.ticket_id AND m.reply AND m.author_id = 2001 AND (m.created_ts, m.message_id) > h.first_bot) THEN true
    WHEN EXISTS (SELECT 1 FROM msg m WHERE m.ticket_id = h.ticket_id AND m.reply AND m.author_id = 9001 AND (m.created_ts, m.message_id) > h.first_bot) THEN NULL
    ELSE false END AS human_replied_after_ai FROM hum h
)"""


@Fx.plan_once
def safe_messages(spark, d):
    return readers.read_conversations(Fx.messages(spark, d))


@Fx.plan_once
def attributed(spark, d):
    return csat.survey_attribution(Fx.surveys(spark, d), safe_messages(spark, d), Fx.ROSTER["bot"])


@query("survey_attribution", sql("SELECT survey_key, ticket_id, reply_id, reply_ts, reply_author, after_bot, attribution FROM attc", _MSG))
def survey_attribution(spark, d):
    return attributed(spark, d).select("survey_key", "ticket_id", "reply_id", "reply_ts", "reply_author", "after_bot", "attribution")


@query("survey_autorep_exclusion", sql("SELECT survey_key, reply_id FROM attc WHERE NOT note_between", _MSG))
def survey_autorep_exclusion(spark, d):
    return csat.survey_autorep_exclusion(attributed(spark, d)).select("survey_key", "reply_id")


@query("fetch_stats", sql("""SELECT count(*) AS all_responses, count(*) FILTER (attribution = 'included') AS included, 0 AS other_agent,
 count(*) FILTER (attribution = 'null_agent') AS null_agent, true AS identity_ok FROM attc""", _MSG))
def fetch_stats(spark, d):
    return csat.fetch_stats(attributed(spark, d))


_CSAT = f"""cs AS (
  SELECT concat('sha256:', sha256(CAST(doc_id AS VARCHAR))) AS response_key, CAST((doc_id % 150 + 1) * 100 + doc_id % 10 AS VARCHAR) AS ticket_id,
         TIMESTAMP '2024-01-02' + INTERVAL 1 HOUR * doc_id AS responded_ts, CASE WHEN toxic = 1 THEN -103 WHEN quality = 1 THEN 103 ELSE 100 END AS rating_raw,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS satisfaction_bucket
  FROM labels JOIN documents USING (doc_id)
), csm AS (SELECT c.*, s.cohort_week, s.is_weekend_start, s.outcome, s.skill_bucket, s.issue_category FROM cs c JOIN ens s ON s.session_id = c.ticket_id),
csl AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY responded_ts, response_key) AS rn, count(*) OVER (PARTITION BY ticket_id) AS total FROM csm),
csd AS (
  SELECT week_definition, cohort_week, g.grain, u.dimension, u.value, satisfaction_bucket
  FROM csl JOIN defs ON week_definition = 'mon_sun' OR NOT is_weekend_start, LATERAL (VALUES ('response'), ('ticket')) g(grain),
    LATERAL (VALUES ('all', 'all'), ('outcome', outcome), ('skill', skill_bucket), ('issue_category', issue_category)) u(dimension, value)
  WHERE g.grain = 'response' OR rn = total
), csw AS (
  SELECT week_definition, cohort_week, grain, dimension, value, count(*) AS ticket_count, count(*) FILTER (satisfaction_bucket = 'positive') AS positive,
         count(*) FILTER (satisfaction_bucket = 'neutral') AS neutral, count(*) FILTER (satisfaction_bucket = 'negative') AS negative FROM csd GROUP BY 1, 2, 3, 4, 5
)"""


@Fx.stored_once
def answers(spark, d):
    """Answers with their comment: texts are redacted once, not again for every pass of a report."""
    return csat.responses(Fx.csat(spark, d), Fx.AGENT_CONFIG)


@Fx.stored_once
def plain_answers(spark, d):
    """Answers without the comment, which most reports do not need: the text is never read."""
    rows = csat.satisfaction_bucket(Fx.csat(spark, d).drop("feedback"), Fx.AGENT_CONFIG)
    return rows.select(X.response_key(F.col("source_id")).alias("response_key"), "ticket_id", "responded_ts", F.col("rating").alias("rating_raw"), "satisfaction_bucket")


@Fx.plan_once
def matched(spark, d):
    return csat.csat_to_tickets(plain_answers(spark, d), Fx.enriched_sessions(spark, d))


@query("satisfaction_bucket", sql("SELECT response_key, ticket_id, responded_ts, rating_raw, satisfaction_bucket FROM cs", _CSAT))
def satisfaction_bucket(spark, d):
    return plain_answers(spark, d)


@query("response_key", sql("SELECT response_key FROM cs", _CSAT))
def response_key(spark, d):
    return Fx.csat(spark, d).select(X.response_key(F.col("source_id")).alias("response_key"))


@query("redact_comment")
def redact_comment(spark, d):
    return answers(spark, d).select("response_key", "comment_redacted")


@query("csat_to_tickets", sql("SELECT response_key, ticket_id, cohort_week, outcome FROM csm", _CSAT))
def csat_to_tickets(spark, d):
    return csat.csat_to_tickets(plain_answers(spark, d), Fx.sessions(spark, d)).select("response_key", "ticket_id", "cohort_week", "outcome")


@query("csat_weekly", sql("SELECT * FROM csw", _CSAT))
def csat_weekly(spark, d):
    return csat.csat_weekly(matched(spark, d))


@query("csat_rollup", sql("""SELECT week_definition, grain, dimension, value, sum(ticket_count) AS ticket_count, sum(positive) AS positive, sum(neutral) AS neutral, sum(negative) AS negative
 FROM csw GROUP BY 1, 2, 3, 4""", _CSAT))
def csat_rollup(spark, d):
    return csat.csat_rollup(csat.csat_weekly(matched(spark, d)))


@query("feedback_entries", sql("""SELECT ticket_id, responded_ts, satisfaction_bucket, outcome, skill_bucket AS skill, issue_category, cohort_week, rn AS response_number, total AS response_total,
 rn = total AS is_latest_for_ticket FROM csl""", _CSAT))
def feedback_entries(spark, d):
    rows = csat.csat_to_tickets(answers(spark, d), Fx.enriched_sessions(spark, d))
    return csat.feedback_entries(rows).drop("text")


_STATE = """cst AS (SELECT session_id, CASE WHEN cohort_week < DATE '2024-01-15' THEN NULL ELSE
 coalesce((SELECT arg_max(satisfaction_bucket, (responded_ts, response_key)) FROM cs WHERE cs.ticket_id = ens.session_id), 'unrated') END AS csat_satisfaction FROM ens)"""
_FETCHED = [date(2024, 1, 15), date(2024, 1, 22), date(2024, 1, 29)]


@query("csat_state", sql("SELECT * FROM cst", _CSAT, _STATE))
def csat_state(spark, d):
    return csat.csat_state(Fx.sessions(spark, d), plain_answers(spark, d), _FETCHED).select("session_id", "csat_satisfaction")


# ---- help desk ----------------------------------------------------------------------------


@query("is_public_agent_reply", sql("SELECT message_id FROM msg WHERE reply", _MSG))
def is_public_agent_reply(spark, d):
    return safe_messages(spark, d).where(helpdesk.is_public_reply()).select("message_id")


@query("human_reply_after_bot", sql("SELECT * FROM hra", _MSG))
def human_reply_after_bot(spark, d):
    return helpdesk.human_reply_after_bot(safe_messages(spark, d), Fx.ROSTER)


@Fx.plan_once
def records(spark, d):
    """Help-desk record per session: the conversation numbered like the session's last digit."""
    state = helpdesk.human_reply_after_bot(safe_messages(spark, d), Fx.ROSTER)
    ses = Fx.sessions(spark, d).where("cast(session_id as bigint) % 5 <> 0").select("session_id", "cohort_week", (F.col("session_id").cast("bigint") % 10 + 1).cast("string").alias("ticket_id"))
    return ses.join(state, "ticket_id").select(F.col("session_id").alias("ticket_id"), "cohort_week", "human_replied_after_ai")


_REC = """rec AS (SELECT s.session_id, s.cohort_week, h.human_replied_after_ai FROM ses s JOIN hra h ON h.ticket_id = CAST(CAST(s.session_id AS BIGINT) % 10 + 1 AS VARCHAR) WHERE CAST(s.session_id AS BIGINT) % 5 <> 0),
rcd AS (SELECT s.session_id, s.cohort_week, s.is_weekend_start, r.human_replied_after_ai, r.session_id IS NOT NULL AS matched FROM ses s LEFT JOIN rec r USING (session_id, cohort_week) WHERE s.outcome = 'ai_end_to_end')"""


@query("reconcile_outcome", sql("SELECT session_id, cohort_week, human_replied_after_ai, matched FROM rcd", _MSG, _REC))
def reconcile_outcome(spark, d):
    return helpdesk.reconcile_outcome(Fx.sessions(spark, d), records(spark, d)).drop("is_weekend_start")


# The help desk has been read for three weeks; one of them lies before the first ticket.
_READ = [date(2023, 12, 25), date(2024, 1, 8), date(2024, 1, 29)]
_AXIS = "axis AS (SELECT week_definition, w AS cohort_week FROM defs, (VALUES " + ", ".join(f"(DATE '{w}')" for w in _READ) + ") v(w))"


def _reported(spark):
    return weekly.calendar(spark, CohortWindow.build(Fx.AS_OF, 6))


def reconciled_weeks(spark, d):
    return helpdesk.reconciliation_weekly(helpdesk.reconcile_outcome(Fx.sessions(spark, d), records(spark, d)), _reported(spark), _READ)


@query("reconciliation_weekly", sql("""SELECT a.week_definition, a.cohort_week, count(r.session_id) AS ai_end_to_end, count(human_replied_after_ai) AS checked_ticket_count, count(*) FILTER (human_replied_after_ai) AS human_replied_after_ai,
 count(*) FILTER (matched AND human_replied_after_ai IS NULL) AS unresolved_ticket_count, count(*) FILTER (human_replied_after_ai) / nullif(count(human_replied_after_ai), 0) AS mismatch_rate
 FROM axis a LEFT JOIN rcd r ON r.cohort_week = a.cohort_week AND (week_definition = 'mon_sun' OR NOT is_weekend_start) GROUP BY 1, 2""", _MSG, _REC, _AXIS))
def reconciliation_weekly(spark, d):
    return reconciled_weeks(spark, d)


_COV = """inv0 AS (
  SELECT session_id AS ticket_id, turn0_ts AS created_ts, CAST(CAST(session_id AS BIGINT) % 10 + 1 AS VARCHAR) AS conversation_id FROM ses WHERE CAST(session_id AS BIGINT) % 5 <> 0
  UNION ALL SELECT CAST(conv_id + 900000 AS VARCHAR), TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id, CAST(conv_id + 1 AS VARCHAR) FROM (SELECT DISTINCT conv_id FROM conversations)
), auth AS (SELECT ticket_id, bool_or(author_id = 1001) AS b, bool_or(author_id = 2001) AS h, bool_or(author_id = 9001) AS u FROM msg WHERE reply GROUP BY 1),
cov AS (
  SELECT i.ticket_id, i.created_ts AS opened_ts, CAST(date_trunc('week', i.created_ts + INTERVAL 7 HOUR) AS DATE) AS cohort_week, isodow(i.created_ts + INTERVAL 7 HOUR) >= 6 AS is_weekend_start,
         CASE WHEN s.session_id IS NOT NULL THEN CASE WHEN ai_first AND NOT transferred THEN 'ai_replied_only' WHEN ai_first THEN 'ai_replied_then_transferred' WHEN transferred THEN 'transferred_without_ai_reply' ELSE 'invoked_no_result' END
              WHEN coalesce(b, false) OR coalesce(u, false) THEN 'unresolved' ELSE 'not_observed_invoked' END AS status,
         CASE WHEN s.session_id IS NULL THEN CASE WHEN NOT (coalesce(b, false) OR coalesce(u, false)) THEN coalesce(h, false) END
              WHEN NOT ai_first AND NOT transferred THEN CASE WHEN coalesce(h, false) THEN true WHEN coalesce(u, false) THEN NULL ELSE false END END AS human_replied
  FROM inv0 i LEFT JOIN ses s ON s.session_id = i.ticket_id LEFT JOIN auth a ON a.ticket_id = i.conversation_id
)"""


@Fx.plan_once
def coverage(spark, d):
    ses = Fx.sessions(spark, d)
    return helpdesk.classify_entry_coverage(Fx.inventory(spark, d, ses), ses, safe_messages(spark, d), Fx.ROSTER, "conversation_id")


@query("classify_entry_coverage", sql("SELECT * FROM cov", _MSG, _COV))
def classify_entry_coverage(spark, d):
    return coverage(spark, d)


def covered_weeks(spark, d):
    return helpdesk.entry_coverage_weekly(coverage(spark, d), _reported(spark), _READ)


@query("entry_coverage_weekly", sql(f"""SELECT a.week_definition, a.cohort_week, count(c.ticket_id) AS ticket_count, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in K.ENTRY_STATUSES)},
 count(*) FILTER (status = 'not_observed_invoked' AND human_replied) AS not_observed_human_replied, count(*) FILTER (status = 'not_observed_invoked' AND NOT human_replied) AS not_observed_no_human_reply
 FROM axis a LEFT JOIN cov c ON c.cohort_week = a.cohort_week AND (week_definition = 'mon_sun' OR NOT is_weekend_start) GROUP BY 1, 2""", _MSG, _COV, _AXIS))
def entry_coverage_weekly(spark, d):
    return covered_weeks(spark, d)


@query("entry_coverage_page", sql("""SELECT ticket_id, opened_ts, status, row_number() OVER (ORDER BY opened_ts DESC, CAST(ticket_id AS HUGEINT) DESC) AS position, count(*) OVER () AS total
 FROM cov WHERE NOT is_weekend_start AND status = 'unresolved' QUALIFY position BETWEEN 11 AND 20""", _MSG, _COV))
def entry_coverage_page(spark, d):
    order = helpdesk.entry_coverage_order(coverage(spark, d), new_folder(spark, "entry-order"), "mon_fri", status="unresolved")
    return helpdesk.entry_coverage_page(order, 2, 10).select("ticket_id", "opened_ts", "status", "position", "total")


@query("looks_like_person")
def looks_like_person(spark, d):
    rows = Fx.texts(spark, d).select("id", F.explode(F.split("text", r"\n")).alias("name"))
    return rows.select("id", "name", X.looks_like_person(F.col("name")).alias("is_person")).groupBy("id").agg(F.count_if("is_person").alias("person_lines"), F.count(F.lit(1)).alias("lines"))


_ROSTER = """ros AS (SELECT DISTINCT author_id AS agent_id, CASE WHEN author_id = 1001 THEN 'bot' WHEN author_id = 2001 THEN 'human' ELSE 'excluded' END AS agent_group FROM msg WHERE author_id IS NOT NULL
 UNION ALL SELECT DISTINCT author_id, 'human' FROM msg WHERE author_id = 9001)"""


@query("roster_overlaps", sql("SELECT agent_id, count(DISTINCT agent_group) AS groups, min(agent_group) AS first_group FROM ros GROUP BY 1 HAVING count(DISTINCT agent_group) > 1", _MSG, _ROSTER))
def roster_overlaps(spark, d):
    authors = safe_messages(spark, d).where("author_id is not null").select(F.col("author_id").alias("agent_id")).distinct()
    group = F.when(F.col("agent_id") == 1001, "bot").when(F.col("agent_id") == 2001, "human").otherwise("excluded")
    rows = authors.select("agent_id", group.alias("agent_group"))
    return helpdesk.roster_overlaps(rows.unionByName(authors.where("agent_id = 9001").select("agent_id", F.lit("human").alias("agent_group"))))


# ---- A/B ----------------------------------------------------------------------------------

_LLM = """lc AS (SELECT event_id, CASE WHEN user_id % 11 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END END AS model, ts,
 CAST(k AS BIGINT) * 10 AS total_tokens, CAST(k AS BIGINT) * 7 AS input_tokens, CAST(k AS BIGINT) * 3 AS output_tokens, value * 1000 AS latency_ms FROM ev)"""
_ROLL = """count(*) AS call_count, sum(total_tokens) AS total_tokens, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
 quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95"""


@query("metrics_rollup", sql(f"SELECT model, {_ROLL} FROM lc WHERE model IS NOT NULL GROUP BY 1", _LLM))
def metrics_rollup(spark, d):
    return abtest.metrics_rollup(Fx.llm_calls(spark, d), ["model"])


@query("metrics_rollup_hourly", sql(f"SELECT model, date_trunc('hour', ts) AS bucket, {_ROLL} FROM lc WHERE model IS NOT NULL GROUP BY 1, 2", _LLM))
def metrics_rollup_hourly(spark, d):
    return abtest.metrics_rollup(Fx.llm_calls(spark, d), ["model"], "hour")


_FACTS = """lat AS (SELECT session_id, CAST(sum(CAST(latency AS DECIMAL(18,6))) FILTER (latency >= 0) AS DOUBLE) AS latency FROM tr GROUP BY 1),
fct AS (
  SELECT e.session_id AS ticket_id, e.model_core AS arm, e.turn0_ts, e.outcome, e.ai_first, e.transferred, e.reopen_lifetime, e.turn_count, l.latency, e.issue_category, e.app, e.product_code,
         coalesce(e.skill, 'unknown') AS skill, coalesce(e.intent, 'unknown') AS intent
  FROM ens e JOIN lat l USING (session_id) WHERE e.model_core IS NOT NULL
), fsum AS (
  SELECT arm, count(*) AS ticket_count, count(*) FILTER (outcome = 'ai_end_to_end') AS ai_end_to_end, count(*) FILTER (outcome = 'ai_then_cs') AS ai_then_cs, count(*) FILTER (outcome = 'direct_cs') AS direct_cs,
         count(*) FILTER (outcome = 'unclassified') AS unclassified, count(*) FILTER (ai_first) AS ai_first_count, count(*) FILTER (transferred) AS transferred_count, coalesce(sum(reopen_lifetime), 0) AS reopen_count,
         count(reopen_lifetime) AS reopen_denominator, sum(turn_count) AS turn_total, quantile_disc(latency, 0.5) AS latency_p50, quantile_disc(latency, 0.95) AS latency_p95 FROM fct GROUP BY 1
), lsum AS (SELECT model AS arm, count(*) AS llm_call_count, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(total_tokens) AS total_tokens,
   quantile_disc(latency_ms, 0.5) / 1000 AS llm_latency_p50, quantile_disc(latency_ms, 0.95) / 1000 AS llm_latency_p95 FROM lc WHERE model IS NOT NULL GROUP BY 1),
lcs AS (SELECT ticket_id, arg_max(satisfaction_bucket, (responded_ts, response_key)) AS bucket FROM cs GROUP BY 1),
vot AS (SELECT f.arm, count(*) AS csat_response_count, count(*) FILTER (bucket = 'positive') AS csat_positive_count, count(*) FILTER (bucket = 'negative') AS csat_negative_count FROM fct f JOIN lcs USING (ticket_id) GROUP BY 1),
arms AS (
  SELECT a.arm, a.ord AS arm_order, coalesce(ticket_count, 0) AS ticket_count, coalesce(ai_end_to_end, 0) AS ai_end_to_end, coalesce(ai_then_cs, 0) AS ai_then_cs, coalesce(direct_cs, 0) AS direct_cs,
         coalesce(unclassified, 0) AS unclassified, coalesce(ai_first_count, 0) AS ai_first_count, coalesce(transferred_count, 0) AS transferred_count, coalesce(reopen_count, 0) AS reopen_count,
         coalesce(reopen_denominator, 0) AS reopen_denominator, coalesce(turn_total, 0) AS turn_total, latency_p50, latency_p95, coalesce(llm_call_count, 0) AS llm_call_count, coalesce(input_tokens, 0) AS input_tokens,
         coalesce(output_tokens, 0) AS output_tokens, coalesce(total_tokens, 0) AS total_tokens, llm_latency_p50, llm_latency_p95, coalesce(csat_response_count, 0) AS csat_response_count,
         coalesce(csat_positive_count, 0) AS csat_positive_count, coalesce(csat_negative_count, 0) AS csat_negative_count, coalesce(ticket_count, 0) / sum(ticket_count) OVER () AS share, coalesce(ticket_count, 0) < 30 AS low_sample
  FROM (VALUES (0, 'model-b'), (1, 'model-a'), (2, 'model-c')) a(ord, arm) LEFT JOIN fsum USING (arm) LEFT JOIN lsum USING (arm) LEFT JOIN vot USING (arm)
)"""
_ARMS = ["model-b", "model-a", "model-c"]


@Fx.stored_once
def facts(spark, d):
    signals = Fx.signals(spark, d).where("kind in ('intent', 'skill')")
    return abtest.ab_facts(Fx.traces(spark, d), signals, Fx.WINDOW, Fx.CARRY)


@Fx.plan_once
def arms(spark, d):
    return abtest.ab_arms(facts(spark, d), Fx.llm_calls(spark, d), csat.latest_response(plain_answers(spark, d)), _ARMS)


@query("ab_facts", sql("SELECT * FROM fct", _LLM, _CSAT, _FACTS))
def ab_facts(spark, d):
    return facts(spark, d)


@query("unmatched_tickets", sql("SELECT DISTINCT session_id FROM tr WHERE arm IS NULL"))
def unmatched_tickets(spark, d):
    return abtest.unmatched_tickets(Fx.traces(spark, d))


@query("ab_arms", sql("SELECT * FROM arms", _LLM, _CSAT, _FACTS))
def ab_arms(spark, d):
    return arms(spark, d)


_DAILY = """dcnt AS (
  SELECT CAST(turn0_ts + INTERVAL 7 HOUR AS DATE) AS date, arm, count(*) AS ticket_count, count(*) FILTER (outcome = 'ai_end_to_end') AS ai_end_to_end, count(*) FILTER (outcome = 'ai_then_cs') AS ai_then_cs,
         count(*) FILTER (outcome = 'direct_cs') AS direct_cs, count(*) FILTER (outcome = 'unclassified') AS unclassified, count(*) FILTER (ai_first) AS ai_first_count, count(*) FILTER (transferred) AS transferred_count,
         coalesce(sum(reopen_lifetime), 0) AS reopen_count, count(reopen_lifetime) AS reopen_denominator, sum(turn_count) AS turn_total, quantile_disc(latency, 0.5) AS latency_p50, quantile_disc(latency, 0.95) AS latency_p95
  FROM fct GROUP BY 1, 2
), dtok AS (SELECT CAST(date_trunc('hour', ts) + INTERVAL 7 HOUR AS DATE) AS date, model AS arm, sum(total_tokens) AS total_tokens, sum(output_tokens) AS output_tokens FROM lc WHERE model IS NOT NULL GROUP BY 1, 2),
day AS (
  SELECT date, arm, coalesce(ticket_count, 0) AS ticket_count, coalesce(ai_end_to_end, 0) AS ai_end_to_end, coalesce(ai_then_cs, 0) AS ai_then_cs, coalesce(direct_cs, 0) AS direct_cs, coalesce(unclassified, 0) AS unclassified,
         coalesce(ai_first_count, 0) AS ai_first_count, coalesce(transferred_count, 0) AS transferred_count, coalesce(reopen_count, 0) AS reopen_count, coalesce(reopen_denominator, 0) AS reopen_denominator,
         coalesce(turn_total, 0) AS turn_total, latency_p50, latency_p95, coalesce(total_tokens, 0) AS total_tokens, coalesce(output_tokens, 0) AS output_tokens
  FROM dcnt FULL OUTER JOIN dtok USING (date, arm)
)"""


@Fx.plan_once
def daily(spark, d):
    return abtest.ab_daily(facts(spark, d), Fx.llm_calls(spark, d))


@query("ab_daily", sql("SELECT * FROM day", _LLM, _CSAT, _FACTS, _DAILY))
def ab_daily(spark, d):
    return daily(spark, d)


@query("ab_dimensions", sql("""SELECT dimension, value, arm, ticket_count, ai_end_to_end FROM (
 SELECT u.dimension, u.value, arm, count(*) AS ticket_count, count(*) FILTER (outcome = 'ai_end_to_end') AS ai_end_to_end
 FROM fct, LATERAL (VALUES ('issue_category', issue_category), ('app', app), ('product_code', product_code), ('skill', skill), ('intent', intent)) u(dimension, value) GROUP BY 1, 2, 3)
 WHERE (dimension, value) IN (SELECT (dimension, value) FROM (SELECT u.dimension, u.value, row_number() OVER (PARTITION BY u.dimension ORDER BY count(*) DESC, u.value) AS rn
 FROM fct, LATERAL (VALUES ('issue_category', issue_category), ('app', app), ('product_code', product_code), ('skill', skill), ('intent', intent)) u(dimension, value) GROUP BY 1, 2) WHERE rn <= 8)""", _LLM, _CSAT, _FACTS))
def ab_dimensions(spark, d):
    return abtest.ab_dimensions(facts(spark, d))


def _metric_sql() -> str:
    rows = []
    for key, kind, direction, value, den, rule in abtest._METRICS:
        v = f"CAST({value} AS DOUBLE)"
        shown = v if rule == "value" else f"CASE WHEN {den} >= 20 THEN ({value}) / {den} END" if rule == "rate" else f"CASE WHEN {den} > 0 THEN ({value}) / {den} END"
        rows.append(f"('{key}', '{kind}', '{direction}', {shown}, {den})")
    return "mrow AS (SELECT arm, arm_order, u.* FROM arms, LATERAL (VALUES " + ", ".join(rows) + ") u(metric, kind, direction, value, denominator))"


@query("ab_metric_rows", sql("SELECT * FROM mrow", _LLM, _CSAT, _FACTS, _metric_sql()))
def ab_metric_rows(spark, d):
    return abtest.ab_metric_rows(arms(spark, d))


@query("ab_delta", sql("""SELECT metric, first_value, second_value, delta, CASE WHEN delta IS NULL OR direction = 'neutral' OR delta = 0 THEN NULL WHEN direction = 'higher' THEN delta > 0 ELSE delta < 0 END AS better
 FROM (SELECT a.metric, a.direction, a.value AS first_value, b.value AS second_value, CASE WHEN a.kind = 'rate' THEN b.value - a.value WHEN a.value <> 0 THEN (b.value - a.value) / a.value END AS delta
 FROM mrow a JOIN mrow b USING (metric) WHERE a.arm = 'model-b' AND b.arm = 'model-a')""", _LLM, _CSAT, _FACTS, _metric_sql()))
def ab_delta(spark, d):
    return abtest.ab_delta(abtest.ab_metric_rows(arms(spark, d)), "model-b", "model-a")


@query("ab_daily_series", sql("""SELECT g.date, g.arm, u.metric, u.value FROM (SELECT * FROM (SELECT DISTINCT date FROM day), (SELECT DISTINCT arm FROM day)) g LEFT JOIN day d USING (date, arm),
 LATERAL (VALUES ('ai_end_to_end', CASE WHEN ticket_count >= 10 THEN ai_end_to_end / ticket_count END), ('ai_first', CASE WHEN ticket_count >= 10 THEN ai_first_count / ticket_count END),
  ('transferred', CASE WHEN ticket_count >= 10 THEN transferred_count / ticket_count END), ('direct_cs', CASE WHEN ticket_count >= 10 THEN direct_cs / ticket_count END),
  ('reopen', CASE WHEN reopen_denominator >= 10 THEN reopen_count / reopen_denominator END), ('latency_p50', CASE WHEN ticket_count >= 10 THEN latency_p50 END), ('latency_p95', CASE WHEN ticket_count >= 10 THEN latency_p95 END),
  ('turns_per_ticket', CASE WHEN ticket_count >= 10 THEN turn_total / ticket_count END), ('tokens_per_ticket', CASE WHEN ticket_count >= 10 THEN total_tokens / ticket_count END),
  ('output_tokens_per_ticket', CASE WHEN ticket_count >= 10 THEN output_tokens / ticket_count END)) u(metric, value)""", _LLM, _CSAT, _FACTS, _DAILY))
def ab_daily_series(spark, d):
    return abtest.ab_daily_series(daily(spark, d))


@query("recent_models", sql("""SELECT arm, count(DISTINCT session_id) AS tickets FROM tr WHERE arm IS NOT NULL AND ts >= TIMESTAMP '2024-01-17 03:00:00' AND ts < TIMESTAMP '2024-01-31 03:00:00' GROUP BY 1"""))
def recent_models(spark, d):
    return abtest.recent_models(Fx.traces(spark, d), ntz(Fx.WINDOW.as_of_utc))


@query("first_seen", sql("""SELECT model, CASE WHEN h14 > TIMESTAMP '2024-01-17 03:00:00' + INTERVAL 26 HOUR THEN h14 ELSE h60 END AS first_seen, CASE WHEN h14 > TIMESTAMP '2024-01-17 03:00:00' + INTERVAL 26 HOUR THEN 14 ELSE 60 END AS lookback_days, true AS confirmed
 FROM (SELECT model, min(date_trunc('hour', ts)) FILTER (ts >= TIMESTAMP '2024-01-17 03:00:00') AS h14, min(date_trunc('hour', ts)) AS h60 FROM lc WHERE model IS NOT NULL GROUP BY 1)""", _LLM))
def first_seen(spark, d):
    return abtest.first_seen(Fx.llm_calls(spark, d), ntz(Fx.WINDOW.as_of_utc))


# ---- ticket list --------------------------------------------------------------------------

_TICKETS = f"""tk AS (
  SELECT session_id AS ticket_id, turn0_ts AS opened_ts, cohort_week, cohort_status, is_weekend_start, outcome, ai_first, transferred, reopen_lifetime, reopen_within_7d, ai_reply_count, turn_count, turn_count > 3 AS gt4_turn,
         issue_category, app, product_code, skill_bucket AS skill, safe_intent AS intent, transstatus AS tpe_code, CAST(NULL AS VARCHAR) AS tpe_status, guardrail_rule, CASE WHEN transferred THEN coalesce(trigger_reason, 'unknown') END AS transfer_reason,
         escalation_guard_blocked, csat_satisfaction, data_quality, model_core
  FROM ens JOIN cst USING (session_id)
)"""
_T = (_CSAT, _STATE, _TICKETS)


@Fx.plan_once
def tickets(spark, d):
    return explorer.ticket_projection(csat.csat_state(Fx.enriched_sessions(spark, d), plain_answers(spark, d), _FETCHED))


@query("ticket_projection", sql("SELECT * FROM tk", *_T))
def ticket_projection(spark, d):
    return tickets(spark, d)


def _allowed(spark, d):
    """What each value filter accepts: the values of the tickets and the visible segment labels."""
    seg = segments.segment_breakdown(Fx.enriched_sessions(spark, d), weekly.calendar(spark, Fx.WINDOW))
    return explorer.allowlists(tickets(spark, d), seg)


@query("ticket_filter", sql("""SELECT ticket_id FROM tk WHERE opened_ts + INTERVAL 7 HOUR >= TIMESTAMP '2024-01-08' AND opened_ts + INTERVAL 7 HOUR < TIMESTAMP '2024-01-27' AND outcome IN ('ai_end_to_end', 'ai_then_cs')
 AND coalesce(issue_category, 'Không xác định') IN ('Nạp tiền', 'Không xác định') AND gt4_turn AND NOT is_weekend_start""", *_T))
def ticket_filter(spark, d):
    return explorer.ticket_filter(
        tickets(spark, d), _allowed(spark, d), opened_from="2024-01-08", opened_to="2024-01-26", outcome="ai_end_to_end,ai_then_cs", issue_category="Nạp tiền,Không xác định",
        gt4_turn=True, week_definition="mon_fri").select("ticket_id")


#: Every filter once: its argument, and the same as SQL.
_FILTERS = {
    "cohort_week": ("2024-01-15", "cohort_week = DATE '2024-01-15'"), "cohort_weeks": ("2024-01-01,2024-01-22", "cohort_week IN (DATE '2024-01-01', DATE '2024-01-22')"),
    "opened_from": ("2024-01-20", "opened_ts + INTERVAL 7 HOUR >= TIMESTAMP '2024-01-20'"), "opened_to": ("2024-01-06", "opened_ts + INTERVAL 7 HOUR < TIMESTAMP '2024-01-07'"),
    "outcome": ("direct_cs,unclassified", "outcome IN ('direct_cs', 'unclassified')"), "ticket_id": ("901", "ticket_id = '901'"), "issue_category": ("Rút tiền", "issue_category = 'Rút tiền'"),
    "app": ("451 - app,454 - app", "app IN ('451 - app', '454 - app')"), "product_code": ("P2", "product_code = 'P2'"), "skill": (f"skill_1,{K.NO_SKILL}", f"coalesce(skill, '{K.NO_SKILL}') IN ('skill_1', '{K.NO_SKILL}')"),
    "tpe_code": (f"-365,{K.MISSING}", f"coalesce(tpe_code, '{K.MISSING}') IN ('-365', '{K.MISSING}')"), "model_core": ("model-a", "model_core = 'model-a'"), "intent": (K.OTHER_INTENT, f"intent = '{K.OTHER_INTENT}'"),
    "transfer_reason": ("unknown,ai_response_requires_transfer", "transfer_reason IN ('unknown', 'ai_response_requires_transfer')"), "csat_satisfaction": ("unrated,negative", "csat_satisfaction IN ('unrated', 'negative')"),
    "gt4_turn": (False, "NOT gt4_turn"), "transferred": (True, "transferred"), "is_weekend_start": (True, "is_weekend_start"), "week_definition": ("mon_fri", "NOT is_weekend_start"),
}


@query("ticket_filter_each", sql(" UNION ALL ".join(f"SELECT '{name}' AS filter, ticket_id FROM tk WHERE {where}" for name, (_, where) in _FILTERS.items()), *_T))
def ticket_filter_each(spark, d):
    rows, allowed = tickets(spark, d), _allowed(spark, d)
    allowed["intent"] = (*allowed["intent"], K.OTHER_INTENT)
    found = [explorer.ticket_filter(rows, allowed, **{name: value}).select(F.lit(name).alias("filter"), "ticket_id") for name, (value, _) in _FILTERS.items()]
    return reduce(DataFrame.unionByName, found)


@query("filter_allowlist", sql(f"SELECT DISTINCT value FROM (SELECT coalesce(tpe_code, '{K.MISSING}') AS value FROM tk UNION ALL SELECT label FROM segs WHERE dimension = 'tpe')", *_T, _SEG))
def filter_allowlist(spark, d):
    seg = segments.segment_breakdown(Fx.enriched_sessions(spark, d), weekly.calendar(spark, Fx.WINDOW))
    return explorer.filter_allowlist(tickets(spark, d), seg, "tpe_code")


@query("ticket_sort", sql("SELECT ticket_id, tpe_code, row_number() OVER (ORDER BY tpe_code IS NULL, CAST(tpe_code AS INT) DESC, CAST(ticket_id AS BIGINT)) AS position FROM tk", *_T))
def ticket_sort(spark, d):
    rows = tickets(spark, d).select("ticket_id", "tpe_code")
    return explorer.ticket_order(rows, new_folder(spark, "ticket-order"), "tpe_code", True).positions()


_PAGE_KEYS = "CASE csat_satisfaction WHEN 'negative' THEN 0 WHEN 'neutral' THEN 0 WHEN 'positive' THEN 0 WHEN 'unrated' THEN 1 ELSE 2 END, CASE csat_satisfaction WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END DESC, CASE WHEN csat_satisfaction IN ('negative', 'neutral', 'positive') THEN -CAST(ticket_id AS BIGINT) END, CAST(ticket_id AS BIGINT)"


def _by_satisfaction(spark, d):
    rows = tickets(spark, d).select("ticket_id", "csat_satisfaction")
    return explorer.ticket_order(rows, new_folder(spark, "ticket-order"), "csat_satisfaction", True)


@query("paginate", sql(f"SELECT ticket_id, csat_satisfaction, row_number() OVER (ORDER BY {_PAGE_KEYS}) AS position, count(*) OVER () AS total, 2 AS page, 25 AS page_size FROM tk QUALIFY position BETWEEN 26 AND 50", *_T))
def paginate(spark, d):
    return explorer.paginate(_by_satisfaction(spark, d), 2, 25)


@query("paginate_last", sql(f"""SELECT ticket_id, csat_satisfaction, row_number() OVER (ORDER BY {_PAGE_KEYS}) AS position, count(*) OVER () AS total, CAST((count(*) OVER () + 24) // 25 AS INTEGER) AS page, 25 AS page_size
 FROM tk QUALIFY position > (total - 1) // 25 * 25""", *_T))
def paginate_last(spark, d):
    order = _by_satisfaction(spark, d)
    return explorer.paginate(order, -(-order.total // 25), 25)


@query("paginate_after", sql(f"SELECT ticket_id, csat_satisfaction, row_number() OVER (ORDER BY {_PAGE_KEYS}) AS position FROM tk QUALIFY position BETWEEN 91 AND 130", *_T))
def paginate_after(spark, d):
    order = _by_satisfaction(spark, d)
    return order.after(order.key_at(90), 40)


@query("natural_sort_key", sql("SELECT session_id, app, CAST(dense_rank() OVER (ORDER BY app_code) AS INTEGER) AS place FROM ens"))
def natural_sort_key(spark, d):
    rows = Fx.sessions(spark, d).select("session_id", "app")
    apps = rows.select("app").distinct().select("app", X.natural_key(F.col("app")).alias("key"))
    return rows.join(apps.select("app", F.dense_rank().over(W.orderBy("key")).alias("place")), "app").select("session_id", "app", "place")


@query("table_sort")
def table_sort(spark, d):
    return explorer.table_sort(Fx.sessions(spark, d).select("session_id", "issue_category"), "issue_category")


@query("inspect_ticket", sql("""SELECT session_id, turn0_trace_id, cohort_week, cohort_status, ai_first, outcome, reopen_lifetime, reopen_within_7d, ai_reply_count, first_transfer_trace_id, data_quality, guardrail_rule
 FROM ens WHERE session_id = '901'"""))
def inspect_ticket(spark, d):
    return explorer.inspect_ticket(Fx.enriched_sessions(spark, d), "901")


@query("weekly_population", sql("SELECT cohort_week, ticket_id FROM tk WHERE cohort_week >= DATE '2024-01-22' AND outcome = 'ai_end_to_end'", *_T))
def weekly_population(spark, d):
    return explorer.weekly_population(tickets(spark, d), [w for w, _ in Fx.WINDOW.weeks], 2, "ai_end_to_end")


@query("sample_by_hash", sql("SELECT session_id FROM ses ORDER BY sha256(session_id), session_id LIMIT 25"))
def sample_by_hash(spark, d):
    return explorer.sample_by_hash(Fx.sessions(spark, d).select("session_id"), "session_id", 25)


@query("schema_sample", sql("SELECT ticket_id FROM tk WHERE cohort_week >= DATE '2024-01-22' ORDER BY sha256(ticket_id), ticket_id LIMIT 20", *_T))
def schema_sample(spark, d):
    rows = explorer.weekly_population(tickets(spark, d), [w for w, _ in Fx.WINDOW.weeks], 2)
    return explorer.sample_by_hash(rows.select("ticket_id"), "ticket_id", 20)
