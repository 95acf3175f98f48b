"""Queries: scans, validation, classification, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import timefns as T
from ..functions import variants as V
from ..operators import classify, enrich, ingest
from ..session import new_folder
from ..sources import readers, reference
from ..window import CohortWindow
from . import fixtures as Fx
from .oracle_base import sql
from .registry import query, text_list

_SES_COLUMNS = """session_id, turn0_trace_id, turn0_ts, cohort_week, score_ts, cohort_status, ai_first, no_ai_first_reason, outcome, reopen_lifetime,
 reopen_within_7d, ai_reply_count, first_transfer_trace_id, data_quality, environment, is_weekend_start, turn_count, transferred, control_reopen_within_7d"""


@query("read_traces", sql("""SELECT trace_id, session_id, ts, turn, CAST(ts AS DATE) AS day FROM tr
 WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 12:00:00'"""))
def read_traces(spark, d):
    path = new_folder(spark, "traces")
    readers.write_traces(Fx.raw_traces(spark, d), path)
    rows = readers.read_traces(spark, path, "2024-01-08 00:00:00", "2024-01-15 12:00:00")
    return rows.select(F.col("id").alias("trace_id"), F.col("sessionId").alias("session_id"), "ts", F.try_variant_get("metadata", "$.turn", "int").alias("turn"), "day")


@query("read_traces_rejects", """SELECT event_id AS seq, event_id % 97 = 1 AS no_time FROM events WHERE event_id % 97 = 1 OR (ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00')
 UNION ALL SELECT event_id + 1000000000, event_id % 97 = 1 FROM events WHERE event_id % 89 = 0 AND (event_id % 97 = 1 OR (ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'))""")
def read_traces_rejects(spark, d):
    path = new_folder(spark, "traces")
    readers.write_traces(Fx.damaged_traces(spark, d), path)
    return readers.read_traces(spark, path, "2024-01-10 06:00:00", "2024-01-11 00:00:00").select("seq", F.col("ts").isNull().alias("no_time"))


@query("read_observations", sql("SELECT trace_id, intent FROM ob WHERE intent IS NOT NULL"))
def read_observations(spark, d):
    path = new_folder(spark, "observations")
    readers.write_observations(Fx.observations(spark, d), path)
    rows = readers.read_observations(spark, path, K.OBS_INTENT)
    return rows.select(F.col("traceId").alias("trace_id"), V.string_at(F.col("metadata"), "$.intent").alias("intent"))


@query("traces_by_session", sql("SELECT trace_id, ts, turn FROM tr WHERE session_id = '901'"))
def traces_by_session(spark, d):
    return readers.traces_by_session(Fx.traces(spark, d), "901").select("trace_id", "ts", "turn")


@query("filter_ticket_traces", "SELECT event_id AS seq FROM events WHERE event_id % 97 <> 7 UNION ALL SELECT event_id + 1000000000 FROM events WHERE event_id % 97 <> 7 AND event_id % 89 = 0")
def filter_ticket_traces(spark, d):
    rows = Fx.damaged_traces(spark, d)
    return ingest.filter_ticket_traces(rows).select("seq")


_DAMAGED = """dmg0 AS (
  SELECT event_id AS seq, e % 97 AS m, CASE WHEN e % 97 <> 2 THEN trace_id END AS id, CASE WHEN e % 97 <> 3 THEN session_id END AS sessionid,
         CASE WHEN e % 97 <> 1 THEN ts END AS gts, ts, turn, is_ai, is_transfer, is_malformed, is_guardrail, 'default' AS environment
  FROM (SELECT *, event_id AS e FROM tr)
), dmg AS (
  SELECT * FROM dmg0 UNION ALL
  SELECT seq + 1000000000, m, id, sessionid, gts, ts, turn, is_ai, is_transfer, is_malformed, is_guardrail,
         CASE WHEN (seq + 1000000000) % 2 = 0 THEN 'other' ELSE environment END FROM dmg0 WHERE seq % 89 = 0
), keep AS (SELECT * FROM dmg WHERE id IS NULL UNION ALL SELECT * FROM dmg WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
norm AS (
  SELECT seq, id AS trace_id, sessionid AS session_id, gts AS ts, turn,
         CASE WHEN gts IS NULL THEN 'invalid_timestamp' WHEN id IS NULL THEN 'missing_trace_id' WHEN sessionid IS NULL THEN 'missing_session_id'
              WHEN m = 4 THEN 'missing_turn' WHEN m = 5 THEN 'invalid_turn' WHEN m = 6 AND sessionid <> '7' THEN 'session_freshdesk_mismatch' END AS reason,
         environment
  FROM keep
), iss AS (SELECT reason, session_id, trace_id, ts FROM norm WHERE reason IS NOT NULL),
iss1 AS (
  SELECT * FROM iss WHERE session_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY reason, coalesce(trace_id, ''), coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '')) = 1
)"""


@Fx.plan_once
def damaged_payloads(spark, d):
    """Deduplicated, validated traces with reject reasons."""
    return ingest.normalize_traces(ingest.dedupe_traces(Fx.damaged_traces(spark, d), "seq"))


@Fx.stored_once
def damaged(spark, d):
    return damaged_payloads(spark, d).drop("input", "output")


@query("normalize_traces", sql("SELECT trace_id, session_id, ts, reason FROM norm", _DAMAGED))
def normalize_traces(spark, d):
    return damaged(spark, d).select("trace_id", "session_id", "ts", "reason")


@query("parse_aware_timestamp", "SELECT event_id + c.shift AS seq, CASE WHEN event_id % 97 <> 1 THEN ts END AS parsed FROM events, (VALUES (0), (1000000000)) c(shift) WHERE c.shift = 0 OR event_id % 89 = 0")
def parse_aware_timestamp(spark, d):
    rows = Fx.damaged_traces(spark, d)
    return rows.select("seq", T.parse_aware_timestamp(F.col("timestamp")).alias("parsed"))


@query("dedupe_traces", sql("SELECT seq, id, environment FROM keep", _DAMAGED))
def dedupe_traces(spark, d):
    return ingest.dedupe_traces(Fx.damaged_traces(spark, d), "seq").select("seq", "id", "environment")


_STRICT = """st AS (SELECT id, count(DISTINCT environment) AS variants, min(seq) AS seq FROM dmg WHERE id IS NOT NULL GROUP BY id)"""


@query("dedupe_traces_strict", sql("""SELECT seq, id FROM st WHERE variants = 1 UNION ALL SELECT seq, id FROM dmg WHERE id IS NULL""", _DAMAGED, _STRICT))
def dedupe_traces_strict(spark, d):
    payload = ingest.payload_hash("id", "sessionId", "timestamp", "environment", "metadata", "input", "output")
    kept, _ = ingest.dedupe_traces_strict(Fx.damaged_traces(spark, d), payload, "seq")
    return kept.select("seq", "id")


@query("payload_collisions", sql("SELECT count(*) FILTER (variants > 1) AS collision_count FROM st", _DAMAGED, _STRICT))
def payload_collisions(spark, d):
    payload = ingest.payload_hash("id", "sessionId", "timestamp", "environment", "metadata", "input", "output")
    return ingest.dedupe_traces_strict(Fx.damaged_traces(spark, d), payload, "seq")[1]


@query("first_issue_per_session", sql("SELECT reason, session_id, trace_id, ts FROM iss1", _DAMAGED))
def first_issue_per_session(spark, d):
    return ingest.first_issue_per_session(ingest.quality_issues(damaged(spark, d)))


@query("exclude_invalid_sessions", sql("""SELECT trace_id, session_id FROM norm WHERE reason IS NULL
 AND session_id NOT IN (SELECT session_id FROM iss WHERE session_id IS NOT NULL)""", _DAMAGED))
def exclude_invalid_sessions(spark, d):
    rows = damaged(spark, d)
    return ingest.exclude_invalid_sessions(ingest.valid_records(rows), ingest.quality_issues(rows)).select("trace_id", "session_id")


_SELECT = """sel0 AS (
  SELECT session_id, arg_min(ts, (turn, ts, trace_id)) + INTERVAL 7 HOUR AS first_local,
         count(*) FILTER (ts + INTERVAL 7 HOUR >= TIMESTAMP '2024-01-15' AND ts + INTERVAL 7 HOUR <= TIMESTAMP '2024-01-31 10:00:00') AS inside
  FROM norm WHERE reason IS NULL GROUP BY 1
), sel AS (
  SELECT session_id, CASE WHEN first_local < TIMESTAMP '2024-01-15' THEN CASE WHEN inside > 0 THEN 'pre_window_start' END
                          WHEN first_local <= TIMESTAMP '2024-01-31 10:00:00' THEN 'eligible' END AS selection_group
  FROM sel0 WHERE session_id NOT IN (SELECT session_id FROM iss1)
  UNION ALL SELECT session_id, 'invalid_keyed' FROM iss1
)"""


@Fx.plan_once
def selection(spark, d, window: CohortWindow = Fx.SHORT_WINDOW):
    rows = damaged(spark, d)
    return ingest.select_candidates(ingest.valid_records(rows), ingest.quality_issues(rows), window)


@query("select_candidates", sql("SELECT session_id, selection_group FROM sel WHERE selection_group IS NOT NULL", _DAMAGED, _SELECT))
def select_candidates(spark, d):
    return selection(spark, d)


@query("is_transfer_response", sql("SELECT trace_id, is_transfer FROM tr"))
def is_transfer_response(spark, d):
    rows = Fx.raw_traces(spark, d)
    return rows.select(F.col("id").alias("trace_id"), classify.is_transfer_response(V.string_at(F.col("output"), "$.response")).alias("is_transfer"))


@query("normalize_transfer_text")
def normalize_transfer_text(spark, d):
    return Fx.texts(spark, d).select("id", F.sha2(X.normalize_transfer_text(F.col("text")), 256).alias("normal_hash"))


@query("output_flags", sql("""SELECT trace_id, is_transfer, is_guardrail, is_malformed, is_ai,
 CASE WHEN is_malformed THEN 'malformed_output' WHEN is_guardrail THEN 'guardrail_rule' ELSE 'empty_or_technical' END AS output_quality FROM tr"""))
def output_flags(spark, d):
    rows = Fx.traces(spark, d)
    quality = classify.output_quality(F.col("is_malformed"), F.col("is_guardrail"))
    return rows.select("trace_id", "is_transfer", "is_guardrail", "is_malformed", "is_ai", quality.alias("output_quality"))


@query("is_guardrail_or_system_only", sql("SELECT trace_id, is_guardrail FROM tr"))
def is_guardrail_only(spark, d):
    return Fx.traces(spark, d).select("trace_id", "is_guardrail")


@query("is_substantive_ai_response", sql("SELECT trace_id, is_ai FROM tr"))
def is_substantive(spark, d):
    return Fx.traces(spark, d).select("trace_id", "is_ai")


@query("is_malformed_output", sql("SELECT trace_id, is_malformed FROM tr"))
def is_malformed(spark, d):
    return Fx.raw_traces(spark, d).select(F.col("id").alias("trace_id"), classify.is_malformed_output(F.col("output")).alias("is_malformed"))


@query("cohort_status", sql("""SELECT trace_id, CASE WHEN l >= TIMESTAMP '2024-01-15' AND l < TIMESTAMP '2024-01-29' THEN 'complete'
 WHEN l >= TIMESTAMP '2024-01-29' AND l <= TIMESTAMP '2024-01-31 10:00:00' THEN 'wtd' ELSE 'out_of_scope' END AS cohort_status
 FROM (SELECT trace_id, ts + INTERVAL 7 HOUR AS l FROM tr)"""))
def cohort_status(spark, d):
    return Fx.traces(spark, d).select("trace_id", Fx.SHORT_WINDOW.cohort_status(T.local_ts(F.col("ts"))).alias("cohort_status"))


@query("trace_order", sql("SELECT trace_id, session_id, p AS position FROM pos"))
def trace_order(spark, d):
    rows = Fx.traces(spark, d).select("trace_id", "session_id", "turn", "ts")
    return classify.trace_order(rows).select("trace_id", "session_id", "position")


@query("first_trace", sql("SELECT session_id, trace_id, ts, turn FROM fst"))
def first_trace(spark, d):
    return classify.first_trace(Fx.traces(spark, d)).select("session_id", "trace_id", "ts", "turn")


@query("duplicate_turns", sql("SELECT session_id, dup AS has_duplicate_turn FROM dup"))
def duplicate_turns(spark, d):
    return classify.duplicate_turns(Fx.traces(spark, d))


@query("classify_sessions", sql(f"SELECT {_SES_COLUMNS} FROM ses"))
def classify_sessions(spark, d):
    return Fx.sessions(spark, d).drop(*Fx.CARRY)


@query("reopen_lifetime", sql("SELECT session_id, reopen_lifetime FROM ses WHERE reopen_lifetime IS NOT NULL"))
def reopen_lifetime(spark, d):
    return Fx.sessions(spark, d).where("reopen_lifetime is not null").select("session_id", "reopen_lifetime")


@query("reopen_within_7d", sql("SELECT session_id, reopen_within_7d, control_reopen_within_7d FROM ses"))
def reopen_within_7d(spark, d):
    return Fx.sessions(spark, d).select("session_id", "reopen_within_7d", "control_reopen_within_7d")


@query("time_functions", sql("""SELECT session_id, cohort_week, score_ts, is_weekend_start,
 TIMESTAMP '2024-01-31 10:00:00' >= cohort_week + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND + INTERVAL 168 HOUR AS week_mature_mon_sun,
 TIMESTAMP '2024-01-31 10:00:00' >= cohort_week + INTERVAL 5 DAY - INTERVAL 1 MICROSECOND + INTERVAL 168 HOUR AS week_mature_mon_fri FROM ses"""))
def time_functions(spark, d):
    rows = classify.first_trace(Fx.traces(spark, d))
    ts, as_of = F.col("ts"), F.lit(None)
    from ..window import ntz

    as_of = ntz(Fx.AS_OF)
    week = T.cohort_week(ts)
    return rows.select(
        "session_id", week.alias("cohort_week"), T.score_anchor(week).alias("score_ts"), T.is_weekend_start(ts).alias("is_weekend_start"),
        *[T.week_mature(week, as_of, F.lit(w)).alias(f"week_mature_{w}") for w in K.WEEK_DEFINITIONS])


@query("extract_dimensions", sql("""SELECT trace_id, issue_category, app, app_code, product_code, entry_point, 'Không xác định' AS payment_channel,
 arm AS model_core FROM tr"""))
def extract_dimensions(spark, d):
    names = ("issue_category", "app", "app_code", "product_code", "entry_point", "payment_channel", "model_core")
    return Fx.traces(spark, d).select("trace_id", *names)


@query("parse_meta_code", sql("SELECT trace_id, tpe_code, tpe_status_raw FROM tr"))
def parse_meta_code(spark, d):
    return Fx.traces(spark, d).select("trace_id", "tpe_code", "tpe_status_raw")


@query("is_ai_arm", sql("SELECT trace_id, arm FROM tr"))
def is_ai_arm(spark, d):
    return Fx.raw_traces(spark, d).select(F.col("id").alias("trace_id"), ingest.model_arm(F.col("input")).alias("arm"))


@query("is_blocking_guardrail", sql("SELECT trace_id, source, rule FROM ob WHERE rule IS NOT NULL"))
def is_blocking_guardrail(spark, d):
    rows = Fx.observations(spark, d).where(F.col("name").isin(K.OBS_INPUT_GUARD, K.OBS_SKILL_GUARD, K.OBS_OUTPUT_GUARD))
    rows = rows.where(enrich.is_blocking_guardrail(F.col("output")) & enrich.guardrail_signal(F.col("metadata"), F.col("output")))
    return rows.select(F.col("traceId").alias("trace_id"), F.col("name").alias("source"), V.string_at(F.col("output"), "$.rule").alias("rule"))


@query("safe_skill", sql("SELECT trace_id, skill FROM ob WHERE skill IS NOT NULL"))
def safe_skill(spark, d):
    rows = readers.observations_named(Fx.observations(spark, d), K.OBS_SKILL)
    names = F.explode(V.strings_at(F.col("metadata"), "$.skills_used")).alias("s")
    return rows.select(F.col("traceId").alias("trace_id"), names).select("trace_id", X.safe_skill(F.col("s")).alias("skill"))


@query("tpe_signal", sql("SELECT trace_id, transstatus, step_result FROM ob WHERE transstatus IS NOT NULL"))
def tpe_signal(spark, d):
    rows = readers.observations_named(Fx.observations(spark, d), K.OBS_TPE)
    return rows.select(F.col("traceId").alias("trace_id"), enrich.tpe_signal(F.col("output")).alias("p")).select("trace_id", "p.*")


@query("is_safe_ticket_id", r"""SELECT doc_id, regexp_full_match(t, '[1-9][0-9]{0,19}') AND NOT regexp_matches(t, '(^|\D)(0|84|\+84)[0-9]{8,10}($|\D)') AS ok
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN concat('84', 100000000 + doc_id) WHEN 2 THEN concat('9', 10000000 + doc_id) ELSE concat('x', doc_id) END AS t FROM documents)""")
def is_safe_ticket_id(spark, d):
    i = F.col("id")
    made = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(F.lit("84"), i + 100000000)).when(i % 4 == 2, F.concat(F.lit("9"), i + 10000000)).otherwise(F.concat(F.lit("x"), i))
    return Fx.texts(spark, d).select(F.col("id").alias("doc_id"), X.is_safe_ticket_id(made).alias("ok"))


@query("is_safe_intent", sql("""SELECT trace_id, coalesce(regexp_full_match(s, '[a-z0-9_-]{1,64}') AND NOT regexp_matches(s, '[0-9]{6}'), false) AS ok
 FROM (SELECT trace_id, CASE WHEN k % 3 = 0 THEN concat('intent_', k) WHEN k % 3 = 1 THEN concat('Intent ', k) ELSE concat('intent_', 100000 + k) END AS s FROM tr)"""))
def is_safe_intent(spark, d):
    k = F.col("k")
    made = F.when(k % 3 == 0, F.concat(F.lit("intent_"), k)).when(k % 3 == 1, F.concat(F.lit("Intent "), k)).otherwise(F.concat(F.lit("intent_"), k + 100000))
    return Fx.events(spark, d).select(F.col("event_id").cast("string").alias("trace_id"), X.is_safe_intent(made).alias("ok"))


@query("safe_dimension")
def safe_dimension(spark, d):
    rows = Fx.texts(spark, d).select("id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.select("id", X.safe_dimension(F.col("line")).alias("value")).groupBy("id").agg(
        F.count_if(F.col("value") == K.MISSING).alias("unsafe"), F.count(F.lit(1)).alias("lines"))


signals = Fx.signals


@query("build_trace_enrichment", sql("""SELECT trace_id, coalesce(intent, '') AS intents, coalesce(skill, '') AS skills, coalesce(rule, '') AS guardrail_rules,
 coalesce(rule || '/' || source, '') AS first_event, history AS escalation_guard_blocked, coalesce(transstatus || ':' || coalesce(step_result, '-'), '') AS tpe_signals
 FROM ob WHERE intent IS NOT NULL OR skill IS NOT NULL OR rule IS NOT NULL OR history OR transstatus IS NOT NULL"""))
def build_trace_enrichment(spark, d):
    rows = enrich.build_trace_enrichment(signals(spark, d))
    event = F.get("guardrail_events", F.lit(0))
    return rows.select(
        "trace_id", text_list("intents").alias("intents"), text_list("skills").alias("skills"), text_list("guardrail_rules").alias("guardrail_rules"),
        F.coalesce(F.concat(event["rule"], F.lit("/"), event["source"]), F.lit("")).alias("first_event"), "escalation_guard_blocked",
        F.array_join(F.transform("tpe_signals", lambda p: F.concat(p["transstatus"], F.lit(":"), F.coalesce(p["step_result"], F.lit("-")))), ",").alias("tpe_signals"))


@query("attach_enrichment", sql("""SELECT session_id, intent, skill, guardrail_rule, skill_count, coalesce(array_to_string(skill_set, ','), '') AS skill_set,
 coalesce(array_to_string(rules, ','), '') AS guardrail_rules, escalation_guard_blocked, n_pairs FROM ens"""))
def attach_enrichment(spark, d):
    return Fx.enriched_sessions(spark, d).select(
        "session_id", "intent", "skill", "guardrail_rule", "skill_count", text_list("skill_set").alias("skill_set"), text_list("guardrail_rules").alias("guardrail_rules"),
        "escalation_guard_blocked", F.size("tpe_signals").alias("n_pairs"))


@query("only_value", sql("SELECT session_id, intent, skill FROM ens"))
def only_value(spark, d):
    rows = enrich.session_signals(Fx.traces(spark, d), signals(spark, d).where("kind in ('intent', 'skill')"))
    base = classify.first_trace(Fx.traces(spark, d)).select("session_id")
    return base.join(rows, "session_id", "left").select(
        "session_id", "intent", enrich.only_value(F.col("skill_set")).alias("skill"))


@query("transfer_trigger", sql("""SELECT session_id, trigger_reason, trigger_rule, trigger_source, trigger_stage, trigger_skill FROM ens WHERE transferred"""))
def transfer_trigger(spark, d):
    rows = enrich.transfer_trigger(Fx.sessions(spark, d).where("transferred"), signals(spark, d))
    return rows.select("session_id", *[f"trigger_{c}" for c in ("reason", "rule", "source", "stage", "skill")])


@query("transfer_reason_code", sql("SELECT trace_id, reason FROM trg"))
def transfer_reason_code(spark, d):
    rows = signals(spark, d).where("kind = 'event'")
    return rows.select("trace_id", enrich.transfer_reason_code(F.col("a"), F.col("b"), F.col("c")).alias("reason"))


@query("resolve_tpe_status", sql("""SELECT p.session_id, p.transstatus, p.step_result,
 (SELECT arg_min(status, ord) FROM mapping m WHERE m.code = p.transstatus AND (m.step IS NULL OR m.step = p.step_result)) AS status FROM pairs p"""))
def resolve_tpe_status(spark, d):
    rows = enrich.session_signals(Fx.traces(spark, d), signals(spark, d).where("kind = 'tpe'"))
    pairs = rows.select("session_id", F.explode("tpe_signals").alias("p")).select("session_id", "p.*")
    return enrich.resolve_tpe_status(pairs, enrich.tpe_mapping(spark))


@query("skill_bucket", sql("SELECT session_id, skill_bucket FROM ens"))
def skill_bucket(spark, d):
    return Fx.enriched_sessions(spark, d).select("session_id", enrich.skill_bucket(F.col("skill_set")).alias("skill_bucket"))


@query("unique_transstatus", sql("SELECT session_id, transstatus FROM ens"))
def unique_transstatus(spark, d):
    return Fx.enriched_sessions(spark, d).select("session_id", enrich.unique_transstatus(F.col("tpe_signals")).alias("transstatus"))


_KEYWORDS = """SELECT doc_id, CASE WHEN n > 1 THEN 'multiple' WHEN n = 0 THEN 'other' WHEN i THEN 'ibft' WHEN t THEN 'topup' WHEN w THEN 'withdraw' ELSE 'oao' END AS category
FROM (SELECT *, CAST(i AS INT) + CAST(t AS INT) + CAST(w AS INT) + CAST(o AS INT) AS n FROM (
  SELECT doc_id,
    regexp_matches(s, 'ibft|interbank|inter-bank|chuyen tien lien ngan hang|lien ngan hang') AS i, regexp_matches(s, 'topup|top up|nap tien|nap dt') AS t,
    regexp_matches(s, 'withdraw|rut tien|cashout|cash out') AS w, regexp_matches(s, 'oao|open account|mo tai khoan') AS o
  FROM (SELECT doc_id, concat(lower(strip_accents(title)), ' ', lower(strip_accents(cat))) AS s FROM (
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Nạp tiền lỗi' WHEN 1 THEN 'Rút Tiền' WHEN 2 THEN 'IBFT' ELSE 'Hỏi chung' END AS title,
           CASE doc_id % 3 WHEN 0 THEN 'CASH OUT' WHEN 1 THEN 'khác' ELSE 'mở tài khoản' END AS cat FROM documents))))"""


@query("category_from_keywords", _KEYWORDS)
def category_from_keywords(spark, d):
    i = F.col("id")
    title = F.when(i % 5 == 0, "Nạp tiền lỗi").when(i % 5 == 1, "Rút Tiền").when(i % 5 == 2, "IBFT").otherwise("Hỏi chung")
    cat = F.when(i % 3 == 0, "CASH OUT").when(i % 3 == 1, "khác").otherwise("mở tài khoản")
    payload = F.struct(F.struct(title.alias("title"), F.struct(F.struct(cat.alias("loại")).alias("nested"), F.lit("topup").alias("note")).alias("meta")).alias("other_info"))
    return Fx.texts(spark, d).select(F.col("id").alias("doc_id"), F.parse_json(F.to_json(payload)).alias("p")).select("doc_id", enrich.category_from_keywords(F.col("p")).alias("category"))


@query("category_from_tpe", sql("""SELECT o.trace_id, coalesce(CAST((SELECT arg_min(mcase, ord) FROM mapping m WHERE m.code = o.transstatus AND (m.step IS NULL OR m.step = o.step_result)) AS VARCHAR), 'unknown') AS tpe_category
 FROM ob o WHERE intent IS NOT NULL OR skill IS NOT NULL OR rule IS NOT NULL OR history OR transstatus IS NOT NULL"""))
def category_from_tpe(spark, d):
    return enrich.category_from_tpe(Fx.observations(spark, d), enrich.tpe_mapping(spark))


@query("category_from_guardrail", sql("""SELECT trace_id, coalesce(rule, 'unknown') AS guardrail_category
 FROM ob WHERE intent IS NOT NULL OR skill IS NOT NULL OR rule IS NOT NULL OR history OR transstatus IS NOT NULL"""))
def category_from_guardrail(spark, d):
    return enrich.category_from_guardrail(Fx.observations(spark, d))


@query("read_conversations", """SELECT CAST(conv_id + 1 AS VARCHAR) AS ticket_id, conv_id * 1000 + turn + 1 AS message_id, role = 'assistant' AND length(text) % 5 = 0 AS is_autorep_note FROM conversations""")
def read_conversations(spark, d):
    return readers.read_conversations(Fx.messages(spark, d)).select("ticket_id", "message_id", "is_autorep_note")


@query("read_helpdesk_tickets", sql("""SELECT session_id AS ticket_id, turn0_ts AS created_ts FROM ses WHERE CAST(session_id AS BIGINT) % 5 <> 0 AND turn0_ts >= TIMESTAMP '2024-01-08'
 UNION ALL SELECT CAST(conv_id + 900000 AS VARCHAR), TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id >= TIMESTAMP '2024-01-08'"""))
def read_helpdesk_tickets(spark, d):
    rows = Fx.inventory(spark, d, Fx.sessions(spark, d))
    return readers.read_helpdesk_tickets(rows, "2024-01-08 00:00:00").select("ticket_id", "created_ts")


_MAPPED = """mpd AS (
  SELECT CASE WHEN event_id % 97 = 1 THEN concat('x', event_id) WHEN event_id % 5 = 0 THEN '-365' ELSE CAST(event_id % 1000000 AS VARCHAR) END AS code,
         CASE WHEN event_id % 11 = 3 THEN NULL WHEN event_id % 101 = 7 THEN concat('bad ', event_id) ELSE CAST(event_id % 3 AS VARCHAR) END AS step FROM events)"""


@query("reference_tables", f"""WITH {_MAPPED}
SELECT 'duplicate_tpe_step' AS problem, code || '/' || step AS item FROM mpd WHERE step IS NOT NULL GROUP BY code, step HAVING count(*) > 1
UNION ALL SELECT 'duplicate_tpe_wildcard', code FROM mpd WHERE step IS NULL GROUP BY code HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'malformed_code', code FROM mpd WHERE NOT regexp_full_match(code, '-?[0-9]{{1,6}}')
UNION ALL SELECT DISTINCT 'malformed_step', step FROM mpd WHERE NOT regexp_full_match(step, '-?[0-9]{{1,6}}')""")
def reference_tables(spark, d):
    e = F.col("event_id")
    code = F.when(e % 97 == 1, F.concat(F.lit("x"), e)).when(e % 5 == 0, "-365").otherwise((e % 1_000_000).cast("string"))
    steps = F.when(e % 11 == 3, F.array().cast("array<string>")).when(e % 101 == 7, F.array(F.concat(F.lit("bad "), e))).otherwise(F.array((e % 3).cast("string")))
    made = Fx.table(spark, d, "events").select(e.alias("ord"), code.alias("code"), steps.alias("steps"), F.lit(1).alias("case"), F.lit("X").alias("status"))
    return reference.mapping_problems(made)


@query("rule_overlaps", """SELECT DISTINCT concat('rule_', event_id % 50) AS rule FROM events WHERE event_id % 50 % 7 = 0""")
def rule_overlaps(spark, d):
    rule = F.concat(F.lit("rule_"), F.col("event_id") % 50)
    rows = Fx.table(spark, d, "events").select(rule.alias("rule"), (F.col("event_id") % 50).alias("n"))
    both = rows.select("rule", F.lit("violation").alias("kind")).unionByName(rows.where("n % 7 = 0").select("rule", F.lit("compliant").alias("kind")))
    return reference.rule_overlaps(both)


@query("scale_problems", """SELECT concat('survey-', doc_id % 5) AS survey_id, doc_id % 9 AS token, count(DISTINCT quality) AS buckets FROM labels GROUP BY 1, 2 HAVING count(DISTINCT quality) > 1""")
def scale_problems(spark, d):
    rows = Fx.table(spark, d, "labels").select(F.concat(F.lit("survey-"), F.col("doc_id") % 5).alias("survey_id"), (F.col("doc_id") % 9).alias("token"), F.col("quality").cast("string").alias("bucket"))
    return reference.scale_problems(rows)


@query("transfer_templates", sql("SELECT trace_id, is_transfer OR event_type = 'signup' AS is_transfer FROM tr"))
def transfer_templates(spark, d):
    """Approved replies from a taxonomy file: the default one, and the reply of signups as the second."""
    path = new_folder(spark, "taxonomy")
    texts = F.lit([*K.TRANSFER_TEXTS, "Không hỗ trợ nội dung này"])
    document = F.to_json(F.struct(
        F.struct(F.array(F.struct(F.lit("-365").alias("code"), F.array(F.lit("1")).alias("steps"), F.lit(1).alias("case"), F.lit("X").alias("status"))).alias("mappings")).alias("tpe"),
        F.struct(texts.alias("semantic_texts")).alias("transfer"), F.struct(F.array(F.lit("a")).alias("violation_rules"), F.array(F.lit("b")).alias("compliant_rules")).alias("guardrail")))
    spark.range(1).select(document.alias("value")).coalesce(1).write.text(path)
    templates = reference.transfer_templates(reference.read_taxonomy(spark, path))
    return Fx.raw_traces(spark, d).select(F.col("id").alias("trace_id"), classify.is_transfer_response(V.string_at(F.col("output"), "$.response"), templates).alias("is_transfer"))
