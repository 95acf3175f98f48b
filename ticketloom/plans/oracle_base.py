"""The fixture views and ticket facts once more, as plain SQL for the DuckDB check."""

from __future__ import annotations

from .. import constants as K

WEEKS = ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")
AS_OF_LOCAL = "TIMESTAMP '2024-01-31 10:00:00'"

_mapping_rows = ",\n".join(
    f"({i}, '{code}', {'NULL' if step is None else repr(step)}, {case}, '{status}')"
    for i, (code, steps, case, status) in enumerate(K.TPE_MAPPING) for step in (steps or (None,)))
_reasons = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in K.REASON_BY_RULE.items())

BASE = f"""
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         (user_id + 1) * 100 + (day(ts) - 1) // 3 AS sid
  FROM events
), evn AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS rn FROM ev
), tr AS (
  SELECT CAST(event_id AS VARCHAR) AS trace_id, CAST(sid AS VARCHAR) AS session_id, ts, event_id, user_id, k, rn, sid, event_type,
         CAST(rn - 1 + (CASE WHEN sid % 7 = 0 THEN 1 ELSE 0 END) - (CASE WHEN k % 10 = 9 AND rn > 1 THEN 1 ELSE 0 END) AS INTEGER) AS turn,
         event_type = 'purchase' AND k % 4 = 0 AS is_transfer,
         event_type IN ('view', 'click') OR (event_type = 'purchase' AND k % 4 <> 0) AS is_ai,
         event_type = 'signup' AS is_guardrail, event_type = 'error' AS is_malformed,
         value AS latency,
         CASE WHEN user_id % 11 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END END AS arm,
         CASE WHEN user_id % 13 <> 0 THEN ['Nạp tiền', 'Rút tiền', 'Chuyển tiền', 'Thanh toán'][user_id % 4 + 1] ELSE 'Không xác định' END AS issue_category,
         concat(k % 5 + 450, ' - app') AS app, CAST(k % 5 + 450 AS BIGINT) AS app_code, concat('P', k % 6) AS product_code,
         CASE k % 3 WHEN 0 THEN 'tranxdetail' WHEN 1 THEN 'resultpage' ELSE 'Không xác định' END AS entry_point,
         CASE WHEN k % 7 <> 0 THEN ['-365', '-348', '-383', '999'][k % 4 + 1] END AS tpe_code,
         CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN 'Thất bại' END AS tpe_status_raw
  FROM evn
), pos AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, ts, trace_id) AS p FROM tr
), dec AS (
  SELECT session_id, min(p) AS dp, arg_min(is_ai, p) AS d_ai FROM pos WHERE is_ai OR is_transfer GROUP BY 1
), fst AS (SELECT * FROM pos WHERE p = 1),
flw AS (
  SELECT pos.session_id, pos.p, pos.is_ai, pos.ts, fst.ts AS t0,
         lag(pos.is_ai) OVER (PARTITION BY pos.session_id ORDER BY pos.p) AS before_ai
  FROM pos JOIN dec USING (session_id) JOIN fst USING (session_id) WHERE pos.p > dec.dp
), flc AS (
  SELECT session_id, CAST(sum(CASE WHEN before_ai IS NULL OR before_ai THEN 1 ELSE 0 END) AS BIGINT) AS returns,
         max(CASE WHEN ts > t0 AND ts <= t0 + INTERVAL 168 HOUR THEN 1 ELSE 0 END) AS within7
  FROM flw GROUP BY 1
), dup AS (
  SELECT session_id, max(n) > 1 AS dup FROM (SELECT session_id, turn, count(*) AS n FROM tr GROUP BY 1, 2) GROUP BY 1
), agg AS (
  SELECT session_id, count(*) AS turn_count, count(*) FILTER (is_ai) AS ai_reply_count, bool_or(is_malformed) AS bad,
         bool_or(turn = 0) AS zero, arg_min(trace_id, p) FILTER (is_transfer) AS first_transfer_trace_id
  FROM pos GROUP BY 1
), ses AS (
  SELECT f.session_id, f.trace_id AS turn0_trace_id, f.ts AS turn0_ts,
         CAST(date_trunc('week', f.ts + INTERVAL 7 HOUR) AS DATE) AS cohort_week,
         date_trunc('week', f.ts + INTERVAL 7 HOUR) + INTERVAL 5 HOUR AS score_ts,
         CASE WHEN f.ts + INTERVAL 7 HOUR >= TIMESTAMP '2024-01-01' AND f.ts + INTERVAL 7 HOUR < TIMESTAMP '2024-01-29' THEN 'complete'
              WHEN f.ts + INTERVAL 7 HOUR >= TIMESTAMP '2024-01-29' AND f.ts + INTERVAL 7 HOUR <= {AS_OF_LOCAL} THEN 'wtd' ELSE 'out_of_scope' END AS cohort_status,
         coalesce(d.d_ai, false) AS ai_first,
         CASE WHEN d.dp IS NULL THEN CASE WHEN f.is_malformed THEN 'unknown' WHEN f.is_guardrail THEN 'guardrail_rule' ELSE 'empty_or_technical' END
              WHEN NOT d.d_ai THEN 'direct_cs' END AS no_ai_first_reason,
         CASE WHEN d.dp IS NULL THEN 'unclassified' WHEN NOT d.d_ai THEN 'direct_cs'
              WHEN a.first_transfer_trace_id IS NOT NULL THEN 'ai_then_cs' ELSE 'ai_end_to_end' END AS outcome,
         CASE WHEN d.d_ai THEN coalesce(c.returns, 0) END AS reopen_lifetime,
         CASE WHEN d.d_ai THEN coalesce(c.within7, 0) END AS reopen_within_7d,
         a.ai_reply_count, a.first_transfer_trace_id,
         CASE WHEN u.dup THEN 'duplicate_turn' WHEN NOT a.zero THEN 'no_turn_zero' WHEN a.bad THEN 'malformed_output'
              WHEN d.dp IS NULL AND NOT f.is_guardrail THEN 'empty_or_technical' ELSE 'valid' END AS data_quality,
         'default' AS environment, isodow(f.ts + INTERVAL 7 HOUR) >= 6 AS is_weekend_start, a.turn_count,
         a.first_transfer_trace_id IS NOT NULL AS transferred,
         CASE WHEN d.dp IS NOT NULL AND NOT d.d_ai THEN coalesce(c.within7, 0) END AS control_reopen_within_7d,
         f.issue_category, f.app, f.app_code, f.product_code, f.entry_point, 'Không xác định' AS payment_channel, f.tpe_code, f.tpe_status_raw,
         f.arm AS model_core, f.user_id
  FROM fst f JOIN agg a USING (session_id) JOIN dup u USING (session_id) LEFT JOIN dec d USING (session_id) LEFT JOIN flc c USING (session_id)
), mapping(ord, code, step, mcase, status) AS (VALUES
{_mapping_rows}
), ob AS (
  SELECT trace_id, session_id, k, event_type,
         CASE WHEN event_type = 'view' THEN concat('intent_', k % 10) END AS intent,
         CASE WHEN event_type = 'click' THEN concat('skill_', k % 5) END AS skill,
         CASE WHEN is_transfer AND k % 20 <> 16 THEN CASE WHEN k % 12 = 8 THEN 'missing_transaction_id' ELSE 'cs_escalation' END END AS rule,
         CASE WHEN is_transfer AND k % 20 <> 16 THEN CASE k % 12 WHEN 0 THEN 'skill_guardrail_checked' WHEN 4 THEN 'output_guardrail' ELSE 'input_guardrail' END END AS source,
         CASE WHEN is_transfer AND k % 20 <> 16 AND k % 12 = 0 THEN 'output' END AS stage,
         CASE WHEN is_transfer AND k % 20 <> 16 AND k % 12 = 0 THEN concat('skill_', k % 5) END AS gskill,
         event_type = 'signup' AND k % 5 = 0 AS history,
         CASE WHEN event_type = 'purchase' THEN ['-365', '-348', '-383', '999'][k % 4 + 1] END AS transstatus,
         CASE WHEN event_type = 'purchase' THEN CASE k % 3 WHEN 0 THEN '-1006' WHEN 1 THEN '210800' END END AS step_result
  FROM tr
), trg AS (
  SELECT trace_id, rule, source, stage, gskill,
         CASE WHEN rule = 'cs_escalation' AND source = 'skill_guardrail_checked' AND stage = 'output' THEN 'skill_suggested_transfer'
              WHEN rule = 'cs_escalation' AND source = 'output_guardrail' THEN 'ai_response_requires_transfer'
              {_reasons} ELSE 'other_guardrail' END AS reason
  FROM ob WHERE rule IS NOT NULL
), pairs AS (
  SELECT DISTINCT session_id, transstatus, step_result FROM ob WHERE transstatus IS NOT NULL
), sets AS (
  SELECT session_id, count(DISTINCT intent) AS n_intent, min(intent) AS intent1, count(DISTINCT skill) AS skill_count, min(skill) AS skill1,
         count(DISTINCT rule) AS n_rule, min(rule) AS rule1, bool_or(history) AS history,
         list_sort(list(DISTINCT skill) FILTER (skill IS NOT NULL)) AS skill_set,
         list_sort(list(DISTINCT rule) FILTER (rule IS NOT NULL)) AS rules
  FROM ob GROUP BY 1
), tpc AS (
  SELECT session_id, count(DISTINCT transstatus) AS n_code, min(transstatus) AS code1, count(*) AS n_pairs, count(step_result) AS n_steps FROM pairs GROUP BY 1
), ens0 AS (
  SELECT s.*, CASE WHEN n_intent = 1 THEN intent1 END AS intent, CASE WHEN skill_count = 1 THEN skill1 END AS skill, skill_count, skill_set,
         CASE WHEN n_rule = 1 THEN rule1 END AS guardrail_rule, rules, coalesce(history, false) AS escalation_guard_blocked,
         CASE WHEN n_code = 1 THEN code1 END AS transstatus, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_steps, 0) AS n_steps,
         CASE WHEN skill_count >= 2 THEN '{K.MULTI_SKILL}' WHEN skill_count = 1 THEN skill1 ELSE '{K.NO_SKILL}' END AS skill_bucket,
         t.reason AS trigger_reason, t.rule AS trigger_rule, t.source AS trigger_source, t.stage AS trigger_stage, t.gskill AS trigger_skill
  FROM ses s LEFT JOIN sets USING (session_id) LEFT JOIN tpc USING (session_id) LEFT JOIN trg t ON t.trace_id = s.first_transfer_trace_id
), freq AS (SELECT intent FROM ens0 WHERE intent IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
ens AS (
  SELECT e.*, CASE WHEN e.intent IS NULL THEN NULL WHEN f.intent IS NOT NULL THEN e.intent ELSE '{K.OTHER_INTENT}' END AS safe_intent
  FROM ens0 e LEFT JOIN freq f USING (intent)
), defs(week_definition) AS (VALUES ('mon_sun'), ('mon_fri')),
cal AS (
  SELECT week_definition, w::DATE AS cohort_week,
         CASE WHEN w::DATE = DATE '2024-01-29' THEN 'wtd' ELSE 'complete' END AS cohort_status,
         {AS_OF_LOCAL} >= w::DATE + INTERVAL 1 DAY * (CASE WHEN week_definition = 'mon_sun' THEN 7 ELSE 5 END) - INTERVAL 1 MICROSECOND + INTERVAL 168 HOUR AS mature
  FROM defs, (SELECT unnest([{", ".join(f"'{w}'" for w in WEEKS)}]) AS w)
), sd AS (SELECT s.*, d.week_definition FROM ens s JOIN defs d ON d.week_definition = 'mon_sun' OR NOT s.is_weekend_start),
wk AS (
  SELECT c.week_definition, c.cohort_week, c.cohort_status, count(s.session_id) > 0 AS has_data, count(s.session_id) AS total_tickets,
         count(*) FILTER (s.ai_first) AS ai_first_count,
         coalesce(count(*) FILTER (s.ai_first) / nullif(count(s.session_id), 0), 0.0) AS ai_first_rate,
         count(*) FILTER (s.outcome = 'ai_end_to_end') AS ai_end_to_end_count, count(*) FILTER (s.outcome = 'ai_then_cs') AS ai_then_cs_count,
         count(*) FILTER (s.outcome = 'direct_cs') AS direct_cs_count, count(*) FILTER (s.outcome = 'unclassified') AS unclassified_count,
         CASE WHEN c.mature THEN sum(s.reopen_within_7d) / nullif(count(s.reopen_within_7d), 0) END AS reopen_7d_rate,
         CASE WHEN c.mature THEN count(s.reopen_within_7d) END AS reopen_7d_denominator,
         sum(s.reopen_lifetime) / nullif(count(s.reopen_lifetime), 0) AS reopen_lifetime_rate,
         CAST(coalesce(sum(s.reopen_lifetime), 0) AS BIGINT) AS reopen_lifetime_numerator, count(s.reopen_lifetime) AS reopen_lifetime_denominator,
         sum(s.ai_reply_count) FILTER (s.ai_first) / nullif(count(*) FILTER (s.ai_first), 0) AS ai_reply_mean_ai_first,
         quantile_disc(s.ai_reply_count, 0.5) AS ai_reply_p50, quantile_disc(s.ai_reply_count, 0.9) AS ai_reply_p90, max(s.ai_reply_count) AS ai_reply_max,
         count(*) FILTER (s.turn_count > 3 AND s.transferred) AS gt4_turn_with_cs, count(*) FILTER (s.turn_count > 3 AND NOT s.transferred) AS gt4_turn_without_cs,
         0 AS max_replies_rule_fired, TIMESTAMP '2024-01-31 03:00:00' AS as_of
  FROM cal c LEFT JOIN sd s USING (week_definition, cohort_week) GROUP BY c.week_definition, c.cohort_week, c.cohort_status, c.mature
), obs_end AS (SELECT 1)
"""


def sql(body: str, *extra: str) -> str:
    """BASE plus further CTEs ("name AS (...)") and the final SELECT."""
    return BASE + "".join(f", {e}" for e in extra) + "\n" + body
