"""Queries: weekly metrics, segments, transfer diagnostics, exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import formats as N
from ..operators import classify, enrich, segments, weekly
from ..sources import writers
from . import fixtures as Fx
from .oracle_base import sql
from .q_ingest import _DAMAGED, _SELECT, damaged, selection
from .registry import query
from ..operators import ingest

_WEEKLY = ", ".join(weekly.WEEKLY_COLUMNS)


def enriched(spark, d):
    return Fx.enriched_sessions(spark, d)


@Fx.plan_once
def weekly_rows(spark, d):
    return weekly.weekly_summary(enriched(spark, d), Fx.WINDOW)


@query("weekly_summary", sql(f"SELECT {_WEEKLY} FROM wk"))
def weekly_summary(spark, d):
    return weekly_rows(spark, d).select(*weekly.WEEKLY_COLUMNS)


@query("nearest_rank", sql("SELECT week_definition, cohort_week, ai_reply_p50, ai_reply_p90 FROM wk WHERE has_data"))
def nearest_rank(spark, d):
    return weekly.nearest_rank_by_week(Fx.sessions(spark, d))


_GATE = """g AS (SELECT count(*) FILTER (selection_group = 'eligible') AS valid_sessions, count(*) FILTER (selection_group = 'invalid_keyed') AS invalid_sessions FROM sel),
g2 AS (SELECT *, invalid_sessions / (valid_sessions + invalid_sessions) AS structural_invalid_rate FROM g)"""


@query("structural_gate", sql("""SELECT *, structural_invalid_rate <= 0.05 AS core_allowed, structural_invalid_rate <= 0.05 AS business_allowed,
 structural_invalid_rate <= 0.05 AS tpe_allowed, structural_invalid_rate <= 0.05 AS guardrail_allowed,
 CASE WHEN structural_invalid_rate > 0.05 THEN 'structural_invalid_rate_gt_5pct' ELSE '' END AS reasons FROM g2""", _DAMAGED, _SELECT, _GATE))
def structural_gate(spark, d):
    return weekly.structural_gate(selection(spark, d))


_VIEW = """week_definition, {week} AS cohort_week, count(*) AS eligible_ticket_count, count(*) FILTER (outcome IN ('ai_then_cs', 'direct_cs')) AS transfer_total,
 count(*) FILTER (turn_count > 3) AS gt4_turn_total, count(*) FILTER (turn_count > 3 AND transferred) AS gt4_turn_with_cs,
 count(*) FILTER (turn_count > 3 AND NOT transferred) AS gt4_turn_without_cs, 0 AS max_replies_rule_fired, count(*) FILTER (is_weekend_start) AS weekend_start_count,
 count(*) FILTER (outcome = 'ai_end_to_end') AS ai_end_to_end, count(*) FILTER (outcome = 'ai_then_cs') AS ai_then_cs, count(*) FILTER (outcome = 'direct_cs') AS direct_cs,
 count(*) FILTER (outcome = 'unclassified') AS unclassified, count(*) FILTER (ai_first) AS ai_first_count, count(*) FILTER (ai_first) / count(*) AS ai_first_rate,
 sum(reopen_lifetime) AS reopen_lifetime_numerator, count(reopen_lifetime) AS reopen_lifetime_denominator, sum(reopen_within_7d) AS reopen_7d_numerator,
 count(reopen_within_7d) AS reopen_7d_denominator"""


@query("view_totals", sql(f"SELECT {_VIEW.format(week='cohort_week')} FROM sd GROUP BY week_definition, cohort_week UNION ALL SELECT {_VIEW.format(week='NULL::DATE')} FROM sd GROUP BY week_definition"))
def view_totals(spark, d):
    return weekly.view_totals(enriched(spark, d))


@query("data_range", sql("""SELECT week_definition, min(cohort_week) FILTER (has_data) AS first_week_with_data,
 coalesce(string_agg(CAST(cohort_week AS VARCHAR), ',' ORDER BY cohort_week) FILTER (NOT has_data), '') AS weeks_without_data FROM wk GROUP BY 1"""))
def data_range(spark, d):
    return weekly.data_range(weekly_rows(spark, d))


# Cut-off weekday is Tuesday: two finished days of the running week.
_SAME = """sps AS (SELECT * FROM sd WHERE date_diff('day', cohort_week, CAST(turn0_ts + INTERVAL 7 HOUR AS DATE)) < 2),
spw AS (
  SELECT c.week_definition, c.cohort_week, c.cohort_status, count(s.session_id) AS total_tickets, count(*) FILTER (s.ai_first) AS ai_first_count,
         coalesce(count(*) FILTER (s.ai_first) / nullif(count(s.session_id), 0), 0.0) AS ai_first_rate,
         sum(s.reopen_lifetime) / nullif(count(s.reopen_lifetime), 0) AS reopen_lifetime_rate,
         coalesce(sum(s.reopen_lifetime), 0) AS reopen_lifetime_numerator, count(s.reopen_lifetime) AS reopen_lifetime_denominator
  FROM cal c LEFT JOIN sps s USING (week_definition, cohort_week) GROUP BY 1, 2, 3
), spb AS (
  SELECT week_definition, count(*) AS weeks_used, avg(ai_first_rate) AS baseline_ai_first_rate, avg(reopen_lifetime_rate) AS baseline_reopen_lifetime_rate
  FROM spw WHERE cohort_status = 'complete' AND total_tickets > 0 GROUP BY 1 HAVING count(*) >= 2
), spc AS (SELECT w.* EXCLUDE (cohort_status), b.* EXCLUDE (week_definition) FROM spw w JOIN spb b USING (week_definition) WHERE cohort_status = 'wtd')"""


@query("same_period", sql("SELECT *, DATE '2024-01-29' AS running_week, 2 AS cutoff_weekday FROM spc", _SAME))
def same_period(spark, d):
    return weekly.same_period(Fx.sessions(spark, d), Fx.WINDOW)


_LATEST = """ltp AS (
  SELECT week_definition, max(cohort_week) FILTER (has_data) AS latest_week FROM wk GROUP BY 1
), lpw AS (
  SELECT l.week_definition, l.latest_week, (SELECT max(w.cohort_week) FROM wk w WHERE w.week_definition = l.week_definition AND w.has_data AND w.cohort_status = 'complete'
    AND w.cohort_week < l.latest_week) AS previous_week FROM ltp l
), scope AS (SELECT wk.* FROM wk JOIN ltp ON wk.week_definition = ltp.week_definition AND wk.cohort_week = ltp.latest_week)"""


@query("latest_and_previous_week", sql("SELECT * FROM lpw", _LATEST))
def latest_and_previous_week(spark, d):
    return weekly.latest_and_previous_week(weekly_rows(spark, d))


@query("week_set_rollup", sql("""SELECT week_definition, sum(total_tickets) AS eligible_ticket_count, sum(ai_then_cs_count + direct_cs_count) AS transfer_total,
 sum(ai_end_to_end_count) AS ai_end_to_end, sum(ai_then_cs_count) AS ai_then_cs, sum(direct_cs_count) AS direct_cs, sum(unclassified_count) AS unclassified,
 sum(ai_first_count) AS ai_first_count, sum(ai_first_count) / sum(total_tickets) AS ai_first_rate, sum(reopen_lifetime_numerator) AS reopen_lifetime_numerator,
 sum(reopen_lifetime_denominator) AS reopen_lifetime_denominator, sum(coalesce(round(reopen_7d_rate * reopen_7d_denominator), 0)) AS reopen_7d_numerator,
 coalesce(sum(reopen_7d_denominator), 0) AS reopen_7d_denominator, sum(gt4_turn_with_cs) AS gt4_turn_with_cs, sum(gt4_turn_without_cs) AS gt4_turn_without_cs,
 0 AS max_replies_rule_fired,
 CASE WHEN week_definition = 'mon_fri' THEN 0 ELSE sum(total_tickets) - sum((SELECT f.total_tickets FROM wk f WHERE f.week_definition = 'mon_fri' AND f.cohort_week = wk.cohort_week)) END AS weekend_start_count
 FROM wk WHERE has_data AND cohort_week IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-01-29') GROUP BY week_definition"""))
def week_set_rollup(spark, d):
    return weekly.week_set_rollup(weekly_rows(spark, d), [date(2024, 1, 1), date(2024, 1, 15), date(2024, 1, 29)])


@query("share_with_guard", sql("SELECT week_definition, cohort_week, CASE WHEN total_tickets >= 20 THEN direct_cs_count / total_tickets END AS share FROM wk"))
def share_with_guard(spark, d):
    rows = weekly_rows(spark, d)
    return rows.select("week_definition", "cohort_week", N.share_with_guard(F.col("direct_cs_count"), F.col("total_tickets"), K.MIN_SHARE_SAMPLE).alias("share"))


def _vi_count(c):
    return f"replace(format('{{:,}}', CAST({c} AS BIGINT)), ',', '.')"


def _vi_rate(c):
    return f"(CASE WHEN {c} IS NULL THEN '—' WHEN {c} IN (0, 1) THEN format('{{:.0f}}%', {c} * 100) ELSE replace(format('{{:.1f}}%', round({c} * 100, 1)), '.', ',') END)"


def _vi_avg(c):
    return f"coalesce(replace(format('{{:.2f}}', round({c}, 2)), '.', ','), '—')"


_KPI = """kd AS (
  SELECT s.week_definition, s.cohort_week, m.metric, CASE WHEN s.cohort_status = 'wtd' THEN m.cur2 - m.base2 ELSE m.cur1 - m.base1 END AS delta,
         CASE WHEN s.cohort_status = 'wtd' THEN concat('trung bình cùng kỳ ', c.weeks_used, ' tuần trước') ELSE 'tuần trước' END AS against
  FROM scope s JOIN lpw USING (week_definition) LEFT JOIN wk p ON p.week_definition = s.week_definition AND p.cohort_week = lpw.previous_week
  LEFT JOIN spc c ON c.week_definition = s.week_definition,
  LATERAL (VALUES ('AI First', s.ai_first_rate, p.ai_first_rate, c.ai_first_rate, c.baseline_ai_first_rate),
                  ('Reopen sau AI First', s.reopen_lifetime_rate, p.reopen_lifetime_rate, c.reopen_lifetime_rate, c.baseline_reopen_lifetime_rate)) m(metric, cur1, base1, cur2, base2)
)"""


@query("kpi_delta", sql("""SELECT week_definition, cohort_week, metric, round(delta, 9) AS delta,
 CASE WHEN delta IS NULL THEN NULL WHEN abs(delta) * 100 < 0.5 THEN 'flat' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction,
 CASE WHEN delta IS NULL THEN NULL WHEN abs(delta) * 100 < 0.5 THEN concat(metric, ' gần như không đổi so với ', against, '.')
 ELSE concat(metric, CASE WHEN delta > 0 THEN ' tăng ' ELSE ' giảm ' END, replace(format('{:.1f}', round(abs(delta) * 100, 1)), '.', ','), ' điểm so với ', against, '.') END AS sentence
 FROM kd""", _SAME, _LATEST, _KPI))
def kpi_delta(spark, d):
    base = enriched(spark, d)
    return weekly.kpi_delta(weekly.weekly_summary(base, Fx.WINDOW), weekly.same_period(base, Fx.WINDOW))


_TAIL = f"' trong ' || {_vi_count('total_tickets')} || ' ticket tuần này'"


@query("decision_ledger", sql(f"""SELECT week_definition, cohort_week, 'ai_first' AS cell, ai_first_count AS value, {_vi_count('ai_first_count')} AS value_text,
 {_vi_rate('(ai_first_count / total_tickets)')} || {_TAIL} AS support, 'brand' AS tone FROM scope
 UNION ALL SELECT week_definition, cohort_week, 'transfer', ai_then_cs_count + direct_cs_count, {_vi_count('ai_then_cs_count + direct_cs_count')},
 {_vi_rate('((ai_then_cs_count + direct_cs_count) / total_tickets)')} || {_TAIL}, 'neutral' FROM scope
 UNION ALL SELECT week_definition, cohort_week, 'reopen', reopen_lifetime_numerator, {_vi_count('reopen_lifetime_numerator')} || ' lần',
 {_vi_avg('reopen_lifetime_numerator / nullif(reopen_lifetime_denominator, 0)')} || ' lần/ticket · ' || {_vi_count('reopen_lifetime_denominator')} || ' ticket AI First',
 CASE WHEN reopen_lifetime_numerator > 0 THEN 'warning' ELSE 'neutral' END FROM scope
 UNION ALL SELECT week_definition, cohort_week, 'gt4', gt4_turn_without_cs, {_vi_count('gt4_turn_without_cs')},
 CASE WHEN gt4_turn_without_cs > 0 THEN {_vi_rate('(gt4_turn_without_cs / total_tickets)')} || {_TAIL} END, CASE WHEN gt4_turn_without_cs > 0 THEN 'critical' ELSE 'neutral' END FROM scope""", _LATEST))
def decision_ledger(spark, d):
    return weekly.decision_ledger(weekly_rows(spark, d))


@query("attention_items", sql(f"""SELECT week_definition, 'attention-gt4' AS item, 'critical' AS severity, {_vi_count('gt4_turn_without_cs')} || ' ticket có hơn 3 lượt xử lý mà chưa chuyển CS' AS headline
 FROM scope WHERE gt4_turn_without_cs > 0
 UNION ALL SELECT week_definition, 'attention-gate', 'critical', {_vi_rate('structural_invalid_rate')} || ' bản ghi lỗi cấu trúc, vượt ngưỡng 5%' FROM g2, defs WHERE structural_invalid_rate > 0.05""",
 _DAMAGED, _SELECT, _GATE, _LATEST))
def attention_items(spark, d):
    return weekly.attention_items(weekly_rows(spark, d), weekly.structural_gate(selection(spark, d)))


# ---- segments and transfer reasons --------------------------------------------------------

_SEG = f"""sg AS (
  SELECT week_definition, cohort_week, ai_first, transferred, reopen_lifetime, u.dimension, u.label
  FROM sd, LATERAL (VALUES ('issue_category', issue_category), ('app', app), ('product_code', product_code), ('skill', skill_bucket),
    ('intent', coalesce(safe_intent, '{K.MISSING}')), ('tpe', coalesce(transstatus, '{K.MISSING}')), ('guardrail_rule', coalesce(guardrail_rule, '{K.MISSING}')),
    ('entry_point', entry_point), ('model_core', coalesce(model_core, '{K.MISSING}'))) u(dimension, label)
), sgw AS (
  SELECT week_definition, cohort_week, dimension, label, count(*) AS total, count(*) FILTER (ai_first) AS ai_first, count(*) FILTER (transferred) AS transferred,
         coalesce(sum(reopen_lifetime), 0) AS reopen FROM sg GROUP BY GROUPING SETS ((week_definition, cohort_week, dimension, label), (week_definition, dimension, label))
), sgx AS (
  SELECT week_definition, cohort_week, u.dimension, CASE WHEN u.dimension = 'skill' THEN '{K.NO_SKILL}' ELSE '{K.MISSING}' END AS label, 0 AS total, 0 AS ai_first, 0 AS transferred, 0 AS reopen
  FROM (SELECT week_definition, cohort_week FROM cal UNION ALL SELECT week_definition, NULL FROM defs), (SELECT unnest([{", ".join(repr(s) for s in K.SEGMENTS)}]) AS dimension) u
), segs AS (
  SELECT week_definition, cohort_week, dimension, label, sum(total) AS total, sum(ai_first) AS ai_first, sum(transferred) AS transferred, sum(reopen) AS reopen
  FROM (SELECT * FROM sgw UNION ALL SELECT * FROM sgx) GROUP BY 1, 2, 3, 4
)"""


@query("segment_breakdown", sql("SELECT * FROM segs", _SEG))
def segment_breakdown(spark, d):
    return segments.segment_breakdown(enriched(spark, d), weekly.calendar(spark, Fx.WINDOW))


@query("project_intents", sql("SELECT session_id, safe_intent FROM ens"))
def project_intents(spark, d):
    return segments.project_intents(enriched(spark, d)).select("session_id", "safe_intent")


_SETS = "GROUP BY GROUPING SETS ((week_definition, cohort_week, {k}), (week_definition, {k}))"
_GRAIN = "coalesce(trigger_reason, 'unknown') AS reason, trigger_rule AS rule, trigger_source AS source, trigger_stage AS stage, trigger_skill AS skill"


@query("transfer_triggers", sql(f"""SELECT week_definition, cohort_week, reason, rule, source, stage, skill, count(*) AS count
 FROM (SELECT week_definition, cohort_week, {_GRAIN} FROM sd WHERE transferred) {_SETS.format(k='reason, rule, source, stage, skill')}"""))
def transfer_triggers(spark, d):
    return segments.transfer_triggers(enriched(spark, d))


@query("transfer_guardrails", sql(f"""SELECT week_definition, cohort_week, rule, count(*) AS count
 FROM (SELECT week_definition, cohort_week, unnest(rules) AS rule FROM sd WHERE transferred) {_SETS.format(k='rule')}"""))
def transfer_guardrails(spark, d):
    return segments.transfer_guardrails(enriched(spark, d))


_TPC = f"""tpn AS (SELECT week_definition, cohort_week, p.transstatus, p.step_result, count(*) AS count FROM sd JOIN pairs p USING (session_id) WHERE transferred
 {_SETS.format(k='p.transstatus, p.step_result')}),
tps AS (SELECT t.*, (SELECT arg_min(status, ord) FROM mapping m WHERE m.code = t.transstatus AND (m.step IS NULL OR m.step = t.step_result)) AS status FROM tpn t)"""


@query("transfer_tpe", sql("SELECT * FROM tps", _TPC))
def transfer_tpe(spark, d):
    return segments.transfer_tpe(enriched(spark, d))


@query("transfer_flags", sql("""SELECT week_definition, cohort_week, count(*) AS observed_transfer_denominator, count(*) FILTER (n_steps = 0) AS step_result_missing,
 count(*) FILTER (escalation_guard_blocked) AS escalation_guard_blocked FROM sd WHERE transferred GROUP BY GROUPING SETS ((week_definition, cohort_week), (week_definition))"""))
def transfer_flags(spark, d):
    return segments.transfer_flags(enriched(spark, d))


@query("tpe_option_label", sql("""SELECT transstatus, CASE WHEN count(DISTINCT status) <= 1 THEN
 arg_min(concat(coalesce(status, 'Chưa phân loại'), ' (', transstatus, ' / ', coalesce(step_result, '—'), ')'), (-count, step_result IS NULL, coalesce(step_result, ''))) END AS label
 FROM tps WHERE week_definition = 'mon_sun' AND cohort_week IS NULL GROUP BY transstatus""", _TPC))
def tpe_option_label(spark, d):
    return segments.tpe_option_label(segments.transfer_tpe(enriched(spark, d)).where("week_definition = 'mon_sun' and cohort_week is null"))


@query("coverage_rates", sql(f"""SELECT count(*) FILTER (issue_category <> '{K.MISSING}') / count(*) AS issue_category, count(*) FILTER (app <> '{K.MISSING}') / count(*) AS app,
 count(*) FILTER (n_pairs > 0) / count(*) AS tpe, count(*) FILTER (safe_intent IS NOT NULL) / count(*) AS intent, count(*) FILTER (skill_count > 0) / count(*) AS skill FROM ens"""))
def coverage_rates(spark, d):
    return segments.coverage_rates(enriched(spark, d))


_QUALITY = """qc AS (SELECT data_quality AS quality FROM ses UNION ALL SELECT reason FROM iss1 UNION ALL SELECT reason FROM iss WHERE session_id IS NULL)"""


def _issues(spark, d):
    issues = ingest.quality_issues(damaged(spark, d))
    return ingest.first_issue_per_session(issues), issues.where("session_id is null")


@query("quality_counts", sql("SELECT quality, count(*) AS count FROM qc GROUP BY 1", _DAMAGED, _QUALITY))
def quality_counts(spark, d):
    return segments.quality_counts(Fx.sessions(spark, d), *_issues(spark, d))


@query("quality_sources", sql("SELECT quality FROM qc", _DAMAGED, _QUALITY))
def quality_sources(spark, d):
    return segments.quality_rows(Fx.sessions(spark, d), *_issues(spark, d))


# ---- exports ------------------------------------------------------------------------------


@query("write_weekly_csv", sql(f"SELECT {_WEEKLY} FROM wk WHERE week_definition = 'mon_fri'"))
def write_weekly_csv(spark, d):
    return writers.weekly_csv_rows(weekly_rows(spark, d), "mon_fri")


_CELLS = ", ".join(f"CASE WHEN total_tickets = 0 THEN '—' ELSE {e} END AS \"{n}\"" for n, e in (
    ("AI First", _vi_count("ai_first_count")), ("Tỷ lệ AI First", _vi_rate("ai_first_rate")), ("AI xử lý trọn", _vi_count("ai_end_to_end_count")),
    ("AI trả lời rồi chuyển CS", _vi_count("ai_then_cs_count")), ("Chuyển CS ngay từ đầu", _vi_count("direct_cs_count")),
    ("Tổng chuyển CS", _vi_count("ai_then_cs_count + direct_cs_count")), ("Reopen sau AI First", _vi_count("reopen_lifetime_numerator")),
    ("Tỷ lệ reopen", _vi_rate("reopen_lifetime_rate")), ("AI phản hồi/ticket TB", _vi_avg("ai_reply_mean_ai_first")),
    (">3 lượt xử lý + CS", _vi_count("gt4_turn_with_cs")), (">3 lượt xử lý chưa chuyển", _vi_count("gt4_turn_without_cs")), ("Chưa phân loại", _vi_count("unclassified_count"))))


@query("weekly_report_export", sql(f"""SELECT week_definition, cohort_week, strftime(cohort_week, '%d/%m') || '–' || strftime(cohort_week + INTERVAL 1 DAY * (CASE WHEN week_definition = 'mon_fri' THEN 4 ELSE 6 END), '%d/%m')
 || CASE WHEN cohort_status = 'wtd' THEN ' (WTD)' ELSE '' END AS "Tuần", CASE WHEN total_tickets = 0 THEN 'Không có dữ liệu' ELSE {_vi_count('total_tickets')} END AS "Tổng ticket", {_CELLS} FROM wk"""))
def weekly_report_export(spark, d):
    return weekly.weekly_report_export(weekly_rows(spark, d)).orderBy(F.desc("cohort_week"))


_INVEST = """inv AS (
  SELECT 'eligible' AS "group", session_id, turn0_trace_id AS trace_id, CAST(cohort_week AS VARCHAR) AS cohort_week, outcome, data_quality, coalesce(no_ai_first_reason, '') AS reason,
         CASE WHEN transferred THEN 'not_applicable' ELSE '' END AS business_category, CASE WHEN transferred THEN 'not_applicable' ELSE '' END AS tpe_category,
         CASE WHEN transferred THEN 'not_applicable' ELSE '' END AS guardrail_rule FROM ses
  UNION ALL SELECT 'invalid_keyed', session_id, coalesce(trace_id, ''), '', '', reason, reason, '', '', '' FROM iss1
  UNION ALL SELECT 'unkeyed', '', coalesce(trace_id, ''), '', '', reason, reason, '', '', '' FROM iss WHERE session_id IS NULL
  UNION ALL SELECT selection_group, session_id, '', '', '', selection_group, selection_group, '', '', '' FROM sel WHERE selection_group = 'pre_window_start'
)"""


def investigation(spark, d):
    keyed, unkeyed = _issues(spark, d)
    return writers.investigation_rows(Fx.sessions(spark, d), keyed, unkeyed, selection(spark, d).where("selection_group = 'pre_window_start'"))


@query("investigation_rows", sql("SELECT * FROM inv", _DAMAGED, _SELECT, _INVEST))
def investigation_rows(spark, d):
    return investigation(spark, d)


@query("run_summary", sql("""SELECT 'outcome' AS section, outcome AS name, CAST(count(*) AS DOUBLE) AS value FROM ses GROUP BY 2
 UNION ALL SELECT 'reply_count', CAST(ai_reply_count AS VARCHAR), count(*) FROM ses GROUP BY 2
 UNION ALL SELECT 'quality_reason', data_quality, count(*) FROM (SELECT data_quality FROM ses WHERE data_quality <> 'valid' UNION ALL SELECT reason FROM iss1 UNION ALL SELECT reason FROM iss WHERE session_id IS NULL) GROUP BY 2
 UNION ALL SELECT u.section, u.name, u.value FROM (SELECT count(*) AS n, count(*) FILTER (outcome = 'unclassified') AS un, count(*) FILTER (is_weekend_start) AS we, count(*) FILTER (ai_first) AS ai,
   sum(reopen_lifetime) AS rl, count(reopen_lifetime) AS rd, sum(reopen_within_7d) AS r7, count(reopen_within_7d) AS rd7, sum(control_reopen_within_7d) AS rc, count(control_reopen_within_7d) AS rdc,
   count(*) FILTER (transferred) AS tr FROM ses) s,
   LATERAL (VALUES ('count', 'eligible_ticket_count', n), ('count', 'unclassified_eligible_count', un), ('count', 'weekend_start_count', we), ('ai_first', 'true', ai), ('ai_first', 'false', n - ai),
    ('reopen_lifetime', 'numerator', rl), ('reopen_lifetime', 'denominator', rd), ('reopen_within_7d', 'numerator', r7), ('reopen_within_7d', 'denominator', rd7),
    ('control_within_7d', 'numerator', rc), ('control_within_7d', 'denominator', rdc), ('transfer_coverage', 'transferred', tr)) u(section, name, value)
 UNION ALL SELECT 'count', 'invalid_keyed_session_count', count(*) FROM iss1 UNION ALL SELECT 'count', 'unkeyed_trace_count', count(*) FROM iss WHERE session_id IS NULL
 UNION ALL SELECT 'count', 'pre_window_start_count', count(*) FROM sel WHERE selection_group = 'pre_window_start'""", _DAMAGED, _SELECT))
def run_summary(spark, d):
    keyed, unkeyed = _issues(spark, d)
    return writers.run_summary(Fx.sessions(spark, d), keyed, unkeyed, selection(spark, d).where("selection_group = 'pre_window_start'"))


@query("dashboard_snapshot", sql("""SELECT w.week_definition, w.cohort_week, w.total_tickets, w.ai_first_count, (SELECT count(*) FROM segs s WHERE s.week_definition = w.week_definition AND s.cohort_week = w.cohort_week) AS segment_rows,
 (SELECT sum(total) FROM segs s WHERE s.week_definition = w.week_definition AND s.cohort_week = w.cohort_week AND dimension = 'app') AS app_total FROM wk w""", _SEG))
def dashboard_snapshot(spark, d):
    base = enriched(spark, d)
    cal = weekly.calendar(spark, Fx.WINDOW)
    doc = writers.dashboard_snapshot(weekly.weekly_summary(base, Fx.WINDOW), segments.segment_breakdown(base, cal))
    app = F.aggregate(F.filter("segments", lambda s: s["dimension"] == "app"), F.lit(0).cast("bigint"), lambda a, s: a + s["total"])
    return doc.select("week_definition", "cohort_week", "summary.total_tickets", "summary.ai_first_count", F.size("segments").alias("segment_rows"), app.alias("app_total"))
