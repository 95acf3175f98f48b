"""Queries: quality measures, reconciliation checks, scores, incremental rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import timefns as T
from ..functions import variants as V
from ..operators import csat, enrich, explorer, ingest, quality, reopen, scores, segments, weekly
from ..session import written
from ..streaming import incremental
from ..window import ntz
from . import fixtures as Fx
from . import q_service as S
from .oracle_base import sql
from .q_ingest import _DAMAGED, _SELECT, damaged_payloads, selection, signals
from .q_explain import label_rows
from .q_metrics import _GATE, enriched, weekly_rows
from .registry import ORACLE, query

_P = ("project", "analytics-v1", "v2")


def coverage_parts(spark, d):
    rows = enrich.extract_dimensions(ingest.valid_records(damaged_payloads(spark, d)))
    raw = ingest.filter_ticket_traces(Fx.damaged_traces(spark, d)).select(F.col("sessionId").alias("session_id"))
    return quality.dimension_coverage(rows, raw)


_COVER = """cvf AS (
  SELECT n.session_id, arg_min(CASE WHEN m.k % 3 = 0 THEN 'tranxdetail' WHEN m.k % 3 = 1 THEN 'resultpage' ELSE '<absent>' END, (n.turn, n.ts, n.trace_id)) AS state0,
         arg_min(q.m, (n.turn, n.ts, n.trace_id)) AS first_m, arg_min(m.user_id % 13 <> 0, (n.turn, n.ts, n.trace_id)) AS cat0, arg_min(coalesce(m.tpe_code, ''), (n.turn, n.ts, n.trace_id)) AS code0,
         arg_min(coalesce(m.tpe_status_raw, ''), (n.turn, n.ts, n.trace_id)) AS stat0
  FROM norm n JOIN dmg0 q ON q.seq = n.seq % 1000000000 JOIN tr m ON m.event_id = q.seq WHERE n.reason IS NULL GROUP BY 1
), cvg AS (
  SELECT session_id, CASE WHEN first_m IN (6, 7) THEN '<absent>' ELSE state0 END AS state, cat0 AND first_m NOT IN (6, 7) AS has_category, code0 <> '' AND first_m NOT IN (6, 7) AS has_tpe, code0 AS tpe_code, nullif(stat0, '') AS tpe_status FROM cvf
), den AS (SELECT (SELECT count(DISTINCT sessionid) FROM dmg WHERE m <> 7 AND sessionid IS NOT NULL) + (SELECT count(*) FROM dmg WHERE m <> 7 AND sessionid IS NULL) AS ticket_count),
cvr AS (SELECT den.ticket_count, count(*) AS sessions, count(*) FILTER (has_category) AS c, count(*) FILTER (has_tpe) AS t, count(*) FILTER (state = 'tranxdetail') AS ap, count(*) FILTER (state = 'tranxdetail' AND has_tpe) AS apt,
  count(*) FILTER (state = 'resultpage') AS na, count(*) FILTER (state = '<absent>') AS ab FROM cvg, den GROUP BY 1)"""


@query("dimension_coverage", sql("""SELECT ticket_count, c AS issue_category_present_count, t AS tpe_present_count, ap AS applicable_ticket_count, apt AS applicable_tpe_present, na AS non_applicable_ticket_count,
 ab AS entry_point_absent_count, 0 AS entry_point_null_string_count, 0 AS entry_point_invalid_type_count, ticket_count - sessions AS diagnostic_uninspectable_ticket_count, c / ticket_count AS coverage_issue_category,
 t / ticket_count AS coverage_tpe, coalesce(apt / nullif(ap, 0), 0.0) AS coverage_tpe_applicable, c / ticket_count >= 0.90 AS p0_issue_category_pass, t / ticket_count >= 0.85 AS p0_tpe_pass, c / ticket_count >= 0.90 AND t / ticket_count >= 0.85 AS p0_pass FROM cvr""", _DAMAGED, _COVER))
def dimension_coverage(spark, d):
    return quality.coverage_report(*coverage_parts(spark, d))


@query("category_gaps", sql("""SELECT state, count(*) AS count FROM cvg WHERE NOT has_category GROUP BY 1
 UNION ALL SELECT '<uninspectable>', ticket_count - sessions FROM cvr WHERE ticket_count > sessions""", _DAMAGED, _COVER))
def category_gaps(spark, d):
    return quality.category_gaps(*coverage_parts(spark, d))


@query("unmapped_tpe_codes", sql("SELECT tpe_code, tpe_status, count(*) AS count FROM cvg WHERE has_tpe GROUP BY 1, 2", _DAMAGED, _COVER))
def unmapped_tpe_codes(spark, d):
    return quality.unmapped_codes(coverage_parts(spark, d)[0])


@query("data_quality_score", sql(f"""SELECT score, CASE WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'warning' ELSE 'critical' END AS tone, valid AS structural_valid_rate FROM (
 SELECT floor(100 * (0.4 * (1 - structural_invalid_rate) + 0.2 * c.ic + 0.2 * c.tpe + 0.1 * c.skill + 0.1) + 0.5) AS score, 1 - structural_invalid_rate AS valid FROM g2,
 (SELECT count(*) FILTER (issue_category <> '{K.MISSING}') / count(*) AS ic, count(*) FILTER (n_pairs > 0) / count(*) AS tpe, count(*) FILTER (skill_count > 0) / count(*) AS skill FROM ens) c)""", _DAMAGED, _SELECT, _GATE))
def data_quality_score(spark, d):
    return quality.data_quality_score(segments.coverage_rates(enriched(spark, d)), weekly.structural_gate(selection(spark, d)), F.lit(True))


@query("payload_shape_profile")
def payload_shape_profile(spark, d):
    return quality.payload_shape_profile(Fx.raw_traces(spark, d), "input")


@query("identity_profile", """SELECT 'id' AS path, n AS rows, n AS seen, n AS distinct_values, 0 AS collisions, 0 AS missing, true AS is_key FROM (SELECT count(*) AS n FROM events)
 UNION ALL SELECT 'owner.id', n, s, u, s - u, n - s, false FROM (SELECT count(*) AS n, count(*) FILTER (user_id % 2 = 0) AS s, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS u FROM events)""")
def identity_profile(spark, d):
    made = F.struct(F.col("event_id").alias("id"), F.struct(F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("id"), F.lit("x").alias("name")).alias("owner"))
    rows = Fx.table(spark, d, "events").select(F.parse_json(F.to_json(made)).alias("payload"))
    return quality.identity_profile(rows, "payload")


_PRIVATE = r"(regexp_matches(regexp_replace(regexp_replace({0}, '[\p{{Cf}}\p{{M}}]+', '', 'g'), '\P{{Nd}}+', '', 'g'), '(0|84)[0-9]{{8,10}}') OR regexp_matches(regexp_replace({0}, '[\p{{Cf}}\p{{M}}]+', '', 'g'), '(?i)(^|[^0-9a-f])[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}($|[^0-9a-f])'))"


@query("pii_scan", f"""WITH t AS (SELECT doc_id AS id, nfc_normalize(text) AS text FROM documents)
SELECT id, 'body' AS path, 'identifying_value' AS problem FROM t WHERE {_PRIVATE.format('text')}
UNION ALL SELECT DISTINCT id, 'parts[].line', 'identifying_value' FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE {_PRIVATE.format('line')}
UNION ALL SELECT id, 'more.code', 'identifying_value' FROM t WHERE id % 7 = 0
UNION ALL SELECT id, 'more.title', 'denied_key' FROM t
UNION ALL SELECT id, 'more.0901234567', 'identifying_key' FROM t WHERE id % 5 = 0""")
def pii_scan(spark, d):
    """Every text three ways: a column, the lines in an array of structs, and a payload with a code in other digits."""
    arabic = F.translate(F.concat(F.lit("mã 09-"), F.lpad(F.col("id").cast("string"), 8, "0")), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    payload = F.concat(F.lit('{"title": null, "code": "'), F.when(F.col("id") % 7 == 0, arabic).otherwise("mã 09"), F.when(F.col("id") % 5 == 0, F.lit('", "0901234567": "x"}')).otherwise('"}'))
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line")))
    rows = Fx.texts(spark, d).select("id", F.col("text").alias("body"), lines.alias("parts"), F.parse_json(payload).alias("more"))
    return quality.pii_scan(rows, "id")


@query("disjoint_groups", sql("SELECT session_id, count(DISTINCT selection_group) AS groups FROM (SELECT session_id, selection_group FROM sel UNION ALL SELECT session_id, 'extra' FROM sel WHERE CAST(session_id AS BIGINT) % 7 = 0) WHERE selection_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT selection_group) > 1", _DAMAGED, _SELECT))
def disjoint_groups(spark, d):
    rows = selection(spark, d)
    return quality.disjoint_groups(rows.unionByName(rows.where("cast(session_id as bigint) % 7 = 0").select("session_id", F.lit("extra").alias("selection_group"))))


_WEEK_SCOPE = "concat(week_definition, '/', coalesce(CAST(cohort_week AS VARCHAR), 'all'))"


def _check_rows(source: str, scope: str, items: dict[str, tuple[str, str]]) -> str:
    """Check rows from the rows of `source`: name -> (expected, actual)."""
    values = ", ".join(f"('{name}', CAST({e} AS DOUBLE), CAST({a} AS DOUBLE))" for name, (e, a) in items.items())
    return f"SELECT u.c AS \"check\", {scope} AS scope, u.e AS expected, u.a AS actual, u.e IS NOT DISTINCT FROM u.a AS ok FROM {source}, LATERAL (VALUES {values}) u(c, e, a)"


def _none_broken(*names: str) -> str:
    return f"SELECT u.c AS \"check\", 'all' AS scope, 0.0 AS expected, 0.0 AS actual, true AS ok FROM (VALUES {', '.join(f'({n!r})' for n in names)}) u(c)"


_SESSION_RULES = ("session_unique", "weekend_flag", "in_reporting_range", "transfer_set", "rule_scalar")


@query("session_checks", sql(_none_broken(*_SESSION_RULES, "groups_disjoint", "eligible_is_analyzed")))
def session_checks(spark, d):
    base, chosen = enriched(spark, d), selection(spark, d)
    kept = base.join(chosen.where("selection_group = 'eligible'").select("session_id"), "session_id", "left_semi")
    known = chosen.join(kept.select("session_id"), "session_id", "left_semi").unionByName(chosen.where("selection_group <> 'eligible'"))
    return quality.session_checks(kept, known)


@query("weekly_checks", sql("""SELECT u.c AS "check", concat(week_definition, '/', CAST(cohort_week AS VARCHAR)) AS scope, u.e AS expected, u.e AS actual, true AS ok FROM wk,
 LATERAL (VALUES ('ai_first_is_sum', CAST(ai_first_count AS DOUBLE)), ('outcomes_close', total_tickets), ('gt4_within_total', 1), ('has_data_matches', CASE WHEN has_data THEN 1 ELSE 0 END), ('ai_rate_is_division', ai_first_rate),
 ('total_recount', total_tickets), ('reopen_recount', reopen_lifetime_numerator)) u(c, e)"""))
def weekly_checks(spark, d):
    return quality.weekly_checks(weekly_rows(spark, d), enriched(spark, d))


_SUMMED = ("eligible_ticket_count", "transfer_total", "reopen_lifetime_numerator")
_VIEW_CHECKS = _check_rows(f"({ORACLE['view_totals']}) v", _WEEK_SCOPE, {
    "outcomes_close": ("eligible_ticket_count", " + ".join(K.OUTCOMES)), "ai_first_is_sum": ("ai_end_to_end + ai_then_cs", "ai_first_count"),
    "transfer_is_sum": ("ai_then_cs + direct_cs", "transfer_total"), "gt4_is_sum": ("gt4_turn_with_cs + gt4_turn_without_cs", "gt4_turn_total")}) + " UNION ALL " + _check_rows(
    "(SELECT week_definition, " + ", ".join(f"sum({c}) FILTER (cohort_week IS NULL) AS t_{c}, sum({c}) FILTER (cohort_week IS NOT NULL) AS w_{c}" for c in _SUMMED)
    + f" FROM ({ORACLE['view_totals']}) GROUP BY 1) s", "week_definition", {f"weeks_add_up_{c}": (f"t_{c}", f"w_{c}") for c in _SUMMED})


@query("view_checks", _VIEW_CHECKS)
def view_checks(spark, d):
    return quality.view_checks(weekly.view_totals(enriched(spark, d)))


_SEGMENT_CHECKS = _check_rows(f"""(SELECT s.week_definition, s.cohort_week, s.dimension, sum(total) AS total, max(CASE WHEN label IN ('{K.MISSING}', '{K.NO_SKILL}') THEN 1 ELSE 0 END) AS missing,
   (SELECT max(eligible_ticket_count) FROM ({ORACLE['view_totals']}) v WHERE v.week_definition = s.week_definition AND v.cohort_week IS NOT DISTINCT FROM s.cohort_week) AS n
   FROM ({ORACLE['segment_breakdown']}) s GROUP BY 1, 2, 3) p""", f"concat({_WEEK_SCOPE}, '/', dimension)", {"dimension_closes": ("coalesce(n, 0)", "total"), "missing_bucket": ("1", "missing")}) + " UNION ALL " + _check_rows(
    f"""(SELECT week_definition, dimension, label, sum(total) FILTER (cohort_week IS NULL) AS t, coalesce(sum(total) FILTER (cohort_week IS NOT NULL), 0) AS w FROM ({ORACLE['segment_breakdown']}) GROUP BY 1, 2, 3) l""",
    "concat(week_definition, '/', dimension, '/', label)", {"weeks_add_up": ("t", "w")})


@query("segment_checks", _SEGMENT_CHECKS)
def segment_checks(spark, d):
    base = enriched(spark, d)
    return quality.segment_checks(segments.segment_breakdown(base, weekly.calendar(spark, Fx.WINDOW)), weekly.view_totals(base))


def _rolled(source: str, keys: str, scope: str, name: str) -> str:
    return _check_rows(f"(SELECT week_definition, {keys}, coalesce(sum(count) FILTER (cohort_week IS NULL), 0) AS t, coalesce(sum(count) FILTER (cohort_week IS NOT NULL), 0) AS w FROM ({ORACLE[source]}) GROUP BY ALL) r", scope, {name: ("t", "w")})


_GRAIN = "reason, rule, source, stage, skill"
_TRANSFER_CHECKS = _check_rows(f"""(SELECT f.*, (SELECT sum(count) FROM ({ORACLE['transfer_triggers']}) t WHERE t.week_definition = f.week_definition AND t.cohort_week IS NOT DISTINCT FROM f.cohort_week) AS n,
   (SELECT max(count) FROM ({ORACLE['transfer_guardrails']}) g WHERE g.week_definition = f.week_definition AND g.cohort_week IS NOT DISTINCT FROM f.cohort_week) AS top FROM ({ORACLE['transfer_flags']}) f) j""", _WEEK_SCOPE, {
    "triggers_partition": ("observed_transfer_denominator", "coalesce(n, 0)"), "rules_within_total": ("1", "CASE WHEN coalesce(top, 0) <= observed_transfer_denominator THEN 1 ELSE 0 END"),
    "flags_within_total": ("1", "CASE WHEN greatest(step_result_missing, escalation_guard_blocked) <= observed_transfer_denominator THEN 1 ELSE 0 END")}) + " UNION ALL " + " UNION ALL ".join([
    _rolled("transfer_triggers", _GRAIN, "concat(week_definition, '/', " + ", '/', ".join(f"coalesce({g}, '-')" for g in _GRAIN.split(", ")) + ")", "trigger_weeks_add_up"),
    _rolled("transfer_guardrails", "rule", "concat(week_definition, '/', rule)", "rule_weeks_add_up"), _none_broken("trigger_grain")])


@query("transfer_checks", _TRANSFER_CHECKS)
def transfer_checks(spark, d):
    base = enriched(spark, d)
    return quality.transfer_checks(segments.transfer_triggers(base), segments.transfer_flags(base), segments.transfer_guardrails(base))


_CSAT_CHECKS = _check_rows(f"({ORACLE['csat_weekly']}) w", "concat(week_definition, '/', CAST(cohort_week AS VARCHAR), '/', grain, '/', dimension, '/', value)", {"buckets_close": ("ticket_count", "positive + neutral + negative")}) + " UNION ALL " + _check_rows(
    "(SELECT week_definition, cohort_week, grain, " + ", ".join(f"sum(ticket_count) FILTER (dimension = '{x}') AS n_{x}" for x in ("all", "outcome", "skill", "issue_category")) + f" FROM ({ORACLE['csat_weekly']}) GROUP BY 1, 2, 3) p",
    "concat(week_definition, '/', CAST(cohort_week AS VARCHAR), '/', grain)", {f"{x}_closes": ("n_all", f"n_{x}") for x in ("outcome", "skill", "issue_category")}) + " UNION ALL " + _none_broken(
    "feedback_in_range", "feedback_latest", "feedback_numbered_once", "feedback_total_recount")


def _csat_inputs(spark, d):
    """The report, the comments and the matched answers, each written: every check reads them again."""
    rows = written(S.matched(spark, d), "csat-matched")
    feedback = csat.feedback_entries(csat.csat_to_tickets(S.answers(spark, d), enriched(spark, d)))
    return written(csat.csat_weekly(rows), "csat-weekly"), written(feedback, "csat-feedback"), rows


@query("csat_checks", _CSAT_CHECKS)
def csat_checks(spark, d):
    return quality.csat_checks(*_csat_inputs(spark, d))


_COVERAGE_CHECKS = _check_rows(f"({ORACLE['entry_coverage_weekly']}) e", _WEEK_SCOPE, {
    "statuses_close": ("ticket_count", " + ".join(K.ENTRY_STATUSES)), "human_split_closes": ("not_observed_invoked", "not_observed_human_replied + not_observed_no_human_reply")}) + " UNION ALL " + _check_rows(
    f"({ORACLE['reconciliation_weekly']}) r", _WEEK_SCOPE, {
        "checked_within_population": ("1", "CASE WHEN checked_ticket_count + unresolved_ticket_count <= ai_end_to_end THEN 1 ELSE 0 END"),
        "mismatch_is_division": ("human_replied_after_ai / nullif(checked_ticket_count, 0)", "mismatch_rate")})


def _coverage_inputs(spark, d):
    return S.covered_weeks(spark, d), S.reconciled_weeks(spark, d)


@query("coverage_checks", _COVERAGE_CHECKS)
def coverage_checks(spark, d):
    return quality.coverage_checks(*_coverage_inputs(spark, d))


_PERIOD_CHECKS = _check_rows(f"({ORACLE['same_period']}) p", _WEEK_SCOPE, {
    "within_whole_week": ("1", "1"), "ai_rate_is_division": ("coalesce(ai_first_count / nullif(total_tickets, 0), 0.0)", "ai_first_rate"),
    "reopen_rate_is_division": ("reopen_lifetime_numerator / nullif(reopen_lifetime_denominator, 0)", "reopen_lifetime_rate"), "baseline_weeks": ("1", "CASE WHEN weeks_used BETWEEN 2 AND 4 THEN 1 ELSE 0 END"),
    "baseline_weeks_recount": ("weeks_used", "weeks_used"), "baseline_ai_recount": ("1", "1"), "baseline_reopen_recount": ("1", "1")})


def _period_inputs(spark, d):
    rows = Fx.sessions(spark, d)
    return weekly.same_period(rows, Fx.WINDOW), weekly_rows(spark, d), weekly.same_days_of_weeks(rows, Fx.WINDOW)


@query("period_checks", _PERIOD_CHECKS)
def period_checks(spark, d):
    return quality.period_checks(*_period_inputs(spark, d))


_REASON_CHECKS = _check_rows(f"({ORACLE['reopen_reason_coverage']}) c", _WEEK_SCOPE, {
    "abstained_within_labeled": ("1", "CASE WHEN abstained <= labeled THEN 1 ELSE 0 END"),
    "no_rate_without_denominator": ("CASE WHEN direct_cs_denominator > 0 THEN 1 ELSE 0 END", "CASE WHEN direct_cs_reopen_7d_rate IS NOT NULL THEN 1 ELSE 0 END")})


def _reason_inputs(spark, d):
    return reopen.reopen_reason_coverage(reopen.label_status(label_rows(spark, d)), Fx.sessions(spark, d), weekly.calendar(spark, Fx.WINDOW))


@query("reason_checks", _REASON_CHECKS)
def reason_checks(spark, d):
    return quality.reason_checks(_reason_inputs(spark, d))


_TICKET_RULES = ("ticket_id_safe", "outcome_known", "gt4_follows_turns", "week_is_monday", "reason_with_transfer", "reopen_with_ai_first", "intent_frequency", "ticket_unique")


@query("ticket_checks", sql(_none_broken(*_TICKET_RULES)))
def ticket_checks(spark, d):
    return quality.ticket_checks(S.tickets(spark, d))


_REPORT_CHECKS = _check_rows(f"({ORACLE['dimension_coverage']}) r", "'all'", {
    "populations_close": ("ticket_count", "applicable_ticket_count + non_applicable_ticket_count + entry_point_absent_count + diagnostic_uninspectable_ticket_count"),
    "sessions_within_denominator": ("1", "1"), "category_is_division": ("issue_category_present_count / ticket_count", "coverage_issue_category"), "tpe_is_division": ("tpe_present_count / ticket_count", "coverage_tpe"),
    "applicable_is_division": ("coalesce(applicable_tpe_present / nullif(applicable_ticket_count, 0), 0.0)", "coverage_tpe_applicable")})


@query("coverage_report_checks", _REPORT_CHECKS)
def coverage_report_checks(spark, d):
    return quality.coverage_report_checks(quality.coverage_report(*coverage_parts(spark, d)))


@query("coverage_report_checks_broken", " UNION ALL ".join(f"SELECT '{f}' AS family, '{c}' AS \"check\", 'all' AS scope" for f, c in (
    ("absent", "populations_close"), ("unread", "populations_close"), ("unread", "sessions_within_denominator"), ("category", "category_is_division"), ("tpe", "tpe_is_division"), ("applicable", "applicable_is_division"))))
def coverage_report_checks_broken(spark, d):
    report = quality.coverage_report(*coverage_parts(spark, d))
    more = lambda column, by: report.withColumn(column, F.col(column) + by)
    cases = {"absent": more("entry_point_absent_count", 1), "unread": more("diagnostic_uninspectable_ticket_count", -(1 << 40)), "category": more("issue_category_present_count", 1),
             "tpe": more("tpe_present_count", 1), "applicable": more("coverage_tpe_applicable", 0.25)}
    return reduce(DataFrame.unionByName, [_failing(n, quality.coverage_report_checks(r)) for n, r in cases.items()])


# Every check once with an input that breaks it: one number of one row is off, a row is there twice or
# missing. The SQL says which checks must fail, and where; nothing else may.

_ONE = "2024-01-08"


def _off(rows, column, by=1, week=_ONE, definition="mon_sun", **where):
    """One cell of a report changed."""
    here = (F.col("week_definition") == definition) & (F.col("cohort_week").isNull() if week is None else F.col("cohort_week") == F.lit(week).cast("date"))
    for name, value in where.items():
        here = here & (F.col(name) == value)
    return rows.withColumn(column, F.when(here, F.col(column) + by).otherwise(F.col(column)))


def _failing(family: str, checks):
    return checks.where("not ok").select(F.lit(family).alias("family"), "check", "scope")


def _expect(family: str, scopes: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{family}' AS family, '{name}' AS \"check\", '{scope}' AS scope" for name, scope in scopes.items())


_AT = f"mon_sun/{_ONE}"


@query("weekly_checks_broken", _expect("ai", {"ai_first_is_sum": _AT, "ai_rate_is_division": _AT}) + " UNION ALL " + _expect("total", {"outcomes_close": _AT, "ai_rate_is_division": _AT, "total_recount": _AT})
       + " UNION ALL " + _expect("gt4", {"gt4_within_total": _AT}) + " UNION ALL " + _expect("reopen", {"reopen_recount": _AT}) + " UNION ALL " + _expect("data", {"has_data_matches": _AT}))
def weekly_checks_broken(spark, d):
    rows, base = weekly_rows(spark, d), enriched(spark, d)
    flipped = rows.withColumn("has_data", F.col("has_data") != ((F.col("week_definition") == "mon_sun") & (F.col("cohort_week") == F.lit(_ONE).cast("date"))))
    cases = {"ai": _off(rows, "ai_first_count"), "total": _off(rows, "total_tickets"), "gt4": _off(rows, "gt4_turn_with_cs", 1 << 40), "reopen": _off(rows, "reopen_lifetime_numerator"), "data": flipped}
    return reduce(DataFrame.unionByName, [_failing(n, quality.weekly_checks(r, base)) for n, r in cases.items()])


@query("view_checks_broken", " UNION ALL ".join([
    _expect("eligible", {"outcomes_close": _AT, "weeks_add_up_eligible_ticket_count": "mon_sun"}), _expect("ai", {"ai_first_is_sum": _AT}),
    _expect("transfer", {"transfer_is_sum": _AT, "weeks_add_up_transfer_total": "mon_sun"}), _expect("gt4", {"gt4_is_sum": _AT}), _expect("reopen", {"weeks_add_up_reopen_lifetime_numerator": "mon_sun"})]))
def view_checks_broken(spark, d):
    rows = weekly.view_totals(enriched(spark, d))
    cases = {"eligible": "eligible_ticket_count", "ai": "ai_first_count", "transfer": "transfer_total", "gt4": "gt4_turn_total", "reopen": "reopen_lifetime_numerator"}
    return reduce(DataFrame.unionByName, [_failing(n, quality.view_checks(_off(rows, c))) for n, c in cases.items()])


@query("segment_checks_broken", " UNION ALL ".join([
    _expect("label", {"dimension_closes": f"{_AT}/issue_category", "weeks_add_up": "mon_sun/issue_category/Nạp tiền"}), _expect("missing", {"missing_bucket": f"{_AT}/issue_category", "dimension_closes": f"{_AT}/issue_category", "weeks_add_up": f"mon_sun/issue_category/{K.MISSING}"})]))
def segment_checks_broken(spark, d):
    base = enriched(spark, d)
    rows, views = segments.segment_breakdown(base, weekly.calendar(spark, Fx.WINDOW)), weekly.view_totals(base)
    gone = (F.col("week_definition") == "mon_sun") & (F.col("cohort_week") == F.lit(_ONE).cast("date")) & (F.col("dimension") == "issue_category") & (F.col("label") == K.MISSING)
    cases = {"label": _off(rows, "total", dimension="issue_category", label="Nạp tiền"), "missing": rows.where(~F.coalesce(gone, F.lit(False)))}
    return reduce(DataFrame.unionByName, [_failing(n, quality.segment_checks(r, views)) for n, r in cases.items()])


@query("transfer_checks_broken", " UNION ALL ".join([
    _expect("flags", {"flags_within_total": _AT}), _expect("rules", {"rules_within_total": _AT, "rule_weeks_add_up": "mon_sun/cs_escalation"}), _expect("total", {"triggers_partition": _AT}),
    _expect("twice", {"trigger_grain": "all", "triggers_partition": "mon_sun/all", "trigger_weeks_add_up": "mon_sun/unknown/-/-/-/-"})]))
def transfer_checks_broken(spark, d):
    base = enriched(spark, d)
    triggers, flags, guards = segments.transfer_triggers(base), segments.transfer_flags(base), segments.transfer_guardrails(base)
    again = triggers.where("week_definition = 'mon_sun' and cohort_week is null and reason = 'unknown' and rule is null")
    cases = {"flags": (triggers, _off(flags, "step_result_missing", 1 << 40), guards), "rules": (triggers, flags, _off(guards, "count", 1 << 40, rule="cs_escalation")),
             "total": (triggers, _off(flags, "observed_transfer_denominator"), guards), "twice": (triggers.unionByName(again), flags, guards)}
    return reduce(DataFrame.unionByName, [_failing(n, quality.transfer_checks(*r)) for n, r in cases.items()])


@query("csat_checks_broken", " UNION ALL ".join([
    _expect("bucket", {"buckets_close": f"{_AT}/ticket/all/all"}), _expect("total", {"buckets_close": f"{_AT}/ticket/all/all", **{f"{x}_closes": f"{_AT}/ticket" for x in ("outcome", "skill", "issue_category")}}),
    _expect("number", {"feedback_in_range": "all", "feedback_latest": "all"}), _expect("twice", {"feedback_numbered_once": "all"}), _expect("lost", {"feedback_total_recount": "all"})]))
def csat_checks_broken(spark, d):
    rows, feedback, matched = _csat_inputs(spark, d)
    last = F.col("is_latest_for_ticket")
    cases = {"bucket": (_off(rows, "positive", grain="ticket", dimension="all"), feedback, matched), "total": (_off(rows, "ticket_count", grain="ticket", dimension="all"), feedback, matched),
             "number": (rows, feedback.withColumn("response_number", F.when(last, F.col("response_number") + 1).otherwise(F.col("response_number"))), matched),
             "twice": (rows, feedback.unionByName(feedback.where(last)), matched), "lost": (rows, feedback, matched.unionByName(matched))}
    return reduce(DataFrame.unionByName, [_failing(n, quality.csat_checks(*r)) for n, r in cases.items()])


@query("coverage_checks_broken", " UNION ALL ".join([
    _expect("status", {"statuses_close": _AT}), _expect("human", {"human_split_closes": _AT}), _expect("checked", {"checked_within_population": _AT}),
    _expect("rate", {"mismatch_is_division": _AT})]))
def coverage_checks_broken(spark, d):
    entry, rec = _coverage_inputs(spark, d)
    here = (F.col("week_definition") == "mon_sun") & (F.col("cohort_week") == F.lit(_ONE).cast("date"))
    cases = {"status": (_off(entry, "unresolved"), rec), "human": (_off(entry, "not_observed_human_replied"), rec), "checked": (entry, _off(rec, "unresolved_ticket_count", 1 << 40)),
             "rate": (entry, rec.withColumn("mismatch_rate", F.when(here, 0.123).otherwise(F.col("mismatch_rate"))))}
    return reduce(DataFrame.unionByName, [_failing(n, quality.coverage_checks(*r)) for n, r in cases.items()])


_RUN = "mon_sun/2024-01-29"


@query("period_checks_broken", " UNION ALL ".join([
    _expect("total", {"within_whole_week": _RUN, "ai_rate_is_division": _RUN}), _expect("reopen", {"reopen_rate_is_division": _RUN}), _expect("weeks", {"baseline_weeks": _RUN, "baseline_weeks_recount": _RUN}),
    _expect("means", {"baseline_ai_recount": _RUN, "baseline_reopen_recount": _RUN})]))
def period_checks_broken(spark, d):
    period, whole, sliced = _period_inputs(spark, d)
    off = lambda c, by: _off(period, c, by, "2024-01-29")
    means = _off(off("baseline_ai_first_rate", 0.001), "baseline_reopen_lifetime_rate", 0.001, "2024-01-29")
    cases = {"total": off("total_tickets", 1 << 40), "reopen": off("reopen_lifetime_numerator", 1), "weeks": off("weeks_used", 4), "means": means}
    return reduce(DataFrame.unionByName, [_failing(n, quality.period_checks(r, whole, sliced)) for n, r in cases.items()])


@query("row_checks_broken", " UNION ALL ".join([
    *[_expect(f"session {name}", {name: "all"}) for name in ("weekend_flag", "in_reporting_range", "transfer_set", "session_unique", "groups_disjoint", "eligible_is_analyzed")],
    *[_expect(f"ticket {name}", {name: "all"}) for name in ("ticket_id_safe", "outcome_known", "gt4_follows_turns", "week_is_monday", "reason_with_transfer", "reopen_with_ai_first", "ticket_unique")],
    _expect("reason states", {"abstained_within_labeled": _AT}), _expect("reason rate", {"no_rate_without_denominator": _AT})]))
def row_checks_broken(spark, d):
    ses, tickets, reasons = enriched(spark, d).drop("guardrail_rule"), S.tickets(spark, d).where("ticket_id is not null"), _reason_inputs(spark, d)
    chosen = ses.select("session_id", F.lit("eligible").alias("selection_group"))
    one = lambda rows, key: rows.where(F.col(key) == rows.agg(F.min(key)).scalar())
    first = lambda rows, key, column, value: rows.withColumn(column, F.when(F.col(key) == rows.agg(F.min(key).alias("m")).scalar(), value).otherwise(F.col(column)))
    broken = {
        "weekend_flag": (first(ses, "session_id", "is_weekend_start", ~F.col("is_weekend_start")), chosen), "in_reporting_range": (first(ses, "session_id", "cohort_status", F.lit("later")), chosen),
        "transfer_set": (first(ses, "session_id", "transferred", ~F.col("transferred")), chosen), "session_unique": (ses.unionByName(one(ses, "session_id")), chosen),
        "groups_disjoint": (ses, chosen.unionByName(one(chosen, "session_id").withColumn("selection_group", F.lit("invalid_keyed")))),
        "eligible_is_analyzed": (ses, chosen.unionByName(one(chosen, "session_id").withColumn("session_id", F.lit("nobody"))))}
    shown = {
        "ticket_id_safe": ("ticket_id", F.lit("0901234567")), "outcome_known": ("outcome", F.lit("lost")), "gt4_follows_turns": ("gt4_turn", ~F.col("gt4_turn")), "week_is_monday": ("cohort_week", F.date_add("cohort_week", 1)),
        "reason_with_transfer": ("transfer_reason", F.when(F.col("transfer_reason").isNull(), "unknown")), "reopen_with_ai_first": ("ai_first", ~F.col("ai_first"))}
    out = [_failing(f"session {n}", quality.session_checks(*r)) for n, r in broken.items()]
    out += [_failing(f"ticket {n}", quality.ticket_checks(first(tickets, "ticket_id", c, v))) for n, (c, v) in shown.items()]
    out.append(_failing("ticket ticket_unique", quality.ticket_checks(tickets.unionByName(one(tickets, "ticket_id")))))
    out.append(_failing("reason states", quality.reason_checks(_off(reasons, "abstained", 1 << 40))))
    out.append(_failing("reason rate", quality.reason_checks(_off(reasons, "direct_cs_denominator", -(1 << 40)))))
    return reduce(DataFrame.unionByName, out)


# ---- scores -------------------------------------------------------------------------------


@Fx.plan_once
def session_scores_rows(spark, d):
    gate = weekly.structural_gate(Fx.sessions(spark, d).select("session_id", F.lit("eligible").alias("selection_group")))
    return scores.session_scores(Fx.sessions(spark, d), gate, *_P)


@query("session_scores", sql("""SELECT session_id, u.name, u.text_value, u.number_value, u.data_type FROM ses, LATERAL (VALUES
 ('ai_first', NULL, CAST(CASE WHEN ai_first THEN 1 ELSE 0 END AS DOUBLE), 'NUMERIC', true), ('ai_reply_count', NULL, ai_reply_count, 'NUMERIC', true), ('ticket_data_quality', data_quality, NULL, 'CATEGORICAL', true),
 ('no_ai_first_reason', no_ai_first_reason, NULL, 'CATEGORICAL', NOT ai_first AND no_ai_first_reason IS NOT NULL), ('ticket_outcome', outcome, NULL, 'CATEGORICAL', outcome <> 'unclassified'),
 ('reopen_lifetime', NULL, reopen_lifetime, 'NUMERIC', ai_first), ('reopen_within_7d', NULL, reopen_within_7d, 'NUMERIC', ai_first), ('transfer_business_category', 'not_applicable', NULL, 'CATEGORICAL', transferred),
 ('transfer_tpe_group', 'not_applicable', NULL, 'CATEGORICAL', transferred), ('transfer_guardrail_rule', 'not_applicable', NULL, 'CATEGORICAL', transferred)) u(name, text_value, number_value, data_type, here) WHERE here"""))
def session_scores(spark, d):
    return session_scores_rows(spark, d).select("session_id", "name", "text_value", "number_value", "data_type")


@query("weekly_scores", sql("""SELECT concat('weekly-cs-summary:', CAST(cohort_week AS VARCHAR)) AS session_id, u.name, u.v AS number_value, u.n AS numerator, u.dn AS denominator FROM wk, LATERAL (VALUES
 ('weekly_cs_total_tickets', CAST(total_tickets AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('weekly_cs_ai_first_count', ai_first_count, NULL, NULL), ('weekly_cs_ai_first_rate', ai_first_rate, ai_first_count, total_tickets),
 ('weekly_cs_ai_end_to_end_count', ai_end_to_end_count, NULL, NULL), ('weekly_cs_ai_then_cs_count', ai_then_cs_count, NULL, NULL), ('weekly_cs_direct_cs_count', direct_cs_count, NULL, NULL), ('weekly_cs_unclassified_count', unclassified_count, NULL, NULL),
 ('weekly_cs_reopen_7d_rate', reopen_7d_rate, round(reopen_7d_rate * reopen_7d_denominator), reopen_7d_denominator), ('weekly_cs_reopen_7d_denominator', reopen_7d_denominator, NULL, NULL),
 ('weekly_cs_reopen_lifetime_rate', reopen_lifetime_rate, round(reopen_lifetime_rate * ai_first_count), ai_first_count), ('weekly_cs_ai_reply_p50', ai_reply_p50, NULL, NULL), ('weekly_cs_ai_reply_p90', ai_reply_p90, NULL, NULL),
 ('weekly_cs_ai_reply_max', ai_reply_max, NULL, NULL)) u(name, v, n, dn) WHERE week_definition = 'mon_sun' AND u.v IS NOT NULL"""))
def weekly_scores(spark, d):
    gate = weekly.structural_gate(Fx.sessions(spark, d).select("session_id", F.lit("eligible").alias("selection_group")))
    return scores.weekly_scores(weekly_rows(spark, d), gate, *_P).select("session_id", "name", "number_value", "numerator", "denominator")


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST('0x' || substr({h}, 17, 1) AS BIGINT) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query("stable_score_id", f"SELECT {_uuid5('id_text')} AS id, name, session_id FROM (SELECT *, '{'|'.join(_P)}|' || session_id || '|' || name AS id_text FROM ({ORACLE['session_scores']}))")
def stable_score_id(spark, d):
    return session_scores_rows(spark, d).select("id", "name", "session_id")


@query("score_event_id")
def score_event_id(spark, d):
    return session_scores_rows(spark, d).select("id", "event_id")


@query("score_manifest", ORACLE["session_scores"].replace("SELECT session_id, u.name", "SELECT strftime(score_ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, session_id, u.name"))
def score_manifest(spark, d):
    return scores.score_manifest(session_scores_rows(spark, d)).select("timestamp", "session_id", "name", "text_value", "number_value", "data_type")


@query("acknowledge_check", sql("""SELECT trace_id AS id, CASE WHEN event_id % 10 = 3 THEN 0 ELSE 1 END AS requested, CASE WHEN event_id % 10 = 7 THEN 0 WHEN event_id % 10 = 5 THEN 2 ELSE 1 END AS acknowledged FROM tr WHERE event_id % 10 IN (3, 5, 7)"""))
def acknowledge_check(spark, d):
    ids = Fx.table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 10).alias("m"))
    got = ids.where("m <> 7").select("id")
    return scores.acknowledge_check(ids.where("m <> 3").select("id"), got.unionByName(ids.where("m = 5").select("id")))


_PIECES = [f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT))" for i in range(4)]


@query("inventory_fingerprint", sql(f"""SELECT 'sha256:' || sha256(string_agg(line, chr(10) ORDER BY part)) AS fingerprint, CAST(sum(n) AS BIGINT) AS tickets FROM (
 SELECT part, count(*) AS n, concat_ws('/', part, count(*), {', '.join(_PIECES)}) AS line FROM (
  SELECT CAST('0x' || substr(sha256(ticket_id), 1, 8) AS BIGINT) % 4096 AS part, sha256(ticket_id || chr(31) || strftime(created_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(created_ts) % 1000000 > 0 THEN '.' || lpad(CAST(microsecond(created_ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z') AS h FROM inv0) GROUP BY part)""", S._MSG, S._COV))
def inventory_fingerprint(spark, d):
    return scores.inventory_fingerprint(Fx.inventory(spark, d, Fx.sessions(spark, d)))


# ---- incremental rules --------------------------------------------------------------------


@query("week_needs_fetch", sql("""SELECT DISTINCT cohort_week, CASE WHEN cohort_week = DATE '2024-01-22' THEN true ELSE DATE '2024-01-31' <= cohort_week + INTERVAL 20 DAY AND TIMESTAMP '2024-01-31 03:00:00' >= cohort_week + INTERVAL 9 DAY + INTERVAL 6 HOUR END AS needs_fetch FROM ses"""))
def week_needs_fetch(spark, d):
    week = F.col("cohort_week")
    fetched = F.when(week != F.lit("2024-01-22").cast("date"), F.date_add(week, 9).cast("timestamp_ntz"))
    rows = Fx.sessions(spark, d).select("cohort_week").distinct()
    return rows.select("cohort_week", T.week_needs_fetch(week, fetched, ntz(Fx.WINDOW.as_of_utc), 14, 6).alias("needs_fetch"))


@query("all_or_nothing_missing_lane", sql("SELECT 0 AS signals, 'partial' AS status"))
def all_or_nothing_missing_lane(spark, d):
    seen = Fx.observations(spark, d).where(F.col("name") != K.OBS_SKILL).select("name", F.lit(True).alias("complete"))
    kept, status = incremental.all_or_nothing_enrichment(signals(spark, d), incremental.lane_status(seen, K.LANES))
    return kept.agg(F.count(F.lit(1)).alias("signals")).withColumn("status", status.scalar())


@query("all_or_nothing_enrichment", sql("""SELECT u.kind, count(*) AS signals, 'complete' AS status FROM ob, LATERAL (VALUES ('intent', intent IS NOT NULL), ('skill', skill IS NOT NULL), ('tpe', transstatus IS NOT NULL), ('history', history), ('event', rule IS NOT NULL), ('rule', rule IS NOT NULL)) u(kind, here)
 WHERE here GROUP BY 1"""))
def all_or_nothing_enrichment(spark, d):
    seen = Fx.observations(spark, d).select("name", F.lit(True).alias("complete"))
    kept, status = incremental.all_or_nothing_enrichment(signals(spark, d), incremental.lane_status(seen, K.LANES))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("signals")).withColumn("status", status.scalar())


@query("all_or_nothing_partial", sql("SELECT 0 AS signals, 'partial' AS status"))
def all_or_nothing_partial(spark, d):
    lanes = Fx.observations(spark, d).select("name").distinct().select("name", (F.col("name") != K.OBS_SKILL).alias("complete"))
    kept, status = incremental.all_or_nothing_enrichment(signals(spark, d), lanes)
    return kept.agg(F.count(F.lit(1)).alias("signals")).withColumn("status", status.scalar())


@query("latest_response", sql("SELECT ticket_id, arg_max(satisfaction_bucket, (responded_ts, response_key)) AS satisfaction_bucket FROM cs GROUP BY 1", S._CSAT))
def latest_response(spark, d):
    return csat.latest_response(S.plain_answers(spark, d)).select("ticket_id", "satisfaction_bucket")
