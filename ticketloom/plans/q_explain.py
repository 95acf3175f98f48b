"""Queries: escalation explanation and reopen-reason work."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import variants as V
from ..operators import classify, explain, reopen, weekly
from . import fixtures as Fx
from .oracle_base import sql
from .registry import query, text_list

_STEPS = """stp AS (
  SELECT trace_id, session_id, rn AS turn, k, ts, ['topup', 'withdraw', 'interbank-fund-transfer'][k % 3 + 1] AS skill,
         CASE WHEN k % 24 = 0 THEN 'cs_escalation' ELSE 'tone_check_error' END AS srule,
         CASE WHEN k % 36 = 4 THEN 'cs_escalation' WHEN k % 36 = 16 THEN 'tone_check_error' ELSE 'profanity' END AS orule
  FROM tr
), stv AS (
  SELECT *, CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN 'khong_tra_loi' WHEN k % 12 IN (8, 4, 0, 5) THEN 'chuyen_cs' ELSE 'tra_loi' END AS verdict,
         CASE WHEN k % 29 = 0 THEN 'Ticket đã được xử lý trước đó' WHEN k % 31 = 0 THEN 'Ticket đã chuyển CS ở lượt trước' WHEN k % 12 = 8 THEN 'Câu hỏi vướng rule missing_transaction_id'
              WHEN k % 12 = 4 THEN 'Câu trả lời vướng rule ' || orule WHEN k % 12 = 5 THEN 'Skill vướng rule off_topic' WHEN k % 12 = 0 THEN 'Skill vướng rule ' || srule ELSE 'Agent đã trả lời khách' END AS verdict_reason,
         CASE WHEN k % 29 = 0 THEN 'E5' WHEN k % 31 = 0 THEN 'E4' WHEN k % 12 IN (8, 5) THEN 'E3' WHEN k % 12 = 0 THEN CASE srule WHEN 'cs_escalation' THEN 'E1' ELSE 'E9' END
              WHEN k % 12 = 4 THEN CASE orule WHEN 'cs_escalation' THEN 'E2' WHEN 'tone_check_error' THEN 'E9' ELSE 'E8' END WHEN k % 10 = 7 THEN 'E7' WHEN k % 17 = 3 THEN 'E6' ELSE 'NONE' END AS escalation_class,
         k % 6 <> 5 AS has_load
  FROM stp
), stc AS (
  SELECT *, CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN NULL WHEN k % 12 = 8 OR k % 12 = 5 THEN NULL WHEN k % 12 = 0 THEN CASE WHEN k % 24 = 0 THEN concat('reason ', k) END
              WHEN k % 12 = 4 THEN NULL WHEN k % 10 = 7 THEN 'Vui lòng báo cskh xử lý' END AS guardrail_reason,
         CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN NULL WHEN k % 12 = 8 THEN 'missing_transaction_id' WHEN k % 12 = 5 THEN 'off_topic' WHEN k % 12 = 0 THEN srule WHEN k % 12 = 4 THEN orule END AS blocking_rule
  FROM stv
)"""


@Fx.stored_once
def steps(spark, d):
    return explain.compact_steps(Fx.steps(spark, d))


@query("compact_steps", sql("""SELECT trace_id, ord, key, CASE WHEN bad THEN 'chan' ELSE 'ok' END AS outcome, label FROM stp, LATERAL (VALUES
 (1, 'idempotency_guard', k % 29 = 0, 'Kiểm tra trùng lặp', true), (2, 'escalation_history_guard', k % 31 = 0, 'Kiểm tra lịch sử chuyển CS', true),
 (3, 'input_guardrail', k % 12 = 8, 'Kiểm tra câu hỏi của khách', true), (4, 'route', false, 'Chọn nhóm nghiệp vụ', true), (5, 'skills_loaded', false, 'Nạp danh sách skill', k % 3 = 0),
 (6, 'tool:load_skill_reference__' || skill, false, 'Chọn skill: ' || skill, k % 6 <> 5), (7, 'tool:get_bank_name', false, 'Tra dữ liệu: get_bank_name', true),
 (9, 'skill_guardrail_checked', k % 12 = 5, 'Kiểm tra skill có phù hợp không (đầu vào)', true), (10, 'skill_guardrail_checked', k % 12 = 0, 'Kiểm tra skill có phù hợp không (đầu ra)', true),
 (11, 'output_guardrail', k % 12 = 4, 'Kiểm tra câu trả lời', true), (12, 'general_response', false, 'general_response', k % 17 = 3)) u(ord, key, bad, label, here) WHERE here""", _STEPS))
def compact_steps(spark, d):
    order = F.element_at(F.split("id", "-"), -1).cast("int")
    return steps(spark, d).select("trace_id", order.alias("ord"), "key", "outcome", "label")


@query("turn_verdict", sql("SELECT trace_id, session_id, turn, verdict, verdict_reason FROM stv", _STEPS))
def turn_verdict(spark, d):
    return explain.turn_verdict(steps(spark, d))


@Fx.plan_once
def features(spark, d):
    return explain.turn_features(Fx.steps(spark, d), steps(spark, d))


@query("turn_features", sql("""SELECT trace_id, CASE WHEN has_load THEN skill ELSE '' END AS skills_used, CASE WHEN has_load THEN 'load_skill_reference__' || skill || ':1,get_bank_name:1' ELSE 'get_bank_name:1' END AS tools_called,
 concat('draft ', k) AS last_draft FROM stv""", _STEPS))
def turn_features(spark, d):
    tools = F.array_join(F.transform("tools_called", lambda t: F.concat(t["tool"], F.lit(":"), t["n"].cast("string"))), ",")
    return features(spark, d).select("trace_id", text_list("skills_used").alias("skills_used"), tools.alias("tools_called"), "last_draft")


@query("clean_evidence", sql("SELECT trace_id, concat('{\"text\":\"draft ', k, '\"}') AS evidence FROM stp", _STEPS))
def clean_evidence(spark, d):
    rows = Fx.steps(spark, d).where("name like 'llm_call:%'").select(F.col("traceId").alias("trace_id"), "output")
    return explain.clean_evidence(rows, "output").select("trace_id", "evidence")


@Fx.plan_once
def classes(spark, d):
    return explain.escalation_class(steps(spark, d))


@query("escalation_class", sql("SELECT trace_id, session_id, turn, escalation_class FROM stc", _STEPS))
def escalation_class(spark, d):
    return classes(spark, d).select("trace_id", "session_id", "turn", "escalation_class")


@query("guardrail_reason", sql("SELECT trace_id, guardrail_reason, blocking_rule FROM stc", _STEPS))
def guardrail_reason(spark, d):
    return explain.guardrail_reason(classes(spark, d))


@query("session_escalation", sql("""SELECT session_id, CASE WHEN last_class IN ('E4', 'E5') AND real_class IS NOT NULL THEN real_class ELSE last_class END AS escalation_class,
 CASE WHEN last_class IN ('E4', 'E5') AND real_class IS NOT NULL THEN real_turn WHEN last_class <> 'NONE' THEN last_turn END AS escalated_turn
 FROM (SELECT session_id, arg_max(escalation_class, turn) AS last_class, max(turn) AS last_turn, arg_max(escalation_class, turn) FILTER (escalation_class NOT IN ('NONE', 'E4', 'E5')) AS real_class,
 max(turn) FILTER (escalation_class NOT IN ('NONE', 'E4', 'E5')) AS real_turn FROM stc GROUP BY 1)""", _STEPS))
def session_escalation(spark, d):
    return explain.session_escalation(classes(spark, d), ["turn"])


@query("phase_summary", sql("""SELECT trace_id, phase_order, phase, step_count, CASE WHEN phase = decision THEN 'quyet_dinh' WHEN phase = 'tra_du_lieu' THEN CASE WHEN step_count > 0 THEN 'thong_tin' ELSE 'dat' END WHEN blocked THEN 'chan' ELSE 'dat' END AS state,
 CASE WHEN phase = decision THEN false WHEN phase = 'tra_du_lieu' THEN step_count = 0 ELSE NOT blocked END AS collapsed
 FROM (SELECT trace_id, u.*, CASE WHEN k % 29 = 0 OR k % 31 = 0 OR k % 12 = 8 THEN 'tiep_nhan' ELSE 'ket_qua' END AS decision FROM stv, LATERAL (VALUES
  (0, 'tiep_nhan', 3, k % 29 = 0 OR k % 31 = 0 OR k % 12 = 8), (1, 'nhan_dien', 1 + (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 17 = 3 THEN 1 ELSE 0 END), false),
  (2, 'doc_quy_dinh', CASE WHEN has_load THEN 1 ELSE 0 END, false), (3, 'tra_du_lieu', 1, false), (4, 'ket_qua', 3, k % 12 IN (0, 4, 5))) u(phase_order, phase, step_count, blocked))""", _STEPS))
def phase_summary(spark, d):
    rows = steps(spark, d)
    return explain.phase_summary(rows, explain.turn_verdict(rows)).drop("title", "summary")


@query("sub_skills_read", sql("SELECT trace_id, skill, concat('sub-skill-', CASE k % 2 WHEN 0 THEN 'A' ELSE 'B' END, '.md') AS filename, 1 AS read_order FROM stv WHERE has_load", _STEPS))
def sub_skills_read(spark, d):
    return explain.sub_skills_read(steps(spark, d))


_SNAP = """snap AS (SELECT skill, concat('sub-skill-', CASE k % 2 WHEN 0 THEN 'A' ELSE 'B' END, '.md') AS filename, min(concat('body ', k % 4)) AS content FROM stv WHERE has_load GROUP BY 1, 2)"""


@Fx.plan_once
def stored_documents(spark, d):
    """Stored text per (skill, file): the smallest content any trace read."""
    rows = steps(spark, d).where(F.col("filename").isNotNull() & F.col("content").isNotNull())
    return rows.groupBy(F.regexp_replace("key", "^tool:load_skill_reference__", "").alias("skill"), "filename").agg(F.min("content").alias("content"))


@query("document_drift", sql("""SELECT trace_id, concat('body ', k % 4) <> content AS drift_changed FROM stv JOIN snap ON stv.skill = snap.skill
 AND snap.filename = concat('sub-skill-', CASE k % 2 WHEN 0 THEN 'A' ELSE 'B' END, '.md') WHERE has_load""", _STEPS, _SNAP))
def document_drift(spark, d):
    return explain.document_drift(steps(spark, d), stored_documents(spark, d))


@query("latest_tool_result", sql("SELECT trace_id, 'tool:get_bank_name' AS step_key, 1 AS calls, k % 10 = 7 AS has_error FROM stp", _STEPS))
def latest_tool_result(spark, d):
    return explain.latest_tool_result(Fx.steps(spark, d)).select("trace_id", "step_key", "calls", F.col("result_json").contains("error").alias("has_error"))


@query("humanize_tool", sql(f"""SELECT trace_id, 'Ngân hàng' AS label, CASE WHEN k % 10 = 7 THEN '{K.TOOL_FAILED}' ELSE concat('Bank', k % 5) END AS value, k % 10 = 7 AS failed FROM stp""", _STEPS))
def humanize_tool(spark, d):
    return explain.humanize_tool(explain.latest_tool_result(Fx.steps(spark, d))).select("trace_id", "label", "value", "failed")


@query("coverage_mismatch", sql("""SELECT trace_id, CASE WHEN k % 5 = 4 THEN 'topup' WHEN k % 5 = 2 THEN 'withdraw' END AS expected_skill,
 NOT has_load OR (k % 5 = 4 AND skill <> 'topup') OR (k % 5 = 2 AND skill <> 'withdraw') OR (k % 5 = 0 AND false) AS mismatch FROM stv""", _STEPS))
def coverage_mismatch(spark, d):
    apps = Fx.traces(spark, d).select("trace_id", "app")
    return explain.coverage_mismatch(features(spark, d).join(apps, "trace_id")).select("trace_id", "expected_skill", "mismatch")


def _facts_sql() -> str:
    """Every configured field of every skill, from the same constants: value and presence in the fixture's payloads."""
    values = {"App": "app", "UserID": "concat('user-', user_id)", "title": "concat('Hỗ trợ ', k)", "Product Code": "product_code"}
    skill = "CASE " + " ".join(f"WHEN app_code IN ({', '.join(map(str, apps))}) THEN '{name}'" for name, apps in K.APP_SKILLS.items()) + " END"
    rows = []
    for name, fields in [(None, K.DEFAULT_FIELDS), *K.SKILL_FIELDS.items()]:
        for i, label in enumerate((*fields, "title")):
            value = values.get(label)
            shown = "CAST(NULL AS VARCHAR)" if value is None or label in K.PRESENCE_FIELDS else value
            here = f"skill = '{name}'" if name else f"(skill IS NULL OR skill NOT IN ({', '.join(repr(n) for n in K.SKILL_FIELDS)}))"
            rows.append(f"SELECT session_id, {i} AS position, '{label}' AS label, {shown} AS value, {'false' if value is None else 'true'} AS present FROM fsk WHERE {here}")
    return f"fsk AS (SELECT *, {skill} AS skill FROM fst), fct AS ({' UNION ALL '.join(rows)})"


@query("ticket_facts", sql("SELECT * FROM fct", _facts_sql()))
def ticket_facts(spark, d):
    raw = Fx.raw_traces(spark, d)
    first = classify.first_trace(Fx.traces(spark, d)).select("trace_id", "session_id")
    rows = explain.ticket_facts(raw.select(F.col("id").alias("trace_id"), "input").join(first, "trace_id"))
    return rows.select("session_id", "position", "label", "value", "present")


# ---- rule documents -----------------------------------------------------------------------

_WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DOCS = rf"""mk AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 7 = 0 THEN '## ' || trim(l) WHEN i % 3 = 1 THEN '### A' || i || ' - ' || trim(l) ELSE l END), chr(10)) AS text FROM documents
), ln AS (
  SELECT doc_id, i, parts[i] AS l FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM mk))
), lh AS (SELECT *, length(regexp_extract(l, '^(#{{2,3}}){_WS}+.*$', 1)) AS level FROM ln),
lx AS (
  SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx, regexp_replace(regexp_extract(l, '^#{{2,3}}{_WS}+(.*)$', 1), '{_WS}+$', '') AS head FROM lh WHERE level > 0
), sec AS (
  SELECT s.doc_id, concat('topup/references/doc-', s.doc_id, '.md#L', s.i) AS anchor, s.i AS line, nullif(regexp_extract(head, '{{case}}', 1), '') AS case_id,
         CASE WHEN regexp_matches(head, '{{case}}') THEN regexp_replace(regexp_extract(head, '{{case}}', 2), '^{_WS}+|{_WS}+$', '', 'g') ELSE head END AS case_title,
         regexp_replace(coalesce((SELECT string_agg(b.l, chr(10) ORDER BY b.i) FROM lh b WHERE b.doc_id = s.doc_id AND b.i > s.i AND (s.nx IS NULL OR b.i < s.nx)), ''), '^\n+|\n+$', '', 'g') AS body
  FROM lx s WHERE level = 3
)""".replace("{case}", rf"^([A-Z](?:\.?\p{{Nd}}+[a-z]?)(?:{_WS}*,{_WS}*[A-Z]\.?\p{{Nd}}+[a-z]?)*){_WS}+-{_WS}+(.+)$")


def rule_documents(spark, d):
    """Every document, with headings on fixed lines: every seventh a section, every third a case."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when((i + 1) % 7 == 0, F.concat(F.lit("## "), F.trim(l))).when(
        (i + 1) % 3 == 1, F.concat(F.lit("### A"), (i + 1).cast("string"), F.lit(" - "), F.trim(l))).otherwise(l))
    return Fx.texts(spark, d).select(F.concat(F.lit("topup/references/doc-"), F.col("id"), F.lit(".md")).alias("path"), F.array_join(lines, "\n").alias("text"))


@query("extract_sections", sql("SELECT anchor, line, case_id, case_title, body FROM sec", _DOCS))
def extract_sections(spark, d):
    return explain.extract_sections(rule_documents(spark, d)).select("anchor", "line", "case_id", "case_title", "body")


@Fx.plan_once
def rules(spark, d):
    """Rule sections of the skills in use: the sections of every document, filed under a skill."""
    sections = explain.extract_sections(rule_documents(spark, d))
    doc = F.regexp_extract("file_label", r"doc-(\d+)", 1).cast("bigint")
    skill = Fx.pick(doc % 3, "topup", "withdraw", "ibft")
    label = F.concat(F.lit("sub-skill-"), Fx.pick(F.floor(doc / 3) % 2, "A", "B"))
    source = F.when(doc % 5 == 0, "skill_md").otherwise("sub_skill")
    return sections.withColumns({"skill": skill, "file_label": label, "source": source})


def _rule_inputs(spark, d):
    rows = steps(spark, d)
    return explain.sub_skills_read(rows), features(spark, d), rules(spark, d), explain.escalation_class(rows)


_CAND = r"""rl AS (
  SELECT anchor, line, body, ['topup', 'withdraw', 'ibft'][doc_id % 3 + 1] AS rskill, concat('sub-skill-', ['A', 'B'][(doc_id // 3) % 2 + 1]) AS label, CASE WHEN doc_id % 5 = 0 THEN 'skill_md' ELSE 'sub_skill' END AS source FROM sec
), rd AS (
  SELECT *, CASE skill WHEN 'interbank-fund-transfer' THEN 'ibft' ELSE skill END AS rskill, concat('sub-skill-', CASE k % 2 WHEN 0 THEN 'A' ELSE 'B' END) AS label, concat(k % 3, '/', k % 2) AS kind FROM stc WHERE has_load
), pt AS (SELECT DISTINCT kind, rskill, label FROM rd),
pc AS (
  SELECT kind, pt.rskill AS skill, anchor, source, 1 AS part, rl.label, line, body FROM pt JOIN rl ON rl.rskill = pt.rskill AND rl.label = pt.label AND source = 'sub_skill'
  UNION ALL SELECT kind, pt.rskill, anchor, source, 2, rl.label, line, body FROM pt JOIN rl ON rl.rskill = pt.rskill AND source = 'skill_md'
), pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY part, label, line, anchor) AS n, count(*) OVER (PARTITION BY kind) AS alln FROM pc) WHERE n <= 40),
gu AS (SELECT trace_id, CASE WHEN has_load THEN concat(k % 3, '/', k % 2) END AS kind, CASE WHEN has_load THEN skill ELSE 'khong_xac_dinh' END AS skill FROM stc WHERE escalation_class = 'E7'),
sz AS (SELECT kind, count(*) AS total FROM pc GROUP BY 1),
cd AS (
  SELECT trace_id, pr.skill, anchor, source, n, body, alln + (CASE WHEN escalation_class = 'E7' THEN 1 ELSE 0 END) AS total FROM rd JOIN pr USING (kind)
  UNION ALL SELECT trace_id, skill, 'tool:get_bank_name', 'tool_message', coalesce(total, 0) + 1, 'Vui lòng báo cskh xử lý', coalesce(total, 0) + 1 FROM gu LEFT JOIN sz USING (kind) WHERE coalesce(total, 0) + 1 <= 40
)"""


@query("rule_candidates", sql("SELECT trace_id, skill, anchor, source, n AS candidate_order, greatest(total - 40, 0) AS dropped FROM cd", _STEPS, _DOCS, _CAND))
def rule_candidates(spark, d):
    return explain.rule_candidates(*_rule_inputs(spark, d)).select("trace_id", "skill", "anchor", "source", "candidate_order", "dropped")


_SCORE = r"""sc0 AS (
  SELECT DISTINCT anchor, source, body, regexp_matches(body, '(?is)(^|[^\p{L}\p{N}\p{M}_])(cskh|cs)($|[^\p{L}\p{N}\p{M}_])|chăm sóc khách hàng') AS asks, contains(lower(body), 'get_bank_name') AS bank,
         contains(lower(body), 'load_skill_reference__') AS loads FROM cd
), sc AS (
  SELECT trace_id, cd.anchor, n, total, CASE WHEN cd.source = 'sub_skill' THEN 100 WHEN cd.source = 'skill_md' THEN -5 ELSE 0 END + CASE WHEN asks THEN 10 ELSE 0 END + CASE WHEN bank THEN 30 ELSE 0 END AS score, loads FROM cd JOIN sc0 USING (anchor, source, body)
)"""


@query("rank_candidates", sql("""SELECT trace_id, anchor, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, n) AS rank, greatest(total - 40, 0) AS dropped,
 greatest(count(*) OVER (PARTITION BY trace_id) - 8, 0) AS beyond FROM sc QUALIFY rank <= 8""", _STEPS, _DOCS, _CAND, _SCORE))
def rank_candidates(spark, d):
    return explain.ranked_rules(*_rule_inputs(spark, d)).select("trace_id", "anchor", F.col("score").cast("bigint").alias("score"), "rank", "dropped", "beyond")


_GROUND = r"""gr AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('Hoàn ', doc_id % 50, ' lần') ELSE concat('Mã ', 100000 + doc_id) END AS c1,
         CASE doc_id % 3 WHEN 0 THEN 'cao' WHEN 1 THEN 'thap' ELSE 'sure' END AS confidence, CASE WHEN doc_id % 7 = 0 THEN ' theo rule' ELSE '' END AS tail, text
  FROM documents
)"""


@query("ground_check", sql(r"""SELECT doc_id, doc_id % 2 = 0 AND confidence <> 'sure' AND tail = '' AND contains(regexp_replace(text, '[.,]', '', 'g'), CAST(doc_id % 50 AS VARCHAR)) AS grounded FROM gr""", _GROUND))
def ground_check(spark, d):
    i = F.col("id")
    rows = Fx.texts(spark, d).select(
        i.alias("doc_id"), F.concat(F.when(i % 2 == 0, F.concat(F.lit("Hoàn "), i % 50, F.lit(" lần"))).otherwise(F.concat(F.lit("Mã "), i + 100000)),
                                    F.when(i % 7 == 0, " theo rule").otherwise("")).alias("conclusion"),
        Fx.pick(i % 3, "cao", "thap", "sure").alias("confidence"), F.col("text").alias("evidence"))
    return explain.ground_check(rows).select("doc_id", "grounded")


@query("strip_title_suffix", "SELECT doc_id, concat('Lỗi ', doc_id) AS title FROM documents")
def strip_title_suffix(spark, d):
    made = F.concat(F.lit("Lỗi "), "id", F.when(F.col("id") % 2 == 0, F.lit(" ( Mã giao dịch: 12 ) -  ( Ticket id: 3 )")).otherwise(""))
    return Fx.texts(spark, d).select(F.col("id").alias("doc_id"), X.strip_title_suffix(made).alias("title"))


@query("mask_text")
def mask_text(spark, d):
    return Fx.texts(spark, d).select("id", X.mask_text(F.col("text")).alias("masked"))


@query("mask_digit_runs", """SELECT doc_id AS id, sha256(array_to_string(list_transform(regexp_extract_all(text, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]{9,}') THEN repeat('*', length(p)) ELSE p END), '')) AS masked_hash
 FROM documents""")
def mask_digit_runs(spark, d):
    return Fx.texts(spark, d).select("id", F.sha2(X.mask_digit_runs(F.col("text")), 256).alias("masked_hash"))


@query("accent_fold")
def accent_fold(spark, d):
    return Fx.texts(spark, d).select("id", F.sha2(X.accent_fold(F.col("text")), 256).alias("folded_hash"))


# ---- reopen -------------------------------------------------------------------------------

_REO = """elg AS (SELECT * FROM ses WHERE ai_first AND reopen_within_7d = 1 AND outcome IN ('ai_end_to_end', 'ai_then_cs') AND data_quality = 'valid'),
rpk AS (
  SELECT e.session_id, e.turn0_trace_id AS anchor_trace_id, (SELECT arg_min(t.trace_id, t.p) FROM pos t WHERE t.session_id = e.session_id AND t.p > 1 AND t.ts > e.turn0_ts AND t.ts <= e.turn0_ts + INTERVAL 168 HOUR) AS followup_trace_id,
         e.cohort_week AS week, e.issue_category AS domain, e.outcome FROM elg e
), rpp AS (
  SELECT k.*, NOT a.is_malformed AND k.followup_trace_id IS NOT NULL AS complete, concat('Yêu cầu ', a.k, ' từ [PII] qua [PII]') AS t0, concat('Yêu cầu ', f.k, ' từ [PII] qua [PII]') AS t1,
         CASE WHEN a.event_type = 'signup' THEN 'Không hỗ trợ nội dung này' ELSE concat('Trả lời ', a.event_type, ' ', a.k) END AS r0
  FROM rpk k JOIN tr a ON a.trace_id = k.anchor_trace_id LEFT JOIN tr f ON f.trace_id = k.followup_trace_id
)"""


@Fx.plan_once
def population(spark, d):
    return reopen.reopen_population(Fx.sessions(spark, d), Fx.traces(spark, d), reopen.trace_texts(Fx.raw_traces(spark, d)))


@query("reopen_population", sql("SELECT session_id, anchor_trace_id, followup_trace_id, week, domain, outcome, complete, CASE WHEN complete THEN t0 END AS initial_user_text, CASE WHEN complete THEN r0 END AS initial_ai_text, CASE WHEN complete THEN t1 END AS followup_user_text FROM rpp", _REO))
def reopen_population(spark, d):
    return population(spark, d)


@query("reopen_control_rate", sql("SELECT sum(control_reopen_within_7d) AS numerator, count(control_reopen_within_7d) AS denominator, sum(control_reopen_within_7d) / count(control_reopen_within_7d) AS rate FROM ses"))
def reopen_control_rate(spark, d):
    return reopen.control_rate(Fx.sessions(spark, d))


@query("normalize_vectors", """SELECT vec_id AS id, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n), 'sum'), 6) AS component_sum FROM (
 SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""")
def normalize_vectors(spark, d):
    rows = reopen.normalize_vectors(Fx.vectors(spark, d))
    return rows.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"))


@query("kmeans_cosine")
def kmeans_cosine(spark, d):
    return reopen.kmeans_cosine(reopen.normalize_vectors(Fx.vectors(spark, d)), 5).select("id", "cluster_id")


@query("silhouette_cosine", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_cosine_similarity(a.v, b.v)) FILTER (a.vec_id <> b.vec_id) AS s, count(*) FILTER (a.vec_id <> b.vec_id) AS n FROM v a, v b GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN label = other THEN s / nullif(n, 0) END) AS a, max(CASE WHEN label = other THEN n END) AS own, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN own = 0 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette, (SELECT count(DISTINCT label) FROM v) AS clusters FROM ab""")
def silhouette_cosine(spark, d):
    labelled = Fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("cluster_id"))
    return reopen.silhouette_cosine(reopen.normalize_vectors(labelled)).withColumn("silhouette", F.round("silhouette", 9))


@query("select_k")
def select_k(spark, d):
    return reopen.select_k(Fx.vectors(spark, d), 5, 15)


@query("round_robin_sample", sql("""SELECT session_id, round FROM (SELECT session_id, cohort_week, issue_category, outcome, row_number() OVER (PARTITION BY cohort_week, issue_category, outcome ORDER BY session_id) AS round FROM ses)
 ORDER BY round, cohort_week, issue_category, outcome LIMIT 300"""))
def round_robin_sample(spark, d):
    rows = Fx.sessions(spark, d).select("session_id", "cohort_week", "issue_category", "outcome")
    return reopen.round_robin_sample(rows, ["cohort_week", "issue_category", "outcome"], "session_id").select("session_id", "round")


@query("saturation_stop", sql("""SELECT doc_id FROM bat WHERE batch <= coalesce((SELECT min(s.batch) FROM stale s WHERE s.batch - 1 IN (SELECT batch FROM stale)), batch)""",
 """bat AS (SELECT doc_id, doc_id // 50 AS batch, CASE WHEN doc_id < 90 THEN concat('lý do ', doc_id % 30) ELSE concat('lý do ', doc_id % 10) END AS reason FROM documents)""",
 """stale AS (SELECT DISTINCT batch FROM bat WHERE batch NOT IN (SELECT min(batch) FROM bat GROUP BY reason))"""))
def saturation_stop(spark, d):
    i = F.col("id")
    reason = F.when(i < 90, F.concat(F.lit("Lý do  "), i % 30)).otherwise(F.concat(F.lit("lý DO "), i % 10))
    rows = Fx.texts(spark, d).select(i.alias("doc_id"), reason.alias("reason"))
    return reopen.saturation_stop(rows, "doc_id").select("doc_id")


@query("pii_review_sample", sql("""SELECT session_id, segment, trace_id FROM rpp, LATERAL (VALUES (0, 'initial_user_text', anchor_trace_id), (1, 'initial_ai_text', anchor_trace_id), (2, 'followup_user_text', followup_trace_id)) u(part, segment, trace_id)
 WHERE complete ORDER BY session_id, part LIMIT 200""", _REO))
def pii_review_sample(spark, d):
    return reopen.pii_review_sample(population(spark, d)).select("session_id", "segment", "trace_id")


@query("disjoint_sample_pool", sql("SELECT session_id, week, domain, outcome, anchor_trace_id, followup_trace_id FROM rpk WHERE CAST(session_id AS BIGINT) % 3 <> 0", _REO))
def disjoint_sample_pool(spark, d):
    pop = reopen.reopen_keys(Fx.sessions(spark, d), Fx.traces(spark, d))
    return reopen.disjoint_sample_pool(pop, pop.where("cast(session_id as bigint) % 3 = 0"))


def _golden_hash(tag: str, column: str = "session_id") -> str:
    return f"sha256('7|{tag}|' || {column})"


@query("golden_sample", sql(f"""SELECT substr({_golden_hash('row')}, 1, 24) AS row_id, session_id, CASE WHEN again THEN substr({_golden_hash('group')}, 1, 24) END AS duplicate_group_id, NULL::VARCHAR AS duplicate_source_row_id FROM gpk
 UNION ALL SELECT substr({_golden_hash('copy')}, 1, 24), session_id, substr({_golden_hash('group')}, 1, 24), substr({_golden_hash('row')}, 1, 24) FROM gpk WHERE again""", _REO,
 f"gpk0 AS (SELECT session_id FROM rpk WHERE CAST(session_id AS BIGINT) % 3 <> 0 ORDER BY {_golden_hash('pick')}, session_id LIMIT 34)",
 f"gpk AS (SELECT session_id, row_number() OVER (ORDER BY {_golden_hash('again')}, session_id) <= 6 AS again FROM gpk0)"))
def golden_sample(spark, d):
    pop = reopen.reopen_keys(Fx.sessions(spark, d), Fx.traces(spark, d))
    pool = reopen.disjoint_sample_pool(pop, pop.where("cast(session_id as bigint) % 3 = 0"))
    return reopen.golden_sample(pool, 40).select("row_id", "session_id", "duplicate_group_id", "duplicate_source_row_id")


_LABEL = """lbl AS (SELECT CAST((doc_id % 150 + 1) * 100 + doc_id % 10 AS VARCHAR) AS session_id, doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN NULL WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN 'refund_or_reversal_pending' ELSE 'recipient_not_credited' END AS label,
  CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'q' END AS quote, doc_id % 11 = 0 AS error FROM labels QUALIFY row_number() OVER (PARTITION BY (doc_id % 150 + 1) * 100 + doc_id % 10 ORDER BY doc_id) = 1),
lbs AS (SELECT *, CASE WHEN error THEN 'failed' WHEN label IS NULL THEN 'invalid' WHEN label = 'other' THEN CASE WHEN quote IS NOT NULL THEN 'abstained' ELSE 'invalid' END ELSE 'labeled' END AS status FROM lbl)"""


@Fx.plan_once
def label_rows(spark, d):
    rows = Fx.table(spark, d, "labels")
    first = rows.groupBy(((F.col("doc_id") % 150 + 1) * 100 + F.col("doc_id") % 10).cast("string").alias("session_id")).agg(F.min(F.struct("doc_id", "quality", "toxic")).alias("r"))
    q, t, i = F.col("r.quality"), F.col("r.toxic"), F.col("r.doc_id")
    label = F.when((q == 1) & (t == 1), None).when(t == 1, "other").when(q == 1, "refund_or_reversal_pending").otherwise("recipient_not_credited")
    return first.select("session_id", i.alias("doc_id"), label.alias("label"), F.when((t == 1) & (i % 2 == 0), "q").alias("quote"), (i % 11 == 0).alias("error"),
                        F.lit("v1").alias("labels_version"), F.lit("p1").alias("prompt_version"))


@query("label_todo", sql("SELECT session_id FROM ses WHERE session_id NOT IN (SELECT session_id FROM lbl)", _LABEL))
def label_todo(spark, d):
    return reopen.label_todo(Fx.sessions(spark, d), label_rows(spark, d), "v1", "p1")


@query("label_batch_stats", sql("""SELECT count(*) FILTER (status = 'labeled') AS labeled, count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (doc_id % 2 = 0) AS cached FROM lbs""", _LABEL))
def label_batch_stats(spark, d):
    return reopen.label_batch_stats(label_rows(spark, d), F.col("doc_id") % 2 == 0)


@query("reopen_reason_rollup", sql("""SELECT week_definition, cohort_week, l.label, outcome, issue_category AS business, count(*) AS count FROM lbl l JOIN ses s USING (session_id) JOIN defs ON week_definition = 'mon_sun' OR NOT is_weekend_start
 WHERE l.label IS NOT NULL GROUP BY 1, 2, 3, 4, 5""", _LABEL))
def reopen_reason_rollup(spark, d):
    return reopen.reopen_reason_rollup(label_rows(spark, d), Fx.sessions(spark, d))


@query("reopen_reason_coverage", sql("""SELECT c.week_definition, c.cohort_week,
 count(*) FILTER (ai_first AND reopen_within_7d = 1 AND outcome IN ('ai_end_to_end', 'ai_then_cs') AND data_quality = 'valid') AS population, count(*) FILTER (status IN ('labeled', 'abstained')) AS labeled,
 count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'invalid') AS invalid,
 CASE WHEN mature THEN sum(control_reopen_within_7d) / nullif(count(control_reopen_within_7d), 0) END AS direct_cs_reopen_7d_rate, CASE WHEN mature THEN count(control_reopen_within_7d) ELSE 0 END AS direct_cs_denominator
 FROM cal c LEFT JOIN sd USING (week_definition, cohort_week) LEFT JOIN lbs USING (session_id) GROUP BY c.week_definition, c.cohort_week, mature""", _LABEL))
def reopen_reason_coverage(spark, d):
    return reopen.reopen_reason_coverage(reopen.label_status(label_rows(spark, d)), Fx.sessions(spark, d), weekly.calendar(spark, Fx.WINDOW))


_GOLD = """gld AS (SELECT doc_id, CAST(quality AS VARCHAR) AS human_label, CASE WHEN toxic = 1 THEN '0' ELSE '1' END AS prediction, CASE WHEN doc_id % 7 = 0 THEN concat('g', doc_id) END AS grp, false AS copy FROM labels
 UNION ALL SELECT doc_id, CAST(quality AS VARCHAR), CASE WHEN toxic = 1 THEN '0' ELSE '1' END, concat('g', doc_id), true FROM labels WHERE doc_id % 7 = 0),
mtx AS (SELECT a.l AS human_label, b.l AS prediction, (SELECT count(*) FROM gld g WHERE NOT copy AND g.human_label = a.l AND g.prediction = b.l) AS count FROM (VALUES ('0'), ('1')) a(l), (VALUES ('0'), ('1')) b(l)),
met AS (SELECT l AS label, (SELECT sum(count) FROM mtx WHERE human_label = l) AS support, (SELECT sum(count) FROM mtx WHERE human_label = l AND prediction = l) AS true_positive, (SELECT sum(count) FROM mtx WHERE prediction = l) AS predicted FROM (VALUES ('0'), ('1')) v(l))"""


@Fx.plan_once
def golden_rows(spark, d):
    rows = Fx.table(spark, d, "labels").select(
        F.concat(F.lit("r"), "doc_id").alias("row_id"), F.col("quality").cast("string").alias("human_label"), F.when(F.col("toxic") == 1, "0").otherwise("1").alias("prediction"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("g"), "doc_id")).alias("duplicate_group_id"), F.lit(None).cast("string").alias("duplicate_source_row_id"))
    copies = rows.where("duplicate_group_id is not null").withColumns({"duplicate_source_row_id": F.col("row_id"), "row_id": F.concat(F.lit("c"), "row_id")})
    return rows.unionByName(copies)


@query("confusion_matrix", sql("SELECT * FROM mtx", _GOLD))
def confusion_matrix(spark, d):
    return reopen.confusion_matrix(golden_rows(spark, d), ["0", "1"])


@query("label_metrics", sql("""SELECT *, true_positive / nullif(support, 0) AS recall, true_positive / nullif(predicted, 0) AS precision, support >= 10 AS verified, CASE WHEN support >= 10 THEN true_positive / support >= 0.60 END AS passes_gate FROM met""", _GOLD))
def label_metrics(spark, d):
    return reopen.label_metrics(reopen.confusion_matrix(golden_rows(spark, d), ["0", "1"]))


@query("eval_labels", sql("""SELECT 'evaluated' AS status, 1.0 AS human_consistency, n AS model_denominator, acc AS overall_accuracy, abst AS abstention_rate,
 acc >= 0.8 AND abst <= 0.15 AND NOT EXISTS (SELECT 1 FROM met WHERE support >= 10 AND true_positive / support < 0.60) AS gate_passed
 FROM (SELECT sum(count) AS n, sum(count) FILTER (human_label = prediction) / sum(count) AS acc, sum(count) FILTER (prediction = '0') / sum(count) AS abst FROM mtx)""", _GOLD))
def eval_labels(spark, d):
    return reopen.eval_labels(golden_rows(spark, d), ["0", "1"], "0")
