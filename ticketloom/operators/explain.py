"""Why a ticket was passed on: compact steps, verdicts, escalation classes, rules and evidence."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import variants as V
from .enrich import is_blocking_guardrail

LOAD_SKILL = "tool:load_skill_reference__"
LIST_SKILL = "tool:list_skill_references__"
TOOL = "tool:"
ESCALATE_PHRASE = r"(?iuU)chuy[ểê]n\b.{0,20}\bcskh|chăm sóc khách hàng|\bcskh\b|\bcs\b"

# Span names dropped from the step list, and the five phases of a turn.
HIDDEN_NAMES = ("pipeline", "execute", "tools_loaded", "load_context")
HIDDEN_PREFIXES = ("llm_call:", "plugin:")
PHASES = (
    ("tiep_nhan", "Tiếp nhận câu hỏi"),
    ("nhan_dien", "Nhận diện vấn đề"),
    ("doc_quy_dinh", "Đọc quy định"),
    ("tra_du_lieu", "Tra dữ liệu"),
    ("ket_qua", None),
)
RESULT_TITLES = {"chuyen_cs": "QUYẾT ĐỊNH", "tra_loi": "TRẢ LỜI KHÁCH", "khong_tra_loi": "KHÔNG TRẢ LỜI"}
GUARD_SUBJECTS = {"input_guardrail": "Câu hỏi", "output_guardrail": "Câu trả lời", "skill_guardrail_checked": "Skill"}


def _after(name: Column, prefix: str) -> Column:
    return F.substring(name, len(prefix) + 1, 1 << 30)


def compact_steps(observations: DataFrame) -> DataFrame:
    """Visible steps with label, outcome and summary. Unknown spans stay visible."""
    name, output, payload = F.col("name"), F.col("output"), F.col("input")
    hidden = reduce(lambda a, b: a | b, [name.startswith(p) for p in HIDDEN_PREFIXES], name.isin(*HIDDEN_NAMES))
    guard = name.isin(*GUARD_SUBJECTS)
    blocked = F.when(guard, is_blocking_guardrail(output)).when(
        name.isin("idempotency_guard", "escalation_history_guard"), V.is_true(output, "$.blocked")).otherwise(False)
    is_tool, is_load = name.startswith(TOOL), name.startswith(LOAD_SKILL)
    empty = F.array().cast("array<string>")
    # Each path is read only for the kind of step that carries it.
    failed = V.is_object(output, "$.result") & (V.part(output, "$.result.error").isNotNull() | V.part(output, "$.result.info").isNotNull())
    rows = observations.where((name != "") & ~hidden).select(
        F.col("traceId").alias("trace_id"), "id", F.coalesce("startTime", F.lit("")).alias("start"), name.alias("key"),
        blocked.alias("blocked"), F.when(guard, V.string_at(output, "$.rule")).alias("rule"),
        F.when(name == "skill_guardrail_checked", V.string_at(payload, "$.stage")).alias("stage"),
        F.when(name == "route", V.strings_at(output, "$.agents")).otherwise(empty).alias("agents"),
        F.when(name == "skills_loaded", V.strings_at(output, "$.skills")).otherwise(empty).alias("skills"),
        F.when(is_load, V.filled_string_at(payload, "$.input.filename")).alias("filename"),
        F.when(is_load, V.string_at(output, "$.result.content")).alias("content"),
        F.when(blocked, V.filled_string_at(F.col("metadata"), "$.reason")).alias("reason"),
        F.when(is_tool & ~is_load, V.string_at(output, "$.result.message")).alias("message"),
        F.coalesce(F.when(is_tool & ~is_load, failed), F.lit(False)).alias("is_error"),
        *[c for c in ("session_id", "turn") if c in observations.columns],
    )
    key, is_load = F.col("key"), F.col("key").startswith(LOAD_SKILL)
    is_tool = key.startswith(TOOL)
    stage_text = F.when(F.col("stage") == "input", " (đầu vào)").when(F.col("stage") == "output", " (đầu ra)").otherwise("")
    label = (
        F.when(key == "idempotency_guard", "Kiểm tra trùng lặp").when(key == "escalation_history_guard", "Kiểm tra lịch sử chuyển CS")
        .when(key == "input_guardrail", "Kiểm tra câu hỏi của khách").when(key == "output_guardrail", "Kiểm tra câu trả lời")
        .when(key == "skill_guardrail_checked", F.concat(F.lit("Kiểm tra skill có phù hợp không"), stage_text))
        .when(key == "route", "Chọn nhóm nghiệp vụ").when(key == "plan", "Lập kế hoạch").when(key == "skills_loaded", "Nạp danh sách skill")
        .when(is_load, F.concat(F.lit("Chọn skill: "), _after(key, LOAD_SKILL)))
        .when(is_tool, F.concat(F.lit("Tra dữ liệu: "), _after(key, TOOL))).otherwise(key)
    )
    subject = F.create_map(*[F.lit(x) for kv in GUARD_SUBJECTS.items() for x in kv])[key]
    fine = F.when(key == "skill_guardrail_checked", "Skill phù hợp").otherwise(F.concat(subject, F.lit(" hợp lệ")))
    joined = F.array_join
    summary = (
        F.when(key == "idempotency_guard", F.when(F.col("blocked"), "Ticket này đã được xử lý trước đó, agent không trả lời lại")
               .otherwise("Chưa xử lý trước đó, agent tiếp tục xử lý"))
        .when(key == "escalation_history_guard", F.when(F.col("blocked"), "Ticket đã từng chuyển cho CS, agent không trả lời các lượt sau")
              .otherwise("Ticket chưa từng chuyển CS, agent tiếp tục xử lý"))
        .when(subject.isNotNull(), F.when(F.col("blocked"), _rule_reason(subject, F.col("rule"))).otherwise(fine))
        .when(key == "route", F.when(F.size("agents") > 0, F.concat(F.lit("Chọn nhóm nghiệp vụ: "), joined("agents", ", "))).otherwise("Không xác định được nhóm nghiệp vụ"))
        .when(key == "plan", "Agent đã lập kế hoạch xử lý trước khi thực thi")
        .when(key == "skills_loaded", F.when(F.size("skills") > 0, F.concat(F.lit("Đã nạp "), F.size("skills").cast("string"), F.lit(" skill: "), joined("skills", ", "))).otherwise("Không nạp được skill nào"))
        .when(is_load, F.concat(F.lit("Agent chọn skill "), _after(key, LOAD_SKILL), F.lit(" để trả lời")))
        .when(is_tool, F.concat(F.lit("Agent tra cứu dữ liệu qua "), _after(key, TOOL)))
        .otherwise(F.concat(F.lit("Bước '"), key, F.lit("' chưa có mô tả, xem chi tiết bên dưới")))
    )
    return rows.select("*", label.alias("label"), F.when(F.col("blocked"), "chan").otherwise("ok").alias("outcome"), summary.alias("summary")).drop("agents", "skills")


def _rule_reason(subject: Column, rule: Column) -> Column:
    return F.concat(subject, F.lit(" vướng rule "), F.coalesce(F.when(rule != "", rule), F.lit("không xác định")))


def turn_verdict(steps: DataFrame) -> DataFrame:
    """Fixed priority: idempotency, history, input, output, skill, else answered."""
    order = ("idempotency_guard", "escalation_history_guard", "input_guardrail", "output_guardrail", "skill_guardrail_checked")
    priority = reduce(lambda c, kv: c.when(F.col("key") == kv[1], kv[0]), list(enumerate(order))[1:], F.when(F.col("key") == order[0], 0))
    hit = F.when(F.col("blocked"), F.struct(priority.alias("p"), "start", "id", "key", "rule"))
    keys = [c for c in ("session_id", "turn") if c in steps.columns]
    # session_id and turn are attributes of the trace, so grouping by them adds no rows.
    first = steps.groupBy("trace_id", *keys).agg(F.min(F.when(hit["p"].isNotNull(), hit)).alias("h"))
    p = F.col("h.p")
    subject = F.when(p == 2, "Câu hỏi").when(p == 3, "Câu trả lời").otherwise("Skill")
    verdict = F.when(p <= 1, "khong_tra_loi").when(p.isNotNull(), "chuyen_cs").otherwise("tra_loi")
    reason = (
        F.when(p == 0, "Ticket đã được xử lý trước đó").when(p == 1, "Ticket đã chuyển CS ở lượt trước")
        .when(p.isNotNull(), _rule_reason(subject, F.col("h.rule"))).otherwise("Agent đã trả lời khách")
    )
    return first.select("trace_id", *keys, verdict.alias("verdict"), reason.alias("verdict_reason"))


def turn_features(observations: DataFrame, steps: DataFrame) -> DataFrame:
    """Skills in first-use order, tools with their call counts, text of the last draft."""
    at = F.struct("start", "id")
    tools = steps.where(F.col("key").startswith(TOOL)).groupBy("trace_id", "key").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"))
    item = F.struct("at", _after(F.col("key"), TOOL).alias("tool"), "n", F.col("key").startswith(LOAD_SKILL).alias("is_skill"),
                    _after(F.col("key"), LOAD_SKILL).alias("skill"))
    used = tools.groupBy("trace_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    skills = F.filter(F.transform(F.filter("items", lambda x: x["is_skill"]), lambda x: x["skill"]), lambda s: s != "")
    used = used.select("trace_id", skills.alias("skills_used"), F.transform("items", lambda x: F.struct(x["tool"].alias("tool"), x["n"].alias("n"))).alias("tools_called"))
    drafts = observations.where(F.col("name").startswith("llm_call:")).groupBy(F.col("traceId").alias("trace_id")).agg(
        F.max_by(V.string_at(F.col("output"), "$.text"), F.struct(F.coalesce("startTime", F.lit("")), "id")).alias("t"))
    drafts = drafts.select("trace_id", F.when(~X.is_blank(F.col("t")), F.col("t")).alias("last_draft"))
    traces = steps.select("trace_id").distinct()
    joined = traces.join(used, "trace_id", "left").join(drafts, "trace_id", "left")
    return joined.withColumns({
        "skills_used": F.coalesce("skills_used", F.array().cast("array<string>")),
        "tools_called": F.coalesce("tools_called", F.array().cast("array<struct<tool:string,n:bigint>>"))})


def clean_evidence(frame: DataFrame, column: str, keep_long: str | None = None) -> DataFrame:
    """Payload without bookkeeping keys, long strings cut; `keep_long` flags rows that are not cut."""
    limit = K.EVIDENCE_LENGTH

    def clean(value, cut: bool):
        if isinstance(value, dict):
            return {k: clean(v, cut) for k, v in value.items()
                    if k not in ("messages_count", "iteration", "stop_reason") and "usage" not in k.lower() and "token" not in k.lower()}
        if isinstance(value, list):
            return [clean(v, cut) for v in value]
        return value[:limit] if cut and isinstance(value, str) else value

    @F.pandas_udf("string")
    def cleaned(payload: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([
            None if p is None else json.dumps(clean(json.loads(p), not w), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            for p, w in zip(payload, whole)])

    whole = F.col(keep_long) if keep_long else F.lit(False)
    return frame.withColumn("evidence", cleaned(F.to_json(column), whole))


# ---- escalation ---------------------------------------------------------------------------


def _content_class(rule: Column, escalation: str) -> Column:
    return F.when(rule.isin("cs_escalation", "cs_escalation_regex"), escalation).when(rule == "tone_check_error", "E9").otherwise("E8")


def escalation_class(steps: DataFrame) -> DataFrame:
    """E1-E9 or NONE per trace, with the reason text and rule of the deciding step.

    Every step is given its place in the fixed priority; the lowest (priority, time, id) decides,
    so the whole choice is one minimum per trace.
    """
    key, stage, rule, blocked = F.col("key"), F.col("stage"), F.col("rule"), F.col("blocked")
    plain_tool = key.startswith(TOOL) & ~key.startswith(LOAD_SKILL) & ~key.startswith(LIST_SKILL)
    gave_up = plain_tool & F.col("is_error") & F.coalesce(F.col("message").rlike(ESCALATE_PHRASE), F.lit(False))
    place = (
        F.when(blocked & (key == "idempotency_guard"), 1).when(blocked & (key == "escalation_history_guard"), 2)
        .when(blocked & (key == "input_guardrail"), 3).when(blocked & (key == "skill_guardrail_checked") & (stage == "input"), 4)
        .when(blocked & (key == "skill_guardrail_checked") & (stage == "output"), 5).when(blocked & (key == "output_guardrail"), 6)
        .when(gave_up, 7).when(key == "general_response", 8).when(blocked & (key == "skill_guardrail_checked"), 9)
    )
    step = F.struct(place.alias("place"), "start", "id", "rule", "reason", "message", "key")
    keys = [c for c in ("session_id", "turn") if c in steps.columns]
    best = steps.groupBy("trace_id", *keys).agg(F.min(F.when(place.isNotNull(), step)).alias("d"))
    p = F.col("d.place")
    klass = (
        F.when(p == 1, "E5").when(p == 2, "E4").when(p.isin(3, 4), "E3").when(p == 5, _content_class(F.col("d.rule"), "E1"))
        .when(p == 6, _content_class(F.col("d.rule"), "E2")).when(p == 7, "E7").when(p.isNotNull(), "E6").otherwise("NONE")
    )
    decided = p <= 6
    return best.select(
        "trace_id", *keys, klass.alias("escalation_class"),
        F.when(p == 7, F.when(F.col("d.message") != "", F.col("d.message"))).when(decided, F.col("d.reason")).alias("guardrail_reason"),
        F.when(decided, F.col("d.rule")).alias("blocking_rule"), F.when(p <= 7, F.col("d.key")).alias("deciding_key"))


def guardrail_reason(classes: DataFrame) -> DataFrame:
    return classes.select("trace_id", "guardrail_reason", "blocking_rule")


def session_escalation(classes: DataFrame, order: list[str]) -> DataFrame:
    """Class of the last turn; "already handled" classes point back to the latest real class."""
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "escalation_class", "turn")
    real = ~F.col("escalation_class").isin("NONE", "E4", "E5")
    marks = classes.groupBy("session_id").agg(F.max(at).alias("last"), F.max(F.when(real, at)).alias("real"))
    back = F.col("last.escalation_class").isin("E4", "E5") & F.col("real").isNotNull()
    none = F.col("last.escalation_class") == "NONE"
    return marks.select(
        "session_id", F.when(back, F.col("real.escalation_class")).otherwise(F.col("last.escalation_class")).alias("escalation_class"),
        F.when(back, F.col("real.turn")).when(~none, F.col("last.turn")).alias("escalated_turn"))


def phase_summary(steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Five phases per trace with row count, state and collapsed flag."""
    key = F.col("key")
    phase = (
        F.when(key.isin("idempotency_guard", "escalation_history_guard", "input_guardrail"), "tiep_nhan")
        .when(key.isin("route", "plan", "skills_loaded", "general_response"), "nhan_dien")
        .when(key.isin("skill_guardrail_checked", "output_guardrail"), "ket_qua")
        .when(key.startswith(LOAD_SKILL) | key.startswith(LIST_SKILL), "doc_quy_dinh").otherwise("tra_du_lieu")
    )
    rows = steps.select("trace_id", phase.alias("phase"), "blocked")
    names = [p for p, _ in PHASES]
    counts = rows.groupBy("trace_id").agg(
        *[F.count_if(F.col("phase") == p).alias(f"n_{p}") for p in names], *[F.max((F.col("phase") == p) & F.col("blocked")).alias(f"b_{p}") for p in names])
    counts = counts.join(verdicts.select("trace_id", "verdict"), "trace_id")
    decision = F.when(F.col("b_tiep_nhan"), "tiep_nhan").otherwise("ket_qua")
    result_title = F.create_map(*[F.lit(x) for kv in RESULT_TITLES.items() for x in kv])[F.col("verdict")]
    items = []
    for i, (name, title) in enumerate(PHASES):
        n, b = F.col(f"n_{name}"), F.col(f"b_{name}")
        data = name == "tra_du_lieu"
        state = F.when(decision == name, "quyet_dinh").otherwise(
            F.when(n > 0, "thong_tin").otherwise("dat") if data else F.when(b, "chan").otherwise("dat"))
        collapsed = F.when(decision == name, False).otherwise(n == 0 if data else ~b)
        summary = F.when(n == 0, "Không có bước nào").when(collapsed, F.concat(n.cast("string"), F.lit(" bước kiểm tra · đạt"))).otherwise("")
        items.append(F.struct(F.lit(i).alias("phase_order"), F.lit(name).alias("phase"),
                              (F.lit(title) if title else F.coalesce(result_title, F.lit("Kết quả"))).alias("title"), n.alias("step_count"),
                              state.alias("state"), collapsed.alias("collapsed"), summary.alias("summary")))
    return counts.select("trace_id", F.explode(F.array(*items)).alias("p")).select("trace_id", "p.*")


def sub_skills_read(steps: DataFrame) -> DataFrame:
    """Distinct (skill, file) per trace with the place of the first read."""
    reads = steps.where(F.col("key").startswith(LOAD_SKILL) & F.col("filename").isNotNull())
    first = reads.groupBy("trace_id", _after(F.col("key"), LOAD_SKILL).alias("skill"), "filename").agg(F.min(F.struct("start", "id")).alias("at"))
    order = W.partitionBy("trace_id").orderBy("at")
    return first.select("trace_id", "skill", "filename", F.row_number().over(order).alias("read_order"))


def document_drift(steps: DataFrame, snapshot: DataFrame) -> DataFrame:
    """True for traces that read a document whose stored content is different."""
    reads = steps.where(F.col("key").startswith(LOAD_SKILL) & F.col("filename").isNotNull() & F.col("content").isNotNull()).select(
        "trace_id", _after(F.col("key"), LOAD_SKILL).alias("skill"), "filename", F.sha2("content", 256).alias("read_hash"))
    reads = reads.distinct()
    stored = snapshot.select("skill", "filename", F.sha2("content", 256).alias("stored_hash"))
    joined = reads.join(stored, ["skill", "filename"], "left")
    return joined.groupBy("trace_id").agg(F.coalesce(F.max(F.col("read_hash") != F.col("stored_hash")), F.lit(False)).alias("drift_changed"))


def latest_tool_result(observations: DataFrame) -> DataFrame:
    """One row per trace and tool: last result, position of the first call."""
    key = F.col("name")
    rows = observations.where(key.startswith(TOOL) & ~key.startswith(LOAD_SKILL) & ~key.startswith(LIST_SKILL))
    at = F.struct(F.coalesce("startTime", F.lit("")).alias("start"), "id")
    output = F.col("output")
    result = F.when(V.is_object(output), V.part(output, "$.result")).otherwise(output)
    return rows.groupBy(F.col("traceId").alias("trace_id"), key.alias("step_key")).agg(
        F.max_by(F.to_json(result), at).alias("result_json"), F.min(at).alias("first_call"), F.count(F.lit(1)).alias("calls"))


def humanize_tool(rows: DataFrame) -> DataFrame:
    """Adds label, value and failed for (step_key, result_json)."""
    base = F.split(F.regexp_replace("step_key", "^tool:", ""), "__")[0]
    result = F.try_parse_json("result_json")
    obj = V.is_object(result)
    failed = obj & (V.part(result, "$.error").isNotNull() | V.part(result, "$.info").isNotNull())
    labels = F.create_map(*[F.lit(x) for name, (text, _, _) in K.TOOL_LABELS.items() for x in (name, text)])
    label = F.try_element_at(labels, base)
    value, missing = F.lit(K.TOOL_DONE), F.lit(False)
    for name, (_, field, template) in K.TOOL_LABELS.items():
        here = base == name
        if template == "tpe":
            status = X.strip(V.string_at(result, f"$.{field}"))
            shown, gone = F.coalesce(F.when(status != "", status), F.lit(K.MISSING)), F.lit(False)
        elif "{len}" in template:
            n = F.coalesce(F.size(F.try_variant_get(result, f"$.{field}", "array<variant>")), F.lit(0))
            n = F.greatest(n, F.lit(0))
            shown, gone = F.concat(n.cast("string"), F.lit(template.replace("{len}", ""))), F.lit(False)
        else:
            raw = F.try_variant_get(result, f"$.{field}", "string")
            before, after = template.split("{0}")
            shown, gone = F.concat(F.lit(before), raw, F.lit(after)), ~obj | raw.isNull()
        value, missing = F.when(here, shown).otherwise(value), F.when(here, gone).otherwise(missing)
    bad = failed | missing
    return rows.withColumns({"label": F.coalesce(label, base), "value": F.when(bad, F.lit(K.TOOL_FAILED)).otherwise(value), "failed": bad})


def expected_skill(app: Column) -> Column:
    """Skill for an application text such as "241 - name"."""
    number = F.regexp_extract(app, r"(?U)^\s*(\d+)", 1)
    found = F.lit(None).cast("string")
    for skill, apps in reversed(list(K.APP_SKILLS.items())):
        found = F.when(number.isin(*[str(a) for a in apps]), F.lit(skill)).otherwise(found)
    return F.when(app != "", found)


def coverage_mismatch(turns: DataFrame) -> DataFrame:
    """Expected skill of the app against the skills loaded; none loaded is a mismatch too."""
    want = expected_skill(F.col("app"))
    wrong = want.isNotNull() & ~F.array_contains("skills_used", F.coalesce(want, F.lit("")))
    return turns.withColumns({"expected_skill": want, "mismatch": (F.size("skills_used") == 0) | wrong})


def ticket_facts(first_traces: DataFrame) -> DataFrame:
    """Configured facts per ticket: value or presence only, long numbers masked in free text.

    Expects session_id and the first trace's input payload.
    """
    payload = F.col("input")
    app = F.try_variant_get(payload, V.path_of("other_info", "meta", "App"), "string")
    skill = expected_skill(F.when(~X.is_blank(app), app))
    title = X.strip_title_suffix(V.string_at(payload, "$.other_info.title"))

    def fact(name: str) -> Column:
        raw = title if name == "title" else F.try_variant_get(payload, V.path_of("other_info", "meta", name), "string")
        shown = lambda value: F.lit(None).cast("string") if name in K.PRESENCE_FIELDS else X.mask_digit_runs(value) if name in K.MASKED_FIELDS else value
        return X.let(X.strip(raw), lambda value: F.named_struct(F.lit("value"), F.when(value != "", shown(value)), F.lit("present"), F.coalesce(value != "", F.lit(False))))

    # every field once, and the names that the ticket's skill shows
    names = list(dict.fromkeys(n for fields in (K.DEFAULT_FIELDS, *K.SKILL_FIELDS.values()) for n in (*fields, "title")))
    chosen = F.lit([*K.DEFAULT_FIELDS, "title"])
    for name, fields in K.SKILL_FIELDS.items():
        chosen = F.when(skill == name, F.lit([*fields, "title"])).otherwise(chosen)
    facts = F.map_from_arrays(F.lit(names), F.array(*[fact(n) for n in names]))
    rows = first_traces.select("session_id", facts.alias("__facts"), F.posexplode(chosen).alias("position", "label"))
    return rows.select("session_id", "position", "label", F.try_element_at("__facts", F.col("label")).alias("f")).select("session_id", "position", "label", "f.*")


# ---- rule documents -----------------------------------------------------------------------


def extract_sections(documents: DataFrame) -> DataFrame:
    """Markdown sections per document, in the row itself: no shuffle, whole text.

    Expects path ("skill/references/name.md" or "skill/SKILL.md") and text. SKILL.md files give
    their level-2 sections, other files the level-3 sections after the scenario heading.
    """
    lines = F.split(F.col("text"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    heading = r"(?U)^(#{2,3})(?!#)\s+(.*?)\s*$"
    case_id = r"(?U)^([A-Z](?:\.?\d+[a-z]?)(?:\s*,\s*[A-Z]\.?\d+[a-z]?)*)\s+-\s+(.+)$"
    rows = documents.select("path", lines.alias("lines"))
    rows = rows.withColumn("heads", F.filter(
        F.transform("lines", lambda l, i: F.struct(i.alias("i"), F.length(F.regexp_extract(l, heading, 1)).alias("level"),
                                                   F.regexp_extract(l, heading, 2).alias("text"), (X.strip(l) == "## Kịch bản & Hướng dẫn").alias("anchor"))),
        lambda h: h["level"] > 0))
    is_main = F.element_at(F.split("path", "/"), -1) == "SKILL.md"
    anchor = F.get(F.filter("heads", lambda h: h["anchor"]), F.lit(0))["i"]
    ends = F.transform("heads", lambda h, n: F.struct(h.alias("h"), F.coalesce(F.get(F.col("heads"), n + 1)["i"], F.size("lines")).alias("end")))
    rows = rows.withColumns({"is_main": is_main, "start": F.when(is_main, F.lit(-1)).otherwise(F.coalesce(anchor, F.lit(-1))), "ends": ends})
    wanted = F.filter("ends", lambda e: (e["h"]["i"] > F.col("start")) & (e["h"]["level"] == F.when(F.col("is_main"), 2).otherwise(3)))
    rows = rows.select("path", "lines", "is_main", F.explode(wanted).alias("e"))
    body = F.array_join(F.slice("lines", F.col("e.h.i") + 2, F.col("e.end") - F.col("e.h.i") - 1), "\n")
    head = F.col("e.h.text")
    is_case = ~F.col("is_main") & head.rlike(case_id)
    file = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        F.concat(F.col("path"), F.lit("#L"), (F.col("e.h.i") + 1).cast("string")).alias("anchor"), F.split("path", "/")[0].alias("skill"),
        F.regexp_replace(file, r"\.[^.]*$", "").alias("file_label"), F.when(is_case, F.regexp_extract(head, case_id, 1)).alias("case_id"),
        F.when(is_case, X.strip(F.regexp_extract(head, case_id, 2))).otherwise(head).alias("case_title"),
        F.regexp_replace(body, "^\n+|\n+$", "").alias("body"), F.when(F.col("is_main"), "skill_md").otherwise("sub_skill").alias("source"),
        (F.col("e.h.i") + 1).alias("line"))


def _stored_skill(skill: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for kv in K.SKILL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, skill), skill)


def rule_patterns(reads: DataFrame, features: DataFrame, classes: DataFrame) -> DataFrame:
    """Per trace what decides its rules: files read and skills used, in order, tools called, and the
    message of a tool that gave up (class E7). Traces with equal columns share a pattern_id."""
    files = reads.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("read_order").alias("o"), _stored_skill(F.col("skill")).alias("skill"), F.regexp_replace("filename", r"\.[^.]*$", "").alias("file_label")))).alias("files"))
    gave_up = classes.where("escalation_class = 'E7' and guardrail_reason is not null").select("trace_id", F.struct(F.col("deciding_key").alias("key"), F.col("guardrail_reason").alias("message")).alias("gave_up"))
    rows = features.select("trace_id", F.transform("skills_used", _stored_skill).alias("skills"), F.get("skills_used", F.lit(0)).alias("first_skill"), "tools_called")
    rows = rows.join(files, "trace_id", "left").join(gave_up, "trace_id", "left")
    parts = ["files", "skills", "first_skill", "tools_called", "gave_up"]
    return rows.withColumn("pattern_id", F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def distinct_patterns(patterns: DataFrame) -> DataFrame:
    """One row per pattern: many fewer than traces, since traces of a skill read the same files."""
    names = [c for c in patterns.columns if c not in ("trace_id", "pattern_id")]
    return patterns.groupBy("pattern_id").agg(F.first(F.struct(*names)).alias("p")).select("pattern_id", "p.*")


def pattern_candidates(patterns: DataFrame, rules: DataFrame, cap: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """Sections a pattern could have followed: those of the files read, the main documents of the skills
    used, and the message of the tool that gave up. The first `cap` are kept, `dropped` says how many more there are.

    No pattern can use more than the first `cap` sections of a file, so the rule table is cut to those
    before the join, with the number of all of them; section texts stay in the rule table.
    """
    sections = rules.select(F.col("skill").alias("__skill"), "file_label", "anchor", "line", "case_title", "source")

    def leading(source: str, keys: list[str], order: list[str]) -> DataFrame:
        own = sections.where(F.col("source") == source)
        ranked = own.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= cap)
        return ranked.drop("__n").join(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all")), keys)

    read = patterns.select("pattern_id", F.posexplode("files").alias("o", "f")).select("pattern_id", "o", F.col("f.skill").alias("__skill"), "f.file_label")
    part1 = read.join(leading("sub_skill", ["__skill", "file_label"], ["line", "anchor"]), ["__skill", "file_label"]).withColumn("part", F.lit(1))
    used = patterns.select("pattern_id", F.posexplode("skills").alias("o", "__skill"))
    part2 = used.join(leading("skill_md", ["__skill"], ["file_label", "line", "anchor"]), ["__skill"]).withColumn("part", F.lit(2))
    key = F.col("gave_up.key")
    part3 = patterns.where("gave_up is not null").select(
        "pattern_id", F.coalesce("first_skill", F.lit("khong_xac_dinh")).alias("__skill"), key.alias("file_label"), F.lit(0).alias("o"), key.alias("anchor"), F.lit(0).alias("line"),
        F.lit("Công cụ báo lỗi và yêu cầu chuyển CSKH").alias("case_title"), F.lit("tool_message").alias("source"), F.lit(3).alias("part"), F.lit(1).cast("bigint").alias("__all"), F.col("gave_up.message").alias("message"))
    names = ["pattern_id", "__skill", "file_label", "o", "anchor", "line", "case_title", "source", "part", "__all"]
    none = F.lit(None).cast("string").alias("message")
    rows = part1.select(*names, none).unionByName(part2.select(*names, none)).unionByName(part3.select(*names, "message"))
    # every source of sections counts all of its own once
    total = rows.groupBy("pattern_id", "part", "o").agg(F.max("__all").alias("n")).groupBy("pattern_id").agg(F.sum("n").alias("__total"))
    order = W.partitionBy("pattern_id").orderBy("part", "o", "file_label", "line", "anchor")
    ranked = rows.withColumn("candidate_order", F.row_number().over(order)).where(F.col("candidate_order") <= cap)
    return ranked.join(total, "pattern_id").withColumn("dropped", F.greatest(F.col("__total") - cap, F.lit(0))).withColumnRenamed("__skill", "skill").drop("o", "part", "__all", "__total")


def rule_candidates(reads: DataFrame, features: DataFrame, rules: DataFrame, classes: DataFrame, cap: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """Candidates of every trace: those of its pattern, worked out once per pattern."""
    patterns = rule_patterns(reads, features, classes)
    return patterns.select("trace_id", "pattern_id").join(pattern_candidates(distinct_patterns(patterns), rules, cap), "pattern_id").drop("pattern_id")


def ranked_rules(reads: DataFrame, features: DataFrame, rules: DataFrame, classes: DataFrame, cap: int = K.CANDIDATE_LIMIT, limit: int = K.RANK_LIMIT) -> DataFrame:
    """Best candidates of every trace, scored and ranked once per pattern."""
    patterns = rule_patterns(reads, features, classes)
    distinct = distinct_patterns(patterns)
    ranked = rank_candidates(pattern_candidates(distinct, rules, cap), distinct, rules, limit=limit, key="pattern_id")
    return patterns.select("trace_id", "pattern_id").join(ranked, "pattern_id").drop("pattern_id")


def rank_candidates(candidates: DataFrame, features: DataFrame, rules: DataFrame, known: DataFrame | None = None, limit: int = K.RANK_LIMIT, key: str = "trace_id") -> DataFrame:
    """Best `limit` per trace (or pattern: `key`) by score; equal scores keep their order; `beyond` counts the rest.

    Texts are scored once per distinct (section, tools called), not once per candidate. Values
    known of a ticket, when given, are looked up per candidate.
    """
    rows = candidates.join(features.select(key, "tools_called"), key, "left")
    distinct = rows.select("anchor", "source", "message", "tools_called").distinct()
    texts = rules.select("anchor", F.lower("body").alias("__body"))
    scored = distinct.join(texts, "anchor", "left").withColumn("__body", F.coalesce("__body", F.lower("message"), F.lit("")))
    called = F.coalesce("tools_called", F.array().cast("array<struct<tool:string,n:bigint>>"))
    tools = F.aggregate(called, F.lit(0).cast("bigint"), lambda a, t: a + F.when((t["tool"] != "") & F.contains(F.col("__body"), F.lower(t["tool"])), t["n"]).otherwise(0))
    score = (
        F.when(F.col("source") == "sub_skill", 100).otherwise(0) + tools * 30
        + F.when(F.col("__body").rlike(ESCALATE_PHRASE), 10).otherwise(0) - F.when(F.col("source") == "skill_md", 5).otherwise(0))
    keys = ["anchor", "source", "tools_called"]
    scored = scored.select(*keys, F.coalesce("message", F.lit("")).alias("__m"), score.alias("score"))
    rows = rows.withColumn("__m", F.coalesce("message", F.lit(""))).join(scored, [*keys, "__m"])
    if known is not None:
        rows = rows.join(known.select(key, "known_values"), key, "left").join(texts, "anchor", "left")
        body = F.coalesce("__body", F.lower("message"), F.lit(""))
        hits = F.filter(F.coalesce("known_values", F.array().cast("array<string>")), lambda v: (v != "") & F.contains(body, F.lower(v)))
        rows = rows.withColumn("score", F.col("score") + F.size(hits) * 20).drop("known_values", "__body")
    order = W.partitionBy(key).orderBy(F.desc("score"), "candidate_order")
    beyond = F.greatest(F.count(F.lit(1)).over(W.partitionBy(key)) - limit, F.lit(0))  # candidates are capped per key
    ranked = rows.withColumns({"rank": F.row_number().over(order), "beyond": beyond}).where(F.col("rank") <= limit)
    return ranked.drop("tools_called", "__m")


def ground_check(rows: DataFrame) -> DataFrame:
    """Adds grounded: conclusion is filled, confident in a known way, free of long numbers and
    banned words, and every number in it occurs in the evidence."""
    text = F.col("conclusion")
    plain = lambda c: F.regexp_replace(c, "[.,]", "")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"((?U)\d[\d.,]*\d|\d)"), 1), plain)
    evidence = plain(F.coalesce("evidence", F.lit("")))
    words = "|".join(f"\\Q{w.lower()}\\E" for w in K.BANNED_WORDS)
    banned = F.lower(text).rlike(rf"(?U)\b(?:{words})\b")
    ok = (
        ~X.is_blank(text) & F.col("confidence").isin(*K.CONFIDENCES) & ~text.rlike("[0-9]{6}") & ~banned
        & F.forall(numbers, lambda n: F.contains(evidence, n))
    )
    return rows.withColumn("grounded", F.coalesce(ok, F.lit(False)))
