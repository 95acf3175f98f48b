"""Dimensions of a ticket and the signals its observations carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import variants as V

_META = ("other_info", "meta")


def dimension_value(payload: Column, name: str) -> Column:
    found = V.string_at(payload, V.path_of(*_META, *K.DIMENSION_PATHS[name]))
    return F.coalesce(X.let(found, lambda t: F.when(t.rlike(r"(?U)\S"), t)), F.lit(K.MISSING))


def app_code(app: Column) -> Column:
    return F.try_to_number(F.regexp_extract(app, r"(?U)^\s*([0-9]+)(?:\s|$)", 1), F.lit("9" * 18)).cast("bigint")


def parse_meta_code(text: Column) -> tuple[Column, Column]:
    """(code, status) of "<code> <status>"; both null for anything else or phone-like digits."""
    pattern = r"(?sU)^(-?[0-9]{1,6})(?:\s+(.*))?$"

    def parsed(value: Column) -> Column:
        pair = F.named_struct(F.lit("code"), F.regexp_extract(value, pattern, 1), F.lit("status"), F.regexp_extract(value, pattern, 2))
        return F.when(value.rlike(pattern) & ~X.has_phone_digits(value), pair)

    both = X.let(X.strip(text), parsed)
    return both["code"], F.nullif(both["status"], F.lit(""))


def extract_dimensions(records: DataFrame) -> DataFrame:
    payload = F.col("input")
    staged = records.select("*", *[dimension_value(payload, d).alias(d) for d in K.DIMENSION_PATHS],
                            V.string_at(payload, V.path_of(*_META, K.TPE_CODE_KEY)).alias("__tpe"))
    code, status = parse_meta_code(F.col("__tpe"))
    # A text of nothing but letters cannot hold a code: the usual case costs one test.
    maybe = F.col("__tpe").rlike("[0-9]")
    code, status = F.when(maybe, code), F.when(maybe, status)
    return staged.select(
        "*", app_code(F.col("app")).alias("app_code"), code.alias("tpe_code"), status.alias("tpe_status_raw"),
        V.string_at(payload, "$.model_info.model_core").alias("model_core"),
    ).drop("__tpe")


# ---- signals ------------------------------------------------------------------------------


def is_blocking_guardrail(output: Column) -> Column:
    blocked = reduce(lambda a, b: a | b, [V.is_true(output, f"$.{f}") for f in K.BLOCKED_FIELDS])
    return blocked | V.is_false(output, f"$.{K.PASSED_FIELD}")


def guardrail_signal(metadata: Column, output: Column) -> Column:
    """First-generation test: `violation` counts when truthy, in metadata or output."""
    tests = [
        V.is_false(c, f"$.{K.PASSED_FIELD}") | V.is_true(c, "$.blocked") | V.is_truthy(c, "$.violation")
        for c in (metadata, output)
    ]
    return tests[0] | tests[1]


def _tpe_token(payload: Column, path: str) -> Column:
    kind = V.type_of(payload, path)
    text = F.when(kind.isin("BIGINT", "STRING"), F.try_variant_get(payload, path, "string"))
    return F.when(text.rlike(X.TPE_TOKEN), text)


def tpe_signal(output: Column) -> Column:
    """(transstatus, stepresult) of one observation; null without a valid status code."""
    status = _tpe_token(output, "$.result.transstatus")
    step = _tpe_token(output, "$.result.stepresult")
    return F.when(status.isNotNull(), F.struct(status.alias("transstatus"), step.alias("step_result")))


def transfer_reason_code(rule: Column, source: Column, stage: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in K.REASON_BY_RULE.items() for x in pair])
    return (
        F.when((rule == "cs_escalation") & (source == K.OBS_SKILL_GUARD) & (stage == "output"), "skill_suggested_transfer")
        .when((rule == "cs_escalation") & (source == K.OBS_OUTPUT_GUARD), "ai_response_requires_transfer")
        .otherwise(F.coalesce(F.try_element_at(known, rule), F.lit("other_guardrail")))
    )


def observation_signals(observations: DataFrame, prefix: str = K.SKILL_PREFIX) -> DataFrame:
    """Long form (trace_id, kind, a, b, c, d, rank): one narrow row per signal, deduplicated.

    Grouping by the whole signal spreads a trace with very many observations over tasks; `rank`
    keeps the earliest occurrence, by source order and then observation order.
    """
    name, output, payload, metadata = F.col("name"), F.col("output"), F.col("input"), F.col("metadata")
    rule = V.filled_string_at(output, "$.rule")
    known_rule = F.when(rule.isin(*K.GUARDRAIL_RULES) & ~rule.isin(*K.COMPLIANT_RULES), rule)
    is_guard = name.isin(K.OBS_INPUT_GUARD, K.OBS_SKILL_GUARD, K.OBS_OUTPUT_GUARD)
    raw_stage = V.filled_string_at(payload, "$.stage")
    stage = F.when((name == K.OBS_SKILL_GUARD) & raw_stage.isin("input", "output"), raw_stage)
    skill = F.when(name == K.OBS_SKILL_GUARD, X.safe_skill(V.filled_string_at(payload, "$.skill"), prefix))
    order = (
        F.when((name == K.OBS_INPUT_GUARD), 0).when((name == K.OBS_SKILL_GUARD) & (stage == "input"), 1)
        .when((name == K.OBS_SKILL_GUARD) & (stage == "output"), 2).when(name == K.OBS_OUTPUT_GUARD, 3).otherwise(4)
    )
    rank = F.struct(order.alias("source_order"), F.coalesce("startTime", F.lit("")).alias("start"), F.coalesce("id", F.lit("")).alias("oid"))
    none = F.lit(None).cast("string")

    def signal(kind: str, a: Column, b: Column = none, c: Column = none, d: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))

    skills = F.array_distinct(F.filter(F.transform(V.strings_at(metadata, "$.skills_used"), lambda s: X.safe_skill(s, prefix)),
                                       lambda s: s.isNotNull()))
    tpe = tpe_signal(output)
    empty = F.array().cast("array<struct<kind:string,a:string,b:string,c:string,d:string>>")
    found = (
        F.when(name == K.OBS_INTENT, F.array(signal("intent", V.filled_string_at(metadata, "$.intent"))))
        .when(name == K.OBS_SKILL, F.transform(skills, lambda s: signal("skill", s)))
        .when(is_guard, F.array(signal("rule", known_rule),
                                F.when(is_blocking_guardrail(output), signal("event", known_rule, name, stage, skill))))
        .when(name == K.OBS_HISTORY_GUARD, F.array(F.when(V.is_true(output, "$.blocked"), signal("history", F.lit("blocked")))))
        .when(name == K.OBS_TPE, F.array(F.when(tpe.isNotNull(), signal("tpe", tpe["transstatus"], tpe["step_result"]))))
        .otherwise(empty)
    )
    rows = observations.where(F.col("traceId") != "").select(F.col("traceId").alias("trace_id"), rank.alias("rank"), F.explode(found).alias("s"))
    rows = rows.where("s.a is not null").select("trace_id", "s.*", "rank")
    return rows.groupBy("trace_id", "kind", "a", "b", "c", "d").agg(F.min("rank").alias("rank"))


def _values(kind: str) -> Column:
    return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("a"))))


def _tpe_pairs() -> Column:
    """Sorted by number, a missing step after every real one."""
    order = F.struct(F.col("a").cast("int").alias("n"), F.col("b").isNull().alias("m"), F.col("b").cast("int").alias("s"),
                     F.struct(F.col("a").alias("transstatus"), F.col("b").alias("step_result")).alias("pair"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == "tpe", order)))
    return F.transform(ordered, lambda x: x["pair"])


def build_trace_enrichment(signals: DataFrame) -> DataFrame:
    """One row per trace that carries any signal."""
    event = F.struct("rank.source_order", "rank.start", "rank.oid", "a", F.coalesce("d", F.lit("")).alias("dk"),
                     F.struct(F.col("a").alias("rule"), F.col("b").alias("source"), F.col("c").alias("stage"), F.col("d").alias("skill")).alias("e"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == "event", event)))
    return signals.groupBy("trace_id").agg(
        _values("intent").alias("intents"), _values("skill").alias("skills"), _values("rule").alias("guardrail_rules"),
        F.transform(ordered, lambda x: x["e"]).alias("guardrail_events"),
        F.max(F.col("kind") == "history").alias("escalation_guard_blocked"), _tpe_pairs().alias("tpe_signals"),
    )


def only_value(values: Column) -> Column:
    """The value of a one-element set, null otherwise: conflicting signals are not guessed."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def only_value_of(kind: str) -> Column:
    """Aggregate: the value of a signal kind if there is only one. Fixed size, unlike a set."""
    value = F.when(F.col("kind") == kind, F.col("a"))
    return F.when(F.min(value) == F.max(value), F.min(value))


def session_signals(traces: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of all traces of a ticket: published ones as sets, deduplicated before they are
    collected. Intents are free text of a model, so only the single one is kept."""
    owned = signals.join(traces.select("trace_id", "session_id"), "trace_id")
    unique = owned.groupBy("session_id", "kind", "a", "b").agg(F.lit(1).alias("one"))
    return unique.groupBy("session_id").agg(
        only_value_of("intent").alias("intent"), _values("skill").alias("skill_set"),
        _values("rule").alias("guardrail_rules"), F.max(F.col("kind") == "history").alias("escalation_guard_blocked"),
        _tpe_pairs().alias("tpe_signals"),
    )


def attach_enrichment(sessions: DataFrame, traces: DataFrame, signals: DataFrame) -> DataFrame:
    found = session_signals(traces, signals.where("kind <> 'event'"))
    empty = F.array().cast("array<string>")
    joined = sessions.join(found, "session_id", "left")
    sets = {c: F.coalesce(c, empty) for c in ("skill_set", "guardrail_rules")}
    sets["tpe_signals"] = F.coalesce("tpe_signals", F.array().cast("array<struct<transstatus:string,step_result:string>>"))
    sets["escalation_guard_blocked"] = F.coalesce("escalation_guard_blocked", F.lit(False))
    joined = joined.withColumns(sets)
    return joined.withColumns({
        "skill": only_value(F.col("skill_set")), "guardrail_rule": only_value(F.col("guardrail_rules")), "skill_count": F.size("skill_set"),
    })


def transfer_trigger(sessions: DataFrame, signals: DataFrame) -> DataFrame:
    """First ordered guardrail event of the first transfer trace of each ticket."""
    events = signals.where("kind = 'event'")
    first = F.min(F.struct("rank.source_order", "rank.start", "rank.oid", "a", F.coalesce("d", F.lit("")).alias("dk"), "b", "c", "d")).alias("t")
    best = events.groupBy("trace_id").agg(first)
    stage, skill, rule, source = F.col("t.c"), F.col("t.d"), F.col("t.a"), F.col("t.b")
    best = best.select(
        F.col("trace_id").alias("first_transfer_trace_id"), transfer_reason_code(rule, source, stage).alias("trigger_reason"),
        rule.alias("trigger_rule"), source.alias("trigger_source"), stage.alias("trigger_stage"), skill.alias("trigger_skill"),
    )
    return sessions.join(best, "first_transfer_trace_id", "left")


def enrich_sessions(sessions: DataFrame, traces: DataFrame, signals: DataFrame) -> DataFrame:
    return transfer_trigger(attach_enrichment(sessions, traces, signals), signals)


# ---- governed transaction status ----------------------------------------------------------


def tpe_mapping(spark) -> DataFrame:
    rows = [(i, code, list(steps), case, status) for i, (code, steps, case, status) in enumerate(K.TPE_MAPPING)]
    return spark.createDataFrame(rows, "ord int, code string, steps array<string>, case int, status string")


def resolve_tpe_status(pairs: DataFrame, mapping: DataFrame, code: str = "transstatus", step: str = "step_result") -> DataFrame:
    """Governed status of each (code, step): a mapping without steps fits every step, first match wins.

    The mapping is a few dozen literal rows; exploding its steps turns the lookup into an equi join.
    """
    exact = mapping.select("ord", F.col("code").alias("__code"), F.explode("steps").alias("__step"), "status")
    any_step = mapping.where(F.size("steps") == 0).select("ord", F.col("code").alias("__code"), F.lit(None).cast("string").alias("__step"), "status")
    table = exact.unionByName(any_step)
    by_code = table.groupBy("__code").agg(F.array_sort(F.collect_list(F.struct("ord", "__step", "status"))).alias("__rules"))
    joined = pairs.join(by_code, pairs[code] == by_code["__code"], "left")
    fits = F.filter("__rules", lambda r: r["__step"].isNull() | (r["__step"] == F.col(step)))
    return joined.withColumn("status", F.get(fits, F.lit(0))["status"]).drop("__code", "__rules")


def skill_bucket(skill_set: Column) -> Column:
    return (
        F.when(F.size(skill_set) >= 2, F.lit(K.MULTI_SKILL))
        .when(F.size(skill_set) == 1, X.safe_dimension(F.get(skill_set, F.lit(0))))
        .otherwise(F.lit(K.NO_SKILL))
    )


def unique_transstatus(pairs: Column) -> Column:
    return only_value(F.array_distinct(F.transform(pairs, lambda p: p["transstatus"])))


# ---- first-generation categories ----------------------------------------------------------


def category_from_keywords(payload: Column) -> Column:
    """Accent-folded keyword match over the title and the allow-listed meta values."""
    texts = [V.string_at(payload, "$.other_info.title")]
    for depth in range(K.KEYWORD_META_DEPTH):
        base = F.try_variant_get(payload, V.path_of(*_META), "map<string,variant>")
        level = F.map_entries(base)
        for _ in range(depth):
            nested = F.transform(level, lambda e: F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")))
            level = F.flatten(F.filter(nested, lambda x: x.isNotNull()))
        hits = F.filter(level, lambda e: e["key"].isin(*K.KEYWORD_META_KEYS) & (F.schema_of_variant(e["value"]) == "STRING"))
        texts.append(F.concat_ws("\u0000", F.transform(hits, lambda e: F.try_variant_get(e["value"], "$", "string"))))
    return keyword_category(F.concat_ws("\u0000", *texts), V.is_object(payload, "$.other_info") & (
        (V.type_of(payload, "$.other_info.title") == "STRING") | V.is_object(payload, "$.other_info.meta")))


def keyword_category(text: Column, usable: Column) -> Column:
    folded = X.accent_fold(text)
    hits = F.filter(F.array(*[
        F.when(reduce(lambda a, b: a | b, [folded.contains(w) for w in words]), F.lit(name))
        for name, words in K.KEYWORD_PATTERNS.items()
    ]), lambda x: x.isNotNull())
    result = F.when(F.size(hits) > 1, "multiple").otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit("other")))
    return F.when(F.coalesce(usable, F.lit(False)), result).otherwise("unknown")


def category_from_tpe(observations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped case per trace: the only one, "multiple" or "unknown"."""
    output, result = F.col("output"), "$.result"
    is_tpe = (F.col("name") == K.OBS_TPE) | V.string_at(F.col("metadata"), "$.tool_name").isin(K.OBS_TPE, K.OBS_TPE.removeprefix("tool:"))

    def scalar(path: str) -> Column:
        return F.when(V.type_of(output, path).isin("BIGINT", "STRING"), F.try_variant_get(output, path, "string"))

    code = F.coalesce(scalar(f"{result}.transstatus"), scalar(f"{result}.tpe_error_code"))
    pairs = observations.select(F.col("traceId").alias("trace_id"), F.when(is_tpe, code).alias("code"), scalar(f"{result}.stepresult").alias("step"))
    exact = mapping.select(F.col("code").alias("c"), F.explode("steps").alias("s"), F.col("case").alias("exact_case"))
    wild = mapping.where(F.size("steps") == 0).select(F.col("code").alias("c"), F.col("case").alias("wild_case"))
    joined = pairs.join(exact, (pairs["code"] == exact["c"]) & (pairs["step"] == exact["s"]), "left").drop("c", "s")
    joined = joined.join(wild, joined["code"] == wild["c"], "left").drop("c")
    hit = F.when(F.col("exact_case").isNotNull(), F.struct("code", "step", F.col("exact_case").alias("case"))).when(
        F.col("wild_case").isNotNull(), F.struct("code", F.lit(None).cast("string").alias("step"), F.col("wild_case").alias("case")))
    found = joined.select("trace_id", hit.alias("m")).distinct()
    return _one_many_unknown(found.withColumn("v", F.col("m.case").cast("string")), "tpe_category")


def category_from_guardrail(observations: DataFrame) -> DataFrame:
    """Allowed rule of the blocking observations per trace: the only one, "multiple" or "unknown"."""
    metadata, output = F.col("metadata"), F.col("output")
    values = F.array(*[V.string_at(c, f"$.{f}") for c in (metadata, output) for f in K.RULE_FIELDS])
    allowed = F.filter(values, lambda v: v.isin(*K.GUARDRAIL_RULES))
    usable = F.when(guardrail_signal(metadata, output), allowed).otherwise(F.array().cast("array<string>"))
    found = observations.select(F.col("traceId").alias("trace_id"), F.explode_outer(usable).alias("v")).distinct()
    return _one_many_unknown(found, "guardrail_category")


def _one_many_unknown(found: DataFrame, name: str) -> DataFrame:
    value = F.when(F.count("v") > 1, "multiple").otherwise(F.coalesce(F.min("v"), F.lit("unknown")))
    return found.groupBy("trace_id").agg(value.alias(name))
