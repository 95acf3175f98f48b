"""Data-quality measures and reconciliation checks: rows of (check, scope, expected, actual, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import variants as V
from .weekly import by_definition


def dimension_coverage(normalized: DataFrame, raw_tickets: DataFrame) -> DataFrame:
    """Raw-denominator coverage of category and transaction code, with gates and gap counts.

    `normalized` holds valid trace rows with payload and extracted dimensions; `raw_tickets` every
    ticket trace with its session id, null when it has none.
    """
    path = "$" + '.other_info.meta["Thông tin thêm"].sub_source'
    kind = V.type_of(F.col("input"), path)
    entry = X.strip(X.nfkc(F.try_variant_get("input", path, "string")))
    state = F.when(kind.isNull(), "<absent>").when(kind != "STRING", "<invalid-type>").when(
        F.lower(entry).isin("", "null", "none", "undefined"), "<null-string>").when(entry == "tranxdetail", "tranxdetail").when(
        entry == "resultpage", "resultpage").otherwise("<other-valid>")
    category = X.nfkc(X.strip(F.col("issue_category"))) != K.MISSING
    status = F.when(F.col("tpe_status_raw").isin(*K.SAFE_STATUSES), F.col("tpe_status_raw"))
    marked = normalized.select("session_id", "turn", "ts", "trace_id", state.alias("state"), category.alias("has_category"),
                               F.col("tpe_code").isNotNull().alias("has_tpe"), "tpe_code", status.alias("tpe_status"))
    first = marked.groupBy("session_id").agg(F.min(F.struct("turn", "ts", "trace_id", "state", "has_category", "has_tpe", "tpe_code", "tpe_status")).alias("f"))
    return first.select("session_id", "f.state", "f.has_category", "f.has_tpe", "f.tpe_code", "f.tpe_status"), raw_denominator(raw_tickets)


def raw_denominator(raw_tickets: DataFrame) -> DataFrame:
    """Distinct session ids plus every trace without one."""
    keyed = F.coalesce(F.col("session_id"), F.lit("")) != ""
    ids = raw_tickets.where(keyed).select("session_id").distinct().agg(F.count(F.lit(1)).alias("keyed"))
    loose = raw_tickets.where(~keyed).agg(F.count(F.lit(1)).alias("unkeyed"))
    return ids.select((F.col("keyed") + loose.scalar()).alias("ticket_count"))


def coverage_report(first: DataFrame, denominator: DataFrame) -> DataFrame:
    sums = first.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("has_category").alias("issue_category_present_count"), F.count_if("has_tpe").alias("tpe_present_count"),
        F.count_if(F.col("state") == "tranxdetail").alias("applicable_ticket_count"),
        F.count_if((F.col("state") == "tranxdetail") & F.col("has_tpe")).alias("applicable_tpe_present"),
        F.count_if(F.col("state").isin("resultpage", "<other-valid>")).alias("non_applicable_ticket_count"),
        F.count_if(F.col("state") == "<absent>").alias("entry_point_absent_count"), F.count_if(F.col("state") == "<null-string>").alias("entry_point_null_string_count"),
        F.count_if(F.col("state") == "<invalid-type>").alias("entry_point_invalid_type_count"))
    sums = sums.withColumn("ticket_count", denominator.scalar())
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0))
    sums = sums.withColumns({
        "diagnostic_uninspectable_ticket_count": F.col("ticket_count") - F.col("sessions"),
        "coverage_issue_category": share("issue_category_present_count", "ticket_count"), "coverage_tpe": share("tpe_present_count", "ticket_count"),
        "coverage_tpe_applicable": share("applicable_tpe_present", "applicable_ticket_count")})
    sums = sums.withColumns({"p0_issue_category_pass": F.col("coverage_issue_category") >= 0.90, "p0_tpe_pass": F.col("coverage_tpe") >= 0.85})
    return sums.withColumn("p0_pass", F.col("p0_issue_category_pass") & F.col("p0_tpe_pass")).drop("sessions")


UNINSPECTABLE = "<uninspectable>"


def category_gaps(first: DataFrame, denominator: DataFrame) -> DataFrame:
    """Tickets without a category by the state of their entry point; tickets none of whose traces could be read are a state of their own."""
    gaps = first.where(~F.col("has_category")).groupBy("state").agg(F.count(F.lit(1)).alias("count"))
    seen = first.agg(F.count(F.lit(1)).alias("n")).scalar()
    unread = denominator.select(F.lit(UNINSPECTABLE).alias("state"), (F.col("ticket_count") - seen).alias("count")).where("count > 0")
    return gaps.unionByName(unread)


def coverage_report_checks(report: DataFrame) -> DataFrame:
    """The diagnostic populations close on the raw denominator, and shares are divisions."""
    parts = ("applicable_ticket_count", "non_applicable_ticket_count", "entry_point_absent_count", "entry_point_null_string_count", "entry_point_invalid_type_count", "diagnostic_uninspectable_ticket_count")
    share = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    whole = F.lit("all")
    return _explode(report, [
        check_row("populations_close", whole, F.col("ticket_count"), sum((F.col(p) for p in parts), F.lit(0))),
        check_row("sessions_within_denominator", whole, F.lit(1), (F.col("diagnostic_uninspectable_ticket_count") >= 0).cast("int")),
        check_row("category_is_division", whole, share("issue_category_present_count", "ticket_count"), F.col("coverage_issue_category")),
        check_row("tpe_is_division", whole, share("tpe_present_count", "ticket_count"), F.col("coverage_tpe")),
        check_row("applicable_is_division", whole, share("applicable_tpe_present", "applicable_ticket_count"), F.col("coverage_tpe_applicable"))])


def unmapped_codes(first: DataFrame) -> DataFrame:
    return first.where("has_tpe").groupBy("tpe_code", "tpe_status").agg(F.count(F.lit(1)).alias("count"))


def data_quality_score(coverage: DataFrame, gate: DataFrame, fresh: Column) -> DataFrame:
    """Weighted score 0-100 with a tone band."""
    row = coverage.withColumn("structural_valid_rate", 1 - gate.select("structural_invalid_rate").scalar())
    weighted = (0.4 * F.col("structural_valid_rate") + 0.2 * F.col("issue_category") + 0.2 * F.col("tpe") + 0.1 * F.col("skill")
                + 0.1 * F.when(fresh, 1.0).otherwise(0.0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 * weighted + 0.5)))
    return row.select(score.alias("score"), F.when(score >= 90, "good").when(score >= 70, "warning").otherwise("critical").alias("tone"), "structural_valid_rate")


# ---- profiles of JSON payloads ------------------------------------------------------------


def _nesting(payload: Column) -> Column:
    """How many objects and arrays lie inside each other, from the payload's JSON without its strings."""
    plain = F.regexp_replace(F.to_json(payload), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    step = lambda a, c: F.when(c.isin("[", "{"), a["now"] + 1).when(c.isin("]", "}"), a["now"] - 1).otherwise(a["now"])
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(brackets, start, lambda a, c: F.struct(step(a, c).alias("now"), F.greatest(a["most"], step(a, c)).alias("most")), lambda a: a["most"])


def _levels(rows: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, path, name, value) of every node at any depth; arrays are one path with [], and items have no name.

    One aggregate finds how deep the payloads go (their joint schema can't say, where types differ).
    One scan then unfolds a level per step: a node passes on itself, marked as done, and its children.
    """
    depth = rows.agg(F.max(_nesting(F.col(column))).alias("n")).first()["n"]
    none = F.lit(None).cast("string")
    nodes = rows.select(*keep, F.lit("").alias("path"), none.alias("name"), F.col(column).alias("value"), F.lit(False).alias("done"))
    for _ in range(depth or 0):
        kind = F.schema_of_variant("value")
        pairs = F.when(kind.startswith("OBJECT"), F.map_entries(F.try_variant_get("value", "$", "map<string,variant>")))
        items = F.when(kind.startswith("ARRAY"), F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v: F.struct(none.alias("key"), v.alias("value"))))

        def child(e):
            path = F.when(e["key"].isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", F.nullif("path", F.lit("")), e["key"]))
            return F.struct(path.alias("path"), e["key"].alias("name"), e["value"].alias("value"), F.lit(False).alias("done"))

        own = F.array(F.struct("path", "name", "value", F.lit(True).alias("done")))
        children = F.when(~F.col("done"), F.transform(F.coalesce(pairs, items), child))
        nodes = nodes.select(*keep, F.inline(F.when(children.isNull(), own).otherwise(F.concat(own, children))))
    return nodes.drop("done")


def payload_shape_profile(rows: DataFrame, column: str) -> DataFrame:
    """Types per path, list sizes, and whether a path looks like it names an agent."""
    nodes = _levels(rows, column)
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^([A-Z]+)", 1)
    size = F.when(kind == "ARRAY", F.size(F.try_variant_get("value", "$", "array<variant>")))
    leaf = F.lower(F.element_at(F.split("path", r"\."), -1))
    agent = leaf.contains("agent") | leaf.contains("responder") | (leaf == "user_id")
    return nodes.groupBy("path").agg(
        F.array_join(F.sort_array(F.collect_set(kind)), "|").alias("types"), F.min(size).alias("min_items"), F.max(size).alias("max_items"),
        F.max(agent).alias("agent_like"), F.count(F.lit(1)).alias("seen"))


def identity_profile(rows: DataFrame, column: str) -> DataFrame:
    """Candidate key paths (last name is id): always present and unique, with collision counts."""
    nodes = _levels(rows, column).where(F.col("path").rlike(r"(^|\.)id$") & ~F.schema_of_variant("value").rlike("^(VOID|BOOLEAN|OBJECT|ARRAY)"))
    values = nodes.groupBy("path", F.to_json("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    stats = values.groupBy("path").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("distinct_values"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stats.withColumn("rows", total).select(
        "path", "rows", "seen", "distinct_values", (F.col("seen") - F.col("distinct_values")).alias("collisions"), (F.col("rows") - F.col("seen")).alias("missing"),
        ((F.col("seen") == F.col("rows")) & (F.col("distinct_values") == F.col("rows"))).alias("is_key"))


def rating_tokens(rows: DataFrame) -> DataFrame:
    """Histogram of (survey, rating token)."""
    return rows.groupBy("survey_id", "rating").agg(F.count(F.lit(1)).alias("count"))


def denied_columns(schema, extra: tuple[str, ...] = (), prefix: str = "") -> list[str]:
    """Schema paths a published report must not contain."""
    found = []
    for field in getattr(schema, "fields", []):
        path = f"{prefix}.{field.name}" if prefix else field.name
        if field.name in K.DENIED_KEYS + extra:
            found.append(path)
        inner = getattr(field.dataType, "elementType", field.dataType)
        found += denied_columns(inner, extra, path)
    return found


def pii_scan(rows: DataFrame, key: str, denied: tuple[str, ...] = K.DENIED_KEYS) -> DataFrame:
    """(key, path, problem) of whatever a published row must not hold, at any depth of any column.

    Structs, arrays, maps and VARIANT payloads are walked alike. Problems: denied_key (a field with a
    name on the list), identifying_key and identifying_value (a phone- or uuid-shaped text, in the
    digits of any script, whatever stands between them).
    """
    nested = [F.to_variant_object(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in rows.schema.fields if f.name != key]
    held = rows.select(key, F.to_variant_object(F.struct(*nested)).alias("__row"))
    nodes = _levels(held, "__row", (key,)).where("path <> ''")
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    name = X.nfc(F.col("name"))
    problems = F.array_compact(F.array(
        F.when(F.coalesce(name.isin(*denied), F.lit(False)), F.lit("denied_key")), F.when(X.has_private_identifier(name), F.lit("identifying_key")),
        F.when(X.has_private_identifier(text), F.lit("identifying_value"))))
    return nodes.select(key, "path", F.explode(problems).alias("problem")).distinct()


# ---- reconciliation checks ----------------------------------------------------------------


def check_row(name: str, scope: Column, expected: Column, actual: Column) -> Column:
    e, a = expected.cast("double"), actual.cast("double")
    return F.struct(F.lit(name).alias("check"), scope.cast("string").alias("scope"), e.alias("expected"), a.alias("actual"), e.eqNullSafe(a).alias("ok"))


def _explode(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def _violations(name: str, rows: DataFrame) -> DataFrame:
    """A check that holds when no row is found."""
    return _explode(rows.agg(F.count(F.lit(1)).alias("n")), [check_row(name, F.lit("all"), F.lit(0), F.col("n"))])


def disjoint_groups(selection: DataFrame) -> DataFrame:
    """Sessions in more than one selection group: must be empty."""
    return selection.groupBy("session_id").agg(F.count_distinct("selection_group").alias("groups")).where("groups > 1")


def weekly_checks(weekly: DataFrame, sessions: DataFrame) -> DataFrame:
    """Weekly identities, and equality with an independent recount from the tickets."""
    scope = F.concat_ws("/", "week_definition", F.col("cohort_week").cast("string"))
    total = F.col("total_tickets")
    own = _explode(weekly, [
        check_row("ai_first_is_sum", scope, F.col("ai_end_to_end_count") + F.col("ai_then_cs_count"), F.col("ai_first_count")),
        check_row("outcomes_close", scope, total, sum((F.col(f"{o}_count") for o in K.OUTCOMES), F.lit(0))),
        check_row("gt4_within_total", scope, F.lit(1), (F.col("gt4_turn_with_cs") + F.col("gt4_turn_without_cs") <= total).cast("int")),
        check_row("has_data_matches", scope, (total > 0).cast("int"), F.col("has_data").cast("int")),
        check_row("ai_rate_is_division", scope, F.coalesce(F.try_divide("ai_first_count", total), F.lit(0.0)), F.col("ai_first_rate")),
    ])
    recount = by_definition(sessions.select("cohort_week", "is_weekend_start", "reopen_lifetime")).groupBy("week_definition", "cohort_week").agg(
        F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum("reopen_lifetime"), F.lit(0)).alias("__r"))
    joined = weekly.join(recount, ["week_definition", "cohort_week"], "left")
    return own.unionByName(_explode(joined, [
        check_row("total_recount", scope, F.coalesce("__n", F.lit(0)), total),
        check_row("reopen_recount", scope, F.coalesce("__r", F.lit(0)), F.col("reopen_lifetime_numerator"))]))


def session_rules(columns: list[str]) -> dict[str, Column]:
    """Row rules of the ticket facts: name and what a broken row looks like."""
    local_day = F.convert_timezone(F.lit("UTC"), F.lit(K.TIMEZONE), F.col("turn0_ts")).cast("date")
    rules = {
        "weekend_flag": F.col("is_weekend_start") != (F.weekday(local_day) >= 5),
        "in_reporting_range": ~F.col("cohort_status").isin("complete", "wtd"),
        "transfer_set": F.col("transferred") != F.col("first_transfer_trace_id").isNotNull(),
    }
    if "guardrail_rule" in columns:
        single = F.when(F.size("guardrail_rules") == 1, F.get("guardrail_rules", F.lit(0)))
        rules["rule_scalar"] = ~F.col("guardrail_rule").eqNullSafe(single)
    return rules


def ticket_rules() -> dict[str, Column]:
    """Row contract of the public ticket list."""
    return {
        "ticket_id_safe": F.col("ticket_id").isNull() | ~X.is_safe_ticket_id(F.col("ticket_id")),
        "outcome_known": ~F.col("outcome").isin(*K.OUTCOMES),
        "gt4_follows_turns": F.col("gt4_turn") != (F.col("turn_count") > 3),
        "week_is_monday": F.weekday("cohort_week") != 0,
        "reason_with_transfer": F.col("transferred") != F.col("transfer_reason").isNotNull(),
        "reopen_with_ai_first": F.col("reopen_lifetime").isNotNull() != F.col("ai_first"),
    }


def broken_counts(rules: dict[str, Column]) -> list[Column]:
    """One count of broken rows per rule, for an aggregate or for `DataFrame.observe`; null is not broken."""
    return [F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()]


def rule_checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules in one pass over the rows."""
    return _explode(rows.agg(*broken_counts(rules)), [check_row(name, F.lit("all"), F.lit(0), F.col(name)) for name in rules])


def session_checks(sessions: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Ticket grain, flags and group membership."""
    again = sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = rule_checks(sessions, session_rules(sessions.columns)).unionByName(_violations("session_unique", again))
    if selection is not None:
        eligible = selection.where("selection_group = 'eligible'").select("session_id", F.lit(True).alias("__selected"))
        both = eligible.join(sessions.select("session_id", F.lit(True).alias("__analyzed")), "session_id", "full_outer").where("__selected is null or __analyzed is null")
        out = out.unionByName(_violations("groups_disjoint", disjoint_groups(selection))).unionByName(_violations("eligible_is_analyzed", both))
    return out


def view_checks(views: DataFrame) -> DataFrame:
    """Identities of the totals, and weekly rows adding up to the overall row."""
    scope = F.concat_ws("/", "week_definition", F.coalesce(F.col("cohort_week").cast("string"), F.lit("all")))
    own = _explode(views, [
        check_row("outcomes_close", scope, F.col("eligible_ticket_count"), sum((F.col(o) for o in K.OUTCOMES), F.lit(0))),
        check_row("ai_first_is_sum", scope, F.col("ai_end_to_end") + F.col("ai_then_cs"), F.col("ai_first_count")),
        check_row("transfer_is_sum", scope, F.col("ai_then_cs") + F.col("direct_cs"), F.col("transfer_total")),
        check_row("gt4_is_sum", scope, F.col("gt4_turn_with_cs") + F.col("gt4_turn_without_cs"), F.col("gt4_turn_total")),
    ])
    sums = views.groupBy("week_definition").agg(*[x for c in ("eligible_ticket_count", "transfer_total", "reopen_lifetime_numerator") for x in (
        F.sum(F.when(F.col("cohort_week").isNotNull(), F.col(c))).alias(f"w_{c}"), F.sum(F.when(F.col("cohort_week").isNull(), F.col(c))).alias(f"t_{c}"))])
    rolled = _explode(sums, [check_row(f"weeks_add_up_{c}", F.col("week_definition"), F.col(f"t_{c}"), F.col(f"w_{c}")) for c in (
        "eligible_ticket_count", "transfer_total", "reopen_lifetime_numerator")])
    return own.unionByName(rolled)


def segment_checks(segments: DataFrame, views: DataFrame) -> DataFrame:
    """Every dimension closes on the view total, has its missing bucket, and weeks add up."""
    week = F.coalesce(F.col("cohort_week"), F.lit("1900-01-01").cast("date")).alias("w")
    per = segments.groupBy("week_definition", week, "dimension").agg(
        F.sum("total").alias("total"), F.sum("transferred").alias("transferred"), F.max(F.col("label").isin(K.MISSING, K.NO_SKILL)).alias("has_missing"))
    base = views.select("week_definition", week, F.col("eligible_ticket_count").alias("n"))
    joined = per.join(base, ["week_definition", "w"], "left")
    scope = F.concat_ws("/", "week_definition", F.when(F.col("w") == F.lit("1900-01-01").cast("date"), "all").otherwise(F.col("w").cast("string")), "dimension")
    rows = _explode(joined, [check_row("dimension_closes", scope, F.coalesce("n", F.lit(0)), F.col("total")), check_row("missing_bucket", scope, F.lit(1), F.col("has_missing").cast("int"))])
    labels = segments.groupBy("week_definition", "dimension", "label").agg(
        F.sum(F.when(F.col("cohort_week").isNull(), F.col("total"))).alias("t"), F.coalesce(F.sum(F.when(F.col("cohort_week").isNotNull(), F.col("total"))), F.lit(0)).alias("w"))
    return rows.unionByName(_explode(labels, [check_row("weeks_add_up", F.concat_ws("/", "week_definition", "dimension", "label"), F.col("t"), F.col("w"))]))


def transfer_checks(triggers: DataFrame, flags: DataFrame, guardrails: DataFrame) -> DataFrame:
    """Triggers partition the transferred tickets; overlapping counts stay below them."""
    week = F.coalesce(F.col("cohort_week"), F.lit("1900-01-01").cast("date")).alias("w")
    t = triggers.groupBy("week_definition", week).agg(F.sum("count").alias("n"))
    g = guardrails.groupBy("week_definition", week).agg(F.max("count").alias("top"))
    f = flags.select("week_definition", week, "observed_transfer_denominator", "step_result_missing", "escalation_guard_blocked")
    joined = f.join(t, ["week_definition", "w"], "left").join(g, ["week_definition", "w"], "left")
    scope = F.concat_ws("/", "week_definition", F.when(F.col("w") == F.lit("1900-01-01").cast("date"), "all").otherwise(F.col("w").cast("string")))
    den = F.col("observed_transfer_denominator")
    grain = ["reason", "rule", "source", "stage", "skill"]
    again = triggers.groupBy("week_definition", "cohort_week", *grain).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = lambda c: F.coalesce(F.sum(F.when(F.col("cohort_week").isNull(), F.col(c))), F.lit(0))
    weeks = lambda c: F.coalesce(F.sum(F.when(F.col("cohort_week").isNotNull(), F.col(c))), F.lit(0))
    rolled = triggers.groupBy("week_definition", *grain).agg(whole("count").alias("t"), weeks("count").alias("w"))
    ruled = guardrails.groupBy("week_definition", "rule").agg(whole("count").alias("t"), weeks("count").alias("w"))
    names = F.concat_ws("/", "week_definition", *[F.coalesce(F.col(g), F.lit("-")) for g in grain])
    rest = _explode(rolled, [check_row("trigger_weeks_add_up", names, F.col("t"), F.col("w"))]).unionByName(
        _explode(ruled, [check_row("rule_weeks_add_up", F.concat_ws("/", "week_definition", "rule"), F.col("t"), F.col("w"))])).unionByName(_violations("trigger_grain", again))
    return rest.unionByName(_explode(joined, [
        check_row("triggers_partition", scope, den, F.coalesce("n", F.lit(0))),
        check_row("rules_within_total", scope, F.lit(1), (F.coalesce("top", F.lit(0)) <= den).cast("int")),
        check_row("flags_within_total", scope, F.lit(1), (F.greatest("step_result_missing", "escalation_guard_blocked") <= den).cast("int"))]))


def csat_checks(weekly: DataFrame, feedback: DataFrame, matched: DataFrame) -> DataFrame:
    """Buckets close, outcomes add up to the total; comments are numbered within the answers of their
    ticket, each number once, and only the last answer is marked as the latest."""
    scope = F.concat_ws("/", "week_definition", F.col("cohort_week").cast("string"), "grain", "dimension", "value")
    own = _explode(weekly, [check_row("buckets_close", scope, F.col("ticket_count"), F.col("positive") + F.col("neutral") + F.col("negative"))])
    parts = weekly.groupBy("week_definition", "cohort_week", "grain").agg(
        F.sum(F.when(F.col("dimension") == "all", F.col("ticket_count"))).alias("all"),
        *[F.sum(F.when(F.col("dimension") == d, F.col("ticket_count"))).alias(d) for d in ("outcome", "skill", "issue_category")])
    closed = _explode(parts, [check_row(f"{d}_closes", F.concat_ws("/", "week_definition", F.col("cohort_week").cast("string"), "grain"), F.col("all"), F.col(d)) for d in (
        "outcome", "skill", "issue_category")])
    numbering = rule_checks(feedback, {
        "feedback_in_range": (F.col("response_number") < 1) | (F.col("response_number") > F.col("response_total")),
        "feedback_latest": F.col("is_latest_for_ticket") != (F.col("response_number") == F.col("response_total"))})
    again = feedback.groupBy("ticket_id", "response_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    answers = matched.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n"))
    shown = feedback.groupBy("ticket_id").agg(F.min("response_total").alias("low"), F.max("response_total").alias("high"))
    wrong = shown.join(answers, "ticket_id", "left").where("n is null or low <> n or high <> n")
    return own.unionByName(closed).unionByName(numbering).unionByName(_violations("feedback_numbered_once", again)).unionByName(_violations("feedback_total_recount", wrong))


def coverage_checks(entry: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """Entry statuses close and the human split covers the unobserved ones; reconciliation adds up."""
    scope = F.concat_ws("/", "week_definition", F.col("cohort_week").cast("string"))
    a = _explode(entry, [
        check_row("statuses_close", scope, F.col("ticket_count"), sum((F.col(s) for s in K.ENTRY_STATUSES), F.lit(0))),
        check_row("human_split_closes", scope, F.col("not_observed_invoked"), F.col("not_observed_human_replied") + F.col("not_observed_no_human_reply"))])
    b = _explode(reconciliation, [
        check_row("checked_within_population", scope, F.lit(1), (F.col("checked_ticket_count") + F.col("unresolved_ticket_count") <= F.col("ai_end_to_end")).cast("int")),
        check_row("mismatch_is_division", scope, F.try_divide("human_replied_after_ai", "checked_ticket_count"), F.col("mismatch_rate"))])
    return a.unionByName(b)


def period_checks(period: DataFrame, weekly: DataFrame, sliced: DataFrame) -> DataFrame:
    """Same-period rows stay inside their whole week, their rates are divisions, and the baseline is the
    mean of the same days of up to four earlier complete weeks (`sliced`: every week cut to those days)."""
    whole = weekly.select("week_definition", "cohort_week", F.col("total_tickets").alias("__n"))
    past = sliced.where("cohort_status = 'complete' and total_tickets > 0").withColumn("__nth", F.row_number().over(W.partitionBy("week_definition").orderBy(F.desc("cohort_week")))).where("__nth <= 4")
    means = past.groupBy("week_definition").agg(F.count(F.lit(1)).alias("__weeks"), F.avg("ai_first_rate").alias("__ai"), F.avg("reopen_lifetime_rate").alias("__reopen"))
    joined = period.join(whole, ["week_definition", "cohort_week"], "left").join(means, "week_definition", "left")
    scope = F.concat_ws("/", "week_definition", F.col("cohort_week").cast("string"))
    close = lambda a, b: (F.abs(F.coalesce(F.col(a), F.lit(-1.0)) - F.coalesce(F.col(b), F.lit(-1.0))) < 1e-9).cast("int")
    return _explode(joined, [
        check_row("within_whole_week", scope, F.lit(1), (F.col("total_tickets") <= F.col("__n")).cast("int")),
        check_row("ai_rate_is_division", scope, F.coalesce(F.try_divide("ai_first_count", "total_tickets"), F.lit(0.0)), F.col("ai_first_rate")),
        check_row("reopen_rate_is_division", scope, F.try_divide("reopen_lifetime_numerator", "reopen_lifetime_denominator"), F.col("reopen_lifetime_rate")),
        check_row("baseline_weeks", scope, F.lit(1), F.col("weeks_used").between(2, 4).cast("int")),
        check_row("baseline_weeks_recount", scope, F.col("__weeks"), F.col("weeks_used")),
        check_row("baseline_ai_recount", scope, F.lit(1), close("__ai", "baseline_ai_first_rate")),
        check_row("baseline_reopen_recount", scope, F.lit(1), close("__reopen", "baseline_reopen_lifetime_rate"))])


def reason_checks(coverage: DataFrame) -> DataFrame:
    """Label states stay inside the population; immature weeks have no control rate."""
    scope = F.concat_ws("/", "week_definition", F.col("cohort_week").cast("string"))
    return _explode(coverage, [
        check_row("abstained_within_labeled", scope, F.lit(1), (F.col("abstained") <= F.col("labeled")).cast("int")),
        check_row("no_rate_without_denominator", scope, (F.col("direct_cs_denominator") > 0).cast("int"), F.col("direct_cs_reopen_7d_rate").isNotNull().cast("int"))])


def ticket_checks(tickets: DataFrame) -> DataFrame:
    """Row contract of the public list, and the intent frequency once more."""
    rare = tickets.where(F.col("intent").isNotNull() & (F.col("intent") != K.OTHER_INTENT)).groupBy("intent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < K.INTENT_MIN_COUNT)
    again = tickets.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rule_checks(tickets, ticket_rules()).unionByName(_violations("intent_frequency", rare)).unionByName(_violations("ticket_unique", again))


class CheckFailed(ValueError):
    """Checks that did not hold; what they guard has not been published."""

    def __init__(self, failed: list[str]):
        super().__init__("check failed: " + "; ".join(failed))
        self.failed = failed


def refuse_failed(checks: DataFrame, shown: int = 20) -> None:
    """Raises CheckFailed with the first failed checks, if there are any."""
    failed = checks.where("not ok").select(F.concat_ws(" ", "check", "scope").alias("c")).limit(shown).collect()
    if failed:
        raise CheckFailed([r["c"] for r in failed])
