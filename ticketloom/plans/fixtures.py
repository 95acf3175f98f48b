"""Driver tables viewed as the domain: traces, observations, messages, surveys, vectors."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import wraps
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import timefns as T
from ..operators import classify, enrich, ingest
from ..operators.scale import rank_rows
from ..window import CohortWindow
from .tickets import narrow_traces

AS_OF = datetime(2024, 1, 31, 10, 0, tzinfo=timezone(timedelta(hours=7)))
WINDOW = CohortWindow.build(AS_OF, 4)
# A shorter window, so that some sessions start before it and go on inside it.
SHORT_WINDOW = CohortWindow.build(AS_OF, 2)
TEMPLATE = K.TRANSFER_TEXTS[0]
TEMPLATE_HTML = (
    "<p>Xin lỗi vì sự bất tiện. Yêu cầu của Quý Khách đã được chuyển đến bộ phận Chăm sóc Khách hàng.</p>"
    "<p>Vui lòng chờ trong giây lát,&nbsp;nhân viên sẽ sớm liên hệ hỗ trợ.</p>"
)
CATEGORIES = ("Nạp tiền", "Rút tiền", "Chuyển tiền", "Thanh toán")
ROSTER = {"bot": (1001,), "human": (2001, 2002), "excluded": (3001,)}
CARRY = (
    "issue_category", "app", "app_code", "product_code", "entry_point", "payment_channel",
    "tpe_code", "tpe_status_raw", "model_core",
)
AGENT_CONFIG = {"survey": {"negative": (-103,), "neutral": (100,), "positive": (103,)}}


def plan_once(build):
    """Keeps the lazy DataFrame of a view per session and folder: the plan is shared, no data is."""

    @wraps(build)
    def view(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        plans = spark.__dict__.setdefault("_ticketloom_plans", {})
        key = (build.__module__, build.__name__, sf_dir, *args)
        if key not in plans:
            plans[key] = build(spark, sf_dir, *args)
        return plans[key]

    return view


def stored_once(build):
    """A fact table that many reports read. Where the session names a shared folder in
    spark.checkpoint.dir the table is written there once per application and read back, so raw
    payloads are parsed once and a lost executor costs a re-read; without the setting it stays lazy.
    """

    @plan_once
    @wraps(build)
    def view(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        rows = build(spark, sf_dir, *args)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            return rows
        mark = sha256(repr((sf_dir, args)).encode()).hexdigest()[:16]
        path = f"{root}/ticketloom/{spark.sparkContext.applicationId}/{build.__module__.rsplit('.', 1)[-1]}-{build.__name__}-{mark}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


@plan_once
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their session and their position in it."""
    raw = table(spark, sf_dir, "events")
    ts = T.as_utc_ntz(F.col("ts"), raw.schema["ts"].dataType.typeName())
    sid = (F.col("user_id") + 1) * 100 + F.floor((F.dayofmonth(ts) - 1) / 3)
    rows = raw.select(
        "event_id", ts.alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), sid.cast("bigint").alias("sid"),
    )
    return rank_rows(rows, ["sid"], [F.date_trunc("hour", "ts")], [F.col("ts"), F.col("event_id")], "rn")


def _trace_columns(ev: DataFrame) -> DataFrame:
    k, user = F.col("k"), F.col("user_id")
    moved = F.when((k % 10 == 9) & (F.col("rn") > 1), 1).otherwise(0)
    turn = F.col("rn") - 1 + F.when(F.col("sid") % 7 == 0, 1).otherwise(0) - moved
    arm = F.when(user % 11 != 0, F.when(user % 2 == 0, "model-a").otherwise("model-b"))
    transfer = (F.col("event_type") == "purchase") & (k % 4 == 0)
    answer = F.concat(F.lit("Trả lời "), F.col("event_type"), F.lit(" "), k)
    response = (
        F.when(transfer, F.when(k % 8 == 0, F.lit(TEMPLATE_HTML)).otherwise(F.lit(TEMPLATE)))
        .when(F.col("event_type") == "signup", "Không hỗ trợ nội dung này")
        .when(F.col("event_type") != "error", answer)
    )
    blocked = F.when(F.col("event_type") == "signup", F.lit(True))
    agents = F.when(F.col("event_type") == "signup", F.array(F.lit("guardrail"))).otherwise(F.array(F.lit("customer-service")))
    category = F.when(user % 13 != 0, pick(user % 4, *CATEGORIES))
    entry = F.when(k % 3 < 2, pick(k % 3, "tranxdetail", "resultpage", ""))
    code = F.when(k % 7 != 0, F.concat(pick(k % 4, "-365", "-348", "-383", "999"),
                                       F.when(k % 2 == 0, F.lit(" Thất bại")).otherwise(F.lit(""))))
    meta = F.struct(
        F.struct(category.alias("category"), entry.alias("sub_source")).alias("Thông tin thêm"),
        F.concat((k % 5 + 450).cast("string"), F.lit(" - app")).alias("App"),
        F.concat(F.lit("P"), k % 6).alias("Product Code"),
        code.alias(K.TPE_CODE_KEY),
        F.concat(F.lit("user-"), user).alias("UserID"),
    )
    payload = F.struct(
        F.lit("ticket").alias("source"),
        F.concat(F.lit("Yêu cầu "), k, F.lit(" từ user-"), user, F.lit(" qua a.b@example.com")).alias("user_input"),
        F.struct(F.col("sid").cast("string").alias("freshdesk_id"), F.concat(F.lit("Hỗ trợ "), k).alias("title"),
                 meta.alias("meta")).alias("other_info"),
        F.struct(arm.alias("model_core")).alias("model_info"),
    )
    output = F.struct(
        response.alias("response"), F.when(F.col("event_type") == "error", F.lit(42)).alias("code"),
        blocked.alias("blocked"), agents.alias("agents_used"),
    )
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("sid").cast("string").alias("sessionId"),
        T.utc_iso(F.col("ts")).alias("timestamp"),
        F.lit("default").alias("environment"),
        F.parse_json(F.to_json(F.struct(turn.alias("turn")))).alias("metadata"),
        F.parse_json(F.to_json(payload)).alias("input"),
        F.parse_json(F.to_json(output)).alias("output"),
        F.col("value").alias("latency"),
        F.col("event_id").alias("seq"),
    )


@plan_once
def raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace_columns(events(spark, sf_dir))


@plan_once
def damaged_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw traces with broken fields and repeated copies, so that every reject reason has rows."""
    e = F.col("seq")
    raw = raw_traces(spark, sf_dir)
    raw = raw.select(
        F.when(e % 97 != 2, F.col("id")).alias("id"),
        F.when(e % 97 != 3, F.col("sessionId")).alias("sessionId"),
        F.when(e % 97 != 1, F.col("timestamp")).otherwise(F.substring("timestamp", 1, 19)).alias("timestamp"),
        "environment",
        F.when(e % 97 == 4, F.parse_json(F.lit("{}"))).when(e % 97 == 5, F.parse_json(F.lit('{"turn":true}'))).otherwise(
            F.col("metadata")).alias("metadata"),
        F.when(e % 97 == 6, F.parse_json(F.lit('{"source":"ticket","other_info":{"freshdesk_id":"7"}}')))
        .when(e % 97 == 7, F.parse_json(F.lit('{"source":"chat"}'))).otherwise(F.col("input")).alias("input"),
        "output", "latency", "seq",
    )
    again = raw.where(e % 89 == 0).withColumn("seq", e + 1_000_000_000)
    changed = again.withColumn("environment", F.when(e % 2 == 0, "other").otherwise(F.col("environment")))
    return raw.unionByName(changed)


@stored_once
def traces(spark: SparkSession, sf_dir: str, templates: tuple[str, ...] = K.TRANSFER_TEXTS) -> DataFrame:
    return narrow_traces(raw_traces(spark, sf_dir), templates)


@stored_once
def sessions(spark: SparkSession, sf_dir: str, window: CohortWindow = WINDOW) -> DataFrame:
    return classify.classify_sessions(traces(spark, sf_dir), window, CARRY)


@stored_once
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.observation_signals(observations(spark, sf_dir))


@stored_once
def enriched_sessions(spark: SparkSession, sf_dir: str, window: CohortWindow = WINDOW) -> DataFrame:
    return enrich.enrich_sessions(sessions(spark, sf_dir, window), traces(spark, sf_dir), signals(spark, sf_dir))


@plan_once
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the seven enrichment lanes."""
    ev = table(spark, sf_dir, "events")
    ts = T.as_utc_ntz(F.col("ts"), ev.schema["ts"].dataType.typeName())
    ev = ev.select("event_id", ts.alias("ts"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, kind = F.col("k"), F.col("event_type")
    skill = F.concat(F.lit("customer-service/skill_"), k % 5)
    blank = F.lit("{}")

    def row(name: Column | str, cond: Column, metadata=None, payload=None, output=None) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.when(cond, F.struct(
            name.alias("name"),
            (F.to_json(metadata) if metadata is not None else blank).alias("metadata"),
            (F.to_json(payload) if payload is not None else blank).alias("input"),
            (F.to_json(output) if output is not None else blank).alias("output"),
        ))

    guarded = (kind == "purchase") & (k % 4 == 0) & (k % 20 != 16)
    guard_name = pick(F.floor(k % 12 / 4), K.OBS_SKILL_GUARD, K.OBS_OUTPUT_GUARD, K.OBS_INPUT_GUARD)
    rule = F.when(k % 12 == 8, "missing_transaction_id").otherwise("cs_escalation")
    stage = F.struct(F.when(k % 12 == 0, "output").alias("stage"), F.when(k % 12 == 0, skill).alias("skill"))
    result = F.struct(F.struct(pick(k % 4, -365, -348, -383, 999).alias("transstatus"),
                               F.when(k % 3 < 2, pick(k % 3, "-1006", "210800", "")).alias("stepresult")).alias("result"))
    lanes = F.array(
        row(K.OBS_INTENT, kind == "view", metadata=F.struct(F.concat(F.lit("intent_"), k % 10).alias("intent"))),
        row(K.OBS_SKILL, kind == "click", metadata=F.struct(F.array(skill).alias("skills_used"))),
        row(guard_name, guarded, payload=stage, output=F.struct(rule.alias("rule"), F.lit(True).alias("blocked"))),
        row(K.OBS_TPE, kind == "purchase", output=result),
        row(K.OBS_HISTORY_GUARD, (kind == "signup") & (k % 5 == 0), output=F.struct(F.lit(True).alias("blocked"))),
    )
    rows = ev.select("event_id", "ts", F.explode(F.filter(lanes, lambda x: x.isNotNull())).alias("o"))
    return rows.select(
        F.concat_ws("-", F.lit("o"), "event_id", "o.name").alias("id"),
        F.col("event_id").cast("string").alias("traceId"),
        "o.name",
        T.utc_iso(F.col("ts")).alias("startTime"),
        F.parse_json("o.metadata").alias("metadata"),
        F.parse_json("o.input").alias("input"),
        F.parse_json("o.output").alias("output"),
    )


@plan_once
def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    ts = T.as_utc_ntz(F.col("ts"), ev.schema["ts"].dataType.typeName())
    k = F.get_json_object("props", "$.k").cast("bigint")
    model = F.when(F.col("user_id") % 11 != 0, F.when(F.col("user_id") % 2 == 0, "model-a").otherwise("model-b"))
    return ev.select(
        F.col("event_id").cast("string").alias("call_id"), model.alias("model"), ts.alias("ts"),
        (k * 10).alias("total_tokens"), (k * 7).alias("input_tokens"), (k * 3).alias("output_tokens"),
        (F.col("value") * 1000).alias("latency_ms"),
    )


def _conversation_start(conv: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(hours=conv.cast("int"))


@plan_once
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Help-desk messages with their text; `read_conversations` reduces it to safe fields."""
    role, size = F.col("role"), F.length("text")
    note = (role == "assistant") & (size % 5 == 0)
    reply = (role == "assistant") & (size % 5 != 0)
    author = F.when(role == "assistant", pick(size % 4, 1001, 1001, 2001, 9001))
    body = F.when(note, F.concat(F.lit("AutoRep: "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") + 1).cast("string").alias("ticket_id"),
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("message_id"),
        author.cast("bigint").alias("author_id"),
        (role == "user").alias("incoming"),
        (note | (role == "system")).alias("private"),
        F.lit(2).alias("source"),
        (_conversation_start(F.col("conv_id")) + F.make_dt_interval(mins=(F.col("turn") * 10).cast("int"))).alias("created_ts"),
        F.when(reply, 3).when(role == "user", 1).otherwise(2).alias("category"),
        body.alias("body_text"),
    )


@plan_once
def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survey without an agent id per conversation, 35 minutes after its start."""
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return conv.select(
        F.col("conv_id").alias("survey_key"), (F.col("conv_id") + 1).cast("string").alias("ticket_id"),
        F.lit(None).cast("bigint").alias("agent_id"), F.lit("survey").alias("survey_id"),
        (_conversation_start(F.col("conv_id")) + F.make_dt_interval(mins=F.lit(35))).alias("created_ts"),
        pick(F.col("conv_id") % 3, -103, 100, 103).alias("rating"),
    )


@plan_once
def csat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored survey answers, one per labelled document."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rating = F.when(F.col("toxic") == 1, -103).when(F.col("quality") == 1, 103).otherwise(100)
    responded = F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return joined.select(
        F.col("doc_id").alias("source_id"),
        ((F.col("doc_id") % 150 + 1) * 100 + F.col("doc_id") % 10).cast("string").alias("ticket_id"),
        F.lit("survey").alias("survey_id"), responded.alias("responded_ts"), rating.alias("rating"),
        F.col("text").alias("feedback"),
    )


def inventory(spark: SparkSession, sf_dir: str, ticket_sessions: DataFrame) -> DataFrame:
    """Help-desk tickets: most observed sessions plus one unobserved ticket per conversation."""
    sid = F.col("session_id").cast("bigint")
    seen = ticket_sessions.where(sid % 5 != 0).select(
        "session_id", F.col("turn0_ts").alias("created_ts"), (sid % 10 + 1).cast("string").alias("conversation_id"))
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    unseen = conv.select(
        (F.col("conv_id") + 900000).cast("string").alias("session_id"),
        _conversation_start(F.col("conv_id")).alias("created_ts"), (F.col("conv_id") + 1).cast("string").alias("conversation_id"))
    return seen.unionByName(unseen).withColumnRenamed("session_id", "ticket_id")


@plan_once
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@plan_once
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@plan_once
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of every trace, for the explanation jobs."""
    ev = events(spark, sf_dir)
    k = F.col("k")
    skill = pick(k % 3, "topup", "withdraw", "interbank-fund-transfer")

    def row(order: int, name, present=None, payload=None, output=None, metadata=None) -> Column:
        item = F.struct(
            F.lit(order).alias("ord"), (F.lit(name) if isinstance(name, str) else name).alias("name"),
            (F.to_json(payload) if payload is not None else F.lit("{}")).alias("input"),
            (F.to_json(output) if output is not None else F.lit("{}")).alias("output"),
            (F.to_json(metadata) if metadata is not None else F.lit("{}")).alias("metadata"),
        )
        return item if present is None else F.when(present, item)

    def verdict(cond: Column, rule: Column, fine: str) -> Column:
        return F.struct(cond.alias("blocked"), F.when(cond, rule).otherwise(F.lit(fine)).alias("rule"))

    skill_rule = F.when(k % 24 == 0, "cs_escalation").otherwise("tone_check_error")
    out_rule = F.when(k % 36 == 4, "cs_escalation").when(k % 36 == 16, "tone_check_error").otherwise("profanity")
    bank = F.struct(F.when(k % 10 == 7, "lookup_failed").alias("error"),
                    F.when(k % 10 == 7, "Vui lòng báo cskh xử lý").alias("message"),
                    F.when(k % 10 != 7, F.concat(F.lit("Bank"), k % 5)).alias("short_name"))
    content = F.concat(F.lit("body "), k % 4)
    items = F.array(
        row(0, "pipeline"),
        row(1, "idempotency_guard", output=F.struct((k % 29 == 0).alias("blocked"))),
        row(2, "escalation_history_guard", output=F.struct((k % 31 == 0).alias("blocked"))),
        row(3, "input_guardrail", output=verdict(k % 12 == 8, F.lit("missing_transaction_id"), "input_compliant")),
        row(4, "route", output=F.struct(F.array(F.lit("topup")).alias("agents"))),
        row(5, "skills_loaded", k % 3 == 0, output=F.struct(F.array(skill).alias("skills"))),
        row(6, F.concat(F.lit("tool:load_skill_reference__"), skill), k % 6 != 5,
            payload=F.struct(F.struct(F.concat(F.lit("sub-skill-"), pick(k % 2, "A", "B"), F.lit(".md")).alias("filename")).alias("input")),
            output=F.struct(F.struct(content.alias("content")).alias("result"))),
        row(7, "tool:get_bank_name", output=F.struct(bank.alias("result"))),
        row(8, "llm_call:iter_1", output=F.struct(F.concat(F.lit("draft "), k).alias("text"), F.lit(7).alias("total_tokens"))),
        row(9, "skill_guardrail_checked", payload=F.struct(F.lit("input").alias("stage")),
            output=verdict(k % 12 == 5, F.lit("off_topic"), "input_compliant")),
        row(10, "skill_guardrail_checked", payload=F.struct(F.lit("output").alias("stage")),
            output=verdict(k % 12 == 0, skill_rule, "output_compliant"),
            metadata=F.struct(F.when(k % 24 == 0, F.concat(F.lit("reason "), k)).alias("reason"))),
        row(11, "output_guardrail", output=verdict(k % 12 == 4, out_rule, "output_compliant")),
        row(12, "general_response", k % 17 == 3),
    )
    rows = ev.select("event_id", "sid", "rn", "ts", "k", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("o"))
    return rows.select(
        F.concat_ws("-", F.lit("s"), "event_id", F.lpad(F.col("o.ord").cast("string"), 2, "0")).alias("id"),
        F.col("event_id").cast("string").alias("traceId"), F.col("sid").cast("string").alias("session_id"),
        F.col("rn").cast("int").alias("turn"), "o.name",
        T.utc_iso(F.col("ts") + F.make_dt_interval(secs=F.col("o.ord").cast("decimal(18,6)"))).alias("startTime"),
        F.parse_json("o.input").alias("input"), F.parse_json("o.output").alias("output"),
        F.parse_json("o.metadata").alias("metadata"),
    )
