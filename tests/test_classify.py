import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.operators import classify, enrich, ingest, weekly
from ticketloom.plans.tickets import narrow_traces
from ticketloom.window import CohortWindow

AS_OF = datetime(2024, 1, 31, 10, tzinfo=timezone(timedelta(hours=7)))
WINDOW = CohortWindow.build(AS_OF, 4)
RAW = "id string, sessionId string, timestamp string, environment string, metadata string, input string, output string"
SCHEMA = "session_id string, trace_id string, ts timestamp_ntz, turn int, environment string, is_transfer boolean, is_guardrail boolean, is_malformed boolean, is_ai boolean"


def raw_frame(spark, rows):
    df = spark.createDataFrame(rows, RAW)
    return df.withColumns({c: F.parse_json(c) for c in ("metadata", "input", "output")})


def reason_of(spark, **change):
    base = {"id": "t", "sessionId": "7", "timestamp": "2024-01-02T00:00:00Z", "environment": "", "metadata": '{"turn": 0}', "input": '{"source": "ticket"}', "output": "{}"}
    row = {**base, **change}
    return ingest.normalize_traces(raw_frame(spark, [tuple(row.values())])).first()["reason"]


@pytest.mark.parametrize("change,want", [
    ({}, None), ({"timestamp": "2024-01-02T00:00:00"}, "invalid_timestamp"), ({"timestamp": "2024-01-02T07:00:00+07:00"}, None), ({"timestamp": "x"}, "invalid_timestamp"),
    ({"id": ""}, "missing_trace_id"), ({"id": None}, "missing_trace_id"), ({"sessionId": None}, "missing_session_id"), ({"metadata": "{}"}, "missing_turn"),
    ({"metadata": '{"turn": null}'}, "missing_turn"), ({"metadata": '{"turn": true}'}, "invalid_turn"), ({"metadata": '{"turn": "1"}'}, "invalid_turn"),
    ({"metadata": '{"turn": -1}'}, "invalid_turn"), ({"metadata": '{"turn": 1.5}'}, "invalid_turn"),
    ({"input": '{"other_info": {"freshdesk_id": "8"}}'}, "session_freshdesk_mismatch"), ({"input": '{"other_info": {"freshdesk_id": 8}}'}, None),
    ({"id": None, "timestamp": "x"}, "invalid_timestamp")])
def test_reject_reasons(spark, change, want):
    assert reason_of(spark, **change) == want


@pytest.mark.parametrize("output,flags", [
    ('{"response": "Xin chào"}', (False, False, False, True)), ('{"response": "Xin chào", "blocked": true}', (False, True, False, False)),
    ('{"response": "Xin chào", "blocked": "true"}', (False, False, False, True)), ('{"response": "Xin chào", "passed": false}', (False, True, False, False)),
    ('{"response": "Xin chào", "violation": "x"}', (False, True, False, False)), ('{"response": "Xin chào", "violation": ""}', (False, False, False, True)),
    ('{"response": "Xin chào", "violation": 0}', (False, False, False, True)), ('{"response": "x", "agents_used": ["guardrail"]}', (False, True, False, False)),
    ('{"response": "x", "agents_used": "GUARDRAIL"}', (False, True, False, False)), ('{"response": "x", "agents_used": ["guardrail", 1]}', (False, False, False, True)),
    ('{"response": "x", "agents_used": []}', (False, False, False, True)), ('{"response": "x", "agents_used": ["guardrail", "a"]}', (False, False, False, True)),
    ('{"response": "escalate_cs_message"}', (False, True, False, False)), ('{"response": "no_data"}', (False, False, False, False)),
    ('{"response": "  "}', (False, False, False, False)), ('{"response": 4}', (False, False, True, False)), ('"text"', (False, False, True, False)), ("{}", (False, False, True, False))])
def test_output_flags(spark, output, flags):
    row = classify.output_flags(raw_frame(spark, [("t", "7", "", "", "{}", "{}", output)])).first()
    assert (row["is_transfer"], row["is_guardrail"], row["is_malformed"], row["is_ai"]) == flags


def expected_ticket(rows):
    """Plain reading of the rules for one ticket, as an ordered walk."""
    rows = sorted(rows, key=lambda r: (r["turn"], r["ts"], r["trace_id"]))
    first = next((i for i, r in enumerate(rows) if r["is_ai"] or r["is_transfer"]), None)
    ai_first = first is not None and rows[first]["is_ai"]
    later = rows[first + 1:] if first is not None else []
    count, waiting = 0, True
    for r in later:
        if waiting:
            count, waiting = count + 1, False
        waiting = waiting or r["is_ai"]
    again = int(any(timedelta() < r["ts"] - rows[0]["ts"] <= timedelta(hours=168) for r in later))
    transfer = next((r["trace_id"] for r in rows if r["is_transfer"]), None)
    outcome = "unclassified" if first is None else "direct_cs" if not ai_first else "ai_then_cs" if transfer else "ai_end_to_end"
    turns = [r["turn"] for r in rows]
    if len(set(turns)) < len(turns):
        quality = "duplicate_turn"
    elif 0 not in turns:
        quality = "no_turn_zero"
    elif any(r["is_malformed"] for r in rows):
        quality = "malformed_output"
    elif first is None and not rows[0]["is_guardrail"]:
        quality = "empty_or_technical"
    else:
        quality = "valid"
    return (ai_first, outcome, count if ai_first else None, again if ai_first else None, sum(r["is_ai"] for r in rows), transfer, quality, len(rows),
            again if outcome == "direct_cs" else None)


def random_rows(seed, tickets):
    rnd, rows = random.Random(seed), []
    for s in range(tickets):
        for i in range(rnd.randint(1, 7)):
            kind = rnd.choice(["ai", "ai", "transfer", "guard", "bad", "none"])
            ts = datetime(2024, 1, 3) + timedelta(hours=rnd.choice([0, 1, 5, 100, 168, 169, 200]), seconds=rnd.choice([0, 0, 1]))
            rows.append({"session_id": str(100 + s), "trace_id": f"t{s}-{i}", "ts": ts, "turn": rnd.choice([0, 1, 1, 2, 3, 4]), "environment": "e", "is_transfer": kind == "transfer",
                         "is_guardrail": kind == "guard", "is_malformed": kind == "bad", "is_ai": kind == "ai"})
    rnd.shuffle(rows)
    return rows


def test_tickets_against_ordered_walk_and_any_input_order(spark):
    rows = random_rows(3, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("ai_first", "outcome", "reopen_lifetime", "reopen_within_7d", "ai_reply_count", "first_transfer_trace_id", "data_quality", "turn_count", "control_reopen_within_7d")
    got = {r["session_id"]: tuple(r[n] for n in names) for r in classify.classify_sessions(df, WINDOW).collect()}
    by_ticket = {}
    for r in rows:
        by_ticket.setdefault(r["session_id"], []).append(r)
    assert got == {s: expected_ticket(v) for s, v in by_ticket.items()}
    again = {r["session_id"]: tuple(r[n] for n in names) for r in classify.classify_sessions(df.repartition(7, "trace_id"), WINDOW).collect()}
    assert again == got


def test_hot_ticket(spark):
    """A third of all rows in one ticket, twelve rows per turn number."""
    rows = random_rows(5, 300)
    rows += [{**rows[0], "session_id": "999", "trace_id": f"h{i}", "ts": datetime(2024, 1, 3) + timedelta(minutes=i), "turn": i // 12, "is_ai": i % 3 == 0, "is_transfer": False,
              "is_guardrail": False, "is_malformed": False} for i in range(600)]
    got = classify.classify_sessions(spark.createDataFrame(rows, SCHEMA), WINDOW).where("session_id = '999'").first()
    want = expected_ticket([r for r in rows if r["session_id"] == "999"])
    assert (got["ai_first"], got["outcome"], got["reopen_lifetime"], got["reopen_within_7d"], got["data_quality"], got["turn_count"]) == (want[0], want[1], want[2], want[3], want[6], want[7])


@pytest.mark.parametrize("seconds,want", [(168 * 3600, 1), (168 * 3600 + 1, 0), (0, 0), (1, 1)])
def test_reopen_boundary(spark, seconds, want):
    base = {"session_id": "1", "environment": "", "is_transfer": False, "is_guardrail": False, "is_malformed": False}
    rows = [{**base, "trace_id": "a", "ts": datetime(2024, 1, 3), "turn": 0, "is_ai": True},
            {**base, "trace_id": "b", "ts": datetime(2024, 1, 3) + timedelta(seconds=seconds), "turn": 1, "is_ai": False}]
    assert classify.classify_sessions(spark.createDataFrame(rows, SCHEMA), WINDOW).first()["reopen_within_7d"] == want


@pytest.mark.parametrize("invalid,allowed", [(1, True), (2, False)])
def test_structural_gate_is_exclusive_at_five_percent(spark, invalid, allowed):
    rows = [(str(i), "eligible") for i in range(19)] + [(f"x{i}", "invalid_keyed") for i in range(invalid)]
    row = weekly.structural_gate(spark.createDataFrame(rows, "session_id string, selection_group string")).first()
    assert row["core_allowed"] is allowed and row["structural_invalid_rate"] == pytest.approx(invalid / (19 + invalid))


def test_maturity_per_definition():
    from datetime import date

    week = date(2024, 1, 15)
    edge = datetime(2024, 1, 27, tzinfo=timezone(timedelta(hours=7)))
    assert CohortWindow.build(edge, 4).is_mature(week, "mon_fri") and not CohortWindow.build(edge, 4).is_mature(week, "mon_sun")
    assert not CohortWindow.build(edge - timedelta(microseconds=2), 4).is_mature(week, "mon_fri")
    with pytest.raises(ValueError):
        CohortWindow.build(datetime(2024, 1, 1), 4)


def observation(spark, rows):
    df = spark.createDataFrame(rows, "id string, traceId string, name string, startTime string, metadata string, input string, output string")
    return df.withColumns({c: F.parse_json(c) for c in ("metadata", "input", "output")})


def test_enrichment_rules(spark):
    rows = [
        ("1", "t", K.OBS_INTENT, "1", '{"intent": "refund"}', "{}", "{}"), ("2", "t", K.OBS_INTENT, "2", '{"intent": 5}', "{}", "{}"),
        ("3", "t", K.OBS_SKILL, "3", '{"skills_used": "customer-service/topup"}', "{}", "{}"), ("4", "t", K.OBS_SKILL, "4", '{"skills_used": ["withdraw", "bad skill", 7]}', "{}", "{}"),
        ("5", "t", K.OBS_OUTPUT_GUARD, "1", "{}", "{}", '{"rule": "cs_escalation", "passed": false}'),
        ("6", "t", K.OBS_SKILL_GUARD, "9", "{}", '{"stage": "output", "skill": "topup"}', '{"rule": "cs_escalation", "blocked": true}'),
        ("7", "t", K.OBS_SKILL_GUARD, "8", "{}", '{"stage": "output", "skill": "topup"}', '{"rule": "cs_escalation", "blocked": true}'),
        ("8", "t", K.OBS_INPUT_GUARD, "9", "{}", "{}", '{"rule": "off_topic", "blocked": "true"}'), ("9", "t", K.OBS_INPUT_GUARD, "9", "{}", "{}", '{"rule": "input_compliant", "blocked": true}'),
        ("10", "t", K.OBS_TPE, "1", "{}", "{}", '{"result": {"transstatus": -365, "stepresult": "-1006"}}'), ("11", "t", K.OBS_TPE, "1", "{}", "{}", '{"result": {"transstatus": true}}'),
        ("12", "t", K.OBS_TPE, "1", "{}", "{}", '{"result": {"transstatus": "1", "stepresult": 1.5}}'), ("13", "u", K.OBS_HISTORY_GUARD, "1", "{}", "{}", '{"blocked": "yes"}')]
    got = enrich.build_trace_enrichment(enrich.observation_signals(observation(spark, rows))).collect()
    assert len(got) == 1
    row = got[0]
    assert row["intents"] == ["refund"] and row["skills"] == ["topup", "withdraw"] and row["guardrail_rules"] == ["cs_escalation", "off_topic"]
    assert [(e["rule"], e["source"], e["stage"]) for e in row["guardrail_events"]] == [("cs_escalation", K.OBS_SKILL_GUARD, "output"), ("cs_escalation", K.OBS_OUTPUT_GUARD, None)]
    assert [(p["transstatus"], p["step_result"]) for p in row["tpe_signals"]] == [("-365", "-1006"), ("1", None)]
    assert row["escalation_guard_blocked"] is False


def test_meta_code(spark):
    df = spark.createDataFrame([("-365 Thất bại",), ("999",), ("0901234567 x",), ("12 0901234567",), ("abc",), (None,), ("1234567 x",)], "t string")
    code, status = enrich.parse_meta_code(F.col("t"))
    assert [tuple(r) for r in df.select(code.alias("c"), status.alias("s")).collect()] == [("-365", "Thất bại"), ("999", None)] + [(None, None)] * 5


def test_tpe_status(spark):
    pairs = spark.createDataFrame([("-365", "-1000"), ("-365", None), ("-383", "5"), ("-383", None), ("7", "7")], "transstatus string, step_result string")
    got = {(r[0], r[1]): r["status"] for r in enrich.resolve_tpe_status(pairs, enrich.tpe_mapping(spark)).collect()}
    assert got == {("-365", "-1000"): "SYSTEM_ERROR", ("-365", None): None, ("-383", "5"): "PENDING", ("-383", None): "PENDING", ("7", "7"): None}


def test_dedupe_rules(spark):
    rows = [("a", "1", "e1", 1), ("a", "1", "e1", 2), ("b", "1", "e1", 3), ("b", "1", "e2", 4), (None, "2", "x", 5), (None, "2", "x", 6)]
    raw = spark.createDataFrame(rows, "id string, sessionId string, environment string, seq long")
    assert sorted(r["seq"] for r in ingest.dedupe_traces(raw, "seq").collect()) == [1, 3, 5, 6]
    kept, collisions = ingest.dedupe_traces_strict(raw, ingest.payload_hash("id", "sessionId", "environment"), "seq")
    assert sorted(r["seq"] for r in kept.collect()) == [1, 5, 6] and collisions.first()[0] == 1


def test_narrow_traces_drops_payloads(spark):
    raw = raw_frame(spark, [("t", "7", "2024-01-02T00:00:00Z", "e", '{"turn": 0}', '{"source": "ticket", "model_info": {"model_core": "m"}}', '{"response": "x"}')])
    row = narrow_traces(raw).first()
    assert row["arm"] == "m" and "input" not in row and "output" not in row and row["app"] == K.MISSING
