import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import csat, explain, helpdesk, reopen
from ticketloom.operators.scale import latest_before, nearest_rank, number_rows, rank_rows


def test_rank_rows_against_sort(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaab"), datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 5000)), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, id int")
    got = {r["id"]: r["n"] for r in rank_rows(df, ["g"], [F.date_trunc("hour", "ts")], [F.col("ts"), F.col("id")], "n").collect()}
    want = {}
    for g in "ab":
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want


def test_latest_before_against_brute_force(spark):
    rnd = random.Random(2)
    when = lambda: datetime(2024, 1, 1) + timedelta(hours=rnd.randint(0, 120))
    left = [(i, rnd.choice("aab"), when()) for i in range(150)]
    right = [(i, rnd.choice("aac"), when(), f"v{i}") for i in range(200)]
    got = latest_before(spark.createDataFrame(left, "lid int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "rid int, k string, rts timestamp_ntz, v string"),
                        "k", "ts", "rts", ["v"], "rid", "hit")
    got = {r["lid"]: r["hit"]["v"] if r["hit"] else None for r in got.collect()}
    want = {}
    for lid, k, ts in left:
        hits = [(r[2], r[0], r[3]) for r in right if r[1] == k and r[2] < ts]
        want[lid] = max(hits)[2] if hits else None
    assert got == want


@pytest.fixture
def many_partitions(spark):
    """Small inputs over many range partitions, so that keys and days cross their borders."""
    names = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield 12
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("keys", ["a", "aaaaab", "abcdefgh" * 4])
def test_number_rows_against_sort_over_many_partitions(spark, many_partitions, keys):
    """One hot day of one key, several keys, keys within one partition; null keys are a key of their own."""
    rnd = random.Random(5)
    rows = [(rnd.choice([*keys, None]) if len(keys) > 1 else "a", datetime(2024, 1, 1) + timedelta(seconds=rnd.randint(0, 600)), i, f"x{i}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, id int, extra string")
    got = number_rows(df, ["g"], ["ts", "id"], "n")
    assert got.columns == ["g", "ts", "id", "extra", "n"]
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    assert {r["id"]: r["n"] for r in got.collect()} == want
    assert number_rows(df.where("false"), ["g"], ["ts", "id"], "n").count() == 0


def test_one_hot_day_is_in_many_partitions(spark, many_partitions, monkeypatch):
    """What the tasks of the scan write: no partition has much more than its share of a single (ticket, day)."""
    seen = []
    from ticketloom.operators import scale

    real = scale.written
    monkeypatch.setattr(scale, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    day = [("hot", datetime(2024, 1, 1) + timedelta(milliseconds=7 * i), i) for i in range(6_000)]
    rows = spark.createDataFrame(day, "k string, ts timestamp_ntz, id int")
    assert number_rows(rows, ["k"], ["ts", "id"], "n").agg(F.max("n")).first()[0] == 6_000
    found = latest_before(rows, rows.select("k", F.col("ts").alias("rts"), F.col("id").alias("rid")), "k", "ts", "rts", [], "rid", "hit")
    assert found.where("hit.tie = id - 1").count() == 5_999
    for table in seen:
        sizes = [r["count"] for r in table.where("__close is null").groupBy("__part").count().collect()]
        assert len(sizes) >= 10 and max(sizes) < 6_000 / 4


@pytest.mark.parametrize("keys", ["a", "aab"])
def test_latest_before_over_many_partitions(spark, many_partitions, keys):
    rnd = random.Random(6)
    when = lambda: datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 300))
    left = [(i, rnd.choice(keys), when()) for i in range(1_500)] + [(9_000, None, when()), (9_001, "z", when())]
    for right in ([(i, rnd.choice(keys), when(), f"v{i}") for i in range(40)], [(i, "a", when(), f"v{i}") for i in range(1_500)], [(0, "a", datetime(2023, 1, 1), "v0")]):
        got = latest_before(spark.createDataFrame(left, "lid int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "rid int, k string, rts timestamp_ntz, v string"),
                            "k", "ts", "rts", ["v"], "rid", "hit")
        got = {r["lid"]: r["hit"]["v"] if r["hit"] else None for r in got.collect()}
        want = {}
        for lid, k, ts in left:
            hits = [(r[2], r[0], r[3]) for r in right if r[1] == k and r[2] < ts]
            want[lid] = max(hits)[2] if hits else None
        assert got == want


def test_feedback_entries_number_repeated_answers_once_each(spark):
    at = datetime(2024, 1, 1)
    rows = [("t", at.date(), at + timedelta(hours=h), key, "positive", text, "ai", [], "Nạp tiền") for h, key, text in ((1, "a", "x"), (1, "a", "x"), (2, "b", None), (2, "c", "y"))]
    df = spark.createDataFrame(rows, "ticket_id string, cohort_week date, responded_ts timestamp_ntz, response_key string, satisfaction_bucket string, comment_redacted string, outcome string, skill_set array<string>, issue_category string")
    got = sorted((r["response_number"], r["response_total"], r["text"], r["is_latest_for_ticket"]) for r in csat.feedback_entries(df).collect())
    assert got == [(1, 4, "x", False), (2, 4, "x", False), (4, 4, "y", True)]
    assert csat.refuse_repeats(df.where("comment_redacted = 'y'")).count() == 1
    with pytest.raises(Exception, match="identity is duplicated"):
        csat.refuse_repeats(df).collect()


def _plan_after_run(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_values_of_a_hot_ticket(spark):
    """Only values that occur are collected, and a ticket with most of the values is split over tasks."""
    rnd = random.Random(7)
    triples = [("hot", "user-7 gọi user-77 và app-1", "trả lời user-7", "user-123 nữa")] + [(f"t{i}", f"user-{i} x", "y", "z") for i in range(50)]
    values = [("hot", f"user-{i}") for i in range(4_000)] + [(f"t{i}", v) for i in range(50) for v in (f"user-{i}", f"user-{i}", "zz", "")] + [("gone", "user-1")]
    rnd.shuffle(values)
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        found = reopen.occurring_values(spark.createDataFrame(values, "session_id string, value string").repartition(4), spark.createDataFrame(triples, "session_id string, u0 string, a0 string, u1 string"))
        per_ticket = found.groupBy("session_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
        plan = _plan_after_run(per_ticket)
        got = {r["session_id"]: r["v"] for r in per_ticket.collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    want = {k: sorted({v for s, v in values if s == k and v and any(v in t for t in texts)}) for k, *texts in triples}
    assert got == {k: v for k, v in want.items() if v}
    assert "skew=true" in plan


def test_reopen_population_masks_values_of_all_traces(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    sessions = spark.createDataFrame([("s", True, 1, "ai_end_to_end", "valid", "t0", at(0), at(0).date(), "Nạp tiền"), ("q", True, 1, "ai_end_to_end", "valid", "q0", at(0), at(0).date(), None)],
                                     "session_id string, ai_first boolean, reopen_within_7d int, outcome string, data_quality string, turn0_trace_id string, turn0_ts timestamp_ntz, cohort_week date, issue_category string")
    traces = spark.createDataFrame([("s", 0, at(0), "t0"), ("s", 1, at(200), "t1"), ("s", 2, at(5), "t2"), ("s", 3, at(6), "t3"), ("q", 0, at(0), "q0"), ("q", 1, at(1), "q1")], "session_id string, turn int, ts timestamp_ntz, trace_id string")
    texts = spark.createDataFrame([("t0", "s", "tôi là an-1 và an", "chào an-1 12", ["an"]), ("t1", "s", "khác", "x", ["an-1", "12"]), ("t2", "s", "lại an-1", None, []), ("t3", "s", "không dùng", "x", ["chào"]),
                                   ("q0", "q", "hỏi", None, ["hỏi"]), ("q1", "q", "nữa", "x", [])], "trace_id string, session_id string, user_text string, ai_text string, known_values array<string>")
    got = {r["session_id"]: r for r in reopen.reopen_population(sessions, traces, texts).collect()}
    r = got["s"]
    assert (r["followup_trace_id"], r["initial_user_text"], r["initial_ai_text"], r["followup_user_text"], r["complete"]) == ("t2", "tôi là [PII] và [PII]", "[PII] [PII] [PII]", "lại [PII]", True)
    assert got["q"]["complete"] is False and got["q"]["initial_user_text"] is None


def test_nearest_rank_against_sort(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice([0.0, 1.5, rnd.expovariate(1 / 50)])) for _ in range(500)] + [("c", 7.0), ("a", None)]
    got = nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    for r in got:
        values = sorted(v for k, v in rows if k == r["k"] and v is not None)
        assert (r["p50"], r["p95"]) == tuple(values[max(1, math.ceil(p * len(values))) - 1] for p in (0.5, 0.95))
    assert len(got) == 3


def test_kmeans_and_silhouette_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(40, 6)) + c for c in (3 * np.eye(6)[:4])]) [rnd.permutation(160)]
    x[5] = 0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, vector array<double>")
    unit = reopen.normalize_vectors(df)
    assigned = reopen.kmeans_cosine(unit, 5)
    got = {r["id"]: r["cluster_id"] for r in assigned.select("id", "cluster_id").collect()}
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(n > 0, x / np.where(n > 0, n, 1), 0)
    centers, labels = u[:5].copy(), None
    for _ in range(50):
        new = (1 - u @ centers.T).argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for c in range(5):
            if (labels == c).any():
                m = u[labels == c].mean(axis=0)
                centers[c] = m / np.linalg.norm(m) if np.linalg.norm(m) else 0
    assert [got[i] for i in range(160)] == list(labels)
    dist = 1 - u @ u.T
    want = []
    for i in range(160):
        own = [j for j in range(160) if labels[j] == labels[i] and j != i]
        if not own:
            want.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, labels == c].mean() for c in set(labels) if c != labels[i])
        want.append((b - a) / max(a, b) if max(a, b) else 0.0)
    scores = {r["id"]: r["silhouette"] for r in reopen.silhouette_rows(assigned).collect()}
    assert np.allclose([scores[i] for i in range(160)], want, atol=1e-9)


def test_select_k_on_tiny_input_is_one_cluster(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id int, vector array<double>")
    assert {(r["cluster_id"], r["k"]) for r in reopen.select_k(df).collect()} == {(0, 1)}


MESSAGE = "ticket_id string, message_id long, author_id long, incoming boolean, private boolean, source int, created_ts timestamp_ntz, category int, is_autorep_note boolean"
ROSTER = {"bot": (1,), "human": (2,), "excluded": (3,)}


def reply(ticket, mid, author, minute, private=False, note=False, category=3):
    return (ticket, mid, author, False, private, 2, datetime(2024, 1, 1) + timedelta(minutes=minute), category, note)


def test_human_reply_states(spark):
    rows = [reply("a", 1, 1, 0), reply("a", 2, 2, 5), reply("b", 3, 2, 0), reply("b", 4, 1, 5), reply("c", 5, 1, 0), reply("c", 6, 9, 5), reply("d", 7, 2, 0), reply("e", 8, 1, 0), reply("e", 9, 3, 5),
            reply("f", 10, 1, 0), reply("f", 11, 2, 0), reply("g", 12, 1, 1, category=1)]
    got = {r["ticket_id"]: r["human_replied_after_ai"] for r in helpdesk.human_reply_after_bot(spark.createDataFrame(rows, MESSAGE), ROSTER).collect()}
    assert got == {"a": True, "b": False, "c": None, "d": None, "e": False, "f": True}


def test_survey_attribution_rules(spark):
    messages = [reply("a", 1, 1, 0), reply("b", 2, 1, 0), reply("b", 3, 2, 5), reply("c", 4, 1, 0), reply("c", 5, None, 5, True, True), reply("d", 6, 1, 20), reply("e", 7, 1, 0),
                reply("e", 8, None, 30, True, True), reply("g", 9, 1, 0), reply("g", 10, None, 5, True, True)]
    at = datetime(2024, 1, 1, 0, 20)
    surveys = [(k, None if k not in "fg" else (1 if k == "g" else 8), at) for k in "abcdefg"]
    got = csat.survey_attribution(spark.createDataFrame(surveys, "ticket_id string, agent_id long, created_ts timestamp_ntz"), spark.createDataFrame(messages, MESSAGE), (1,))
    assert {r["ticket_id"]: r["attribution"] for r in got.collect()} == {
        "a": "included", "b": "null_agent", "c": "null_agent", "d": "null_agent", "e": "included", "f": "other_agent", "g": "other_agent"}


def test_extract_sections(spark):
    text = "intro\n### A0 - early\nx\n## Kịch bản & Hướng dẫn\n### C1 - Hoàn tiền\n\n- dòng 1\n- dòng 2\n\n### Không mã\nbody\n## Khác\nskip\n#### nope\n"
    main = "# T\n## Một\nthân\n### con\n## Hai  \nxa"
    df = spark.createDataFrame([("withdraw/references/sub-skill-C.md", text), ("withdraw/SKILL.md", main)], "path string, text string")
    got = {r["anchor"]: (r["case_id"], r["case_title"], r["body"], r["source"]) for r in explain.extract_sections(df).collect()}
    assert got == {
        "withdraw/references/sub-skill-C.md#L5": ("C1", "Hoàn tiền", "- dòng 1\n- dòng 2", "sub_skill"),
        "withdraw/references/sub-skill-C.md#L10": (None, "Không mã", "body", "sub_skill"),
        "withdraw/SKILL.md#L2": (None, "Một", "thân", "skill_md"), "withdraw/SKILL.md#L5": (None, "Hai", "xa", "skill_md")}


def test_rules_of_a_pattern_are_worked_out_once_and_mapped_back(spark):
    reads = spark.createDataFrame([("a", "topup", "f1.md", 1), ("b", "topup", "f1.md", 1), ("c", "withdraw", "f1.md", 1), ("c", "topup", "f2.md", 2)], "trace_id string, skill string, filename string, read_order int")
    tool = "array<struct<tool:string,n:bigint>>"
    feats = spark.createDataFrame([("a", ["topup"], [("t", 1)]), ("b", ["topup"], [("t", 1)]), ("c", ["withdraw", "topup"], []), ("d", [], [])], f"trace_id string, skills_used array<string>, tools_called {tool}")
    classes = spark.createDataFrame([("d", "E7", "tool:x", "báo cskh"), ("a", "E1", None, None)], "trace_id string, escalation_class string, deciding_key string, guardrail_reason string")
    rules = spark.createDataFrame([(s, f, f"{s}/{f}#L{n}", n, "t", "sub_skill", "body T") for s in ("topup", "withdraw") for f in ("f1", "f2") for n in (1, 2, 3)] + [("topup", "SKILL", "topup/SKILL#L1", 1, "t", "skill_md", "x")],
                                  "skill string, file_label string, anchor string, line int, case_title string, source string, body string")
    patterns = explain.rule_patterns(reads, feats, classes)
    assert explain.distinct_patterns(patterns).count() == 3
    got = {}
    for r in explain.rule_candidates(reads, feats, rules, classes, cap=4).collect():
        got.setdefault(r["trace_id"], []).append((r["candidate_order"], r["anchor"], r["dropped"]))
    assert sorted(got["a"]) == sorted(got["b"]) == [(1, "topup/f1#L1", 0), (2, "topup/f1#L2", 0), (3, "topup/f1#L3", 0), (4, "topup/SKILL#L1", 0)]
    assert sorted(got["c"]) == [(1, "withdraw/f1#L1", 3), (2, "withdraw/f1#L2", 3), (3, "withdraw/f1#L3", 3), (4, "topup/f2#L1", 3)]
    assert got["d"] == [(1, "tool:x", 0)]
    ranked = {(r["trace_id"], r["rank"]): (r["anchor"], r["score"], r["beyond"]) for r in explain.ranked_rules(reads, feats, rules, classes, limit=2).collect()}
    assert ranked["a", 1] == ranked["b", 1] == ("topup/f1#L1", 130, 2) and ranked["d", 1] == ("tool:x", 10, 0) and ranked["c", 1] == ("withdraw/f1#L1", 100, 5)


def test_privacy_scan_walks_everything(spark):
    from ticketloom.operators import quality

    rows = spark.createDataFrame([(1, "ok", [{"a": "gọi 0901 234-567"}], {"0901234567": "v"}, '{"x": [{"UserID": 5, "y": "٠٩٠١٢٣٤٥٦٧"}]}'), (2, None, [], {}, "null"),
                                  (3, "0901​234567", [{"a": None}], {"k": "6ba7b811-9dad-11d1-80b4-00c04fd430c8"}, '{"z": 901234567}'), (4, "𝟎𝟗𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕 full width", [], None, '[["０９０１２３４５６７"]]')],
                                 "id int, t string, l array<map<string,string>>, m map<string,string>, j string").select("id", "t", "l", "m", F.parse_json("j").alias("j"))
    got = {(r["id"], r["path"], r["problem"]) for r in quality.pii_scan(rows, "id").collect()}
    assert got == {(1, "l[].a", "identifying_value"), (1, "m.0901234567", "identifying_key"), (1, "j.x[].UserID", "denied_key"), (1, "j.x[].y", "identifying_value"), (3, "t", "identifying_value"),
                   (3, "m.k", "identifying_value"), (4, "t", "identifying_value"), (4, "j[][]", "identifying_value")}


def test_ground_check(spark):
    rows = [("Hoàn 1.500 đ", "có 1500", "cao"), ("Hoàn 1.500 đ", "có 150", "cao"), ("mã 123456", "123456", "cao"), ("theo rule", "", "cao"), ("theo ruler", "", "thap"), (" ", "", "cao"), ("ok", "", "x")]
    df = spark.createDataFrame(rows, "conclusion string, evidence string, confidence string")
    assert [r["grounded"] for r in explain.ground_check(df).collect()] == [True, False, False, False, True, False, False]


def test_round_robin_fails_when_strata_exceed_the_cap(spark):
    import pytest

    df = spark.createDataFrame([(i, i % 4) for i in range(20)], "id int, s int")
    assert [r["id"] for r in reopen.round_robin_sample(df, ["s"], "id", 6).collect()] == [0, 1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="more strata"):
        reopen.round_robin_sample(df, ["s"], "id", 3).collect()


def test_rank_candidates_scores(spark):
    rules = spark.createDataFrame([("a1", "gọi get_bank_name trước"), ("a2", "chuyển cskh"), ("m1", "thân bài 77")], "anchor string, body string")
    cands = spark.createDataFrame([("t", "a1", "sub_skill", None, 1), ("t", "a2", "sub_skill", None, 2), ("t", "m1", "skill_md", None, 3), ("t", "tool:x", "tool_message", "báo cs", 4)],
                                  "trace_id string, anchor string, source string, message string, candidate_order int")
    feats = spark.createDataFrame([("t", [("get_bank_name", 2)])], "trace_id string, tools_called array<struct<tool:string,n:bigint>>")
    known = spark.createDataFrame([("t", ["77", ""])], "trace_id string, known_values array<string>")
    got = explain.rank_candidates(cands, feats, rules).orderBy("rank").select("anchor", "score").collect()
    assert [tuple(r) for r in got] == [("a1", 160), ("a2", 110), ("tool:x", 10), ("m1", -5)]
    got = explain.rank_candidates(cands, feats, rules, known, limit=3).orderBy("rank").select("anchor", "score").collect()
    assert [tuple(r) for r in got] == [("a1", 160), ("a2", 110), ("m1", 15)]
