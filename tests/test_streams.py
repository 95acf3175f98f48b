from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketloom.plans import fixtures as Fx
from ticketloom.sources import writers
from ticketloom.streaming import incremental, streams


def run(query_frame, spark, name, mode, path):
    q = query_frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return spark.table(name)


def test_ticket_state_stream_equals_batch(spark, sf_dir, tmp_path):
    pytest.importorskip("google.protobuf", reason="Spark's stateful Python processor needs protobuf")
    source = str(tmp_path / "traces")
    rows = Fx.traces(spark, sf_dir).select("session_id", "trace_id", "turn", F.col("ts").cast("timestamp").alias("ts"), "is_ai", "is_transfer")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = run(streams.ticket_state_stream(stream, "60 days"), spark, "ticket_state", "update", str(tmp_path / "c1"))
    last = out.groupBy("session_id").agg(F.max_by(F.struct("ai_first", "outcome", "reopen_lifetime", "reopen_within_7d", "ai_reply_count"), "turn_count").alias("l"))
    got = {r["session_id"]: tuple(r["l"]) for r in last.collect()}
    want = {r["session_id"]: tuple(r)[1:] for r in Fx.sessions(spark, sf_dir).select("session_id", "ai_first", "outcome", "reopen_lifetime", "reopen_within_7d", "ai_reply_count").collect()}
    assert got == want


def test_latest_response_stream(spark, tmp_path):
    source = str(tmp_path / "answers")
    rows = spark.createDataFrame([("1", "a", datetime(2024, 1, 2), "positive"), ("1", "b", datetime(2024, 1, 5), "negative"), ("2", "c", datetime(2024, 1, 3), "neutral"),
                                  ("1", "d", datetime(2024, 1, 4), "neutral")], "ticket_id string, response_key string, responded_ts timestamp, satisfaction_bucket string")
    rows.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = run(streams.latest_response_stream(stream), spark, "latest_answers", "update", str(tmp_path / "c2"))
    got = {r["ticket_id"]: r["b"] for r in out.groupBy("ticket_id").agg(F.max_by("satisfaction_bucket", F.struct("responded_ts", "response_key")).alias("b")).collect()}
    assert got == {"1": "negative", "2": "neutral"}


def weeks_of(spark, path):
    return {str(r["cohort_week"]): r["v"] for r in incremental.read_weeks(spark, path).collect()}


def make_weeks(spark, tag, days=("2024-01-01", "2024-01-15", "2024-01-22")):
    return spark.createDataFrame([(w, tag) for w in days], "w string, v string").select(F.col("w").cast("date").alias("cohort_week"), "v")


def test_week_refresh_replaces_due_weeks_only(spark, tmp_path):
    path = str(tmp_path / "weeks")
    make = lambda tag: make_weeks(spark, tag)
    incremental.replace_weeks(make("old"), path)
    state = spark.createDataFrame([("2024-01-01",), ("2024-01-15",)], "w string").select(F.col("w").cast("date").alias("cohort_week"), F.expr("timestamp_ntz'2024-01-23 00:00:00'").alias("fetched_at"))
    incremental.refresh_weeks(make("new"), state, path, F.expr("timestamp_ntz'2024-01-30 00:00:00'"))
    assert weeks_of(spark, path) == {"2024-01-01": "old", "2024-01-15": "new", "2024-01-22": "new"}
    incremental.refresh_weeks(make("newer").where("cohort_week < '2024-01-20'"), state.unionByName(state.limit(1).select(F.lit("2024-01-22").cast("date").alias("cohort_week"), "fetched_at")), path, F.expr("timestamp_ntz'2024-01-30 00:00:00'"))
    assert weeks_of(spark, path) == {"2024-01-01": "old", "2024-01-15": "newer"}


def test_refresh_that_fails_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "weeks")
    incremental.replace_weeks(make_weeks(spark, "old"), path)
    with monkeypatch.context() as m:
        m.setattr(incremental, "commit_weeks", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            incremental.replace_weeks(make_weeks(spark, "half", ("2024-01-15",)), path, weeks=make_weeks(spark, "", ("2024-01-22",)))
    assert set(weeks_of(spark, path).values()) == {"old"} and len(weeks_of(spark, path)) == 3
    with pytest.raises(Exception, match="broken"):  # rows that fail while they are written
        broken = make_weeks(spark, "bad").withColumn("v", F.when(F.col("cohort_week") == F.lit("2024-01-22").cast("date"), F.raise_error(F.lit("broken")).cast("string")).otherwise("bad"))
        incremental.replace_weeks(broken, path)
    assert set(weeks_of(spark, path).values()) == {"old"}
    # the same refresh again, all of it
    incremental.replace_weeks(make_weeks(spark, "half", ("2024-01-15",)), path, weeks=make_weeks(spark, "", ("2024-01-22",)))
    assert weeks_of(spark, path) == {"2024-01-01": "old", "2024-01-15": "half"}
    assert incremental.drop_old_versions(spark, path, keep=1) and weeks_of(spark, path) == {"2024-01-01": "old", "2024-01-15": "half"}


def test_all_weeks_may_go_and_only_named_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "weeks")
    incremental.replace_weeks(make_weeks(spark, "old"), path)
    plan = incremental.read_weeks(spark, path)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ["):]
    assert "cohort_week" in filters[:filters.index("]")] and "version" in filters[:filters.index("]")]
    incremental.replace_weeks(make_weeks(spark, "x").where("false"), path, weeks=make_weeks(spark, ""))
    assert weeks_of(spark, path) == {}


def test_week_sink_rebuilds_touched_weeks(spark, tmp_path):
    path, source = str(tmp_path / "weeks"), str(tmp_path / "source")
    incremental.replace_weeks(make_weeks(spark, "old"), path)
    make_weeks(spark, "x", ("2024-01-15", "2024-01-15")).write.parquet(source)
    sink = incremental.week_sink(path, lambda weeks: make_weeks(spark, "rebuilt").join(weeks, "cohort_week", "left_semi"))
    stream = spark.readStream.schema("cohort_week date, v string").parquet(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert weeks_of(spark, path) == {"2024-01-01": "old", "2024-01-15": "rebuilt", "2024-01-22": "old"}


def test_ticket_facts_outlive_the_timer(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="Spark's stateful Python processor needs protobuf")
    rows = [("s", f"t{turn}", turn, ts, True, False) for turn, ts in enumerate(["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-20 00:00:00"])]
    rows += [("other", "x", 0, "2024-01-15 00:00:00", True, False)]
    path = str(tmp_path / "traces")
    schema = "session_id string, trace_id string, turn int, ts string, is_ai boolean, is_transfer boolean"
    out = str(tmp_path / "out")
    for day in ("2024-01-01", "2024-01-02", "2024-01-15", "2024-01-20"):
        batch = spark.createDataFrame([r for r in rows if r[3].startswith(day)], schema).withColumn("ts", F.col("ts").cast("timestamp"))
        batch.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(batch.schema).parquet(path)
        job = streams.ticket_state_stream(stream, "1 hour").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c9"))
        job.foreachBatch(lambda rows, i: rows.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination(120)
    last = spark.read.parquet(out).where("session_id = 's'").orderBy(F.col("turn_count").desc()).first()
    assert (last["turn_count"], last["reopen_lifetime"], last["reopen_within_7d"]) == (3, 2, 1)


class FakeHandle:
    """State and timers of one key in dictionaries; counts what is written."""

    def __init__(self):
        self.timers, self.writes = [], 0

    def state(self, *_):
        handle, rows = self, {}

        class State:
            def get(self, key=None):
                return rows.get(key)

            def update(self, value, key=None):
                handle.writes += 1
                rows[key] = value

            def updateValue(self, key, value):  # noqa: N802
                self.update(value, key)

            getValue, removeKey, values = get, lambda self, key: rows.pop(key), rows.values  # noqa: N815

        return State()

    getValueState = getMapState = state  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_a_shard_of_tickets_is_one_key_and_a_batch_writes_the_pages_it_touches(monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    monkeypatch.setattr(streams.TicketState, "PAGE", 8)
    monkeypatch.setattr(streams.TicketState, "KEPT", 3)
    rng, hour, week = np.random.default_rng(5), 3600 * 1_000_000, streams.REOPEN_US
    n = 2500  # tickets get 0 to about 20 traces, some of them the same one twice; turns do not follow the time
    rows = pd.DataFrame({"session_id": [str(i) for i in rng.integers(0, 300, n)], "trace_id": [str(i) for i in rng.integers(0, 2000, n)], "turn": rng.integers(0, 6, n),
                         "us": rng.integers(0, 400, n) * hour, "is_ai": rng.random(n) < 0.4, "is_transfer": rng.random(n) < 0.1})
    rows.loc[0, "session_id"] = None
    handle, state, now = FakeHandle(), streams.TicketState(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    state.init(handle)
    out = pd.concat([f for i in range(0, n, 100) for f in state.handleInputRows((1,), iter([rows[i:i + 60], rows[i + 60:i + 100]]), now)], ignore_index=True)

    def facts(traces):
        traces = [([t.turn, t.us, t.trace_id], t.is_ai, t.is_transfer) for t in traces.itertuples()]
        first, last = min(t[0] for t in traces), max(traces, key=lambda t: t[0])[0]
        deciding = min((t[0] for t in traces if t[1] or t[2]), default=None)
        by_ai = [t[1] for t in traces if t[0] == deciding][:1] == [True]
        replies, ended = sum(t[1] for t in traces), [t[1] for t in traces if t[0] == last][-1]
        again = deciding is not None and any(t[0] > deciding and first[1] < t[0][1] <= first[1] + week for t in traces)
        outcome = "unclassified" if deciding is None else "direct_cs" if not by_ai else "ai_then_cs" if any(t[2] for t in traces) else "ai_end_to_end"
        return by_ai, outcome, replies - ended if by_ai else None, int(again) if by_ai else None, replies, len(traces)

    def latest(frame):
        return {None if pd.isna(r[1]) else r[1]: tuple(None if pd.isna(v) else v for v in r[2:]) for r in frame.itertuples()}

    want = {sid: facts(part) for sid, part in rows.groupby(rows["session_id"].fillna("none"))}
    want[None] = want.pop("none")
    assert latest(out) == want
    # one more trace of one ticket: its page and the index, not the shard
    handle.writes = 0
    more = pd.DataFrame({"session_id": ["7"], "trace_id": ["x"], "turn": [9], "us": [0], "is_ai": [True], "is_transfer": [False]})
    got = pd.concat(state.handleInputRows((1,), iter([more]), now))
    assert handle.writes == 2 and list(got["turn_count"]) == [want["7"][-1] + 1]
    # all tickets are closed at their time and shown once more; the kept places go, the facts stay
    assert len(handle.timers) == 1
    done = SimpleNamespace(getCurrentWatermarkInMs=lambda: (400 * hour + week) // 1000 + 2)
    closed = pd.concat(state.handleExpiredTimer((1,), done, None))
    assert latest(closed) == {**want, "7": latest(got)["7"]} and not list(state.stored_places.values())
    late = more.assign(us=[800 * hour], turn=[10], trace_id=["y"])
    assert latest(pd.concat(state.handleInputRows((1,), iter([late]), done)))["7"][3:] == (latest(got)["7"][3], latest(got)["7"][4] + 1, latest(got)["7"][5] + 1)


def test_publish_run_refuses_raw_payloads(spark, tmp_path):
    root = str(tmp_path / "runs")
    good = spark.createDataFrame([(1, "x")], "n int, label string")
    writers.publish_run(good, root, "run-1")
    writers.publish_run(good.withColumn("n", F.lit(2)), root, "run-2")
    writers.publish_run(good.withColumn("n", F.lit(3)), root, "run-1")
    assert sorted((r["run_id"], r["n"]) for r in spark.read.parquet(root).collect()) == [("run-1", 3), ("run-2", 2)]
    assert [r["n"] for r in writers.latest_run(spark, root).collect()] == [3]
    writers.publish_run(good.withColumn("n", F.lit(4)), root, "run-10")
    writers.publish_run(good.withColumn("n", F.lit(5)), root, "run-9")
    assert [r["n"] for r in writers.latest_run(spark, root).collect()] == [5]
    with pytest.raises(ValueError):
        writers.publish_run(good.select(F.struct(F.col("label").alias("response")).alias("s")), root, "run-3")


def test_broken_rows_and_failed_checks_refuse_a_run(spark, tmp_path):
    from ticketloom.operators import quality

    root = str(tmp_path / "runs")
    good = spark.createDataFrame([(1, "x"), (2, "y")], "n int, label string")
    rules = {"n_positive": F.col("n") <= 0, "label_filled": F.col("label") == ""}
    total = lambda rows: rows.agg(F.sum("n").alias("s")).select(F.explode(F.array(quality.check_row("adds_up", F.lit("all"), F.lit(3), F.col("s")))).alias("c")).select("c.*")
    writers.publish_run(good, root, "run-1", rules=rules, checks=total)
    for bad, what in ((good.withColumn("n", F.col("n") - 1), "n_positive"), (good.withColumn("label", F.lit("")), "label_filled"), (good.withColumn("n", F.col("n") + 1), "adds_up")):
        for run in ("run-1", "run-2"):
            with pytest.raises(quality.CheckFailed, match=what):
                writers.publish_run(bad, root, run, rules=rules, checks=total)
    # neither the refused rerun nor the refused new run left anything behind
    assert sorted((r["run_id"], r["n"]) for r in spark.read.parquet(root).collect()) == [("run-1", 1), ("run-1", 2)]
    assert [r["run_id"] for r in writers.latest_run(spark, root).select("run_id").distinct().collect()] == ["run-1"]


def test_json_traces_are_read_strictly(spark, tmp_path):
    from ticketloom.operators import ingest
    from ticketloom.sources import readers

    path = tmp_path / "t.jsonl"
    path.write_text('{"id": "a", "sessionId": "1", "timestamp": "2024-01-02T00:00:00Z", "metadata": {"turn": 0}, "input": {}, "output": {}}\n'
                    '{"id": 5, "sessionId": "1", "timestamp": "2024-01-02T00:00:00Z", "metadata": {"turn": 0}}\n'
                    '{"id": "late", "sessionId": "1", "timestamp": "2025-01-02T00:00:00Z", "metadata": {"turn": 0}}\n')
    table = str(tmp_path / "traces")
    readers.write_traces(readers.traces_from_json(readers.read_json(spark, str(path))), table)
    raw = readers.read_traces(spark, table, "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    assert sorted((r["trace_id"] or "", r["reason"]) for r in ingest.normalize_traces(raw).collect()) == [("", "missing_trace_id"), ("a", None)]


def test_readers_open_only_their_partitions(spark, tmp_path):
    from ticketloom.sources import readers

    rows = spark.createDataFrame([(f"{name}{day}", name, f"2024-01-{day:02d}T12:00:00Z") for name in ("route", "tool:x") for day in range(1, 10)] + [("none", "route", "soon")],
                                 "id string, name string, startTime string")
    table, plain = str(tmp_path / "observations"), str(tmp_path / "plain")
    readers.write_observations(rows, table)
    got = readers.read_observations(spark, table, "tool:x", "2024-01-03 12:00:00", "2024-01-05 12:00:00")
    assert sorted(r["id"] for r in got.collect()) == ["tool:x3", "tool:x4"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ["):]
    assert "name" in filters[:filters.index("PushedFilters")] and "day" in filters[:filters.index("PushedFilters")]
    # a table that is not laid out so would be scanned whole: refused
    rows.write.parquet(plain)
    for read in (lambda: readers.read_observations(spark, plain, "route", "2024-01-01", "2024-01-02"), lambda: readers.read_traces(spark, table, "2024-01-01", "2024-01-02")):
        with pytest.raises(ValueError, match="not partitioned"):
            read()
    # a second write replaces its own days only
    readers.write_observations(rows.where("id = 'tool:x4'").withColumn("id", F.lit("again")), table)
    assert sorted(r["id"] for r in readers.read_observations(spark, table, "tool:x", "2024-01-03 00:00:00", "2024-01-06 00:00:00").collect()) == ["again", "tool:x3", "tool:x5"]


def test_all_observations_of_a_name_are_read(spark, tmp_path):
    """The query names no period: observations of any day, and of none, are its rows."""
    from ticketloom.plans.queries import QUERIES
    from ticketloom.sources import readers

    days = ("2023-11-30 23:59:59", "2024-01-04 12:00:00", "2024-01-10 12:00:00", "2024-01-25 12:00:00", "2025-06-01 00:00:00", None)
    events = [(i, day, i, kind, 1.0, f'{{"k": {i}}}') for kind, first in (("view", 1), ("click", 20)) for i, day in enumerate(days, first)]
    spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["read_observations"](spark, str(tmp_path)).collect()
    assert sorted((r["trace_id"], r["intent"]) for r in got) == [(str(i), f"intent_{i}") for i in range(1, 7)]

    table = str(tmp_path / "observations")
    readers.write_observations(spark.createDataFrame([("a", "x", "2020-01-01T00:00:00Z"), ("b", "x", "soon"), ("c", "y", "2020-01-01T00:00:00Z")],
                                                     "id string, name string, startTime string"), table)
    assert sorted(r["id"] for r in readers.read_observations(spark, table, "x").collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="both"):
        readers.read_observations(spark, table, "x", "2020-01-01")


def test_ids_before_the_period_are_no_repeats(spark):
    from ticketloom.sources import readers

    rows = [("1", "2024-01-01 00:00:00"), ("1", "2024-01-08 00:00:00"), ("2", "2024-01-09 00:00:00"), ("3", "2024-01-07 23:59:59"), ("x", "2024-01-07 00:00:00")]
    made = lambda r: spark.createDataFrame(r, "ticket_id string, created_ts string").withColumn("created_ts", F.col("created_ts").cast("timestamp_ntz"))
    read = lambda r: sorted(t["ticket_id"] for t in readers.read_helpdesk_tickets(made(r), "2024-01-08 00:00:00").collect())
    assert read(rows) == ["1", "2"]
    for broken in (("2", "2024-01-10 00:00:00"), ("x", "2024-01-10 00:00:00")):
        with pytest.raises(Exception, match="malformed or repeated"):
            read([*rows, broken])
