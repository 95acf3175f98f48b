"""Queries: streaming and incremental jobs run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..session import new_folder
from ..sources import writers
from ..streaming import incremental, streams
from ..window import ntz
from . import fixtures as Fx
from . import q_service as S
from .oracle_base import sql
from .q_metrics import weekly_rows
from .registry import query

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(frame, spark, name):
    """Runs a stream over what is there and returns the rows it emitted, read back from files."""
    out, marks = new_folder(spark, name), new_folder(spark, f"{name}-state")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    job = frame.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(out)


def _as_stream(rows, spark, name):
    path = new_folder(spark, f"{name}-source")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("latest_response_stream", sql("SELECT ticket_id, arg_max(satisfaction_bucket, (responded_ts, response_key)) AS satisfaction_bucket FROM cs GROUP BY 1", S._CSAT))
def latest_response_stream(spark, d):
    rows = S.plain_answers(spark, d).withColumn("responded_ts", F.col("responded_ts").cast("timestamp"))
    out = _run(streams.latest_response_stream(_as_stream(rows, spark, "answers")), spark, "latest")
    return out.groupBy("ticket_id").agg(F.max_by("satisfaction_bucket", F.struct("responded_ts", "response_key")).alias("satisfaction_bucket"))


@query("ticket_state_stream", sql("SELECT session_id, ai_first, outcome, reopen_lifetime, reopen_within_7d, ai_reply_count, turn_count FROM ses"))
def ticket_state_stream(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    rows = Fx.traces(spark, d).select("session_id", "trace_id", "turn", F.col("ts").cast("timestamp").alias("ts"), "is_ai", "is_transfer")
    out = _run(streams.ticket_state_stream(_as_stream(rows, spark, "traces"), "1 hour"), spark, "tickets")
    last = F.max_by(F.struct("ai_first", "outcome", "reopen_lifetime", "reopen_within_7d", "ai_reply_count", "turn_count"), "turn_count").alias("l")
    return out.groupBy("session_id").agg(last).select("session_id", "l.*")


@query("incremental_week_refresh", sql("""SELECT cohort_week, outcome, count(*) AS tickets, CASE WHEN cohort_week <= DATE '2024-01-08' THEN 'old' ELSE 'new' END AS state FROM ses GROUP BY 1, 2"""))
def incremental_week_refresh(spark, d):
    path = new_folder(spark, "weeks")
    rows = Fx.sessions(spark, d).groupBy("cohort_week", "outcome").agg(F.count(F.lit(1)).alias("tickets"))
    incremental.replace_weeks(rows.withColumn("state", F.lit("old")), path)
    fetched = F.when(F.col("cohort_week") < F.lit("2024-01-29").cast("date"), F.date_add("cohort_week", 7).cast("timestamp_ntz"))
    state = rows.select("cohort_week").distinct().select("cohort_week", fetched.alias("fetched_at")).where("fetched_at is not null")
    incremental.refresh_weeks(rows.withColumn("state", F.lit("new")), state, path, ntz(Fx.WINDOW.as_of_utc), 14)
    return incremental.read_weeks(spark, path)


@query("publish_run", sql("SELECT week_definition, cohort_week, total_tickets, 'run-10' AS run_id FROM wk"))
def publish_run(spark, d):
    root = new_folder(spark, "runs")
    rows = weekly_rows(spark, d).select("week_definition", "cohort_week", "total_tickets")
    writers.publish_run(rows.where("week_definition = 'mon_sun'"), root, "run-2")
    writers.publish_run(rows, root, "run-10")
    return writers.latest_run(spark, root)


@query("rating_tokens", sql("SELECT 'survey' AS survey_id, rating_raw AS rating, count(*) AS count FROM cs GROUP BY 2", S._CSAT))
def rating_tokens(spark, d):
    return quality.rating_tokens(Fx.csat(spark, d))
