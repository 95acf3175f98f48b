"""Table readers: time- and name-pruned scans, safe projections, input checks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import timefns as T
from ..functions import variants as V


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as one VARIANT column `payload`."""
    return spark.read.option("singleVariantColumn", "payload").json(path)


def traces_from_json(payload: DataFrame) -> DataFrame:
    """Raw trace columns from one VARIANT column; wrongly typed ids and times become null."""
    v = F.col("payload")
    text = lambda name: V.string_at(v, f"$.{name}").alias(name)
    latency = F.when(V.type_of(v, "$.latency") != "BOOLEAN", F.try_variant_get(v, "$.latency", "double"))
    return payload.select(text("id"), text("sessionId"), text("timestamp"), text("environment"),
                          *[V.part(v, f"$.{c}").alias(c) for c in ("metadata", "input", "output")], latency.alias("latency"))


def observations_from_json(payload: DataFrame) -> DataFrame:
    v = F.col("payload")
    start = F.coalesce(V.string_at(v, "$.startTime"), V.string_at(v, "$.timestamp"))
    return payload.select(V.string_at(v, "$.id").alias("id"), V.string_at(v, "$.traceId").alias("traceId"), V.string_at(v, "$.name").alias("name"),
                          start.alias("startTime"), *[V.part(v, f"$.{c}").alias(c) for c in ("metadata", "input", "output")])


def time_slice(rows: DataFrame, start: str, end: str, column: str = "ts") -> DataFrame:
    """Half-open UTC range. The bare column comparison reaches Parquet row groups."""
    c = F.col(column)
    return rows.where((c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz")))


#: What a table folder says about its own layout; the name is hidden from table scans.
LAYOUT = "_layout"


def _write_laid_out(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Replaces the partitions present in `rows`; a partition of any size is spread over tasks."""
    rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    plain = [f for f in rows.schema.fields if f.name not in parts]
    schema = Ty.StructType([*plain, *[rows.schema[p] for p in parts]])
    mark = rows.sparkSession.createDataFrame([(parts, schema.json())], "parts array<string>, schema string")
    mark.coalesce(1).write.mode("overwrite").json(f"{path}/{LAYOUT}")


def _read_laid_out(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """The table, if its writer partitioned it by `parts`; any other table would be scanned whole and is refused."""
    try:
        mark = spark.read.schema("parts array<string>, schema string").json(f"{path}/{LAYOUT}").first()
    except AnalysisException:
        mark = None
    if mark is None or list(mark["parts"]) != parts:
        raise ValueError(f"{path} is not partitioned by {', '.join(parts)}")
    return spark.read.schema(Ty.StructType.fromJson(json.loads(mark["schema"]))).parquet(path)


def _timed(rows: DataFrame, column: str) -> DataFrame:
    """Text times parsed once, when the table is written: `ts`, and its UTC day as the partition."""
    parsed = rows.withColumn("ts", T.parse_aware_timestamp(F.col(column)))
    return parsed.withColumn("day", F.col("ts").cast("date"))


def _days(start: str, end: str) -> Column:
    return F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def write_traces(raw: DataFrame, path: str) -> None:
    """Raw traces by UTC day. Those whose time can't be read lie in the null day."""
    _write_laid_out(_timed(raw, "timestamp"), path, ["day"])


def read_traces(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Raw traces of a half-open UTC range: only its days are opened, and row groups are cut by time.

    Unreadable times stay in: they are reject rows, not rows of another period.
    """
    rows = _read_laid_out(spark, path, ["day"])
    dated = time_slice(rows.where(_days(start, end)), start, end)
    return dated.unionByName(rows.where("day is null"))


def observations_named(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("name") == name)


def write_observations(rows: DataFrame, path: str) -> None:
    """Observations by name and UTC day."""
    _write_laid_out(_timed(rows, "startTime"), path, ["name", "day"])


def read_observations(spark: SparkSession, path: str, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observations of one name in a half-open UTC range: one name's days are opened.

    Without a range all of the name's observations, those whose time can't be read as well.
    """
    if (start is None) != (end is None):
        raise ValueError("a range needs both its start and its end")
    rows = observations_named(_read_laid_out(spark, path, ["name", "day"]), name)
    return rows if start is None else time_slice(rows.where(_days(start, end)), start, end)


def traces_by_session(traces: DataFrame, session_id: str) -> DataFrame:
    return traces.where(F.col("session_id") == session_id).orderBy("ts")


def read_conversations(messages: DataFrame) -> DataFrame:
    """Safe message fields; the body is used for the automatic-note flag and dropped."""
    note = F.col("private") & F.coalesce(F.lower("body_text").contains("autorep"), F.lit(False))
    return messages.select("ticket_id", "message_id", "author_id", "incoming", "private", "source", "created_ts", "category", note.alias("is_autorep_note"))


def helpdesk_problems(tickets: DataFrame) -> DataFrame:
    """Malformed or repeated inventory ids: must be empty."""
    shape = tickets.where(~F.coalesce(F.col("ticket_id").rlike("^[1-9][0-9]*$"), F.lit(False)) | F.col("created_ts").isNull()).select(
        F.lit("malformed").alias("problem"), "ticket_id")
    again = tickets.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), "ticket_id")
    return shape.unionByName(again)


def read_helpdesk_tickets(tickets: DataFrame, since: str) -> DataFrame:
    """Inventory from a time on; a malformed or repeated id fails the job when the rows are read.

    Only tickets of the period are listed, so an id of an older ticket is not a repeat.
    """
    listed = tickets.where(F.col("created_ts") >= F.lit(since).cast("timestamp_ntz"))
    counted = listed.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n"))
    shaped = F.coalesce(F.col("ticket_id").rlike("^[1-9][0-9]*$"), F.lit(False)) & F.col("created_ts").isNotNull()
    joined = listed.join(counted, "ticket_id")
    checked = F.when(shaped & (F.col("n") == 1), F.col("ticket_id")).otherwise(F.raise_error(F.lit("inventory id is malformed or repeated")).cast("string"))
    return joined.withColumn("ticket_id", checked).drop("n")
