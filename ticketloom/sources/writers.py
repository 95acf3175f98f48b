"""Result tables and files: weekly artifact, investigation list, run summary, published runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .. import constants as K
from ..operators import quality
from ..operators.weekly import WEEKLY_COLUMNS, weekly_report_export
from ..session import written


def weekly_csv_rows(weekly: DataFrame, definition: str) -> DataFrame:
    return weekly.where(F.col("week_definition") == definition).select(*WEEKLY_COLUMNS)


def write_weekly_csv(weekly: DataFrame, path: str, definition: str) -> None:
    """A few dozen rows: one file by design."""
    weekly_csv_rows(weekly, definition).orderBy("cohort_week").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_weekly_export(weekly: DataFrame, path: str, tab: bool = False) -> None:
    """Fourteen hand-off columns, newest week first; a few dozen rows in one file."""
    rows = weekly_report_export(weekly).orderBy(F.desc("cohort_week")).drop("week_definition", "cohort_week").coalesce(1)
    if not tab:
        first = rows.columns[0]
        # Spreadsheet programs recognise UTF-8 by the byte-order mark.
        rows = rows.withColumnRenamed(first, "﻿" + first)
    rows.write.mode("overwrite").csv(path, header=True, sep="\t" if tab else ",")


def investigation_rows(sessions: DataFrame, keyed: DataFrame, unkeyed: DataFrame, pre_window: DataFrame) -> DataFrame:
    """Every ticket, reject and out-of-window session in one ten-column table."""
    blank = F.lit("")
    legacy = F.when(F.col("transferred"), "not_applicable").otherwise("")
    eligible = sessions.select(
        F.lit("eligible").alias("group"), "session_id", F.col("turn0_trace_id").alias("trace_id"), F.col("cohort_week").cast("string").alias("cohort_week"),
        "outcome", "data_quality", F.coalesce("no_ai_first_reason", blank).alias("reason"), legacy.alias("business_category"),
        legacy.alias("tpe_category"), legacy.alias("guardrail_rule"))

    def rejects(rows: DataFrame, group: str, session, trace, reason) -> DataFrame:
        return rows.select(
            F.lit(group).alias("group"), session.alias("session_id"), trace.alias("trace_id"), blank.alias("cohort_week"), blank.alias("outcome"),
            reason.alias("data_quality"), reason.alias("reason"), blank.alias("business_category"), blank.alias("tpe_category"), blank.alias("guardrail_rule"))

    trace = F.coalesce("trace_id", blank)
    return (
        eligible.unionByName(rejects(keyed, "invalid_keyed", F.col("session_id"), trace, F.col("reason")))
        .unionByName(rejects(unkeyed, "unkeyed", blank, trace, F.col("reason")))
        .unionByName(rejects(pre_window, "pre_window_start", F.col("session_id"), blank, F.lit("pre_window_start"))))


def run_summary(sessions: DataFrame, keyed: DataFrame, unkeyed: DataFrame, pre_window: DataFrame) -> DataFrame:
    """Long form (section, name, value): every number is an aggregate, nothing reaches the driver."""
    n = F.count(F.lit(1))

    def part(section: str, rows: DataFrame, name) -> DataFrame:
        return rows.groupBy(name.alias("name")).agg(n.cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value")

    reasons = sessions.where("data_quality <> 'valid'").select(F.col("data_quality").alias("r")).unionByName(keyed.select(F.col("reason").alias("r"))).unionByName(
        unkeyed.select(F.col("reason").alias("r")))
    scalars = {
        ("count", "eligible_ticket_count"): n, ("count", "unclassified_eligible_count"): F.count_if(F.col("outcome") == "unclassified"),
        ("count", "weekend_start_count"): F.count_if("is_weekend_start"), ("ai_first", "true"): F.count_if("ai_first"), ("ai_first", "false"): F.count_if(~F.col("ai_first")),
        ("transfer_coverage", "transferred"): F.count_if("transferred"),
    }
    for section, column in (("reopen_lifetime", "reopen_lifetime"), ("reopen_within_7d", "reopen_within_7d"), ("control_within_7d", "control_reopen_within_7d")):
        scalars[(section, "numerator")] = F.coalesce(F.sum(column), F.lit(0))
        scalars[(section, "denominator")] = F.count(column)
    row = sessions.agg(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(scalars.values())])
    items = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("name"), F.col(f"v{i}").alias("value")) for i, (s, m) in enumerate(scalars)])
    whole = row.select(F.explode(items).alias("x")).select("x.*")
    counted = lambda rows, name: rows.agg(n.cast("double").alias("value")).select(F.lit("count").alias("section"), F.lit(name).alias("name"), "value")
    return (
        whole.unionByName(part("outcome", sessions, F.col("outcome"))).unionByName(part("reply_count", sessions, F.col("ai_reply_count").cast("string")))
        .unionByName(part("quality_reason", reasons, F.col("r"))).unionByName(counted(keyed, "invalid_keyed_session_count"))
        .unionByName(counted(unkeyed, "unkeyed_trace_count")).unionByName(counted(pre_window, "pre_window_start_count")))


def dashboard_snapshot(weekly: DataFrame, segments: DataFrame) -> DataFrame:
    """One nested row per definition and week. Tickets stay a table of their own.

    Collected are segment labels of one week, which the privacy rules keep to a vocabulary.
    """
    per_week = segments.where("cohort_week is not null").groupBy("week_definition", "cohort_week").agg(
        F.array_sort(F.collect_list(F.struct("dimension", "label", "total", "ai_first", "transferred", "reopen"))).alias("segments"))
    summary = weekly.select("week_definition", "cohort_week", F.struct(*[c for c in weekly.columns if c not in ("week_definition", "cohort_week")]).alias("summary"))
    return summary.join(per_week, ["week_definition", "cohort_week"], "left")


def forbidden_columns(schema: Ty.DataType, prefix: str = "") -> list[str]:
    """Paths of raw-payload names anywhere in a schema."""
    if isinstance(schema, Ty.StructType):
        found = []
        for field in schema.fields:
            path = f"{prefix}.{field.name}" if prefix else field.name
            found += [path] if field.name in K.FORBIDDEN_OUTPUT_COLUMNS else []
            found += forbidden_columns(field.dataType, path)
        return found
    if isinstance(schema, Ty.ArrayType):
        return forbidden_columns(schema.elementType, prefix)
    if isinstance(schema, Ty.MapType):
        return forbidden_columns(schema.valueType, prefix)
    return []


#: Small table of (run_id, published_at) inside a published folder.
RUN_POINTERS = "_published"


def publish_run(df: DataFrame, root: str, run_id: str, fmt: str = "parquet", rules: dict[str, Column] | None = None, checks: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Writes one run as a partition; earlier runs stay, a rerun replaces its own partition.

    `rules` name broken rows and are counted in the pass that writes the rows; `checks` gives check rows
    for the rows as written. If anything is broken, CheckFailed is raised and nothing of the run is published.
    """
    bad = forbidden_columns(df.schema)
    if bad:
        raise ValueError(f"raw payload column must not be published: {bad[0]}")
    if rules or checks:
        df = _checked(df, rules or {}, checks)
    writer = df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").format(fmt).save(root)
    # the pointer follows the data, so a reader never meets half a run; its name is hidden from table scans
    df.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("published_at")).coalesce(1).write.mode("append").parquet(f"{root}/{RUN_POINTERS}")


def _checked(df: DataFrame, rules: dict[str, Column], checks: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The rows written aside, if they pass."""
    seen = Observation("rules")
    staged = written(df.observe(seen, *quality.broken_counts(rules)) if rules else df, "staged-run")
    broken = [f"{name} all" for name, n in seen.get.items() if n] if rules else []
    if broken:
        raise quality.CheckFailed(broken)
    if checks is not None:
        quality.refuse_failed(checks(staged))
    return staged


def latest_run(spark, root: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the run that was published last, whatever its name; only its partition is read."""
    pointers = spark.read.schema("run_id string, published_at timestamp").parquet(f"{root}/{RUN_POINTERS}")
    newest = pointers.agg(F.max_by("run_id", "published_at").alias("run_id")).first()["run_id"]
    return spark.read.format(fmt).load(root).where(F.col("run_id") == newest)
