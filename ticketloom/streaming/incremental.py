"""Incremental batch rules: which weeks are read again, atomic replacement, all-or-nothing lanes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import timefns as T


def weeks_to_refresh(weeks: DataFrame, state: DataFrame, as_of: Column, horizon_days: int = 14, retry_hours: int = 0) -> DataFrame:
    """Weeks never read or still inside their correction period; older ones are frozen."""
    joined = weeks.select("cohort_week").distinct().join(state.select("cohort_week", "fetched_at"), "cohort_week", "left")
    return joined.where(T.week_needs_fetch(F.col("cohort_week"), F.col("fetched_at"), as_of, horizon_days, retry_hours)).select("cohort_week")


# A week table is a folder of versions, rows/version=V/cohort_week=W, and a list of commits. A commit is
# one small file that names the version of every week; it is written last, so readers see all of a
# refresh or nothing of it, and a refresh that fails leaves the weeks as they were. One writer at a time.
ROWS, COMMITS = "rows", "commits"
_COMMIT = "number long, cohort_week date, version string"


def committed(spark: SparkSession, path: str, last: int = 1) -> DataFrame:
    """(number, cohort_week, version) of the last commits. A few calendar dates; a table without any has none."""
    try:
        commits = spark.read.schema(_COMMIT).json(f"{path}/{COMMITS}")
    except AnalysisException:  # nothing has been committed yet
        commits = spark.createDataFrame([], _COMMIT)
    newest = commits.agg(F.coalesce(F.max("number"), F.lit(0)).alias("n"))
    return commits.where(F.col("number") > newest.scalar() - last)


def commit_weeks(spark: SparkSession, path: str, number: int, versions: dict[date, str]) -> None:
    """The pointer of a refresh: one file, which appears as a whole. A table without weeks has a commit too."""
    rows = [(number, None, None), *((number, week, version) for week, version in sorted(versions.items()))]
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").json(f"{path}/{COMMITS}")


def read_weeks(spark: SparkSession, path: str, schema: Ty.StructType | None = None) -> DataFrame:
    """The rows of the newest commit; only folders of its versions and weeks are opened."""
    by_version: dict[str, list] = {}
    for row in committed(spark, path).where("version is not null").collect():
        by_version.setdefault(row["version"], []).append(row["cohort_week"])
    rows = (spark.read.schema(schema) if schema is not None else spark.read).parquet(f"{path}/{ROWS}")
    current = reduce(or_, [(F.col("version") == v) & F.col("cohort_week").isin(weeks) for v, weeks in by_version.items()], F.lit(False))
    return rows.where(current).drop("version")


def replace_weeks(rows: DataFrame, path: str, weeks: DataFrame | None = None) -> None:
    """Replaces the weeks present in `rows`, each as a whole, and empties those of `weeks` that have no rows."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "cohort_week").parquet(f"{path}/{ROWS}")
    schema = Ty.StructType([*[f for f in rows.schema.fields if f.name != "cohort_week"], Ty.StructField("version", Ty.StringType()), Ty.StructField("cohort_week", Ty.DateType())])
    new = spark.read.schema(schema).parquet(f"{path}/{ROWS}").where(F.col("version") == version).select("cohort_week").distinct()
    # weeks are a few calendar dates; only they reach the driver
    fresh = {r["cohort_week"] for r in new.collect()}
    gone = {r["cohort_week"] for r in weeks.select("cohort_week").distinct().collect()} if weeks is not None else set()
    before = committed(spark, path).collect()
    kept = {r["cohort_week"]: r["version"] for r in before if r["version"] is not None and r["cohort_week"] not in fresh | gone}
    commit_weeks(spark, path, max((r["number"] for r in before), default=0) + 1, {**kept, **dict.fromkeys(fresh, version)})


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the versions that none of the last `keep` commits names, and returns them. Readers of older commits must be done."""
    used = {r["version"] for r in committed(spark, path, keep).where("version is not null").collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{ROWS}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("version=") and s.getPath().getName()[8:] not in used]
    for old in gone:
        files.delete(old, True)
    return sorted(old.getName()[8:] for old in gone)


def refresh_weeks(new_rows: DataFrame, state: DataFrame, path: str, as_of: Column, horizon_days: int = 14, retry_hours: int = 0) -> DataFrame:
    """Writes the due weeks of `new_rows` and returns them; a due week known from the state that has
    lost all its rows is emptied. Frozen weeks are left untouched."""
    known = new_rows.select("cohort_week").unionByName(state.select("cohort_week"))
    due = weeks_to_refresh(known, state, as_of, horizon_days, retry_hours)
    replace_weeks(new_rows.join(due, "cohort_week", "left_semi"), path, weeks=due)
    return due


def week_sink(path: str, rebuild: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch target: weeks touched by a micro-batch are rebuilt from the full tables and
    replaced. Running a batch twice gives the same files."""

    def write(batch: DataFrame, _: int) -> None:
        weeks = batch.select("cohort_week").distinct()
        replace_weeks(rebuild(weeks), path, weeks=weeks)

    return write


def lane_status(observed: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """(name, complete) of every expected lane; a lane that was not observed is not complete."""
    names = observed.sparkSession.createDataFrame([(n,) for n in expected], "name string")
    return names.join(observed.groupBy("name").agg(F.bool_and("complete").alias("complete")), "name", "left").select("name", F.coalesce("complete", F.lit(False)).alias("complete"))


def all_or_nothing_enrichment(signals: DataFrame, lanes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals only when every lane (name, complete) is complete, and the one-row status."""
    good = lanes.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("good"))
    status = good.select(F.when(F.col("good"), "complete").otherwise("partial").alias("status"))
    return signals.where(good.scalar()), status
