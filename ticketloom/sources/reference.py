"""Reference tables from the taxonomy and roster files, with their consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Small tables out of a taxonomy JSON document."""
    doc = spark.read.option("multiLine", True).json(path)
    rules = doc.select(F.posexplode("tpe.mappings").alias("ord", "m"))
    return {
        "tpe_mapping": rules.select("ord", "m.code", F.col("m.steps").cast("array<string>").alias("steps"), F.col("m.case").cast("int").alias("case"), "m.status"),
        "transfer_texts": doc.select(F.explode("transfer.semantic_texts").alias("text")),
        "guardrail_rules": doc.select(F.explode("guardrail.violation_rules").alias("rule"), F.lit("violation").alias("kind")).unionByName(
            doc.select(F.explode("guardrail.compliant_rules").alias("rule"), F.lit("compliant").alias("kind"))),
    }


def transfer_templates(tables: dict[str, DataFrame], limit: int = 100) -> tuple[str, ...]:
    """Approved replies as constants; a taxonomy with more than `limit` of them is refused."""
    texts = [r["text"] for r in tables["transfer_texts"].limit(limit + 1).collect()]
    if len(texts) > limit or len(set(texts)) != len(texts) or not all(texts):
        raise ValueError("transfer texts are repeated, empty or too many")
    return tuple(texts)


def mapping_problems(mapping: DataFrame) -> DataFrame:
    """Repeated (code, step), repeated wildcard, malformed numbers: must be empty."""
    steps = mapping.select("code", F.explode("steps").alias("step"))
    repeated = steps.groupBy("code", "step").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_tpe_step").alias("problem"), F.concat_ws("/", "code", "step").alias("item"))
    wild = mapping.where(F.size("steps") == 0).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_tpe_wildcard").alias("problem"), F.col("code").alias("item"))
    number = r"^-?[0-9]{1,6}$"
    bad = mapping.select("code").distinct().where(~F.col("code").rlike(number)).select(F.lit("malformed_code").alias("problem"), F.col("code").alias("item"))
    bad_step = steps.select("step").distinct().where(~F.col("step").rlike(number)).select(F.lit("malformed_step").alias("problem"), F.col("step").alias("item"))
    return repeated.unionByName(wild).unionByName(bad).unionByName(bad_step)


def rule_overlaps(rules: DataFrame) -> DataFrame:
    """Rules listed as violation and as compliant: must be empty."""
    return rules.where("kind = 'violation'").select("rule").intersect(rules.where("kind = 'compliant'").select("rule"))


def scale_problems(scales: DataFrame) -> DataFrame:
    """(survey_id, bucket, token) rows in which a token has more than one bucket: must be empty."""
    return scales.groupBy("survey_id", "token").agg(F.count_distinct("bucket").alias("buckets")).where("buckets > 1")
