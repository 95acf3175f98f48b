"""Queries with models of the corpus: toxicity, language-model scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import lm_scoring, toxicity
from .common import documents
from .registry import query


def held_out(doc_id="doc_id"):
    """Whether a document's labels are never learned from (a row without id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = toxicity.toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(documents(spark, sf_dir))
