"""A corpus pipeline of five stages; each takes what the one before it kept.

Every stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
`documents`; where a text is shortened, n_chars follows it. Stages are written to the shared folder
and read again, so a lost executor costs a re-read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.common import documents, store
from ticketloom.llm.jaccard_join import drop_copies
from ticketloom.llm.line_dedup import drop_repeated_lines
from ticketloom.llm.packing import pack_documents
from ticketloom.llm.q_models import held_out
from ticketloom.llm.substring_dedup import drop_repeated_substrings
from ticketloom.llm.toxicity import toxicity

ORACLE_SQL = None  # model scores, content-defined chunks and tokenizer ids are beyond SQL


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The input's columns with kept_text as the text; a null text stays null."""
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    made = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return docs.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    # smaller slices: in a pipeline a worker also holds memory of other stages
    return toxicity(docs, labels, slice_bytes=1 << 20).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A repeated line stays in the smallest doc_id that holds it: the next stage keeps that document of a group of copies."""
    return _with_text(drop_repeated_lines(docs, keep="smallest"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies are texts that share 80 % of their runs of five words; op8_jaccard_join has limits of its own."""
    return drop_copies(docs, shingle=5, percent=80)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(drop_repeated_substrings(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
