"""Queries over whole texts: quality rules, byte-level BPE, packing, line and substring deduplication."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, license_scan, line_dedup, packing, quality_rules, substring_dedup
from .common import documents
from .registry import query


@query("op6_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, list_extract(u.parts, u.i) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)) u),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS lost FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op6_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    rated = quality_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text"), trusted)
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), *vocab).drop("text")
    decoded = bpe.decode(encoded, *vocab)
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    cut = substring_dedup.drop_repeated_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_chunks", "n_dropped_chunks", "dropped_words", "dropped", "kept_text")


@query("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(documents(spark, sf_dir))
