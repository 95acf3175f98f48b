"""Queries over filters: the interaction audit."""

from __future__ import annotations

from . import filter_audit
from .common import documents
from .registry import query


@query("op12_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS smallest FROM d),
flags AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > smallest, false) AS e FROM w),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
hist AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, b)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31),
steps AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(CAST(list_sum(bits[1:k - 1]) AS INT), 0) AS before FROM orders, range(1, 6) x(k)),
sums AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
         sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM hist, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM sums
""")
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
