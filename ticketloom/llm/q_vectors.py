"""Queries over embeddings: exact top-k search, near duplicates, code compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import topk, vector_codes, vector_dedup
from .registry import query


@query("op9_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""")
def op9_exact_top_k(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


@query("op11_vector_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
answer AS (
  SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.root, e.vec_id) AS component_id FROM embeddings e
  LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
  LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = e.vec_id)
SELECT *, coalesce(vec_id = component_id, true) AS kept FROM answer
""")
def op11_vector_near_dedup(spark, sf_dir):
    return vector_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql(rounds: int) -> str:
    """Assignment and refinement, one pair of tables for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT x.vec_id, x.p, c.e, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM parts x JOIN book{r} c ON x.p = c.p AND x.i = c.i GROUP BY x.vec_id, x.p, c.e)
  GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
  SELECT n.p, n.best.e AS e, x.i, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM near{r} n JOIN parts x ON x.vec_id = n.vec_id AND x.p = n.p GROUP BY n.p, n.best.e, x.i),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
  FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e AND m.i = b.i)""")
    return ",".join(steps)


@query("op13_vector_codes", f"""
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT max(len(v)) // 8 AS n FROM usable),
parts AS MATERIALIZED (
  SELECT vec_id, (j - 1) // size.n AS p, (j - 1) % size.n AS i, v[j] AS v FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS j FROM usable), size),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM usable ORDER BY vec_id LIMIT 16),
book0 AS MATERIALIZED (SELECT p, e, i, v FROM parts JOIN first USING (vec_id)),
{_rounds_sql(vector_codes.ROUNDS)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{vector_codes.ROUNDS} GROUP BY vec_id),
whole AS (SELECT c.*, u.label FROM coded c JOIN usable u USING (vec_id)),
per_label AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM whole GROUP BY label),
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS d FROM book{vector_codes.ROUNDS})
SELECT w.vec_id, w.code, w.error, l.label_error, digest.d AS codebooks_sha256
FROM whole w JOIN per_label l ON w.label IS NOT DISTINCT FROM l.label, digest
""")
def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")
