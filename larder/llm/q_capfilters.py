"""Query 12: near duplicates among embeddings with equal labels, with its SQL twin (all pairs of a label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.capfilters import near_vectors
from larder.llm.registry import read, register

SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER () AS k
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
links AS (
  SELECT a.k AS a, b.k AS b, a.vec_id AS a_id, b.vec_id AS b_id
  FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93
),
reach AS (
  SELECT k AS a, k AS b FROM u
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
roots AS (SELECT r.a, min(u.vec_id) AS component_id FROM reach r JOIN u ON u.k = r.b GROUP BY r.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
found AS (SELECT u.vec_id, coalesce(c.n, 0) AS n_links, r.component_id FROM u LEFT JOIN counts c ON c.a = u.k JOIN roots r ON r.a = u.k)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
UNION ALL
SELECT vec_id, 0, vec_id, TRUE FROM embeddings
WHERE NOT (coalesce(label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE))
"""


@register("op12_capfilters", SQL)
def op12_capfilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
