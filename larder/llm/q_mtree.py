"""Query 2: the ten best inner products of every hundredth vector, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.mtree import top_k, whole_vectors
from larder.llm.registry import read, register

SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op2_mtree", SQL)
def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, F.col("id") % 100 == 0, k=10).withColumnRenamed("id", "vec_id")
