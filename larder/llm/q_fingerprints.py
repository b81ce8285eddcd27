"""Query 3: fingerprints of whole documents and of edited ones, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.fingerprints import as_text, fingerprint_edits, likeness
from larder.llm.registry import read, register

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ranked AS (
  SELECT *, lead(text) OVER (ORDER BY doc_id DESC) AS following,
         first_value(text) OVER (ORDER BY doc_id DESC) AS top,
         lead(doc_id) OVER (ORDER BY doc_id DESC) AS following_id,
         first_value(doc_id) OVER (ORDER BY doc_id DESC) AS top_id
  FROM d
),
edits AS (
  SELECT doc_id, length(text) AS n_chars, text, coalesce(following_id, top_id) AS next_id,
         left(text, length(text) - length(text) // 2)
         || left(CASE WHEN following_id IS NULL THEN top ELSE following END, length(text) // 2) AS edited
  FROM ranked
),
sides AS (
  SELECT doc_id, 0 AS side, text AS body FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits
),
paragraphs AS (
  SELECT doc_id, side, paragraph
  FROM (SELECT doc_id, side, unnest(string_split(body, chr(10))) AS paragraph FROM sides)
  WHERE regexp_matches(paragraph, '[^ \t\r]')
),
equal_lanes AS (
  SELECT doc_id, side, e,
         (sum(('0x' || substr(sha256(paragraph), 8 * e + 1, 8))::UBIGINT) % 4294967296)::BIGINT AS lane
  FROM paragraphs, (SELECT unnest(range(8)) AS e) GROUP BY ALL
),
phrases AS (
  SELECT doc_id, side, ('0x' || substr(md5(phrase), 1, 16))::UBIGINT AS w0, ('0x' || substr(md5(phrase), 17, 16))::UBIGINT AS w1
  FROM (SELECT doc_id, side, unnest(string_split_regex(paragraph, '[.,!?;:|]+')) AS phrase FROM paragraphs)
  WHERE regexp_matches(phrase, '[^ \t\r]')
),
sign_lanes AS (
  SELECT doc_id, side, j,
         sum((((CASE WHEN j < 64 THEN w0 ELSE w1 END) >> (j % 64)) & 1)::BIGINT * 2 - 1) AS s
  FROM phrases, (SELECT unnest(range(128)) AS j) GROUP BY ALL
),
signs AS (SELECT doc_id, side, list(s::BIGINT ORDER BY j) AS v FROM sign_lanes GROUP BY ALL),
counts AS (SELECT doc_id, side, count(*) AS n FROM phrases GROUP BY ALL),
prints AS (
  SELECT s.doc_id, s.side, coalesce(g.v, list_transform(range(128), lambda x: 0::BIGINT)) AS v,
         lpad(lower(hex(coalesce(c.n, 0))), 8, '0')
         || coalesce(q.digits, repeat('0', 64))
         || list_aggregate(list_transform(coalesce(g.v, list_transform(range(128), lambda x: 0::BIGINT)),
              lambda x: lpad(lower(hex((x + 65536) % 65536)), 4, '0')), 'string_agg', '') AS fingerprint
  FROM sides s
  LEFT JOIN signs g USING (doc_id, side)
  LEFT JOIN counts c USING (doc_id, side)
  LEFT JOIN (SELECT doc_id, side, string_agg(lpad(lower(hex(lane)), 8, '0'), '' ORDER BY e) AS digits
             FROM equal_lanes GROUP BY ALL) q USING (doc_id, side)
),
pairs AS (
  SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint,
         list_zip(a.v, b.v) AS ab, list_zip(a.v, c.v) AS ac
  FROM edits e
  JOIN prints a ON a.doc_id = e.doc_id AND a.side = 0
  JOIN prints b ON b.doc_id = e.doc_id AND b.side = 1
  JOIN prints c ON c.doc_id = e.next_id AND c.side = 0
),
sums AS (
  SELECT *,
         list_sum(list_transform(ab, lambda z: (z[1] - z[2]) * (z[1] - z[2])))::DOUBLE AS ab_apart,
         list_sum(list_transform(ab, lambda z: z[1] * z[1] + z[2] * z[2]))::DOUBLE AS ab_both,
         list_sum(list_transform(ac, lambda z: (z[1] - z[2]) * (z[1] - z[2])))::DOUBLE AS ac_apart,
         list_sum(list_transform(ac, lambda z: z[1] * z[1] + z[2] * z[2]))::DOUBLE AS ac_both
  FROM pairs
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN ab_both = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - ab_apart / ab_both) END AS near_edited,
       CASE WHEN ac_both = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - ac_apart / ac_both) END AS near_next
FROM sums
"""


@register("op3_fingerprints", SQL)
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
