"""Query 1: all documents without later copies of repeated runs of lines, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.linededup import WORD_CHARS, without_copies
from larder.llm.registry import read, register

#: Common tables that leave `deduped` (doc_id, lang, source, text, n_lines, n_deleted) of a relation `docs_in`
#: with unique doc_id. Runs are keyed by their lines themselves.
STEPS = r"""
raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM docs_in
),
numbered AS (
  SELECT *, regexp_matches(l, '[^ \t\r]') AS full_line,
         sum(CASE WHEN regexp_matches(l, '[^ \t\r]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n
  FROM raw
),
lines AS (SELECT doc_id, n, rtrim(l, ' ' || chr(9) || chr(13)) AS l FROM numbered WHERE full_line),
lists AS (
  SELECT doc_id, list(l ORDER BY n) AS ls,
         list(greatest(len(string_split_regex(regexp_replace(l, '^ +', ''), '[ \t]+')), length(l) // WORD_CHARS) ORDER BY n) AS ws
  FROM lines GROUP BY doc_id
),
starts AS (SELECT doc_id, ls, ws, unnest(range(1, len(ls) + 1)) AS n FROM lists),
sized AS (SELECT *, unnest(range(1, least(10, len(ls) - n + 1) + 1)) AS size FROM starts),
runs AS (
  SELECT doc_id, n, size, sha256(array_to_string(ls[n:n + size - 1], chr(10))) AS k
  FROM sized WHERE list_sum(ws[n:n + size - 1]) >= 10
),
copies AS (
  SELECT * FROM (SELECT *, first_value((doc_id, n)) OVER (PARTITION BY size, k ORDER BY doc_id, n) AS f FROM runs)
  WHERE f <> (doc_id, n)
),
gone AS (SELECT DISTINCT doc_id, unnest(range(n, n + size)) AS n FROM copies),
kept AS (
  SELECT r.doc_id, string_agg(r.l, chr(10) ORDER BY r.i) FILTER (WHERE g.n IS NULL) AS kept_text
  FROM numbered r LEFT JOIN gone g USING (doc_id, n) GROUP BY r.doc_id
),
deduped AS (
  SELECT d.doc_id, d.lang, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept_text, '') END AS text,
         coalesce(len(s.ls), 0)::INTEGER AS n_lines, coalesce(c.n_deleted, 0)::INTEGER AS n_deleted
  FROM docs_in d LEFT JOIN kept k USING (doc_id) LEFT JOIN lists s USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n_deleted FROM gone GROUP BY doc_id) c USING (doc_id)
)
""".replace("WORD_CHARS", str(WORD_CHARS))

SQL = f"""
WITH docs_in AS (SELECT doc_id, text, lang, source FROM documents),
{STEPS}
SELECT doc_id, n_lines, n_deleted, text AS clean_text FROM deduped
"""


@register("op1_linededup", SQL)
def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = without_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_deleted", F.col("text").alias("clean_text"))
