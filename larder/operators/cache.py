"""Table jobs over a question cache:
(question_key, question_raw, sql, result_snapshot, response, hits, created_at, updated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import normalize_question

CACHE_SCHEMA = (
    "question_key string, question_raw string, sql string, result_snapshot string, response string, "
    "hits bigint, created_at timestamp_ntz, updated_at timestamp_ntz"
)


def with_key(df: DataFrame, question: str = "question") -> DataFrame:
    return df.withColumn("question_key", normalize_question(question))


def cache_lookup(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Each question with the cached SQL, result and response of its key, if any.

    ``cache`` has one row per key, so a question asked very often only needs its own rows split,
    which adaptive execution does.
    """
    entries = cache.select("question_key", "sql", "result_snapshot", "response")
    return questions.join(entries.withColumn("found", F.lit(True)), "question_key", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def fold_batch(batch: DataFrame, *more: Column) -> DataFrame:
    """What a batch of store calls (question_key, question, sql, result, response, at, seq) leaves per
    key: the last SQL and result, the last response that is not NULL, the first raw text.

    A key is folded by partial aggregates, however often it occurs.
    """
    when = F.struct("at", "seq")
    return batch.groupBy("question_key").agg(
        F.min_by("question", when).alias("question_raw"),
        F.max_by("sql", when).alias("sql"),
        F.max_by("result", when).alias("result_snapshot"),
        F.max_by("response", F.when(F.col("response").isNotNull(), when)).alias("response"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        *more,
    )


def cache_of(calls: DataFrame) -> DataFrame:
    """Cache that a first batch of calls leaves, each call counted as a hit: one aggregate, no join."""
    counted = fold_batch(calls, F.count("*").alias("hits"))
    return counted.select("question_key", "question_raw", "sql", "result_snapshot", "response", "hits", "created_at", "updated_at")


def cache_upsert(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """Cache after a batch: SQL, result and time replaced, a response only by a response; raw text,
    creation time and hits stay."""
    old, new = cache.alias("old"), fold_batch(batch).alias("new")
    both = old.join(new, "question_key", "full_outer")
    replaced = F.col("new.updated_at").isNotNull()

    def latest(c: str):
        return F.when(replaced, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    def kept(c: str):
        return F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c)

    return both.select(
        "question_key",
        kept("question_raw"),
        latest("sql"),
        latest("result_snapshot"),
        F.coalesce(F.col("new.response"), F.col("old.response")).alias("response"),
        F.coalesce(F.col("old.hits"), F.lit(0)).cast("long").alias("hits"),
        kept("created_at"),
        latest("updated_at"),
    )


def cache_hits(cache: DataFrame, reuses: DataFrame) -> DataFrame:
    """Hit counters raised by a table of reuses (question_key); unknown keys change nothing."""
    added = reuses.groupBy("question_key").agg(F.count("*").alias("_added"))
    rows = cache.join(added, "question_key", "left")
    return rows.withColumn("hits", F.col("hits") + F.coalesce("_added", F.lit(0))).drop("_added")


def valid_reuse(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Whether the cached response may stand for each fresh (question_key, sql, result): there is
    one, the SQL is the same, and its result has not changed."""
    old = cache.select("question_key", F.col("sql").alias("_sql"), "result_snapshot", "response")
    rows = fresh.join(old, "question_key", "left")
    valid = (
        F.col("response").isNotNull()
        & F.col("_sql").eqNullSafe(F.col("sql"))
        & F.col("result_snapshot").eqNullSafe(F.col("result"))
    )
    return rows.withColumn("reuse", valid).drop("_sql", "result_snapshot", "response")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits")
    )


def cache_eligible(turns: DataFrame, by: str = "conv_id", order: str = "turn", error: str = "error") -> DataFrame:
    """Only questions that stand alone and met no error may read or write the cache.

    The first turn of each thread stands alone; it is found by partial minima, without any history.
    """
    first = turns.groupBy(F.col(by).alias("_thread")).agg(F.min(order).alias("_first"))
    alone = turns.join(first, (F.col(by) == F.col("_thread")) & (F.col(order) == F.col("_first")), "left_semi")
    return alone.filter(F.col(error).isNull())
