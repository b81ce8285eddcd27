"""Is there enough data behind an answer?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import MISSING, PRESENT, ZERO, ratio, value_state
from larder.operators.star import Star

MIN_RANKING_ROWS = 3
SUFFICIENT, INSUFFICIENT = "sufficient", "insufficient"


def null_aware_anti(df: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """``key NOT IN (listed)`` with its NULL rules: a NULL in the list empties the result, and a NULL
    key is kept only when the list is empty.

    The list is made distinct before the join, so one value listed very often is one row in it.
    """
    values = listed.select(F.col(listed_key).alias("_listed"))
    has_null = F.coalesce(F.bool_or(F.col("_listed").isNull()), F.lit(False))
    state = values.agg(F.struct(has_null.alias("has_null"), (F.count("*") == 0).alias("is_empty"))).scalar()
    known = values.filter(F.col("_listed").isNotNull()).distinct()
    rest = df.join(known, F.col(key) == F.col("_listed"), "left_anti")
    return rest.filter(~state.getField("has_null") & (F.col(key).isNotNull() | state.getField("is_empty")))


def items_without(star: Star, measure: str) -> DataFrame:
    """Items with no measured amount above zero of the measure."""
    wanted = star.measure.filter(F.col("measure_name") == measure).select("measure_id")
    having = star.fact.filter(F.col("value") > 0).join(wanted, "measure_id", "left_semi")
    items = star.item.select("item_id", "item_name")
    return null_aware_anti(items, "item_id", having, "item_id")


def count_without(star: Star, measure: str) -> DataFrame:
    return items_without(star, measure).agg(F.count_distinct("item_id").alias("items_without"))


def guard(result: DataFrame, min_rows: int = MIN_RANKING_ROWS) -> DataFrame:
    """One row: whether a ranking has rows enough to be shown."""
    n = F.count("*")
    status = F.when(n < min_rows, INSUFFICIENT).otherwise(SUFFICIENT)
    return result.agg(status.alias("status"), n.alias("n_rows"))


def coverage_profile(star: Star) -> DataFrame:
    """Per catalog measure how many items are present, zero, missing or have no row at all.

    A measure without data shows zeros instead of vanishing.
    """
    states = star.fact.withColumn("_state", value_state("value"))
    stats = states.groupBy("measure_id").agg(
        *[F.count_if(F.col("_state") == s).alias(s) for s in (PRESENT, ZERO, MISSING)],
        F.count_distinct("item_id").alias("_items"),
    )
    n_items = star.item.agg(F.count_distinct("item_id")).scalar()
    rows = star.measure.join(stats, "measure_id", "left").withColumn("n_items", n_items)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("present", "zero", "missing")]
    return rows.select(
        "measure_name", *counts, (F.col("n_items") - F.coalesce("_items", F.lit(0))).alias("absent")
    )


def coverage_guard(star: Star, min_ratio: float) -> DataFrame:
    """Per measure the share of items with a value, and whether rankings on it may be trusted."""
    measured = star.fact.filter(F.col("value").isNotNull()).groupBy("measure_id")
    counts = measured.agg(F.count_distinct("item_id").alias("_items"))
    n_items = star.item.agg(F.count_distinct("item_id")).scalar()
    share = ratio(F.coalesce("_items", F.lit(0)), F.col("n_items"))
    rows = star.measure.join(counts, "measure_id", "left").withColumn("n_items", n_items)
    return rows.select(
        "measure_name",
        share.alias("coverage"),
        F.when(share < min_ratio, INSUFFICIENT).otherwise(SUFFICIENT).alias("status"),
    )


def unused_measures(star: Star) -> DataFrame:
    """Catalog measures for which no sheet has a row."""
    return star.measure.join(star.fact.select("measure_id").distinct(), "measure_id", "left_anti").select(
        "measure_id", "measure_name"
    )
