"""Rankings, lookups and winners over a star. NULL always sorts last and ties break by name and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.star import Star, star_rows

OPEN_RANKING_ROWS = 10
RESULT_CAP = 50


def descending(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def ascending(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def _by_name() -> list[Column]:
    return [ascending("item_name"), ascending("item_id")]


def lookup(
    star: Star, measure: str, pattern: str, any_case: bool = False, by_value: bool = False
) -> DataFrame:
    """All items matching a pattern. Normally the accent-free name is matched; ``any_case`` matches
    the shown name, ignoring case but not accents."""
    rows = star_rows(star, [measure])
    if any_case:
        rows = rows.filter(F.col("item_name").ilike(pattern))
    else:
        rows = rows.filter(F.col("item_name_normalized").like(pattern))
    order = [descending("value"), *_by_name()] if by_value else _by_name()
    return rows.select("item_id", "item_name", "value", "unit").orderBy(*order)


def rank_items(
    star: Star,
    measure: str,
    n: int | None = OPEN_RANKING_ROWS,
    inverse: bool = False,
    groups: Sequence[str] | None = None,
    group_patterns: Sequence[str] | None = None,
) -> DataFrame:
    """Highest measured values first; ``inverse`` gives the lowest values above zero."""
    grouped = groups is not None or group_patterns is not None
    rows = star_rows(star, [measure], groups, group_patterns).filter(F.col("value").isNotNull())
    if inverse:
        rows = rows.filter(F.col("value") > 0)
    shown = ["item_id", "item_name", *(["group_name"] if grouped else []), "value", "unit"]
    first = ascending("value") if inverse else descending("value")
    ranked = rows.select(*shown).orderBy(first, *_by_name())
    return ranked if n is None else ranked.limit(n)


def compare_groups(star: Star, measure: str, groups: Sequence[str]) -> DataFrame:
    """All measured items of the named groups, side by side: a closed set, so no limit."""
    return rank_items(star, measure, None, groups=groups)


def top_per_group(star: Star, measure: str, ties: bool = True) -> DataFrame:
    """Winner of each group. With ties every item at the top value, else the first by name.

    Ties may be many rows of one group, so they are found by joining the group maxima (partial
    aggregates) back instead of ranking a group in one task.
    """
    rows = star_rows(star, [measure]).filter(F.col("value").isNotNull())
    rows = rows.select("item_id", "item_name", "group_id", "value")
    if ties:
        best = rows.groupBy("group_id").agg(F.max("value").alias("value"))
        winners = rows.join(best, ["group_id", "value"])
    else:
        order = Window.partitionBy("group_id").orderBy(descending("value"), *_by_name())
        winners = rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    named = winners.join(star.group.select("group_id", "group_name"), "group_id")
    return named.select("item_id", "item_name", "group_name", "value").orderBy(
        descending("value"), *_by_name()
    )


def top_k(star: Star, measure: str, k: int) -> DataFrame:
    """The k highest values with their row number."""
    best = rank_items(star, measure, k)
    order = Window.orderBy(descending("value"), *_by_name())
    return best.withColumn("row_num", F.row_number().over(order).cast("long"))


def rank_by(df: DataFrame, order: Sequence[tuple[str | Column, bool]], n: int | None = None) -> DataFrame:
    """Several sort keys of mixed direction; each is (column or expression, descending)."""
    columns = [F.col(c) if isinstance(c, str) else c for c, _ in order]
    keys = [
        c.desc_nulls_last() if down else c.asc_nulls_last()
        for c, (_, down) in zip(columns, order, strict=True)
    ]
    ranked = df.orderBy(*keys)
    return ranked if n is None else ranked.limit(n)


def result_cap(df: DataFrame, order: Sequence[Column], n: int = RESULT_CAP) -> DataFrame:
    """First ``n`` rows plus, on each, how many there are in all."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total_rows", total)
