"""Totals per group and measures composed of several components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import exact_mean, exact_sum
from larder.operators.rank import ascending, descending
from larder.operators.reshape import pivot_measures
from larder.operators.star import Star, star_rows


def _per_group(star: Star, measure: str, aggregate, out: str) -> DataFrame:
    """Aggregate on the group key; labels are joined to the few results."""
    rows = star_rows(star, [measure]).groupBy("group_id").agg(aggregate.alias(out))
    named = rows.join(star.group.select("group_id", "group_name"), "group_id")
    return named.select("group_name", out).orderBy(descending(out), ascending("group_name"))


def total_by_group(star: Star, measure: str, n: int | None = None, scale: int | None = None) -> DataFrame:
    """Sum per group, all groups ranked; ``n=1`` is the accepted short answer."""
    totals = _per_group(star, measure, exact_sum("value", scale), "total")
    return totals if n is None else totals.limit(n)


def mean_by_group(star: Star, measure: str, scale: int | None = None) -> DataFrame:
    """Mean per group: another reading of the same question."""
    return _per_group(star, measure, exact_mean("value", scale), "mean")


def _items(star: Star, groups: Sequence[str] | None, with_group: bool) -> DataFrame:
    items = star.item.select("item_id", "item_name", "group_id")
    if groups is None and not with_group:
        return items.drop("group_id")
    labels = star.group.select("group_id", "group_name")
    if groups is not None:
        labels = labels.filter(F.col("group_name").isin(*groups))
    return items.join(labels, "group_id").drop("group_id")


def _measured(star: Star, measures: Sequence[str]) -> DataFrame:
    wanted = star.measure.filter(F.col("measure_name").isin(*measures))
    return star.fact.join(wanted.select("measure_id", "measure_name"), "measure_id")


def composite(
    star: Star,
    measures: Sequence[str],
    n: int | None = 10,
    groups: Sequence[str] | None = None,
    with_group: bool = False,
    measured_only: bool = False,
    by_name: bool = False,
    scale: int | None = None,
) -> DataFrame:
    """Sum of the components of each item, skipping NULLs: an item with one component counts.

    Items without any measured component get NULL and sort last, or drop out with ``measured_only``.
    ``by_name`` merges items of the same name.
    """
    rows = _measured(star, measures)
    if measured_only:
        rows = rows.filter(F.col("value").isNotNull())
    sums = rows.groupBy("item_id").agg(exact_sum("value", scale).alias("total"))
    totals = sums.join(_items(star, groups, with_group), "item_id")
    shown = [c for c in ("item_name", "group_name") if c in totals.columns]
    if by_name:
        totals = totals.groupBy(*shown).agg(exact_sum("total", scale).alias("total"))
        order = [descending("total"), ascending("item_name")]
    else:
        shown = ["item_id", *shown]
        order = [descending("total"), ascending("item_name"), ascending("item_id")]
    ranked = totals.select(*shown, "total").orderBy(*order)
    return ranked if n is None else ranked.limit(n)


def composite_strict(star: Star, measures: Sequence[str], scale: int | None = None) -> DataFrame:
    """a + b + c, NULL as soon as one component is: the reading ``composite`` exists to avoid."""
    wide = pivot_measures(_measured(star, measures), ["item_id"], measures)
    cells = [F.col(m) if scale is None else F.col(m).cast(f"decimal(18,{scale})") for m in measures]
    total = reduce(add, cells).cast("double").alias("total")
    return wide.join(_items(star, None, False), "item_id").select("item_id", "item_name", total)


def cross_measures(
    star: Star,
    measures: Sequence[str],
    groups: Sequence[str] | None = None,
    with_group: bool = False,
) -> DataFrame:
    """Items with all the listed measures, one column each: a self-join of the fact done in one pass."""
    wide = pivot_measures(_measured(star, measures), ["item_id"], measures).dropna(subset=list(measures))
    rows = wide.join(_items(star, groups, with_group), "item_id")
    shown = [c for c in ("item_id", "item_name", "group_name") if c in rows.columns]
    return rows.select(*shown, *measures)
