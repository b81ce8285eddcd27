"""Items close to an anchor item in several measures at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.compose import cross_measures
from larder.operators.rank import ascending
from larder.operators.star import Star


def _close(pairs: Sequence[tuple[Column, Column]], tolerance: float) -> Column:
    return reduce(and_, [F.abs(a - b) < tolerance for a, b in pairs])


def anchor_values(star: Star, pattern: str, measures: Sequence[str]) -> Column:
    """Struct of the measures of the first item (by name) matching a pattern, as a scalar subquery."""
    first = star.item.filter(F.col("item_name_normalized").like(pattern))
    first = first.orderBy(ascending("item_name"), ascending("item_id")).limit(1)
    rows = star.fact.filter(F.col("item_id") == first.select("item_id").scalar())
    rows = rows.join(star.measure.filter(F.col("measure_name").isin(*measures)), "measure_id")
    cells = [F.max(F.when(F.col("measure_name") == m, F.col("value"))).alias(m) for m in measures]
    return rows.agg(F.struct(*cells).alias("anchor")).scalar()


def similar_to(
    star: Star, pattern: str, measures: Sequence[str], tolerance: float = 1.0, n: int | None = None
) -> DataFrame:
    """Items that differ from the anchor by less than ``tolerance`` in every measure, by name.

    A missing measure, of the item or the anchor, is no match.
    """
    anchor = anchor_values(star, pattern, measures)
    rows = cross_measures(star, measures)
    near = rows.filter(_close([(F.col(m), anchor.getField(m)) for m in measures], tolerance))
    ranked = near.orderBy(ascending("item_name"), ascending("item_id"))
    return ranked if n is None else ranked.limit(n)


def similar_to_anchors(
    wide: DataFrame, anchors: DataFrame, measures: Sequence[str], tolerance: float, n: int
) -> DataFrame:
    """The same for many anchors (anchor_id + measures): per anchor the first ``n`` similar items.

    Values fall into cells a little wider than the tolerance, so a match lies in the anchor's cell or
    one next to it and cells join by equality. Items with the very same values are one candidate: of
    these only the first ``n`` by name can be among the results, so a value shared by very many
    items costs no more than a rare one.
    """
    width = tolerance * (1 + 1e-6)
    cells = [f"_cell_{i}" for i in range(len(measures))]
    cell_of = [F.floor(F.col(m) / width).cast("long") for m in measures]

    same = Window.partitionBy(*measures).orderBy(ascending("item_name"), ascending("item_id"))
    first = wide.dropna(subset=list(measures)).withColumn("_place", F.row_number().over(same))
    items = first.filter(F.col("_place") <= n).drop("_place")
    items = items.select("item_id", "item_name", *measures, *[c.alias(x) for c, x in zip(cell_of, cells, strict=True)])

    points = anchors.select(*measures).dropna().distinct()
    for c, x in zip(cell_of, cells, strict=True):
        points = points.withColumn(x, F.explode(F.sequence(c - 1, c + 1)))
    points = points.withColumnsRenamed({m: f"_at_{m}" for m in measures})

    near = points.join(items, cells).filter(
        _close([(F.col(m), F.col(f"_at_{m}")) for m in measures], tolerance)
    )
    by_point = Window.partitionBy(*[f"_at_{m}" for m in measures]).orderBy(
        ascending("item_name"), ascending("item_id")
    )
    found = near.withColumn("place", F.row_number().over(by_point)).filter(F.col("place") <= n)
    found = found.select(
        "item_id", "item_name", F.col("place").cast("long").alias("place"),
        *[F.col(f"_at_{m}").alias(m) for m in measures],
    )
    return anchors.select("anchor_id", *measures).join(found, list(measures)).select(
        "anchor_id", "item_id", "item_name", "place"
    )
