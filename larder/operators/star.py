"""Star schema: group, item and measure dimensions around one fact per item and measure."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.text import strip_accents_lower
from larder.session import cut_lineage

_ROW_BITS = 33


@dataclass(frozen=True)
class Star:
    """group(group_id, group_name, group_name_normalized, source)
    item(item_id, item_name, item_name_normalized, group_id, source)
    measure(measure_id, measure_name, unit, category)
    fact(item_id, measure_id, value, is_missing)"""

    group: DataFrame
    item: DataFrame
    measure: DataFrame
    fact: DataFrame


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """Small constant table. As VALUES its size is known to the planner."""

    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(text(x) for x in v) + ")"
        return repr(v)

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def dense_key(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """1, 2, 3, ... in the order of ``by``, NULLs last, without one task seeing all rows.

    Rows are range-partitioned and sorted, numbered inside their partition, and written to shared
    storage so that the partitions stay what they are. Only the partition sizes are summed up.
    """
    order = [F.col(c).asc_nulls_last() for c in by]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(out, (F.col("_start") + inside + 1).cast("long"))
        .drop("_part", "_start", "_at")
    )


def group_dim(longs: DataFrame, source: str, group: str = "item_group") -> DataFrame:
    """Distinct groups, numbered by name."""
    names = longs.select(F.col(group).alias("group_name")).distinct()
    return dense_key(names, ["group_name"], "group_id").select(
        "group_id",
        "group_name",
        strip_accents_lower("group_name").alias("group_name_normalized"),
        F.lit(source).alias("source"),
    )


def item_dim(longs: DataFrame, groups: DataFrame, source: str, group: str = "item_group") -> DataFrame:
    """Distinct items with the key of their group. Items whose group is unknown drop out."""
    items = longs.select("item_id", "item_name", F.col(group).alias("group_name")).distinct()
    return items.join(groups.select("group_name", "group_id"), "group_name").select(
        "item_id",
        "item_name",
        strip_accents_lower("item_name").alias("item_name_normalized"),
        "group_id",
        F.lit(source).alias("source"),
    )


def measure_dim(spark: SparkSession, rows: Iterable[Sequence]) -> DataFrame:
    """Catalog of (id, name, unit, category)."""
    return literal_table(spark, ["measure_id", "measure_name", "unit", "category"], rows)


def build_fact(longs: Sequence[DataFrame], measures: DataFrame) -> DataFrame:
    """Long tables conformed to the catalog, distinct within each, put together with UNION ALL.

    Measures missing from the catalog drop out. The key replaces the name before the distinct, so
    that narrow rows are shuffled.
    """
    facts = None
    for long in longs:
        rows = long.join(measures.select("measure_name", "measure_id"), "measure_name")
        part = rows.select("item_id", "measure_id", "value").distinct()
        facts = part if facts is None else facts.unionByName(part)
    return facts.withColumn("is_missing", F.col("value").isNull())


def like_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """One bracketed OR of LIKE patterns."""
    c = F.col(c) if isinstance(c, str) else c
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | c.like(pattern)
    return hit


def star_rows(
    star: Star,
    measures: Sequence[str],
    groups: Sequence[str] | None = None,
    group_patterns: Sequence[str] | None = None,
    with_group: bool = False,
) -> DataFrame:
    """Fact joined to its dimensions, for the named measures and (by name or pattern) groups.

    Which side is broadcast is left to the planner, which checks sizes and falls back to a shuffle.
    """
    wanted = star.measure.filter(F.col("measure_name").isin(*measures))
    items = star.item.drop("source")
    if with_group or groups is not None or group_patterns is not None:
        chosen = star.group.drop("source")
        if groups is not None:
            chosen = chosen.filter(F.col("group_name").isin(*groups))
        if group_patterns is not None:
            chosen = chosen.filter(like_any("group_name_normalized", group_patterns))
        items = items.join(chosen, "group_id")
    return star.fact.join(wanted, "measure_id").join(items, "item_id")


def register_views(star: Star, names: dict[str, tuple[str, dict[str, str]]]) -> None:
    """Temp views of the four tables; ``names`` gives per part the view name and column renames."""
    for part, (view, columns) in names.items():
        getattr(star, part).withColumnsRenamed(columns).createOrReplaceTempView(view)
