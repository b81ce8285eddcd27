"""From a headerless grid of text cells to typed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import SENTINELS, is_number, sentinel_number, to_key
from larder.functions.text import BLANKS
from larder.operators.chunked import CHUNK_ROWS, forward_fill

# First cells of header rows; an empty first cell counts as a header too.
HEADER_CELLS = ["Número do", "Alimento", "nan", "Descrição dos alimentos"]


def select_positional(df: DataFrame, names: Mapping[int, str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns by position under new names; positions left out (repeated headers) vanish."""
    return df.select(*keep, *[F.col(f"c{i}").alias(name) for i, name in names.items()])


def filter_data_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key cell is a number."""
    return df.filter(is_number(key))


def clean_sentinels(
    df: DataFrame, columns: Sequence[str], marks: Mapping[str, float | None] = SENTINELS
) -> DataFrame:
    """Measure cells as doubles: marks mapped, other text NULL."""
    return df.withColumns({c: sentinel_number(c, marks) for c in columns})


def separator_label(key: str, name: str, headers: Sequence[str] = HEADER_CELLS) -> Column:
    """Label held by a group-separator row: text key that is no header, and no name."""
    # The name is looked at first: it tells data rows apart without matching their text.
    label = F.btrim(F.col(key), F.lit(BLANKS))
    is_separator = F.col(name).isNull() & ~is_number(key) & ~label.isin(*headers)
    return F.when(is_separator, label)


def carry_forward_group(
    df: DataFrame,
    key: str = "c0",
    name: str = "c1",
    order: str = "row_idx",
    out: str = "item_group",
    by: Sequence[str] = (),
    headers: Sequence[str] = HEADER_CELLS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every row gets the label of the last separator row above it (NULL before the first)."""
    marked = df.withColumn("_label", separator_label(key, name, headers))
    return forward_fill(marked, "_label", order, out, by, chunk_rows).drop("_label")


def group_by_key(df: DataFrame, key: str, group: str, order: str = "row_idx") -> DataFrame:
    """One group per key; a repeated key takes the group of its last row."""
    return df.groupBy(key).agg(F.max_by(group, order).alias(group))


def attach_group(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Key to group lookup; keys without a group keep NULL."""
    return df.join(groups, key, "left")


def groups_in_order(df: DataFrame, group: str, order: str = "row_idx") -> DataFrame:
    """Distinct groups by first appearance."""
    seen = df.groupBy(group).agg(F.min(order).alias("first_seen"))
    return seen.orderBy("first_seen")


def sheet_to_table(
    grid: DataFrame,
    names: Mapping[int, str],
    key: str,
    name: str,
    group: str = "item_group",
    order: str = "row_idx",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The whole clean-up of one sheet: groups carried forward, data rows kept, cells typed.

    Groups are carried on key and label alone; the wide rows are not moved for it.
    """
    measures = [n for n in names.values() if n not in (key, name)]
    labelled = carry_forward_group(grid.select(order, "c0", "c1"), order=order, out=group, chunk_rows=chunk_rows)
    keyed = filter_data_rows(labelled, "c0").select(order, to_key("c0").alias(key), group)
    rows = select_positional(filter_data_rows(grid, "c0"), names).withColumn(key, to_key(key))
    table = clean_sentinels(rows, measures)
    return attach_group(table, group_by_key(keyed, key, group, order), key).select(key, name, group, *measures)
