"""Ordered windows that survive one huge partition key.

A plain window sorts a whole key in one task. Here a key is cut into chunks of its order column, the
window runs per chunk, and what a chunk needs from the ones before it is carried over on a table
with one row per chunk. Both levels are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16


def _chunk(df: DataFrame, order: str, rows: int) -> Column:
    """Number of a row's chunk: spans of ``rows`` values of a dense order, of more if it is sparse, so that
    there are about as many chunks as the table has rows to fill them."""
    spread = (F.max(order) - F.min(order) + 1).cast("double") * rows / F.count(order)
    width = df.agg(F.greatest(F.lit(float(rows)), F.ceil(F.coalesce(spread, F.lit(0.0))).cast("double"))).scalar()
    return F.floor(F.col(order) / width).cast("long")


def forward_fill(
    df: DataFrame,
    value: str,
    order: str,
    out: str,
    by: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, in ``order`` (a whole number), per ``by``."""
    keys = [*by, "_chunk"]
    rows = df.withColumn("_chunk", _chunk(df, order, chunk_rows))
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_inside", F.last(value, ignorenulls=True).over(so_far))

    at_value = F.when(F.col(value).isNotNull(), F.col(order))
    ends = rows.groupBy(*keys).agg(F.max_by(value, at_value).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return (
        filled.join(carried, keys, "left")
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_chunk", "_inside", "_carried")
    )


def _last_of(items: Column, n: int) -> Column:
    return F.when(F.size(items) <= n, items).otherwise(F.slice(items, -n, n))


def preceding_rows(
    df: DataFrame,
    n: int,
    order: str,
    columns: Sequence[str],
    out: str,
    by: Sequence[str],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The up to ``n`` rows before each row, oldest first, as an array of structs.

    ``order`` is a whole number, unique within ``by``.
    """
    keys = [*by, "_chunk"]
    item = F.struct(order, *columns)
    rows = df.withColumn("_chunk", _chunk(df, order, chunk_rows))
    inside = Window.partitionBy(*keys).orderBy(order)
    near = rows.withColumn("_near", F.collect_list(item).over(inside.rowsBetween(-n, -1)))

    # The limit on the row number is applied before the shuffle: n rows per chunk and task move.
    latest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    ends = rows.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n)
    tails = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_tail"))
    # A chunk in the table holds one row at least, so n chunks back hold the last n rows.
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(-n, -1)
    earlier = tails.select(
        *keys, _last_of(F.flatten(F.collect_list("_tail").over(before)), n).alias("_earlier")
    )
    both = F.when(F.col("_earlier").isNull(), F.col("_near")).otherwise(F.concat("_earlier", "_near"))
    return (
        near.join(earlier.filter(F.size("_earlier") > 0), keys, "left")
        .withColumn(out, _last_of(both, n))
        .drop("_chunk", "_near", "_earlier")
    )
