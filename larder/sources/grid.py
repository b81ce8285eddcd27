"""Headerless sheets as all-text grids that know their row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_MASK = (1 << 33) - 1
#: Files are taken to be smaller than 2**42 bytes.
_FILE_BITS = 42


def read_grid(spark: SparkSession, path: str, n_columns: int) -> DataFrame:
    """CSV export of one sheet as (row_idx, c0 .. cn), empty cells NULL, nothing trimmed.

    row_idx is the byte at which the row's split starts plus the row's number in the task. A row takes
    at least one byte, so numbers of one split stay below the start of the next: the order of the file.
    An export in several files is numbered in the order of their names, each file after the one before.
    """
    cells = [f"c{i}" for i in range(n_columns)]
    rows = spark.read.csv(path, header=False, schema=", ".join(f"{c} string" for c in cells))
    start = F.col("_metadata.file_block_start")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK))
    files = sorted(rows.inputFiles())
    if len(files) > 1:
        place = F.array_position(F.array(*[F.lit(f) for f in files]), F.input_file_name()) - 1
        start = start + F.shiftleft(place.cast("long"), _FILE_BITS)
    return rows.select((start + inside).alias("row_idx"), *cells)
