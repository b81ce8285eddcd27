"""Data-quality tests. Each gives rows (table_name, check, column_name, failures)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _result(df: DataFrame, table: str, check: str, column: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check"),
        F.lit(column).alias("column_name"),
        F.col("failures").cast("long").alias("failures"),
    )


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "column_name", "failures")
    return long.select(F.lit(table).alias("table_name"), F.lit("not_null").alias("check"), "column_name", "failures")


def unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; keys with a NULL are left to ``not_null``."""
    # Texts are compared by digest, so that no text is shuffled.
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    filled = df.select(*columns).dropna(how="any")
    keys = filled.select(*[F.unhex(F.sha2(c, 256)).alias(c) if c in texts else F.col(c) for c in columns])
    repeated = keys.groupBy(*columns).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return _result(repeated.agg(F.count("*").alias("failures")), table, "unique", ",".join(columns))


def relationships(child: DataFrame, table: str, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose foreign key has no parent. Rows are counted per key before the join."""
    keys = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n"))
    known = parent.select(F.col(pk).alias("_pk"))
    orphans = keys.join(known, F.col(fk) == F.col("_pk"), "left_anti")
    failures = F.coalesce(F.sum("n"), F.lit(0)).alias("failures")
    return _result(orphans.agg(failures), table, "relationships", fk)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and NULLs per column, in one pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    counts = df.agg(F.count("*").alias("n_rows"), *nulls)
    return counts.unpivot(["n_rows"], list(columns), "column_name", "n_nulls")


def sample_head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """First rows by an order column."""
    return df.orderBy(F.col(order).asc_nulls_last()).limit(n)
