"""Tables on shared storage, reference results and the catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from larder.operators.star import literal_table


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table: writing twice leaves the same as writing once."""
    if partition_by:
        # Rebalancing gathers a partition value in few files and still splits a value that is too big.
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_references(results: Mapping[str, DataFrame], folder: str) -> None:
    """One reference result per name: '<id>' is the main one, '<id>_alt<i>' further right answers."""
    for name, df in results.items():
        write_table(df, f"{folder}/{name}.parquet")


def read_references(spark: SparkSession, folder: str, question: str) -> list[tuple[str, DataFrame]]:
    """Main and alternative references of a question; empty when there are none."""
    path = f"{folder}/{question}.parquet"
    found = _read_if_there(spark, path)
    references = [] if found is None else [(question, found)]
    i = 0
    while (alternative := _read_if_there(spark, f"{folder}/{question}_alt{i}.parquet")) is not None:
        references.append((f"{question}_alt{i}", alternative))
        i += 1
    return references


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def catalog_of(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """{table: columns} of given tables, lower case."""
    return {t.lower(): [c.lower() for c in df.columns] for t, df in tables.items()}


def session_catalog(spark: SparkSession) -> dict[str, list[str]]:
    """{table: columns} of all tables and views the session knows."""
    return catalog_of({t.name: spark.table(t.name) for t in spark.catalog.listTables()})


def catalog_table(spark: SparkSession, catalog: Mapping[str, Sequence[str]]) -> DataFrame:
    """Catalog as rows (table_name, column_name)."""
    rows = [(t, c) for t, columns in catalog.items() for c in columns]
    return literal_table(spark, ["table_name", "column_name"], rows)
