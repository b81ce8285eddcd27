"""The operators bound to the given tables.

Two stars are derived from them. Parts: item = part, group = p_type, one sheet from ``part`` and one
from ``lineitem``. Documents: item = document, group = language, one sheet from ``documents`` and a
thin one from ``labels``, where a label of 0 is not the same as no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.reshape import to_long
from larder.operators.star import Star, build_fact, group_dim, item_dim, measure_dim
from larder.plans.food import write_gold
from larder.session import new_path
from larder.sources.snapshots import state_of_files
from larder.sources.tables import read_table

SCALE = 4
SOURCE = "warehouse"

PART_MEASURES = [
    (1, "p_size", "units", "part"),
    (2, "p_retailprice", "money", "part"),
    (3, "qty_total", "units", "lines"),
    (4, "discount_min", "ratio", "lines"),
    (5, "tax_max", "ratio", "lines"),
    (6, "bulk_return_price", "money", "lines"),
    (7, "p_weight", "kg", "part"),
]
PART_SHEETS = [["p_size", "p_retailprice"], ["qty_total", "discount_min", "tax_max", "bulk_return_price"]]

DOC_MEASURES = [
    (1, "n_chars", "chars", "text"),
    (2, "quality", "flag", "label"),
    (3, "toxic", "flag", "label"),
    (4, "readability", "score", "text"),
]
DOC_SHEETS = [["n_chars"], ["quality", "toxic"]]

IDS = ["item_id", "item_name", "item_group"]


def line_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of a part over its order lines; most parts have no bulk return."""
    bulk_return = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)
    return (
        read_table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("item_id"))
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty_total"),
            F.min("l_discount").alias("discount_min"),
            F.max("l_tax").alias("tax_max"),
            F.max(F.when(bulk_return, F.col("l_extendedprice"))).alias("bulk_return_price"),
        )
    )


def part_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("item_group"),
        "p_size",
        "p_retailprice",
    )


def part_longs(spark: SparkSession, sf: str) -> list[DataFrame]:
    first = to_long(part_sheet(spark, sf), IDS, PART_SHEETS[0])
    return [first, to_long(line_measures(spark, sf), ["item_id"], PART_SHEETS[1])]


def doc_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("item_name"),
        F.col("lang").alias("item_group"),
        "n_chars",
    )


def doc_longs(spark: SparkSession, sf: str) -> list[DataFrame]:
    labels = read_table(spark, sf, "labels").withColumnRenamed("doc_id", "item_id")
    return [to_long(doc_sheet(spark, sf), IDS, DOC_SHEETS[0]), to_long(labels, ["item_id"], DOC_SHEETS[1])]


def _star(spark: SparkSession, longs: list[DataFrame], catalog) -> Star:
    groups = group_dim(longs[0], SOURCE)
    measures = measure_dim(spark, catalog)
    return Star(groups, item_dim(longs[0], groups, SOURCE), measures, build_fact(longs, measures))


_gold: dict[tuple, Star] = {}


def _versions(spark: SparkSession, sf: str, tables: tuple[str, ...]) -> tuple:
    """State of the tables' files, from their listing."""
    return tuple(state_of_files(spark, f"{sf.rstrip('/')}/{table}.parquet") for table in tables)


def _gold_once(spark: SparkSession, sf: str, name: str, longs, catalog, tables: tuple[str, ...]) -> Star:
    """Gold tables are built once per application and state of their tables, then queried, as in any warehouse."""
    key = (spark.sparkContext.applicationId, sf, name, _versions(spark, sf, tables))
    if key not in _gold:
        _gold[key] = write_gold(_star(spark, longs(spark, sf), catalog), new_path(spark, f"gold-{name}"))
    return _gold[key]


def build_parts(spark: SparkSession, sf: str) -> Star:
    return _star(spark, part_longs(spark, sf), PART_MEASURES)


def build_docs(spark: SparkSession, sf: str) -> Star:
    return _star(spark, doc_longs(spark, sf), DOC_MEASURES)


def parts(spark: SparkSession, sf: str) -> Star:
    return _gold_once(spark, sf, "parts", part_longs, PART_MEASURES, ("part", "lineitem"))


def docs(spark: SparkSession, sf: str) -> Star:
    return _gold_once(spark, sf, "docs", doc_longs, DOC_MEASURES, ("documents", "labels"))


# The same stars for the SQL oracle, as WITH parts.


def _catalog_sql(rows) -> str:
    return ", ".join(f"({i}, '{n}', '{u}', '{c}')" for i, n, u, c in rows)


_DIMENSIONS = """
grp AS (SELECT row_number() OVER (ORDER BY group_name) AS group_id, group_name
        FROM (SELECT DISTINCT item_group AS group_name FROM sheet)),
item AS (SELECT DISTINCT item_id, item_name, strip_accents(lower(item_name)) AS item_name_normalized,
                group_id, group_name
         FROM sheet JOIN grp ON item_group = group_name),
star AS (SELECT item_id, item_name, item_name_normalized, group_id, group_name, measure_id, measure_name,
                value, unit
         FROM fact JOIN measure USING (measure_name) JOIN item USING (item_id))
"""

PARTS_SQL = f"""
sheet AS (SELECT p_partkey AS item_id, p_name AS item_name, p_type AS item_group FROM part),
lines AS (SELECT l_partkey AS item_id,
                 CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty_total,
                 MIN(l_discount) AS discount_min, MAX(l_tax) AS tax_max,
                 MAX(CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN l_extendedprice END)
                   AS bulk_return_price
          FROM lineitem GROUP BY l_partkey),
fact AS (SELECT p_partkey AS item_id, 'p_size' AS measure_name, CAST(p_size AS DOUBLE) AS value FROM part
         UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part
         UNION ALL SELECT item_id, 'qty_total', qty_total FROM lines
         UNION ALL SELECT item_id, 'discount_min', discount_min FROM lines
         UNION ALL SELECT item_id, 'tax_max', tax_max FROM lines
         UNION ALL SELECT item_id, 'bulk_return_price', bulk_return_price FROM lines),
measure AS (SELECT * FROM (VALUES {_catalog_sql(PART_MEASURES)})
            AS t(measure_id, measure_name, unit, category)),
{_DIMENSIONS}
"""

DOCS_SQL = f"""
sheet AS (SELECT doc_id AS item_id, source AS item_name, lang AS item_group FROM documents),
fact AS (SELECT doc_id AS item_id, 'n_chars' AS measure_name, CAST(n_chars AS DOUBLE) AS value FROM documents
         UNION ALL SELECT doc_id, 'quality', CAST(quality AS DOUBLE) FROM labels
         UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels),
measure AS (SELECT * FROM (VALUES {_catalog_sql(DOC_MEASURES)})
            AS t(measure_id, measure_name, unit, category)),
{_DIMENSIONS}
"""
