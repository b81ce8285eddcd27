"""Search by trigrams: an index of the three-character pieces of texts answers LIKE patterns without reading all texts.

`<folder>/grams` holds (gram, id) in parts by the gram and sorted by it, so a gram is found in the row groups of one
part; `<folder>/texts` holds (id, text) in parts by the id. A pattern is reduced to the trigrams of its fixed runs, which
each match holds; the ids that hold the rarest of them are the candidates, and LIKE itself decides on those. A pattern
without three fixed characters in a row is looked for in all texts. Texts of fewer than three characters have no grams
and match no pattern that has some; a null text matches nothing. Characters are code points, and case counts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.tables import write_table

#: Parts of either table; the most trigrams of a pattern that are looked up.
PARTS, MOST = 64, 4


def trigrams(text: str) -> Column:
    """Distinct pieces of three characters of a column, none for shorter texts."""
    # Each match takes one code point and looks two ahead; functions over an array of characters would be interpreted.
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("(?s)(?=(...))."), F.lit(1)))


def required(pattern: str) -> list[str]:
    """Trigrams that every match of a LIKE pattern holds; a backslash makes the next character a fixed one."""
    runs, run, chars = [], "", iter(pattern)
    for c in chars:
        if c == "\\":
            run += next(chars, "")
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
    return sorted({r[i : i + 3] for r in (*runs, run) for i in range(len(r) - 2)})


def _part(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(PARTS)).cast("int")


def build(texts: DataFrame, folder: str, key: str, text: str) -> None:
    """Write the index of the texts of a table."""
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text"))
    write_table(rows.limit(0), f"{folder}/columns")  # an empty table has no other files
    write_table(rows.withColumn("part", _part(F.col("id"))), f"{folder}/texts", ["part"])
    grams = rows.select("id", F.explode(trigrams("text")).alias("gram")).withColumn("part", _part(F.col("gram")))
    # Rebalancing splits the part of a gram that most texts hold.
    grams = grams.hint("rebalance", "part").sortWithinPartitions("part", "gram", "id")
    grams.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/grams")


def _read(spark: SparkSession, folder: str, table: str, column: str) -> DataFrame:
    kind = spark.read.parquet(f"{folder}/columns").schema["id"].dataType.simpleString()
    return spark.read.schema(f"id {kind}, {column} string, part int").parquet(f"{folder}/{table}")


def _postings(spark: SparkSession, folder: str, grams: list[str]) -> DataFrame:
    """Rows of some grams; their parts are constants, so other parts are not listed for the scan."""
    either = reduce(or_, [(F.col("part") == _part(F.lit(g))) & (F.col("gram") == g) for g in grams])
    return _read(spark, folder, "grams", "gram").where(either).select("gram", "id")


def candidates(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """The ids of all texts that hold the rarest trigrams of a pattern; None if it has no trigram."""
    grams = required(pattern)
    if not grams:
        return None
    # At most one row for each character of the pattern.
    held = {r.gram: r["count"] for r in _postings(spark, folder, grams).groupBy("gram").count().collect()}
    rarest = sorted(grams, key=lambda g: (held.get(g, 0), g))[:MOST]
    bit = reduce(lambda other, i: F.when(F.col("gram") == rarest[i], F.lit(1 << i)).otherwise(other), range(len(rarest)), F.lit(0))
    found = _postings(spark, folder, rarest).groupBy("id").agg(F.bit_or(bit).alias("bits"))
    return found.where(F.col("bits") == (1 << len(rarest)) - 1).select("id")


def search(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(id, text) of the rows of the indexed table whose text is LIKE the pattern."""
    texts = _read(spark, folder, "texts", "text")
    ids = candidates(spark, folder, pattern)
    if ids is not None:
        # At most PARTS numbers.
        parts = [r.part for r in ids.select(_part(F.col("id")).alias("part")).distinct().collect()]
        texts = texts.where(F.col("part").isin(parts) if parts else F.lit(False))
        texts = texts.join(ids.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return texts.where(F.col("text").like(pattern)).select("id", "text")
