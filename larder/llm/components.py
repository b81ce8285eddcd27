"""Connected components of links between whole numbers, by rounds of star contractions.

In a round every node passes the smallest node it knows to its larger neighbours, then to its smaller
ones. Links become stars around the smallest node of a component; rounds grow with the logarithm of its
size. A node with very many links is aggregated before the shuffle, and the join that follows has one row
per node on one side, so adaptive execution can split the hot node on the other.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import new_path


def _kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dropped(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _release() -> None:
    """Give a worker's free memory back, since workers are kept while the JVM joins what they made."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("n"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the smallest node of its component."""
    links = _kept(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        sign = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        large = _large_star(links).where("a <> b").distinct()
        links = _kept(_small_star(large).where("a <> b").distinct(), "links")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()
