"""A question cache in hash buckets: a batch adds small files, readers merge them, compaction rewrites what was touched.

Rows of a bucket lie in folders `<path>/data/<unique name>/bucket=<b>`; the newest manifest names the folders of each
bucket and the last batch. A batch writes one folder for each bucket that it touches and reads nothing; a bucket of one
folder is read as it is, one of several folders is merged by key in one aggregate. A batch that dies before its manifest
leaves the former state, a batch that is sent again counts once, and running queries keep their files. Readers may
come at any time; of two writers at a time the second gets an error.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators.cache import CACHE_SCHEMA, cache_lookup, fold_batch
from larder.sources.snapshots import claim, deleted, listed, newest_number, whole_manifests
from larder.sources.tables import write_table

#: The columns of a cache and the number of the batch that a row comes from.
ROW = f"{CACHE_SCHEMA}, batch bigint"


@dataclass(frozen=True)
class State:
    number: int
    buckets: int
    last_batch: int
    folders: dict[int, tuple[str, ...]]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _published(spark: SparkSession, path: str, state: State) -> State:
    body = {"buckets": state.buckets, "last_batch": state.last_batch, "folders": {str(b): f for b, f in state.folders.items()}}
    if not claim(spark, path, state.number, json.dumps(body)):
        raise RuntimeError(f"another writer has changed the cache at {path}")
    return state


def create(spark: SparkSession, path: str, buckets: int = 256) -> State:
    """An empty cache. A bucket should hold what one task can merge."""
    return _published(spark, path, State(1, buckets, -1, {}))


def state(spark: SparkSession, path: str) -> State:
    for _, found in whole_manifests(spark, path):
        folders = {int(b): tuple(f) for b, f in found["folders"].items()}
        return State(newest_number(spark, path), found["buckets"], found["last_batch"], folders)
    raise FileNotFoundError(f"no cache at {path}")


def _written(rows: DataFrame, path: str, buckets: int) -> dict[int, str]:
    """Write rows of the columns ROW into a new folder, and return its part for each bucket that has rows."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows = rows.to(StructType.fromDDL(ROW)).withColumn("bucket", bucket_of("question_key", buckets))
    write_table(rows, folder, ["bucket"])
    names = [s.getPath().getName() for s in listed(rows.sparkSession, folder)]
    return {int(n.removeprefix("bucket=")): f"{folder}/{n}" for n in names if n.startswith("bucket=")}


def _append(rows: DataFrame, path: str, number: int) -> State:
    spark = rows.sparkSession
    now = state(spark, path)
    if number <= now.last_batch:
        return now
    added = _written(rows.withColumn("batch", F.lit(number).cast("long")), path, now.buckets)
    folders = now.folders | {b: (*now.folders.get(b, ()), f) for b, f in added.items()}
    return _published(spark, path, State(now.number + 1, now.buckets, number, folders))


def fill(cache: DataFrame, path: str, number: int = 0) -> State:
    """Add the rows of a cache, one for each key, with their hits."""
    return _append(cache, path, number)


def upsert(batch: DataFrame, path: str, number: int) -> State:
    """Add a batch of store calls as `operators.cache.cache_upsert` does; numbers of batches rise, one that is known is skipped."""
    return _append(fold_batch(batch).withColumn("hits", F.lit(0).cast("long")), path, number)


def _first(column: str) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("batch"))).alias(column)


def merge(rows: DataFrame) -> DataFrame:
    """One row for each key out of rows of several batches."""
    return rows.groupBy("question_key").agg(
        _first("question_raw"),
        F.max_by("sql", "batch").alias("sql"),
        F.max_by("result_snapshot", "batch").alias("result_snapshot"),
        F.max_by("response", F.when(F.col("response").isNotNull(), F.col("batch"))).alias("response"),
        F.sum("hits").alias("hits"),
        _first("created_at"),
        F.max_by("updated_at", "batch").alias("updated_at"),
        F.max("batch").alias("batch"),
    )


def _rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(ROW).parquet(*folders) if folders else spark.createDataFrame([], ROW)


def read(spark: SparkSession, path: str, only: Iterable[int] | None = None) -> DataFrame:
    """The cache, or some buckets of it; other buckets are not opened."""
    folders = state(spark, path).folders
    wanted = folders if only is None else [b for b in sorted(set(only)) if b in folders]
    whole = [folders[b][0] for b in wanted if len(folders[b]) == 1]
    open_ = [f for b in wanted if len(folders[b]) > 1 for f in folders[b]]
    rows = _rows(spark, whole)
    return (rows.unionByName(merge(_rows(spark, open_))) if open_ else rows).drop("batch")


def lookup(questions: DataFrame, path: str) -> DataFrame:
    """`operators.cache.cache_lookup` that opens the buckets of its questions only."""
    spark = questions.sparkSession
    asked = questions.select(bucket_of("question_key", state(spark, path).buckets).alias("b")).distinct()
    # At most as many numbers as there are buckets.
    return cache_lookup(questions, read(spark, path, [r.b for r in asked.collect()]))


def compact(spark: SparkSession, path: str, least: int = 2) -> State:
    """Rewrite the buckets that have `least` folders or more as one folder each; others stay as they are."""
    now = state(spark, path)
    touched = {b: f for b, f in now.folders.items() if len(f) >= max(2, least)}
    if not touched:
        return now
    merged = _written(merge(_rows(spark, [x for f in touched.values() for x in f])), path, now.buckets)
    folders = now.folders | {b: (f,) for b, f in merged.items()}
    return _published(spark, path, State(now.number + 1, now.buckets, now.last_batch, folders))


def expire(spark: SparkSession, path: str, older_than_s: float = 86_400) -> int:
    """Delete folders of buckets that the newest manifest does not name and that are older; their number."""
    named = {f for folders in state(spark, path).folders.values() for f in folders}
    ends = {"/".join(f.rsplit("/", 2)[1:]) for f in named}
    gone = 0
    for data in listed(spark, f"{path}/data"):
        for status in listed(spark, data.getPath().toString()):
            name, age = status.getPath().getName(), time.time() - status.getModificationTime() / 1000
            if name.startswith("bucket=") and f"{data.getPath().getName()}/{name}" not in ends and age > older_than_s:
                deleted(spark, status.getPath().toString())
                gone += 1
    return gone
