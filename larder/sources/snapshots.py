"""Committed snapshots: data goes to a new folder, then one small manifest names it.

A snapshot holds one or more tables under `<path>/data/<unique name>/<table>`; `<path>/manifests/<version>.json` names that
folder. A write that dies before its manifest leaves the former snapshot in place, a reader takes the version from the
newest manifest that is whole, and running queries keep the files they began with. A version number is claimed by
creating its file, which fails where the file is there, so of two writers one has to take the next number.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from larder.sources.tables import write_table


@dataclass(frozen=True)
class Snapshot:
    version: int
    folder: str
    tables: tuple[str, ...]


def _at(spark: SparkSession, path: str):
    """File system and path, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, path: str) -> list:
    """File states in a folder, none if it is not there."""
    files, where = _at(spark, path)
    return list(files.listStatus(where)) if files.exists(where) else []


def _text(spark: SparkSession, path) -> str:
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def whole_manifests(spark: SparkSession, path: str) -> Iterator[tuple[int, dict]]:
    """Numbers and contents of manifests, the newest first; one that a writer has not finished is none yet."""
    for status in sorted(listed(spark, f"{path}/manifests"), key=lambda s: s.getPath().getName(), reverse=True):
        name = status.getPath().getName()
        if not name.endswith(".json"):
            continue
        try:
            yield int(name.removesuffix(".json")), json.loads(_text(spark, status.getPath()))
        except json.JSONDecodeError:
            continue


def newest_number(spark: SparkSession, path: str) -> int:
    """The greatest number that a manifest has, whole or not; 0 if there is none."""
    names = [s.getPath().getName() for s in listed(spark, f"{path}/manifests")]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def claim(spark: SparkSession, path: str, number: int, body: str) -> bool:
    """Create the manifest of a number; False if another writer has it."""
    files, where = _at(spark, f"{path}/manifests/{number:012d}.json")
    try:
        stream = files.create(where, False)
    except Py4JJavaError:
        if not files.exists(where):
            raise
        return False
    stream.write(bytearray(body.encode()))
    stream.close()
    return True


def deleted(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def _manifests(spark: SparkSession, path: str) -> Iterator[Snapshot]:
    for number, found in whole_manifests(spark, path):
        yield Snapshot(number, found["folder"], tuple(found["tables"]))


def snapshots(spark: SparkSession, path: str) -> list[Snapshot]:
    """All committed snapshots, the newest first."""
    return list(_manifests(spark, path))


def latest(spark: SparkSession, path: str) -> Snapshot | None:
    return next(_manifests(spark, path), None)


def write_data(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Write tables into a new folder that no reader knows yet, and return it."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", (partition_by or {}).get(name, ()))
    return folder


def publish(spark: SparkSession, path: str, folder: str, tables: Sequence[str]) -> Snapshot:
    """Make a folder of `write_data` the newest snapshot."""
    body = json.dumps({"folder": folder, "tables": list(tables)})
    version = newest_number(spark, path) + 1
    while not claim(spark, path, version, body):
        version += 1  # another writer was faster
    return Snapshot(version, folder, tuple(tables))


def commit(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, Sequence[str]] | None = None) -> Snapshot:
    """Replace the tables at a path as one: readers see all of the new ones or all of the old ones."""
    spark = next(iter(tables.values())).sparkSession
    return publish(spark, path, write_data(tables, path, partition_by), list(tables))


def read_snapshot(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the newest snapshot, or of a version that is still kept."""
    for found in _manifests(spark, path):
        if version in (None, found.version):
            if table not in found.tables:
                raise ValueError(f"snapshot {found.version} has no table {table}")
            return spark.read.parquet(f"{found.folder}/{table}")
    raise FileNotFoundError(f"no snapshot {version or ''} at {path}".replace("  ", " "))


def expire(spark: SparkSession, path: str, keep: int = 2, older_than_s: float = 86_400) -> int:
    """Delete all but the newest snapshots, and data without a manifest that is older; the number of folders deleted."""
    found = snapshots(spark, path)
    for old in found[keep:]:
        deleted(spark, f"{path}/manifests/{old.version:012d}.json")
    named = {s.folder.rsplit("/", 1)[1] for s in found[:keep]}
    unnamed = {s.folder.rsplit("/", 1)[1] for s in found[keep:]}
    gone = 0
    for status in listed(spark, f"{path}/data"):
        name, age = status.getPath().getName(), time.time() - status.getModificationTime() / 1000
        if name not in named and (name in unnamed or age > older_than_s):
            deleted(spark, status.getPath().toString())
            gone += 1
    return gone


def state_of_files(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files at a path; reads the listing and no rows."""
    files, where = _at(spark, path)
    found, listed = [], files.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        found.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
