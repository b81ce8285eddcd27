"""WARC archives: written as record-wise compressed files with an index, read back by byte ranges.

Rows are (page_id, url, html). A null html is an empty payload, a null url an empty target. Of records
with equal payloads of at least `least` bytes, the one with the smallest page_id is a response and the
others revisit it; a null page_id counts as the largest. If that row is repeated, one copy is the response
and the others revisit it. Shorter payloads are all responses. Other columns are ignored.

The index comes first: writing returns a row per record with file, offset, length, URL and digest, and
only what an index row names is read. A task writes a file of its own under an unused name, so what a
lost task left is in no index row.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.stores import open_folder

LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Ranges of a file less than GAP bytes apart are read in one request of at most MOST bytes;
#: a task reads records of whole stretches of STRETCH bytes.
GAP, MOST, STRETCH = 64 << 10, 8 << 20, 16 << 20
#: Bytes that a task reads at most on average.
TASK_BYTES = 128 << 20

INDEX = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "file string, offset long, length long"
)
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def typed_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Page rows with payload_digest, payload_bytes, record_type and refers_to.

    Who revisits whom is found on rows without payloads; the payloads are shuffled once, by page_id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns(
        {
            "payload_digest": F.sha2("html", 256),
            "payload_bytes": F.octet_length("html").cast("long"),
            "_key": F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        }
    )
    shared = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select(F.col("payload_digest").alias("_digest"), "_first")
    )
    ids = rows.where(F.col("payload_bytes") >= least).select("_key", "payload_digest")
    groups = ids.join(shared, F.col("payload_digest") == F.col("_digest")).groupBy("_key", "payload_digest").agg(F.first("_first").alias("_first"))
    groups = groups.withColumn("_shared", F.lit(True))
    # The join and the window deal rows out alike, so payloads move once.
    joined = rows.join(groups, ["_key", "payload_digest"], "left")
    copy = F.row_number().over(Window.partitionBy("_key", "payload_digest").orderBy("url"))
    revisits = F.col("_shared").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("_first")) | (copy > 1))
    return joined.withColumn("_revisits", revisits).select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        "payload_bytes",
        F.when(F.col("_revisits"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("_revisits"), F.col("_first")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    """URN that holds the page id (RFC 9562 version 8, free bits)."""
    digits = f"{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-800{int(page_id is None)}-8000-00000000{digits[12:]}>"


def page_of(urn: str) -> int | None:
    groups = urn.strip("<>").removeprefix("urn:uuid:").split("-")
    if groups[2] == "8001":
        return None
    value = int(groups[0] + groups[1] + groups[4][-4:], 16)
    return value - (1 << 64) if value >> 63 else value


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _member(head: bytes, block: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()


def make_record(page_id, url, html, digest, size, kind, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + html.encode() if kind == "response" else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return _member(_head([*fields, ("Content-Length", str(len(block)))]), block)


def parse_record(member: bytes) -> tuple:
    """Values of one compressed record, in the order of RECORDS."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if kind == "response" and len(payload) != size:
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut off")
    return (
        page_of(fields["WARC-Record-ID"]),
        fields["WARC-Target-URI"],
        kind,
        page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        size,
        fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        payload if kind == "response" else None,
    )


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def write_archive(pages: DataFrame, folder: str, least: int = LEAST_SHARED) -> DataFrame:
    """Write WARC files into `folder` (shared storage) and their index beside them; return the index."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in batches:
                found = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page_id, url, html, digest, size, kind, refers_to = row
                    if out is None:
                        fs.create_dir(f"{root}/records", recursive=True)
                        out = fs.open_output_stream(f"{root}/records/{name}", compression=None)
                        about = b"format: WARC File Format 1.1\r\n"
                        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
                        out.write(_member(_head([*fields, ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]), about))
                    member, start = make_record(page_id, url, html, digest, size, kind, refers_to, date), out.tell()
                    out.write(member)
                    found.append((page_id, url, kind, refers_to, size, digest, name, start, len(member)))
                if found:
                    yield _arrow(INDEX, found)
        finally:
            if out is not None:
                out.close()

    typed = typed_records(pages, least).select("page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to")
    typed.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records that the given index rows name: sorted by place, neighbouring ranges read together."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        opened, source = None, None
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(places):
                name, start, length = places[at]
                end, until = start + length, at + 1
                while until < len(places) and places[until][0] == name and places[until][1] - end <= GAP and sum(places[until][1:]) - start <= MOST:
                    end, until = max(end, sum(places[until][1:])), until + 1
                if name != opened:
                    opened, source = name, fs.open_input_file(f"{root}/records/{name}")
                data = source.read_at(end - start, start)
                yield _arrow(RECORDS, [parse_record(data[o - start : o - start + n]) for _, o, n in places[at:until]])
                at = until

    # Index rows are small, what they name is not: the number of tasks follows the bytes to be read.
    bytes_read = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_read // TASK_BYTES))
    places = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / STRETCH))
    return places.sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)
