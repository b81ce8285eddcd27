"""Corpus pipeline: language, repeated lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet into the shared
folder and reads it again as the next stage's documents. All stages but the last return the columns of
documents, whatever others the input has.

* language_id drops texts without a letter and texts whose two likeliest languages are too close to tell;
  `lang` becomes the predicted language. The model learns from the labelled rows among its documents.
* line_dedup deletes later copies of repeated line runs; a document of which nothing is left is dropped.
* near_dedup keeps one document of each group, the one with the smallest doc_id. Documents are linked whose sets
  of five-word shingles have a Jaccard similarity of 0.8 or more. Repeated rows count as copies.
* secret_scan replaces secrets by a mark and keeps all documents.
* packing cuts the documents that are left into sequences of 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.langid import UND, predict, train
from larder.llm.linededup import without_copies
from larder.llm.nearcopies import without_near_copies
from larder.llm.packing import pack
from larder.llm.secrets import redact
from larder.session import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted again."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs)
    known = docs.select(*COLUMNS).withColumn("_p", predict(F.col("text"), model)).where(F.col("_p.lang_pred") != UND).where(~F.col("_p.ambiguous"))
    return _documents(known.withColumn("lang", F.col("_p.lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = without_copies(docs.select(*COLUMNS))
    return _documents(clean.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(without_near_copies(docs.select(*COLUMNS)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(docs.select(*COLUMNS).withColumn("text", redact(F.col("text"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Language identification has no SQL form; the tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
