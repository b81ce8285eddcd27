"""Query 4: all documents encoded, decoded and compared with the sentencepiece library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.registry import read, register
from larder.llm.sentencepieces import transcode


@register("op4_sentencepieces")
def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    checked = docs.select("doc_id", "text", transcode(F.col("text")).alias("t")).select("doc_id", "text", "t.*")
    return checked.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("back", 256).alias("decoded_sha256"),
        F.col("back").eqNullSafe(F.col("text")).alias("round_trip"),
        "parity",
    )
