"""Query 11: tokens of two tokenizers aligned in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.alignment import align
from larder.llm.registry import read, register


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))
