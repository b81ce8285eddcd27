"""Query 13: conversations damaged by a fixed rule and repaired at least cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.registry import read, register
from larder.llm.repair import damaged, repair_conversations


@register("op13_repair")
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(read(spark, sf_dir, "conversations")))
