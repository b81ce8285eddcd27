"""Question sets and run reports as nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import fingerprint
from larder.operators.evalruns import AXES, accuracy, run_coverage

# Field names of question sets and run reports.
QUESTIONS = (
    "version string, total int, questions array<struct<id string, question string, difficulty string, "
    "tags array<string>, clinical_note string, sql_reference string, sql_reference_alt array<string>, "
    "expected_behavior string, order_matters boolean, compare_mode string, optional_columns array<string>>>"
)

_RATE = "struct<ok int, total int, taxa double>"

# Every field any version of the report has had; what an old report lacks reads as NULL.
REPORT = (
    "run_at string, dataset_version string, prompt_fingerprint string, total int, passed int, "
    "skipped int, skipped_ids array<string>, complete boolean, accuracy double, "
    "metricas struct<execution_accuracy struct<passed int, total int, taxa double>, "
    f"validade_sintatica {_RATE}, uso_de_schema {_RATE}, seguranca {_RATE}, eficiencia {_RATE}>, "
    "cache struct<hits_nesta_rodada int, perguntas_guardadas_no_total int>, "
    "by_difficulty map<string, struct<total int, passed int>>, "
    "details array<struct<id string, difficulty string, question string, status string, sql_gerado string, "
    "error string, motivo string, resposta string, resposta_preview string, passed boolean, skipped boolean, "
    "reused_from_previous_run boolean, rows_ref int, rows_agent int, order_matters boolean, "
    "compare_mode string, checks struct<sintaxe string, schema string, seguranca string, eficiencia string>>>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question."""
    sets = spark.read.schema(QUESTIONS).option("multiLine", True).json(path)
    return sets.select("version", F.inline("questions"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per run."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def report_details(reports: DataFrame) -> DataFrame:
    """One row per run and question, the axes as columns."""
    rows = reports.select("run_at", "prompt_fingerprint", F.inline("details"))
    named = rows.withColumnsRenamed({"sql_gerado": "sql", "motivo": "reason"})
    reply = F.coalesce("resposta", "resposta_preview").alias("reply")
    checks = [F.col(f"checks.{a}").alias(a) for a in AXES]
    kept = [c for c in named.columns if c not in ("checks", "resposta", "resposta_preview")]
    return named.select(*kept, reply, *checks).withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def run_heads(details: DataFrame) -> DataFrame:
    """One row per run: accuracy, coverage and passed/total per difficulty as a map.

    Difficulties are few by definition; the questions of a run are not, and stay rows.
    """
    tiers = accuracy(details, ["run_at", "difficulty"]).groupBy("run_at")
    tier = F.struct("difficulty", F.struct("total", "passed"))
    by_difficulty = tiers.agg(F.map_from_entries(F.sort_array(F.collect_list(tier))).alias("by_difficulty"))
    heads = run_coverage(details).join(accuracy(details), "run_at", "left")
    return heads.join(by_difficulty, "run_at", "left")


def write_reports(details: DataFrame, folder: str) -> None:
    """Report as two JSON datasets: a line per run, and a line per run and question by run."""
    run_heads(details).write.mode("overwrite").json(f"{folder}/runs")
    details.write.mode("overwrite").partitionBy("run_at").json(f"{folder}/details")


def files_fingerprint(spark: SparkSession, paths: Sequence[str], digits: int = 16) -> str:
    """One fingerprint over the bytes of a few files in the given order: changes when any of them does."""
    content = F.lit(b"")
    for path in paths:
        file = spark.read.format("binaryFile").load(path).select("path", "content")
        if file.select("path").count() != 1:
            raise ValueError(f"'{path}' is not one file")
        content = F.concat(content, file.select("content").scalar())
    return spark.range(1).select(fingerprint(content, digits)).first()[0]
