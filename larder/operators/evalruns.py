"""Metrics over evaluation runs.

``details`` has one row per run and question: run_at, id, difficulty, status, passed, skipped, plus
whatever an operator asks for. ``questions`` has one row per question: id, difficulty, question, ...
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import ratio
from larder.functions.replies import rate_limited

# The static checks, and the states of a question in a run.
AXES = ["sintaxe", "schema", "seguranca", "eficiencia"]
EVALUATED = ["pass", "fail", "sql_error"]
SYMBOLS = {"pass": "✅", "fail": "❌", "sql_error": "💥", "sem_orcamento": "·", "sem_gold": "—"}
ABSENT_SYMBOL = "·"
UNKNOWN_SYMBOL = "?"

OK = "ok"


def _evaluated(details: DataFrame) -> DataFrame:
    return details.filter(~F.coalesce("skipped", F.lit(False)))


def _passed() -> Column:
    return F.count_if(F.col("passed"))


def accuracy(details: DataFrame, by: Sequence[str] = ("run_at",)) -> DataFrame:
    """Passed over evaluated, skipped questions left out."""
    counts = _evaluated(details).groupBy(*by).agg(_passed().alias("passed"), F.count("*").alias("total"))
    return counts.withColumn("accuracy", ratio(F.col("passed"), F.col("total")))


def axis_rates(details: DataFrame, axes: Sequence[str] = AXES, by: Sequence[str] = ("run_at",)) -> DataFrame:
    """Share of 'ok' per axis among the rows where the axis was checked.

    Axes are counted side by side first; only the counts are turned into rows.
    """
    counts = []
    for axis in axes:
        counts += [
            F.count_if(F.col(axis) == OK).alias(f"{axis}_ok"),
            F.count(axis).alias(f"{axis}_total"),
        ]
    wide = _evaluated(details).groupBy(*by).agg(*counts)
    each = F.array(
        *[
            F.struct(F.lit(a).alias("axis"), F.col(f"{a}_ok").alias("ok"), F.col(f"{a}_total").alias("total"))
            for a in axes
        ]
    )
    rows = wide.select(*by, F.inline(each))
    return rows.withColumn("rate", ratio(F.col("ok"), F.col("total")))


def run_coverage(details: DataFrame) -> DataFrame:
    """Per run how many questions were evaluated and skipped, and whether the run is complete."""
    skipped = F.count_if(F.coalesce("skipped", F.lit(False)))
    return details.groupBy("run_at").agg(
        (F.count("*") - skipped).alias("evaluated"),
        skipped.alias("skipped"),
        (skipped == 0).alias("complete"),
    )


def skipped_ids(details: DataFrame) -> DataFrame:
    return details.filter("skipped").select("run_at", "id")


def classify_error(error: Column) -> Column:
    """skipped_rate_limit or agent_error for an error text, NULL without one."""
    return F.when(error.isNull(), F.lit(None)).when(rate_limited(error), "skipped_rate_limit").otherwise(
        "agent_error"
    )


def rescore(details: DataFrame, questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Status of every stored answer under today's rules.

    ``verdicts`` has run_at, id, executes, has_gold, matches, refuses for answers that hold SQL.
    Questions no longer in the set drop out. Without SQL the answer was never paid for
    (sem_orcamento); where a refusal is expected only the refusal counts.
    """
    rows = details.select("run_at", "id", "sql").join(questions.select("id", "difficulty", "expects_refusal"), "id")
    rows = rows.join(verdicts, ["run_at", "id"], "left")
    return with_status(rows).select("run_at", "id", "difficulty", F.col("rescored_status").alias("status"))


def with_status(rows: DataFrame) -> DataFrame:
    """Adds ``rescored_status`` to answers that carry expects_refusal and their own verdict."""

    def no(c: str) -> Column:
        return ~F.coalesce(c, F.lit(False))

    status = (
        F.when(F.coalesce("sql", F.lit("")) == "", "sem_orcamento")
        .when(F.col("expects_refusal"), F.when(no("refuses"), "fail").otherwise("pass"))
        .when(no("has_gold"), "sem_gold")
        .when(no("executes"), "sql_error")
        .when(no("matches"), "fail")
        .otherwise("pass")
    )
    return rows.withColumn("rescored_status", status)


def scored_accuracy(scored: DataFrame) -> DataFrame:
    """Per run: evaluated, passed and their ratio, from re-scored states."""
    is_evaluated = F.col("status").isin(*EVALUATED)
    counts = scored.groupBy("run_at").agg(
        F.count_if(is_evaluated).alias("evaluated"), F.count_if(F.col("status") == "pass").alias("hits")
    )
    return counts.withColumn("rescored", ratio(F.col("hits"), F.col("evaluated")))


def run_summary_of(rows: DataFrame) -> DataFrame:
    """Reported and re-scored accuracy in one aggregate, from details that carry ``rescored_status``."""
    asked = ~F.coalesce("skipped", F.lit(False))
    counts = rows.groupBy("run_at").agg(
        F.count_if(F.col("rescored_status").isin(*EVALUATED)).alias("evaluated"),
        F.count_if(F.col("rescored_status") == "pass").alias("hits"),
        F.count_if(asked & F.col("passed")).alias("_passed"),
        F.count_if(asked).alias("_total"),
    )
    rescored, reported = ratio(F.col("hits"), F.col("evaluated")), ratio(F.col("_passed"), F.col("_total"))
    return counts.select("run_at", "evaluated", "hits", rescored.alias("rescored"), reported.alias("reported"))


def run_summary(details: DataFrame, scored: DataFrame) -> DataFrame:
    """Reported accuracy next to the re-scored one."""
    reported = accuracy(details).select("run_at", F.col("accuracy").alias("reported"))
    return scored_accuracy(scored).join(reported, "run_at", "left")


def common_base(scored: DataFrame) -> DataFrame:
    """Questions evaluated in every run: the only fair ground for comparing runs."""
    n_runs = scored.agg(F.count_distinct("run_at")).scalar()
    seen = scored.filter(F.col("status").isin(*EVALUATED)).groupBy("id")
    return seen.agg(F.count_distinct("run_at").alias("n")).filter(F.col("n") == n_runs).select("id")


def common_base_accuracy(scored: DataFrame) -> DataFrame:
    rows = scored.join(common_base(scored), "id", "left_semi")
    counts = rows.groupBy("run_at").agg(
        F.count_if(F.col("status") == "pass").alias("hits"), F.count("*").alias("total")
    )
    return counts.withColumn("accuracy", ratio(F.col("hits"), F.col("total")))


def latest_run(details: DataFrame) -> DataFrame:
    return details.filter(F.col("run_at") == details.agg(F.max("run_at")).scalar())


def latest_failures(details: DataFrame, questions: DataFrame) -> DataFrame:
    """Failed questions of the last run with their reason."""
    failed = latest_run(details).filter(F.col("status").isin("fail", "sql_error"))
    return failed.select("id", "status", "reason").join(questions.select("id", "difficulty", "question"), "id")


def latest_violations(details: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Axes of the last run that are not ok."""
    long = latest_run(details).select("id", *axes).unpivot(["id"], list(axes), "axis", "violation")
    return long.filter(F.col("violation") != OK)


def _symbol(status: Column, symbols: Mapping[str, str]) -> Column:
    sign = F.lit(UNKNOWN_SYMBOL)
    for state, symbol in symbols.items():
        sign = F.when(status == state, symbol).otherwise(sign)
    return sign


def status_cells(scored: DataFrame, symbols: Mapping[str, str] = SYMBOLS) -> DataFrame:
    """The matrix as rows (id, run_at, symbol), for any number of runs; cells without a row are absent."""
    return scored.select("id", "run_at", _symbol(F.col("status"), symbols).alias("symbol"))


def status_matrix(
    scored: DataFrame, questions: DataFrame, runs: Sequence[str], symbols: Mapping[str, str] = SYMBOLS
) -> DataFrame:
    """One row per question, one column per listed run, a symbol in each cell."""
    # Cells are aggregated as small numbers and turned into symbols afterwards.
    signs = [*symbols.values(), UNKNOWN_SYMBOL, ABSENT_SYMBOL]
    code = F.lit(len(signs) - 1)
    for i, status in enumerate(symbols):
        code = F.when(F.col("status") == status, i + 1).otherwise(code)
    cells = [F.max(F.when(F.col("run_at") == r, code)).alias(r) for r in runs]
    seen = scored.filter(F.col("run_at").isin(*runs)).groupBy("id").agg(*cells)
    rows = questions.select("id", "difficulty").join(seen, "id", "left")
    signs_of = F.array(*[F.lit(s) for s in signs])
    marks = [F.element_at(signs_of, F.coalesce(F.col(f"`{r}`"), F.lit(len(signs)))).alias(r) for r in runs]
    return rows.select("id", "difficulty", *marks)


def plan_rerun(questions: DataFrame, last_run: DataFrame, fingerprint: Column, last_fingerprint: Column) -> DataFrame:
    """Which questions may reuse their last result: passed, not skipped, nothing changed since.

    A last run without a fingerprint counts as unchanged.
    """
    unchanged = last_fingerprint.isNull() | (last_fingerprint == fingerprint)
    rows = questions.select("id").join(last_run.select("id", "passed", "skipped"), "id", "left")
    good = F.coalesce("passed", F.lit(False)) & ~F.coalesce("skipped", F.lit(False))
    return rows.select("id", F.when(unchanged & good, "reuse").otherwise("rerun").alias("action"))


def hits_delta(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cache hits gained between two snapshots of a cache table."""
    signed = after.select(*by, F.col("hits").alias("h")).unionAll(before.select(*by, (-F.col("hits")).alias("h")))
    total = F.coalesce(F.sum("h"), F.lit(0)).alias("hits_gained")
    return signed.groupBy(*by).agg(total) if by else signed.agg(total)
