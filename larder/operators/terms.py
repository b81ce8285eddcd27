"""User terms to measures or groups by a synonym list of (term, targets, is_proxy)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.numbers import exact_sum
from larder.functions.text import strip_accents_lower
from larder.operators.star import Star, literal_table

Synonyms = Sequence[tuple[str, Sequence[str], bool]]


def synonym_table(spark: SparkSession, synonyms: Synonyms) -> DataFrame:
    """One row per term without case and accents; spellings of a term must mean the same."""
    rows: dict[str, tuple[str, tuple[str, ...], bool]] = {}
    for term, targets, is_proxy in synonyms:
        row = (_bare(term), tuple(targets), is_proxy)
        known = rows.setdefault(row[0], row)
        if (set(known[1]), known[2]) != (set(row[1]), row[2]):
            raise ValueError(f"'{term}' stands for {known[1:]} and for {row[1:]}")
    return literal_table(spark, ["term", "targets", "is_proxy"], rows.values())


def _bare(term: str) -> str:
    parts = unicodedata.normalize("NFD", term.lower())
    return "".join(p for p in parts if unicodedata.category(p)[0] != "M")


def terms_in(text: Column | str, synonyms: Synonyms) -> Column:
    """Distinct terms that occur as whole words, accents and case aside; where two overlap the longer
    one wins. The list becomes one pattern, so a text is read once and nothing is joined."""
    terms = sorted({_bare(t) for t, _, _ in synonyms}, key=lambda t: (-len(t), t))
    pattern = r"\b(" + "|".join(re.escape(t) for t in terms) + r")\b"
    return F.array_distinct(F.regexp_extract_all(strip_accents_lower(text), F.lit(pattern), F.lit(1)))


def resolve_terms(questions: DataFrame, synonyms: Synonyms, text: str = "question") -> DataFrame:
    """One row per question and term found, with the targets of the term."""
    found = questions.withColumn("term", F.explode(terms_in(text, synonyms)))
    return found.join(synonym_table(questions.sparkSession, synonyms), "term")


def resolve_totals(
    questions: DataFrame, synonyms: Synonyms, star: Star, keys: Sequence[str], scale: int | None = None
) -> DataFrame:
    """Per question, term and item asked about: the measure, or the sum of the measures behind the term.

    ``questions`` holds item_id. Facts of the same question are summed with NULLs skipped.
    """
    asked = resolve_terms(questions, synonyms).select(
        *keys, "item_id", "term", F.explode("targets").alias("measure_name")
    )
    wanted = asked.join(star.measure.select("measure_id", "measure_name"), "measure_name")
    facts = wanted.join(star.fact.select("item_id", "measure_id", "value"), ["item_id", "measure_id"])
    return facts.groupBy(*keys, "item_id", "term").agg(exact_sum("value", scale).alias("total"))
