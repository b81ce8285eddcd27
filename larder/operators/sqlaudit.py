"""Replies to statements, and a static audit of statements against the warehouse's own names.

Names are found by pattern, not by a parser, so this is an approximation: implicit column aliases
and tables listed with commas are not seen. Every check is a function of one row; a log of any size
is audited without a shuffle.

``catalog`` is {table: columns}, the metadata the session holds anyway.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.replies import (
    candidate_statement,
    change_verb,
    code_only,
    column_names,
    joins_without_condition,
    looks_parseable,
    reject_reason,
    several_statements,
    table_names,
)

Catalog = Mapping[str, Sequence[str]]


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``sql`` (NULL when no usable statement was found) and ``reject_reason``."""
    found = replies.withColumn("_found", candidate_statement(reply))
    judged = found.withColumn("reject_reason", reject_reason(reply, "_found"))
    return judged.withColumn("sql", F.when(F.col("reject_reason").isNull(), F.col("_found"))).drop("_found")


def with_code(statements: DataFrame, sql: str = "sql") -> DataFrame:
    return statements.withColumn("code", code_only(sql))


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v.lower()) for v in values]) if values else F.array().cast("array<string>")


def with_unknown_names(coded: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds the arrays ``unknown_tables`` and ``unknown_columns`` to statements that carry ``code``.

    A column is known when any table the statement reads has it.
    """
    known = F.map_from_arrays(_texts(list(catalog)), F.array(*[_texts(list(c)) for c in catalog.values()]))
    nothing = F.array().cast("array<string>")
    named = coded.withColumn("_tables", table_names("code")).withColumn("_columns", column_names("code"))
    columns = F.flatten(F.transform("_tables", lambda t: F.coalesce(F.try_element_at(known, t), nothing)))
    return named.withColumns(
        {
            "unknown_tables": F.array_except("_tables", _texts(list(catalog))),
            "unknown_columns": F.array_except("_columns", columns),
        }
    ).drop("_tables", "_columns")


def _each(audited: DataFrame, names: str, out: str) -> DataFrame:
    # A plain explode is given a filter on its array, which would run all patterns a second time.
    return audited.select("stmt_id", F.explode_outer(names).alias(out)).filter(F.col(out).isNotNull())


def unknown_tables(statements: DataFrame, catalog: Catalog) -> DataFrame:
    """Tables a statement (stmt_id, sql) reads that neither the catalog nor the statement defines."""
    audited = with_unknown_names(with_code(statements), catalog)
    return _each(audited, "unknown_tables", "table_name")


def unknown_columns(statements: DataFrame, catalog: Catalog) -> DataFrame:
    """Columns found in none of the tables that the statement reads."""
    audited = with_unknown_names(with_code(statements), catalog)
    return _each(audited, "unknown_columns", "column_name")


def axis_verdicts(statements: DataFrame, catalog: Catalog) -> DataFrame:
    """Verdict per axis and statement: 'ok' or what is wrong; 'n/a' where the text does not parse.

    ``unknown_names`` lists the tables and columns behind 'alucinou', sorted."""
    judged = with_code(statements).withColumn("_verb", change_verb("code"))
    judged = judged.withColumns({"_bare": joins_without_condition("code"), "_parses": looks_parseable("code", "_verb")})
    audited = with_unknown_names(judged, catalog)
    n_bad = F.size("unknown_tables") + F.size("unknown_columns")
    safety = (
        F.when(F.col("_verb").isNotNull(), F.concat(F.lit("escrita: "), "_verb"))
        .when(several_statements("code"), "multi_statement")
        .otherwise("ok")
    )
    schema = F.when(n_bad > 0, "alucinou").otherwise("ok")
    bare = F.concat(F.col("_bare").cast("string"), F.lit(" JOIN sem ON"))
    efficiency = F.when(F.col("_bare") > 0, bare).otherwise("ok")
    names = F.array_join(F.array_sort(F.array_union("unknown_tables", "unknown_columns")), ", ")

    def axis(verdict: Column, name: str) -> Column:
        return F.when(F.col("_parses"), verdict).otherwise("n/a").alias(name)

    return audited.select(
        "stmt_id",
        F.when(F.col("_parses"), "ok").otherwise("nao_parseia").alias("sintaxe"),
        axis(schema, "schema"),
        axis(safety, "seguranca"),
        axis(efficiency, "eficiencia"),
        F.when(F.col("_parses") & (n_bad > 0), names).alias("unknown_names"),
    )
