"""Expressions over model replies: the SQL in them, what is wrong with it, and rate-limit errors.

The checks work on text, not on a syntax tree. Those that take ``code`` expect the text made by
``code_only``, kept in a column of its own so that it is made once per statement.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.numbers import as_column
from larder.functions.text import BLANKS, mentions_any

# How a statement stands in a reply, and a waiting time in an error text.
FENCED = r"(?is)```(?:sql)?\s*\n?(.*?)```"
FROM_KEYWORD = r"(?is)\b((?:SELECT|WITH)\b.*)$"
READS = r"(?i)^(SELECT|WITH)\b"
RETRY_AFTER = r"(?i)try again in (?:([\d.]+)h)?(?:([\d.]+)m)?(?:([\d.]+)s)?"

# Verbs a reply may not start with.
WRITE_VERBS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "MERGE", "REPLACE",
    "ATTACH", "DETACH", "COPY", "EXPORT", "IMPORT", "CALL", "PRAGMA", "SET",
]

# Verbs that no part of a statement may run.
CHANGE_VERBS = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER"]

STARTS_WRITING = r"(?i)^\s*(" + "|".join(WRITE_VERBS) + r")\b"
CHANGES = r"(?:^|;|\(|\))\s*+(" + "|".join(CHANGE_VERBS).lower() + r")\b"

# Loops over single characters, which need no stack however long the text; a doubled quote is two literals.
LITERAL_OR_COMMENT = r"(')[^']*+'|--[^\n]*+|/\*(?s:.*?)\*/"
QUOTED_NAME = r"\"([a-z_]\w*+)\""

# Possessive, so that a word that does not fit is left at once.
# What follows a table name is no alias if the statement goes on there.
NO_WORD = r"(?!(?:join|inner|left|right|full|outer|cross|on|using|where|group|order|having|limit|union)\b)"
SCHEMA = r"(?:[a-z_]\w*+\s*+\.\s*+)*+"
TABLE_REF = r"\b(?:from|join)\s++" + SCHEMA + r"([a-z_]\w*+)"
TABLE_ALIAS = r"\b(?:from|join)\s++" + SCHEMA + r"[a-z_]\w*+\s++(?:as\s++)?" + NO_WORD + r"([a-z_]\w*+)"
NAMED_QUERY = r"(?:\bwith\s++(?:recursive\s++)?|,\s*+)([a-z_]\w*+)\s++as\s*+\("
GIVEN_NAME = r"\b(?:from|join|as)\s++" + SCHEMA + r"([a-z_]\w*+)"
CALL_NAME = r"\b[a-z_]\w*+\s*+\("
QUALIFIER = r"\b[a-z_]\w*+\s*+\."
WORD = r"\b([a-z_]\w*+)"

# Words of the language that are no column names.
LANGUAGE_WORDS = [
    "select", "distinct", "from", "join", "inner", "left", "right", "full", "outer", "cross", "on",
    "using", "where", "and", "or", "not", "in", "is", "null", "like", "ilike", "between", "exists",
    "case", "when", "then", "else", "end", "as", "group", "order", "by", "having", "limit", "offset",
    "asc", "desc", "nulls", "first", "last", "union", "all", "except", "intersect", "with",
    "recursive", "over", "partition", "rows", "range", "preceding", "following", "current", "row",
    "unbounded", "true", "false", "date", "timestamp", "interval", "cast", "double", "integer",
    "varchar", "values", "filter", "qualify", "window", "escape", "insert", "update", "delete", "drop",
    "create", "alter", "table", "into", "set", "returning",
]


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def candidate_statement(reply: Column | str) -> Column:
    """Fenced block, or else the text from the first SELECT/WITH on; NULL when there is neither."""
    reply = as_column(reply)
    fenced = F.nullif(_trimmed(F.regexp_extract(reply, FENCED, 1)), F.lit(""))
    bare = F.nullif(_trimmed(F.regexp_extract(reply, FROM_KEYWORD, 1)), F.lit(""))
    return _trimmed(F.rtrim(F.coalesce(fenced, bare), F.lit(";")))


def reject_reason(reply: Column | str, candidate: Column | str) -> Column:
    """Why the candidate statement of a reply cannot be used; NULL when it can."""
    reply, candidate = as_column(reply), as_column(candidate)
    return (
        F.when(reply.isNull() | (_trimmed(reply) == ""), "empty")
        .when(candidate.isNull(), "no_statement")
        .when(~candidate.rlike(READS), "not_a_read")
        .when(candidate.rlike(STARTS_WRITING), "write")
    )


def code_only(sql: Column | str) -> Column:
    """Statement in lower case, literals emptied, comments removed and plain names without quotes."""
    code = F.lower(F.regexp_replace(as_column(sql), LITERAL_OR_COMMENT, "$1 $1"))
    return F.when(code.contains('"'), F.regexp_replace(code, QUOTED_NAME, "$1")).otherwise(code)


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _any_of(code: Column, words: list[str]) -> Column:
    """Plain substring test. It spares most statements the pattern that follows."""
    return reduce(or_, [code.contains(w) for w in words])


def _all_matches(code: Column, pattern: str) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), F.lit(1))


def change_verb(code: Column | str) -> Column:
    """First data-changing verb anywhere in the statement; NULL when there is none."""
    code = as_column(code)
    maybe = _any_of(code, [v.lower() for v in CHANGE_VERBS])
    return F.nullif(F.when(maybe, F.regexp_extract(code, CHANGES, 1)), F.lit(""))


def several_statements(code: Column | str) -> Column:
    return F.rtrim(as_column(code), F.lit(";" + BLANKS)).contains(";")


def joins_without_condition(code: Column | str) -> Column:
    """How many JOINs have neither ON nor USING."""
    code = as_column(code)
    joins = F.regexp_count(code, F.lit(r"\bjoin\b"))
    conditions = F.regexp_count(code, F.lit(r"\b(?:on|using)\b"))
    bare = F.greatest(joins - conditions, F.lit(0))
    return F.when(code.isNotNull(), F.when(code.contains("join"), bare).otherwise(0))


def looks_parseable(code: Column | str, verb: Column | str) -> Column:
    """Cheap stand-in for a parser: a known verb, balanced brackets, no empty select list or source.

    ``verb`` is the statement's ``change_verb``.
    """
    code, verb = as_column(code), as_column(verb)
    opened = F.length(code) - F.length(F.replace(code, F.lit("("), F.lit("")))
    closed = F.length(code) - F.length(F.replace(code, F.lit(")"), F.lit("")))
    gap = code.rlike(
        r"\bselect\s++from\b|\bfrom\s++(?:where|group|order|limit)\b"
        r"|\b(?:where|and|or|by|on|from|select)\s*+;?\s*+$"
    )
    return (verb.isNotNull() | _trimmed(code).rlike(READS)) & (opened == closed) & ~gap


def _named_queries(code: Column) -> Column:
    return F.when(code.contains("with"), _all_matches(code, NAMED_QUERY)).otherwise(_nothing())


def table_names(code: Column | str) -> Column:
    """Distinct tables named after FROM and JOIN, less the statement's own WITH names."""
    code = as_column(code)
    used = _all_matches(code, TABLE_REF)
    return F.when(code.contains("with"), F.array_except(used, _all_matches(code, NAMED_QUERY))).otherwise(
        F.array_distinct(used)
    )


def column_names(code: Column | str) -> Column:
    """Distinct column names a statement expects from its tables.

    Call names and qualifiers are cut off, then language words and every name the statement itself
    gives (tables, their aliases, WITH names, AS names) are taken away.
    """
    code = as_column(code)
    bare = F.when(code.contains("("), F.regexp_replace(code, CALL_NAME, "(")).otherwise(code)
    bare = F.when(code.contains("."), F.regexp_replace(bare, QUALIFIER, " ")).otherwise(bare)
    words = F.filter(_all_matches(bare, WORD), lambda w: ~w.isin(*LANGUAGE_WORDS))
    given = F.concat(_all_matches(code, GIVEN_NAME), _all_matches(code, TABLE_ALIAS), _named_queries(code))
    return F.array_except(words, given)


def rate_limited(error: Column | str) -> Column:
    return mentions_any(error, ["429", "rate limit"])


def retry_after_seconds(error: Column | str) -> Column:
    """Waiting time stated in an error text such as 'try again in 1h2m3.5s'; NULL when none is."""
    error = as_column(error)
    hours, minutes, seconds = (
        F.regexp_extract(error, RETRY_AFTER, i).try_cast("double") for i in (1, 2, 3)
    )
    zero = F.lit(0.0)
    stated = F.coalesce(hours, minutes, seconds).isNotNull()
    total = F.coalesce(hours, zero) * 3600 + F.coalesce(minutes, zero) * 60 + F.coalesce(seconds, zero)
    return F.when(stated, total)
