"""Text normalisation."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.numbers import as_column

BLANKS = " \t\n\r\f\x0b"

# What counts as white space in a question, besides the space itself.
OTHER_BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"

# Marks dropped at the end of a question.
QUESTION_ENDING = "?!. "

# Words that tell that a reply declined to answer for want of data.
REFUSAL_WORDS = [
    "insuficientes",
    "não apresenta quantidade significativa",
    "limitação",
    "não possui dados",
    "taco não",
    "dados insuficientes",
]


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


@functools.cache
def accent_pairs() -> tuple[str, str]:
    """Letters of the basic plane that decompose to one base letter, and those base letters."""
    accented, base = [], []
    for point in range(0x80, 0x10000):
        letter = chr(point)
        parts = unicodedata.normalize("NFD", letter)
        bare = "".join(p for p in parts if unicodedata.category(p)[0] != "M")
        if len(bare) == 1 and bare != letter:
            accented.append(letter)
            base.append(bare)
    return "".join(accented), "".join(base)


def strip_accents_lower(c: Column | str) -> Column:
    """Lower case without accents. Pure ASCII text, the common case, skips the table."""
    lowered = F.lower(as_column(c))
    accented, base = accent_pairs()
    bare = F.regexp_replace(F.translate(lowered, accented, base), r"\p{M}", "")
    return F.when(is_ascii(lowered), lowered).otherwise(bare)


def _without_marks(text: str) -> str:
    return "".join(p for p in unicodedata.normalize("NFKD", text) if not unicodedata.combining(p))


@functools.cache
def _latin_fold() -> tuple[str, str, str]:
    """For Latin letters and common punctuation: the one-to-one folds (as two aligned strings, with
    plain deletions last) and a pattern for text that holds anything beyond them."""
    folded, base, dropped = [], [], []
    known = [(0x00, 0x7F)]
    ranges = [(0x80, 0x24F), (0x300, 0x33F), (0x1E00, 0x1EFF), (0x2010, 0x2029), (0x20A0, 0x20AF)]
    for first, last in ranges:
        for point in range(first, last + 1):
            letter = chr(point)
            bare = _without_marks(letter)
            if len(bare) > 1:
                continue
            if not bare:
                dropped.append(letter)
            elif bare != letter:
                folded.append(letter)
                base.append(bare)
            known = [*known[:-1], (known[-1][0], point)] if known[-1][1] == point - 1 else [*known, (point, point)]
    spans = "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in known)
    return "".join(folded) + "".join(dropped), "".join(base), f"[^{spans}]"


def _fold_any(c: Column) -> Column:
    """Any text folded in Arrow batches. The function holds all it needs, so workers import nothing."""

    def fold(texts: pd.Series) -> pd.Series:
        import unicodedata as data

        def bare(text):
            if text is None:
                return None
            parts = data.normalize("NFKD", text)
            return "".join(p for p in parts if not data.combining(p)).lower()

        return texts.map(bare)

    return F.pandas_udf(fold, T.StringType())(c)


def normalize_question(c: Column | str) -> Column:
    """Key of a question: compatibility forms folded, accents, case, outer blanks and closing marks
    dropped, inner blanks collapsed.

    Latin text stays in the JVM. Only text holding other characters is handed to the Arrow function,
    which sees NULL for all the rest.
    """
    c = as_column(c)
    folded, base, beyond = _latin_fold()
    odd = ~is_ascii(c) & c.rlike(beyond)
    latin = F.lower(F.when(is_ascii(c), c).otherwise(F.translate(c, folded, base)))
    text = F.coalesce(_fold_any(F.when(odd, c)), latin)
    text = F.rtrim(F.btrim(text, F.lit(" " + OTHER_BLANKS)), F.lit(QUESTION_ENDING))
    spaced = F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def cell_text(c: Column | str) -> Column:
    """Outer blanks and case dropped."""
    return F.lower(F.btrim(as_column(c), F.lit(BLANKS)))


def one_line(c: Column | str) -> Column:
    """Blanks collapsed to single spaces."""
    return F.trim(F.regexp_replace(as_column(c), r"\s+", " "))


def mentions_any(c: Column | str, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words."""
    lowered = F.lower(as_column(c))
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found


def refuses(c: Column | str, words: list[str] = REFUSAL_WORDS) -> Column:
    return mentions_any(c, words)


def preview(c: Column | str, width: int = 100) -> Column:
    """Text cut at ``width`` characters with an ellipsis, whole if it fits."""
    c = as_column(c)
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def fingerprint(c: Column | str, digits: int = 16) -> Column:
    """First hex digits of the SHA-256 of text or bytes."""
    return F.substring(F.sha2(as_column(c).cast("binary"), 256), 1, digits)


def minute_label(c: Column | str) -> Column:
    """'2026-07-22T09:17:04.1' as '2026-07-22 09:17'."""
    return F.replace(F.substring(as_column(c), 1, 16), F.lit("T"), F.lit(" "))


def day_label(c: Column | str) -> Column:
    """Month and day of a run label: '07-22'."""
    return F.substring(as_column(c), 6, 5)


def file_stamp(c: Column | str) -> Column:
    """Time as it stands in a report's file name: 20260722_091704."""
    return F.date_format(as_column(c), "yyyyMMdd_HHmmss")
