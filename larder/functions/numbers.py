"""Numbers out of dirty cells, and how a measured value is classed and rounded."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Cell marks of the source sheets. A trace counts as zero, "not analysed" as missing.
SENTINELS = {"Tr": 0.0, "NA": None}

MISSING, ZERO, PRESENT = "missing", "zero", "present"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_number(c: Column | str) -> Column:
    """Whether the text is a plain number. A cast alone also takes '1d', 'NaN' and 'Infinity'."""
    return as_column(c).rlike(NUMBER_TEXT)


def to_number(c: Column | str) -> Column:
    """Double, or NULL for anything that is not a plain number."""
    c = as_column(c)
    return F.when(is_number(c), F.trim(c).try_cast("double"))


def sentinel_number(c: Column | str, marks: Mapping[str, float | None] = SENTINELS) -> Column:
    """Number with marks mapped by exact match: 'Tr ' is not the mark 'Tr' and becomes NULL."""
    c = as_column(c)
    value = to_number(c)
    for mark, number in marks.items():
        value = F.when(c == mark, F.lit(number).cast("double")).otherwise(value)
    return value


def to_key(c: Column | str) -> Column:
    """Whole-number key; fractions are cut off, as in 12.0 read from a sheet."""
    return to_number(c).try_cast("long")


def value_state(c: Column | str) -> Column:
    """missing (NULL or not a number), zero or present."""
    c = as_column(c)
    return F.when(c.isNull() | F.isnan(c.cast("double")), MISSING).when(c == 0, ZERO).otherwise(PRESENT)


def round_even(c: Column | str, digits: int = 2) -> Column:
    """Round half to even on the scaled value, the way array libraries do."""
    scale = float(10**digits)
    return F.rint(as_column(c).cast("double") * scale) / scale


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded; NULL when there is nothing to divide by."""
    return F.when(whole != 0, F.bround(part.cast("double") / whole.cast("double"), digits))


def exact_sum(c: Column | str, scale: int | None = None) -> Column:
    """NULL-skipping sum. With ``scale`` the values are summed as decimals of that many places, so
    the result does not depend on the order in which tasks deliver their parts; sums have 38 digits."""
    c = as_column(c)
    if scale is None:
        return F.sum(c)
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def exact_mean(c: Column | str, scale: int | None = None) -> Column:
    c = as_column(c)
    if scale is None:
        return F.avg(c)
    total = exact_sum(c, scale)
    return F.when(F.count(c) > 0, total / F.count(c))
