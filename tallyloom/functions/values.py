"""Number parsing, division and rounding rules, as JVM-side column expressions.

One place for the rules that differ between Spark and the numeric conventions wanted here:
missing is NULL only (never NaN or infinity), division by zero is NULL, rounding is half-to-even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Accepts 12, -3, .5, 1.5, 1e6; rejects 1f, NaN, Infinity, which a cast alone would let through.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(col: ColumnLike) -> Column:
    """Text with decimal comma or dot to double; anything else is NULL."""
    text = F.regexp_replace(F.trim(_c(col)), ",", ".")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def finite(col: ColumnLike) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_div(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient, NULL where the divisor is zero or missing."""
    return F.try_divide(_c(numerator), _c(denominator))


def zero_if_null(col: ColumnLike) -> Column:
    return F.coalesce(_c(col), F.lit(0.0))


def clip_low(col: ColumnLike, low: float = 0.0) -> Column:
    """Missing or below ``low`` becomes ``low``."""
    return F.greatest(F.coalesce(_c(col), F.lit(low)), F.lit(low))


def rint0(col: ColumnLike) -> Column:
    """Whole number, half to even."""
    return F.rint(_c(col))


def half_even(col: ColumnLike, digits: int = 0) -> Column:
    return F.rint(_c(col)) if digits == 0 else F.bround(_c(col), digits)


def safe_denominator(col: ColumnLike, value: float | None = 1.0) -> Column:
    """Missing or zero divisor replaced by ``value`` (``None``: missing)."""
    c = F.nullif(_c(col), F.lit(0))
    return c if value is None else F.coalesce(c, F.lit(value))


def clean_code(col: ColumnLike, width: int) -> Column:
    """Trim, drop quote marks, pad with zeros on the left; longer codes stay whole."""
    bare = F.trim(F.regexp_replace(F.trim(_c(col)), "['\"]", ""))
    return F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))


def count_char(col: ColumnLike, char: str) -> Column:
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))) / F.lit(len(char))


def whole_words(col: ColumnLike) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(_c(col)), r"\s+"), lambda w: w != "")


def fmt_percent(col: ColumnLike) -> Column:
    return F.format_string("%.2f%%", _c(col))
