"""Column functions shared by the operators."""

from .values import (  # noqa: F401
    clean_code, clip_low, count_char, finite, fmt_percent, half_even, parse_number, rint0,
    safe_denominator, safe_div, whole_words, zero_if_null,
)
