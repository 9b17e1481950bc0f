"""Projection, filtering and cleaning. All per-row work is built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip_low, finite, parse_number, safe_div
from ..session import materialise
from .grouping import Totals, by_group, has_key
from .joins import join_unique
from .ordering import number_rows


def select_rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the columns of ``names`` under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def parse_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: parse_number(c) for c in cols})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double, not-a-number to missing; numeric columns only lose NaN and infinities."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: parse_number(c) if kinds[c] == "string" else finite(F.col(c).cast("double"))
                           for c in cols})


def floor_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clip_low(c) for c in cols})


def fill_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def fill_from(df: DataFrame, target: str, source: Column | str) -> DataFrame:
    source = F.col(source) if isinstance(source, str) else source
    return df.withColumn(target, F.coalesce(F.col(target), source))


def safe_ratio(df: DataFrame, name: str, numerator: str, denominator: str) -> DataFrame:
    return df.withColumn(name, finite(safe_div(numerator, denominator)))


def fill_group_mean(df: DataFrame, col: str, keys: Sequence[str], totals: Totals | None = None) -> DataFrame:
    """Gaps take the mean of their group. Means are aggregated map-side into a written table, so rows are brought together by group only
    where that table is large."""
    if totals is None and keys:
        means = df.where(has_key(keys)).groupBy(*keys).agg(F.avg(col).alias("_mean"))
        return join_unique(df, materialise(means, "means"), keys).withColumn(col, F.coalesce(F.col(col), F.col("_mean"))).select(*df.columns)

    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, keys, _mean=F.avg(col))
        return part.withColumn(col, F.coalesce(F.col(col), F.col("_mean"))).drop("_mean")
    return by_group(df, keys, step, totals)


def fill_mean(df: DataFrame, col: str) -> DataFrame:
    """The overall mean is one value: a scalar subquery, not a join."""
    mean = df.agg(F.avg(col)).scalar()
    return df.withColumn(col, F.coalesce(F.col(col), mean))


def fill_when(df: DataFrame, cols: Sequence[str], cond: Column, value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(cond, F.coalesce(F.col(c), F.lit(value))).otherwise(F.col(c)) for c in cols})


# Industry levels as lengths of the dotted code "47.112".
INDUSTRY_LEVELS = {"n2": 2, "n3": 4, "n4": 5}


def code_prefixes(df: DataFrame, col: str, levels: Mapping[str, int] = INDUSTRY_LEVELS) -> DataFrame:
    return df.withColumns({name: F.substring(col, 1, n) for name, n in levels.items()})


def filter_prefix(df: DataFrame, col: str, n: int, values: Sequence[str] | DataFrame) -> DataFrame:
    """Codes whose prefix is in a list, or in the first column of another table (semi-join)."""
    if not isinstance(values, DataFrame):
        return df.where(F.substring(col, 1, n).isin(list(values)))
    wanted = values.select(F.substring(values.columns[0], 1, n).alias("_prefix")).distinct()
    return df.join(wanted, F.substring(df[col], 1, n) == wanted["_prefix"], "left_semi")


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(cols) if cols else None)


def missing_count(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNull().cast("int")
    return total


def split_complete(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Complete rows and rows with a gap."""
    return df.where(missing_count(cols) == 0), df.where(missing_count(cols) > 0)


def deny_ids(df: DataFrame, col: str, ids: Sequence[object]) -> DataFrame:
    """Rows whose id is not listed; rows without an id stay."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(list(ids)))


def set_when(df: DataFrame, target: str, *rules: tuple[Column, Column], default: Column | None = None) -> DataFrame:
    """First matching rule decides; without a match the default, else the old value."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return df.withColumn(target, out.otherwise(F.col(target) if default is None else default))


def relabel(df: DataFrame, col: str, mapping: Mapping[str, str], default: str = "keep",
            name: str | None = None) -> DataFrame:
    """Codes to labels; unknown codes are kept (``keep``) or become missing (``null``)."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    label = F.try_element_at(table, F.col(col))
    return df.withColumn(name or col, F.coalesce(label, F.col(col)) if default == "keep" else label)


def fix_unit_error(df: DataFrame, part: str, total: str, factor: float = 1000.0,
                   fallback: Column | str | None = None) -> DataFrame:
    """A part above its total was reported in the wrong unit; still above after dividing: other source."""
    fallback = F.col(fallback) if isinstance(fallback, str) else fallback
    small = F.col(part) / F.lit(factor)
    fixed = small if fallback is None else F.when(small > F.col(total), fallback).otherwise(small)
    return df.withColumn(part, F.when(F.col(part) > F.col(total), fixed).otherwise(F.col(part)))


def filter_range(df: DataFrame, col: str, low: object, high: object) -> DataFrame:
    return df.where(F.col(col).between(low, high))


def filter_selected(df: DataFrame, chosen: Mapping[str, object]) -> DataFrame:
    """``{column: values}``; the text ``All`` leaves a column unfiltered."""
    for col, values in chosen.items():
        if isinstance(values, str):
            values = [values]
        if "All" not in values:
            df = df.where(F.col(col).isin(list(values)))
    return df


def trim_outliers(df: DataFrame, col: str, k: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows within mean +- k sample standard deviations, overall or inside the group."""
    if not keys:
        mean, sd = df.agg(F.avg(col)).scalar(), df.agg(F.stddev_samp(col)).scalar()
        return df.where(F.col(col).between(mean - k * sd, mean + k * sd))

    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, keys, _m=F.avg(col), _s=F.stddev_samp(col))
        return part.where(F.col(col).between(F.col("_m") - k * F.col("_s"), F.col("_m") + k * F.col("_s"))) \
            .drop("_m", "_s")
    return by_group(df, keys, step)


def encode_codes(df: DataFrame, col: str, order: str | None = None, name: str | None = None) -> DataFrame:
    """Labels to integers from 0, by sorted label or, with ``order``, by first appearance."""
    codes = df.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.min(order if order else F.lit(0)).alias("_first"))
    codes = number_rows(codes, [], ["_first", col], "_code")
    return join_unique(df, codes.select(col, (F.col("_code") - 1).alias(name or f"{col}_code")), [col])


def min_class_size(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows of classes with at least ``n`` rows."""
    out = by_group(df, [col], lambda part, t: t.add(part, [col], _size=F.count(F.lit(1))))
    return out.where(F.col("_size") >= n).drop("_size")


def drop_zero_total(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Units whose parent total is zero or missing in any of the columns are dropped."""
    for c in cols:
        df = df.where(F.coalesce(F.col(c), F.lit(0.0)) != 0)
    return df


def add_residuals(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.withColumns({
        "residual": F.col(y) - F.col(yhat),
        "positive": (F.col(y) > 0).cast("int"),
        "negative_prediction": (F.col(yhat) < 0).cast("int"),
    })
