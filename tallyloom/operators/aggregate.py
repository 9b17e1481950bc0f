"""Aggregations. All are algebraic (partial sums before the shuffle), so hot groups stay cheap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_div
from .grouping import has_key
from .ordering import exact_percentiles


def _group(df: DataFrame, keys: Sequence[str]):
    return df.where(has_key(keys)).groupBy(*keys)


def group_sum(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "sum_") -> DataFrame:
    """Sums per group; a group of missing values sums to 0, rows without key are left out."""
    return _group(df, keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(prefix + c) for c in cols])


def sum_when(df: DataFrame, keys: Sequence[str], col: str, conds: Mapping[str, Column]) -> DataFrame:
    return _group(df, keys).agg(*[F.coalesce(F.sum(F.when(c, F.col(col))), F.lit(0.0)).alias(n)
                                  for n, c in conds.items()])


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "mean_") -> DataFrame:
    return _group(df, keys).agg(*[F.avg(c).alias(prefix + c) for c in cols])


def mean_of_ratios(df: DataFrame, num: str, den: str, keys: Sequence[str], name: str = "mean_ratio") -> DataFrame:
    """Mean of the per-row ratio; rows with a zero divisor do not count."""
    return _group(df, keys).agg(F.avg(safe_div(num, den)).alias(name))


def group_counts(df: DataFrame, keys: Sequence[str], value: str, distinct: str) -> DataFrame:
    return _group(df, keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(value) > 0).alias("n_positive"),
        F.count_distinct(distinct).alias("n_distinct"))


def row_max(cols: Sequence[str]) -> Column:
    return F.greatest(*[F.col(c) for c in cols])


def row_sum(cols: Sequence[str]) -> Column:
    """Sum over columns, missing as 0."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def dedup_none(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; all rows of a repeated key go."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r")) \
        .where("_n = 1").select(*keys, "_r.*").select(*df.columns)


def multi_level_totals(df: DataFrame, level_sets: Sequence[Sequence[str]], measures: Sequence[str],
                       ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Totals for several key sets in one pass, then ratios of totals (per employee and the like).

    ``level`` numbers the key set; keys outside the set are NULL.
    """
    keys = list(dict.fromkeys(k for s in level_sets for k in s))
    out = df.groupingSets([[F.col(k) for k in s] for s in level_sets], *keys).agg(
        F.grouping_id(*keys).alias("_gid"), *[F.sum(m).alias(m) for m in measures])
    level = F.lit(None).cast("int")
    for i, s in enumerate(level_sets):
        gid = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s)
        level = F.when(F.col("_gid") == gid, F.lit(i)).otherwise(level)
    return out.withColumn("level", level).withColumns(
        {n: safe_div(a, b) for n, (a, b) in ratios.items()}).drop("_gid")


def impute_simple(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """Missing numbers to the exact median, missing codes to the most frequent (ties: smallest)."""
    if num_cols:
        med = {r["column"]: r["p0"] for r in exact_percentiles(df, num_cols, [0.5]).collect()}  # one row per column
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in num_cols if c in med})
    for c in cat_cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).count()
        mode = counts.orderBy(F.desc("count"), "_v").limit(1).select("_v").scalar()
        df = df.withColumn(c, F.coalesce(F.col(c), mode))
    return df


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of missing values; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])
    return counts.select(F.inline(pairs))


def control_totals(parent: DataFrame, child: DataFrame, keys: Sequence[str],
                   pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Parent totals beside sums of allocated values: ``{name: (parent column, child column)}``."""
    p = _group(parent, keys).agg(*[F.sum(a).alias("parent_" + n) for n, (a, _) in pairs.items()])
    c = _group(child, keys).agg(*[F.sum(b).alias("child_" + n) for n, (_, b) in pairs.items()])
    out = p.join(c, list(keys), "left")
    return out.withColumns({"diff_" + n: F.col("parent_" + n) - F.coalesce(F.col("child_" + n), F.lit(0.0))
                            for n in pairs})


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin is closed. Empty bins are listed."""
    low, high = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    width = (high - low) / F.lit(float(bins))
    at = F.coalesce(F.floor(F.try_divide(F.col(col) - low, width)), F.lit(0))
    counts = df.where(F.col(col).isNotNull()).groupBy(
        F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"))


def fit_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("corr"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


def count_by_source(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    """Overall top k: each task keeps k rows, only those travel."""
    return df.orderBy(*by).limit(k)
