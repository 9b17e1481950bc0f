"""Joins. Join strategy is left to Spark: it knows the sizes at run time (adaptive broadcast, skew split).

Adaptive execution splits a skewed side only where both sides come straight from a shuffle. Where the other side
is an aggregate (ids, means, updates: one row per key) ``join_unique`` leaves the choice to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _on(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (left[k].eqNullSafe(right[k]) if null_safe else left[k] == right[k])
    return cond


def join_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                null_safe: bool = False) -> DataFrame:
    """Equi-join on 1-n keys. ``null_safe``: missing keys match each other (off by default)."""
    if not null_safe:
        return left.join(right, list(keys), how)
    other = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(other["_r_" + k])
    return left.join(other, cond, how).drop(*["_r_" + k for k in keys])


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join to a table with one row per key. Nothing is counted first: adaptive execution broadcasts ``right``
    where it turns out small, and splits a skewed left side otherwise."""
    return left.join(right, list(keys), how)


def anti_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` without an equal row in ``b``, over all common columns, missing equal to missing."""
    common = [c for c in a.columns if c in b.columns]
    other = b.select(*common).distinct()
    return a.join(other, _on(a, other, common, True), "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose key is (``present``) or is not in another table's ids."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return join_unique(df, wanted, [key], "left_semi" if present else "left_anti").select(*df.columns)


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str) -> DataFrame:
    """Value from a table with one row per ``table_key``, by a differently named key."""
    t = table.select(F.col(table_key).alias(key), F.col(value).alias(name))
    return join_unique(df, t, [key]).select(*df.columns, name)


def update_from(df: DataFrame, updates: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Overwrite where an update value exists, else keep. ``updates`` has one row per key."""
    u = updates.select(*keys, *[F.col(c).alias("_u_" + c) for c in cols])
    return join_unique(df, u, keys).withColumns(
        {c: F.coalesce(F.col("_u_" + c), F.col(c)) for c in cols}).select(*df.columns)


def update_matched(df: DataFrame, updates: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Matched rows take the update (missing update: 0), unmatched rows keep their value. One update per key."""
    u = updates.select(*keys, F.col(col).alias("_new"), F.lit(True).alias("_matched"))
    return join_unique(df, u, keys).withColumn(
        col, F.when(F.col("_matched"), F.coalesce(F.col("_new"), F.lit(0))).otherwise(F.col(col))
    ).select(*df.columns)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def symmetric_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur exactly once in the two tables together; counted map-side before the shuffle."""
    return a.unionByName(b).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(F.col(b.columns[0]).alias(key)))
