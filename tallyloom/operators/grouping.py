"""Group values on every row, safe for groups of any size.

A window over ``partitionBy(key)`` brings a whole group to one task. That is the cheapest plan for
ordinary groups (consecutive windows on the same key share one shuffle), and it breaks for a key that
holds a large part of the table. So every grouped operator runs in two parts:

* ordinary groups: window functions;
* hot groups, those above ``tallyloom.hotRows`` rows: aggregate (map-side partial sums), then join the
  result back. Every group above the threshold is treated this way, so no window ever holds more rows of a key than that.
  The keys are a written table, never a list on the driver; joins with it carry no hint, so adaptive
  execution broadcasts it where it is small and splits the skewed side where it is not.

``tallyloom.hotRows`` is a setting of the session (default 1,000,000): what one task is allowed to sort for one key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffles_end

HOT_ROWS = 1_000_000


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("tallyloom.hotRows", str(HOT_ROWS)))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right["_hot_" + k])
    return cond


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """All groups above the row threshold as a written table, or None if there is none.

    One pass over the key columns with map-side counts; only where some group is hot is a table of them written.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows(df))
    hot = counts.select(*[F.col(k).alias("_hot_" + k) for k in keys])
    with shuffles_end(df.sparkSession):
        none = hot.isEmpty()
    return None if none else materialise(hot, "hot")


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame | None | str = "find") -> tuple[DataFrame, DataFrame | None]:
    """``(ordinary rows, rows of hot groups or None)``. Without keys the whole table is one group.

    ``hot``: the result of an earlier ``hot_keys`` on the same groups, to save the count.
    """
    if not keys:
        big = df.count() > hot_rows(df)
        return (df.limit(0), df) if big else (df, None)
    if isinstance(hot, str):
        hot = hot_keys(df, keys)
    if hot is None:
        return df, None
    cold = df.join(hot, _null_safe(df, hot, keys), "left_anti")
    warm = df.join(hot, _null_safe(df, hot, keys), "left_semi")
    return cold, warm


class WindowTotals:
    """Group values by window; for groups of bounded size."""

    def add(self, df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.withColumns({n: F.when(has_key(keys), a.over(w)) for n, a in aggs.items()})


class HotTotals:
    """Group values by aggregation and join; for the groups of unbounded size.

    The input is written before the first call of a chain and again after every ``EVERY`` calls, where the plan has grown.
    """

    EVERY = 4

    def __init__(self, keys: Sequence[str]):
        self.keys, self.calls = tuple(keys), 0

    def add(self, df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
        df = df.drop(*aggs)
        if self.calls % self.EVERY == 0:
            df = materialise(df, "hot")
        self.calls += 1
        if not keys:
            total = df.agg(*[a.alias(n) for n, a in aggs.items()])
            return df.withColumns({n: total.select(n).scalar() for n in aggs})
        totals = df.where(has_key(keys)).groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
        # A plain join on a written table, which adaptive execution broadcasts if small and splits if skewed.
        totals = materialise(totals, "totals")
        return df.join(totals, list(keys), "left").select(*df.columns, *aggs)


def has_key(keys: Sequence[str]) -> Column:
    """True where no key is missing: rows without a key belong to no group."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


Totals = WindowTotals | HotTotals
Step = Callable[[DataFrame, Totals], DataFrame]


def by_group(df: DataFrame, keys: Sequence[str], step: Step, totals: Totals | None = None,
             source: DataFrame | None = None) -> DataFrame:
    """Run ``step(rows, totals)`` on ordinary and on hot groups and put the rows together.

    ``totals`` given: the caller has split already (a chain splits once, not once per operator). ``source``: an
    earlier table whose groups are at least as large and cheaper to count, such as one side before a join.
    """
    if totals is not None:
        return step(df, totals)
    cold, warm = split_hot(df, keys, hot_keys(source, keys) if source is not None and keys else "find")
    out = step(cold, WindowTotals())
    if warm is None:
        return out
    return out.unionByName(step(warm, HotTotals(keys)))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """First ``k`` rows per group in the declared order.

    ``row_number <= k`` is planned as a group limit before and after the shuffle, so a hot group sends
    at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
