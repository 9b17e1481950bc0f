"""Ordered computations inside groups: running sums, positions, ranks, lags, exact percentiles.

Ordinary groups use windows. Hot groups are range-partitioned on (keys, order), so one group spans many
slices; each slice is worked on alone and then shifted by what the slices before it add up to. That carry
has one row per slice and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffle_width
from .grouping import HotTotals, split_hot


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows with ``_slice``: all rows of slice i come before those of slice i+1 in (keys, order).

    Written to the shared folder, so that slice numbers are fixed once.
    """
    n = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *[_col(o) for o in order])
    return materialise(ranged.withColumn("_slice", F.spark_partition_id()), "sliced")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
            sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            hot: DataFrame | None | str = "find", before: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums and last non-missing values, both up to and including the row; ``before``: last non-missing values of the rows before it.

    ``order`` must be a total order inside the group. ``sums={'rn': F.lit(1)}`` numbers the rows.
    """
    sums, lasts, earlier = sums or {}, lasts or {}, before or {}
    cold, hot = split_hot(df, keys, hot)

    def local(part: DataFrame, extra: Sequence[str]) -> tuple[DataFrame, Window]:
        by = Window.partitionBy(*keys, *extra) if (keys or extra) else Window.partitionBy(F.lit(0))
        w = by.orderBy(*[_col(o) for o in order])
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cols = {n: F.sum(c).over(run) for n, c in sums.items()}
        cols |= {n: F.last(c, ignorenulls=True).over(run) for n, c in lasts.items()}
        cols |= {n: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n, c in earlier.items()}
        return part.withColumns(cols), w

    out, _ = local(cold, [])
    if hot is None:
        return out
    part, w = local(sliced(hot, keys, order), ["_slice"])
    ends = part.withColumn("_end", F.lead(F.lit(1)).over(w).isNull()).where("_end")
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_slice") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *[F.col(k).alias("_k_" + k) for k in keys], F.col("_slice").alias("_s"),
        *[F.sum(n).over(before).alias("_c_" + n) for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias("_c_" + n) for n in lasts],
        *[F.last(F.coalesce(c, n), ignorenulls=True).over(before).alias("_c_" + n) for n, c in earlier.items()])
    cond = part["_slice"] == carry["_s"]
    for k in keys:
        cond = cond & part[k].eqNullSafe(carry["_k_" + k])
    joined = part.join(F.broadcast(carry), cond, "left")
    fix = {n: F.col(n) + F.coalesce(F.col("_c_" + n), F.lit(0)) for n in sums}
    fix |= {n: F.coalesce(F.col(n), F.col("_c_" + n)) for n in (*lasts, *earlier)}
    return out.unionByName(joined.withColumns(fix).select(*out.columns))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    return running(df, keys, order, sums={name: F.lit(1).cast("long")})


def dense_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank",
                descending: bool = True) -> DataFrame:
    """Dense rank of ``value`` inside the group: the distinct values are numbered, then joined back."""
    way = F.col(value).desc() if descending else F.col(value).asc()
    cold, hot = split_hot(df, keys)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(way)
    out = cold.withColumn(name, F.dense_rank().over(w).cast("long"))
    if hot is None:
        return out
    ranks = materialise(number_rows(hot.select(*keys, value).distinct(), keys, [way], name), "ranks")
    ranks = ranks.select(*[F.col(c).alias("_r_" + c) for c in (*keys, value)], name)
    cond = F.lit(True)
    for c in (*keys, value):
        cond = cond & hot[c].eqNullSafe(ranks["_r_" + c])
    return out.unionByName(hot.join(ranks, cond, "left").select(*hot.columns, name))


def add_lags(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], col: str, n: int = 2,
             drop_incomplete: bool = True, hot: DataFrame | None | str = "find") -> DataFrame:
    """``col_lag1 .. col_lagN``: values of the previous rows of the unit; incomplete rows dropped on request."""
    names = [f"{col}_lag{i}" for i in range(1, n + 1)]
    cold, hot = split_hot(df, keys, hot)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*[_col(o) for o in order])
    out = cold.withColumns({name: F.lag(col, i).over(w) for i, name in enumerate(names, 1)})
    if hot is not None:
        # Positions make the lag an equality join, which spreads one long series over all tasks.
        rows = materialise(number_rows(hot, keys, order, "_lag_at"), "positions")
        base = rows
        for i, name in enumerate(names, 1):
            prev = base.select(*keys, (F.col("_lag_at") + i).alias("_lag_at"), F.col(col).alias(name))
            rows = rows.join(prev, [*keys, "_lag_at"], "left")
        out = out.unionByName(rows.select(*out.columns))
    return out.dropna(subset=names) if drop_incomplete else out


def exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles by linear interpolation: one row per (keys, ``column``), columns ``p0, p1, ..``.

    The built-in exact ``percentile`` keeps all distinct values of a group in one buffer, so it is used
    for ordinary groups only; for hot groups equal values are counted, ranked by running sums, and the
    two values around each position are picked.
    """
    cols, keys = list(cols), list(keys)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("_x")) \
        .select(*keys, "_x.column", "_x._v").where(F.col("_v").isNotNull())
    by = [*keys, "column"]
    cold, hot = split_hot(long, by)
    out = cold.groupBy(*by).agg(*[F.percentile("_v", p).alias(f"p{i}") for i, p in enumerate(probs)])
    if hot is None:
        return out
    counts = materialise(hot.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    ranked = HotTotals(by).add(running(counts, by, ["_v"], sums={"_hi": F.col("_n")}), by, _all=F.sum("_n"))

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("_hi") > pos) & (F.col("_hi") - F.col("_n") <= pos), F.col("_v")))

    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        aggs += [at(F.floor(pos)).alias(f"_a{i}"), at(F.ceil(pos)).alias(f"_b{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    picked = ranked.groupBy(*by).agg(*aggs).select(*by, *[
        (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(f"p{i}")
        for i in range(len(probs))])
    return out.unionByName(picked)


def exact_median(df: DataFrame, col: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_percentiles(df, [col], [0.5], keys).drop("column").withColumnRenamed("p0", name)
