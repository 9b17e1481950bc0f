"""Scaling, codes and splits for models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .grouping import has_key
from .hotdeck import in_share
from .joins import join_unique
from .ordering import exact_percentiles, number_rows, running

Scaling = Mapping[str, tuple[float, float]]


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "robust") -> dict[str, tuple[float, float]]:
    """``{column: (center, scale)}``: ``robust`` median and quartile range (exact), ``standard`` mean and
    population deviation, ``minmax`` minimum and range, ``none``. A scale of 0 becomes 1."""
    cols = list(cols)
    if kind == "none":
        return {c: (0.0, 1.0) for c in cols}
    if kind == "robust":
        rows = exact_percentiles(df, cols, [0.25, 0.5, 0.75]).collect()  # one row per column
        found = {r["column"]: (r["p1"], r["p2"] - r["p0"]) for r in rows}
    else:
        a, b = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        row = df.agg(*[a(c).cast("double").alias(f"a{i}") for i, c in enumerate(cols)],
                     *[b(F.col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(cols)]).first()
        found = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols) if row[f"a{i}"] is not None}
    return {c: (found[c][0], found[c][1] or 1.0) if c in found else (0.0, 1.0) for c in cols}


def fit_scalers(df: DataFrame, cols: Sequence[str], key: str, kind: str = "robust") -> DataFrame:
    """``(key, center, scale)``: :func:`fit_scaler` for every value of ``key`` in one grouped pass; arrays in the order of ``cols``."""
    cols = list(cols)
    if kind == "none" or not cols:
        zero, one = (F.array(*[F.lit(x)] * len(cols)).cast("array<double>") for x in (0.0, 1.0))
        return df.select(key).distinct().select(key, zero.alias("center"), one.alias("scale"))
    if kind == "robust":
        by_column = exact_percentiles(df, cols, [0.25, 0.5, 0.75], [key]).groupBy(key).agg(
            F.map_from_entries(F.collect_list(F.struct("column", F.struct(F.col("p1").alias("a"), (F.col("p2") - F.col("p0")).alias("b"))))).alias("m"))
        pairs = [(F.col("m")[c]["a"], F.col("m")[c]["b"]) for c in cols]
    else:
        a, b = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        by_column = df.groupBy(key).agg(*[a(c).cast("double").alias(f"_a{i}") for i, c in enumerate(cols)], *[b(F.col(c)).cast("double").alias(f"_b{i}") for i, c in enumerate(cols)])
        pairs = [(F.col(f"_a{i}"), F.col(f"_b{i}")) for i in range(len(cols))]
    scale = [F.when(F.coalesce(b, F.lit(0.0)) == 0, 1.0).otherwise(b) for _, b in pairs]
    return by_column.select(key, F.array(*[F.coalesce(a, F.lit(0.0)) for a, _ in pairs]).alias("center"), F.array(*scale).alias("scale"))


def distance_columns_by(train: DataFrame, df: DataFrame, num: Sequence[str], cat: Sequence[str], key: str, scalers: DataFrame) -> DataFrame:
    """:func:`distance_columns` where scaling and known codes are those of the training rows with the same ``key``."""
    out = df.join(scalers, key)
    numbers = F.array(*[F.col(c).cast("double") for c in num]) if num else F.array().cast("array<double>")
    out = out.withColumn("vec", F.zip_with(F.zip_with(numbers, "center", lambda x, c: x - c), "scale", lambda x, s: x / s)).drop("center", "scale")
    hashed = []
    for c in cat:
        known = train.select(key, c).distinct().withColumn("_known", F.lit(True))
        out = join_unique(out, known, [key, c])
        out = out.withColumn("_h_" + c, F.when(F.col("_known"), F.xxhash64(c)).otherwise(F.lit(0))).drop("_known")
        hashed.append("_h_" + c)
    cats = F.array(*hashed).cast("array<bigint>") if hashed else F.array().cast("array<bigint>")
    return out.withColumn("cats", cats).drop(*hashed)


def scaled(scaling: Scaling, col: str) -> Column:
    center, scale = scaling[col]
    return (F.col(col) - F.lit(float(center))) / F.lit(float(scale))


def clean_features(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Missing numbers to 0, missing codes to ``missing``."""
    return df.withColumns({**{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in num},
                           **{c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in cat}})


def distance_columns(train: DataFrame, df: DataFrame, num: Sequence[str], cat: Sequence[str],
                     scaling: Scaling) -> DataFrame:
    """Add ``vec`` (scaled numbers) and ``cats`` (hashed codes, 0 = code not in the training rows)."""
    out = df.withColumn("vec", F.array(*[scaled(scaling, c) for c in num]) if num else F.array().cast("array<double>"))
    hashed = []
    for c in cat:
        known = train.select(c).distinct().withColumn("_known", F.lit(True))
        out = join_unique(out, known, [c])
        out = out.withColumn("_h_" + c, F.when(F.col("_known"), F.xxhash64(c)).otherwise(F.lit(0))).drop("_known")
        hashed.append("_h_" + c)
    cats = F.array(*hashed).cast("array<bigint>") if hashed else F.array().cast("array<bigint>")
    return out.withColumn("cats", cats).drop(*hashed)


def feature_pipeline(num: Sequence[str], cat: Sequence[str], scaling: Scaling) -> tuple[Pipeline, dict[str, Column]]:
    """Spark ML pipeline to ``features`` and the scaled columns it reads (add them with ``withColumns``).

    Unknown codes give all zeros, known ones keep their own slot.
    """
    cols = {"_s_" + c: scaled(scaling, c) for c in num}
    stages = []
    if cat:
        stages += [StringIndexer(inputCols=list(cat), outputCols=["_i_" + c for c in cat], handleInvalid="keep"),
                   OneHotEncoder(inputCols=["_i_" + c for c in cat], outputCols=["_o_" + c for c in cat])]
    stages.append(VectorAssembler(inputCols=[*cols, *["_o_" + c for c in cat]], outputCol="features"))
    return Pipeline(stages=stages), cols


# ---- splits: decided by the md5 of a key, so they do not change from run to run

def split_rows(df: DataFrame, key: str, seed: object = 42, train_hex: str = "cccc") -> DataFrame:
    """``part`` = train or test; ``cccc`` is 80 %. With a parent id as key all units of a parent stay together."""
    return df.withColumn("part", F.when(in_share(F.col(key), F.lit(seed), train_hex), "train").otherwise("test"))


def _first_share(df: DataFrame, keys: Sequence[str], coarse: Column, order: Sequence[str], share: float) -> DataFrame:
    """``part``: the first ``share`` of the rows of each group in the declared order trains. ``coarse`` never falls along that order.

    The last training row is found by counts per value of ``coarse``; only rows with its value are ranked one by one, all others are before or
    behind it. Rows without a key are tested.
    """
    keys = list(keys)
    df = df.withColumn("_at", F.struct(coarse.alias("v")))      # a struct: a missing value compares as the smallest
    counts = materialise(df.where(has_key(keys)).groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n")), "counts")
    last = F.floor(F.col("_all") * share + F.lit(1e-9))
    up_to = running(counts, keys, ["_at"], sums={"_hi": F.col("_n")})
    if keys:
        up_to = join_unique(up_to, counts.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    else:
        up_to = up_to.withColumn("_all", counts.agg(F.sum("_n")).scalar())
    cut = up_to.where((F.col("_hi") >= last) & (F.col("_hi") - F.col("_n") < last)) \
        .select(*keys, F.col("_at").alias("_cut"), (last - F.col("_hi") + F.col("_n")).alias("_left"))
    cut = materialise(cut, "cut")                               # at most one row per group
    if keys:
        df = join_unique(df, cut, keys)
    else:
        df = df.withColumns({c: cut.select(c).scalar() for c in ("_cut", "_left")})
    edge = F.coalesce(F.col("_at") == F.col("_cut"), F.lit(False))
    ranked = number_rows(df.where(edge), keys, order, "_rn")
    part = lambda train: F.when(train, "train").otherwise("test")
    return df.where(~edge).withColumn("part", part(F.col("_at") < F.col("_cut"))) \
        .unionByName(ranked.withColumn("part", part(F.col("_rn") <= F.col("_left"))).drop("_rn")).drop("_at", "_cut", "_left")


def split_stratified(df: DataFrame, label: str, key: str, seed: object = 42, share: float = 0.8) -> DataFrame:
    """The same share of every class, in the order of the hash."""
    draw = df.withColumn("_m", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    return _first_share(draw, [label], F.substring("_m", 1, 4), ["_m", key], share).drop("_m")


def split_ordered(df: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """First part of the rows in the declared order trains, the rest tests."""
    return _first_share(df, [], F.col(order[0]), order, share)


def fold_of(key: Column, folds: int, seed: object = 42) -> Column:
    """Fold number from the first hash digits."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 6)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(folds)).cast("int")
