"""How good predictions are: regression errors, percentage errors, classification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_div
from .ordering import exact_percentiles


def regression_metrics(df: DataFrame, y: str, yhat: str, keys: Sequence[str] = (), exclude: Column | None = None,
                       n_features: int | None = None) -> DataFrame:
    """MSE, RMSE, MAE, median absolute error, R2 (and adjusted R2), overall or per group.

    ``exclude``: condition for rows left out. R2 = 1 - SSE / SST, missing where y does not vary.
    """
    keys = list(keys)
    if exclude is not None:
        df = df.where(~F.coalesce(exclude, F.lit(False)))
    df = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    err = F.col(y) - F.col(yhat)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - safe_div(F.sum(err * err), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))
    med = exact_percentiles(df.select(*keys, F.abs(err).alias("_e")), ["_e"], [0.5], keys) \
        .select(*keys, F.col("p0").alias("median_ae"))
    if keys:
        out = out.join(med, keys, "left")
    else:
        out = out.withColumn("median_ae", med.select("median_ae").scalar())
    out = out.withColumn("rmse", F.sqrt("mse")).select(*keys, "n", "mse", "rmse", "mae", "median_ae", "r2")
    return out if n_features is None else out.withColumn("adjusted_r2", adjusted_r2(F.col("r2"), F.col("n"), n_features))


def adjusted_r2(r2: Column, n: Column, p: int) -> Column:
    return F.lit(1.0) - safe_div((F.lit(1.0) - r2) * (n - 1), n - p - 1)


def pct_error(y: Column, yhat: Column) -> Column:
    """100 |y - yhat| / y; a missed zero counts 100, a correctly predicted zero is missing and drops out of means."""
    return F.when((y == 0) & (yhat == 0), F.lit(None)).when(y == 0, F.lit(100.0)) \
        .otherwise(safe_div(F.abs(y - yhat) * 100, y))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then rows ``accuracy``, ``macro avg``, ``weighted avg``.

    One aggregation to (actual, predicted) counts, the rest works on that small table.
    """
    pairs = df.groupBy(F.col(y).cast("string").alias("_y"), F.col(yhat).cast("string").alias("_p")).count()
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("_y").alias("label"), F.col("count").alias("support"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("_y") == F.col("_p"), F.col("count")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("count").alias("guessed"),
                 F.lit(0).cast("long").alias("hit")))).alias("_s")).select("_s.*")
    per = sides.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("_g"), F.sum("hit").alias("_h"))
    zero = F.lit(0.0)
    per = per.withColumns({"precision": F.coalesce(safe_div("_h", "_g"), zero),
                           "recall": F.coalesce(safe_div("_h", "support"), zero)})
    per = per.withColumn("f1", F.coalesce(safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return safe_div(F.sum(F.col(c) * F.col("support")), n).alias(c)
    cols = ["label", "precision", "recall", "f1", "support"]
    acc = safe_div(F.sum("_h"), n)
    return per.select(*cols) \
        .unionByName(per.agg(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), n.alias("support"))) \
        .unionByName(per.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], n.alias("support"))) \
        .unionByName(per.agg(F.lit("weighted avg").alias("label"), *[weighted(c) for c in ("precision", "recall", "f1")], n.alias("support")))


def backtest_published(df: DataFrame, published: DataFrame, key: Sequence[str], predicted: str, actual: str,
                       kind: str = "reg_type", multi: str = "02") -> tuple[DataFrame, DataFrame]:
    """Join to what was published (one row per key, complete rows): ``(rows with absolute difference, metrics)``
    for all units and for multi-unit ones."""
    one = published.groupBy(*key).agg(F.min(F.struct(actual, kind)).alias("_p")).select(*key, f"_p.{actual}", f"_p.{kind}")
    pred = df.groupBy(*key).agg(F.min(predicted).alias(predicted))
    rows = pred.join(one, list(key), "inner").dropna(subset=[predicted, actual]) \
        .withColumn("abs_diff", F.abs(F.col(predicted) - F.col(actual)))
    both = rows.withColumn("part", F.explode(F.when(F.col(kind) == multi, F.array(F.lit("all"), F.lit("multi")))
                                             .otherwise(F.array(F.lit("all")))))
    return rows, regression_metrics(both, actual, predicted, ["part"])
