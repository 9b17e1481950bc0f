"""Nearest-neighbour models and imputation on the exact kernel of ``nearest``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_div, safe_denominator
from ..session import materialise
from .features import clean_features, distance_columns, distance_columns_by, fit_scaler, fit_scalers, fold_of, split_rows
from .grouping import Totals, by_group, first_rows
from .metrics import adjusted_r2, regression_metrics
from .nearest import nearest
from .partial import nearest_partial


def _prepare(train: DataFrame, rows: DataFrame, num: Sequence[str], cat: Sequence[str], scaler: str):
    train, rows = clean_features(train, num, cat), clean_features(rows, num, cat)
    scaling = fit_scaler(train, num, scaler)
    return distance_columns(train, train, num, cat, scaling), distance_columns(train, rows, num, cat, scaling)


def weighted_mean(y: str, weights: str, among: Column | None = None) -> Column:
    """Mean of the neighbours' y: ``uniform``, or by ``distance`` (1 / distance; where some are at distance 0, these alone count).
    An aggregate over rows with ``distance``; ``among`` restricts the rows."""
    among = F.lit(True) if among is None else among
    if weights == "uniform":
        return F.avg(F.when(among, F.col(y)))
    if weights != "distance":
        raise ValueError(f"unknown weights {weights}")
    here, inverse = F.when(among & (F.col("distance") == 0), F.col(y)), F.when(among & (F.col("distance") > 0), 1 / F.col("distance"))
    return F.coalesce(F.avg(here), safe_div(F.sum(inverse * F.col(y)), F.sum(inverse)))


def knn_regress(train: DataFrame, to_impute: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, k: int = 2,
                scaler: str = "robust", exclude_same: bool = False, weights: str = "uniform", power: float = 2) -> DataFrame:
    """``(id, predicted)``: mean y of the k nearest training rows in scaled + one-hot space.

    ``exclude_same``: training and imputed rows are the same table, each row is predicted from the others. ``weights``: see
    :func:`weighted_mean`; ``power``: of the Minkowski distance.
    """
    d, q = _prepare(train, to_impute, num, cat, scaler)
    near = nearest(q.withColumnRenamed(id, "_qid"), d, k, "_qid", id, cats="cats", exclude_same=exclude_same, carry=[y], power=power)
    return near.groupBy(F.col("_qid").alias(id)).agg(weighted_mean(y, weights).alias("predicted"))


def _earlier(periods: Sequence[int], time: str, strict: bool) -> Column:
    every = F.array(*[F.lit(int(p)) for p in periods])
    ok = F.filter(every, lambda p: p < F.col(time) if strict else p <= F.col(time))
    return F.transform(ok, lambda p: p.cast("string"))


def knn_regress_past(train: DataFrame, to_impute: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str,
                     time: str, k: int = 2, scaler: str = "robust", strict: bool = False,
                     exclude_same: bool = False) -> DataFrame:
    """As ``knn_regress``, with neighbours of the same or an earlier period only (``strict``: earlier only)."""
    d, q = _prepare(train, to_impute, num, cat, scaler)
    q = q.withColumn("_may", _earlier(_periods(train, time), time, strict)).withColumnRenamed(id, "_qid")
    near = nearest(q, d, k, "_qid", id, cats="cats", group=time, groups="_may", exclude_same=exclude_same, carry=[y])
    return near.groupBy(F.col("_qid").alias(id)).agg(F.avg(y).alias("predicted"))


def _near_by_part(train: DataFrame, test: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, k: int, scaler: str, power: float = 2) -> DataFrame:
    """``(_id, _for, distance, rank, y)``: the k nearest training rows of each tested row among those with the same ``_for``.

    Scaling and known codes of each part come from its own training rows, all in one grouped pass, and one search serves all parts;
    a training row stands once per part that it serves.
    """
    scalers = materialise(fit_scalers(train, num, "_for", scaler), "scalers")
    d = distance_columns_by(train, train, num, cat, "_for", scalers).select(id, F.col(y).alias("_y"), "vec", "cats", "_for")
    q = distance_columns_by(train, test, num, cat, "_for", scalers).select(F.struct(F.col(id).alias("id"), F.col("_for").alias("part")).alias("_qid"), "vec", "cats",
                                                                           F.array("_for").alias("_may"))
    near = nearest(q, d, k, "_qid", id, cats="cats", group="_for", groups="_may", carry=["_y"], power=power)
    return near.select(F.col("_qid.id").alias("_id"), F.col("_qid.part").alias("_for"), "distance", "rank", F.col("_y").alias(y))


def _periods(df: DataFrame, time: str) -> list[int]:
    return sorted(r[0] for r in df.select(time).distinct().collect())  # one row per year


def rolling_backtest(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, time: str, k: int = 2,
                     scaler: str = "robust") -> DataFrame:
    """Each year predicted from all earlier years, errors per year; years without history are skipped.

    Nothing of the tested year or a later one enters its scaling or its known codes: a code first seen in it is unknown.
    """
    df = clean_features(df, num, cat)
    tested = F.array(*[F.lit(p) for p in _periods(df, time)[1:]])
    train = df.withColumn("_for", F.explode(F.filter(tested, lambda p: p > F.col(time)))).withColumn("_for", F.col("_for").cast("string"))
    test = df.where(F.array_contains(tested, F.col(time))).withColumn("_for", F.col(time).cast("string"))
    pred = _near_by_part(train, test, num, cat, y, id, k, scaler).groupBy(F.col("_id").alias(id)).agg(F.avg(y).alias("predicted"))
    return regression_metrics(df.select(id, time, y).join(pred, id), y, "predicted", [time])


def rolling_backtest_cumulative(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, time: str, k: int = 2,
                                scaler: str = "robust") -> DataFrame:
    """Per year all rows up to it, split 80/20 by id; the test part predicted from the training part, which alone decides scaling and codes."""
    df = split_rows(clean_features(df, num, cat), id)
    every = F.array(*[F.lit(p) for p in _periods(df, time)])
    part = df.withColumn("_for", F.explode(F.filter(every, lambda p: p >= F.col(time)))).withColumn("_for", F.col("_for").cast("string"))
    near = _near_by_part(part.where("part = 'train'"), part.where("part = 'test'"), num, cat, y, id, k, scaler)
    pred = near.groupBy(F.col("_id").alias(id), F.col("_for").cast(df.schema[time].dataType).alias("_tested")).agg(F.avg(y).alias("predicted"))
    return regression_metrics(df.select(id, y).join(pred, id).withColumnRenamed("_tested", time), y, "predicted", [time])


def knn_grid(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, ks: Sequence[int] = (2, 3, 4, 5), weights: Sequence[str] = ("uniform", "distance"),
             powers: Sequence[float] = (1, 2), folds: int = 5, scaler: str = "standard") -> DataFrame:
    """``(k, weights, p, mean_score, sd_score, place)``: adjusted R2 over the folds for every choice, the best first.

    Every fold is predicted from the others, which alone decide its scaling and known codes. Neighbours are searched once per power, for the largest k;
    the values of all k and both weights are sums over the first of these. The adjustment counts all rows and the columns of ``num`` and ``cat``.
    """
    d = clean_features(df, num, cat).withColumn("_fold", fold_of(F.col(id), folds))
    others = F.filter(F.array(*[F.lit(i) for i in range(folds)]), lambda f: f != F.col("_fold"))
    train = d.withColumn("_for", F.explode(others)).withColumn("_for", F.col("_for").cast("string"))
    test = d.withColumn("_for", F.col("_fold").cast("string"))
    n = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    choices = [(k, w) for k in ks for w in weights]
    out = None
    for power in powers:
        near = _near_by_part(train, test, num, cat, y, id, max(ks), scaler, power)
        pred = near.groupBy(F.col("_id").alias(id)).agg(*[weighted_mean(y, w, F.col("rank") <= k).alias(f"_p{i}") for i, (k, w) in enumerate(choices)])
        rows = d.select(id, "_fold", y).join(pred, id)
        r2 = [(F.lit(1.0) - safe_div(F.sum((F.col(y) - F.col(f"_p{i}")) ** 2), F.var_pop(y) * F.count(F.lit(1)))).alias(f"_r{i}") for i in range(len(choices))]
        scores = [F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights"), F.lit(float(power)).alias("p"), adjusted_r2(F.col(f"_r{i}"), n, len(num) + len(cat)).alias("score"))
                  for i, (k, w) in enumerate(choices)]
        part = rows.groupBy("_fold").agg(*r2).select("_fold", F.explode(F.array(*scores)).alias("s")).select("s.*")
        out = part if out is None else out.unionByName(part)
    mean = out.groupBy("k", "weights", "p").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("sd_score"))
    best = Window.orderBy(F.desc_nulls_last(F.round("mean_score", 12)), "k", F.desc("weights"), "p")      # one row per choice
    return mean.withColumn("place", F.row_number().over(best)).orderBy("place")


def knn_best(train: DataFrame, rows: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, scaler: str = "standard", **grid) -> DataFrame:
    """``(id, predicted)`` by the best choice of :func:`knn_grid` on ``train``, refitted on all of it."""
    best = knn_grid(train, num, cat, y, id, scaler=scaler, **grid).where("place = 1").first()
    if best is None:
        return rows.select(id, F.lit(None).cast("double").alias("predicted")).where("false")
    return knn_regress(train, rows, num, cat, y, id, best["k"], scaler, weights=best["weights"], power=best["p"])


def _out_of_fold(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, k: int, folds: int, scaler: str) -> tuple[DataFrame, DataFrame]:
    """``(rows with _fold, k nearest rows of the other folds with their _y)``; all folds in one job."""
    d = clean_features(df, num, cat)
    d = distance_columns(d, d, num, cat, fit_scaler(d, num, scaler)).withColumn("_fold", fold_of(F.col(id), folds))
    others = F.filter(F.array(*[F.lit(i) for i in range(folds)]), lambda f: f != F.col("_fold"))
    q = d.withColumn("_may", F.transform(others, lambda f: f.cast("string"))).withColumnRenamed(id, "_qid")
    return d, nearest(q, d.withColumnRenamed(y, "_y"), k, "_qid", id, cats="cats", group="_fold", groups="_may", carry=["_y"])


def knn_out_of_fold(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, k: int = 2, folds: int = 5,
                    scaler: str = "robust") -> DataFrame:
    """``(id, predicted)``: every row predicted from the other folds."""
    _, near = _out_of_fold(df, num, cat, y, id, k, folds, scaler)
    return near.groupBy(F.col("_qid").alias(id)).agg(F.avg("_y").alias("predicted"))


def knn_cv(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, ks: Sequence[int] = (2, 3, 5, 7),
           folds: int = 5, scaler: str = "robust") -> DataFrame:
    """Mean and deviation of the fold MAE for every k. Distances are computed once, for the largest k."""
    d, near = _out_of_fold(df, num, cat, y, id, max(ks), folds, scaler)
    by_k = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    pred = by_k.groupBy(F.col("_qid").alias(id), "k").agg(F.avg("_y").alias("predicted"))
    fold = d.select(id, F.col(y), "_fold").join(pred, id).groupBy("k", "_fold").agg(F.avg(F.abs(F.col(y) - F.col("predicted"))).alias("mae"))
    return fold.groupBy("k").agg(F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("sd_mae"))


def knn_classify(train: DataFrame, rows: DataFrame, num: Sequence[str], cat: Sequence[str], label: str, id: str, k: int = 5,
                 scaler: str = "standard", exclude_same: bool = False) -> DataFrame:
    """``(id, predicted)``: majority label of the k nearest, ties to the smallest label."""
    d, q = _prepare(train, rows, num, cat, scaler)
    near = nearest(q.withColumnRenamed(id, "_qid"), d, k, "_qid", id, cats="cats", exclude_same=exclude_same, carry=[label])
    votes = near.groupBy(F.col("_qid").alias(id), label).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(id).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label"))).alias("_b")) \
        .select(id, F.col("_b.label").alias("predicted"))


def knn_impute(df: DataFrame, cols: Sequence[str], id: str, k: int = 3, by: str | None = None) -> DataFrame:
    """Fill every gap with the mean of the k nearest rows that have the value.

    Distances are Euclidean over the standardised columns both rows have, blown up by (columns / shared columns), found
    exactly whatever patterns the gaps make (:func:`nearest_partial`). A gap without any comparable donor takes the column mean.
    With ``by`` (a period) every value of it is standardised and filled on its own; ids have to differ over all of them.
    """
    cols = list(cols)
    z = df.select(id, *([by] if by else []), *[F.col(c).cast("double").alias(c) for c in cols])
    z = z.withColumn("_by", F.col(by) if by else F.lit(0))
    scalers = materialise(fit_scalers(z, cols, "_by", "standard"), "scalers")
    z = z.join(scalers.withColumnRenamed("_by", "_b"), F.col("_by").eqNullSafe(F.col("_b"))).drop("_b")
    unit = [((F.col(c) - F.col("center")[i]) / F.col("scale")[i]).alias(c) for i, c in enumerate(cols)]
    near = nearest_partial(z.select(id, "_by", *unit), cols, id, k, "_by")
    means = near.groupBy(id).agg(*[F.avg(F.when(F.col("column") == i, F.col("value"))).alias("_m_" + c) for i, c in enumerate(cols)])
    return z.join(means, id, "left").select(id, *([by] if by else []), *[
        F.coalesce(F.col(c), F.col("_m_" + c) * F.col("scale")[i] + F.col("center")[i], F.col("center")[i]).alias(c) for i, c in enumerate(cols)])


def rescale_to_parent(df: DataFrame, pred: str, keys: Sequence[str], total: str, name: str = "rescaled",
                      totals: Totals | None = None) -> DataFrame:
    """Predictions x parent total / sum of predictions, so that the units of a parent add up."""
    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, keys, _sum=F.sum(pred))
        return part.withColumn(name, safe_div(pred, "_sum") * F.col(total)).drop("_sum")
    return by_group(df, keys, step, totals)


def local_frame(units: DataFrame, enterprises: DataFrame, coords: DataFrame, target: object, unit: str = "orgnr_bedrift",
                parent: str = "orgnr_foretak", codes: tuple[str, str] = ("naring3", "naring_f_3")) -> DataFrame:
    """Units that share an own or a parent industry with one enterprise, with the parent's turnover per employee and per
    unit, and place; units without place are dropped. A parent without employees counts as having one."""
    mine = units.where(F.col(parent) == target)
    df = units
    for i, c in enumerate(codes):
        wanted = mine.select(F.col(c).alias("_w")).distinct().withColumn(f"_hit{i}", F.lit(True))
        df = df.join(wanted, df[c] == wanted["_w"], "left").drop("_w")
    df = df.where(F.col("_hit0") | F.col("_hit1")).drop("_hit0", "_hit1")
    df = by_group(df, [parent], lambda part, t: t.add(part, [parent], bedrift_count=F.count(F.lit(1))))
    ent = enterprises.select(parent, F.col("omsetning").alias("omsetning_foretak"),
                             safe_denominator("sysselsetting_syss", 1.0).alias("sysselsetting_foretak"),
                             F.col("nopost_driftskostnader").alias("nopost_driftskostnader_foretak"))
    df = first_rows(df.join(ent, parent, "left"), [unit], [parent])
    df = df.withColumns({"oms_per_syss_foretak": safe_div("omsetning_foretak", "sysselsetting_foretak"),
                         "oms_per_bedrift_foretak": safe_div("omsetning_foretak", "bedrift_count")})
    return df.join(coords.select(unit, "x_koordinat", "y_koordinat"), unit, "left").dropna(
        subset=["x_koordinat", "y_koordinat", "omsetning_foretak", "nopost_driftskostnader_foretak",
                "oms_per_syss_foretak", "oms_per_bedrift_foretak"])


LOCAL_FEATURES = ["x_koordinat", "y_koordinat", "sysselsetting_syss", "omsetning_foretak", "nopost_driftskostnader_foretak",
                  "oms_per_syss_foretak", "oms_per_bedrift_foretak"]


def local_knn(units: DataFrame, enterprises: DataFrame, coords: DataFrame, target: object, unit: str = "orgnr_bedrift",
              parent: str = "orgnr_foretak", cat: Sequence[str] = ("naring",), y: str = "omsetning", k: int = 5) -> DataFrame:
    """Predict the turnover of held-out enterprises' units from nearby similar units and scale it to the enterprise.

    The split keeps the units of an enterprise together. Columns ``predicted`` and ``new_predicted`` are added.
    """
    df = split_rows(local_frame(units, enterprises, coords, target, unit, parent), parent)
    train, test = df.where("part = 'train'").drop("part"), df.where("part = 'test'").drop("part")
    pred = knn_regress(train, test, LOCAL_FEATURES, list(cat), y, unit, k, "standard")
    return rescale_to_parent(test.join(pred, unit), "predicted", [parent], "omsetning_foretak", "new_predicted")


def foreign_neighbours(df: DataFrame, parent: str, value: object, features: Sequence[str], id: str, k: int = 5) -> DataFrame:
    """Own units of one enterprise and the distinct k nearest units of other enterprises (``own`` tells which)."""
    ready = df.withColumn("vec", F.array(*[F.col(c).cast("double") for c in features]))
    own, other = ready.where(F.col(parent) == value), ready.where(F.col(parent) != value)
    near = nearest(own.withColumnRenamed(id, "_qid"), other, k, "_qid", id)
    picked = df.join(near.select(id).distinct(), id, "left_semi").withColumn("own", F.lit(0))
    return df.where(F.col(parent) == value).withColumn("own", F.lit(1)).unionByName(picked)
