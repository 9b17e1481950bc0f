"""Models by Spark ML: boosted trees, linear, random forest, cross-validation; imputers by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clip_low
from ..session import materialise
from .aggregate import impute_simple
from .clean import min_class_size
from .features import clean_features, feature_pipeline, fit_scaler, fold_of
from .gram import FRACTIONS, Components, stack_regress, with_components
from .hotdeck import in_share
from .joins import join_unique
from .knn import knn_regress
from .metrics import classification_report


class Fitted:
    """A fitted regressor with its feature steps; ``predict`` clips at 0."""

    def __init__(self, train: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, estimator, scaler: str = "robust"):
        self.num, self.cat, self.y = list(num), list(cat), y
        train = clean_features(train, num, cat)
        self.scaling = fit_scaler(train, num, scaler)
        pipe, self.cols = feature_pipeline(num, cat, self.scaling)
        ready = train.withColumns(self.cols).withColumn("label", F.col(y).cast("double"))
        self.steps = pipe.fit(ready)
        # Iterative fits read the features many times: written once, not recomputed per pass.
        features = materialise(self.steps.transform(ready).select("features", "label"), "features")
        self.model = estimator.fit(features)

    def predict(self, df: DataFrame, name: str = "predicted", clip: bool = True) -> DataFrame:
        ready = clean_features(df, self.num, self.cat).withColumns(self.cols)
        out = self.model.transform(self.steps.transform(ready))
        value = clip_low("prediction") if clip else F.col("prediction")
        return out.withColumn(name, value).select(*df.columns, name)

    def feature_names(self) -> list[str]:
        names = list(self.num)
        if self.cat:
            for labels, c in zip(self.steps.stages[0].labelsArray, self.cat):
                names += [f"{c}={v}" for v in labels]
        return names


BINS = 32


def bin_columns(train: DataFrame, num: Sequence[str], bins: int = BINS) -> dict[str, Column]:
    """``{_s_column: number of the quantile bin}``, cut at quantiles of all training rows; the bins are where trees may cut at all."""
    if not num:
        return {}
    spread = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.percentile_approx(c, spread, 10000).alias(f"c{i}") for i, c in enumerate(num)]).first()
    cuts = [sorted(set(r or [])) for r in row]
    return {"_s_" + c: sum([(F.col(c) > F.lit(v)).cast("double") for v in found], F.lit(0.0)) for c, found in zip(num, cuts)}


class FittedTrees(Fitted):
    """Boosted trees. Spark's trees see a number by its bin only, so rows that are equal in all bins and codes train as one row with
    their mean and, as its weight, their number: sums of weights, labels and residuals in every node are those of the rows.

    The iterations read one row per different (bins, codes), however many rows there are. ``grid``: parameters are chosen by the mean over the folds
    (``_fold`` of the training rows) of the absolute errors of rows, as Spark's cross-validation does.
    """

    def __init__(self, train: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, estimator: GBTRegressor, grid: Sequence[dict] = (), folds: int = 3):
        self.num, self.cat, self.y = list(num), list(cat), y
        train = clean_features(train, num, cat)
        fold = ["_fold"] if grid else []
        # Read for the bins, for the groups and, with a grid, for the errors of every fold.
        train = materialise(train.select(*num, *cat, F.col(y).cast("double").alias("label"), *fold), "train")
        self.cols = bin_columns(train, self.num)
        rows = train.withColumns(self.cols)
        whole = F.when(F.count("label") == F.count(F.lit(1)), F.avg("label"))      # a missing label stays one, and the fit reports it
        alike = materialise(rows.groupBy(*self.cols, *cat, *fold).agg(whole.alias("label"), F.count(F.lit(1)).cast("double").alias("weight")), "alike")
        self.steps = feature_pipeline(num, cat, {c: (0.0, 1.0) for c in self.num})[0].fit(alike)
        features = materialise(self.steps.transform(alike).select("features", "label", "weight", *fold), "features")
        estimator = estimator.setWeightCol("weight")
        self.model = estimator.fit(features, self._best(estimator, grid, folds, features, rows)) if grid else estimator.fit(features)

    def _best(self, estimator: GBTRegressor, grid: Sequence[dict], folds: int, features: DataFrame, rows: DataFrame) -> dict:
        errors = [0.0] * len(grid)
        for f in range(folds):
            part, tested = features.where(F.col("_fold") != f), self.steps.transform(rows.where(F.col("_fold") == f)).select("features", "label")
            if part.isEmpty():
                raise ValueError(f"no training rows beside fold {f}")
            for i, model in estimator.fitMultiple(part, list(grid)):
                tested = model.setPredictionCol(f"_p{i}").transform(tested)
            found = tested.agg(*[F.avg(F.abs(F.col("label") - F.col(f"_p{i}"))).alias(f"e{i}") for i in range(len(grid))]).first()      # one number per choice
            if found["e0"] is None:
                raise ValueError(f"no rows in fold {f}")
            errors = [e + found[f"e{i}"] for i, e in enumerate(errors)]
        return grid[errors.index(min(errors))]


def gbt_regress(train: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, grid: dict | None = None, scaler: str = "robust",
                max_iter: int = 20, max_depth: int = 5, folds: int = 3, fold_key: str | None = None, seed: int = 42) -> Fitted:
    """Boosted trees. ``grid``: {parameter: values} searched by cross-validation on folds given by a hash of ``fold_key``.

    Bins do not depend on the scale of a column, so ``scaler`` changes nothing here.
    """
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, maxBins=BINS, seed=seed)
    if not grid:
        return FittedTrees(train, num, cat, y, gbt)
    params = ParamGridBuilder()
    for name, values in grid.items():
        params = params.addGrid(gbt.getParam(name), list(values))
    return FittedTrees(train.withColumn("_fold", fold_of(F.col(fold_key), folds)), num, cat, y, gbt, params.build(), folds)


def linear_regress(train: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, scaler: str = "robust", ridge: float = 0.0) -> Fitted:
    return Fitted(train, num, cat, y, LinearRegression(featuresCol="features", labelCol="label", regParam=ridge, elasticNetParam=0.0), scaler)


def feature_importance(fitted: Fitted) -> DataFrame:
    """``(feature, importance)``, largest first; the model is small and lives on the driver."""
    weights = fitted.model.featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(fitted.feature_names(), weights)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def linear_by_group(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Line per group and one over all rows; errors of both per group, and overall with missing keys."""
    line = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]
    per = df.groupBy(*keys).agg(*line, F.avg(y).alias("_mean"))
    pooled = df.agg(*line)
    out = join_unique(df, per, keys).withColumns({
        "_own": F.coalesce(F.col("slope") * F.col(x) + F.col("intercept"), F.col("_mean")),
        "_all": pooled.select("slope").scalar() * F.col(x) + pooled.select("intercept").scalar()})
    errors = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(y) - F.col("_own"))).alias("mae_group"),
              F.avg(F.abs(F.col(y) - F.col("_all"))).alias("mae_pooled")]
    return out.groupBy(*keys).agg(*errors).unionByName(out.agg(*errors), allowMissingColumns=True)


def tree_classify(df: DataFrame, num: Sequence[str], cat: Sequence[str], label: str, id: str, min_rows: int = 50,
                  trees: int = 20, depth: int = 6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Random forest on classes of at least ``min_rows`` rows with median / most-frequent fill:
    ``(test rows with prediction, report)``; 80 % trains."""
    df = impute_simple(min_class_size(df, label, min_rows), num, cat)
    scaling = fit_scaler(df, num, "none")
    pipe, cols = feature_pipeline(num, cat, scaling)
    ready = df.withColumns(cols)
    indexer = StringIndexer(inputCol=label, outputCol="_index", handleInvalid="error").fit(ready)
    ready = materialise(pipe.fit(ready).transform(indexer.transform(ready)).select(id, F.col(label).alias("_label"), "_index", "features")
                        .withColumn("_train", in_share(F.col(id), F.lit(seed), "cccc")), "classes")
    model = RandomForestClassifier(featuresCol="features", labelCol="_index", numTrees=trees, maxDepth=depth, seed=seed).fit(ready.where("_train"))
    out = model.transform(ready.where("NOT _train"))
    out = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels).transform(out) \
        .select(id, F.col("_label").alias("actual"), "predicted")
    return out, classification_report(out, "actual", "predicted")


def pca_variance(df: DataFrame, cols: Sequence[str], n: int | float | None = 6, scaler: str = "standard", top: int = 5, cat: Sequence[str] = ()) -> DataFrame:
    """Per component: share of variance, cumulative share, and the columns with the largest loadings."""
    parts = Components(df, cols, cat, n, scaler)
    rows, total = [], 0.0
    for i in range(parts.n):
        total += float(parts.share[i])
        best = sorted(range(len(parts.loadings)), key=lambda j: (-round(abs(parts.loadings[j, i]), 9), j))[:top]
        rows.append((i + 1, float(parts.share[i]), total, [parts.columns.names[1 + j] for j in best]))
    return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double, top_columns array<string>")


def gbt_regress_pca(train: DataFrame, rows: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str, n: int | float | None = 6, scaler: str = "robust",
                    **options) -> DataFrame:
    """``(id, predicted)``: boosted trees over the principal components of scaled numbers and codes; ``options`` as for :func:`gbt_regress`."""
    fitted, asked, names = with_components(train.where(F.col(y).isNotNull()), rows, num, cat, y, id, n, scaler)
    return gbt_regress(fitted, names, [], y, scaler="none", **options).predict(asked).select(id, "predicted")


def learning_curve(df: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], y: str, id: str,
                   fractions: Sequence[float] = FRACTIONS, folds: int = 3, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(fraction, train_mean, train_sd, test_mean, test_sd)`` of any model at growing training sizes; by default MAE.

    ``fit_predict(train, rows)`` adds ``predicted``; ``score(actual, predicted)`` is averaged over the rows. Training sets are nested: a row's hash
    decides from which fraction on it takes part. The model is fitted once per fraction and fold; for lines and nearest neighbours
    :func:`linear_learning_curve` and :func:`knn_learning_curve` need one pass for all of them.
    """
    score = score or (lambda a, p: F.abs(a - p))
    t = materialise(df, "curve").withColumn("_fold_no", fold_of(F.col(id), folds)).withColumn(
        "_u", F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit("curve"))), 1, 6), 16, 10).cast("double") / float(16 ** 6))
    out = None
    for frac in fractions:
        for f in range(folds):
            used = (F.col("_fold_no") != f) & (F.col("_u") < frac)
            train = t.where(used).drop("_fold_no", "_u")
            rows = t.where(used | (F.col("_fold_no") == f)).withColumn("_tested", F.col("_fold_no") == f).drop("_fold_no", "_u")
            value = score(F.col(y), F.col("predicted"))
            part = fit_predict(train, rows).agg(F.avg(F.when(~F.col("_tested"), value)).alias("train"), F.avg(F.when(F.col("_tested"), value)).alias("test")).select(
                F.lit(float(frac)).alias("fraction"), F.lit(f).alias("fold"), "train", "test")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("fraction").agg(F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_sd"), F.avg("test").alias("test_mean"), F.stddev_pop("test").alias("test_sd"))


IMPUTERS: dict[str, Callable] = {
    "knn": lambda train, rows, num, cat, y, id: rows.join(knn_regress(train, rows, num, cat, y, id), id, "left"),
    "gbt": lambda train, rows, num, cat, y, id: gbt_regress(train, num, cat, y).predict(rows),
    "linear": lambda train, rows, num, cat, y, id: linear_regress(train, num, cat, y).predict(rows),
    "stack": lambda train, rows, num, cat, y, id: rows.join(stack_regress(train, rows, num, cat, y, id), id, "left"),
}


def impute_with(name: str, train: DataFrame, rows: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, id: str) -> DataFrame:
    """Predict with the imputer of that name: rows with ``predicted``."""
    if name not in IMPUTERS:
        raise ValueError(f"unknown imputer {name}; known: {sorted(IMPUTERS)}")
    return IMPUTERS[name](train, rows, num, cat, y, id)
