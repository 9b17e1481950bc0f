"""Model, imputation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import boost, features, gram, hotdeck, knn, metrics, models
from tallyloom.session import materialise

from .registry import query

# ---------------------------------------------------------------- rows with numeric features, a code, a label and a year

NUM = ["f1", "f2", "f3", "f4", "f5", "f6"]
FEAT = f"""feat AS (SELECT vec_id AS id, label, 'L' || CAST(label // 3 AS VARCHAR) AS code, 2000 + label AS year,
  {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS f{i + 1}' for i in range(6))}, CAST(embedding[7] AS DOUBLE) * 1000 AS y FROM embeddings)"""


def feat(t):
    e = F.col("embedding")
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", F.concat(F.lit("L"), F.floor(F.col("label") / 3).cast("string")).alias("code"),
                               (F.col("label") + 2000).alias("year"), *[e[i].cast("double").alias(f"f{i + 1}") for i in range(6)],
                               (e[6].cast("double") * 1000).alias("y"))


def z_sql(kind: str = "robust") -> str:
    if kind == "robust":
        pars = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in NUM)
    else:
        pars = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
    return f"""{FEAT}, par AS (SELECT {pars} FROM feat),
z AS (SELECT id, label, code, year, y, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in NUM)} FROM feat, par)"""


DIST = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUM)


def near_sql(where: str, code: bool = True, kind: str = "robust") -> str:
    d = f"{DIST} + CASE WHEN a.code <> b.code THEN 2 ELSE 0 END" if code else DIST
    return f"""{z_sql(kind)}, near AS (SELECT a.id, a.label, a.year, a.y AS own, b.id AS did, b.y, b.label AS dlabel, b.year AS dyear,
  row_number() OVER (PARTITION BY a.id ORDER BY round({d}, 9), b.id) AS rank FROM z a JOIN z b ON {where})"""


@query("feature_scaling", f"""
WITH {FEAT}, p AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS q_{c}, avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS l_{c}, max({c}) - min({c}) AS w_{c}' for c in ('f1', 'f2'))} FROM feat)
SELECT id, {', '.join(f'({c} - m_{c}) / q_{c} AS {c}_robust, ({c} - a_{c}) / s_{c} AS {c}_standard, ({c} - l_{c}) / w_{c} AS {c}_minmax' for c in ('f1', 'f2'))} FROM feat, p""",
       dbl="f1_robust f1_standard f1_minmax f2_robust f2_standard f2_minmax")
def feature_scaling(t):
    df, cols = feat(t), {}
    for kind in ("robust", "standard", "minmax"):
        par = features.fit_scaler(df, ["f1", "f2"], kind)
        cols |= {f"{c}_{kind}": features.scaled(par, c) for c in ("f1", "f2")}
    return df.withColumns(cols).select("id", *cols)


SPLIT = "CASE WHEN substring(md5(CAST({} AS VARCHAR) || ':42'), 1, 4) < 'cccc' THEN 'train' ELSE 'test' END"


@query("split_rows", f"""SELECT o_orderkey, {SPLIT.format('o_orderkey')} AS by_row, {SPLIT.format('o_custkey')} AS by_group FROM orders""")
def split_rows(t):
    df = features.split_rows(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").withColumnRenamed("part", "by_row")
    return features.split_rows(df, "o_custkey").select("o_orderkey", "by_row", F.col("part").alias("by_group"))


@query("split_stratified", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT r.o_orderkey, CASE WHEN r.rn <= floor(r.n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS stratified, CASE WHEN o.rn <= floor(o.n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS ordered FROM r JOIN o USING (o_orderkey)""")
def split_stratified(t):
    df = features.split_stratified(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderstatus", "o_orderkey").withColumnRenamed("part", "stratified")
    return features.split_ordered(df, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "stratified", F.col("part").alias("ordered"))


# ---------------------------------------------------------------- nearest neighbours

WIDE = [f"e{i + 1}" for i in range(64) if i != 6]      # all values but the one that is predicted
WIDE_DIST = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in WIDE)


def wide(t):
    e = F.col("embedding")
    return t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.floor(F.col("label") / 3).cast("string")).alias("code"), (e[6].cast("double") * 1000).alias("y"),
                               *[e[int(c[1:]) - 1].cast("double").alias(c) for c in WIDE])


@query("knn_regress", f"""
WITH feat AS (SELECT vec_id AS id, 'L' || CAST(label // 3 AS VARCHAR) AS code, CAST(embedding[7] AS DOUBLE) * 1000 AS y, {', '.join(f'CAST(embedding[{c[1:]}] AS DOUBLE) AS {c}' for c in WIDE)} FROM embeddings),
par AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}' for c in WIDE)} FROM feat),
z AS (SELECT id, code, y, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in WIDE)} FROM feat, par),
near AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY round({WIDE_DIST} + CASE WHEN a.code <> b.code THEN 2 ELSE 0 END, 9), b.id) AS rank FROM z a JOIN z b ON a.id <> b.id)
SELECT id, avg(y) AS predicted FROM near WHERE rank <= 2 GROUP BY 1""", dbl="predicted")
def knn_regress(t):
    return knn.knn_regress(wide(t), wide(t), WIDE, ["code"], "y", "id", exclude_same=True)


@query("knn_regress_past", f"WITH {near_sql('a.id <> b.id AND b.year <= a.year')} SELECT id, avg(y) AS predicted FROM near WHERE rank <= 2 GROUP BY 1", dbl="predicted")
def knn_regress_past(t):
    return knn.knn_regress_past(feat(t), feat(t), NUM, ["code"], "y", "id", "year", exclude_same=True)


def period_sql(train: str, test: str) -> str:
    """Errors per tested year ``t.year``; ``train`` and ``test`` choose rows f and a. Scaling and known codes come from the training rows."""
    pars = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in NUM)
    d = " + ".join(f"((a.{c} - m_{c}) / s_{c} - (f.{c} - m_{c}) / s_{c}) ** 2" for c in NUM)
    return f"""
WITH {FEAT}, t AS (SELECT DISTINCT year FROM feat), tr AS (SELECT t.year AS ty, f.* FROM t JOIN feat f ON {train}), te AS (SELECT t.year AS ty, a.* FROM t JOIN feat a ON {test}),
par AS (SELECT ty, {pars} FROM tr GROUP BY ty), codes AS (SELECT DISTINCT ty, code FROM tr),
near AS (SELECT a.ty, a.id, a.y AS own, f.y, row_number() OVER (PARTITION BY a.ty, a.id ORDER BY round({d} + CASE WHEN a.code = f.code THEN 0 WHEN c.code IS NULL THEN 1 ELSE 2 END, 9), f.id) AS rank
  FROM te a JOIN par USING (ty) JOIN tr f USING (ty) LEFT JOIN codes c ON c.ty = a.ty AND c.code = a.code),
p AS (SELECT ty AS year, id, own, avg(y) AS predicted FROM near WHERE rank <= 2 GROUP BY 1, 2, 3)
SELECT year, count(*) AS n, avg((own - predicted) ** 2) AS mse, sqrt(avg((own - predicted) ** 2)) AS rmse, avg(abs(own - predicted)) AS mae, quantile_cont(abs(own - predicted), 0.5) AS median_ae,
  1 - sum((own - predicted) ** 2) / (var_pop(own) * count(*)) AS r2 FROM p GROUP BY 1"""


@query("rolling_backtest", period_sql("f.year < t.year", "a.year = t.year"), dbl="mse rmse mae median_ae r2", digits=4)
def rolling_backtest(t):
    return knn.rolling_backtest(feat(t), NUM, ["code"], "y", "id", "year")


@query("rolling_backtest_cumulative", period_sql(f"f.year <= t.year AND {SPLIT.format('f.id')} = 'train'", f"a.year <= t.year AND {SPLIT.format('a.id')} = 'test'"),
       dbl="mse rmse mae median_ae r2", digits=4)
def rolling_backtest_cumulative(t):
    return knn.rolling_backtest_cumulative(feat(t), NUM, ["code"], "y", "id", "year")


FOLD = "CAST(('0x' || substring(md5(CAST({} AS VARCHAR) || ':42'), 1, 6)) AS BIGINT) % 5"


@query("knn_cv", f"""
WITH {near_sql(FOLD.format('a.id') + ' <> ' + FOLD.format('b.id'))}, p AS (SELECT k, id, own, {FOLD.format('id')} AS fold, avg(y) AS predicted FROM near JOIN (SELECT unnest([2, 3, 5, 7]) AS k) ON rank <= k GROUP BY 1, 2, 3),
m AS (SELECT k, fold, avg(abs(own - predicted)) AS mae FROM p GROUP BY 1, 2) SELECT CAST(k AS INTEGER) AS k, avg(mae) AS mean_mae, stddev_pop(mae) AS sd_mae FROM m GROUP BY 1""", dbl="mean_mae sd_mae", digits=4)
def knn_cv(t):
    return knn.knn_cv(feat(t), NUM, ["code"], "y", "id")


def grid_sql(rows: str, name: str = "") -> str:
    """Adjusted R2 by fold of every (k, weights, p), from ``rows``: each fold by the others, which decide its scaling."""
    pars = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
    diffs = [f"abs((a.{c} - m_{c}) / s_{c} - (f.{c} - m_{c}) / s_{c})" for c in NUM]
    codes = "CASE WHEN a.code = f.code THEN 0 ELSE 2 END"
    dist = {1: " + ".join(diffs), 2: " + ".join(f"{d} ** 2" for d in diffs)}
    near = " UNION ALL ".join(f"""SELECT {p} AS p, a.id, a.fold, a.y AS own, f.y, round({dist[p]} + {codes}, 9) ** (1.0 / {p}) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY round({dist[p]} + {codes}, 9), f.id) AS rank FROM r{name} a JOIN par{name} USING (fold) JOIN r{name} f ON f.fold <> a.fold""" for p in (1, 2))
    return f"""r{name} AS (SELECT *, {FOLD.format('id')} AS fold FROM {rows}), t{name} AS (SELECT DISTINCT fold FROM r{name}), par{name} AS (SELECT t{name}.fold, {pars} FROM t{name} JOIN r{name} o ON o.fold <> t{name}.fold GROUP BY 1),
near{name} AS ({near}), p{name} AS (SELECT p, id, fold, own, k, avg(y) AS uniform, coalesce(avg(CASE WHEN d = 0 THEN y END), sum(CASE WHEN d > 0 THEN y / d END) / sum(CASE WHEN d > 0 THEN 1 / d END)) AS distance
  FROM near{name} JOIN (SELECT unnest([2, 3, 4, 5]) AS k) ON rank <= k GROUP BY 1, 2, 3, 4, 5),
u{name} AS (SELECT p, k, fold, weights, own, predicted FROM p{name} UNPIVOT (predicted FOR weights IN (uniform, distance))),
s{name} AS (SELECT p, k, fold, weights, 1 - (1 - (1 - sum((own - predicted) ** 2) / (var_pop(own) * count(*)))) * ((SELECT count(*) FROM r{name}) - 1) / ((SELECT count(*) FROM r{name}) - {len(NUM) + 1} - 1) AS score FROM u{name} GROUP BY 1, 2, 3, 4),
grid{name} AS (SELECT CAST(k AS INTEGER) AS k, weights, CAST(p AS DOUBLE) AS p, avg(score) AS mean_score, stddev_pop(score) AS sd_score FROM s{name} GROUP BY 1, 2, 3),
placed{name} AS (SELECT *, CAST(row_number() OVER (ORDER BY round(mean_score, 12) DESC, k, weights DESC, p) AS INTEGER) AS place FROM grid{name})"""


@query("knn_grid", f"WITH {FEAT}, {grid_sql('feat')} SELECT * FROM placed", dbl="mean_score sd_score", digits=6)
def knn_grid(t):
    return knn.knn_grid(feat(t), NUM, ["code"], "y", "id")


def _best_sql() -> str:
    pars = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
    diffs = [f"abs((a.{c} - m_{c}) / s_{c} - (b.{c} - m_{c}) / s_{c})" for c in NUM]
    one = f"round({' + '.join(diffs)} + CASE WHEN a.code = b.code THEN 0 ELSE 2 END, 9)"
    two = f"round({' + '.join(d + ' ** 2' for d in diffs)} + CASE WHEN a.code = b.code THEN 0 ELSE 2 END, 9)"
    return f"""tr AS (SELECT * FROM feat WHERE {SPLIT.format('id')} = 'train'), te AS (SELECT * FROM feat WHERE {SPLIT.format('id')} = 'test'), {grid_sql('tr', '_g')},
best AS (SELECT * FROM placed_g WHERE place = 1), pq AS (SELECT {pars} FROM tr),
n AS (SELECT a.id, b.y, d, row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) AS rank FROM (SELECT a.id, b.id AS bid, b.y, CASE WHEN p = 1 THEN {one} ELSE sqrt({two}) END AS d FROM te a, tr b, pq, best) x
  JOIN te a ON a.id = x.id JOIN tr b ON b.id = x.bid)"""


@query("knn_best", f"""
WITH {FEAT}, {_best_sql()}
SELECT id, CASE WHEN any_value(weights) = 'uniform' THEN avg(y) ELSE coalesce(avg(CASE WHEN d = 0 THEN y END), sum(CASE WHEN d > 0 THEN y / d END) / sum(CASE WHEN d > 0 THEN 1 / d END)) END AS predicted
FROM n, best WHERE rank <= best.k GROUP BY id""", dbl="predicted", digits=4)
def knn_best(t):
    df = features.split_rows(feat(t), "id")
    return knn.knn_best(df.where("part = 'train'"), df.where("part = 'test'"), NUM, ["code"], "y", "id")


@query("knn_classify", """
WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id),
c AS (SELECT id, label, count(*) AS n FROM n WHERE rank <= 5 GROUP BY 1, 2)
SELECT id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rn FROM c) WHERE rn = 1""")
def knn_classify(t):
    df = classes(t)
    return knn.knn_classify(df, df, [f"e{i}" for i in range(64)], [], "label", "id", scaler="none", exclude_same=True)


def classes(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


GAPS = {"f1": ("label IN (1, 4) OR f6 > 0.2", lambda lab: lab.isin(1, 4) | (F.col("f6") > 0.2)), "f2": ("label IN (1, 2)", lambda lab: lab.isin(1, 2)),
        "f3": ("label = 3 AND f4 > 0", lambda lab: (lab == 3) & (F.col("f4") > 0)), "f4": ("id % 11 = 3", lambda lab: F.col("id") % 11 == 3),
        "f5": ("f1 > 0.15 OR id % 7 = 1", lambda lab: (F.col("f1") > 0.15) | (F.col("id") % 7 == 1)), "f6": ("id % 5 = 2 OR label = 6", lambda lab: (F.col("id") % 5 == 2) | (lab == 6))}
GAPPED = f"g AS (SELECT id, {', '.join(f'CASE WHEN {sql} THEN NULL ELSE {c} END AS {c}' for c, (sql, _) in GAPS.items())} FROM feat)"


def _impute_sql(c: str) -> str:
    d = " + ".join(f"coalesce((a.{x} - b.{x}) ** 2, 0)" for x in GAPS)
    n = " + ".join(f"CAST(a.{x} IS NOT NULL AND b.{x} IS NOT NULL AS INTEGER)" for x in GAPS)
    return f"""(SELECT id, avg(v) AS v FROM (SELECT a.id, b.{c} AS v, row_number() OVER (PARTITION BY a.id ORDER BY round(({d}) * {len(GAPS)} / ({n}), 9), b.id) AS rank
  FROM zz a JOIN zz b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND ({n}) > 0) WHERE rank <= 3 GROUP BY 1)"""


@query("knn_impute", f"""
WITH {FEAT}, {GAPPED}, pp AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in GAPS)} FROM g),
zz AS (SELECT id, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in GAPS)} FROM g, pp)
SELECT g.id, {', '.join(f'coalesce(g.{c}, x_{c}.v * s_{c} + m_{c}, m_{c}) AS {c}' for c in GAPS)}
FROM g CROSS JOIN pp {' '.join(f'LEFT JOIN {_impute_sql(c)} x_{c} ON g.id = x_{c}.id' for c in GAPS)}""", dbl=" ".join(GAPS))
def knn_impute(t):
    g = feat(t).select("id", *[F.when(~gap(F.col("label")), F.col(c)).alias(c) for c, (_, gap) in GAPS.items()])
    return knn.knn_impute(g, list(GAPS), "id")


LOCAL = """u AS (SELECT o_orderkey AS unit, o_custkey AS parent, o_totalprice AS omsetning, o_orderpriority || o_orderstatus AS naring, o_orderpriority || o_orderstatus AS n3, 'N' || CAST(c_nationkey AS VARCHAR) AS nf3,
  coalesce(q, 0) AS syss, CAST(o_orderkey * 7919 % 1000 AS DOUBLE) AS x, CAST(o_custkey * 104729 % 1000 AS DOUBLE) AS yy FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
e AS (SELECT parent, CAST(sum(CAST(omsetning AS DECIMAL(18,2))) AS DOUBLE) AS oms_f, CAST(sum(CAST(omsetning AS DECIMAL(18,2))) AS DOUBLE) * 0.7 AS cost_f, CASE WHEN sum(syss) = 0 THEN 1 ELSE sum(syss) END AS syss_f FROM u GROUP BY 1),
l0 AS (SELECT u.*, count(*) OVER (PARTITION BY parent) AS cnt FROM u WHERE n3 IN (SELECT n3 FROM u WHERE parent = 7) OR nf3 IN (SELECT nf3 FROM u WHERE parent = 7)),
l AS (SELECT l0.*, oms_f, cost_f, oms_f / syss_f AS ps, oms_f / cnt AS pb, substring(md5(CAST(parent AS VARCHAR) || ':42'), 1, 4) < 'cccc' AS train FROM l0 JOIN e USING (parent))"""


def local_tables(t):
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    kind = F.concat("o_orderpriority", "o_orderstatus")
    u = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(q, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("orgnr_bedrift"), F.col("o_custkey").alias("orgnr_foretak"), F.col("o_totalprice").alias("omsetning"), kind.alias("naring"),
        kind.alias("naring3"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("naring_f_3"), F.coalesce("q", F.lit(0.0)).alias("sysselsetting_syss"))
    oms = F.sum(F.col("omsetning").cast("decimal(18,2)")).cast("double")
    e = u.groupBy("orgnr_foretak").agg(oms.alias("omsetning"), (oms * 0.7).alias("nopost_driftskostnader"), F.sum("sysselsetting_syss").alias("sysselsetting_syss"))
    c = u.select("orgnr_bedrift", (F.col("orgnr_bedrift") * 7919 % 1000).cast("double").alias("x_koordinat"), (F.col("orgnr_foretak") * 104729 % 1000).cast("double").alias("y_koordinat"))
    return u, e, c


LF = ["x", "yy", "syss", "oms_f", "cost_f", "ps", "pb"]


@query("local_knn", f"""
WITH {LOCAL}, par AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LF)} FROM l WHERE train),
z AS (SELECT unit, parent, omsetning, oms_f AS total, naring, train, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in LF)} FROM l, par),
n AS (SELECT a.unit, a.parent, a.total, b.omsetning AS y, row_number() OVER (PARTITION BY a.unit ORDER BY round({' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in LF)} + CASE WHEN a.naring <> b.naring THEN 2 ELSE 0 END, 9), b.unit) AS rank
  FROM z a JOIN z b ON NOT a.train AND b.train),
p AS (SELECT unit, parent, total, avg(y) AS predicted FROM n WHERE rank <= 5 GROUP BY 1, 2, 3)
SELECT unit AS orgnr_bedrift, predicted, predicted / sum(predicted) OVER (PARTITION BY parent) * total AS new_predicted FROM p""", dbl="predicted new_predicted", digits=4)
def local_knn(t):
    return knn.local_knn(*local_tables(t), 7).select("orgnr_bedrift", "predicted", "new_predicted")


@query("foreign_neighbours", f"""
WITH {LOCAL}, n AS (SELECT a.unit AS q, b.unit, row_number() OVER (PARTITION BY a.unit ORDER BY round((a.x - b.x) ** 2 + (a.yy - b.yy) ** 2 + (a.ps - b.ps) ** 2 + (a.pb - b.pb) ** 2, 9), b.unit) AS rank FROM l a JOIN l b ON a.parent = 7 AND b.parent <> 7)
SELECT unit AS orgnr_bedrift, 1 AS own FROM l WHERE parent = 7 UNION ALL SELECT DISTINCT unit, 0 FROM n WHERE rank <= 5""")
def foreign_neighbours(t):
    df = knn.local_frame(*local_tables(t), 7)
    return knn.foreign_neighbours(df, "orgnr_foretak", 7, ["x_koordinat", "y_koordinat", "oms_per_syss_foretak", "oms_per_bedrift_foretak"], "orgnr_bedrift") \
        .select("orgnr_bedrift", "own")


@query("rescale_to_parent", """
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1000 / nullif(sum(l_quantity * 1000) OVER (PARTITION BY o_orderkey), 0) * (o_totalprice * 0.7310585786::DOUBLE) AS rescaled FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", dbl="rescaled", digits=5)
def rescale_to_parent(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"pred": F.col("l_quantity") * 1000, "third": F.col("o_totalprice") * 0.7310585786})
    return knn.rescale_to_parent(df, "pred", ["o_orderkey"], "third").select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rescaled")


# ---------------------------------------------------------------- hot deck

DECK = """t AS (SELECT o_orderkey AS row, o_custkey AS id, CAST(c_nationkey AS VARCHAR) || o_orderstatus || o_orderpriority AS c1, CAST(c_nationkey AS VARCHAR) || o_orderstatus AS c2, CAST(c_nationkey AS VARCHAR) AS c3,
  o_totalprice AS x, coalesce(q, 0) / o_totalprice AS ratio FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def deck(t):
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    n = F.col("c_nationkey").cast("string")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(q, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("id"), F.concat(n, "o_orderstatus", "o_orderpriority").alias("c1"), F.concat(n, "o_orderstatus").alias("c2"),
        n.alias("c3"), F.col("o_totalprice").alias("x"), (F.coalesce("q", F.lit(0.0)) / F.col("o_totalprice")).alias("ratio"))


def level_sql(q: str, d: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT a.row, {i} AS lvl, abs(a.x - b.x) AS dist, b.id AS donor_id, b.row AS drow, b.ratio AS ratio, a.x AS amount{extra} FROM {q} a JOIN {d} b ON a.c{i + 1} = b.c{i + 1} AND a.id <> b.id" for i in range(3))


@query("hot_deck", f"""
WITH {DECK}, n AS ({level_sql('t', 't')}), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY lvl, dist, donor_id, drow) AS rn FROM n)
SELECT t.row, donor_id, CAST(lvl AS INTEGER) AS level, r.ratio * x AS predicted FROM t LEFT JOIN r ON t.row = r.row AND rn = 1""", dbl="predicted")
def hot_deck(t):
    return hotdeck.hot_deck(materialise(deck(t), "units"), ["c1", "c2", "c3"], "x", "ratio", "x", "id", "row").select("row", "donor_id", "level", "predicted")


@query("hot_deck_bootstrap", f"""
WITH {DECK}, m AS (SELECT t.*, i.i AS iteration, substring(md5(CAST(row AS VARCHAR) || ':' || CAST(i.i AS VARCHAR)), 1, 4) < '3333' AS donor FROM t, (SELECT unnest([1, 2, 3]) AS i) i),
n AS ({' UNION ALL '.join(f"SELECT a.iteration, a.row, {i} AS lvl, abs(a.x - b.x) AS dist, b.id AS donor_id, b.row AS drow, b.ratio FROM m a JOIN m b ON NOT a.donor AND b.donor AND a.iteration = b.iteration AND a.c{i + 1} = b.c{i + 1} AND a.id <> b.id" for i in range(3))}),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iteration, row ORDER BY lvl, dist, donor_id, drow) AS rn FROM n) WHERE rn = 1),
p AS (SELECT m.iteration, m.ratio * m.x AS actual, r.ratio * m.x AS predicted FROM m LEFT JOIN r ON m.iteration = r.iteration AND m.row = r.row WHERE NOT donor)
SELECT CAST(iteration AS INTEGER) AS iteration, count(*) AS n, avg(abs(actual - predicted)) AS mae, avg(CASE WHEN actual = 0 AND predicted = 0 THEN NULL WHEN actual = 0 THEN 100 ELSE abs(actual - predicted) * 100 / actual END) AS pct,
  1 - sum((actual - predicted) ** 2) / (var_pop(CASE WHEN predicted IS NOT NULL THEN actual END) * count(predicted)) AS r2 FROM p GROUP BY 1""", dbl="mae pct r2", digits=4)
def hot_deck_bootstrap(t):
    df = materialise(deck(t), "units").withColumn("actual", F.col("ratio") * F.col("x"))
    out = hotdeck.hot_deck_bootstrap(df, 3, ["c1", "c2", "c3"], "x", "ratio", "x", "actual", "id", "row")
    err = F.col("residual") * F.col("residual")
    seen = F.when(F.col("predicted").isNotNull(), F.col("actual"))
    return out.groupBy("iteration").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("residual")).alias("mae"), F.avg(metrics.pct_error(F.col("actual"), F.col("predicted"))).alias("pct"),
        (1 - F.sum(err) / (F.var_pop(seen) * F.count("predicted"))).alias("r2"))


@query("hot_deck_k", """
WITH d AS (SELECT s_suppkey AS row, 'S' || CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey AS VARCHAR) AS c1, CAST(n_regionkey AS VARCHAR) AS c2, s_acctbal AS x, s_suppkey / 100.0 AS ratio FROM supplier JOIN nation ON s_nationkey = n_nationkey),
q AS (SELECT c_custkey AS row, 'S' || CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS c1, CAST(n_regionkey AS VARCHAR) AS c2, c_acctbal AS x FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT a.row, 0 AS lvl, abs(a.x - b.x) AS dist, b.id AS did, b.row AS drow, b.ratio FROM q a JOIN d b ON a.c1 = b.c1 AND a.id <> b.id UNION ALL
  SELECT a.row, 1, abs(a.x - b.x), b.id, b.row, b.ratio FROM q a JOIN d b ON a.c2 = b.c2 AND a.id <> b.id),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, drow ORDER BY lvl) AS f FROM n) WHERE f = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY lvl, dist, did, drow) AS rn FROM u), m AS (SELECT row, avg(ratio) AS donor_ratio, count(*) AS donors FROM r WHERE rn <= 3 GROUP BY 1)
SELECT q.row, donors, donor_ratio * x AS predicted FROM q LEFT JOIN m ON q.row = m.row""", dbl="predicted", digits=7)
def hot_deck_k(t):
    n = t.nation.select("n_nationkey", F.col("n_regionkey").cast("string").alias("c2"))
    d = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("row"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").cast("string").alias("c1"), "c2",
        F.col("s_acctbal").alias("x"), (F.col("s_suppkey") / 100.0).alias("ratio"))
    q = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("row"), F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").cast("string").alias("c1"), "c2", F.col("c_acctbal").alias("x"))
    return hotdeck.hot_deck_k(q, d, ["c1", "c2"], "x", "ratio", "x", "id", "row", "row", 3).select("row", "donors", "predicted")


@query("ratio_frame", """
WITH b AS (SELECT l_orderkey AS id, year(o_orderdate) AS year, l_partkey, l_suppkey, l_linenumber, CAST(c_nationkey AS VARCHAR) AS kommune, CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END AS syss, l_extendedprice AS oms,
  o_totalprice AS salg, CASE o_orderpriority WHEN '1-URGENT' THEN '47.112' WHEN '2-HIGH' THEN '46.310' ELSE '68.200' END AS nacef_5 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'A' AND l_linenumber = 1)
SELECT id, year, nacef_5, substring(nacef_5, 1, 4) AS n3, kommune AS b_kommunenr, oms AS gjeldende_omsetn_kr, syss AS gjeldende_bdr_syss, oms / syss AS oms_per_syss, salg / oms AS salgsint_per_oms FROM b WHERE syss <> 0 AND substring(nacef_5, 1, 2) IN ('45', '46', '47')""",
       dbl="gjeldende_omsetn_kr gjeldende_bdr_syss oms_per_syss salgsint_per_oms")
def ratio_frame(t):
    def comma(c):
        return F.replace(F.col(c).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    year = F.year("o_orderdate").cast("long").alias("year")
    none = F.lit(None).cast("string")
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "47.112").when(F.col("o_orderpriority") == "2-HIGH", "46.310").otherwise("68.200")
    up = t.orders.select(F.col("o_orderkey").alias("id"), year, F.lit(0).alias("radnr"), comma("o_totalprice").alias("salgsint"), code.alias("nacef_5"), F.lit("1").alias("forbruk"),
                         none.alias("b_kommunenr"), none.alias("gjeldende_bdr_syss"), none.alias("gjeldende_omsetn_kr"), none.alias("regtype"))
    down = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .withColumn("syss", F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_quantity"))).select(
            F.col("l_orderkey").alias("id"), year, F.col("l_linenumber").alias("radnr"), none.alias("salgsint"), none.alias("nacef_5"), none.alias("forbruk"), F.col("c_nationkey").cast("string").alias("b_kommunenr"),
            comma("syss").alias("gjeldende_bdr_syss"), comma("l_extendedprice").alias("gjeldende_omsetn_kr"), F.when(F.col("l_returnflag") == "A", "01").otherwise("02").alias("regtype"))
    return hotdeck.ratio_frame(up.unionByName(down)).select(
        "id", "year", "nacef_5", "n3", "b_kommunenr", "gjeldende_omsetn_kr", "gjeldende_bdr_syss", "oms_per_syss", "salgsint_per_oms")


# ---------------------------------------------------------------- metrics

PRED = "(SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity * 1400 + l_tax * 1000.7 AS yhat FROM lineitem)"


def pred(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1400 + F.col("l_tax") * 1000.7).alias("yhat"))


METRICS = "count(*) AS n, avg((y - yhat) ** 2) AS mse, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae, quantile_cont(abs(y - yhat), 0.5) AS median_ae, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS r2"


@query("regression_metrics", f"SELECT l_returnflag, {METRICS} FROM {PRED} WHERE l_linestatus <> 'O' GROUP BY 1", dbl="mse rmse mae median_ae r2", digits=3)
def regression_metrics(t):
    return metrics.regression_metrics(pred(t), "y", "yhat", ["l_returnflag"], F.col("l_linestatus") == "O")


@query("adjusted_r2", f"SELECT *, 1 - (1 - r2) * (n - 1) / (n - 3 - 1) AS adjusted_r2 FROM (SELECT {METRICS} FROM {PRED})", dbl="mse rmse mae median_ae r2 adjusted_r2", digits=3)
def adjusted_r2(t):
    return metrics.regression_metrics(pred(t), "y", "yhat", n_features=3)


@query("pct_error", """
SELECT l_returnflag, avg(CASE WHEN y = 0 AND yhat = 0 THEN NULL WHEN y = 0 THEN 100 ELSE abs(y - yhat) * 100 / y END) AS mean_pct, count(*) AS n
FROM (SELECT l_returnflag, CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END AS y, CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity * 1400 END AS yhat FROM lineitem) GROUP BY 1""", dbl="mean_pct", digits=4)
def pct_error(t):
    y = F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice"))
    yhat = F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity") * 1400)
    return t.lineitem.groupBy("l_returnflag").agg(F.avg(metrics.pct_error(y, yhat)).alias("mean_pct"), F.count(F.lit(1)).alias("n"))


@query("classification_report", """
WITH p AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS yhat FROM lineitem),
l AS (SELECT DISTINCT y AS label FROM p), s AS (SELECT label, (SELECT count(*) FROM p WHERE y = label) AS support, (SELECT count(*) FROM p WHERE yhat = label) AS g, (SELECT count(*) FROM p WHERE y = label AND yhat = label) AS h FROM l),
m AS (SELECT label, support, h, CAST(h AS DOUBLE) / g AS p, CAST(h AS DOUBLE) / support AS r FROM s), f AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM m)
SELECT label, p AS "precision", r AS recall, f1, support FROM f UNION ALL SELECT 'accuracy', sum(h) / sum(support), sum(h) / sum(support), sum(h) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), CAST(sum(support) AS BIGINT) FROM f UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f""",
       dbl='precision recall f1')
def classification_report(t):
    guess = F.when(F.col("l_quantity") < 10, "A").when(F.col("l_quantity") < 35, "N").otherwise("R")
    return metrics.classification_report(t.lineitem.select(F.col("l_returnflag").alias("y"), guess.alias("yhat")), "y", "yhat")


@query("backtest_published", """
WITH p AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS predicted FROM lineitem GROUP BY 1), j AS (SELECT predicted AS yhat, o_totalprice AS y, CASE WHEN o_orderstatus = 'F' THEN '02' ELSE '01' END AS kind FROM p JOIN orders ON k = o_orderkey),
b AS (SELECT 'all' AS part, y, yhat FROM j UNION ALL SELECT 'multi', y, yhat FROM j WHERE kind = '02')
SELECT part, count(*) AS n, avg(abs(y - yhat)) AS mae, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS r2 FROM b GROUP BY 1""", dbl="mae r2", digits=4)
def backtest_published(t):
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("predicted"))
    pub = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("published"), F.when(F.col("o_orderstatus") == "F", "02").otherwise("01").alias("reg_type"))
    return metrics.backtest_published(p, pub, ["k"], "predicted", "published")[1].select("part", "n", "mae", "r2")


@query("linear_by_group", """
WITH s AS (SELECT p_brand, l_quantity AS x, l_extendedprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey), g AS (SELECT p_brand, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s GROUP BY 1),
p AS (SELECT regr_slope(y, x) AS b0, regr_intercept(y, x) AS a0 FROM s), e AS (SELECT p_brand, abs(y - (a + b * x)) AS eg, abs(y - (a0 + b0 * x)) AS ep FROM s JOIN g USING (p_brand), p)
SELECT p_brand, count(*) AS n, avg(eg) AS mae_group, avg(ep) AS mae_pooled FROM e GROUP BY 1 UNION ALL SELECT NULL, count(*), avg(eg), avg(ep) FROM e""", dbl="mae_group mae_pooled", digits=4)
def linear_by_group(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return models.linear_by_group(df, "x", "y", ["p_brand"])


# ---------------------------------------------------------------- linear models, components, curves: normal equations in SQL

def sweep_sql(name: str, columns: int) -> str:
    """Least squares by sweeping the first ``columns`` pivots of ``name`` (g, i, j, v), the sums of products; y is the last column. Weights: ``name_beta`` (g, i, v)."""
    steps = []
    for k in range(1, columns + 1):
        last = name if k == 1 else f"{name}_{k - 1}"
        steps.append(f"""{name}_{k} AS MATERIALIZED (SELECT t.g, t.i, t.j, CASE WHEN abs(p.v) < 1e-12 THEN t.v WHEN t.i = {k} AND t.j = {k} THEN 1 / p.v WHEN t.i = {k} THEN t.v / p.v WHEN t.j = {k} THEN -t.v / p.v
  ELSE t.v - r.v * c.v / p.v END AS v FROM {last} t JOIN {last} p ON p.g = t.g AND p.i = {k} AND p.j = {k} JOIN {last} r ON r.g = t.g AND r.i = t.i AND r.j = {k} JOIN {last} c ON c.g = t.g AND c.i = {k} AND c.j = t.j)""")
    return ", ".join(steps) + f", {name}_beta AS (SELECT g, i, v FROM {name}_{columns} WHERE j = {columns + 1} AND i <= {columns})"


CODES = ["L0", "L1", "L2", "L3"]


def long_sql(source: str) -> str:
    """``x`` (id, i, v): numbers, codes as zeros and ones (their sum stands for the constant), y last."""
    values = [f"CAST({c} AS DOUBLE)" for c in NUM] + [f"CAST(code = '{c}' AS INTEGER)::DOUBLE" for c in CODES] + ["y"]
    return "x AS (" + " UNION ALL ".join(f"SELECT id, {i + 1} AS i, {v} AS v FROM {source}" for i, v in enumerate(values)) + ")"


WIDTH = len(NUM) + len(CODES)
ERRORS = "count(*) AS n, avg((y - p) ** 2) AS mse, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, quantile_cont(abs(y - p), 0.5) AS median_ae, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2"


@query("stack_regress", f"""
WITH {z_sql()}, {long_sql('feat')}, f AS (SELECT id, y, {FOLD.format('id')} AS fold FROM feat), lines AS (SELECT DISTINCT fold AS g FROM f UNION ALL SELECT -1),
s AS MATERIALIZED (SELECT g, a.i, b.i AS j, sum(a.v * b.v) AS v FROM lines JOIN f ON fold <> g JOIN x a USING (id) JOIN x b USING (id) GROUP BY 1, 2, 3), {sweep_sql('s', WIDTH)},
lin AS (SELECT id, sum(b.v * x.v) AS linear FROM f JOIN s_beta b ON b.g = fold JOIN x USING (id, i) GROUP BY 1), lin_all AS (SELECT id, sum(b.v * x.v) AS linear FROM x JOIN s_beta b USING (i) WHERE g = -1 GROUP BY 1),
near AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY round({DIST} + CASE WHEN a.code <> b.code THEN 2 ELSE 0 END, 9), b.id) AS rank FROM z a JOIN z b ON {FOLD.format('a.id')} <> {FOLD.format('b.id')}),
near_all AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY round({DIST} + CASE WHEN a.code <> b.code THEN 2 ELSE 0 END, 9), b.id) AS rank FROM z a JOIN z b ON TRUE),
oof AS (SELECT f.id, f.y, linear, k.knn FROM f JOIN lin USING (id) JOIN (SELECT id, avg(y) AS knn FROM near WHERE rank <= 2 GROUP BY 1) k USING (id)),
m AS (SELECT avg(y) AS my, avg(linear) AS ml, avg(knn) AS mk, var_pop(linear) * count(*) + 1 AS ll, var_pop(knn) * count(*) + 1 AS kk, covar_pop(linear, knn) * count(*) AS lk, covar_pop(linear, y) * count(*) AS ly, covar_pop(knn, y) * count(*) AS ky FROM oof),
w AS (SELECT *, (ly * kk - ky * lk) / (ll * kk - lk * lk) AS wl, (ky * ll - ly * lk) / (ll * kk - lk * lk) AS wk FROM m)
SELECT a.id, my + wl * (a.linear - ml) + wk * (k.knn - mk) AS predicted FROM lin_all a JOIN (SELECT id, avg(y) AS knn FROM near_all WHERE rank <= 2 GROUP BY 1) k USING (id), w""", dbl="predicted", digits=5)
def stack_regress(t):
    return gram.stack_regress(feat(t), feat(t), NUM, ["code"], "y", "id")


SLOT = "CAST(('0x' || substring(md5(CAST(id AS VARCHAR) || ':curve'), 1, 6)) AS BIGINT)::DOUBLE / 16777216"
STEPS = "(SELECT unnest([0, 1, 2, 3, 4]) AS step, unnest([0.1, 0.325, 0.55, 0.775, 1.0]) AS fraction)"


@query("learning_curve", f"""
WITH {FEAT}, {long_sql('feat')}, f AS (SELECT id, y, {FOLD.format('id')} AS fold, {SLOT} AS u FROM feat), lines AS (SELECT DISTINCT fold * 5 + step AS g, fold AS tf, step, fraction FROM f, {STEPS}),
s AS MATERIALIZED (SELECT g, a.i, b.i AS j, sum(a.v * b.v) AS v FROM lines JOIN f ON fold <> tf AND u < fraction JOIN x a USING (id) JOIN x b USING (id) GROUP BY 1, 2, 3), {sweep_sql('s', WIDTH)},
p AS (SELECT g, id, sum(b.v * x.v) AS p FROM s_beta b JOIN x USING (i) GROUP BY 1, 2),
e AS (SELECT fraction, tf, fold = tf AS tested, avg(abs(y - p)) AS mae FROM lines JOIN p USING (g) JOIN f USING (id) WHERE fold = tf OR u < fraction GROUP BY 1, 2, 3)
SELECT CAST(fraction AS DOUBLE) AS fraction, avg(CASE WHEN NOT tested THEN mae END) AS train_mean, stddev_pop(CASE WHEN NOT tested THEN mae END) AS train_sd, avg(CASE WHEN tested THEN mae END) AS test_mean, stddev_pop(CASE WHEN tested THEN mae END) AS test_sd
FROM e GROUP BY 1""", dbl="train_mean train_sd test_mean test_sd", digits=5)
def learning_curve(t):
    return gram.linear_learning_curve(feat(t), NUM, ["code"], "y", "id")


@query("learning_curve_knn", f"""
WITH {z_sql('standard')}, f AS (SELECT *, {FOLD.format('id')} AS fold, {SLOT} AS u FROM z), d AS MATERIALIZED (SELECT a.id, a.fold AS afold, a.u AS au, a.label AS own, b.id AS bid, b.fold, b.u, b.label,
  round({DIST} + CASE WHEN a.code <> b.code THEN 2 ELSE 0 END, 9) AS d FROM f a JOIN f b ON TRUE),
n AS (SELECT tf, fraction, id, afold, own, label, row_number() OVER (PARTITION BY tf, fraction, id ORDER BY d, bid) AS rank FROM (SELECT DISTINCT fold AS tf FROM f), {STEPS}, d
  WHERE d.fold <> tf AND d.u < fraction AND (afold = tf OR au < fraction)),
v AS (SELECT tf, fraction, id, afold, own, label, count(*) AS c FROM n WHERE rank <= 5 GROUP BY ALL),
g AS (SELECT tf, fraction, afold = tf AS tested, own = label AS hit FROM v QUALIFY row_number() OVER (PARTITION BY tf, fraction, id ORDER BY c DESC, label) = 1),
e AS (SELECT fraction, tf, tested, avg(hit::INTEGER) AS s FROM g GROUP BY 1, 2, 3)
SELECT CAST(fraction AS DOUBLE) AS fraction, avg(CASE WHEN NOT tested THEN s END) AS train_mean, stddev_pop(CASE WHEN NOT tested THEN s END) AS train_sd, avg(CASE WHEN tested THEN s END) AS test_mean, stddev_pop(CASE WHEN tested THEN s END) AS test_sd
FROM e GROUP BY 1""", dbl="train_mean train_sd test_mean test_sd", digits=6)
def learning_curve_knn(t):
    return gram.knn_learning_curve(feat(t), NUM, ["code"], "label", "id")


@query("pca_two_columns", """
WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM p),
c AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM z), e AS (SELECT *, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM c),
v AS (SELECT 1 AS component, ((a + c) / 2 + r) / (a + c) AS variance, ((a + c) / 2 + r) / (a + c) AS cumulative FROM e UNION ALL SELECT 2, ((a + c) / 2 - r) / (a + c), 1.0 FROM e)
SELECT CAST(component AS INTEGER) AS component, variance, cumulative FROM v""", dbl="variance cumulative", digits=9)
def pca_two_columns(t):
    e = F.col("embedding")
    df = t.embeddings.select(e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))
    return models.pca_variance(df, ["x", "y"], None).drop("top_columns")


@query("pca_variance", """
WITH v AS (SELECT unnest(range(1, 65)) AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT 64::INTEGER AS components, true AS ordered, true AS sums_to_one, CAST(count(DISTINCT c) AS INTEGER) AS columns FROM v""")
def pca_variance(t):
    out = models.pca_variance(classes(t), [f"e{i}" for i in range(64)], None)
    last = F.max_by("cumulative", "component")
    pairs = out.withColumn("_next", F.coalesce(F.lead("variance").over(Window.orderBy("component")), F.lit(0.0)))
    return pairs.agg(F.count(F.lit(1)).cast("int").alias("components"), F.bool_and(F.col("variance") >= F.col("_next") - 1e-12).alias("ordered"), (F.abs(last - 1) < 1e-9).alias("sums_to_one"),
                     F.size(F.array_distinct(F.flatten(F.collect_list("top_columns")))).alias("columns"))


@query("knn_regress_pca", f"WITH {near_sql('a.id <> b.id', kind='standard')} SELECT id, avg(y) AS predicted FROM near WHERE rank <= 2 GROUP BY 1", dbl="predicted")
def knn_regress_pca(t):
    """All components of numbers and codes: distances are those before the rotation."""
    return gram.knn_regress_pca(feat(t), feat(t), NUM, ["code"], "y", "id", None, exclude_same=True)


# ---------------------------------------------------------------- Spark ML: lines against normal equations, trees by what must hold of them

def shop(t):
    """One row per order with sums over its lines, and codes."""
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("oms"), F.sum("l_quantity").alias("syss"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("lonn"), F.count(F.lit(1)).alias("units"))
    return t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year")).join(q, "o_orderkey")


SHOP = (["syss", "lonn", "units"], ["o_orderpriority"], "oms")
SHOP_SQL = """shop AS (SELECT o_orderkey AS id, o_orderpriority AS code, o_orderstatus AS status, CAST(sum(l_extendedprice) AS DOUBLE) AS y, CAST(sum(l_quantity) AS DOUBLE) AS syss, CAST(sum(l_extendedprice * l_tax) AS DOUBLE) AS lonn, CAST(count(*) AS DOUBLE) AS units
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"""
SHOP_VALUES = ["syss", "lonn", "units", *[f"CAST(starts_with(code, '{i}') AS INTEGER)::DOUBLE" for i in range(1, 6)], "y"]
LINE_SQL = f"""{SHOP_SQL}, x AS ({' UNION ALL '.join(f'SELECT id, {i + 1} AS i, {v} AS v FROM shop' for i, v in enumerate(SHOP_VALUES))}),
s AS MATERIALIZED (SELECT 0 AS g, a.i, b.i AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (id) WHERE id IN (SELECT id FROM shop WHERE {{train}}) GROUP BY 1, 2, 3), {sweep_sql('s', 8)},
p AS (SELECT id, sum(b.v * x.v) AS p FROM s_beta b JOIN x USING (i) GROUP BY 1)"""


def scored(df):
    return metrics.regression_metrics(df, "oms", "predicted")


def sound(df):
    """How many rows were predicted, whether none is negative, and whether the errors are below those of the mean."""
    return df.agg(F.count("predicted").alias("n"), (F.min("predicted") >= 0).alias("not_negative"), (F.avg((F.col("oms") - F.col("predicted")) ** 2) < F.var_pop("oms") / 2).alias("explains_half"))


@query("linear_regress", f"""
WITH {LINE_SQL.format(train=SPLIT.format('id') + " = 'train'")} SELECT {ERRORS} FROM p JOIN shop USING (id) WHERE {SPLIT.format('id')} = 'test'""".replace("avg((y - p) ** 2) AS mse, ", ""), dbl="rmse mae median_ae r2", digits=2)
def linear_regress(t):
    df = features.split_rows(shop(t), "o_orderkey")
    return scored(models.linear_regress(df.where("part = 'train'"), *SHOP).predict(df.where("part = 'test'"), clip=False)).drop("mse")


TESTED = f"WITH {SHOP_SQL} SELECT count(*) AS n, true AS not_negative, true AS explains_half FROM shop WHERE {SPLIT.format('id')} = 'test'"


@query("gbt_regress", TESTED)
def gbt_regress(t):
    df = features.split_rows(shop(t), "o_orderkey")
    return sound(models.gbt_regress(df.where("part = 'train'"), *SHOP).predict(df.where("part = 'test'")))


@query("gbt_grid", TESTED)
def gbt_grid(t):
    df = features.split_rows(shop(t), "o_orderkey")
    fitted = models.gbt_regress(df.where("part = 'train'"), *SHOP, grid={"maxDepth": [2, 4]}, max_iter=8, fold_key="o_orderkey")
    return sound(fitted.predict(df.where("part = 'test'")))


@query("gbt_regress_pca", TESTED)
def gbt_regress_pca(t):
    df = features.split_rows(shop(t), "o_orderkey")
    train, test = df.where("part = 'train'"), df.where("part = 'test'")
    return sound(test.select("o_orderkey", "oms").join(models.gbt_regress_pca(train, test, *SHOP, "o_orderkey", 0.95), "o_orderkey"))


@query("feature_importance", f"""
WITH {SHOP_SQL} SELECT CAST(3 + count(DISTINCT code) AS INTEGER) AS features, true AS sums_to_one, true AS numbers_lead FROM shop""")
def feature_importance(t):
    out = models.feature_importance(models.gbt_regress(shop(t), *SHOP))
    return out.agg(F.count(F.lit(1)).cast("int").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"), (F.sum(F.when(F.col("feature").isin(*SHOP[0]), F.col("importance"))) > 0.9).alias("numbers_lead"))


@query("tree_classify", f"""
WITH c AS (SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 50))
SELECT CAST(label AS VARCHAR) AS label, count(*) AS support, true AS shares FROM c WHERE {SPLIT.format('id')} = 'test' GROUP BY 1 UNION ALL
SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), count(*), true FROM c WHERE {SPLIT.format('id')} = 'test'""")
def tree_classify(t):
    out = models.tree_classify(classes(t), [f"e{i}" for i in range(64)], [], "label", "id")[1].where("support > 0")
    return out.select("label", "support", ((F.least("precision", "recall", "f1") >= 0) & (F.greatest("precision", "recall", "f1") <= 1)).alias("shares"))


@query("boost_classify", f"""
WITH c AS (SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 50))
SELECT label AS actual, count(*) AS n, true AS sums_to_one, true AS one_per_class FROM c WHERE {SPLIT.format('id')} = 'test' GROUP BY 1""")
def boost_classify(t):
    """Probabilities of every class for each tested row."""
    out, _ = boost.boost_classify(classes(t), [f"e{i}" for i in range(64)], [], "label", "id")
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, x: s + x)
    return out.groupBy("actual").agg(F.count("predicted").alias("n"), (F.max(F.abs(total - 1)) < 1e-9).alias("sums_to_one"), (F.min(F.size("probabilities")) == F.max(F.size("probabilities"))).alias("one_per_class"))


@query("impute_with", f"""
WITH {LINE_SQL.format(train="status <> 'P'")}, l AS (SELECT 'linear' AS model, count(*) AS n, true AS not_negative, avg((y - greatest(p, 0)) ** 2) < var_pop(y) / 2 AS explains_half FROM p JOIN shop USING (id) WHERE status = 'P')
SELECT * FROM l UNION ALL SELECT m, n, true, true FROM l, (SELECT unnest(['gbt', 'knn', 'stack']) AS m)""")
def impute_with(t):
    df = materialise(shop(t), "shop")      # every imputer reads it several times
    out = None
    for name in sorted(models.IMPUTERS):
        part = sound(models.impute_with(name, df.where("o_orderstatus <> 'P'"), df.where("o_orderstatus = 'P'"), *SHOP, "o_orderkey")).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
