"""Text, geography and network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import geo, network, text

from .registry import query

WORDS = ["the", "et", "und", "de", "an"]


def _n(w):
    return f"CAST(len(list_filter(w, lambda x: x = '{w}')) AS INTEGER)"


COUNTS = f"""c AS (SELECT doc_id, lang, source, n_chars, text || ' ' || source AS t, list_filter(string_split_regex(lower(text || ' ' || source), '\\s+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, lang, source, {', '.join(f'{_n(w)} AS n_{w}' for w in WORDS)}, CAST(len(w) AS INTEGER) AS n_words, {' + '.join(_n(w) for w in WORDS)} AS term_total,
  CAST(length(t) - length(replace(t, '!', '')) AS INTEGER) AS n_char FROM c)"""


def counted(t):
    return text.term_counts(t.documents, ["text", "source", "text"], WORDS)


@query("text_term_counts", f"WITH {COUNTS} SELECT doc_id, {', '.join('n_' + w for w in WORDS)}, n_words, term_total, n_char, ln(1 + n_char) AS log_char FROM k", dbl="log_char")
def text_term_counts(t):
    return counted(t).withColumn("log_char", F.log1p("n_char")).select("doc_id", *["n_" + w for w in WORDS], "n_words", "term_total", "n_char", "log_char")


@query("text_term_rollup", f"""
WITH {COUNTS} SELECT lang, source, CAST(CASE WHEN grouping(source) = 1 AND grouping(lang) = 0 THEN 0 WHEN grouping(lang) = 1 AND grouping(source) = 0 THEN 1 ELSE 2 END AS INTEGER) AS level,
  CAST(sum(term_total) AS BIGINT) AS total FROM k GROUP BY GROUPING SETS ((lang), (source), (lang, source))""")
def text_term_rollup(t):
    return text.term_rollup(counted(t), "term_total", [["lang"], ["source"], ["lang", "source"]])


# ---------------------------------------------------------------- geography

@query("attach_coordinates", """
WITH p AS (SELECT s_suppkey, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier WHERE s_acctbal > 1000
  UNION SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_nationkey < 20)
SELECT l_orderkey, l_linenumber, l_partkey, s_suppkey, x, y FROM lineitem JOIN p ON l_suppkey = s_suppkey""")
def attach_coordinates(t):
    s = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("x_koordinat"), F.col("s_nationkey").cast("double").alias("y_koordinat"), "s_nationkey")
    files = [s.where("x_koordinat > 1000"), s.where("s_nationkey < 20")]
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    return geo.attach_coordinates(lines, files, "s_suppkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "s_suppkey", F.col("x_koordinat").alias("x"), F.col("y_koordinat").alias("y"))


@query("region_totals", """
SELECT n_nationkey, n_name, coalesce(v, 0) AS oms FROM nation LEFT JOIN (SELECT c_nationkey, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998 GROUP BY 1) ON n_nationkey = c_nationkey""", dbl="oms", digits=2)
def region_totals(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnsRenamed({"c_nationkey": "n_nationkey", "o_totalprice": "oms"})
    return geo.region_totals(df, t.nation.select("n_nationkey", "n_name"), "oms", (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"),
                             F.year("o_orderdate") == 1998, "n_nationkey")


def places(t, i, j, id="vec_id"):
    return t.embeddings.select(F.col("vec_id").alias(id), geo.point(F.col("embedding")[i], F.col("embedding")[j]).alias("point"), "label")


def xy(i, j):
    return f"(SELECT vec_id, CAST(embedding[{i + 1}] AS DOUBLE) AS x, CAST(embedding[{j + 1}] AS DOUBLE) AS y, label FROM embeddings)"


@query("nearest_join", f"""
SELECT a_id, vec_id, distance FROM (SELECT a.vec_id AS a_id, b.vec_id, sqrt(round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9)) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9), b.vec_id) AS rn FROM {xy(0, 1)} a, {xy(2, 3)} b) WHERE rn = 1""", dbl="distance", digits=4)
def nearest_join(t):
    return geo.nearest_join(places(t, 0, 1, "a_id"), places(t, 2, 3), "a_id", "vec_id")


@query("k_nearest_mean", f"""
SELECT vec_id, avg(CASE WHEN d <> 0 THEN d END) AS mean_distance FROM (SELECT a.vec_id, sqrt(round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9)) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9), b.vec_id) AS rn FROM {xy(0, 1)} a, {xy(0, 1)} b)
WHERE rn <= 20 GROUP BY 1""", dbl="mean_distance", digits=4)
def k_nearest_mean(t):
    return geo.k_nearest_mean(places(t, 0, 1), "vec_id", 20)


BOX = f"(SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {xy(0, 1)} GROUP BY 1)"


def diamonds(t):
    """A diamond per label, around the places of that label."""
    p = places(t, 0, 1)
    box = p.groupBy("label").agg(F.min("point.x").alias("x0"), F.max("point.x").alias("x1"), F.min("point.y").alias("y0"), F.max("point.y").alias("y1"))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return box.select(F.col("label").alias("region"), F.array(geo.point(F.col("x0"), my), geo.point(mx, F.col("y1")), geo.point(F.col("x1"), my), geo.point(mx, F.col("y0"))).alias("polygon"))


@query("points_in_polygons", f"""
SELECT p.vec_id, g.label AS region FROM {xy(2, 3)} p LEFT JOIN {BOX} g ON abs(p.x - (x0 + x1) / 2) / ((x1 - x0) / 2) + abs(p.y - (y0 + y1) / 2) / ((y1 - y0) / 2) < 1""")
def points_in_polygons(t):
    return geo.points_in_polygons(diamonds(t), places(t, 2, 3).drop("label")).select("vec_id", "region")


@query("polygon_area", f"SELECT label AS region, (x1 - x0) * (y1 - y0) / 2 AS area FROM {BOX}", dbl="area")
def polygon_area(t):
    return diamonds(t).select("region", geo.polygon_area(F.col("polygon")).alias("area"))


# ---------------------------------------------------------------- network

ROADS = """(SELECT c_nationkey AS source, s_nationkey AS target, min(o_orderstatus) AS st, CAST(min(l_extendedprice) AS DOUBLE) AS fw, max(l_quantity) - 48 AS bw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
EDGES = f"""(SELECT * FROM (SELECT source AS src, target AS dst, fw AS weight FROM {ROADS} WHERE source <= target UNION ALL SELECT target, source, bw FROM {ROADS} WHERE source > target OR source = target) WHERE weight >= 0)"""


def roads(t):
    """Customer nation to supplier nation, with the cheapest line as time one way."""
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    df = df.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(
        F.min("l_extendedprice").alias("drivetime_fw"), (F.max("l_quantity") - 48).alias("drivetime_bw"))
    way = F.when(F.col("source") == F.col("target"), "B").when(F.col("source") < F.col("target"), "FT").otherwise("TF")
    return df.withColumn("oneway", way)


@query("orient_edges", f"SELECT src, dst, weight FROM {EDGES}", dbl="weight", digits=2)
def orient_edges(t):
    return network.orient_edges(roads(t))


@query("connected_components", """
WITH RECURSIVE e AS (SELECT 1000 + s_suppkey AS u, s_nationkey AS v FROM supplier UNION ALL SELECT n_nationkey, 100 + n_regionkey FROM nation),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, seen) AS (SELECT DISTINCT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
SELECT node, component, size, component = (SELECT component FROM s ORDER BY size DESC, component LIMIT 1) AS largest FROM c JOIN s USING (component)""")
def connected_components(t):
    e = t.supplier.select((F.col("s_suppkey") + 1000).alias("src"), F.col("s_nationkey").cast("long").alias("dst")).unionByName(
        t.nation.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst")))
    return network.connected_components(e)


def od_sql() -> str:
    steps = ["d0 AS (SELECT src, dst, min(weight) AS c FROM (SELECT src, dst, weight FROM e UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation) GROUP BY 1, 2)"]
    steps += [f"d{i} AS (SELECT a.src, b.dst, min(a.c + b.c) AS c FROM d{i - 1} a JOIN d{i - 1} b ON a.dst = b.src GROUP BY 1, 2)" for i in range(1, 6)]
    return f"e AS (SELECT * FROM {EDGES}), " + ", ".join(steps)


@query("od_costs", f"""
WITH {od_sql()} SELECT src AS origin, dst AS dest, c AS cost FROM d5 WHERE src IN (SELECT DISTINCT c_nationkey FROM customer) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""", dbl="cost", digits=2)
def od_costs(t):
    return network.od_costs(network.orient_edges(roads(t)), t.customer.select("c_nationkey"), t.nation.where("n_regionkey < 3").select("n_nationkey"))


@query("nearest_dest", f"""
WITH {od_sql()} SELECT origin, dest, cost FROM (SELECT src AS origin, dst AS dest, c AS cost, row_number() OVER (PARTITION BY src ORDER BY round(c, 6), dst) AS rn FROM d5
 WHERE src <> dst AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)) WHERE rn = 1""", dbl="cost", digits=2)
def nearest_dest(t):
    costs = network.od_costs(network.orient_edges(roads(t)), t.nation.select("n_nationkey"), t.nation.where("n_regionkey < 3").select("n_nationkey"))
    return network.nearest_dest(costs)


@query("nearest_destination", f"""
WITH {od_sql()} SELECT origin, dest, cost FROM (SELECT src AS origin, dst AS dest, c AS cost, row_number() OVER (PARTITION BY src ORDER BY round(c, 6), dst) AS rn FROM d5
 WHERE src <> dst AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)) WHERE rn = 1""", dbl="cost", digits=2)
def nearest_destination(t):
    return network.nearest_destination(network.orient_edges(roads(t)), t.nation.select("n_nationkey"), t.nation.where("n_regionkey < 3").select("n_nationkey"))


def routes_sql() -> str:
    """Least (cost, edges) by the number of edges, the smallest predecessor on such a route, and routes walked back."""
    walks = ["w0 AS (SELECT n_nationkey AS o, n_nationkey AS v, 0::DOUBLE AS c, 0 AS h FROM nation)"]
    walks += [f"w{i} AS MATERIALIZED (SELECT o, dst AS v, min(round(c + w, 9)) AS c, {i} AS h FROM w{i - 1} JOIN g ON v = src GROUP BY 1, 2)" for i in range(1, 25)]
    every = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(25))
    return f"""e AS (SELECT * FROM {EDGES}), g AS (SELECT src, dst, min(weight)::DOUBLE AS w FROM e GROUP BY 1, 2), {', '.join(walks)},
best AS MATERIALIZED (SELECT o, v, c, min(h) AS h FROM ({every}) JOIN (SELECT o, v, min(c) AS c FROM ({every}) GROUP BY 1, 2) USING (o, v, c) GROUP BY 1, 2, 3),
tree AS MATERIALIZED (SELECT b.o, b.v, min(a.v) AS pred FROM best b JOIN g ON g.dst = b.v JOIN best a ON a.o = b.o AND a.v = g.src WHERE round(a.c + g.w, 9) = b.c AND a.h + 1 = b.h GROUP BY 1, 2),
back AS (SELECT o, v, pred FROM tree UNION ALL SELECT back.o, t.v, t.pred FROM back JOIN tree t ON t.o = back.o AND t.v = back.pred)"""


@query("route_frequencies", f"WITH RECURSIVE {routes_sql()} SELECT pred AS src, v AS dst, count(*) AS routes FROM back GROUP BY 1, 2")
def route_frequencies(t):
    return network.route_frequencies(network.orient_edges(roads(t)), t.nation.select("n_nationkey"), t.nation.select("n_nationkey"))
