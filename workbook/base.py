"""Sources, cleaning, reshape, joins, aggregation, windows, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import clean_code, half_even, safe_denominator, safe_div
from tallyloom.operators import aggregate as agg
from tallyloom.operators import clean, joins, reshape, windows
from tallyloom.operators.grouping import first_rows
from tallyloom.operators.ordering import add_lags
from tallyloom.session import scratch_path
from tallyloom.sources import (
    collect_periods, conform_table, lower_columns, read_many, read_partition, stage, write_partitioned,
)

from .registry import query

# ---------------------------------------------------------------- sources and sinks


def orders_by_year(t):
    df = t.orders.withColumns({"aar": F.year("o_orderdate"), "skjema": F.col("o_orderstatus")})
    return write_partitioned(df, scratch_path(t.spark, "orders"), ["skjema", "aar"])


@query("scan_partition", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1998""")
def scan_partition(t):
    base = orders_by_year(t)
    return read_partition(t.spark, base, skjema="F", aar=1998).select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_many", """
SELECT c_nationkey AS nation, count(*) AS n FROM (
  SELECT c_nationkey FROM customer UNION ALL SELECT c_nationkey FROM customer) GROUP BY 1""")
def scan_many(t):
    return read_many(t.spark, [t.path("customer"), t.path("customer")], "*.parquet") \
        .groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_projected", "SELECT l_orderkey, l_quantity FROM lineitem")
def scan_projected(t):
    return t.lineitem.select("l_orderkey", "l_quantity")


@query("scan_filtered", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_returnflag IN ('A', 'N') AND l_quantity >= 45""")
def scan_filtered(t):
    return t.lineitem.where(F.col("l_returnflag").isin("A", "N") & (F.col("l_quantity") >= 45)) \
        .select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("collect_periods", """
SELECT year(o_orderdate) AS year, o_orderstatus AS skjema, count(*) AS n, sum(o_totalprice) AS total
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2""",
       dbl="total", digits=2)
def collect_periods_q(t):
    df = collect_periods(t.spark, orders_by_year(t), [1996, 1997, 1998, 1999], ["F", "O"], "error")
    return df.groupBy("year", "skjema").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("roundtrip_parquet", """
SELECT o_orderkey, o_totalprice, o_orderstatus AS skjema, CAST(year(o_orderdate) AS INTEGER) AS aar FROM orders""")
def roundtrip_parquet(t):
    return t.spark.read.parquet(orders_by_year(t)).select("o_orderkey", "o_totalprice", "skjema", "aar")


@query("stage_reuse", """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""", dbl="quantity")
def stage_reuse(t):
    path = scratch_path(t.spark, "stage")

    def build():
        return agg.group_sum(t.lineitem.withColumn("one", F.lit(1)), ["l_returnflag"], ["l_quantity", "one"])
    stage(t.spark, path, build)
    return stage(t.spark, path, build, reuse=True).select(
        "l_returnflag", F.col("sum_one").cast("long").alias("n"), F.col("sum_l_quantity").alias("quantity"))


@query("conform_table", """
SELECT s_suppkey AS id, s_nationkey AS land, CAST(2023 AS INTEGER) AS year FROM supplier""")
def conform_table_q(t):
    return conform_table(t.supplier, {"s_suppkey": "id", "s_nationkey": "land"}, {"year": 2023}, ["s_name", "s_acctbal"])


@query("count_by_source", """
SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2""")
def count_by_source(t):
    return agg.count_by_source(t.orders.withColumn("year", F.year("o_orderdate").cast("long")), ["o_orderstatus", "year"])


# ---------------------------------------------------------------- projection, filter, cleaning

@query("select_rename", "SELECT p_partkey AS id, p_brand AS naring, p_retailprice AS pris FROM part")
def select_rename(t):
    return clean.select_rename(t.part, {"p_partkey": "id", "p_brand": "naring", "p_retailprice": "pris"})


@query("parse_number", r"""
WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' ' || replace(CAST(value AS VARCHAR), '.', ',') || ' '
   WHEN 'error' THEN CAST(value AS VARCHAR) || 'f' WHEN 'view' THEN 'NaN' WHEN 'signup' THEN ''
   ELSE CAST(value AS VARCHAR) END AS txt FROM events)
SELECT event_id, CASE WHEN regexp_full_match(replace(trim(txt), ',', '.'),
  '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
  THEN TRY_CAST(replace(trim(txt), ',', '.') AS DOUBLE) END AS number FROM s""", dbl="number")
def parse_number_q(t):
    v = F.col("value").cast("string")
    txt = F.when(F.col("event_type") == "click", F.concat(F.lit(" "), F.replace(v, F.lit("."), F.lit(",")), F.lit(" "))) \
        .when(F.col("event_type") == "error", F.concat(v, F.lit("f"))).when(F.col("event_type") == "view", "NaN") \
        .when(F.col("event_type") == "signup", "").otherwise(v)
    return clean.parse_columns(t.events.withColumn("number", txt), ["number"]).select("event_id", "number")


@query("coerce_numeric", r"""
SELECT p_partkey, TRY_CAST(CASE WHEN regexp_full_match(replace(p_brand, 'Brand#', ''), '[0-9]+') THEN replace(p_brand, 'Brand#', '') END AS DOUBLE) AS brand_no,
  CAST(NULL AS DOUBLE) AS p_type, CAST(p_size AS DOUBLE) AS p_size FROM part""")
def coerce_numeric(t):
    df = t.part.withColumn("brand_no", F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    return clean.coerce_numeric(df, ["brand_no", "p_type", "p_size"]).select("p_partkey", "brand_no", "p_type", "p_size")


@query("floor_zero", """
SELECT c_custkey, greatest(coalesce(CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal - 4000 END, 0), 0) AS balance
FROM customer""", dbl="balance")
def floor_zero(t):
    df = t.customer.withColumn("balance", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") - 4000))
    return clean.floor_zero(df, ["balance"]).select("c_custkey", "balance")


GAPS = "CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice END"


def with_gaps(t):
    """lineitem with the value missing where no tax is given."""
    return t.lineitem.withColumn("x", F.when(F.col("l_tax") != 0, F.col("l_extendedprice")))


@query("fill_const", f"""
SELECT l_orderkey, l_linenumber, coalesce({GAPS}, 0) AS x,
  coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END, 'missing') AS flag FROM lineitem""")
def fill_const(t):
    df = with_gaps(t).withColumn("flag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    return clean.fill_const(df, {"x": 0.0, "flag": "missing"}).select("l_orderkey", "l_linenumber", "x", "flag")


@query("fill_from", f"""
SELECT l_orderkey, l_linenumber, coalesce({GAPS}, l_quantity * 1000) AS x FROM lineitem""")
def fill_from(t):
    return clean.fill_from(with_gaps(t), "x", F.col("l_quantity") * 1000).select("l_orderkey", "l_linenumber", "x")


@query("safe_ratio", """
SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem""", dbl="ratio")
def safe_ratio(t):
    return clean.safe_ratio(t.lineitem, "ratio", "l_extendedprice", "l_discount").select("l_orderkey", "l_linenumber", "ratio")


@query("fill_group_mean", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, {GAPS} AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(x, avg(x) OVER (PARTITION BY l_suppkey)) AS x FROM s""", dbl="x", digits=4)
def fill_group_mean(t):
    return clean.fill_group_mean(with_gaps(t), "x", ["l_suppkey"]).select("l_orderkey", "l_linenumber", "x")


@query("fill_mean", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, {GAPS} AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(x, (SELECT avg(x) FROM s)) AS x FROM s""", dbl="x", digits=4)
def fill_mean(t):
    return clean.fill_mean(with_gaps(t), "x").select("l_orderkey", "l_linenumber", "x")


@query("fill_when", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, {GAPS} AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN coalesce(x, 0) ELSE x END AS x FROM s""")
def fill_when(t):
    return clean.fill_when(with_gaps(t), ["x"], F.col("l_quantity") < 10).select("l_orderkey", "l_linenumber", "x")


@query("code_prefixes", """
SELECT p_partkey, substring(p_brand, 1, 5) AS n2, substring(p_brand, 1, 7) AS n3, substring(p_brand, 1, 8) AS n4 FROM part""")
def code_prefixes(t):
    return clean.code_prefixes(t.part, "p_brand", {"n2": 5, "n3": 7, "n4": 8}).select("p_partkey", "n2", "n3", "n4")


@query("filter_prefix", """
SELECT p_partkey, p_type FROM part WHERE substring(p_type, 1, 2) IN ('EC', 'ST')
  AND substring(p_brand, 1, 7) IN (SELECT DISTINCT substring(p_brand, 1, 7) FROM part WHERE p_retailprice >= 950)""")
def filter_prefix(t):
    df = clean.filter_prefix(t.part, "p_type", 2, ["EC", "ST"])
    dear = t.part.where(F.col("p_retailprice") >= 950).select("p_brand")
    return clean.filter_prefix(df, "p_brand", 7, dear).select("p_partkey", "p_type")


@query("drop_missing", f"SELECT l_orderkey, l_linenumber, x FROM (SELECT *, {GAPS} AS x FROM lineitem) WHERE x IS NOT NULL")
def drop_missing(t):
    return clean.drop_missing(with_gaps(t), ["x"]).select("l_orderkey", "l_linenumber", "x")


@query("split_complete", """
SELECT CASE WHEN l_tax = 0 OR l_discount = 0 THEN 'incomplete' ELSE 'complete' END AS part, count(*) AS n,
  sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""", dbl="quantity")
def split_complete(t):
    df = with_gaps(t).withColumn("d", F.when(F.col("l_discount") != 0, F.col("l_discount")))
    whole, gaps = clean.split_complete(df, ["x", "d"])
    both = whole.withColumn("part", F.lit("complete")).unionByName(gaps.withColumn("part", F.lit("incomplete")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("deny_ids", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '1-URGENT')")
def deny_ids(t):
    return clean.deny_ids(t.orders, "o_orderpriority", ["5-LOW", "1-URGENT"]).select("o_orderkey", "o_orderpriority")


@query("clean_code", """
SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS code FROM supplier""")
def clean_code_q(t):
    raw = F.concat(F.lit(" '"), F.col("s_nationkey").cast("string"), F.lit("' "))
    return t.supplier.select("s_suppkey", clean_code(raw, 4).alias("code"))


@query("set_when", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE o_orderstatus END AS size
FROM orders""")
def set_when(t):
    df = t.orders.withColumn("size", F.col("o_orderstatus"))
    return clean.set_when(df, "size", (F.col("o_totalprice") > 300000, F.lit("large")),
                          (F.col("o_totalprice") > 100000, F.lit("medium"))).select("o_orderkey", "size")


@query("relabel", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS kept,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS nulled FROM orders""")
def relabel(t):
    names = {"F": "finished", "O": "open"}
    df = clean.relabel(t.orders, "o_orderstatus", names, "keep", "kept")
    return clean.relabel(df, "o_orderstatus", names, "null", "nulled").select("o_orderkey", "kept", "nulled")


@query("fix_unit_error", """
WITH s AS (SELECT o.o_orderkey, l_linenumber, l_partkey, l_suppkey, o_totalprice AS total, l_extendedprice * 10 AS part, l_quantity FROM lineitem JOIN orders o ON l_orderkey = o_orderkey)
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN part > total THEN CASE WHEN part / 1000 > total THEN l_quantity ELSE part / 1000 END ELSE part END AS part
FROM s""", dbl="part")
def fix_unit_error(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")) \
        .withColumn("part", F.col("l_extendedprice") * 10)
    return clean.fix_unit_error(df, "part", "o_totalprice", 1000.0, "l_quantity") \
        .select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "part")


@query("round_half_even", """
SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 1.37, 0) AS whole, round_even(l_extendedprice / 7.0, 4) AS four FROM lineitem""")
def round_half_even(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             half_even(F.col("l_extendedprice") * 1.37).alias("whole"),
                             half_even(F.col("l_extendedprice") / 7.0, 4).alias("four"))


@query("filter_range", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_range(t):
    return clean.filter_range(t.part, "p_size", 10, 20).select("p_partkey", "p_size")


@query("filter_selected", "SELECT p_partkey, p_type, p_brand FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def filter_selected(t):
    return clean.filter_selected(t.part, {"p_type": ["PROMO", "SMALL"], "p_brand": "All"}).select("p_partkey", "p_type", "p_brand")


@query("trim_outliers", """
WITH a AS (SELECT event_id, event_type, value FROM events
  WHERE value BETWEEN (SELECT avg(value) - 2 * stddev_samp(value) FROM events) AND (SELECT avg(value) + 2 * stddev_samp(value) FROM events)),
b AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM a)
SELECT event_id, event_type, value FROM b WHERE value BETWEEN m - 2 * s AND m + 2 * s""")
def trim_outliers(t):
    df = clean.trim_outliers(t.events.select("event_id", "event_type", "value"), "value", 2.0)
    return clean.trim_outliers(df, "value", 2.0, ["event_type"])


@query("encode_codes", """
WITH a AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS sorted_code FROM (SELECT DISTINCT p_brand FROM part)),
b AS (SELECT p_brand, row_number() OVER (ORDER BY f) - 1 AS seen_code FROM (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY 1))
SELECT p_partkey, sorted_code, seen_code FROM part JOIN a USING (p_brand) JOIN b USING (p_brand)""")
def encode_codes(t):
    df = clean.encode_codes(t.part, "p_brand", name="sorted_code")
    return clean.encode_codes(df, "p_brand", order="p_partkey", name="seen_code").select("p_partkey", "sorted_code", "seen_code")


@query("min_class_size", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 25 FROM part))""")
def min_class_size(t):
    return clean.min_class_size(t.part, "p_brand", -(-t.part.count() // 25)).select("p_partkey", "p_brand")


@query("drop_zero_total", """
SELECT o_orderkey, coalesce(sum(l_extendedprice), 0) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING coalesce(sum(l_extendedprice), 0) <> 0""",
       dbl="total", digits=2)
def drop_zero_total(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"))
    df = t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0.0)
    return clean.drop_zero_total(df, ["total"])


@query("safe_denominator", """
SELECT l_orderkey, l_linenumber, l_extendedprice / coalesce(nullif(l_discount, 0), 1) AS per_one, l_extendedprice / nullif(l_discount, 0) AS per_missing FROM lineitem""",
       dbl="per_one per_missing")
def safe_denominator_q(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             safe_div("l_extendedprice", safe_denominator("l_discount", 1.0)).alias("per_one"),
                             safe_div("l_extendedprice", safe_denominator("l_discount", None)).alias("per_missing"))


@query("add_residuals", """
SELECT l_orderkey, l_linenumber, l_extendedprice - (l_quantity * 1500 - 3000) AS residual,
  CAST(l_extendedprice > 0 AS INTEGER) AS positive, CAST(l_quantity * 1500 - 3000 < 0 AS INTEGER) AS negative_prediction FROM lineitem""",
       dbl="residual")
def add_residuals(t):
    df = t.lineitem.withColumn("yhat", F.col("l_quantity") * 1500 - 3000)
    return clean.add_residuals(df, "l_extendedprice", "yhat").select(
        "l_orderkey", "l_linenumber", "residual", "positive", "negative_prediction")


# ---------------------------------------------------------------- reshape

LONG = """(SELECT user_id, event_id AS lopenr, upper(event_type) AS feltnavn,
  CASE WHEN value < 5 THEN NULL ELSE CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) END AS feltverdi FROM events)"""


def long_answers(t):
    return t.events.select(
        "user_id", F.col("event_id").alias("lopenr"), F.upper("event_type").alias("feltnavn"),
        F.when(F.col("value") >= 5, F.round(F.col("value") * 100).cast("long").cast("string")).alias("feltverdi"))


def _first(field):
    return f"arg_min(feltverdi, lopenr) FILTER (WHERE feltnavn = '{field}' AND feltverdi IS NOT NULL) AS {field.lower()}"


@query("eav_pivot", f"""
SELECT user_id, {_first('CLICK')}, {_first('PURCHASE')}, {_first('VIEW')}, CAST(NULL AS VARCHAR) AS other
FROM {LONG} WHERE feltnavn IN ('CLICK', 'PURCHASE', 'VIEW') AND feltverdi IS NOT NULL GROUP BY 1""")
def eav_pivot(t):
    return lower_columns(reshape.eav_pivot(long_answers(t), ["user_id"], "feltnavn", "feltverdi",
                                           ["CLICK", "PURCHASE", "VIEW", "OTHER"], "lopenr"))


LEVELS = """(SELECT o_orderkey AS id, 0 AS radnr, o_orderstatus AS status, o_totalprice AS amount FROM orders
UNION ALL SELECT l_orderkey, l_linenumber + 1, NULL, l_extendedprice FROM lineitem)"""


def two_levels(t):
    up = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("radnr"),
                         F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    down = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") + 1).alias("radnr"),
                             F.lit(None).cast("string").alias("status"), F.col("l_extendedprice").alias("amount"))
    return up.unionByName(down)


@query("split_levels", f"""
WITH p AS (SELECT id, status FROM {LEVELS} WHERE radnr = 0), c AS (SELECT id, radnr, amount FROM {LEVELS} WHERE radnr > 0)
SELECT id, radnr, status, amount FROM p JOIN c USING (id)""")
def split_levels(t):
    up, down = reshape.split_levels(two_levels(t), "radnr", ["id", "status"], ["status"])
    return joins.join_tables(up, down, ["id"], "inner").select("id", "radnr", "status", "amount")


@query("parent_to_children", f"""
SELECT id, radnr, status, amount FROM (
  SELECT id, radnr, max(CASE WHEN radnr = 0 THEN status END) OVER (PARTITION BY id) AS status, amount FROM {LEVELS}) WHERE radnr > 0""")
def parent_to_children(t):
    return reshape.parent_to_children(two_levels(t), ["id"], "radnr", ["status"])


@query("pivot_wide", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS s_F,
  coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) AS s_O, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'X'), 0) AS s_X
FROM orders GROUP BY 1""", dbl="s_F s_O s_X", digits=2)
def pivot_wide(t):
    df = t.orders.withColumn("year", F.year("o_orderdate"))
    return reshape.pivot_wide(df, "year", "o_orderstatus", F.sum("o_totalprice"), ["F", "O", "X"], prefix="s_")


@query("pivot_flag", """
SELECT l_orderkey, sum(l_extendedprice) FILTER (WHERE l_returnflag <> 'R') AS flag0, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS flag1
FROM lineitem GROUP BY 1""", dbl="flag0 flag1", digits=2)
def pivot_flag(t):
    df = t.lineitem.withColumn("flag", (F.col("l_returnflag") == "R").cast("int"))
    return reshape.pivot_flag(df, ["l_orderkey"], "flag", "l_extendedprice")


@query("conform_form", """
SELECT o_orderkey AS id, o_custkey AS orgnr, o_totalprice AS tmp_no_omsetn, coalesce(x, 0) AS tmp_no_p4005, o_totalprice AS copied
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
       dbl="tmp_no_p4005", digits=2)
def conform_form(t):
    published = t.lineitem.groupBy(F.col("l_orderkey").alias("enhets_id")).agg(F.sum("l_extendedprice").alias("nopost_p4005"))
    out = reshape.conform_form(
        t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice"),
        {"o_custkey": "orgnr", "o_totalprice": "tmp_no_omsetn"},
        [(published, {"enhets_id": "id", "nopost_p4005": "tmp_no_p4005"})], "id",
        {"tmp_no_p4005": 0.0}, {"copied": "tmp_no_omsetn"})
    return out.select("id", "orgnr", "tmp_no_omsetn", "tmp_no_p4005", "copied")


LINES_SQL = "(SELECT l_orderkey AS id, sum(l_extendedprice) AS oms, sum(l_quantity) AS syss, max(l_linestatus) AS mode FROM lineitem WHERE {} GROUP BY 1)"


def published(t, where, **names):
    """Published figures per order: sums over some of its lines."""
    sums = t.lineitem.where(where).groupBy(F.col("l_orderkey").alias("enhets_id")).agg(
        F.sum("l_extendedprice").alias("oms"), F.sum("l_quantity").alias("syss"), F.max("l_linestatus").alias("mode"))
    return sums.select("enhets_id", *[F.col(b).alias(a) for a, b in names.items()])


@query("conform_form_1100", f"""
SELECT o_orderkey AS id, o_totalprice AS gjeldende_omsetn_kr, o_totalprice * 0.8 AS driftskost_kr, o_orderpriority AS tmp_sn2007_5, o_orderstatus AS regtype, CAST(o_custkey AS DOUBLE) AS gjeldende_bdr_syss,
  coalesce(p.syss, 0) AS tmp_no_p4005, p.oms AS tmp_no_omsetn, p.mode AS nacef_5, coalesce(l.syss, 0) AS fjor_syssel_t1, l.oms AS fjor_omsetn_kr_t1
FROM orders LEFT JOIN {LINES_SQL.format("l_returnflag = 'N'")} p ON p.id = o_orderkey LEFT JOIN {LINES_SQL.format("l_returnflag = 'R'")} l ON l.id = o_orderkey""",
       dbl="gjeldende_omsetn_kr driftskost_kr gjeldende_bdr_syss tmp_no_p4005 tmp_no_omsetn fjor_syssel_t1 fjor_omsetn_kr_t1", digits=2)
def conform_form_1100(t):
    """Form RA-1100: renamed answers, figures of the enterprise and of last year's establishment, employees copied."""
    form = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("b_omsetning"), (F.col("o_totalprice") * 0.8).alias("b_driftskostnader"),
                           F.col("o_orderpriority").alias("tmp_b_sn07_1"), F.col("o_orderstatus").alias("reg_type_bedrift"), F.col("o_custkey").cast("double").alias("b_sysselsetting_syss"))
    enterprises = published(t, "l_returnflag = 'N'", nopost_p4005="syss", omsetning="oms", naring_f="mode")
    last = published(t, "l_returnflag = 'R'", sysselsetting_syss="syss", omsetning="oms")
    out = reshape.conform_known_form(form, "RA-1100", 2022, enterprises, last)
    return out.select("id", "gjeldende_omsetn_kr", "driftskost_kr", "tmp_sn2007_5", "regtype", "gjeldende_bdr_syss", "tmp_no_p4005", "tmp_no_omsetn", "nacef_5", "fjor_syssel_t1", "fjor_omsetn_kr_t1")


@query("conform_form_1403", "SELECT o_orderkey AS id, o_totalprice AS tmp_no_omsetn FROM orders", dbl="tmp_no_omsetn", digits=2)
def conform_form_1403(t):
    return reshape.conform_known_form(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("tmp_oms")), "RA-1403", 2022)


# ---------------------------------------------------------------- joins

@query("join_left", """
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def join_left(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return joins.join_tables(t.orders.select("o_orderkey"), lines, ["o_orderkey"])


@query("join_inner", """
SELECT n_name, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""", dbl="total", digits=2)
def join_inner(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    df = joins.join_tables(t.orders.select("o_custkey", "o_totalprice"), c, ["o_custkey"], "inner")
    df = joins.join_tables(df, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], "inner")
    return df.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("join_full", """
WITH a AS (SELECT l_orderkey, sum(l_extendedprice) AS sum_r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_orderkey, sum(l_extendedprice) AS sum_other FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT l_orderkey, sum_r, sum_other FROM a FULL JOIN b USING (l_orderkey)""", dbl="sum_r sum_other", digits=2)
def join_full(t):
    r = F.col("l_returnflag") == "R"
    a = t.lineitem.where(r).groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("sum_r"))
    b = t.lineitem.where(~r).groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("sum_other"))
    return joins.join_tables(a, b, ["l_orderkey"], "full")


@query("anti_rows", """
SELECT p_brand, p_type, p_size FROM part EXCEPT SELECT p_brand, p_type, p_size FROM part WHERE p_retailprice >= 950""")
def anti_rows(t):
    cols = ["p_brand", "p_type", "p_size"]
    return joins.anti_rows(t.part.select(*cols), t.part.where("p_retailprice >= 950").select(*cols)).distinct()


@query("semi_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_ids(t):
    return joins.keep_ids(t.orders.select("o_orderkey"), t.lineitem.where("l_returnflag = 'R'").select("l_orderkey"), "o_orderkey")


@query("anti_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_ids(t):
    return joins.keep_ids(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey"), "o_orderkey", False)


@query("lookup_cross_key", """
SELECT c_custkey, m.mean_bal FROM customer LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS mean_bal FROM supplier GROUP BY 1) m ON c_nationkey = s_nationkey""",
       dbl="mean_bal")
def lookup_cross_key(t):
    means = agg.group_mean(t.supplier, ["s_nationkey"], ["s_acctbal"])
    return joins.lookup(t.customer, "c_nationkey", means, "s_nationkey", "mean_s_acctbal", "mean_bal").select("c_custkey", "mean_bal")


@query("update_from", """
SELECT o_orderkey, coalesce(x, o_totalprice) AS o_totalprice FROM orders LEFT JOIN
(SELECT l_orderkey, sum(l_extendedprice) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey""",
       dbl="o_totalprice", digits=2)
def update_from(t):
    u = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")) \
        .agg(F.sum("l_extendedprice").alias("o_totalprice"))
    return joins.update_from(t.orders.select("o_orderkey", "o_totalprice"), u, ["o_orderkey"], ["o_totalprice"])


@query("update_matched", """
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN o_totalprice ELSE coalesce(x, 0) END AS o_totalprice FROM orders LEFT JOIN
(SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS x FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
       dbl="o_totalprice", digits=2)
def update_matched(t):
    u = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("o_totalprice"))
    return joins.update_matched(t.orders.select("o_orderkey", "o_totalprice"), u, ["o_orderkey"], "o_totalprice")


# ---------------------------------------------------------------- aggregation

@query("group_sum", """
SELECT l_suppkey, coalesce(sum(l_extendedprice), 0) AS sum_l_extendedprice, coalesce(sum(l_quantity), 0) AS sum_l_quantity FROM lineitem GROUP BY 1""",
       dbl="sum_l_extendedprice sum_l_quantity", digits=2)
def group_sum(t):
    return agg.group_sum(t.lineitem, ["l_suppkey"], ["l_extendedprice", "l_quantity"])


@query("sum_when", """
SELECT l_orderkey, coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0) AS helper,
  coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag <> 'R'), 0) AS rest FROM lineitem GROUP BY 1""", dbl="helper rest", digits=2)
def sum_when(t):
    r = F.col("l_returnflag") == "R"
    return agg.sum_when(t.lineitem, ["l_orderkey"], "l_extendedprice", {"helper": r, "rest": ~r})


@query("group_mean", "SELECT p_brand, avg(p_retailprice) AS mean_p_retailprice FROM part GROUP BY 1", dbl="mean_p_retailprice")
def group_mean(t):
    return agg.group_mean(t.part, ["p_brand"], ["p_retailprice"])


@query("mean_of_ratios", """
SELECT l_suppkey, avg(l_extendedprice / nullif(l_discount, 0)) AS mean_ratio FROM lineitem GROUP BY 1""", dbl="mean_ratio", digits=4)
def mean_of_ratios(t):
    return agg.mean_of_ratios(t.lineitem, "l_extendedprice", "l_discount", ["l_suppkey"])


@query("group_counts", """
SELECT l_suppkey, count(*) AS n_rows, count(*) FILTER (WHERE l_tax > 0) AS n_positive, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1""")
def group_counts(t):
    return agg.group_counts(t.lineitem, ["l_suppkey"], "l_tax", "l_partkey")


@query("row_max_sum", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(x, l_quantity * 1000) AS largest, coalesce(x, 0) + coalesce(l_quantity, 0) AS total
FROM (SELECT *, {GAPS} AS x FROM lineitem)""", dbl="largest total")
def row_max_sum(t):
    df = with_gaps(t).withColumn("q", F.col("l_quantity") * 1000)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", agg.row_max(["x", "q"]).alias("largest"),
                     agg.row_sum(["x", "l_quantity"]).alias("total"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity").distinct()


@query("dedup_first", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_first(t):
    return first_rows(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"],
                      ["l_orderkey", "l_linenumber", "l_partkey"])


@query("dedup_none", """
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def dedup_none(t):
    return agg.dedup_none(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query("multi_level_totals", """
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, p_type AS n3, c_nationkey AS region, l_extendedprice AS oms, l_quantity AS syss
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)
SELECT year, n3, region, CAST(CASE WHEN grouping(region) = 1 THEN 0 ELSE 1 END AS INTEGER) AS level, sum(oms) AS oms, sum(syss) AS syss,
  sum(oms) / nullif(sum(syss), 0) AS oms_pr_syss FROM s GROUP BY GROUPING SETS ((year, n3), (year, n3, region))""",
       dbl="oms syss oms_pr_syss", digits=6)
def multi_level_totals(t):
    return agg.multi_level_totals(sales(t), [["year", "n3"], ["year", "n3", "region"]], ["oms", "syss"],
                                  {"oms_pr_syss": ("oms", "syss")})


def sales(t):
    """Lines with year, industry and region of the buyer."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")) \
        .join(t.part, F.col("l_partkey") == F.col("p_partkey")) \
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.year("o_orderdate").alias("year"), F.col("p_type").alias("n3"), F.col("p_brand").alias("n4"),
                F.col("c_nationkey").alias("region"), F.col("l_extendedprice").alias("oms"),
                F.col("l_quantity").alias("syss"), "l_orderkey", "l_returnflag")


@query("impute_simple", """
WITH s AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value, CASE WHEN value < 20 THEN NULL ELSE event_type END AS kind FROM events)
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM s)) AS value,
  coalesce(kind, (SELECT kind FROM s WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM s""", dbl="value")
def impute_simple(t):
    df = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
                         F.when(F.col("value") >= 20, F.col("event_type")).alias("kind"))
    return agg.impute_simple(df, ["value"], ["kind"])


@query("null_counts", f"""
SELECT 'x' AS "column", count(*) FILTER (WHERE x IS NULL) AS missing FROM (SELECT {GAPS} AS x FROM lineitem)
UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity IS NULL) FROM lineitem""")
def null_counts(t):
    return agg.null_counts(with_gaps(t).select("x", "l_quantity"))


@query("control_totals", """
WITH p AS (SELECT c_nationkey AS region, sum(o_totalprice) AS parent_oms FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
c AS (SELECT c_nationkey AS region, sum(l_extendedprice) AS child_oms FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT region, parent_oms, child_oms, parent_oms - coalesce(child_oms, 0) AS diff_oms FROM p LEFT JOIN c USING (region)""",
       dbl="parent_oms child_oms diff_oms", digits=2)
def control_totals(t):
    up = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("region"), "o_orderkey", "o_totalprice")
    down = t.lineitem.join(up.drop("o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return agg.control_totals(up, down, ["region"], {"oms": ("o_totalprice", "l_extendedprice")})


@query("histogram", """
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10.0)), 9) AS INTEGER) AS bin FROM orders, m)
SELECT CAST(r.range AS INTEGER) AS bin, lo + r.range * ((hi - lo) / 10.0) AS lo, lo + (r.range + 1) * ((hi - lo) / 10.0) AS hi,
  (SELECT count(*) FROM b WHERE b.bin = r.range) AS n FROM range(10) r, m""", dbl="lo hi", digits=2)
def histogram(t):
    return agg.histogram(t.orders, "o_totalprice", 10)


@query("fit_line", """
SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
  corr(l_quantity, l_extendedprice) AS corr, count(*) AS n FROM lineitem GROUP BY 1""", dbl="slope intercept corr", digits=4)
def fit_line(t):
    return agg.fit_line(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])


# ---------------------------------------------------------------- windows

@query("group_total", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS total_l_extendedprice FROM lineitem""",
       dbl="total_l_extendedprice", digits=2)
def group_total(t):
    return windows.group_total(t.lineitem, "l_extendedprice", ["l_orderkey"], F.col("l_returnflag") == "R") \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total_l_extendedprice")


@query("group_share", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 0) AS share FROM lineitem""", dbl="share")
def group_share(t):
    return windows.group_share(t.lineitem, "l_extendedprice", ["l_orderkey"], "share") \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share")


@query("group_flags", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(CAST(l_returnflag = 'R' AS INTEGER)) OVER w AS any_flag,
  count(*) OVER w AS group_size, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS first_value
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def group_flags(t):
    return windows.group_flags(t.lineitem, ["l_orderkey"], F.col("l_returnflag") == "R", "l_partkey",
                               ["l_linenumber", "l_partkey", "l_suppkey"]) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "any_flag", "group_size", "first_value")


@query("repeated_ids", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def repeated_ids(t):
    return windows.repeated_ids(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")


@query("concentration_curve", """
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS oms FROM orders GROUP BY 1, 2)
SELECT year, o_custkey, CAST(oms AS DOUBLE) AS oms, row_number() OVER w AS position, sum(oms) OVER (w ROWS UNBOUNDED PRECEDING) AS running_total,
  CAST(sum(oms) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100 / CAST(sum(oms) OVER (PARTITION BY year) AS DOUBLE) AS running_percent
FROM s WINDOW w AS (PARTITION BY year ORDER BY oms DESC, o_custkey)""", dbl="oms running_total running_percent", digits=4)
def concentration_curve(t):
    s = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_custkey") \
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("oms"))
    return windows.concentration_curve(s, ["year"], "oms", ["o_custkey"])


@query("rank_within", """
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT year, region, n, dense_rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank FROM s""")
def rank_within(t):
    s = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .groupBy(F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return windows.rank_within(s, ["year"], "n")


PANEL = """(SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS oms FROM orders GROUP BY 1, 2)"""


def panel(t):
    """One row per customer and year."""
    return t.orders.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year")) \
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("oms"))


@query("add_lags", f"""
SELECT * FROM (SELECT unit, year, oms, lag(oms, 1) OVER w AS oms_lag1, lag(oms, 2) OVER w AS oms_lag2 FROM {PANEL} WINDOW w AS (PARTITION BY unit ORDER BY year))
WHERE oms_lag2 IS NOT NULL""", dbl="oms oms_lag1 oms_lag2", digits=2)
def add_lags_q(t):
    return add_lags(panel(t), ["unit"], ["year"], "oms", 2)


@query("linear_trend", f"""
WITH p AS (SELECT unit, year, CASE WHEN year = 1997 AND oms < 50000 THEN NULL ELSE oms END AS oms FROM {PANEL}),
f AS (SELECT unit, regr_slope(oms, year) FILTER (WHERE year < 2000) AS b, avg(oms) FILTER (WHERE year < 2000) AS ym,
  avg(year) FILTER (WHERE year < 2000 AND oms IS NOT NULL) AS xm, count(*) FILTER (WHERE year < 2000) AS n, count(oms) FILTER (WHERE year < 2000) AS ny FROM p GROUP BY 1)
SELECT unit, year, oms, CASE WHEN n = ny AND n >= 2 THEN ym + coalesce(b, 0) * (year - xm) END AS trend FROM p JOIN f USING (unit)""",
       dbl="oms trend", digits=6)
def linear_trend(t):
    p = panel(t).withColumn("oms", F.when((F.col("year") == 1997) & (F.col("oms") < 50000), None).otherwise(F.col("oms")))
    return windows.linear_trend(p, ["unit"], "year", "oms", 2000)


@query("period_change", f"""
WITH s AS (SELECT unit, year, sum(CASE WHEN oms < 20000 THEN 0 ELSE oms END) AS total FROM {PANEL} GROUP BY 1, 2)
SELECT a.unit, a.year, a.total, b.total AS previous, CASE WHEN b.total = 0 THEN 0 ELSE (a.total - b.total) / b.total * 100 END AS change_percent
FROM s a LEFT JOIN s b ON a.unit = b.unit AND a.year = b.year + 1""", dbl="total previous change_percent", digits=4)
def period_change(t):
    p = panel(t).withColumn("oms", F.when(F.col("oms") < 20000, 0.0).otherwise(F.col("oms")))
    return windows.period_change(p, ["unit"], "year", "oms")


# ---------------------------------------------------------------- sort, top-k, sets

@query("sort_multi", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def sort_multi(t):
    return t.supplier.select("s_nationkey", "s_acctbal", "s_suppkey").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("top_k", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15")
def top_k(t):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return agg.top_k(n, [F.desc("n"), F.col("o_custkey")], 15)


@query("top_k_per_group", """
SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3""")
def top_k_per_group(t):
    return first_rows(t.lineitem.select("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber"), ["l_suppkey"],
                      [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3)


@query("union_all", """
SELECT c_custkey AS id, c_nationkey AS region, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier""")
def union_all(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("segment"))
    return joins.union_all(a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("region")))


@query("symmetric_diff", """
WITH u AS (SELECT c_nationkey AS k, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, s_suppkey FROM supplier)
SELECT k, id FROM u GROUP BY 1, 2 HAVING count(*) = 1""")
def symmetric_diff(t):
    return joins.symmetric_diff(t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id")),
                                t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id")))


@query("intersect_keys", "SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def intersect_keys(t):
    return joins.intersect_keys(t.orders, t.lineitem.select("l_orderkey"), "o_orderkey")
