"""Survey-editing queries: orders are enterprises, their lines establishments.

Parent total = o_totalprice, unit turnover = l_extendedprice, employees = l_quantity, unit type from l_returnflag,
industry from p_type, region from the customer's nation, year from the order date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import allocate as al
from tallyloom.operators import factors, publish, training
from tallyloom.operators.aggregate import control_totals as control
from tallyloom.operators.classify import classify_responses, scale_to_total
from tallyloom.plans import allocate_units, produce
from tallyloom.plans import feature_panel as panel
from tallyloom.session import materialise, settle

from .registry import query

KEY = ["id", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = "id, l_linenumber, l_partkey, l_suppkey"

# ---------------------------------------------------------------- classification

PARENTS = """p AS (SELECT o_orderkey AS id, o_custkey AS orgnr_n_1, c_nationkey AS region,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS total_oms, o_totalprice * 0.8 AS total_cost
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
CHILDREN = """c AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
  CASE WHEN l_linestatus = 'O' AND l_discount < 0.03 THEN 0 ELSE l_extendedprice END AS oms,
  CASE WHEN l_discount >= 0.05 THEN l_extendedprice * (1 - l_discount) END AS cost FROM lineitem)"""


def parents(t):
    low = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("orgnr_n_1"), F.col("c_nationkey").alias("region"),
        F.when(low, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("total_oms"), (F.col("o_totalprice") * 0.8).alias("total_cost"))


def children(t):
    unseen = (F.col("l_linestatus") == "O") & (F.col("l_discount") < 0.03)
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity",
        F.when(unseen, 0.0).otherwise(F.col("l_extendedprice")).alias("oms"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"))


def classify_sql(few: str, helper: bool = False) -> str:
    oms = "CASE WHEN l_returnflag = 'R' THEN cost ELSE oms END" if helper else "oms"
    return f"""
{PARENTS}, {CHILDREN},
u AS (SELECT c.* REPLACE (greatest(coalesce({oms}, 0), 0) AS oms, greatest(coalesce(cost, 0), 0) AS cost), orgnr_n_1, region, total_oms, total_cost FROM c JOIN p USING (id)),
s AS (SELECT *, sum(oms) OVER (PARTITION BY id) AS d_oms, sum(cost) OVER (PARTITION BY id) AS d_cost FROM u),
r AS (SELECT *, CASE WHEN coalesce(total_oms, 0) = 0 OR coalesce(total_cost, 0) = 0 THEN 'no_total'
   WHEN coalesce(d_oms / nullif(total_oms, 0), 0) >= 0.65 AND coalesce(round_even(d_cost / nullif(total_cost, 0), 4), 0) >= 0.65 THEN 'both'
   WHEN coalesce(d_oms / nullif(total_oms, 0), 0) > 0.65 THEN 'turnover' ELSE 'below_limit' END AS reason0 FROM s),
n AS (SELECT *, sum(CAST(reason0 = 'both' AS INTEGER)) OVER (PARTITION BY orgnr_n_1) AS n, sum(CAST(reason0 = 'both' AND oms > 0 AS INTEGER)) OVER (PARTITION BY orgnr_n_1) AS m FROM r),
q AS (SELECT *, CASE WHEN reason0 = 'both' AND {few} THEN 'few_reporting' ELSE reason0 END AS reason FROM n),
z AS (SELECT * REPLACE (CASE WHEN reason IN ('turnover', 'few_reporting') THEN NULL ELSE cost END AS cost),
  CASE reason WHEN 'both' THEN 'good' WHEN 'turnover' THEN 'good_turnover_only' WHEN 'no_total' THEN 'no_total' ELSE 'bad' END AS quality,
  CASE WHEN reason IN ('both', 'turnover') THEN round_even(oms / nullif(round_even(d_oms, 5), 0) * total_oms, 0) ELSE oms END AS new_oms FROM q)"""


BY_RATE = classify_sql("n >= 2 AND m / nullif(n, 0) <= 0.8")


@query("classify_responses", f"WITH {BY_RATE} SELECT {KEYS}, quality, reason, cost, new_oms FROM z", dbl="cost new_oms", digits=4)
def classify(t):
    return classified(t).select(*KEY, "quality", "reason", "cost", "new_oms")


def classified(t):
    return classify_responses(parents(t), children(t), ["id"], max_rate=0.8)


@query("classify_responses_count", f"""
WITH {classify_sql("n > 5 AND m <= 5", helper=True)} SELECT {KEYS}, quality, reason, cost, new_oms FROM z""", dbl="cost new_oms", digits=4)
def classify_count(t):
    return classify_responses(parents(t), children(t), ["id"], rule="count", max_reporting=5,
                              helper=F.col("l_returnflag") == "R").select(*KEY, "quality", "reason", "cost", "new_oms")


@query("reconciled_turnover", f"""
WITH {BY_RATE},
k AS (SELECT *, sum(new_oms) OVER (PARTITION BY id) AS allocated FROM z WHERE quality IN ('good', 'good_turnover_only'))
SELECT region, l_returnflag, count(*) AS units, sum(new_oms) AS turnover, count(*) FILTER (WHERE abs(total_oms - allocated) > 2) AS units_to_check
FROM k GROUP BY 1, 2""", dbl="turnover", digits=2)
def reconciled_turnover(t):
    """Flagship: classify, scale to the parent totals, reconcile, and total by region and unit type."""
    good = classified(t).where(F.col("quality").isin("good", "good_turnover_only"))
    checked = al.reconcile(good, "id", "new_oms", "total_oms", keep="all", source=children(t))
    return checked.groupBy("region", "l_returnflag").agg(
        F.count(F.lit(1)).alias("units"), F.sum("new_oms").alias("turnover"),
        F.count_if(F.abs("difference") > 2).alias("units_to_check"))


@query("scale_to_total", f"""
WITH {PARENTS}, {CHILDREN} SELECT {KEYS}, round_even(oms / nullif(sum(oms) OVER (PARTITION BY id), 0) * total_oms, 0) AS scaled FROM c JOIN p USING (id)""", dbl="scaled")
def scale_to_total_q(t):
    return scale_to_total(children(t).join(parents(t), "id"), "oms", ["id"], "total_oms").select(*KEY, "scaled")


# ---------------------------------------------------------------- allocation chain

BASE = """b AS (SELECT o_orderkey AS id, o_orderkey AS orgnr_n_1, 1 AS lopenr, l_linenumber AS radnr, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'R' THEN '04' WHEN 'A' THEN '01' ELSE '02' END AS regtype,
  CASE p_type WHEN 'ECONOMY' THEN '47.112' WHEN 'LARGE' THEN '46.310' WHEN 'MEDIUM' THEN '45.403' WHEN 'PROMO' THEN '46.110' WHEN 'SMALL' THEN '10.200' ELSE '47.300' END AS tmp_sn2007_5,
  CASE o_orderpriority WHEN '1-URGENT' THEN '47.112' WHEN '2-HIGH' THEN '46.310' WHEN '3-MEDIUM' THEN '45.310' ELSE '68.200' END AS nacef_5,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS foretak_omsetning, o_totalprice * 0.8 AS foretak_driftskostnad,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 0 ELSE l_extendedprice END AS new_oms,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 0 WHEN l_tax = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS gjeldende_driftsk_kr,
  CASE WHEN l_discount < 0.02 THEN 0 ELSE l_tax * 1000 END AS lonn, l_extendedprice * l_tax * 5 AS gjeldende_lonn_kr,
  l_quantity AS b_sysselsetting_syss, l_extendedprice * l_discount AS no4295, l_extendedprice * 0.01 AS no4995, l_quantity AS no6200,
  o_totalprice * 0.9 AS salgsint, CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice * 500 ELSE o_totalprice * 0.5 END AS forbruk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


def lines(t):
    """What units are made of, undigested: narrower than units where it is shuffled or written. Parts come first, so that all that goes by order does not move again."""
    return t.lineitem.select(*LINE).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")) \
        .join(t.orders.select(*ORDER), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "p_partkey")


def units(t, source=None, also=()):
    """``source``: :func:`lines` that are written already, with the columns ``also``."""
    def case(col, pairs, default):
        out = None
        for k, v in pairs.items():
            out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
        return out.otherwise(default)
    status, prio, price, total = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("l_extendedprice"), F.col("o_totalprice")
    if source is None:
        source = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return source.select(
            F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("orgnr_n_1"), F.lit(1).alias("lopenr"),
            F.col("l_linenumber").alias("radnr"), "l_linenumber", "l_partkey", "l_suppkey",
            case("l_returnflag", {"R": "04", "A": "01"}, "02").alias("regtype"),
            case("p_type", {"ECONOMY": "47.112", "LARGE": "46.310", "MEDIUM": "45.403", "PROMO": "46.110", "SMALL": "10.200"}, "47.300").alias("tmp_sn2007_5"),
            case("o_orderpriority", {"1-URGENT": "47.112", "2-HIGH": "46.310", "3-MEDIUM": "45.310"}, "68.200").alias("nacef_5"),
            F.when((prio == "5-LOW") & (status == "P"), 0.0).otherwise(total).alias("foretak_omsetning"),
            (total * 0.8).alias("foretak_driftskostnad"),
            F.when((prio == "1-URGENT") & (status == "O"), 0.0).otherwise(price).alias("new_oms"),
            F.when((prio == "2-HIGH") & (status == "F"), 0.0).when(F.col("l_tax") == 0, None)
            .otherwise(price * (1 - F.col("l_discount"))).alias("gjeldende_driftsk_kr"),
            F.when(F.col("l_discount") < 0.02, 0.0).otherwise(F.col("l_tax") * 1000).alias("lonn"),
            (price * F.col("l_tax") * 5).alias("gjeldende_lonn_kr"), F.col("l_quantity").alias("b_sysselsetting_syss"),
            (price * F.col("l_discount")).alias("no4295"), (price * 0.01).alias("no4995"), F.col("l_quantity").alias("no6200"),
            (total * 0.9).alias("salgsint"), F.when(prio == "3-MEDIUM", total * 500).otherwise(total * 0.5).alias("forbruk"), *also)


def unit_keys(t):
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("orgnr_n_1"))


# The chain as SQL steps; each query below shows one of them.
CHAIN = """s13 AS (SELECT * REPLACE (coalesce(gjeldende_driftsk_kr, coalesce(foretak_driftskostnad / nullif(foretak_omsetning, 0), 0) * new_oms, 0) AS gjeldende_driftsk_kr,
    CASE WHEN forbruk > foretak_driftskostnad THEN forbruk / 1000 ELSE forbruk END AS forbruk)
  FROM @source WHERE foretak_omsetning <> 0 AND foretak_driftskostnad <> 0),
a14 AS (SELECT *, sum(gjeldende_driftsk_kr) OVER w AS d, sum(b_sysselsetting_syss) OVER w AS ss FROM s13 WINDOW w AS (PARTITION BY id)),
b14 AS (SELECT *, coalesce(CASE WHEN d = 0 THEN lonn / 100 ELSE gjeldende_driftsk_kr / nullif(d, 0) END, 0) AS sh FROM a14),
s14 AS (SELECT *, round_even(CASE WHEN d = 0 AND sh = 0 THEN b_sysselsetting_syss / nullif(ss, 0) ELSE sh END, 10) * foretak_driftskostnad AS new_drkost FROM b14),
a15 AS (SELECT *, sum(CASE WHEN regtype = '04' THEN new_drkost END) OVER w AS h, sum(new_oms) OVER w AS alls, sum(CASE WHEN regtype <> '04' THEN new_oms END) OVER w AS n,
  sum(CASE WHEN regtype <> '04' THEN lonn / 100 END) OVER w AS wsum, sum(CASE WHEN regtype <> '04' THEN b_sysselsetting_syss END) OVER w AS sn FROM s14 WINDOW w AS (PARTITION BY id)),
s15 AS (SELECT * REPLACE (CASE WHEN regtype = '04' THEN new_drkost ELSE coalesce(CASE WHEN foretak_omsetning - coalesce(h, 0) = 0 THEN 1
    WHEN foretak_omsetning <> 0 AND alls = 0 THEN lonn / 100 / nullif(wsum, 0) WHEN coalesce(n, 0) <> 0 THEN new_oms / n ELSE b_sysselsetting_syss / nullif(sn, 0) END, 0)
    * (foretak_omsetning - coalesce(h, 0)) END AS new_oms) FROM a15),
a16 AS (SELECT *, CAST(substring(tmp_sn2007_5, 1, 2) IN ('45', '46', '47') AND tmp_sn2007_5 <> '45.403' AND substring(tmp_sn2007_5, 1, 4) NOT IN ('45.2', '46.1') AS INTEGER) AS own FROM s15),
s16 AS (SELECT *, CASE WHEN max(own) OVER (PARTITION BY orgnr_n_1) = 0 THEN 1 ELSE own END AS vhbed FROM a16),
a17 AS (SELECT *, min(vhbed) OVER w AS pure, sum(CASE WHEN vhbed = 1 THEN new_oms END) OVER w AS v, sum(CASE WHEN vhbed = 0 THEN new_oms END) OVER w AS a FROM s16 WINDOW w AS (PARTITION BY orgnr_n_1, lopenr)),
b17 AS (SELECT *, CASE WHEN pure = 1 THEN round_even(salgsint * (new_oms / nullif(v, 0)), 0) WHEN vhbed = 1 THEN
   CASE WHEN round_even(salgsint * (new_oms / nullif(v, 0)), 0) > new_oms THEN new_oms ELSE round_even(salgsint * (new_oms / nullif(v, 0)), 0) END END AS inc FROM a17),
c17 AS (SELECT *, CASE WHEN pure = 1 THEN round_even(forbruk * (new_oms / nullif(v, 0)), 0) WHEN vhbed = 1 THEN round_even(inc * (forbruk / nullif(salgsint, 0)), 0) END AS goods FROM b17),
d17 AS (SELECT *, sum(CASE WHEN vhbed = 1 AND pure = 0 THEN inc END) OVER w AS uinc, sum(CASE WHEN vhbed = 1 AND pure = 0 THEN goods END) OVER w AS ugoods FROM c17 WINDOW w AS (PARTITION BY orgnr_n_1, lopenr)),
s17 AS (SELECT *, CASE WHEN vhbed = 0 THEN round_even((salgsint - coalesce(uinc, 0)) * (new_oms / nullif(a, 0)), 0) ELSE inc END AS bedr_salgsint,
   CASE WHEN vhbed = 0 THEN round_even((forbruk - coalesce(ugoods, 0)) * (new_oms / nullif(a, 0)), 0) ELSE goods END AS bedr_forbruk FROM d17),
a19 AS (SELECT * REPLACE (CASE WHEN regtype = '01' AND count(*) OVER (PARTITION BY id) > 1 THEN '02' ELSE regtype END AS regtype) FROM s17),
s19 AS (SELECT * REPLACE (CASE WHEN regtype = '01' THEN foretak_omsetning ELSE new_oms END AS new_oms, CASE WHEN regtype = '01' THEN foretak_driftskostnad ELSE new_drkost END AS new_drkost,
   CASE WHEN regtype = '01' THEN salgsint ELSE bedr_salgsint END AS bedr_salgsint, CASE WHEN regtype = '01' THEN forbruk ELSE bedr_forbruk END AS bedr_forbruk) FROM a19),
a18 AS (SELECT *, coalesce(new_drkost, 0) AS hv, coalesce(gjeldende_lonn_kr, 0) + coalesce(bedr_forbruk, 0) AS fl FROM s19),
b18 AS (SELECT *, CAST(hv < fl AS INTEGER) AS thief, abs(hv - fl) AS uu FROM a18),
c18 AS (SELECT *, max(thief) OVER (PARTITION BY orgnr_n_1) AS anyt, sum(CASE WHEN thief = 0 THEN uu END) OVER w AS u0, sum(CASE WHEN thief = 1 THEN uu END) OVER w AS u1 FROM b18 WINDOW w AS (PARTITION BY orgnr_n_1, lopenr)),
s18 AS (SELECT * REPLACE (CASE WHEN anyt = 1 THEN CASE WHEN thief = 1 THEN fl ELSE coalesce(hv - round_even(uu / nullif(u0, 0) * u1, 0), hv) END ELSE hv END AS new_drkost) FROM c18),
e19 AS (SELECT * REPLACE (CASE WHEN regtype = '01' THEN foretak_driftskostnad ELSE new_drkost END AS new_drkost) FROM s18)"""
STEPS = BASE + ",\n" + CHAIN.replace("@source", "b")


def upto(t, last: str | None, source=None, also=()):
    if last is None:
        return al.fix_consumption(al.impute_by_margin(units(t)))
    return allocate_units(units(t, source, also), until=last, source=unit_keys(t))


def step_query(name: str, last: str | None, table: str, cols: str):
    @query(name, f"WITH {STEPS} SELECT {KEYS}, {', '.join(cols.split())} FROM {table}",
           dbl=" ".join(c for c in cols.split() if c not in ("regtype", "vhbed", "thief")))
    def _(t):
        return upto(t, last).select(*KEY, *cols.split())


step_query("impute_by_margin", None, "s13", "gjeldende_driftsk_kr forbruk")
step_query("allocate_cost", "cost", "s14", "new_drkost")
step_query("allocate_with_helpers", "turnover", "s15", "new_oms")
step_query("flag_industry", "industry", "s16", "vhbed")
step_query("allocate_two_tier", "income", "s17", "bedr_salgsint bedr_forbruk")
step_query("override_single_units", "single", "s19", "regtype new_oms new_drkost")
step_query("enforce_minimum", "minimum", "s18", "thief new_drkost")


@query("allocation_chain", f"""WITH {STEPS} SELECT {KEYS}, regtype, vhbed, new_oms, new_drkost, bedr_salgsint, bedr_forbruk FROM e19""",
       dbl="new_oms new_drkost bedr_salgsint bedr_forbruk")
def allocation_chain(t):
    return allocate_units(units(t), source=unit_keys(t)).select(*KEY, "regtype", "vhbed", "new_oms", "new_drkost", "bedr_salgsint", "bedr_forbruk")


@query("reconcile", f"""
WITH {STEPS} SELECT * FROM (SELECT {KEYS}, foretak_driftskostnad - sum(new_drkost) OVER (PARTITION BY id) AS difference FROM e19) WHERE abs(difference) > 1000""",
       dbl="difference")
def reconcile(t):
    return al.reconcile(allocate_units(units(t), source=unit_keys(t)), "id", "new_drkost", "foretak_driftskostnad", source=unit_keys(t)).select(*KEY, "difference")


@query("industry_cost_control", f"""
WITH {STEPS}, g AS (SELECT o_orderkey AS id, o_totalprice * 0.01 AS no4295_f, o_totalprice * 0.02 AS no4995_f, o_totalprice * 0.001 AS no6200_f FROM orders),
a22 AS (SELECT *, CAST(CAST(substring(tmp_sn2007_5, 1, 2) AS INTEGER) BETWEEN 5 AND 33 AS INTEGER) AS ind FROM s17 LEFT JOIN g USING (id)),
b22 AS (SELECT *, max(ind) OVER w AS has, coalesce(sum(CASE WHEN ind = 1 THEN new_drkost END) OVER w, 0) AS fi FROM a22 WINDOW w AS (PARTITION BY orgnr_n_1, lopenr)),
c22 AS (SELECT *, coalesce(CASE WHEN has = 0 THEN new_drkost / nullif(foretak_driftskostnad, 0) WHEN ind = 1 THEN new_drkost / nullif(fi, 0) ELSE 0 END, 0) AS share,
  coalesce(new_drkost, 0) AS hv, coalesce(gjeldende_lonn_kr, 0) + coalesce(bedr_forbruk, 0) + no4295 + no4995 + no6200 AS fl,
  abs(coalesce(new_drkost, 0) - (coalesce(gjeldende_lonn_kr, 0) + coalesce(bedr_forbruk, 0) + no4295_f + no4995_f + no6200_f)) AS uu FROM b22),
d22 AS (SELECT *, CAST(hv < fl AS INTEGER) AS thief FROM c22),
e22 AS (SELECT *, max(thief) OVER (PARTITION BY orgnr_n_1) AS anyt, sum(CASE WHEN thief = 0 THEN uu END) OVER w AS u0, sum(CASE WHEN thief = 1 THEN uu END) OVER w AS u1 FROM d22 WINDOW w AS (PARTITION BY orgnr_n_1, lopenr)),
f22 AS (SELECT *, CASE WHEN regtype = '01' THEN foretak_driftskostnad WHEN anyt = 1 THEN CASE WHEN thief = 1 THEN fl ELSE coalesce(hv - round_even(uu / nullif(u0, 0) * u1, 0), hv) END ELSE hv END AS nc FROM e22)
SELECT {KEYS}, ind AS industrial, share, thief, nc AS new_drkost, foretak_driftskostnad - sum(nc) OVER (PARTITION BY id) AS difference FROM f22""",
       dbl="share new_drkost difference")
def industry_cost_control(t):
    register = t.orders.select("o_orderkey", (F.col("o_totalprice") * 0.01).alias("no4295_f"),
                               (F.col("o_totalprice") * 0.02).alias("no4995_f"), (F.col("o_totalprice") * 0.001).alias("no6200_f"))
    # The register meets the lines where they lie by order; what that shuffles is gone before the allocation.
    source = materialise(al.with_register_costs(lines(t), register, "o_orderkey"), "lines")
    return al.industry_cost_control(upto(t, "income", source, al.REGISTER_COSTS), None, source=unit_keys(t)).select(*KEY, "industrial", "share", "thief", "new_drkost", "difference")


# ---------------------------------------------------------------- factors and features

CODE_MAP = [("S0", "R0"), ("S1", "R1"), ("S1", "R2"), ("S2", "R1"), ("S3", "R3"), ("S3", "R4"), ("S3", "R5")]
CODE_SQL = "m(old_code, new_code) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CODE_MAP) + ")"
REGION = "'S' || CAST(c_nationkey AS VARCHAR)"


def code_map(t):
    return t.spark.createDataFrame(CODE_MAP, "old_code string, new_code string")


def regional(t, year):
    df = t.orders.where(F.year("o_orderdate") == year).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return df.groupBy(F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("code")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def regional_sql(year):
    return f"(SELECT {REGION} AS code, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = {year} GROUP BY 1)"


def redistributed_sql(year):
    return f"""(SELECT coalesce(new_code, code) AS code, sum(CASE WHEN n > 1 THEN ceil(value / n) ELSE value END) AS value FROM {regional_sql(year)}
  LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY old_code) AS n FROM m) ON code = old_code GROUP BY 1)"""


@query("redistribute_codes", f"WITH {CODE_SQL} SELECT code, value FROM {redistributed_sql(1999)}", dbl="value")
def redistribute_codes(t):
    return factors.redistribute_codes(regional(t, 1999), "code", "value", code_map(t))


@query("translate_codes", f"""
WITH {CODE_SQL} SELECT c_custkey, coalesce(f, {REGION}) AS code FROM customer LEFT JOIN (SELECT old_code, min(new_code) AS f FROM m GROUP BY 1) ON {REGION} = old_code""")
def translate_codes(t):
    df = t.customer.select("c_custkey", F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("code"))
    return factors.translate_codes(df, "code", code_map(t))


@query("change_factor", f"""
WITH {CODE_SQL}, j AS (SELECT a.code, a.value / nullif(b.value, 0) AS factor FROM {redistributed_sql(1999)} a JOIN {redistributed_sql(1998)} b ON a.code = b.code)
SELECT code, coalesce(factor, (SELECT avg(factor) FROM j)) AS factor FROM j""", dbl="factor")
def change_factor(t):
    return factors.change_factor(regional(t, 1999), regional(t, 1998), "code", "value", code_map(t), 1999, 1998)


GROUPS = "(SELECT p_brand AS grp, avg(p_retailprice) / 100 AS value FROM part GROUP BY 1 UNION ALL SELECT 'TOTAL', avg(p_retailprice) / 100 FROM part)"


@query("map_index_groups", f"""
WITH w(grp, n4, w, way, need) AS (VALUES ('Brand#1', '47.11', 0.5, 'a', 1), ('Brand#1', '46.32', 0.5, 'a', 1), ('Brand#2', '47.22', 1.0, 'b', 1), ('Brand#3', '56.10', 1.0, 'c', 1),
  ('Brand#4', '47.24', 0.5, 'd', 2), ('Brand#5', '47.24', 0.5, 'd', 2), ('TOTAL', '45.40', 1.0, 't', 1), ('TOTAL', '47.99', 1.0, 't', 1))
SELECT n4, 1 + sum(value * w) / 100 AS factor FROM {GROUPS} JOIN w USING (grp) WHERE substring(n4, 1, 2) IN ('45', '46', '47') GROUP BY n4, way, need HAVING count(*) >= need""", dbl="factor")
def map_index_groups(t):
    rate = (F.avg("p_retailprice") / 100).alias("value")
    groups = t.part.groupBy(F.col("p_brand").alias("grp")).agg(rate).unionByName(
        t.part.agg(rate).withColumn("grp", F.lit("TOTAL")))
    return factors.map_index_groups(groups, "grp", "value", {"Brand#1": ["47.11", "46.32"], "Brand#2": ["47.22"], "Brand#3": ["56.10"]},
                                    {"47.24": ("Brand#4", "Brand#5")}, ["45.40", "47.99"])


# The rates of the published groups come from the parts, one group per remainder of the part number.
INDEX_NAMES = [*factors.INDEX_GROUPS, "TOTAL"]
INDEX_VALUES = ", ".join(f"('{g}', {i})" for i, g in enumerate(INDEX_NAMES))
INDEX_WEIGHTS = ", ".join([f"('{g}', '{code}', 1.0::DOUBLE / {len(codes)}, 'm{g}', 1)" for g, codes in factors.INDEX_GROUPS.items() for code in codes]
                          + [f"('{g}', '{code}', 0.5::DOUBLE, 'a{code}', 2)" for code, pair in factors.INDEX_AVERAGES.items() for g in pair]
                          + [f"('TOTAL', '{code}', 1.0::DOUBLE, 't', 1)" for code in factors.INDEX_TOTAL_CODES])


@query("index_groups_to_industries", f"""
WITH g(grp, i) AS (VALUES {INDEX_VALUES}), r AS (SELECT p_partkey % {len(INDEX_NAMES)} AS i, avg(p_retailprice) / 1000 AS value FROM part GROUP BY 1), w(grp, n4, w, way, need) AS (VALUES {INDEX_WEIGHTS})
SELECT n4, 1 + sum(value * w) / 100 AS factor FROM g JOIN r USING (i) JOIN w USING (grp) WHERE substring(n4, 1, 2) IN ('45', '46', '47') GROUP BY n4, way, need HAVING count(*) >= need""", dbl="factor", digits=9)
def index_groups_to_industries(t):
    """All groups of the price index to the industries that they stand for."""
    names = F.array(*[F.lit(g) for g in INDEX_NAMES])
    rates = t.part.groupBy((F.col("p_partkey") % len(INDEX_NAMES)).alias("i")).agg((F.avg("p_retailprice") / 1000).alias("value"))
    return factors.map_index_groups(rates.select(F.get(names, F.col("i").cast("int")).alias("grp"), "value"), "grp", "value")


FEATURE_BASE = """f AS (SELECT l_orderkey AS id, l_partkey AS v_orgnr, l_suppkey, l_linenumber, p_type AS tmp_sn2007_5, p_brand AS nacef_5, c_nationkey AS b_kommunenr,
  l_extendedprice AS fjor_omsetn_kr_t1, CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END AS b_sysselsetting_syss, CASE WHEN l_discount = 0 THEN 0 ELSE 1 + l_quantity / 2 END AS fjor_syssel_t1
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def feature_base(t):
    # Orders get their region before they meet the lines, which are then shuffled once less.
    region = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(region, F.col("l_orderkey") == F.col("o_orderkey")) \
        .select(
            F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("v_orgnr"), "l_suppkey", "l_linenumber",
            F.col("p_type").alias("tmp_sn2007_5"), F.col("p_brand").alias("nacef_5"), F.col("c_nationkey").alias("b_kommunenr"),
            F.col("l_extendedprice").alias("fjor_omsetn_kr_t1"),
            F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_quantity")).alias("b_sysselsetting_syss"),
            F.when(F.col("l_discount") == 0, 0.0).otherwise(1 + F.col("l_quantity") / 2).alias("fjor_syssel_t1"))


@query("growth_features", f"""
WITH {FEATURE_BASE},
price AS (SELECT substring(p_type, 1, 5) AS n4, 1 + avg(p_size) / 100 AS factor FROM part WHERE p_type <> 'SMALL' GROUP BY 1),
pop AS (SELECT s_nationkey AS k, 1 + avg(s_acctbal) / 100003 AS factor FROM supplier GROUP BY 1),
inc AS (SELECT c_nationkey AS k, 1 + avg(c_acctbal) / 100003 AS factor FROM customer GROUP BY 1),
g AS (SELECT f.*, fjor_omsetn_kr_t1 * coalesce(price.factor, CASE WHEN nacef_5 = 'Brand#1' THEN NULL ELSE 1.05 END) AS inflation_rate_oms, fjor_omsetn_kr_t1 * pop.factor AS befolkning_delta_oms,
  fjor_omsetn_kr_t1 * (b_sysselsetting_syss / nullif(fjor_syssel_t1, 0)) AS emp_delta_oms, fjor_omsetn_kr_t1 * inc.factor AS inntekt_delta_oms
  FROM f LEFT JOIN price ON substring(tmp_sn2007_5, 1, 5) = n4 LEFT JOIN pop ON b_kommunenr = pop.k LEFT JOIN inc ON b_kommunenr = inc.k),
h AS (SELECT * REPLACE (coalesce(inflation_rate_oms, avg(inflation_rate_oms) OVER (PARTITION BY nacef_5)) AS inflation_rate_oms) FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY v_orgnr ORDER BY id, l_linenumber, l_suppkey) AS rn FROM h)
SELECT v_orgnr, id, CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(inflation_rate_oms, 0) ELSE inflation_rate_oms END AS inflation_rate_oms,
 CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(befolkning_delta_oms, 0) ELSE befolkning_delta_oms END AS befolkning_delta_oms,
 CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(emp_delta_oms, 0) ELSE emp_delta_oms END AS emp_delta_oms,
 CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(inntekt_delta_oms, 0) ELSE inntekt_delta_oms END AS inntekt_delta_oms FROM k WHERE rn = 1""",
       dbl="inflation_rate_oms befolkning_delta_oms emp_delta_oms inntekt_delta_oms", digits=7)
def growth_features(t):
    price = t.part.where("p_type <> 'SMALL'").groupBy(F.substring("p_type", 1, 5).alias("n4")).agg((1 + F.avg("p_size") / 100).alias("factor"))
    pop = t.supplier.groupBy("s_nationkey").agg((1 + F.avg("s_acctbal") / 100003).alias("factor"))
    inc = t.customer.groupBy("c_nationkey").agg((1 + F.avg("c_acctbal") / 100003).alias("factor"))
    general = F.when(F.col("nacef_5") != "Brand#1", 1.05)
    return factors.growth_features(feature_base(t), price, pop, inc, general, order=["id", "l_linenumber", "l_suppkey"]).select(
        "v_orgnr", "id", "inflation_rate_oms", "befolkning_delta_oms", "emp_delta_oms", "inntekt_delta_oms")


@query("productivity_features", f"""
WITH {FEATURE_BASE}, y AS (SELECT *, year(o_orderdate) AS year FROM f JOIN orders ON id = o_orderkey),
a AS (SELECT tmp_sn2007_5, year, avg(fjor_omsetn_kr_t1 / nullif(b_sysselsetting_syss, 0)) AS m1 FROM y GROUP BY 1, 2),
b AS (SELECT tmp_sn2007_5, b_kommunenr, year, avg(fjor_omsetn_kr_t1 / nullif(b_sysselsetting_syss, 0)) AS m2 FROM y GROUP BY 1, 2, 3)
SELECT id, v_orgnr, l_suppkey, l_linenumber, CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(m1 * b_sysselsetting_syss, 0) ELSE m1 * b_sysselsetting_syss END AS by_industry,
  CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(m2 * b_sysselsetting_syss, 0) ELSE m2 * b_sysselsetting_syss END AS by_region
FROM y LEFT JOIN a USING (tmp_sn2007_5, year) LEFT JOIN b USING (tmp_sn2007_5, b_kommunenr, year)""", dbl="by_industry by_region", digits=4)
def productivity_features(t):
    df = feature_base(t).join(t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), "id")
    return factors.productivity_features(df, "fjor_omsetn_kr_t1", "b_sysselsetting_syss", {
        "by_industry": ["tmp_sn2007_5", "year"], "by_region": ["tmp_sn2007_5", "b_kommunenr", "year"]}) \
        .select("id", "v_orgnr", "l_suppkey", "l_linenumber", "by_industry", "by_region")


@query("add_register_units", """
WITH s AS (SELECT o_orderkey AS v_orgnr, o_orderpriority AS nacef_5, o_totalprice AS foretak_omsetning FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT o_orderkey AS v_orgnr, o_orderpriority AS nacef_5, o_totalprice AS foretak_omsetning FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 1)
SELECT v_orgnr, nacef_5, foretak_omsetning, NULL::DOUBLE AS fjor_syssel_t1, NULL::INTEGER AS radnr FROM s
UNION ALL SELECT v_orgnr, nacef_5, foretak_omsetning, coalesce(q, 0), 1 FROM r LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON v_orgnr = l_orderkey
WHERE substring(nacef_5, 1, 2) IN (SELECT DISTINCT substring(nacef_5, 1, 2) FROM s)""", dbl="fjor_syssel_t1")
def add_register_units(t):
    o = t.orders
    sample = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("v_orgnr"), F.col("o_orderpriority").alias("nacef_5"),
                                                   F.col("o_totalprice").alias("foretak_omsetning"))
    zero = F.lit(0.0)
    current = o.select(
        F.when(F.col("o_orderstatus") == "O", "01").otherwise("02").alias("reg_type_f"), F.when(F.col("o_custkey") % 2 == 0, "S").otherwise("B").alias("type"),
        zero.alias("ts_forbruk"), F.col("o_orderpriority").alias("naring_f"), F.col("o_custkey").alias("orgnr_foretak"), zero.alias("ts_salgsint"),
        F.col("o_totalprice").alias("omsetning"), zero.alias("nopost_p4005"), zero.alias("nopost_driftskostnader"), F.lit("0301").alias("kommune"),
        zero.alias("sysselsetting_syss"), F.col("o_orderpriority").alias("naring"), F.col("o_orderkey").alias("orgnr_bedrift"))
    previous = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("orgnr_bedrift")).agg(
        F.sum("l_quantity").alias("sysselsetting_syss")).withColumn("reg_type_f", F.lit("01"))
    return training.add_register_units(sample, current, previous, sample.select("nacef_5")).select(
        "v_orgnr", "nacef_5", "foretak_omsetning", "fjor_syssel_t1", "radnr")


TRAIN_BASE = """w AS (SELECT l_partkey AS v_orgnr, o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, l_linenumber AS lopenr, p_brand AS nacef_5, CAST(NULL AS VARCHAR) AS tmp_sn2007_5,
  CAST(NULL AS VARCHAR) AS b_kommunenr, CASE WHEN l_tax > 0.07 THEN 'bad' ELSE 'good' END AS quality, l_extendedprice AS new_oms, l_quantity AS gjeldende_bdr_syss, l_orderkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def training_base(t):
    none = F.lit(None).cast("string")
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("v_orgnr"), F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("l_linenumber").alias("lopenr"),
        F.col("p_brand").alias("nacef_5"), none.alias("tmp_sn2007_5"), none.alias("b_kommunenr"),
        F.when(F.col("l_tax") > 0.07, "bad").otherwise("good").alias("quality"), F.col("l_extendedprice").alias("new_oms"),
        F.col("l_quantity").alias("gjeldende_bdr_syss"), "l_orderkey", "l_suppkey")


@query("training_sets", f"""
WITH {TRAIN_BASE}, bad AS (SELECT * FROM w WHERE year = 2000 AND quality = 'bad'),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_orgnr, id, year ORDER BY lopenr, l_orderkey, l_suppkey) AS rn FROM w WHERE year = 2000) WHERE rn = 1)
SELECT 'bad' AS part, count(*) AS n, sum(new_oms) AS oms FROM bad UNION ALL SELECT 'good', count(*), sum(new_oms) FROM w WHERE year = 2000 AND quality <> 'bad'
UNION ALL SELECT 'bad_units', count(DISTINCT v_orgnr), NULL FROM bad UNION ALL SELECT 'ids', count(DISTINCT id), NULL FROM bad
UNION ALL SELECT 'training', count(*), sum(new_oms) FROM w WHERE v_orgnr NOT IN (SELECT v_orgnr FROM bad)
UNION ALL SELECT 'impute', count(*), sum(one.new_oms) FROM bad LEFT JOIN one USING (v_orgnr, id, year)""", dbl="oms", digits=2)
def training_sets(t):
    sets = training.training_sets(training_base(t), "quality", 2000, ["Br"], order=["lopenr", "l_orderkey", "l_suppkey"])
    out = None
    for name, df in sets.items():
        oms = F.sum("new_oms") if "new_oms" in df.columns else F.lit(None).cast("double")
        part = df.agg(F.count(F.lit(1)).alias("n"), oms.alias("oms")).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("part", "n", "oms")


@query("apply_predictions", f"""
WITH {TRAIN_BASE}, bad AS (SELECT * FROM w WHERE quality = 'bad'), good AS (SELECT * FROM w WHERE quality <> 'bad' AND id NOT IN (SELECT id FROM bad)),
pred AS (SELECT v_orgnr, avg(new_oms) - 10000 AS predicted_oms FROM w GROUP BY 1),
u AS (SELECT id, v_orgnr, l_orderkey, l_suppkey, lopenr, new_oms FROM good UNION ALL
  SELECT id, v_orgnr, l_orderkey, l_suppkey, lopenr, CASE WHEN gjeldende_bdr_syss = 0 AND substring(nacef_5, 1, 4) <> '47.3' AND substring(nacef_5, 1, 2) <> '68' THEN 0 ELSE predicted_oms END FROM bad LEFT JOIN pred USING (v_orgnr))
SELECT id, v_orgnr, l_orderkey, l_suppkey, CASE WHEN new_oms < 0 THEN 0 ELSE new_oms END AS new_oms FROM u WHERE lopenr = 1""", dbl="new_oms", digits=4)
def apply_predictions(t):
    w = training_base(t)
    pred = w.groupBy("v_orgnr").agg((F.avg("new_oms") - 10000).alias("predicted_oms"))
    return training.apply_predictions(w.where("quality <> 'bad'"), w.where("quality = 'bad'"), pred, ["v_orgnr"]) \
        .select("id", "v_orgnr", "l_orderkey", "l_suppkey", "new_oms")


# ---------------------------------------------------------------- publication

@query("flag_target", """
WITH s AS (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1),
g AS (SELECT l_suppkey, CAST(v AS DOUBLE) AS value, CAST(q AS DOUBLE) * 1500 AS target FROM s)
SELECT l_suppkey, CASE WHEN (value - target) / target * 100 > 0.5 THEN 'red' WHEN (value - target) / target * 100 >= -2 THEN 'green' ELSE 'yellow' END AS status,
  CASE WHEN (value - target) / target * 100 > 2 THEN value - target ELSE 0 END AS overflow FROM g""", dbl="overflow", digits=2)
def flag_target(t):
    s = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"),
                                            (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") * 1500).alias("q"))
    return s.withColumns(publish.flag_target(F.col("v"), F.col("q"))).drop("v", "q")


@query("history_series", """
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, p_type AS n, c_nationkey AS region, CAST(l_extendedprice AS DECIMAL(18,2)) AS oms, l_extendedprice * l_discount AS drkost, l_quantity AS syss
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey),
u AS (SELECT year, n, region, oms, drkost, syss FROM s WHERE year < 2000 UNION ALL SELECT 2000, n, region, oms * 2, drkost, syss FROM s WHERE year = 2000)
SELECT year, substring(n, 1, 4) AS n3, substring(n, 1, 2) AS n2, region, CASE WHEN grouping(region) = 1 THEN 0 ELSE 1 END AS level, sum(oms) AS oms, sum(drkost) AS drkost, sum(syss) AS syss, sum(oms) - sum(drkost) AS resultat,
  sum(oms) / nullif(sum(syss), 0) AS oms_pr_syss FROM u WHERE substring(n, 1, 2) IN ('EC', 'LA', 'ME') GROUP BY GROUPING SETS ((year, substring(n, 1, 4), substring(n, 1, 2)), (year, substring(n, 1, 4), substring(n, 1, 2), region))""",
       dbl="oms drkost syss resultat oms_pr_syss", digits=5)
def history_series(t):
    s = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")) \
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumns({
            "year": F.year("o_orderdate"), "cost": F.col("l_extendedprice") * F.col("l_discount"), "edited": F.col("l_extendedprice") * 2})
    names = {"p_type": "n", "c_nationkey": "region", "cost": "drkost", "l_quantity": "syss"}
    return publish.history_series(s, s.where("year = 2000"), names | {"l_extendedprice": "oms"}, names | {"edited": "oms"}, 2000,
                                  ["oms", "drkost", "syss"], ["EC", "LA", "ME"], ratios={"oms_pr_syss": ("oms", "syss")})


@query("update_file", f"""
WITH {STEPS} SELECT id AS enhets_id, l_partkey AS orgnr_bedrift, new_oms AS gjeldende_omsetn_kr, new_drkost AS gjeldende_driftsk_kr FROM s15
WHERE id IN (SELECT id FROM b WHERE gjeldende_driftsk_kr IS NULL AND substring(nacef_5, 1, 2) IN ('45', '46', '47') AND regtype <> '01')""",
       dbl="gjeldende_omsetn_kr gjeldende_driftsk_kr")
def update_file(t):
    bad = units(t).where("gjeldende_driftsk_kr IS NULL")
    return publish.update_file(upto(t, "turnover"), bad, ["45", "46", "47"], columns={
        "id": "enhets_id", "l_partkey": "orgnr_bedrift", "new_oms": "gjeldende_omsetn_kr", "new_drkost": "gjeldende_driftsk_kr"})


@query("published_extract", """
SELECT p_partkey, p_retailprice, substring(p_type, 1, 2) AS n2, substring(p_type, 1, 4) AS n3 FROM part WHERE substring(p_type, 1, 2) IN ('EC', 'PR')""")
def published_extract(t):
    return publish.published_extract(t.part, "p_type", ["p_partkey", "p_retailprice"], ["EC", "PR"])


@query("diff_percent", """
WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS predicted FROM lineitem GROUP BY 1),
j AS (SELECT year(o_orderdate) AS year, o_orderpriority, predicted, o_totalprice FROM p LEFT JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT CAST(year AS INTEGER) AS year, o_orderpriority, CAST(sum(predicted) AS DOUBLE) AS predicted, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS published FROM j GROUP BY 1, 2)
SELECT *, predicted - published AS diff, printf('%.2f%%', (predicted - published) * 100 / published) AS diff_percent FROM s""", dbl="predicted published diff", digits=2)
def diff_percent(t):
    pred = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("predicted"))
    actual = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"), "o_orderpriority", F.col("o_totalprice").alias("published"))
    return publish.compare_by_group(pred, actual, ["l_orderkey"], ["year", "o_orderpriority"], "predicted", "published")


@query("control_totals_n3", f"""
WITH {STEPS}, e AS (SELECT *, substring(nacef_5, 1, 4) AS n3 FROM e19 WHERE substring(nacef_5, 1, 2) IN ('45', '46', '47')),
p AS (SELECT n3, sum(foretak_omsetning) AS parent_oms, sum(foretak_driftskostnad) AS parent_drkost FROM e WHERE radnr = 1 GROUP BY 1),
c AS (SELECT n3, sum(new_oms) AS child_oms, sum(new_drkost) AS child_drkost FROM e GROUP BY 1)
SELECT n3, parent_oms, child_oms, parent_oms - coalesce(child_oms, 0) AS diff_oms, parent_drkost, child_drkost, parent_drkost - child_drkost AS diff_drkost FROM p LEFT JOIN c USING (n3)""",
       dbl="parent_oms child_oms diff_oms parent_drkost child_drkost diff_drkost", digits=0)
def control_totals_n3(t):
    e = allocate_units(units(t), source=unit_keys(t)).withColumn("n3", F.substring("nacef_5", 1, 4)).where(F.substring("nacef_5", 1, 2).isin("45", "46", "47"))
    return control(e.where("radnr = 1"), e, ["n3"], {"oms": ("foretak_omsetning", "new_oms"), "drkost": ("foretak_driftskostnad", "new_drkost")})


# ---------------------------------------------------------------- the whole run

PANEL_BASE = """f AS (SELECT l_orderkey AS id, l_partkey AS v_orgnr, l_suppkey, l_linenumber, CAST(year(o_orderdate) AS INTEGER) AS year, CASE l_returnflag WHEN 'R' THEN '04' ELSE '02' END AS regtype,
  p_type AS tmp_sn2007_5, CASE p_brand WHEN 'Brand#1' THEN 'LARGE' WHEN 'Brand#2' THEN 'SMALL' ELSE p_type END AS nacef_5, 'S' || CAST(c_nationkey AS VARCHAR) AS b_kommunenr, o_totalprice AS foretak_omsetning,
  l_extendedprice AS fjor_omsetn_kr_t1, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS new_oms,
  CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END AS b_sysselsetting_syss, CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END AS gjeldende_bdr_syss, CASE WHEN l_discount = 0 THEN 0 ELSE 1 + l_quantity / 2 END AS fjor_syssel_t1
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
SIX = ["mean", "emp", "bef", "inf", "inn", "syss"]


def _panel_fill(c: str) -> str:
    d = " + ".join(f"coalesce((a.{x} - b.{x}) ** 2, 0)" for x in SIX)
    n = " + ".join(f"CAST(a.{x} IS NOT NULL AND b.{x} IS NOT NULL AS INTEGER)" for x in SIX)
    return f"""(SELECT key, avg(v) AS v FROM (SELECT a.key, b.{c} AS v, row_number() OVER (PARTITION BY a.key ORDER BY round(({d}) * 6 / ({n}), 9), b.key) AS rank
  FROM zz a JOIN zz b ON a.year = b.year AND a.{c} IS NULL AND b.{c} IS NOT NULL AND ({n}) > 0) WHERE rank <= 3 GROUP BY 1)"""


@query("feature_panel", f"""
WITH {CODE_SQL}, {PANEL_BASE}, years AS (SELECT DISTINCT year FROM f),
price AS (SELECT year, substring(p_type, 1, 5) AS n4, 1 + avg(p_size) / 100 + (year - 1990) / 1000.0::DOUBLE AS factor FROM part, years WHERE p_type <> 'SMALL' GROUP BY 1, 2),
pop AS (SELECT year, 'S' || CAST(s_nationkey AS VARCHAR) AS k, 1 + avg(s_acctbal) / 100003 AS factor FROM supplier, years WHERE s_nationkey % 7 <> year % 7 GROUP BY 1, 2),
inc AS (SELECT year, 'S' || CAST(c_nationkey AS VARCHAR) AS k, 1 + avg(c_acctbal) / 100003 AS factor FROM customer, years GROUP BY 1, 2),
g AS (SELECT f.*, fjor_omsetn_kr_t1 * coalesce(price.factor, 1.05) AS inf, fjor_omsetn_kr_t1 * pop.factor AS bef, fjor_omsetn_kr_t1 * (b_sysselsetting_syss / nullif(fjor_syssel_t1, 0)) AS emp, fjor_omsetn_kr_t1 * inc.factor AS inn
  FROM f LEFT JOIN price ON substring(tmp_sn2007_5, 1, 5) = n4 AND price.year = f.year LEFT JOIN pop ON b_kommunenr = pop.k AND pop.year = f.year LEFT JOIN inc ON b_kommunenr = inc.k AND inc.year = f.year),
h AS (SELECT * REPLACE (CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(emp, 0) ELSE emp END AS emp, CASE WHEN b_sysselsetting_syss = 0 THEN coalesce(bef, 0) ELSE bef END AS bef), v_orgnr || '/' || year AS key FROM g
  QUALIFY row_number() OVER (PARTITION BY year, v_orgnr ORDER BY id, l_linenumber, l_suppkey) = 1),
mm AS (SELECT year, tmp_sn2007_5 AS nacef_5, avg(foretak_omsetning) AS m0 FROM h GROUP BY 1, 2), i AS MATERIALIZED (SELECT h.*, round_even(coalesce(m0, 0), 0) AS mean, b_sysselsetting_syss AS syss FROM h LEFT JOIN mm USING (year, nacef_5)),
pp AS (SELECT year, {', '.join(f'avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}' for c in SIX)} FROM i GROUP BY 1),
zz AS MATERIALIZED (SELECT key, year, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in SIX)} FROM i JOIN pp USING (year)),
k AS (SELECT i.* REPLACE ({', '.join(f'round_even(coalesce(i.{c}, x_{c}.v * s_{c} + m_{c}, m_{c}), 0) AS {c}' for c in ('emp', 'bef', 'inf', 'inn'))}) FROM i JOIN pp USING (year)
  {' '.join(f'LEFT JOIN {_panel_fill(c)} x_{c} USING (key)' for c in ('emp', 'bef', 'inf', 'inn'))} WHERE regtype NOT IN ('04', '11')),
l AS (SELECT v_orgnr, count(*) AS n, count(new_oms) AS ny, regr_slope(new_oms, year) AS b, avg(CASE WHEN new_oms IS NOT NULL THEN year END) AS xm, avg(new_oms) AS ym FROM k WHERE year < 1998 GROUP BY 1),
t AS (SELECT k.*, coalesce(CASE WHEN n = ny AND n >= 2 THEN ym + coalesce(b, 0) * (year - xm) END, new_oms) AS trend, coalesce(code, b_kommunenr) AS region FROM k LEFT JOIN l USING (v_orgnr) LEFT JOIN (SELECT old_code, min(new_code) AS code FROM m GROUP BY 1) ON b_kommunenr = old_code),
o AS (SELECT *, avg(new_oms / nullif(gjeldende_bdr_syss, 0)) OVER (PARTITION BY tmp_sn2007_5, year) * gjeldende_bdr_syss AS o1, avg(new_oms / nullif(gjeldende_bdr_syss, 0)) OVER (PARTITION BY tmp_sn2007_5, region, year) * gjeldende_bdr_syss AS o2 FROM t)
SELECT v_orgnr, year, id, region AS b_kommunenr, emp AS emp_delta_oms, bef AS befolkning_delta_oms, inf AS inflation_rate_oms, inn AS inntekt_delta_oms, trend * 0.7310585786::DOUBLE AS new_oms_trendForecast, CASE WHEN gjeldende_bdr_syss = 0 THEN coalesce(o1, 0) ELSE o1 END * 0.7310585786::DOUBLE AS by_industry,
  CASE WHEN gjeldende_bdr_syss = 0 THEN coalesce(o2, 0) ELSE o2 END * 0.7310585786::DOUBLE AS by_region, CASE WHEN v_orgnr % 10 <> 0 THEN CAST(v_orgnr % 1000 AS DOUBLE) END AS x_koordinat FROM o""",
       dbl="emp_delta_oms befolkning_delta_oms inflation_rate_oms inntekt_delta_oms new_oms_trendForecast by_industry by_region x_koordinat", digits=4)
def feature_panel(t):
    """All years' features at once: growth, gaps filled within the year, trend, region codes, productivity, places."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    size = F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_quantity"))
    region = F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))
    f = x.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("v_orgnr"), "l_suppkey", "l_linenumber", F.year("o_orderdate").alias("year"),
                 F.when(F.col("l_returnflag") == "R", "04").otherwise("02").alias("regtype"), F.col("p_type").alias("tmp_sn2007_5"),
                 F.when(F.col("p_brand") == "Brand#1", "LARGE").when(F.col("p_brand") == "Brand#2", "SMALL").otherwise(F.col("p_type")).alias("nacef_5"), region.alias("b_kommunenr"),
                 F.col("o_totalprice").alias("foretak_omsetning"), F.col("l_extendedprice").alias("fjor_omsetn_kr_t1"), F.when(F.col("l_tax") <= 0.07, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("new_oms"),
                 size.alias("b_sysselsetting_syss"), size.alias("gjeldende_bdr_syss"), F.when(F.col("l_discount") == 0, 0.0).otherwise(1 + F.col("l_quantity") / 2).alias("fjor_syssel_t1"))
    years = F.explode(F.sequence(F.lit(1990), F.lit(2010))).alias("year")
    named = lambda c: F.concat(F.lit("S"), F.col(c).cast("string")).alias("k")
    price = t.part.where("p_type <> 'SMALL'").groupBy(F.substring("p_type", 1, 5).alias("n4")).agg((1 + F.avg("p_size") / 100).alias("factor")).select(years, "n4", "factor") \
        .withColumn("factor", F.col("factor") + (F.col("year") - 1990) / 1000.0)
    pop = t.supplier.groupBy("s_nationkey").agg((1 + F.avg("s_acctbal") / 100003).alias("factor")).select(years, "s_nationkey", "factor").where(F.col("s_nationkey") % 7 != F.col("year") % 7).select("year", named("s_nationkey"), "factor")
    inc = t.customer.groupBy("c_nationkey").agg((1 + F.avg("c_acctbal") / 100003).alias("factor")).select(years, named("c_nationkey"), "factor")
    places = t.part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("v_orgnr"), (F.col("p_partkey") % 1000).cast("double").alias("x_koordinat"), F.lit(0.0).alias("y_koordinat"))
    # Times a number without short fractions, so that nothing lies half way between two roundings.
    shown = {"new_oms_trendForecast": "new_oms_trendForecast", "oms_syssmean_basedOn_naring": "by_industry", "oms_syssmean_basedOn_naring_kommune": "by_region"}
    out = panel(f, 1998, price, pop, inc, 1.05, code_map(t), places, order=["id", "l_linenumber", "l_suppkey"])
    return out.select("v_orgnr", "year", "id", "b_kommunenr", "emp_delta_oms", "befolkning_delta_oms", "inflation_rate_oms", "inntekt_delta_oms",
                      *[(F.col(c) * 0.7310585786).alias(n) for c, n in shown.items()], "x_koordinat")


RUN = f"""WITH {BY_RATE}, {BASE},
w AS (SELECT b.* REPLACE (z.new_oms AS new_oms), z.quality, CAST(year(o_orderdate) AS INTEGER) AS year, b.l_partkey || '-' || b.l_suppkey || '-' || b.l_linenumber AS v_orgnr, b_sysselsetting_syss AS gjeldende_bdr_syss
  FROM b JOIN z ON b.id = z.id AND b.l_linenumber = z.l_linenumber AND b.l_partkey = z.l_partkey AND b.l_suppkey = z.l_suppkey JOIN orders ON b.id = o_orderkey),
bad AS (SELECT *, v_orgnr || '|' || id || '|' || year AS row FROM w WHERE year = 2000 AND quality = 'bad'), good AS (SELECT * FROM w WHERE year = 2000 AND quality <> 'bad' AND id NOT IN (SELECT id FROM bad)),
train AS (SELECT *, v_orgnr || '|' || id || '|' || year AS row FROM w WHERE v_orgnr NOT IN (SELECT v_orgnr FROM bad) AND new_oms IS NOT NULL),
par AS (SELECT quantile_cont(b_sysselsetting_syss, 0.5) AS m1, quantile_cont(b_sysselsetting_syss, 0.75) - quantile_cont(b_sysselsetting_syss, 0.25) AS q1,
  quantile_cont(gjeldende_lonn_kr, 0.5) AS m2, quantile_cont(gjeldende_lonn_kr, 0.75) - quantile_cont(gjeldende_lonn_kr, 0.25) AS q2 FROM train),
za AS (SELECT row, (b_sysselsetting_syss - m1) / q1 AS f1, (gjeldende_lonn_kr - m2) / q2 AS f2, tmp_sn2007_5 AS code FROM bad, par),
zb AS (SELECT row, (b_sysselsetting_syss - m1) / q1 AS f1, (gjeldende_lonn_kr - m2) / q2 AS f2, tmp_sn2007_5 AS code, new_oms AS y FROM train, par),
near AS (SELECT za.row, arg_min(zb.y, (round((za.f1 - zb.f1) * (za.f1 - zb.f1) + (za.f2 - zb.f2) * (za.f2 - zb.f2) + CASE WHEN za.code <> zb.code THEN 2 ELSE 0 END, 9), zb.row), 2) AS best FROM za, zb GROUP BY 1),
pred AS (SELECT row, list_avg(best) AS predicted FROM near),
o AS (SELECT {KEYS}, regtype, orgnr_n_1, lopenr, radnr, tmp_sn2007_5, nacef_5, foretak_omsetning, foretak_driftskostnad, new_oms, gjeldende_driftsk_kr, lonn, gjeldende_lonn_kr, b_sysselsetting_syss, salgsint, forbruk FROM good
  UNION ALL SELECT {KEYS}, regtype, orgnr_n_1, lopenr, radnr, tmp_sn2007_5, nacef_5, foretak_omsetning, foretak_driftskostnad, greatest(predicted, 0), gjeldende_driftsk_kr, lonn, gjeldende_lonn_kr, b_sysselsetting_syss, salgsint, forbruk FROM bad LEFT JOIN pred USING (row)),
{CHAIN.replace("@source", "o")}"""
CODES = ["45", "46", "47", "68"]


@query("end_to_end", f"""{RUN}
SELECT {KEYS}, regtype, new_oms, new_drkost, bedr_salgsint, bedr_forbruk FROM e19""", dbl="new_oms new_drkost bedr_salgsint bedr_forbruk")
def end_to_end(t):
    """Classify, impute this year's bad answers by nearest neighbours, allocate and reconcile."""
    return outputs(t)["units"].select(*KEY, "regtype", "new_oms", "new_drkost", "bedr_salgsint", "bedr_forbruk")


def outputs(t):
    key, year = ["o_orderkey", *KEY[1:]], t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))

    def joined():
        """Marks and lines written one after the other, so that the shuffles of one are gone before those of the other; units are made when they are read."""
        marks = materialise(classified(t).select(*KEY, "quality", F.col("new_oms").alias("_oms")), "marks").withColumnRenamed("id", "o_orderkey")
        return materialise(lines(t).join(year, "o_orderkey"), "lines").join(marks, key)
    # The extra cost items are for the industry control only.
    panel = units(t, settle(t.spark, joined, "panel"), ["year", "quality", "_oms"]).drop("new_oms", "no4295", "no4995", "no6200").withColumns({
        "new_oms": F.col("_oms"), "v_orgnr": F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber"), "gjeldende_bdr_syss": F.col("b_sysselsetting_syss"),
        "b_kommunenr": F.lit(None).cast("string")}).drop("_oms")
    return produce(panel, 2000, CODES, ["b_sysselsetting_syss", "gjeldende_lonn_kr"], ["tmp_sn2007_5"])


@query("end_to_end_check", f"""{RUN}
SELECT * FROM (SELECT {KEYS}, foretak_driftskostnad - sum(new_drkost) OVER (PARTITION BY id) AS difference FROM e19) WHERE abs(difference) > 1000""", dbl="difference", digits=4)
def end_to_end_check(t):
    """Enterprises whose units do not add up after the run."""
    return outputs(t)["check_manually"].select(*KEY, "difference")


PAIRS = {"oms": ("foretak_omsetning", "new_oms"), "drkost": ("foretak_driftskostnad", "new_drkost"), "forbruk": ("forbruk", "bedr_forbruk"), "salgsint": ("salgsint", "bedr_salgsint")}


@query("end_to_end_totals", f"""{RUN},
x AS (SELECT *, substring(nacef_5, 1, 4) AS n3 FROM e19 WHERE substring(nacef_5, 1, 2) IN ({', '.join(f"'{c}'" for c in CODES)})),
xp AS (SELECT n3, {', '.join(f'sum({a}) AS parent_{n}' for n, (a, _) in PAIRS.items())} FROM x WHERE radnr = 1 GROUP BY 1), xc AS (SELECT n3, {', '.join(f'sum({b}) AS child_{n}' for n, (_, b) in PAIRS.items())} FROM x GROUP BY 1)
SELECT n3, {', '.join(f'parent_{n}, child_{n}, parent_{n} - coalesce(child_{n}, 0) AS diff_{n}' for n in PAIRS)} FROM xp LEFT JOIN xc USING (n3)""",
       dbl=" ".join(f"parent_{n} child_{n} diff_{n}" for n in PAIRS), digits=1)
def end_to_end_totals(t):
    """Enterprise totals beside the sums of what was allocated, by three-digit industry."""
    return outputs(t)["control_totals"]


@query("end_to_end_update", f"""{RUN}
SELECT id AS enhets_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS orgnr_bedrift, new_oms AS gjeldende_omsetn_kr, new_drkost AS gjeldende_driftsk_kr FROM e19
WHERE id IN (SELECT id FROM bad WHERE substring(nacef_5, 1, 2) IN ({', '.join(f"'{c}'" for c in CODES)}) AND regtype <> '01')""", dbl="gjeldende_omsetn_kr gjeldende_driftsk_kr", digits=4)
def end_to_end_update(t):
    """The update file of the run."""
    return outputs(t)["update_file"]
