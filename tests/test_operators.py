"""Operators on small literals: missing values, zero divisors, ties, repeated ids, hot groups; and invariants."""

import hashlib
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.functions import clean_code, finite, fmt_percent, half_even, parse_number, safe_div
from tallyloom.operators import aggregate as agg
from tallyloom.operators import allocate as al
from tallyloom.operators import boost, boxes, clean, factors, features, geo, gram, hotdeck, joins, knn, metrics, models, network, ordering, partial, publish, reshape, text, windows
from tallyloom.operators.classify import classify_responses
from tallyloom.operators.nearest import Quantiser, nearest
from tallyloom.operators.ordering import add_lags, dense_ranks, exact_percentiles, number_rows, running
from tallyloom.operators.partial import Ranges, _interleaved, nearest_partial, partial_distances
from tallyloom.plans import allocate_units, panel
from tallyloom.sources import collect_period_files, collect_periods, stage, write_partitioned


@pytest.fixture(params=["1000000", "1"], ids=["window", "hot"])
def groups(request, spark):
    """Run the test with ordinary groups and again with every group of two or more rows as a hot one."""
    spark.conf.set("tallyloom.hotRows", request.param)
    yield request.param
    spark.conf.unset("tallyloom.hotRows")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def one(spark, expr_col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr_col).first()[0]


@pytest.mark.parametrize("value,want", [("1,5", 1.5), (" 12 ", 12.0), ("", None), ("abc", None), ("1f", None), ("NaN", None), (None, None), ("-3", -3.0),
                                        (".5", 0.5), ("1e3", 1000.0), ("Infinity", None), ("1.2.3", None)])
def test_parse_number(spark, value, want):
    assert one(spark, parse_number("v"), value) == want


def test_scalar_rules(spark):
    assert one(spark, safe_div(F.lit(1.0), "v"), 0.0, "double") is None
    assert one(spark, finite("v"), float("inf"), "double") is None
    assert one(spark, finite("v"), float("nan"), "double") is None
    assert [one(spark, half_even("v"), x, "double") for x in (0.5, 1.5, 2.5, -0.5)] == [0.0, 2.0, 2.0, -0.0]
    assert [one(spark, clean_code("v", 4), x) for x in ("'301'", " 12 ", "12345")] == ["0301", "0012", "12345"]
    assert one(spark, fmt_percent("v"), 12.345, "double") == "12.35%" or one(spark, fmt_percent("v"), 12.345, "double") == "12.34%"


def test_eav_pivot(spark):
    df = spark.createDataFrame([("a", "X", None, 1), ("a", "X", "2", 2), ("a", "X", "3", 3), ("a", "Y", "9", 1), ("b", "Z", "1", 1), (None, "X", "1", 1), ("c", "Y", "5", 1)],
                               "id string, f string, v string, o int")
    assert rows(reshape.eav_pivot(df, ["id"], "f", "v", ["X", "Y", "W"], "o"), "id", "x", "y", "w") == [("a", "2", "9", None), ("c", None, "5", None)]


def test_conform_known_form(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 6.0)], "id string, no_oms double")
    pub = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "enhets_id string, nopost_p4005 double, nopost_driftskostnader double, other double")
    out = reshape.conform_known_form(df, "RA-0255-1", 2023, pub)
    assert rows(out, "id", "tmp_no_omsetn", "tmp_no_p4005", "tmp_driftskostnad_9010") == [("a", 5.0, 1.0, 2.0), ("b", 6.0, 0.0, None)]
    assert "tmp_driftskostnad_9010" not in reshape.conform_known_form(df, "RA-0255-1", 2022, pub).columns
    assert reshape.conform_known_form(df, "other", 2022).columns == df.columns


def test_group_values_leave_missing_keys_alone(spark, groups):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 6.0), ("b", None), ("b", None)], "k string, x double")
    out = windows.group_total(df, "x", ["k"], name="t")
    assert rows(out, "k", "x", "t") == sorted([("a", 1.0, 3.0), ("a", 2.0, 3.0), (None, 5.0, None), (None, 6.0, None), ("b", None, None), ("b", None, None)], key=str)


def test_running_and_ranks(spark, groups):
    random.seed(3)
    data = [(random.choice("aab"), random.randint(0, 5), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, v int, i int")
    got = {r["i"]: (r["rn"], r["s"], r["rank"], r["last"]) for r in dense_ranks(running(
        df, ["k"], [F.desc("v"), "i"], {"rn": F.lit(1).cast("long"), "s": F.col("v").cast("long")}, {"last": F.when(F.col("v") % 2 == 0, F.col("i"))}), ["k"], "v").collect()}
    for key in "ab":
        part = sorted((r for r in data if r[0] == key), key=lambda r: (-r[1], r[2]))
        total, last, values = 0, None, sorted({r[1] for r in part}, reverse=True)
        for n, (_, v, i) in enumerate(part, 1):
            total += v
            last = i if v % 2 == 0 else last
            assert got[i] == (n, total, values.index(v) + 1, last)


def test_lags_and_numbering(spark, groups):
    df = spark.createDataFrame([("a", y, float(y)) for y in range(2000, 2007)] + [("b", 2001, 9.0)], "u string, year int, v double")
    out = add_lags(df, ["u"], ["year"], "v", 2)
    assert rows(out, "u", "year", "v_lag1", "v_lag2") == [("a", y, float(y - 1), float(y - 2)) for y in range(2002, 2007)]
    assert sorted(r["rn"] for r in number_rows(df, [], ["u", "year"]).collect()) == list(range(1, 9))


def test_exact_percentiles(spark, groups):
    data = [float(x) for x in range(60)]
    df = spark.createDataFrame([("a", x) for x in data] + [("b", 7.0), ("b", 7.0), ("b", None)], "k string, x double")
    out = {r["k"]: (r["p0"], r["p1"]) for r in exact_percentiles(df, ["x"], [0.5, 0.25], ["k"]).collect()}
    assert out == {"a": (29.5, 14.75), "b": (7.0, 7.0)}
    assert exact_percentiles(df, ["x"], [0.5]).first()["p0"] == pytest.approx(28.5)


def test_linear_trend(spark, groups):
    df = spark.createDataFrame([("one", 2000, 5.0), ("two", 2000, 1.0), ("two", 2001, 3.0), ("two", 2005, 0.0), ("same", 2000, 1.0), ("same", 2000, 3.0),
                                ("gap", 2000, 1.0), ("gap", 2001, None), ("gap", 2002, 3.0)], "u string, year int, y double")
    got = {(r["u"], r["year"]): r["trend"] for r in windows.linear_trend(df, ["u"], "year", "y", 2004).collect()}
    assert got[("one", 2000)] is None and got[("gap", 2002)] is None
    assert got[("two", 2005)] == pytest.approx(11.0) and got[("same", 2000)] == pytest.approx(2.0)


def test_period_change_does_not_jump_gaps(spark):
    df = spark.createDataFrame([("a", 2000, 0.0), ("a", 2001, 5.0), ("a", 2002, 10.0), ("a", 2004, 1.0)], "k string, year int, v double")
    assert rows(windows.period_change(df, ["k"], "year", "v"), "year", "change_percent") == [(2000, None), (2001, 0.0), (2002, 100.0), (2004, None)]


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, w int")
    assert rows(joins.join_tables(a, b, ["k"]), "v", "w") == [(1, 10), (2, None)]
    assert rows(joins.join_tables(a, b, ["k"], null_safe=True), "v", "w") == [(1, 10), (2, 20)]
    c = spark.createDataFrame([("x", 1), (None, 3)], "k string, v int")
    assert rows(joins.anti_rows(a, c), "k", "v") == [(None, 2)]
    up = spark.createDataFrame([("x", None)], "k string, v int")
    assert rows(joins.update_from(a, up, ["k"], ["v"]), "k", "v") == [("x", 1), (None, 2)] or rows(joins.update_from(a, up, ["k"], ["v"]), "k", "v") == [(None, 2), ("x", 1)]
    assert set(rows(joins.update_matched(a, up, ["k"], "v"), "k", "v")) == {("x", 0), (None, 2)}
    assert set(rows(joins.symmetric_diff(a, c), "k", "v")) == {(None, 2), (None, 3)}


def test_classify(spark, groups):
    parent = spark.createDataFrame([(1, "p1", 100.0, 100.0), (2, "p2", 100.0, 100.0), (3, "p3", 100.0, 100.0), (4, "p4", 0.0, 50.0), (5, "p5", 100.0, 100.0), (6, "p6", 1000.0, 100.0)],
                                   "id int, orgnr_n_1 string, total_oms double, total_cost double")
    child = spark.createDataFrame([(1, 1, 40.0, 40.0), (1, 2, 25.0, 25.0), (2, 1, 80.0, 10.0), (3, 1, 10.0, 90.0), (4, 1, 5.0, 5.0), (5, 1, 90.0, 70.0), (5, 2, 0.0, 0.0), (6, 1, 5.0, None)],
                                  "id int, n int, oms double, cost double")
    got = {(r["id"], r["n"]): (r["quality"], r["reason"], r["new_oms"], r["cost"]) for r in classify_responses(parent, child, ["id"]).collect()}
    assert got[(1, 1)] == ("good", "both", 62.0, 40.0)          # exactly at the limit, 40 / 65 of 100
    assert got[(2, 1)] == ("good_turnover_only", "turnover", 100.0, None)
    assert got[(3, 1)][:2] == ("bad", "below_limit") and got[(4, 1)][0] == "no_total"
    assert got[(5, 1)] == ("bad", "few_reporting", 90.0, None)  # one of two units reports
    assert got[(6, 1)] == ("bad", "below_limit", 5.0, 0.0)


BASE = "id string, orgnr_n_1 string, lopenr int, radnr int, regtype string, tmp_sn2007_5 string, foretak_omsetning double, foretak_driftskostnad double, new_oms double, " \
       "gjeldende_driftsk_kr double, lonn double, gjeldende_lonn_kr double, b_sysselsetting_syss double, salgsint double, forbruk double"


def unit(id, n, kind="02", code="47.110", t_oms=100.0, t_cost=80.0, oms=10.0, cost=10.0, lonn=50.0, wages=1.0, size=1.0, inc=90.0, goods=45.0):
    return (id, id, 1, n, kind, code, t_oms, t_cost, oms, cost, lonn, wages, size, inc, goods)


def test_allocate_cost_fallbacks(spark, groups):
    df = spark.createDataFrame([unit("wage", 1, cost=0.0, lonn=25.0), unit("wage", 2, cost=0.0, lonn=75.0), unit("size", 1, cost=0.0, lonn=0.0, size=1.0),
                                unit("size", 2, cost=0.0, lonn=0.0, size=3.0), unit("cost", 1, cost=30.0), unit("cost", 2, cost=10.0)], BASE)
    got = {(r["id"], r["radnr"]): r["new_drkost"] for r in al.allocate_cost(df).collect()}
    assert got == {("wage", 1): 20.0, ("wage", 2): 60.0, ("size", 1): 20.0, ("size", 2): 60.0, ("cost", 1): 60.0, ("cost", 2): 20.0}


def test_allocate_with_helpers(spark, groups):
    df = spark.createDataFrame([unit("a", 1, "04", oms=7.0), unit("a", 2, oms=30.0), unit("a", 3, oms=10.0), unit("b", 1, "04"), unit("b", 2, "04"),
                                unit("c", 1, oms=0.0, lonn=20.0), unit("c", 2, oms=0.0, lonn=60.0)], BASE)
    df = df.withColumn("new_drkost", F.when(F.col("regtype") == "04", 20.0).otherwise(30.0))
    got = {(r["id"], r["radnr"]): r["new_oms"] for r in al.allocate_with_helpers(df).collect()}
    assert got == pytest.approx({("a", 1): 20.0, ("a", 2): 60.0, ("a", 3): 20.0, ("b", 1): 20.0, ("b", 2): 20.0, ("c", 1): 25.0, ("c", 2): 75.0})


def test_two_tier(spark, groups):
    df = spark.createDataFrame([unit("pure", 1, oms=75.0), unit("pure", 2, oms=25.0), unit("mix", 1, oms=20.0), unit("mix", 2, code="10.100", oms=60.0), unit("mix", 3, code="10.100", oms=20.0),
                                unit("none", 1, code="10.100", oms=50.0), unit("none", 2, code="46.110", oms=50.0)], BASE)
    got = {(r["id"], r["radnr"]): (r["vhbed"], r["bedr_salgsint"], r["bedr_forbruk"]) for r in al.allocate_two_tier(al.flag_industry(df)).collect()}
    assert got[("pure", 1)] == (1, 68.0, 34.0)                      # 67.5 and 33.75, half to even
    assert got[("mix", 1)] == (1, 20.0, 10.0)                       # capped at its own turnover
    assert got[("mix", 2)] == (0, 52.0, 26.0) and got[("mix", 3)] == (0, 18.0, 9.0)
    assert got[("none", 1)] == (1, 45.0, 22.0)


def test_minimum_rule(spark, groups):
    cols = "orgnr_n_1 string, lopenr int, radnr int, new_drkost double, gjeldende_lonn_kr double, bedr_forbruk double"
    df = spark.createDataFrame([("a", 1, 1, 10.0, 20.0, 10.0), ("a", 1, 2, 100.0, 30.0, 10.0), ("a", 1, 3, 50.0, 20.0, 10.0), ("calm", 1, 1, 50.0, 1.0, 1.0),
                                ("all", 1, 1, 1.0, 5.0, 0.0), ("flat", 1, 1, 1.0, 5.0, 0.0), ("flat", 1, 2, 10.0, 10.0, 0.0)], cols)
    got = {(r["orgnr_n_1"], r["radnr"]): r["new_drkost"] for r in al.enforce_minimum(df).collect()}
    assert got[("a", 1)] == 30.0 and got[("a", 2)] == 100.0 - 15.0 and got[("a", 3)] == 50.0 - 5.0
    assert got[("calm", 1)] == 50.0 and got[("all", 1)] == 5.0
    assert got[("flat", 1)] == 5.0 and got[("flat", 2)] == 10.0     # no surplus to take from


def test_single_units(spark, groups):
    df = spark.createDataFrame([unit("a", 1, "01"), unit("b", 1, "01"), unit("b", 2, "01")], BASE)
    df = df.withColumns({"new_drkost": F.lit(1.0), "bedr_salgsint": F.lit(1.0), "bedr_forbruk": F.lit(1.0)})
    assert rows(al.override_single_units(df), "id", "regtype", "new_oms", "new_drkost") == [("a", "01", 100.0, 80.0), ("b", "02", 10.0, 1.0), ("b", "02", 10.0, 1.0)]


def test_allocation_keeps_totals(spark, groups):
    random.seed(7)
    data = []
    for p in range(40):
        for n in range(1, random.randint(2, 6)):
            data.append(unit(f"p{p}", n, random.choice(["02", "02", "04"]), random.choice(["47.110", "46.310", "10.100"]), 1000.0 + p, 800.0 + p, float(random.randint(0, 400)),
                             random.choice([None, 0.0, 50.0, 200.0]), random.choice([0.0, 20.0, 50.0]), float(random.randint(0, 40)), float(random.randint(1, 9))))
    df = spark.createDataFrame(data, BASE)
    cost = al.allocate_cost(al.impute_by_margin(df))
    shares = cost.groupBy("id").agg(F.sum("new_drkost").alias("s"), F.max("foretak_driftskostnad").alias("t"), F.sum("gjeldende_driftsk_kr").alias("d")).where("d > 0")
    assert shares.where("abs(s - t) > 0.001").count() == 0
    oms = al.allocate_with_helpers(cost)
    totals = oms.groupBy("id").agg(F.sum("new_oms").alias("s"), F.max("foretak_omsetning").alias("t"), F.sum(F.when(F.col("regtype") != "04", F.col("b_sysselsetting_syss"))).alias("n"),
                                   F.sum(F.when(F.col("regtype") != "04", F.col("new_oms"))).alias("o")).where("o > 0")
    assert totals.where("abs(s - t) > 0.001").count() == 0
    assert allocate_units(df).count() == len(data)


def test_code_split(spark):
    m = spark.createDataFrame([("A", "X"), ("B", "Y"), ("B", "Z")], "old_code string, new_code string")
    df = spark.createDataFrame([("A", 3.0), ("B", 5.0), ("C", 1.0), ("X", 1.0)], "code string, value double")
    assert rows(factors.redistribute_codes(df, "code", "value", m), "code", "value") == [("C", 1.0), ("X", 4.0), ("Y", 3.0), ("Z", 3.0)]
    assert rows(factors.redistribute_codes(df, "code", "value", m, exact=True), "code", "value") == [("C", 1.0), ("X", 4.0), ("Y", 2.5), ("Z", 2.5)]
    assert rows(factors.translate_codes(df, "code", m), "code", "value") == [("C", 1.0), ("X", 1.0), ("X", 3.0), ("Y", 5.0)]


def test_index_tables(spark):
    groups = sorted({*factors.INDEX_GROUPS, *(g for p in factors.INDEX_AVERAGES.values() for g in p), "TOTAL"})
    df = spark.createDataFrame([(g, float(i)) for i, g in enumerate(groups)], "grp string, value double")
    out = {r["n4"]: r["factor"] for r in factors.map_index_groups(df, "grp", "value").collect()}
    value = {g: float(i) for i, g in enumerate(groups)}
    assert out["47.82"] == pytest.approx(1 + value["03"] / 2 / 100) and out["47.30"] == pytest.approx(1 + value["07.2.2"] / 100)
    assert out["47.11"] == pytest.approx(1 + (value["01"] + value["02"]) / 200) and out["46.90"] == pytest.approx(1 + value["TOTAL"] / 100)
    copied = {r["n4"]: r["factor"] for r in factors.map_index_groups(df, "grp", "value", split="copy").collect()}
    assert copied["47.82"] == pytest.approx(1 + value["03"] / 100)


def test_target_flags(spark):
    df = spark.createDataFrame([(100.0,), (101.0,), (97.0,), (103.0,)], "v double").withColumns(publish.flag_target(F.col("v"), F.lit(100.0)))
    assert rows(df, "v", "status", "overflow") == [(100.0, "green", 0.0), (101.0, "red", 0.0), (103.0, "red", 3.0), (97.0, "yellow", 0.0)]


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_is_exact(spark, block):
    random.seed(5)
    don = [(i, [float(random.randint(0, 6)) for _ in range(3)], [random.randint(0, 2)], random.choice(["g", "h"])) for i in range(150)]
    don += [(1000 + i, [1.0, 1.0, 1.0], [1], "g") for i in range(80)]  # a third of the rows are copies
    que = [(i, [random.uniform(0, 6) for _ in range(3)], [random.randint(0, 2)], random.choice([["g"], ["h"], ["g", "h"], ["x"]])) for i in range(60)]
    d = spark.createDataFrame(don, "did int, vec array<double>, cats array<bigint>, grp string")
    q = spark.createDataFrame(que, "qid int, vec array<double>, cats array<bigint>, may array<string>")
    got = {(r["qid"], r["rank"]): r["did"] for r in nearest(q, d, 4, "qid", "did", cats="cats", group="grp", groups="may", block_rows=block).collect()}
    want = {}
    for i, v, c, may in que:
        def dist(x):
            code = 0 if x[2] == c else 1 if 0 in (x[2][0], c[0]) else 2
            return round(sum((a - b) ** 2 for a, b in zip(v, x[1])) + code, 9)
        for n, x in enumerate(sorted((x for x in don if x[3] in may), key=lambda x: (dist(x), x[0]))[:4], 1):
            want[(i, n)] = x[0]
    assert got == want


def test_hot_deck_edges(spark, groups):
    cols = "row int, id string, c string, d string, x double, r double"
    df = spark.createDataFrame([(1, "a", "c1", "d1", 1.0, 0.1), (2, "b", "c1", "d1", 3.0, 0.2), (3, "c", "c1", "d1", -1.0, 0.3), (4, "a", "c2", "d1", 9.0, 0.4), (5, "a", "c2", "d1", 8.0, 0.5),
                                (6, "z", "c9", "d9", 1.0, 0.6)], cols)
    got = {r["row"]: (r["donor_id"], r["level"], r["predicted"]) for r in hotdeck.hot_deck(df, ["c", "d"], "x", "r", "x", "id", "row").collect()}
    assert got[1] == ("b", 0, 0.2)                   # tie in distance: smallest id
    assert got[4][:2] == ("b", 1) and got[5][:2] == ("b", 1)  # only own id in the code: coarser level
    assert got[6] == (None, None, None)


def test_knn_impute(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.0, 3.0), (4, None, 2.1), (5, None, None), (6, 10.0, None)], "id int, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in knn.knn_impute(df, ["a", "b"], "id", 1).collect()}
    assert got[1] == (1.0, 1.0) and got[4][0] == pytest.approx(2.0) and got[6][1] == pytest.approx(3.0)
    assert got[5] == (pytest.approx(4.0), pytest.approx(2.025))  # nothing to compare: column means


def test_splits_are_stable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 50).withColumn("c", F.when(F.col("id") < 100, "small").otherwise("large"))
    by = features.split_rows(df, "g").groupBy("g").agg(F.count_distinct("part").alias("n"))
    assert by.where("n > 1").count() == 0
    strat = features.split_stratified(df, "c", "id")
    assert rows(strat.where("part = 'train'").groupBy("c").count(), "c", "count") == [("large", 720), ("small", 80)]
    assert features.split_ordered(df, ["id"]).where("part = 'train'").agg(F.max("id")).first()[0] == 799


def test_trees_train_on_different_rows_only(spark, monkeypatch):
    """Rows alike in bins and codes are one row with their mean and number; the leaves are means of all of them."""
    seen = {}
    plain = models.materialise
    monkeypatch.setattr(models, "materialise", lambda df, name: seen.setdefault(name, plain(df, name)))
    df = spark.range(600).select("id", (F.col("id") % 4).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("c"),
                                 ((F.col("id") % 4) * 100 + F.col("id") % 3).cast("double").alias("y"))
    fitted = models.gbt_regress(df, ["a"], ["c"], "y", max_iter=3)
    assert seen["features"].count() == 4
    assert {(r["a"], round(r["predicted"], 6)) for r in fitted.predict(df).collect()} == {(float(a), a * 100 + 1.0) for a in range(4)}


def test_tree_grid_scores_rows(spark):
    df = spark.range(300).select("id", (F.col("id") % 8).cast("double").alias("a"), ((F.col("id") % 8) ** 2 * 10 + F.col("id") % 5).cast("double").alias("y"))
    fitted = models.gbt_regress(df, ["a"], [], "y", grid={"maxDepth": [1, 4]}, max_iter=2, fold_key="id")
    assert fitted.model.getOrDefault("maxDepth") == 4


def test_splits_match_a_full_ranking(spark, groups, share):
    rng = random.Random(5)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 3.0, float("nan")])) for i in range(200)]
    df = spark.createDataFrame(data, "id int, c string, o double")
    got = features.split_ordered(df, ["o", "id"], share)
    first = sorted(data, key=lambda r: (r[2] is not None, r[2] is not None and math.isnan(r[2]), r[2] or 0, r[0]))[:int(200 * share + 1e-9)]
    assert rows(got.where("part = 'train'"), "id") == sorted([(r[0],) for r in first], key=str) and got.count() == 200
    strat = {r["id"]: r["part"] for r in features.split_stratified(df, "c", "id", share=share).collect()}
    for c in "ab":
        mine = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i, k, _ in data if k == c)
        assert [i for _, i in mine if strat[i] == "train"] == [i for _, i in mine[:int(len(mine) * share + 1e-9)]]
    assert len(strat) == 200 and {strat[i] for i, c, _ in data if c is None} == {"test"}


def test_ordered_split_ranks_ties_of_the_last_row_only(spark, monkeypatch):
    seen = []
    plain = features.number_rows
    monkeypatch.setattr(features, "number_rows", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    df = spark.range(1000).withColumn("day", F.col("id") % 100)
    assert features.split_ordered(df, ["day", "id"], 0.805).where("part = 'train'").count() == 805
    features.split_stratified(df.withColumn("c", F.lit("x")), "c", "id")
    assert seen[0] == 10 and seen[1] <= 5


def test_hot_deck_matches_all_pairs(spark, groups):
    rng = random.Random(3)
    data = [(i, rng.choice("abcde"), rng.choice("xy"), rng.choice(["u", None]), rng.choice([None, 0.0, 1.0, 2.0, 3.0, 7.0]), i / 100) for i in range(120)]
    df = spark.createDataFrame(data, "row int, id string, c string, d string, x double, r double")
    near = hotdeck.nearest_donors(df.where("row % 2 = 0"), df.where("row % 3 < 2"), ["c", "d"], "x", ["r"], "row", "row", "id")
    want = []
    for a in data[::2]:
        pairs = [(lvl, abs(a[4] - b[4]), b[1], b[0]) for lvl in (0, 1) for b in data if b[0] % 3 < 2 and None not in (a[4], b[4], a[2 + lvl]) and a[2 + lvl] == b[2 + lvl] and a[1] != b[1]]
        if pairs:
            lvl, dist, donor, row = min(pairs)
            want.append((a[0], lvl, dist, donor, row / 100))
    assert rows(near, "row", "level", "distance", "donor_id", "r") == sorted(want, key=str)


def test_hot_deck_writes_no_deck_of_donors(spark, monkeypatch):
    written = []
    plain = hotdeck.materialise
    monkeypatch.setattr(hotdeck, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    df = spark.createDataFrame([(i, f"u{i}", "c", float(i), 1.0) for i in range(20)], "row int, id string, c string, x double, r double")
    assert hotdeck.hot_deck(df, ["c"], "x", "r", "x", "id", "row").where("donor_id IS NOT NULL").count() == 20 and written == []


def test_group_means_fill_without_gathering_groups(spark, groups):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, 5.0), (None, None)], "g string, v double")
    out = clean.fill_group_mean(df, "v", ["g"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out, "g", "v") == sorted([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", None), (None, 5.0), (None, None)], key=str)


def test_industry_control_writes_no_copy_of_counted_units(spark, groups, monkeypatch):
    cols = ("id long, orgnr_n_1 long, lopenr int, regtype string, tmp_sn2007_5 string, nacef_5 string, new_drkost double, new_oms double, foretak_driftskostnad double, foretak_omsetning double, "
            "salgsint double, forbruk double, bedr_salgsint double, bedr_forbruk double, gjeldende_lonn_kr double, no4295 double, no4995 double, no6200 double")
    df = spark.createDataFrame([(i // 3, i // 3 if i // 3 else None, i % 2, "02", "10.200" if i % 2 else "47.112", "47.300", 10.0 * i, 5.0, 90.0, 80.0, 7.0, 6.0, 3.0, 2.0, 4.0 * (i % 4), 1.0, 1.0, 1.0) for i in range(12)], cols)
    register = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "id long, no4295_f double, no4995_f double, no6200_f double")
    want = rows(al.industry_cost_control(df, register), "id", "orgnr_n_1", "share", "thief", "new_drkost", "difference")
    written = []
    plain = al.materialise
    monkeypatch.setattr(al, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    got = al.industry_cost_control(df, register, source=df.select("id", "orgnr_n_1"))
    assert rows(got, "id", "orgnr_n_1", "share", "thief", "new_drkost", "difference") == want and len(want) == 12 and written == []


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    m = metrics.regression_metrics(df, "y", "p", n_features=1).first()
    assert (m["n"], m["mae"], m["median_ae"]) == (3, pytest.approx(2 / 3), 1.0) and m["r2"] == pytest.approx(1 - 2 / (14 / 3))
    assert m["adjusted_r2"] == pytest.approx(1 - (1 - m["r2"]) * 2 / 1)
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0), (10.0, 5.0)], "y double, p double")
    assert [r[0] for r in df.select(metrics.pct_error(F.col("y"), F.col("p"))).collect()] == [100.0, None, 50.0]


def test_components_and_routes(spark):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (10, 11, 2.0)] + [(i, i + 1, 1.0) for i in range(20, 60)]
    e = spark.createDataFrame(edges, "src int, dst int, weight double")
    got = {r["node"]: (r["component"], r["size"], r["largest"]) for r in network.connected_components(e).collect()}
    assert got[4] == (1, 4, False) and got[11] == (10, 2, False) and got[60] == (20, 41, True)
    o = spark.createDataFrame([(1,), (10,)], "o int")
    d = spark.createDataFrame([(3,), (4,), (11,)], "d int")
    assert rows(network.od_costs(e, o, d), "origin", "dest", "cost") == [(1, 3, 2.0), (1, 4, 3.0), (10, 11, 2.0)]
    assert rows(network.route_frequencies(e, o, d), "src", "dst", "routes") == [(1, 2, 2), (10, 11, 1), (2, 3, 2), (3, 4, 1)]


def test_orient_edges(spark):
    df = spark.createDataFrame([("a", "b", "FT", 1.0, 2.0), ("a", "c", "TF", 1.0, 2.0), ("a", "d", "B", 3.0, -1.0)], "source string, target string, oneway string, drivetime_fw double, drivetime_bw double")
    assert rows(network.orient_edges(df), "src", "dst", "weight") == [("a", "b", 1.0), ("a", "d", 3.0), ("c", "a", 2.0)]


def test_polygons(spark):
    sq = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    notch = [(0.0, 0.0), (4.0, 4.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]
    g = spark.createDataFrame([("big", sq), ("notch", notch), ("far", [(x + 100, y) for x, y in sq])], "name string, polygon array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, (9.0, 9.0)), (2, (4.0, 1.0)), (3, (4.0, 6.0)), (4, (50.0, 50.0))], "id int, point struct<x:double,y:double>")
    assert rows(geo.points_in_polygons(g, p), "id", "name") == [(1, "big"), (2, "big"), (3, "big"), (3, "notch"), (4, None)]
    assert ("far", None) in rows(geo.points_in_polygons(g, p, how="polygons"), "name", "id")
    assert {r[0]: r[1] for r in g.select("name", geo.polygon_area(F.col("polygon"))).collect()} == {"big": 100.0, "notch": 48.0, "far": 100.0}


def test_text_counts(spark):
    df = spark.createDataFrame([(1, "Bad FORM, bad\tform! very  bad", "no!"), (2, None, None)], "id int, a string, b string")
    got = rows(text.term_counts(df, ["a", "b", "a"], ["Bad"], phrases=["very bad"]), "id", "n_bad", "n_very_bad", "n_words", "term_total", "n_char")
    assert got == [(1, 3, 1, 7, 4, 2), (2, 0, 0, 0, 0, 0)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("F1", 2020, 1), ("F1", 2021, 2), ("F2", 2020, 3)], "skjema string, aar int, v int")
    base = write_partitioned(df, str(tmp_path / "t"), ["skjema", "aar"])
    assert rows(collect_periods(spark, base, [2020, 2021], ["F1", "F2"]), "year", "skjema", "v") == [(2020, "F1", 1), (2020, "F2", 3), (2021, "F1", 2)]
    with pytest.raises(FileNotFoundError):
        collect_periods(spark, base, [2020, 2021], ["F1", "F2"], "error")
    files = {(2020, "F1"): f"{base}/skjema=F1/aar=2020", (2021, "F2"): f"{base}/skjema=F2/aar=2021"}
    assert collect_period_files(spark, files).count() == 1
    with pytest.raises(FileNotFoundError):
        collect_period_files(spark, files, "error")
    calls = []

    def build():
        calls.append(1)
        return df
    for reuse in (True, True, False):
        assert stage(spark, str(tmp_path / "s"), build, reuse).count() == 3
    assert len(calls) == 2


def test_stratified_tools(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("b", 2)], "c string, o int")
    assert rows(clean.encode_codes(df, "c"), "c", "c_code") == [("a", 0), ("b", 1), ("b", 1)]
    assert rows(clean.encode_codes(df, "c", order="o"), "c", "c_code") == [("a", 0), ("b", 1), ("b", 1)]
    assert rows(clean.min_class_size(df, "c", 2), "o") == [(2,), (3,)]
    h = agg.histogram(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 3).collect()
    assert [r["n"] for r in sorted(h, key=lambda r: r["bin"])] == [2, 0, 0]


def test_pca_is_centred(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 100) for i in range(10)], "a double, b double")
    out, variance, _ = models.pca_fit(df, ["a", "b"], 1)
    assert variance[0] == pytest.approx(1.0)
    assert math.isclose(sum(r["pc"][0] for r in out.collect()), 0.0, abs_tol=1e-9)


def test_equal_points_stay_as_many(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    g = spark.createDataFrame([("s", square), ("s", square)], "name string, polygon array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 9.0, 9.0), (3, None, 1.0)], "id int, x double, y double").select("id", geo.point(F.col("x"), F.col("y")).alias("point"))
    assert rows(geo.points_in_polygons(g.limit(1), p), "id", "name") == [(1, "s"), (1, "s"), (2, None), (3, None)]
    assert len(rows(geo.points_in_polygons(g, p.where("id = 1").limit(1), how="polygons"), "name", "id")) == 2


def test_missing_coordinates_have_no_neighbours(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 2.0), (3, float("nan"), 1.0)], "id int, x double, y double").select("id", geo.point(F.col("x"), F.col("y")).alias("point"))
    q = spark.createDataFrame([(7, 1.0, 2.0), (8, None, None)], "place int, x double, y double").select("place", geo.point(F.col("x"), F.col("y")).alias("point"))
    assert rows(geo.nearest_join(p, q, "id", "place"), "id", "place", "distance") == [(1, 7, 1.0)]


def test_backtest_does_not_look_ahead(spark):
    data = [(i, 2000 + i // 4, float(i % 4), "a", float(i % 4)) for i in range(8)] + [(8, 2002, 1000.0, "new", 3.0), (9, 2002, -1000.0, "new", 0.0)]
    df = spark.createDataFrame(data, "id int, year int, f double, code string, y double")
    later = df.unionByName(df.where("year = 2002").withColumns({"id": F.col("id") + 10, "year": F.lit(2003), "f": F.col("f") * 1e6}))
    got = {r.year: r.mae for r in knn.rolling_backtest(later, ["f"], ["code"], "y", "id", "year", 1, "standard").collect()}
    assert got[2001] == 0 and got[2002] == 0          # the shifted scale and the new code of 2002 and 2003 are not known
    assert rows(knn.rolling_backtest(df, ["f"], ["code"], "y", "id", "year", 1, "standard"), "year", "mae") == [(2001, 0.0), (2002, 0.0)]


def test_more_hot_groups_than_a_list(spark):
    df = spark.range(6000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("v"))
    spark.conf.set("tallyloom.hotRows", "3")
    try:
        got = windows.group_total(df, "v", ["k"], name="total")
        assert got.where("total <> 4 * k + 9000").count() == 0 and got.count() == 6000
    finally:
        spark.conf.unset("tallyloom.hotRows")


def test_repeated_field_takes_the_first_answer(spark):
    df = spark.createDataFrame([("u", 1, "oms", "5", 2), ("u", 1, "oms", "7", 1), ("u", 1, "oms", None, 0)], "id string, radnr int, feltnavn string, feltverdi string, line int")
    assert rows(reshape.eav_pivot(df, ["id", "radnr"], "feltnavn", "feltverdi", ["oms"], "line"), "oms") == [("7",)]


def test_workers_get_the_package(tmp_path):
    """A driver that only knows the package by its own path, from another folder."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.append({root!r})
from pyspark.sql import SparkSession, functions as F
from tallyloom.session import tune
from tallyloom.operators.nearest import nearest
spark = tune(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
a = spark.range(30).select("id", F.array(F.col("id").cast("double")).alias("vec"))
print("rows", nearest(a, a.withColumnRenamed("id", "other"), 1, "id", "other").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 30" in done.stdout, done.stderr[-2000:]


def test_scratch_tables_can_be_removed(spark):
    import os

    from tallyloom.session import clear_scratch, materialise, scratch_dir
    materialise(spark.range(3), "gone").count()
    clear_scratch(spark)
    assert not [n for n in os.listdir(scratch_dir(spark)) if n.startswith("gone")]


# ---------------------------------------------------------------- gaps in any pattern, many dimensions, grids

@pytest.mark.parametrize("block", [4096, 16])
def test_partial_neighbours_are_exact(spark, block):
    random.seed(11)
    data = [(i, [None if random.random() < 0.3 else float(random.randint(0, 4)) + (i % 3) * 10 for _ in range(5)], f"g{i % 2}") for i in range(260)]
    data += [(500 + i, [1.0, None, 2.0, 3.0, None], "g0") for i in range(90)]                    # a quarter of the rows are copies
    data += [(700, [None] * 5, "g1"), (701, [None, None, None, None, 2.0], "g1")]
    cols = [f"c{j}" for j in range(5)]
    df = spark.createDataFrame([(i, *v, g) for i, v, g in data], f"id int, {', '.join(c + ' double' for c in cols)}, grp string")
    got = {}
    for r in nearest_partial(df, cols, "id", 3, "grp", block_rows=block).collect():
        got.setdefault((r["id"], r["column"]), []).append((r["rank"], r["donor"], r["value"]))
    want = {}
    for i, v, g in data:
        for c in range(5):
            if v[c] is not None:
                continue
            found = []
            for j, w, h in data:
                on = [k for k in range(5) if v[k] is not None and w[k] is not None]
                if h == g and w[c] is not None and on:
                    found.append((round(sum((v[k] - w[k]) ** 2 for k in on) * 5 / len(on), 9), j, w[c]))
            if found:
                want[(i, c)] = [(n, j, x) for n, (_, j, x) in enumerate(sorted(found)[:3], 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_partial_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "id int, a double, b double")
    assert nearest_partial(df, ["a", "b"], "id", 2).count() == 0 and knn.knn_impute(df, ["a", "b"], "id").count() == 0
    one = spark.createDataFrame([(1, None, None), (2, 1.0, None)], "id int, a double, b double")
    assert rows(knn.knn_impute(one, ["a", "b"], "id"), "id", "a", "b") == [(1, 1.0, 0.0), (2, 1.0, 0.0)]


def test_number_of_blocks_does_not_grow_with_patterns(spark):
    random.seed(3)
    df = spark.createDataFrame([(i, *[None if random.random() < 0.5 else random.random() for _ in range(8)]) for i in range(600)], "id int, " + ", ".join(f"c{j} double" for j in range(8)))
    patterns = df.select(*[F.col(f"c{j}").isNull() for j in range(8)]).distinct().count()
    near = nearest_partial(df, [f"c{j}" for j in range(8)], "id", 2, block_rows=100)
    assert patterns > 150 and near.select("id").distinct().count() > 500


@pytest.mark.parametrize("block", [None, 4])
def test_nearest_in_many_dimensions_is_exact(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)) + rng.integers(0, 3, 400)[:, None] * 4
    x[:, 5] = np.where(rng.random(400) < 0.01, 1e4, x[:, 5])                                     # outliers
    don = [(i, [float(v) for v in x[i]], [int(i % 3)], f"g{i % 2}") for i in range(400)] + [(1000 + i, [float(v) for v in x[0]], [1], "g0") for i in range(50)]
    que = [(i, [float(v) for v in x[i] + 0.1], [int(i % 4)], ["g0"] if i % 3 else ["g0", "g1"]) for i in range(80)]
    d = spark.createDataFrame(don, "did int, vec array<double>, cats array<bigint>, grp string")
    q = spark.createDataFrame(que, "qid int, vec array<double>, cats array<bigint>, may array<string>")
    got = {(r["qid"], r["rank"]): r["did"] for r in nearest(q, d, 3, "qid", "did", cats="cats", group="grp", groups="may", exclude_same=True, block_rows=block).collect()}
    want = {}
    for i, v, c, may in que:
        def dist(y):
            code = 0 if y[2] == c else 1 if 0 in (y[2][0], c[0]) else 2
            return round(sum((a - b) ** 2 for a, b in zip(v, y[1])) + code, 9)
        for n, y in enumerate(sorted((y for y in don if y[3] in may and y[0] != i), key=lambda y: (dist(y), y[0]))[:3], 1):
            want[(i, n)] = y[0]
    assert got == want


def test_quantised_bounds_hold_and_leave_few_pairs(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "_d int, _v array<double>")
    coder = Quantiser(df, 64)
    code = coder.encode(x)
    off = np.sqrt(((x - coder.decode(code)) ** 2).sum(axis=1))
    none = np.empty((1500, 0), np.int64)
    low, up = coder.bounds(x, none, code, off, none)
    true = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    assert (low <= true + 1e-9).all() and (true <= up + 1e-9).all()
    np.fill_diagonal(up, np.inf)
    np.fill_diagonal(low, np.inf)
    limit = np.partition(up, 4, axis=1)[:, 4]
    assert (low <= limit[:, None]).mean() < 0.1                              # of uniform vectors, where pivots leave all pairs
    assert (low <= limit[:, None]).sum(axis=1).min() >= 5


def test_power_and_weights(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 3.0, 0.0, 2.0), (3, 2.0, 2.0, 4.0), (4, 0.0, 0.0, 7.0)], "id int, a double, b double, y double")
    q = spark.createDataFrame([(9, 0.0, 0.0)], "id int, a double, b double")
    by = lambda **o: knn.knn_regress(df.where("id < 4"), q, ["a", "b"], [], "y", "id", 2, "none", **o).first()["predicted"]
    assert by() == pytest.approx((1 + 4) / 2) and by(power=1) == pytest.approx((1 + 2) / 2)      # (2, 2) is nearer by squares, (3, 0) by sums
    assert by(weights="distance") == 1.0                                                         # at distance 0 alone
    far = knn.knn_regress(df.where("id IN (2, 3)"), q, ["a", "b"], [], "y", "id", 2, "none", weights="distance", power=1).first()["predicted"]
    assert far == pytest.approx((2 / 3 + 4 / 4) / (1 / 3 + 1 / 4))
    with pytest.raises(ValueError):
        knn.weighted_mean("y", "other")
    assert knn.knn_best(df.where("false"), q, ["a", "b"], [], "y", "id").count() == 0


# ---------------------------------------------------------------- sums of products

def test_lines_of_all_folds_from_one_pass(spark):
    rng = np.random.default_rng(2)
    n = 300
    x, code = rng.normal(size=(n, 3)), rng.integers(0, 4, n)
    y = x @ [1.0, -2.0, 0.5] + np.array([0.0, 1.0, 5.0, -3.0])[code] + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(i, *map(float, x[i]), None if i == 7 else f"k{code[i]}", float(y[i])) for i in range(n)], "id int, a double, b double, c double, k string, y double")
    line, whole = gram.linear_out_of_fold(df, ["a", "b", "c"], ["k"], "y", "id", 5)
    got = {r["id"]: r["predicted"] for r in line.collect()}
    fold = {r["id"]: r["f"] for r in df.select("id", features.fold_of(F.col("id"), 5).alias("f")).collect()}
    names = ["missing" if i == 7 else f"k{code[i]}" for i in range(n)]
    known = sorted(set(names))
    full = np.concatenate([x, np.array([[float(m == v) for v in known] for m in names])], axis=1)
    for f in range(5):
        use = np.array([fold[i] != f for i in range(n)])
        beta = np.linalg.lstsq(full[use], y[use], rcond=None)[0]
        for i in np.flatnonzero(~use):
            if i != 7:
                assert got[i] == pytest.approx(full[i] @ beta, abs=1e-8)
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    out = whole.predict(df.fillna("missing", ["k"]), "id").collect()
    assert all(r["values"][0] == pytest.approx(full[r["id"]] @ beta, abs=1e-8) for r in out)


def test_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) @ np.diag([5.0, 2.0, 1.0, 0.01])
    df = spark.createDataFrame([(i, *map(float, r), f"k{i % 3}") for i, r in enumerate(x)], "id int, a double, b double, c double, d double, k string")
    parts = gram.Components(df, ["a", "b", "c", "d"], [], None, "none")
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(parts.variance, values)
    few = gram.Components(df, ["a", "b", "c", "d"], [], 0.95, "none")
    assert few.n == int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95, side="right")) + 1
    full = gram.Components(df, ["a", "b", "c", "d"], ["k"], None, "standard")
    got = {r["id"]: np.array(r["pc"]) for r in full.project(df, "id").collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = ((z[0] - z[1]) ** 2).sum() + 2                                     # all components: distances as before, codes two apart
    assert ((got[0] - got[1]) ** 2).sum() == pytest.approx(want)
    assert np.allclose(np.mean(list(got.values()), axis=0), 0, atol=1e-9)


def test_learning_curves_of_any_model(spark):
    df = spark.createDataFrame([(i, float(i % 13), float(i % 13) * 2 + (i % 5) * 0.1) for i in range(400)], "id int, x double, y double")
    fit = lambda train, test: models.linear_regress(train, ["x"], [], "y").predict(test)
    slow = {r["fraction"]: r for r in models.learning_curve(df, fit, "y", "id", (0.3, 1.0), 3).collect()}
    quick = {r["fraction"]: r for r in gram.linear_learning_curve(df, ["x"], [], "y", "id", (0.3, 1.0), 3).collect()}
    for f, r in slow.items():
        for c in ("train_mean", "train_sd", "test_mean", "test_sd"):
            assert quick[f][c] == pytest.approx(r[c], abs=1e-6)
    assert gram.linear_learning_curve(df.where("false"), ["x"], [], "y", "id").count() == 0


# ---------------------------------------------------------------- boosted trees for many classes

def test_first_round_is_the_mean_of_the_leaves(spark):
    data = [(i, float(i % 2), ["a", "b", "c"][(i // 2) % 3 if i % 2 else 0 if i % 10 else 1]) for i in range(300)]
    df = spark.createDataFrame(data, "id int, x double, label string")
    model = boost.Boosted(df, ["x"], [], "label", rounds=1, depth=1, rate=1.0, ridge=0.0, least=0.0)
    got = {r["x"]: r["probabilities"] for r in model.predict(df, "id", "x").dropDuplicates(["x"]).collect()}
    for x in (0.0, 1.0):
        share = np.array([np.mean([lab == v for _, y, lab in data if y == x]) for v in "abc"])
        step = (share - 1 / 3) / (2 / 9)                                       # mean gradient over mean curvature of the first softmax
        want = np.exp(step) / np.exp(step).sum()
        assert got[x] == pytest.approx(list(want), abs=1e-9)


def test_boosting_learns_and_is_defined_on_odd_input(spark):
    rng = np.random.default_rng(8)
    data = []
    for i in range(600):
        a, b = rng.random(2)
        label = "p" if a < 0.3 else "q" if b < 0.5 else "r"
        data.append((i, None if i % 50 == 0 else float(a), float(b), "u" if i % 7 else None, label))
    df = spark.createDataFrame(data + [(1000 + i, 0.5, 0.5, "u", "rare") for i in range(5)], "id int, a double, b double, k string, label string")
    out, report = boost.boost_classify(df, ["a", "b"], ["k"], "label", "id", rounds=4, depth=2)
    assert {r["actual"] for r in out.select("actual").distinct().collect()} == {"p", "q", "r"}
    assert out.where("actual = predicted").count() > 0.93 * out.count() and report.count() == 6
    assert out.where("abs(aggregate(probabilities, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0
    assert boost.boost_classify(df.where("label = 'p'"), ["a"], [], "label", "id")[0].where("predicted <> 'p'").count() == 0
    assert boost.boost_classify(df.where("false"), ["a"], ["k"], "label", "id")[0].count() == 0


# ---------------------------------------------------------------- roads

def test_routes_follow_the_tie_rule(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0), (1, 4, 2.0), (4, 5, 0.0), (5, 4, 0.0), (4, 6, 3.0), (5, 6, 3.0)], "src int, dst int, weight double")
    o = spark.createDataFrame([(1,)], "o int")
    d = spark.createDataFrame([(i,) for i in range(1, 7)], "d int")
    got = rows(network.route_frequencies(e, o, d), "src", "dst", "routes")
    # 4 is reached by the direct edge (fewest edges of cost 2); 6 through 4, not by the longer way over 5
    assert got == [(1, 2, 1), (1, 3, 1), (1, 4, 3), (4, 5, 1), (4, 6, 1)]
    assert network.route_frequencies(e.where("false"), o, d).count() == 0


def test_searches_against_plain_dijkstra(spark):
    import heapq
    random.seed(2)
    edges = [(random.randint(0, 40), random.randint(0, 40), round(random.choice([0.0, 0.5, random.random() * 9]), 3)) for _ in range(150)]
    e = spark.createDataFrame(edges, "src int, dst int, weight double")

    def costs(a):
        best, heap = {}, [(0.0, a)]
        while heap:
            c, u = heapq.heappop(heap)
            if u in best:
                continue
            best[u] = c
            for x, y, w in edges:
                if x == u and y not in best:
                    heapq.heappush(heap, (round(c + w, 9), y))
        return best
    every = spark.createDataFrame([(i,) for i in range(41)], "n int")
    some = spark.createDataFrame([(i,) for i in range(0, 41, 4)], "n int")
    want = {(a, b): c for a in range(41) for b, c in costs(a).items()}
    assert {(r["origin"], r["dest"]): r["cost"] for r in network.od_costs(e, every, every).collect()} == want
    near = {r["origin"]: (r["dest"], r["cost"]) for r in network.nearest_destination(e, every, some).collect()}
    plain = {}
    for a in range(41):
        reach = [(want[(a, b)], b) for b in range(0, 41, 4) if b != a and (a, b) in want]
        if reach:
            plain[a] = (min(reach)[1], min(reach)[0])
    assert near == plain


def test_rounds_write_improvements_only(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)] + [(0, 2, 3.5)], "src int, dst int, weight double")
    labels, _ = network._cheapest(e, spark.createDataFrame([(0,)], "o int"), "src", "dst", "weight", delta=2.0)       # the edge of 3.5 is heavy
    assert labels.all().count() == 6 == labels.best().count()


@pytest.mark.parametrize("power", [1, 2])
def test_boxes_leave_few_comparisons_and_the_exact_nearest(power):
    """Before boxes, a query was sent to most cells of the pivots; here it reaches few leaves, inside a block and over blocks."""
    rng = np.random.default_rng(11)
    dv, dc = rng.normal(size=(6, 20000)), rng.integers(1, 4, (1, 20000))
    qv, qc = rng.normal(size=(6, 300)), rng.integers(0, 5, (1, 300))
    dv[:, :500] = dv[:, :1]                                                       # copies
    apart = boxes.powers(qv, qc, dv, dc, power)
    want = np.argsort(np.round(apart, 9), axis=1, kind="stable")[:, :3]
    q, d, dist = boxes.nearest_in_block(qv, qc, np.full(300, np.inf), dv, dc, 3, power)
    assert (d.reshape(300, 3) == want).all() and np.allclose(dist.reshape(300, 3), np.take_along_axis(apart, want, axis=1), atol=1e-8)
    tree = boxes.Tree(dv, dc, 128)
    low, high = (np.array([f(dv[:, m], axis=1) for m in tree.members]) for f in (np.min, np.max))
    tree.fit(low, high, [[np.unique(dc[0, m])] for m in tree.members])
    bound = boxes.slack(np.sort(apart, axis=1)[:, 2])
    sent = {(int(r), leaf) for leaf, rows in tree.reach(qv, qc, bound, power) for r in rows}
    assert len(sent) < 0.25 * 300 * len(tree.members)
    leaf_of = tree.find(dv, dc)
    assert all((i, int(leaf_of[j])) in sent for i in range(300) for j in want[i])


def test_boxed_search_with_infinite_values_and_without_numbers(spark):
    d = spark.createDataFrame([(i, [float(i), 0.0 if i else float("inf")], [i % 2 + 1]) for i in range(40)], "did int, vec array<double>, cats array<bigint>")
    got = nearest(d.withColumnRenamed("did", "qid"), d, 2, "qid", "did", cats="cats", exclude_same=True, block_rows=5)
    assert got.where("qid = 0 OR did = 0").count() == 0 and got.where("qid = 5").orderBy("rank").select("did").collect() == [(4,), (6,)]
    plain = d.select("did", F.array().cast("array<double>").alias("vec"), "cats")
    assert nearest(plain.withColumnRenamed("did", "qid"), plain, 2, "qid", "did", cats="cats").where("qid = 7").orderBy("rank").select("did").collect() == [(1,), (3,)]


def test_runs_of_blocks_bound_their_rows_and_leave_few():
    """Before, every query looked at every block of every group, and compared itself with all rows of a block."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(8192, 4))
    x[rng.random(x.shape) < 0.02] = np.nan
    x = x[np.lexsort((_interleaved(x, [np.nanquantile(x[:, j], np.arange(1, 64) / 64) for j in range(4)], 6), *(~np.isnan(x)).T))]
    rows = Ranges(x, x, (~np.isnan(x)).astype(np.int64), np.ones(len(x), np.int64))
    short = rows.joined(np.arange(0, len(x), 128))
    long = short.joined(np.arange(0, 64, 8))
    v = rng.normal(size=(50, 4))
    v[:, 0] = np.nan
    true = partial_distances(v, x).reshape(50, 64, 128).min(axis=2)
    least, _ = short.bounds(v, np.arange(64))
    outer, _ = long.bounds(v, np.arange(8))
    assert (least <= true + 1e-9).all() and (outer <= least.reshape(50, 8, 8).min(axis=2) + 1e-9).all()
    kth = np.sort(partial_distances(v, x), axis=1)[:, 2]
    assert (least <= kth[:, None]).mean() < 0.5


@pytest.mark.parametrize("block", [4096, 40])
def test_partial_neighbours_with_periods_are_exact(spark, block):
    rng = random.Random(8)
    data = [(i, i % 3, *[None if rng.random() < 0.3 else float(rng.randint(0, 9)) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(data, "id int, p int, a double, b double, c double")
    got = {(r["id"], r["column"], r["rank"]): r["donor"] for r in nearest_partial(df, ["a", "b", "c"], "id", 2, "p", block_rows=block).collect()}
    want = {}
    for i, p, *v in data:
        for c in range(3):
            found = []
            for j, other, *w in data:
                both = [(x - y) ** 2 for x, y in zip(v, w) if x is not None and y is not None]
                if other == p and v[c] is None and w[c] is not None and both:
                    found.append((round(sum(both) * 3 / len(both), 9), j))
            want |= {(i, c, n): j for n, (_, j) in enumerate(sorted(found)[:2], 1)}
    assert got == want


def test_impute_with_reads_its_lines_once(spark):
    from workbook import QUERIES
    out = QUERIES["impute_with"](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "lineitem" in f]


def test_columns_read_codes_and_numbers(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, "a", "x"), (2, 2.0, 6.0, "b", None), (3, 3.0, None, "c", "x")], "id long, u double, v double, c string, d string")
    d = features.clean_features(df, ["u", "v"], ["c", "d"])
    columns = gram.Columns(d.where("id < 3"), ["u", "v"], ["c", "d"], {"u": (0.0, 1.0), "v": (0.0, 1.0)})
    batch = columns.select(d.orderBy("id").coalesce(1), "id").toArrow().combine_chunks().to_batches()[0]
    x, at = columns.read(batch)
    assert x.tolist() == [[1, 1, 5], [1, 2, 6], [1, 3, 0]]
    assert [a.tolist() for a in at] == [[3, 4, columns.size], [6, 5, 6]]


def test_a_line_through_a_gap_predicts_nothing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id long, u double")
    line = gram.Linear(gram.Columns(df, ["u"], [], {"u": (0.0, 1.0)}), {0: np.array([1.0, 2.0])})
    assert {r.id: r["values"] for r in line.predict(df, "id").collect()} == {1: [3.0], 2: [None], 3: [None]}


def _gaps_by_hand(v, far, x, k):
    out, dist = [], partial_distances(v.T, x.T)
    for q, c in zip(*np.nonzero(np.isnan(v.T)), strict=True):
        near = sorted((dist[q, j], j) for j in range(x.shape[1]) if not np.isnan(x[c, j]) and dist[q, j] <= (np.inf if far is None else far[c, q]) and np.isfinite(dist[q, j]))[:k]
        out += [(int(q), int(c), int(j), d) for d, j in near]
    return out


@pytest.mark.parametrize("patterns", [2, 40], ids=["few", "many"])
@pytest.mark.parametrize("bounded", [False, True])
def test_gaps_of_a_block_are_filled_exactly(patterns, bounded):
    rng = np.random.default_rng(patterns)
    masks = rng.random((patterns, 5)) < 0.3
    masks[0] = False
    table = lambda n: np.where(masks[rng.integers(0, patterns, n)], np.nan, rng.integers(0, 6, (n, 5)) / 2.0).T
    v, x = table(80), table(700)
    far = np.where(rng.random(v.shape) < 0.2, np.inf, rng.random(v.shape) * 3) if bounded else None
    cuts = [np.linspace(0, 2.5, 7) for _ in range(5)]
    got = partial.gaps_in_block(v, far, x, 3, cuts, 3)
    assert [(int(q), int(c), int(j), float(d)) for q, c, j, d in zip(*got, strict=True)] == _gaps_by_hand(v, far, x, 3)


def test_feature_panel_searches_once(spark, monkeypatch):
    from workbook import QUERIES
    written = []
    plain = panel.materialise
    monkeypatch.setattr(panel, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    out = QUERIES["feature_panel"](spark, "/root/testdata/sf0.001")
    assert written == ["growth", "filled"] and "Arrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_stage_ends_its_shuffle(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {f.split("_")[1] for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}
    before = shuffles()
    out = session.materialise(spark.range(1000).repartition(3, "id"), "t")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and out.where("id >= 0").collect()


def test_settled_results_keep_no_tables_on_the_way(spark):
    kept, seen = session.materialise(spark.range(5), "kept"), []

    def build():
        seen.append(session.materialise(kept.withColumn("x", F.col("id") * 2), "way"))
        return seen[0].where("x > 3")
    out = session.settle(spark, build, "out")
    exists = lambda df: all(os.path.exists(f.removeprefix("file:")) for f in df.inputFiles())
    assert rows(out, "id", "x") == [(2, 4), (3, 6), (4, 8)] and exists(kept) and exists(out) and not exists(seen[0])


@pytest.mark.parametrize("name", ["end_to_end_totals", "end_to_end_update", "end_to_end_check", "end_to_end"])
def test_the_run_keeps_its_panel_and_units_only(spark, name):
    from workbook import QUERIES
    before = len(session._written)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [os.path.basename(p).rsplit("-", 1)[0] for p in session._written[before:]] == ["panel", "units"]


def test_industry_control_moves_units_by_parent_twice_and_by_id_once(spark):
    from workbook import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["industry_cost_control"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3


def test_hot_deck_orders_hot_groups_twice_only(spark, monkeypatch):
    rng, written = random.Random(3), []
    data = [(i, f"u{rng.randrange(6)}", "c" if rng.random() < 0.8 else "d", float(rng.randrange(5)), i / 100) for i in range(60)]
    df = spark.createDataFrame(data, "row int, id string, c string, x double, r double")
    plain = ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    spark.conf.set("tallyloom.hotRows", "1")
    try:
        got = rows(hotdeck.nearest_donors(df.where("row % 2 = 0"), df.where("row % 3 < 2"), ["c"], "x", ["r"], "row", "row", "id"), "row", "distance", "donor_id", "r")
    finally:
        spark.conf.unset("tallyloom.hotRows")
    want = []
    for a in data[::2]:
        pairs = [(abs(a[3] - b[3]), b[1], b[0]) for b in data if b[0] % 3 < 2 and a[2] == b[2] and a[1] != b[1]]
        want += [(a[0], d, u, r / 100) for d, u, r in sorted(pairs)[:1]]
    assert got == sorted(want, key=str) and written == ["sliced", "sliced"]


def test_a_block_is_bounded_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v, q = rng.random((3000, 20)), rng.random((300, 20))
    donors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "_d int, _v array<double>")
    coder, none, shapes = Quantiser(donors, 20), np.zeros((3000, 0), np.int64), []
    code = coder.encode(v)
    off = np.sqrt(((v - coder.decode(code)) ** 2).sum(axis=1))
    plain = coder._bounds
    monkeypatch.setattr(coder, "_bounds", lambda *a: (shapes.append((len(a[0]), len(a[2]))), plain(*a))[1])
    limit, same = np.where(np.arange(300) % 3, np.inf, 0.4), (np.arange(300), np.arange(3000))
    i, j, up, low = coder.within(q, none[:300], limit, code, off, none, 4, same)
    assert max(a * b for a, b in shapes) <= 256 * 2048
    below, above = coder.bounds(q, none[:300], code, off, none)
    below[np.arange(300), np.arange(300)] = above[np.arange(300), np.arange(300)] = np.inf
    far = np.minimum(limit, np.sort(above, axis=1)[:, 3])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(below <= far[:, None] + 1e-8)), strict=True))
    assert np.allclose(up, above[i, j]) and np.allclose(low, below[i, j])
