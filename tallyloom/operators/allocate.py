"""Allocation of parent totals to units under rules.

Columns (survey names): ``id`` parent form, ``orgnr_n_1`` parent, ``lopenr`` run, ``regtype`` unit type (``01`` single,
``02`` multi, ``04`` helper), ``foretak_omsetning``/``foretak_driftskostnad`` parent turnover and cost,
``new_oms``/``gjeldende_driftsk_kr`` the unit's, ``lonn`` wage share in percent, ``gjeldende_lonn_kr`` wages,
``b_sysselsetting_syss`` employees, ``salgsint``/``forbruk`` parent sales income and goods consumption.

Every operator needs sums over the parent only. ``totals`` lets a chain of them share one split into ordinary and
hot parents (see grouping); ordinary parents then need one shuffle for the whole chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rint0, safe_div, zero_if_null
from ..session import materialise
from .clean import drop_zero_total, fix_unit_error
from .grouping import Totals, WindowTotals, by_group

OMS, COST, NEW_COST = "new_oms", "gjeldende_driftsk_kr", "new_drkost"
T_OMS, T_COST, SIZE = "foretak_omsetning", "foretak_driftskostnad", "b_sysselsetting_syss"


def _list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def impute_by_margin(df: DataFrame, cost: str = COST, oms: str = OMS, total_cost: str = T_COST,
                     total_oms: str = T_OMS) -> DataFrame:
    """Missing cost = own turnover x the parent's cost per turnover; units of parents without totals are dropped."""
    margin = F.coalesce(safe_div(total_cost, total_oms), F.lit(0.0))
    df = df.withColumn(cost, F.coalesce(F.col(cost), margin * F.col(oms), F.lit(0.0)))
    return drop_zero_total(df, [total_oms, total_cost])


def allocate_cost(df: DataFrame, key: str | Sequence[str] = "id", cost: str = COST, total: str = T_COST, wage_share: str = "lonn",
                  size: str = SIZE, oms: str = OMS, total_oms: str = T_OMS, fallbacks: bool = True, name: str = NEW_COST,
                  totals: Totals | None = None) -> DataFrame:
    """Parent cost by share of reported cost; if nothing is reported by wage share, else by employees.

    ``fallbacks=False``: share of reported cost only.
    """
    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, _list(key), _d=F.sum(cost), _s=F.sum(size))
        none = F.coalesce(F.col("_d"), F.lit(0.0)) == 0
        share = safe_div(cost, "_d")
        if fallbacks:
            share = F.coalesce(F.when((F.col(total) != 0) & none, F.col(wage_share) / 100).otherwise(share), F.lit(0.0))
            share = F.when(none & (share == 0) & (F.col(total) != 0), safe_div(size, "_s")).otherwise(share)
        new = F.coalesce(F.bround(share, 10) * F.col(total), F.col(cost))
        part = part.withColumn(name, F.when(F.col(total) == 0, F.lit(0.0)).otherwise(new))
        if fallbacks:
            part = part.withColumn(oms, F.when(F.col(total_oms) == 0, F.lit(0.0)).otherwise(F.col(oms)))
        return part.drop("_d", "_s")
    return by_group(df, _list(key), step, totals)


def allocate_with_helpers(df: DataFrame, key: str | Sequence[str] = "id", helper: Column | None = None, oms: str = OMS,
                          cost: str = NEW_COST, total: str = T_OMS, wage_share: str = "lonn", size: str = SIZE,
                          totals: Totals | None = None) -> DataFrame:
    """Helper units turn over their cost; the rest of the parent's turnover is split among the others.

    By turnover share, by wage share if no unit reported turnover, by employees if none is left; 1 if the rest is 0.
    """
    helper = F.coalesce(F.col("regtype") == "04" if helper is None else helper, F.lit(False))
    wage = F.col(wage_share) / 100

    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, _list(key), _h=F.sum(F.when(helper, F.col(cost))), _all=F.sum(oms),
                     _n=F.sum(F.when(~helper, F.col(oms))), _w=F.sum(F.when(~helper, wage)),
                     _s=F.sum(F.when(~helper, F.col(size))))
        parent = zero_if_null(total)
        rest = parent - zero_if_null("_h")
        n = zero_if_null("_n")
        share = F.when(rest == 0, F.lit(1.0)) \
            .when((parent != 0) & (zero_if_null("_all") == 0), safe_div(wage, F.col("_w"))) \
            .when(n != 0, safe_div(F.col(oms), n)).otherwise(safe_div(size, "_s"))
        new = F.when(helper, F.col(cost)).otherwise(F.coalesce(share, F.lit(0.0)) * rest)
        return part.withColumn(oms, new).drop("_h", "_all", "_n", "_w", "_s")
    return by_group(df, _list(key), step, totals)


def flag_industry(df: DataFrame, code: str = "tmp_sn2007_5", parent: str = "orgnr_n_1", name: str = "vhbed",
                  in2: Sequence[str] = ("45", "46", "47"), out_exact: Sequence[str] = ("45.403",),
                  out4: Sequence[str] = ("45.2", "46.1"), totals: Totals | None = None) -> DataFrame:
    """Trade flag by code prefix with exceptions; a parent without any trade unit counts as all trade."""
    own = F.substring(code, 1, 2).isin(list(in2)) & ~F.col(code).isin(list(out_exact)) \
        & ~F.substring(code, 1, 4).isin(list(out4))
    own = F.coalesce(own, F.lit(False)).cast("int")

    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part.withColumn(name, own), [parent], _any=F.max(F.col(name)))
        return part.withColumn(name, F.when(F.col("_any") == 0, F.lit(1)).otherwise(F.col(name))).drop("_any")
    return by_group(df, [parent], step, totals)


def fix_consumption(df: DataFrame) -> DataFrame:
    """Consumption above the parent's cost was given in the wrong unit."""
    return fix_unit_error(df, "forbruk", T_COST, 1000.0)


def allocate_two_tier(df: DataFrame, keys: Sequence[str] = ("orgnr_n_1", "lopenr"), flag: str = "vhbed",
                      income: str = "salgsint", goods: str = "forbruk", weight: str = OMS,
                      names: tuple[str, str] = ("bedr_salgsint", "bedr_forbruk"), totals: Totals | None = None) -> DataFrame:
    """Parent sales income and consumption to units by turnover.

    Parents with trade units only: by share. Mixed parents: trade units first, income capped at their own
    turnover and consumption in the parent's proportion; what is left goes to the other units.
    """
    keys, (n_inc, n_goods) = list(keys), names
    trade = F.col(flag) == 1
    w = F.col(weight)

    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, keys, _pure=F.min(flag), _v=F.sum(F.when(trade, w)), _a=F.sum(F.when(~trade, w)))
        pure = F.col("_pure") == 1
        by_trade = safe_div(w, F.col("_v"))
        first_inc = rint0(F.col(income) * by_trade)
        first_goods = F.when(pure, rint0(F.col(goods) * by_trade))
        first_inc = F.when(pure, first_inc).when(trade, F.when(first_inc > w, w).otherwise(first_inc))
        part = part.withColumn(n_inc, first_inc)
        part = part.withColumn(n_goods, F.when(pure, first_goods).when(
            trade, rint0(F.col(n_inc) * safe_div(goods, income))))
        mixed_trade = trade & ~pure
        part = t.add(part, keys, _u_inc=F.sum(F.when(mixed_trade, F.col(n_inc))),
                     _u_goods=F.sum(F.when(mixed_trade, F.col(n_goods))))
        other = ~trade & ~pure
        by_other = safe_div(w, F.col("_a"))
        return part.withColumns({
            n_inc: F.when(other, rint0((F.col(income) - zero_if_null("_u_inc")) * by_other)).otherwise(F.col(n_inc)),
            n_goods: F.when(other, rint0((F.col(goods) - zero_if_null("_u_goods")) * by_other)).otherwise(F.col(n_goods)),
        }).drop("_pure", "_v", "_a", "_u_inc", "_u_goods")
    return by_group(df, keys[:1], step, totals)


def override_single_units(df: DataFrame, key: str | Sequence[str] = "id", kind: str = "regtype",
                          figures: dict[str, str] | None = None, totals: Totals | None = None) -> DataFrame:
    """A single-unit type whose id repeats becomes multi-unit; true single units take the parent's figures."""
    figures = figures or {OMS: T_OMS, NEW_COST: T_COST, "bedr_salgsint": "salgsint", "bedr_forbruk": "forbruk"}

    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, _list(key), _n=F.count(F.lit(1)))
        part = part.withColumn(kind, F.when((F.col(kind) == "01") & (F.col("_n") > 1), "02").otherwise(F.col(kind)))
        single = F.col(kind) == "01"
        return part.withColumns({a: F.when(single, F.col(b)).otherwise(F.col(a)) for a, b in figures.items()}).drop("_n")
    return by_group(df, _list(key), step, totals)


def enforce_minimum(df: DataFrame, keys: Sequence[str] = ("orgnr_n_1", "lopenr"), value: str = NEW_COST,
                    floor_parts: Sequence[str] = ("gjeldende_lonn_kr", "bedr_forbruk"),
                    surplus_parts: Sequence[str] | None = None, totals: Totals | None = None) -> DataFrame:
    """Raise cost to the sum of its parts and take the excess from other units of the parent by their surplus.

    ``thief`` marks raised units. Parents without one are untouched; a parent whose units are all raised, or whose
    others have no surplus, ends above its total, which ``reconcile`` reports. ``surplus_parts``: parts
    used for the surplus where they differ from the floor.
    """
    keys = list(keys)

    def parts(cols: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for c in cols:
            total = total + zero_if_null(c)
        return total
    have, floor = zero_if_null(value), parts(floor_parts)
    thief = F.coalesce(have < floor, F.lit(False))
    surplus = F.abs(have - parts(surplus_parts or floor_parts))

    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = part.withColumns({"_have": have, "_floor": floor, "_u": surplus, "thief": thief.cast("int")})
        part = t.add(part, keys[:1], _any=F.max("thief"))
        part = t.add(part, keys, _u0=F.sum(F.when(F.col("thief") == 0, F.col("_u"))),
                     _u1=F.sum(F.when(F.col("thief") == 1, F.col("_u"))))
        taken = F.col("_have") - rint0(safe_div("_u", "_u0") * F.col("_u1"))
        new = F.when(F.col("thief") == 1, F.col("_floor")).otherwise(F.coalesce(taken, F.col("_have")))
        return part.withColumn(value, F.when(F.col("_any") == 1, new).otherwise(F.col("_have"))) \
            .drop("_have", "_floor", "_u", "_any", "_u0", "_u1")
    return by_group(df, keys[:1], step, totals)


def reconcile(df: DataFrame, key: str, value: str, total: str, tol: float = 1000.0, keep: str = "above",
              totals: Totals | None = None, source: DataFrame | None = None) -> DataFrame:
    """Sum of allocated values beside the parent total; rows to check (``above`` tolerance), ``within``, or ``all``."""
    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, [key], allocated=F.sum(value))
        return part.withColumn("difference", F.col(total) - F.col("allocated"))
    out = by_group(df, [key], step, totals, source)
    off = F.abs("difference") > tol
    if keep == "all":
        return out.withColumn("exact", F.col("difference") == 0)
    return out.where(off if keep == "above" else ~off)


REGISTER_COSTS = ["no4295_f", "no4995_f", "no6200_f"]


def with_register_costs(df: DataFrame, register: DataFrame, key: str = "id") -> DataFrame:
    """Adds the extra cost items of the register (cut to one row per id) to every unit, 0 where there are none."""
    one = register.groupBy(key).agg(*[F.max(c).alias(c) for c in REGISTER_COSTS])
    return df.join(one, key, "left").fillna(0.0, subset=REGISTER_COSTS)


def industry_cost_control(df: DataFrame, register: DataFrame | None, keys: Sequence[str] = ("orgnr_n_1", "lopenr"), key: str = "id",
                          cost: str = NEW_COST, code: str = "tmp_sn2007_5", parent_code: str = "nacef_5",
                          low: int = 5, high: int = 33, source: DataFrame | None = None) -> DataFrame:
    """Cost control for parents with manufacturing units (two-digit industry ``low``..``high``).

    Adds ``share`` (of parent cost, or of manufacturing cost where the parent has manufacturing) and applies the
    minimum rule with the extra cost items of the register (``no4295_f, no4995_f, no6200_f`` of the parent, ``no4295,
    no4995, no6200`` of the unit); then single units take the parent's cost and totals by id are shown. The
    register is cut to one row per id; None: ``df`` has its items already (:func:`with_register_costs`, where rows lie by id anyway). ``source``: an earlier table with at least the rows of ``df`` (parent and ``key`` columns), on which groups are
    counted; without it ``df`` is written once, because it is read for the counts, too.
    """
    keys = list(keys)
    if register is not None:
        df = with_register_costs(df, register, key)
    two = F.substring(F.coalesce(F.col(code), F.col(parent_code)), 1, 2).try_cast("int")
    df = df.withColumn("industrial", F.coalesce(two.between(low, high), F.lit(False)).cast("int"))
    if source is None:
        # Counted twice and read once: the chain before this is run once, into a written table.
        df = source = materialise(df, "units")

    def step(part: DataFrame, t: Totals) -> DataFrame:
        if isinstance(t, WindowTotals):
            part = part.repartition(keys[0])       # serves the windows by parent and by run
        part = t.add(part, keys, has_industrial=F.max("industrial"),
                     fdk_indr=F.sum(F.when(F.col("industrial") == 1, F.col(cost))),
                     fdk_vanl=F.sum(F.when(F.col("industrial") == 0, F.col(cost)))).fillna(0.0, ["fdk_indr", "fdk_vanl"])
        share = F.when(F.col("has_industrial") == 0, safe_div(cost, T_COST)) \
            .when(F.col("industrial") == 1, safe_div(cost, "fdk_indr")).otherwise(F.lit(0.0))
        part = part.withColumn("share", F.coalesce(share, F.lit(0.0)))
        base = ["gjeldende_lonn_kr", "bedr_forbruk"]
        part = enforce_minimum(part, keys, cost, [*base, "no4295", "no4995", "no6200"], [*base, *REGISTER_COSTS], totals=t)
        single = F.col("regtype") == "01"
        return part.withColumns({a: F.when(single, F.col(b)).otherwise(F.col(a)) for a, b in
                                 {OMS: T_OMS, cost: T_COST, "bedr_salgsint": "salgsint", "bedr_forbruk": "forbruk"}.items()})
    out = by_group(df, keys[:1], step, source=source)
    return reconcile(out, key, cost, T_COST, keep="all", source=source)
