"""Hot-deck imputation: donors in the same code with the nearest value of one measure, from fine to coarse levels.

Nearest in one dimension needs no distance table. Donors and queries stand in one order inside each code. A single donor is the last one passed
on the way to the query, or the last one with another id, from below and from above: running values over one shuffle (correct for hot codes).
For several donors, they are numbered in order, a query is placed among them, and its neighbours to either side are fetched by position:
an equality join on (code, position), spread evenly whatever the size of the code. Each donor also knows the next
donor with another id, so own rows are skipped in one step however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse_number, safe_div
from ..session import materialise, settle
from .grouping import hot_keys, split_hot
from .ordering import add_lags, running, sliced


def nearest_donors(queries: DataFrame, donors: DataFrame, levels: Sequence[str], x: str, carry: Sequence[str],
                   qid: str, did: str, unit: str, k: int = 1, keys: Sequence[str] = (), allow_repeat: bool = False) -> DataFrame:
    """The k best donors per query: ``(qid, rank, level, distance, donor_id, *carry)``.

    Levels go from fine to coarse; ``level`` counts from 0. A donor has another ``unit`` id than the query. Ties take
    the smallest unit id, then the smallest donor row. ``qid``/``did`` identify rows. ``keys`` must match too
    (bootstrap iteration). Donors found at a finer level are not taken again unless ``allow_repeat``.
    """
    if k == 1:
        return _nearest_donor(queries, donors, levels, x, carry, qid, did, unit, keys)
    keys = list(keys)
    place = [*keys, "_lvl", "_code", "_side"]

    def spread(df: DataFrame, row: str, extra: Sequence[str]) -> DataFrame:
        # Side +1: values above the query's, side -1: values up to it, mirrored so that both sides read upwards.
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("_lvl"), F.col(c).cast("string").alias("_code"))
                                 for i, c in enumerate(levels)])).alias("_at")
        df = df.where(F.col(x).isNotNull()).select(*keys, F.col(row).alias("_row"), F.col(unit).alias("_id"), F.col(x).alias("_x"), *extra, at)
        df = df.select(*keys, "_row", "_id", "_x", *extra, "_at.*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("_side"))
        return df.where(F.col("_code").isNotNull()).withColumn("_y", F.col("_x") * F.col("_side"))

    d = spread(donors, did, carry)
    hot = hot_keys(d, place)
    d = running(d, place, ["_y", "_id", "_row"], sums={"_pos": F.lit(1).cast("long")}, hot=hot)
    d = d.withColumn("_me", F.struct("_pos", "_id", "_x", "_row", *carry))
    # The next donor with another id: the neighbour where the id changes, carried back over the run.
    back = [F.col("_y").desc(), F.col("_id").desc(), F.col("_row").desc()]
    d = add_lags(d, place, back, "_me", 1, drop_incomplete=False, hot=hot)
    change = F.when(F.col("_me_lag1._id") != F.col("_id"), F.col("_me_lag1"))
    d = running(d, place, back, lasts={"_next": change}, hot=hot)
    deck = materialise(d.select(*place, "_pos", "_me", "_next", "_id"), "deck")

    # Queries and donors in one order. ``_kind`` puts a query behind equal donors on side +1 and before them on side -1,
    # so equal values belong to exactly one side.
    q = spread(queries, qid, [])
    both = q.select(*place, "_y", F.col("_side").alias("_kind"), "_row", "_id", "_x") \
        .unionByName(deck.select(*place, (F.col("_me._x") * F.col("_side")).alias("_y"), F.lit(0).alias("_kind"),
                                 F.lit(None).cast(q.schema["_row"].dataType).alias("_row"),
                                 F.lit(None).cast(q.schema["_id"].dataType).alias("_id"),
                                 F.lit(None).cast("double").alias("_x")))
    order = ["_y", "_kind", "_row"]
    is_donor = (F.col("_kind") == 0).cast("long")
    placed = running(both, place, order, sums={"_before": is_donor})
    state = placed.where("_kind <> 0").select(*place, "_row", "_id", "_x", (F.col("_before") + 1).alias("_cursor"))

    deck = deck.select(*place, F.col("_pos").alias("_cursor"), F.col("_id").alias("_did"), "_me", "_next")
    for i in range(k):
        state = state.join(deck, [*place, "_cursor"], "left")
        pick = F.when(F.col("_did") != F.col("_id"), F.col("_me")).otherwise(F.col("_next"))
        state = state.withColumn(f"_p{i}", pick).drop("_did", "_me", "_next") \
            .withColumn("_cursor", F.col(f"_p{i}._pos") + 1)
    found = state.select(*keys, "_row", "_lvl", "_x", F.explode(F.array(*[F.col(f"_p{i}") for i in range(k)])).alias("_p")) \
        .where(F.col("_p").isNotNull())
    found = found.select(*keys, F.col("_row").alias(qid), F.col("_lvl").alias("level"), F.abs(F.col("_p._x") - F.col("_x")).alias("distance"),
                         F.col("_p._id").alias("donor_id"), F.col("_p._row").alias("_drow"), *[F.col(f"_p.{c}").alias(c) for c in carry])
    # At most levels x 2 sides x k rows per query from here on: one shuffle by query serves all three windows.
    found = found.repartition(*keys, qid)
    best = ["distance", "donor_id", "_drow"]

    def number(part: Sequence[str], order: Sequence[str]) -> Column:
        return F.row_number().over(Window.partitionBy(*keys, qid, *part).orderBy(*order))
    found = found.withColumn("_in", number(["level"], best)).where(F.col("_in") <= k)
    if not allow_repeat:
        found = found.withColumn("_in", number(["_drow"], ["level"])).where("_in = 1")
    return found.withColumn("rank", number([], ["level", *best])).where(F.col("rank") <= k).drop("_drow", "_in")


def _nearest_donor(queries: DataFrame, donors: DataFrame, levels: Sequence[str], x: str, carry: Sequence[str],
                   qid: str, did: str, unit: str, keys: Sequence[str]) -> DataFrame:
    """:func:`nearest_donors` for one donor: both sides from one order of donors and queries, the better one kept where it is found."""
    keys = list(keys)
    place = [*keys, "_lvl", "_code"]

    def spread(df: DataFrame, *cols: Column) -> DataFrame:
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("_lvl"), F.col(c).cast("string").alias("_code")) for i, c in enumerate(levels)])).alias("_at")
        df = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), *cols, at)
        return df.select(*keys, "_at.*", "_x", *[c for c in df.columns if c not in (*keys, "_at", "_x")]).where(F.col("_code").isNotNull())

    q = spread(queries, F.col(qid).alias("_row"), F.col(unit).alias("_id"), F.lit(True).alias("_query"))
    d = spread(donors, F.struct(F.col(unit).alias("_id"), F.col(x).alias("_x"), F.col(did).alias("_row"), *carry).alias("_me"))
    both = q.unionByName(d.withColumn("_query", F.lit(False)), allowMissingColumns=True)
    kept = both.columns

    def passed(df: DataFrame, y: Column, behind: Column, name: str, hot: bool) -> DataFrame:
        """``name``: the donor passed last on the way down to the query in ``y``; of equal ones the smallest id, then the smallest row."""
        order = [y.desc(), behind, F.col("_me._id").desc(), F.col("_me._row").desc(), F.col("_row").desc()]
        df = _last_two(df, place, order, hot)
        pick = F.when(F.col("_last._id") != F.col("_id"), F.col("_last")).otherwise(F.col("_other"))
        return df.withColumn(name, F.when(F.col("_query"), pick)).select(*kept, *[c for c in df.columns if c == "_above"], name)

    def both_sides(df: DataFrame, hot: bool) -> DataFrame:
        # Equal values belong to one side: from above a query stands before equal donors, from below behind them.
        df = passed(df, F.col("_x"), F.col("_query").desc(), "_above", hot)
        return passed(df, -F.col("_x"), F.col("_query").asc(), "_below", hot).where("_query")

    # Split once: each part goes its whole way alone, and what the hot one writes on it goes with its result.
    cold, warm = split_hot(both, place)
    both = both_sides(cold, False)
    if warm is not None:
        both = both.unionByName(settle(queries.sparkSession, lambda: both_sides(warm, True), "hot"))

    def found(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._x") - F.col("_x")).alias("distance"), F.col(f"{c}._id").alias("donor_id"),
                                                     F.col(f"{c}._row").alias("_drow"), *[F.col(f"{c}.{v}").alias(v) for v in carry]))
    best = both.select(*keys, F.col("_row").alias(qid), F.col("_lvl").alias("level"), F.least(found("_above"), found("_below")).alias("_p")).where(F.col("_p").isNotNull())
    order = Window.partitionBy(*keys, qid).orderBy("level", "distance", "donor_id", "_drow")
    return best.select(*keys, qid, "level", "_p.*").withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("_drow")


def _last_two(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot: bool) -> DataFrame:
    """Adds ``_last``, the donor ``_me`` that the row or the last one before it has, and ``_other``, the last before that with another id.

    Hot groups: each slice finds both alone. What the slices before it end with, at most two donors per slice and key, replaces what a slice has not met.
    """
    df = sliced(df, keys, order) if hot else df
    w = Window.partitionBy(*keys, *(["_slice"] if hot else [])).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_prev", F.last("_me", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    change = F.when(F.col("_prev._id") != F.col("_me._id"), F.col("_prev"))
    df = df.withColumns({"_last": F.last("_me", ignorenulls=True).over(so_far), "_other": F.last(change, ignorenulls=True).over(so_far)}).drop("_prev")
    if not hot:
        return df
    ends = df.withColumn("_end", F.lead(F.lit(1)).over(w).isNull()).where("_end").select(*keys, "_slice", "_last", "_other")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    met = F.filter(F.flatten(F.collect_list(F.array("_other", "_last")).over(before)), lambda x: x.isNotNull())
    carry = ends.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_slice").alias("_s"), met.alias("_met")).withColumn("_c_last", F.try_element_at("_met", F.lit(-1)))
    carry = carry.withColumn("_c_other", F.try_element_at(F.filter("_met", lambda x: x["_id"] != F.col("_c_last._id")), F.lit(-1))).drop("_met")
    cond = df["_slice"] == carry["_s"]
    for k in keys:
        cond = cond & df[k].eqNullSafe(carry["_k_" + k])
    df = df.join(F.broadcast(carry), cond, "left")
    earlier = F.when(F.col("_last").isNull() | (F.col("_c_last._id") == F.col("_last._id")), F.col("_c_other")).otherwise(F.col("_c_last"))
    return df.withColumns({"_last": F.coalesce("_last", "_c_last"), "_other": F.coalesce("_other", earlier)}).drop("_slice", *carry.columns)


def hot_deck(df: DataFrame, levels: Sequence[str], x: str, ratio: str, amount: str, id: str, row: str) -> DataFrame:
    """Donor = another unit of the finest code that has one, nearest in ``x``; predicted = donor ratio x own amount."""
    near = nearest_donors(df, df, levels, x, [ratio], row, row, id, 1)
    return df.join(near.select(row, "donor_id", "level", F.col(ratio).alias("donor_ratio")), row, "left") \
        .withColumn("predicted", F.col("donor_ratio") * F.col(amount))


def in_share(key: Column, iteration: Column, share_hex: str) -> Column:
    """Deterministic draw: the md5 of key and iteration lies below a hexadecimal share (``3333`` = 20 %)."""
    return F.substring(F.md5(F.concat_ws(":", key.cast("string"), iteration.cast("string"))), 1, len(share_hex)) < share_hex


def hot_deck_bootstrap(df: DataFrame, n: int, levels: Sequence[str], x: str, ratio: str, amount: str, actual: str,
                       id: str, row: str, donor_share: str = "3333") -> DataFrame:
    """``n`` draws: the drawn 20 % are donors for the other 80 %; one row per draw and imputed row with its residual.

    All draws are one job: the draw number is part of the key.
    """
    every = df.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(n))))
    every = every.withColumn("_donor", in_share(F.col(row), F.col("iteration"), donor_share))
    q, d = every.where(~F.col("_donor")).drop("_donor"), every.where("_donor").drop("_donor")
    near = nearest_donors(q, d, levels, x, [ratio], row, row, id, 1, ["iteration"])
    out = q.join(near.select("iteration", row, "donor_id", F.col(ratio).alias("donor_ratio")), ["iteration", row], "left")
    return out.withColumn("predicted", F.col("donor_ratio") * F.col(amount)) \
        .withColumn("residual", F.col(actual) - F.col("predicted"))


def hot_deck_k(queries: DataFrame, donors: DataFrame, levels: Sequence[str], x: str, ratio: str, amount: str, id: str,
               row: str, donor_row: str, k: int = 3, allow_repeat: bool = False) -> DataFrame:
    """Mean ratio of up to k donors, collected from the finest to the coarsest level."""
    near = nearest_donors(queries, donors, levels, x, [ratio], row, donor_row, id, k, allow_repeat=allow_repeat)
    mean = near.groupBy(row).agg(F.avg(ratio).alias("donor_ratio"), F.count(F.lit(1)).alias("donors"))
    return queries.join(mean, row, "left").withColumn("predicted", F.col("donor_ratio") * F.col(amount))


def ratio_frame(wide: DataFrame, keys: Sequence[str] = ("id", "year"), level: str = "radnr", unit_type: str = "01",
                codes: Sequence[str] = ("45", "46", "47"), prefixes: tuple[int, int] = (4, 5)) -> DataFrame:
    """Single-unit establishment row paired with its enterprise row, turnover per employee and sales per turnover.

    Input as read (text values with decimal comma); units without employees and incomplete rows are dropped.
    """
    up = wide.where(F.col(level) == 0).select(*keys, "salgsint", "nacef_5", "forbruk")
    down = wide.where((F.col(level) == 1) & (F.col("regtype") == unit_type)).select(
        *keys, "b_kommunenr", "gjeldende_bdr_syss", "gjeldende_omsetn_kr")
    df = down.join(up, list(keys), "left").withColumns({
        c: parse_number(c) for c in ("gjeldende_omsetn_kr", "gjeldende_bdr_syss", "salgsint")})
    df = df.where(F.coalesce("gjeldende_bdr_syss", F.lit(-1)) != 0).withColumns({
        "oms_per_syss": F.coalesce(safe_div("gjeldende_omsetn_kr", "gjeldende_bdr_syss"), F.lit(0.0)),
        "salgsint_per_oms": safe_div("salgsint", "gjeldende_omsetn_kr"),
        "n3": F.substring("nacef_5", 1, prefixes[0]), "n4": F.substring("nacef_5", 1, prefixes[1])})
    return df.dropna().where(F.substring("nacef_5", 1, 2).isin(list(codes)))
