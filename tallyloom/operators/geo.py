"""Places: coordinates, nearest places, polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .nearest import nearest


def attach_coordinates(df: DataFrame, yearly: Sequence[DataFrame], key: str, x: str = "x_koordinat", y: str = "y_koordinat",
                       extra: Sequence[str] = ()) -> DataFrame:
    """Union of the yearly place files, distinct, joined to the units; units without place are dropped."""
    places = yearly[0].select(key, x, y, *extra)
    for p in yearly[1:]:
        places = places.unionByName(p.select(key, x, y, *extra))
    return df.join(places.distinct(), key, "left").dropna(subset=[x, y])


def region_totals(df: DataFrame, regions: DataFrame, measure: str, code: Column, year: Column, region: str) -> DataFrame:
    """Sum per region for one industry and year; every region is listed, without data: 0."""
    sums = df.where(code & year).groupBy(region).agg(F.sum(measure).alias("_sum"))
    return regions.join(sums, region, "left").withColumn(measure, F.coalesce("_sum", F.lit(0.0))).drop("_sum")


def point(x: Column, y: Column) -> Column:
    """x then y."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _with_vec(df: DataFrame, p: str) -> DataFrame:
    return df.withColumn("vec", F.array(F.col(f"{p}.x"), F.col(f"{p}.y")))


def nearest_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, p: str = "point") -> DataFrame:
    """``(a_id, b_id, distance)``: the nearest b of every a."""
    return nearest(_with_vec(a, p), _with_vec(b, p), 1, a_id, b_id).drop("rank")


def k_nearest(points: DataFrame, others: DataFrame, id: str, other_id: str, k: int = 100, p: str = "point") -> DataFrame:
    return nearest(_with_vec(points, p), _with_vec(others, p), k, id, other_id)


def k_nearest_mean(points: DataFrame, id: str, k: int = 100, p: str = "point") -> DataFrame:
    """Mean distance from each point to its k nearest points, zero distances (itself, same place) left out."""
    a = points.withColumnRenamed(id, "_a")
    near = k_nearest(a, points, "_a", id, k, p)
    return near.groupBy(F.col("_a").alias(id)).agg(F.avg(F.when(F.col("distance") != 0, F.col("distance"))).alias("mean_distance"))


def _edges(poly: Column) -> Column:
    """Closed ring as pairs of corners."""
    following = F.concat(F.slice(poly, F.lit(2), F.size(poly) - 1), F.slice(poly, 1, 1))
    return F.zip_with(poly, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def inside(poly: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the right."""
    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        at = ax + F.try_divide((bx - ax) * (y - ay), by - ay)
        return F.when(((ay > y) != (by > y)) & (x < at), F.lit(1)).otherwise(F.lit(0))
    return F.aggregate(_edges(poly), F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1


def polygon_area(poly: Column) -> Column:
    """Shoelace formula."""
    twice = F.aggregate(_edges(poly), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(twice) / 2


def points_in_polygons(polygons: DataFrame, points: DataFrame, how: str = "points", poly: str = "polygon", p: str = "point") -> DataFrame:
    """Left spatial join: keep all ``points`` (without polygon: NULL) or all ``polygons``. Overlaps give several rows. The kept
    side is written with row numbers and joined back by these, so equal rows stay as many as they are.

    Grid of several cell sizes: a polygon uses the smallest power of two not below its extent, so it touches at most
    four cells whatever its size; points are placed once per size in use (few). The join is an equality on
    (size, cell), which adaptive execution splits where one cell holds many points.
    """
    def bound(fn, axis: str) -> Column:
        return fn(F.transform(F.col(poly), lambda c: c[axis]))
    numbered = materialise((points if how == "points" else polygons).withColumn("_key", F.monotonically_increasing_id()), "numbered")
    pts, shapes = (numbered, polygons) if how == "points" else (points, numbered)
    g = shapes.withColumns({"_x0": bound(F.array_min, "x"), "_x1": bound(F.array_max, "x"),
                              "_y0": bound(F.array_min, "y"), "_y1": bound(F.array_max, "y")})
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-12))
    g = g.withColumn("_lvl", F.ceil(F.log2(extent)).cast("int"))
    levels = [r[0] for r in g.select("_lvl").distinct().collect()]  # powers of two: at most some hundred

    def cell(c: Column, size: Column) -> Column:
        return F.floor(c / size).cast("long")
    size = F.pow(F.lit(2.0), F.col("_lvl"))
    g = g.withColumn("_ix", F.explode(F.sequence(cell(F.col("_x0"), size), cell(F.col("_x1"), size)))) \
        .withColumn("_iy", F.explode(F.sequence(cell(F.col("_y0"), size), cell(F.col("_y1"), size))))
    pts = pts.withColumn("_lvl", F.explode(F.array(*[F.lit(v) for v in levels])) if levels else F.lit(None).cast("int"))
    pts = pts.withColumns({"_ix": cell(F.col(f"{p}.x"), size), "_iy": cell(F.col(f"{p}.y"), size)})
    hit = pts.join(g, ["_lvl", "_ix", "_iy"]).where(inside(F.col(poly), F.col(f"{p}.x"), F.col(f"{p}.y")))
    keep_g, keep_p = polygons.columns, points.columns
    if how == "points":
        found = hit.select("_key", *keep_g)
        return numbered.join(found, "_key", "left").select(*keep_p, *keep_g)
    found = hit.select("_key", *keep_p)
    return numbered.join(found, "_key", "left").select(*keep_g, *keep_p)
