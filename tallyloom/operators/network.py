"""Road network: directed edges, components, cheapest routes. What a round finds is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .grouping import first_rows


def orient_edges(df: DataFrame, source: str = "source", target: str = "target", oneway: str = "oneway",
                 fw: str = "drivetime_fw", bw: str = "drivetime_bw") -> DataFrame:
    """``(src, dst, weight)``: FT as drawn, TF turned round, B both ways; negative weights dropped."""
    there = F.struct(F.col(source).alias("src"), F.col(target).alias("dst"), F.col(fw).cast("double").alias("weight"))
    back = F.struct(F.col(target).alias("src"), F.col(source).alias("dst"), F.col(bw).cast("double").alias("weight"))
    both = F.when(F.col(oneway) == "FT", F.array(there)).when(F.col(oneway) == "TF", F.array(back)) \
        .when(F.col(oneway) == "B", F.array(there, back))
    return df.select(F.inline(both)).where(F.col("weight") >= 0)


def component_stars(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` of every node but the smallest of its component, which names it.

    Alternating star contraction (each node's larger neighbours, then its smaller ones, are hung on the smallest
    node around), which needs about log^2 rounds, not as many rounds as the longest path. A round is two jobs, each a partial minimum
    per node joined back to the edges, which adaptive execution splits where a node has many; the last check of a round is
    counted while its edges are written.
    """
    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        return out, tuple(seen.get.values())

    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e, before = settle(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = settle(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component, size, largest)``; the component is named by its smallest node."""
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(dst)).where("node IS NOT NULL").distinct()
    out = materialise(nodes.join(component_stars(edges, src, dst), "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size"), "component").limit(1).select("component").scalar()
    return out.join(sizes, "component").select("node", "component", "size", (F.col("component") == top).alias("largest"))


DIGITS = 9      # costs are sums rounded to this many digits, so that paths of equal cost are equal in whatever order they were summed


class Labels:
    """Labels ``(origin, node, cost, hops)`` in an append-only table: every round adds the labels it improved and rewrites nothing."""

    def __init__(self, first: DataFrame):
        self.spark, self.path, self.schema, self.rounds = first.sparkSession, scratch_path(first.sparkSession, "labels"), first.schema, 0
        self.add(first, 0.0)

    def add(self, rows: DataFrame, high: float) -> tuple[DataFrame, int]:
        """Write a round's rows; they, read back, and how many cost less than ``high``."""
        seen, path = Observation(), f"{self.path}/{self.rounds}"
        rows.observe(seen, F.count_if(F.col("cost") < high).alias("n")).write.parquet(path)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(path), seen.get["n"]

    def all(self) -> DataFrame:
        """Every label so far, also those that were improved on."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{i}" for i in range(self.rounds)])

    def best(self) -> DataFrame:
        return self.all().groupBy("origin", "node").agg(F.min(F.struct("cost", "hops")).alias("_b")).select("origin", "node", "_b.cost", "_b.hops")


def _better(cand: DataFrame, labels: Labels) -> DataFrame:
    """Candidates that no label of the same origin and node equals or beats."""
    old = labels.all().select(F.col("origin").alias("_o"), F.col("node").alias("_n"), F.struct("cost", "hops").alias("_l"))
    at = (F.col("origin") == F.col("_o")) & (F.col("node") == F.col("_n"))
    return cand.join(old, at & (F.col("_l") <= F.struct("cost", "hops")), "left_anti")


def _nearest_only(keep: int):
    """Candidates as of :func:`_better` that are also among the ``keep`` best origins of their node."""
    def better(cand: DataFrame, labels: Labels) -> DataFrame:
        top = first_rows(labels.best(), ["node"], ["cost", "origin"], keep).groupBy("node").agg(F.collect_list(F.struct("cost", "origin")).alias("_top"))
        here = F.struct("cost", "origin")
        ahead = F.filter("_top", lambda x: (x["origin"] != F.col("origin")) & (x < here))
        known = F.exists("_top", lambda x: (x["origin"] == F.col("origin")) & (x <= here))
        # Candidates of one node are many only where it has many neighbours: they are cut to the best of each round first.
        cand = first_rows(cand, ["node"], ["cost", "origin"], keep)
        return cand.join(top, "node", "left").where(F.col("_top").isNull() | (~known & (F.size(ahead) < keep))).drop("_top")
    return better


def _cheapest(edges: DataFrame, origins: DataFrame, src: str, dst: str, weight: str, delta: float | None = None, better=_better) -> tuple[Labels, DataFrame]:
    """Labels of every node reached from every origin, least cost first and of equal costs fewest edges; and the edges.

    Delta-stepping: nodes are settled in buckets of cost. Within a bucket the light edges (up to ``delta``, by default four times
    the largest weight: few rounds, for some labels that are improved on) are followed until nothing in it improves; then the heavy ones once, from nodes that are final by then. A round's
    candidates are reduced to one per (origin, node) before they are compared with the labels, and only improvements are written.
    """
    e = materialise(edges.groupBy(F.col(src).alias("node"), F.col(dst).alias("next")).agg(F.min(weight).cast("double").alias("w")), "edges")
    node = e.schema["node"].dataType
    start = origins.select(F.col(origins.columns[0]).cast(node).alias("origin")).where("origin IS NOT NULL").distinct()
    labels = Labels(start.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops")))
    longest = e.agg(F.max("w")).first()[0] or 0.0
    delta = delta or 4 * longest or 1.0
    light, heavy = e.where(F.col("w") <= delta), e.where(F.col("w") > delta)

    def follow(front: DataFrame, along: DataFrame, high: float) -> tuple[DataFrame, int]:
        cost = F.round(F.col("cost") + F.col("w"), DIGITS)
        cand = front.join(along, "node").groupBy("origin", F.col("next").alias("node")).agg(F.min(F.struct(cost.alias("cost"), (F.col("hops") + 1).alias("hops"))).alias("_b"))
        return labels.add(better(cand.select("origin", "node", "_b.cost", "_b.hops"), labels), high)

    low = 0.0
    while low is not None:
        high = low + delta
        bucket = (F.col("cost") >= low) & (F.col("cost") < high)
        found, more = follow(labels.best().where(bucket), light, high)
        while more:
            found, more = follow(found.where(bucket), light, high)
        if longest > delta:
            follow(labels.best().where(bucket), heavy, high)
        low = labels.best().where(F.col("cost") >= high).agg(F.min("cost")).first()[0]
    return labels, e


def od_costs(edges: DataFrame, origins: DataFrame, dests: DataFrame, src: str = "src", dst: str = "dst",
             weight: str = "weight") -> DataFrame:
    """``(origin, dest, cost)``: cheapest travel cost; unreachable pairs are absent."""
    labels, _ = _cheapest(edges, origins, src, dst, weight)
    wanted = dests.select(F.col(dests.columns[0]).alias("node")).distinct()
    return materialise(labels.best(), "costs").join(wanted, "node").select("origin", F.col("node").alias("dest"), "cost")


def nearest_destination(edges: DataFrame, origins: DataFrame, dests: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """``(origin, dest, cost)``: the cheapest destination of each origin, itself left out; equal costs go to the smallest destination.

    One search from all destinations at once, along the edges turned round. A node keeps its two best destinations only (the
    second for a node that is a destination itself), so the labels grow with the nodes, not with nodes x destinations.
    """
    turned = edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"), F.col(weight).alias("weight"))
    labels, _ = _cheapest(turned, dests, "src", "dst", "weight", better=_nearest_only(2))
    wanted = origins.select(F.col(origins.columns[0]).alias("node")).distinct()
    found = materialise(labels.best(), "costs").join(wanted, "node").select(F.col("node").alias("origin"), F.col("origin").alias("dest"), "cost")
    return nearest_dest(found)


def nearest_dest(costs: DataFrame) -> DataFrame:
    """Cheapest destination per origin (itself left out)."""
    return first_rows(costs.where("origin <> dest"), ["origin"], ["cost", "dest"])


def route_frequencies(edges: DataFrame, origins: DataFrame, dests: DataFrame, src: str = "src", dst: str = "dst",
                      weight: str = "weight") -> DataFrame:
    """``(src, dst, routes)``: how many cheapest routes use each edge, one route for each pair of an origin and another destination.

    Of the cheapest routes to a node the one with fewest edges is taken, and of these the one that comes by the smallest node, so the routes
    of an origin are a tree. Counts are pushed up the trees, the nodes with most edges first: when a node's turn comes, all that goes
    through it is known, and it hands its count to its predecessor once. Every round appends to one written table.
    """
    labels, e = _cheapest(edges, origins, src, dst, weight)
    state = materialise(labels.best(), "state")
    before = state.select("origin", F.col("node").alias("pred"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    tight = (F.round(F.col("_c") + F.col("w"), DIGITS) == F.col("cost")) & (F.col("_h") + 1 == F.col("hops"))
    steps = before.join(e.withColumnRenamed("node", "pred"), "pred").join(state.withColumnRenamed("node", "next"), ["origin", "next"]).where(tight)
    tree = materialise(steps.groupBy("origin", F.col("next").alias("node"), "hops").agg(F.min("pred").alias("pred")), "tree")
    wanted = dests.select(F.col(dests.columns[0]).alias("node")).distinct().withColumn("_own", F.lit(1).cast("long"))
    tree = materialise(tree.join(wanted, "node", "left").withColumn("_own", F.coalesce("_own", F.lit(0).cast("long"))), "tree")
    passed = None
    used = scratch_path(e.sparkSession, "used")
    for hops in range(tree.agg(F.coalesce(F.max("hops"), F.lit(0))).first()[0], 0, -1):
        level = tree.where(F.col("hops") == hops)
        if passed is not None:
            level = level.join(passed, ["origin", "node"], "left").withColumn("_own", F.col("_own") + F.coalesce("_n", F.lit(0))).drop("_n")
        level = materialise(level.where("_own > 0").select("origin", "node", "pred", F.col("_own").alias("n")), "level")
        level.select("pred", "node", "n").write.mode("append").parquet(used)
        passed = level.groupBy("origin", F.col("pred").alias("node")).agg(F.sum("n").alias("_n"))
    if passed is None:
        return e.where("false").select(F.col("node").alias("src"), F.col("next").alias("dst"), F.lit(0).cast("long").alias("routes"))
    return e.sparkSession.read.parquet(used).groupBy(F.col("pred").alias("src"), F.col("node").alias("dst")).agg(F.sum("n").alias("routes"))
