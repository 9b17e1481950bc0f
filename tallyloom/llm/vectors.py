"""Near-duplicate vectors by NN-descent on a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.network import connected_components
from ..session import materialise
from .common import numbered

BITS = 24          # hyperplanes per sorted table
BLOCK = 64         # longer lists are joined in pairs of blocks
AUDIT = 512        # vectors compared with all others to measure recall


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _start(nodes: DataFrame, tables: int, reach: int) -> DataFrame:
    """Edges between vectors that are close in one of ``tables`` orders by the sides of random hyperplanes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), np.int64)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            flat, at = batch.column(2).flatten().to_numpy(), np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                planes = np.random.default_rng(int(d)).standard_normal((int(d), tables * BITS))
                side = (flat[at[mine][:, None] + np.arange(d)] @ planes > 0).reshape(len(mine), tables, BITS)
                keys[mine] = side @ (1 << np.arange(BITS - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["node", "g", "keys"])

    keyed = nodes.select("node", "g", "unit").mapInArrow(run, "node long, g string, keys array<long>")
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed.join(sizes, "g").select("node", "g", "n", F.posexplode("keys").alias("t", "key"))
    drop = F.greatest(F.lit(0), F.lit(BITS) - F.ceil(F.log2(F.col("n") / 64)).cast("int"))
    keyed = keyed.withColumn("bucket", F.call_function("shiftright", F.col("key"), F.least(drop, F.lit(BITS)).cast("int")))
    order = Window.partitionBy("t", "g", "bucket").orderBy("key", "node")
    near = [F.lead("node", k).over(order).alias(f"n{k}") for k in range(1, reach + 1)]
    pairs = keyed.select("node", *near)
    return pairs.select(F.col("node").alias("src"), F.explode(F.array(*[f"n{k}" for k in range(1, reach + 1)])).alias("dst")).where("dst IS NOT NULL").distinct()


def _local_join(lists: DataFrame) -> DataFrame:
    """``(src, dst, sim)``: pairs of one list, at least one of them new, that are closer than the last place of src's list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0)
            ends = items.offsets.to_numpy() - items.offsets.to_numpy()[0]
            flat = items.flatten()
            u, own, fresh, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            units = _matrix(flat.field(4))
            src, dst, sims = [], [], []
            i_blocks, j_blocks = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b, i, j in zip(ends[:-1], ends[1:], i_blocks, j_blocks, strict=True):
                x = units[a:b]
                s = x @ x.T
                ok = (fresh[a:b, None] | fresh[None, a:b]) & (s > last[a:b, None]) & (u[a:b, None] != u[None, a:b])
                if i != j:
                    ok &= own[a:b, None] != own[None, a:b]
                p, q = np.nonzero(ok)
                src.append(u[a:b][p])
                dst.append(u[a:b][q])
                sims.append(s[p, q])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst)), pa.array(np.concatenate(sims).astype(np.float32))], ["src", "dst", "sim"])
    return lists.mapInArrow(run, "src long, dst long, sim float")


def _similarity(pairs: DataFrame, units: DataFrame) -> DataFrame:
    dot = "aggregate(zip_with(ua, ub, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"
    both = pairs.join(units.select(F.col("node").alias("src"), F.col("unit").alias("ua")), "src").join(units.select(F.col("node").alias("dst"), F.col("unit").alias("ub")), "dst")
    return both.select("src", "dst", F.expr(dot).alias("sim"))


def neighbour_links(nodes: DataFrame, least: float, places: int = 8, tables: int = 8, reach: int = 2, rounds: int = 8, recall: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes of one group with cosine >= ``least``, ``(src, dst)`` in both directions, and ``(node, comp, full)``.

    NN-descent: every node has a list of ``places`` neighbours, at first the closest in some hyperplane orders. In each round
    the neighbours of a node, in both directions, are compared with each other, and lists take what is closer. Only pairs with a new
    member are compared, and a list that is full of links takes no more. Rounds end when few places change; then recall is measured on
    ``AUDIT`` vectors compared with all others, and while it is below ``recall`` all lists are doubled and more rounds follow.

    A list full of links is saturated: the node may have more, in its own component or another. The components with a saturated
    node are marked ``full``; :func:`merge_full` joins those that any link connects, and :func:`count_within` compares these whole.
    Recall that stays below ``recall`` is an error. ``nodes`` is ``(node, g, unit array<double>)``.
    """
    light = materialise(nodes.select("node", "g", F.col("unit").cast("array<float>").alias("unit")), "light")
    first = materialise(_start(nodes, tables, reach), "start")
    both = first.unionByName(first.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = _similarity(both, light).withColumn("sim", F.col("sim").cast("float"))
    best = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    near = least - 1e-4          # single precision is good enough to keep a place; links are decided in double precision

    def lists(edges: DataFrame) -> DataFrame:
        return materialise(edges.withColumn("place", F.row_number().over(best)).where(F.col("place") <= places).drop("place"), "graph")

    graph = lists(found.withColumn("new", F.lit(True)))
    total, done = nodes.count(), 0
    while True:
        for _ in range(rounds):
            last = graph.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("m"))
            last = last.select("node", F.when(F.col("n") < places, F.lit(-2.0)).when(F.col("m") >= near, F.lit(2.0)).otherwise(F.col("m")).cast("float").alias("last"))
            known = light.join(last, "node").select(F.col("node").alias("u"), "last", "unit")
            around = graph.select(F.col("src").alias("v"), F.col("dst").alias("u"), "new").unionByName(graph.select(F.col("dst").alias("v"), F.col("src").alias("u"), "new"))
            around = materialise(around.groupBy("v", "u").agg(F.max("new").alias("new")), "around")
            blocks = around.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.max("new").alias("any")).where("any").drop("any")
            dealt = _in_block_pairs(around.join(blocks, "v"), "u").join(known, "u")
            joined = dealt.groupBy("v", "i", "j").agg(F.collect_list(F.struct("u", "own", "new", "last", "unit")).alias("items"))
            closer = _local_join(joined.select("items", "i", "j")).groupBy("src", "dst").agg(F.max("sim").alias("sim"))
            closer = closer.join(graph.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("new", F.lit(True))
            graph = lists(graph.select("src", "dst", "sim").withColumn("new", F.lit(False)).unionByName(closer))
            done += 1
            if graph.where("new").count() <= 0.02 * places * total:
                break
        pairs = graph.where(F.col("sim") >= near).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        one = _similarity(pairs, nodes).where(F.col("sim") >= least).select("src", "dst")
        linked = materialise(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
        parts = connected_components(linked, "src", "dst").select("node", F.col("component").alias("comp"))
        crowded = graph.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("m")).where((F.col("n") >= places) & (F.col("m") >= near))
        parts = parts.join(crowded.select("node", F.lit(True).alias("crowded")), "node", "left")
        parts = materialise(parts, "parts")
        full = parts.groupBy("comp").agg(F.coalesce(F.max("crowded"), F.lit(False)).alias("full"))
        parts = merge_full(nodes, materialise(parts.select("node", "comp").join(full, "comp"), "parts"), least)
        reached = audit(nodes, linked, parts, least)
        if reached >= recall:
            return linked, parts
        if done >= 4 * rounds:
            raise RuntimeError(f"{reached:.3f} of the links of {AUDIT} vectors found after {done} rounds, less than {recall}")
        places *= 2
        graph = graph.withColumn("new", F.lit(True))


def _in_block_pairs(df: DataFrame, key: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in; a group's pairs are then those within (i, j)."""
    df = df.withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return df.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def merge_full(nodes: DataFrame, parts: DataFrame, least: float, block: int = 128, centres: int = 1024) -> DataFrame:
    """``parts`` with full components that any link connects as one.

    The nodes of full components are dealt to balls of about ``block``, each in one component. By the triangle inequality two balls can
    hold a link only if the angle of their centres is at most both radii and the angle of ``least``; the centres of a group are compared
    in pairs of blocks, and balls that pass are compared whole. Nothing is left out, so one pass finds every such pair of components.
    """
    full = parts.where("full").join(nodes, "node")
    sizes = materialise(parts.where("full").groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "sizes")
    balls = full.join(sizes, "comp").groupBy("g", "comp", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))
    balls = materialise(balls.agg(F.min("node").alias("ball"), F.collect_list("unit").alias("units")).drop("own"), "balls")
    widest = float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-4         # rounding must not lose a pair

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            middle, radius = [], []
            for row in range(batch.num_rows):
                x = _matrix(batch.column(3).slice(row, 1).flatten())
                m = x.sum(0)
                m = m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-9 else x[0]
                middle.append(m)
                radius.append(float(np.arccos(np.clip((x @ m).min(), -1, 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(middle, pa.list_(pa.float64())), pa.array(radius, pa.float64())], ["g", "comp", "ball", "centre", "radius"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                items = batch.column(0).slice(row, 1).flatten()
                ball, comp, own, radius = (items.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                x = _matrix(items.field(4))
                ok = np.arccos(np.clip(x @ x.T, -1, 1)) <= radius[:, None] + radius[None, :] + widest
                ok &= (comp[:, None] != comp[None, :]) & (ball[:, None] < ball[None, :])
                if batch.column(1)[row].as_py():
                    ok &= own[:, None] != own[None, :]
                a, b = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ball[a]), pa.array(ball[b])], ["a", "b"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [bool((_matrix(batch.column(2).slice(row, 1).flatten()) @ _matrix(batch.column(3).slice(row, 1).flatten()).T >= least).any()) for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit, pa.bool_())) for c in batch.columns[:2]], ["src", "dst"])

    centred = materialise(balls.mapInArrow(centre, "g string, comp long, ball long, centre array<double>, radius double"), "centres")
    per_group = materialise(centred.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / centres).alias("blocks")), "sizes")
    dealt = _in_block_pairs(centred.join(per_group, "g"), "ball").groupBy("g", "i", "j").agg(F.collect_list(F.struct("ball", "comp", "own", "radius", "centre")).alias("items"))
    pairs = materialise(dealt.select("items", F.col("i") != F.col("j")).mapInArrow(close, "a long, b long"), "near_balls")
    one, two = balls.select(F.col("ball").alias("a"), F.col("comp").alias("src"), F.col("units").alias("x")), balls.select(F.col("ball").alias("b"), F.col("comp").alias("dst"), F.col("units").alias("y"))
    links = materialise(pairs.join(one, "a").join(two, "b").select("src", "dst", "x", "y").mapInArrow(linked, "src long, dst long").distinct(), "between")
    if links.isEmpty():
        return parts
    merged = connected_components(links, "src", "dst").select(F.col("node").alias("comp"), "component")
    return materialise(parts.join(merged, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp"), "full"), "parts")


def count_within(nodes: DataFrame, parts: DataFrame, least: float, block: int = 128) -> DataFrame:
    """``(node, linked)``: other vectors linked to each node of a full component; whole components are compared in pairs of blocks."""
    full = parts.where("full").join(nodes, "node")
    sizes = materialise(parts.where("full").groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "sizes")
    dealt = _in_block_pairs(full.join(sizes, "comp"), "node").groupBy("comp", "i", "j").agg(F.collect_list(F.struct("node", "own", "copies", "unit")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                items = batch.column(0).slice(row, 1).flatten()
                node, own, copies = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                x = _matrix(items.field(3))
                hit = x @ x.T >= least
                np.fill_diagonal(hit, False)
                if batch.column(1)[row].as_py():
                    hit &= own[:, None] != own[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(hit @ copies)], ["node", "linked"])

    dealt = dealt.select("items", F.col("i") != F.col("j"))
    return dealt.mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def audit(nodes: DataFrame, linked: DataFrame, parts: DataFrame, least: float) -> float:
    """Share of the links of AUDIT vectors (chosen by hash) that were found, against all vectors of their groups."""
    asked = nodes.orderBy(F.xxhash64("node")).limit(AUDIT).collect()           # a fixed number of vectors
    if not asked:
        return 1.0
    by_group: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["g"] for r in asked}:
        mine = [r for r in asked if r["g"] == g]
        by_group[g] = (np.array([r["node"] for r in mine]), np.array([r["unit"] for r in mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), object)
            ids = batch.column(0).to_numpy()
            for g, (who, units) in by_group.items():
                mine = np.flatnonzero(groups == g)
                if len(mine):
                    i, j = np.nonzero(units @ _matrix(batch.column(2).take(pa.array(mine))).T >= least)
                    other = who[i] != ids[mine[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(who[i][other]), pa.array(ids[mine[j]][other])], ["src", "dst"])
    true = materialise(nodes.select("node", "g", "unit").mapInArrow(run, "src long, dst long"), "audit")
    n = true.count()
    whole = parts.where("full").select("node", "comp")
    within = true.join(whole.toDF("src", "c"), "src").join(whole.toDF("dst", "d"), "dst").where("c = d").select("src", "dst")
    return true.join(linked.unionByName(within).distinct(), ["src", "dst"], "left_semi").count() / n if n else 1.0


def embedding_dedup(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, _row)`` for every row of ``vectors``.

    Vectors of one label and length are linked when their cosine in double precision is at least ``least``. Equal
    vectors are one node of the graph and linked with each other; see :func:`neighbour_links` for the others.
    A vector that is null, empty or zero, or holds nulls or non-finite numbers, and one without a label, is linked with nothing. Repeated rows
    are vectors of their own, equal to each other. A null id names a component only where no other id is in it. An empty
    table gives an empty result; other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = numbered(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v")), "_row")
    norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    rows = rows.withColumn("norm", norm).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = materialise(rows.select("vec_id", "_row", F.when(F.col("usable"), F.concat_ws("/", "label", F.size("v").cast("string"))).alias("g"),
                                   F.when(F.col("usable"), F.transform("v", lambda x: x / F.col("norm"))).alias("unit")), "units")
    nodes = materialise(rows.where("g IS NOT NULL").groupBy("g", "unit").agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    linked, parts = neighbour_links(nodes.select("node", "g", "unit"), least, **options)
    weight = linked.join(nodes.select(F.col("node").alias("dst"), "copies"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("copies").alias("linked"))
    weight = weight.join(parts.where("full"), "node", "left_anti").unionByName(count_within(nodes, parts, least))
    named = nodes.join(weight, "node", "left").join(parts.select("node", "comp"), "node", "left").select(
        "g", "unit", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    members = rows.join(named, ["g", "unit"], "left").select("vec_id", "_row", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("comp", "_row").alias("comp"))
    members = materialise(members, "members")
    smallest = members.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    return members.join(smallest, "comp").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "_row")
