"""A Merkle manifest of a dataset, with a proof for every row, by a butterfly exchange of subtree roots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import sliced
from ..session import materialise
from .common import fixed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
BLOCK_LEVELS = 3      # levels below the exchange: a block is an aligned range of fanout^3 leaves


def encoded(value: Column) -> Column:
    """A value so that different rows never give the same bytes: ``-`` if null, otherwise its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


def _positions(rows: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at`` (from 0, in ``order`` within ``key``), and ``(key, n)``. A key of any size: rows are dealt by ranges, numbered
    in their slice and moved up by what the slices before hold, one number per slice and key."""
    rows = sliced(rows, [key], order)
    counts = materialise(rows.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("n")), "counts")
    by = Window.partitionBy(key).orderBy("_slice")
    before = counts.select(key, "_slice", (F.sum("n").over(by) - F.col("n")).alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order)) - 1
    return rows.join(before, [key, "_slice"]).withColumn("at", at).drop("before", "_slice"), counts.groupBy(key).agg(F.sum("n").alias("n"))


def butterfly(nodes: DataFrame, fanout: int) -> DataFrame:
    """``(g, at, node, path)`` from ``(g, at, n, node)``: the root over a group's ``n`` nodes (numbered from 0) and every node's proof up to it.

    In round r the nodes whose numbers differ only in digit r (to the base ``fanout``) swap the roots of their level-r subtrees, and
    each of them hashes the parent itself. All hold the root after log(n) rounds, and nothing has to be sent down again.
    A last subtree that is not full has fewer nodes than the others need partners: its nodes answer for
    the missing ones too, in turn, so a round never has more than twice ``n`` messages. A message's group has at most ``fanout`` members.
    """
    state = nodes.select("g", "at", "n", "node", F.array().cast(PROOF).alias("path"))
    most = state.agg(F.max("n")).first()[0] or 0
    step = 1
    while step < most:
        own, low = F.floor(F.col("at") / step), F.col("at") % step
        size = F.least(F.lit(step), F.col("n") - F.col("own") * step)                         # nodes of the own subtree
        rows = state.where(F.col("n") > step).withColumn("own", own).withColumn("low", low).withColumn("digit", F.col("own") % fanout)
        lows = F.when(F.col("digit") > 0, F.sequence(F.col("low"), F.lit(step - 1).cast("long"), size)).otherwise(F.array("low"))
        sent = rows.withColumn("to", F.explode(lows)).withColumn("mine", F.when(F.col("to") == F.col("low"), F.struct("at", "path")))
        swapped = sent.groupBy("g", "n", F.floor(F.col("own") / fanout).alias("parent"), "to").agg(F.collect_list(F.struct("digit", "node", "mine")).alias("m"))
        swapped = swapped.select("g", "n", F.array_sort("m", lambda a, b: (a["digit"] - b["digit"]).cast("int")).alias("m"))

        def joined(keep) -> Column:
            return F.array_join(F.transform(F.filter("m", keep), lambda x: x["node"]), "")

        parent = F.sha2(joined(lambda x: F.lit(True)).cast("binary"), 256)
        got = swapped.select("g", "n", "m", parent.alias("node"), F.explode(F.filter("m", lambda x: x["mine"].isNotNull())).alias("me"))
        sides = F.struct(joined(lambda x: x["digit"] < F.col("me.digit")).alias("left"), joined(lambda x: x["digit"] > F.col("me.digit")).alias("right"))
        got = got.select("g", F.col("me.mine.at").alias("at"), "n", "node", F.concat("me.mine.path", F.array(sides)).alias("path"))
        state = materialise(got.unionByName(state.where(F.col("n") <= step)), "round")
        step *= fanout
    return state.select("g", "at", "node", "path")


def _levels(nodes: list[str], fanout: int, alone: bool) -> Iterator[list[str]]:
    """The levels of a block below its root, then the root: ``BLOCK_LEVELS`` of them, or fewer where the block is a whole tree."""
    for _ in range(BLOCK_LEVELS):
        if alone and len(nodes) == 1:
            break
        yield nodes
        nodes = [hashlib.sha256("".join(nodes[i:i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
    yield nodes


def _block_roots(blocks: DataFrame, fanout: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [[*_levels(leaves, fanout, n == 1)][-1][0] for leaves, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.string())], ["g", "at", "n", "node"])
    return blocks.select("g", "at", "n", F.col("items._leaf").alias("leaves")).mapInArrow(run, "g string, at long, n long, node string")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 8, carry: dict[str, Column] | None = None) -> DataFrame:
    """``(id, group, leaf, proof, subroot, root, *carry)``: a leaf for every row, its proof, the root of its group and that of the dataset.

    A leaf hashes all ``fields`` of a row. Within a group leaves ascend by id; every ``fanout`` consecutive nodes become their hash until
    one is left, and the groups' roots, in order of the group, likewise give the root. ``proof`` has the siblings of each level
    from the leaf to the root, those to the left and those to the right: :func:`fold` goes up from any leaf.

    Leaves are numbered over a range partitioning and dealt in aligned blocks of ``fanout``^3. A block is hashed by one task; above the
    blocks, their roots are exchanged as in :func:`butterfly`, so no task ever holds more than a block or ``fanout`` nodes, and a group that
    has most of the rows is as many blocks as it needs.

    Null values, null ids (first) and a null group (first) are values like others. Rows that share an id are in order of their leaves;
    repeated rows are leaves of their own, with proofs that differ by place only. Texts of any length are hashed whole and not moved. An
    empty table gives an empty result. ``carry``: more columns to compute from ``docs`` and hand through.
    """
    docs, carry = fixed(docs), carry or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))                  # null before all others, then by bytes
    leaves = docs.select(group.alias("g"), F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), leaf_hash(*[F.col(f) for f in fields]).alias("_leaf"),
                         F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("_carry"))
    rows, sizes = _positions(leaves, "g", ["_id", "_leaf"])
    wide = fanout ** BLOCK_LEVELS
    blocks = rows.groupBy("g", F.floor(F.col("at") / wide).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("at", "_id", "_group", "_leaf", "_carry"))).alias("items"))
    blocks = blocks.join(sizes, "g").select("g", F.col("_block").alias("at"), F.ceil(F.col("n") / wide).alias("n"), "items")
    blocks = materialise(blocks, "blocks")
    lower = materialise(butterfly(_block_roots(blocks, fanout), fanout), "lower")

    roots = lower.where("at = 0").select("g", F.col("node").alias("subroot"))
    top, number = _positions(roots.withColumn("_all", F.lit("")), "_all", ["g"])
    top = materialise(top.join(number, "_all").select("g", "at", "n", "subroot"), "subroots")
    upper = butterfly(top.select(F.lit("").alias("g"), "at", "n", F.col("subroot").alias("node")), fanout)
    upper = upper.select("at", F.col("node").alias("root"), F.col("path").alias("above")).join(top.select("at", F.col("g").alias("_g"), "subroot"), "at").drop("at")
    paths = lower.select("g", "at", "path").join(materialise(upper, "upper"), F.col("g") == F.col("_g")).select("g", "at", F.concat("path", "above").alias("path"), "subroot", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for i, (n, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                items = batch.column(1).slice(i, 1).flatten()
                leaf = items.field("_leaf")
                levels = [*_levels(leaf.to_pylist(), fanout, n == 1)][:-1]
                proofs = []
                for k in range(len(leaf)):
                    proof, at = [], k
                    for level in levels:
                        first = at - at % fanout
                        proof.append({"left": "".join(level[first:at]), "right": "".join(level[at + 1:first + fanout])})
                        at //= fanout
                    proofs.append(proof + path)
                same = pa.array([0] * len(leaf), pa.int32())
                yield pa.RecordBatch.from_arrays([items.field("_id"), items.field("_group"), leaf, items.field("_carry"), pa.array(proofs, kind),
                                                  batch.column(3).slice(i, 1).take(same), batch.column(4).slice(i, 1).take(same)], names)

    names = ["_id", "_group", "_leaf", "_carry", "proof", "subroot", "root"]
    kinds = [leaves.schema[c].dataType.simpleString() for c in names[:4]]
    full = blocks.join(paths, ["g", "at"]).select("n", "items", "path", "subroot", "root")
    out = full.mapInArrow(run, f"{', '.join(f'{c} {k}' for c, k in zip(names[:4], kinds, strict=True))}, proof {PROOF}, subroot string, root string")
    return out.select(F.col("_id").alias(id_col), F.col("_group").alias(group_col), F.col("_leaf").alias("leaf"), "proof", "subroot", "root",
                      *[F.col(f"_carry.{k}").alias(k) for k in carry])
