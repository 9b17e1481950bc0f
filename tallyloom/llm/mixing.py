"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, fixed, fresh, located, text_or_empty, unit_hash

SLICES = 4096  # slices of the rank scale; a window never holds more than one slice of a source


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn. Together the targets are ``share`` of all sizes,
    in proportion to weight; a target stops at ``most`` times its source and the excess goes to the others by weight.
    In order of cap/weight, capping the first j sources leaves the level (total - caps) / (other weights); the level
    rises as long as the next source has to be capped too, so the final level is the largest of these.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", turn).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("capped")) / (F.sum("w").over(everything) - F.col("used"))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text", odds_col: str | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken, _row)`` for every row of ``docs``.

    A source with target t and size s is taken t/s times: floor(t/s) certain whole copies of every document, and for
    what remains a Pareto sample. Document i has inclusion probability p = remainder/s and a uniform number u from the
    md5 of its id; documents are ranked by the odds of u divided by the odds of p, and the smallest are taken until
    the next one no longer fits in the words that remain. Then one more document is added, the one whose size comes
    nearest to the gap, if that brings the source nearer to its target. ``odds_col`` (positive) multiplies the
    inclusion odds of single documents.

    The cut is found by words per slice of the rank scale, so no window holds more than a 4096th of a source.
    Null text has size 0; null is a source of its own, the last; a null id hashes as an empty one; rows that
    share an id are ranked by their place in the files. A source without words has target 0, and its documents are not taken;
    so is a table without words. Other columns are not read.
    """
    extra = [F.col(odds_col).cast("double").alias("_w")] if odds_col else [F.lit(1.0).alias("_w")]
    rows = located(fixed(docs), "_row", F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                   F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), *extra)
    rows = materialise(rows, "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialise(targets.withColumnRenamed("source", "_s"), "targets")
    u = unit_hash(F.col("doc_id"))
    p = F.try_divide("rest", "source_size")
    t = rows.join(targets, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_u", (u / (1 - u)) / F.coalesce(F.col("_w"), F.lit(1.0)))
    t = t.withColumn("rank", F.when((p > 0) & (p < 1), F.col("_u") / (p / (1 - p)))) \
        .withColumn("slice", F.floor(F.lit(SLICES) * (F.col("_u") / (1 + F.col("_u"))))).drop("_s", "_u", "_w")
    ranked = materialise(t, "ranked")
    slices = ranked.where("rank IS NOT NULL").groupBy("source", "slice", "rest").agg(F.sum("size").alias("words"))
    through = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    slices = slices.withColumn("before", through - F.col("words")).withColumn("after", through)
    slices = materialise(slices.select(F.col("source").alias("_s"), F.col("slice").alias("_k"), "before", "after"), "slices")
    near = [F.col("source").eqNullSafe(F.col("_s")), F.col("slice") == F.col("_k")]
    cut = ranked.where("rank IS NOT NULL").join(slices, near).drop("_s", "_k")
    full = cut.where("after <= rest").select("_row", "source", "size", "rank", "doc_id", "rest", F.lit(True).alias("chosen"), F.lit(0).cast("long").alias("got"))
    order = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "_row")
    open_ = cut.where("before < rest AND after > rest").withColumn("got", F.col("before") + F.sum("size").over(order))
    open_ = open_.select("_row", "source", "size", "rank", "doc_id", "rest", (F.col("got") <= F.col("rest")).alias("chosen"), F.when(F.col("got") <= F.col("rest"), F.col("got")).otherwise(0).alias("got"))
    later = cut.where("before >= rest AND after > rest").select("_row", "source", "size", "rank", "doc_id", "rest", F.lit(False).alias("chosen"), F.lit(0).cast("long").alias("got"))
    state = materialise(full.unionByName(open_).unionByName(later), "chosen")
    gaps = state.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0))).alias("gap"))
    gaps = materialise(gaps.withColumnRenamed("source", "_s"), "gaps")
    off = F.abs(F.col("gap") - F.col("size"))
    last = state.where("NOT chosen").join(gaps, F.col("source").eqNullSafe(F.col("_s"))).where(off < F.col("gap")) \
        .groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "_row")).alias("b")).select("b._row")
    taken = state.where("chosen").select("_row").unionByName(last).withColumn("_in", F.lit(1))
    out = ranked.join(taken, "_row", "left").withColumn("copies", F.col("whole") + F.coalesce(F.col("_in"), F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"),
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"), "_row")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (dropped where it takes none)."""
    docs = fixed(docs)
    row = fresh(docs, "_row")
    mix = mix_sources(docs, **options).where("copies > 0").select(F.col("_row").alias(row), F.col("copies").alias(fresh(docs, "_copies")))
    copies = mix.columns[1]
    out = located(docs, row).join(mix, row).withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
