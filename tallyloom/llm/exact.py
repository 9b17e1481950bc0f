"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, shuffle_width
from .common import fixed, fresh, located, lower_ascii, text_or_empty

RADIX_BITS = 4  # each merge takes the runs of 2^4 partitions, by one hex digit of the digest


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, _row, _part, digest, n_bytes, check)``: one written row per document, read from the text once."""
    norm = located(fixed(docs), "_row", F.col(id_col).alias("doc_id"), F.spark_partition_id().alias("_part"), lower_ascii(text_or_empty(text_col)).alias("_t"))
    return materialise(norm.select("doc_id", "_row", "_part", F.sha2("_t", 256).alias("digest"), F.octet_length("_t").alias("n_bytes"),
                                   F.xxhash64("_t").alias("check")), "digests")


def merge_runs(rows: DataFrame, keep: str = "largest") -> DataFrame:
    """``(digest, n_bytes, check, keep_id, keep_row, group_size)``: one row per distinct text.

    Every input partition starts with one run: its distinct digests in order, each with the id that stays and a count.
    In each round the runs of 16 partitions meet: a partition gives away the parts of its run by one hex digit of the
    digest and merges what it gets, so after log16(partitions) rounds every partition holds one sorted range
    of all digests. Copies melt at every level: a digest reaches a merge at most 16 times, however many copies it has.
    Two digests count as equal only when SHA-256, length and a second hash all agree.
    """
    pick = {"largest": F.max, "smallest": F.min}[keep]
    key = ["digest", "n_bytes", "check"]
    parts = rows.agg(F.coalesce(F.max("_part"), F.lit(0))).first()[0] + 1
    rounds = max(1, -(-(parts - 1).bit_length() // RADIX_BITS))
    width = shuffle_width(rows.sparkSession)
    runs = rows.groupBy(F.col("_part").cast("long").alias("slot"), *key).agg(pick(F.struct("doc_id", "_row")).alias("stay"), F.count(F.lit(1)).alias("group_size"))
    for r in range(rounds):
        digit = F.conv(F.substring("digest", r + 1, 1), 16, 10).cast("long")
        low = RADIX_BITS * r
        moved = f"slot - shiftleft(shiftright(slot, {low}) & 15, {low})"
        runs = runs.withColumn("slot", F.expr(moved) + F.shiftleft(digit, low)).repartition(width, "slot")
        runs = runs.sortWithinPartitions("slot", *key).groupBy("slot", *key).agg(pick("stay").alias("stay"), F.sum("group_size").alias("group_size"))
    return runs.select(*key, F.col("stay.doc_id").alias("keep_id"), F.col("stay._row").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, _row)`` for every row of ``docs``.

    Texts are equal when they are after lower-casing A-Z; null counts as empty, so all null and empty texts are one
    group. Of equal texts the row with the largest (or smallest) id stays; among rows that share that id, too, the last
    (first) in order of files, so exactly one row of a group is kept. A null id is smaller than any other. An empty
    table gives an empty result. ``_row`` is a row's place in its files; other columns are not read.
    """
    rows = digests(docs, id_col, text_col)
    groups = merge_runs(rows, keep)
    key = ["digest", "n_bytes", "check"]
    return rows.join(groups, key).select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"),
                                         F.col("digest").alias("text_sha256"), "_row")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    docs = fixed(docs)
    row = fresh(docs, "_row")
    stay = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col("_row").alias(row))
    return located(docs, row).join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
