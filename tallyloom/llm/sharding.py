"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import fixed, fresh, located

#: Bits of the key: the first ones come from the md5 of the id, the last ones tell rows of one id apart.
ID_BITS, ROW_BITS = 48, 15
BITS = ID_BITS + ROW_BITS
MEBIBYTE = 1 << 20


def extendible_shards(docs: DataFrame, limit_bytes: int = MEBIBYTE, id_col: str = "doc_id", text_col: str = "text", slack_bits: int = 4) -> DataFrame:
    """``(doc_id, n_bytes, depth, prefix, shard_id, shard_bytes, shard_docs, fits, _row)`` for every row.

    A shard is a bucket of extendible hashing: the rows whose hash begins with ``prefix`` (``depth`` bits). A bucket
    over ``limit_bytes`` is split on one more bit, any other stays, so a row's shard is its shortest prefix that fits.
    The directory is computed bottom-up: bytes are summed once for prefixes of about ``slack_bits`` more bits than the
    number of shards needs, the sums of shorter prefixes follow from these, and only what is still over the limit there
    goes on to further bits. ``shard_id`` is the prefix behind a leading 1 bit, unique over all depths.

    Null text has 0 bytes; a null id hashes as an empty one. Rows that share an id (repeated rows too) are separated by
    the last bits of the key. One row over the limit cannot be split: it is alone in its shard, and ``fits`` is false.
    An empty table gives an empty result. Other columns are not read.
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, ID_BITS // 4), 16, 10).cast("long")
    rows = located(fixed(docs), "_row", F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                   key.alias("_id"))
    rows = materialise(rows.select("_row", "doc_id", "n_bytes", (F.shiftleft("_id", ROW_BITS) + F.pmod(F.xxhash64("_row"), F.lit(1 << ROW_BITS))).alias("_key")), "sized")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(BITS, math.ceil(math.log2(max(1, total / limit_bytes))) + slack_bits)
    left, found = rows, None
    while True:
        leaf = f"shiftright(_key, {BITS - high})"
        leaves = materialise(left.groupBy(F.expr(leaf).alias("_leaf")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "leaves")
        sums = leaves.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")) \
            .select("_leaf", "depth", F.expr(f"shiftright(_leaf, {high} - depth)").alias("prefix"), "b", "n")
        fit = sums.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")) \
            .where((F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS))
        owner = sums.join(fit, ["depth", "prefix"]).groupBy("_leaf").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        owner = materialise(owner.select("_leaf", "s.*"), "directory")
        out = left.withColumn("_leaf", F.expr(leaf)).join(owner, "_leaf")
        found = out if found is None else found.unionByName(out)
        over = leaves.join(owner, "_leaf", "left_anti").select("_leaf")
        if high == BITS or over.isEmpty():
            break
        left = materialise(left.withColumn("_leaf", F.expr(leaf)).join(over, "_leaf", "left_semi").drop("_leaf"), "oversized")
        low, high = high + 1, min(BITS, high + 8)
    shard = F.expr("shiftleft(1L, cast(depth AS INT)) + prefix").alias("shard_id")
    return found.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", shard, "shard_bytes", "shard_docs",
                        (F.col("shard_bytes") <= limit_bytes).alias("fits"), "_row")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one Parquet folder per shard; a shard's rows meet in one task, at most ``limit_bytes`` of text.

    ``shards`` is :func:`extendible_shards` of the same ``docs``. Rows are joined by their number, so rows that share an id
    or have none are each written once, to their own shard. Where ``docs`` may give its rows in another order on
    another pass, use :func:`shard`. Every row's id and size are compared with those of its number; rows that do not fit are an error.
    """
    docs = fixed(docs)
    row = fresh(docs, "_row")
    number, doc_id, size = fresh(docs, "_number"), fresh(docs, "_id"), fresh(docs, "_size")
    owner = shards.select(F.col("_row").alias(number), F.col("doc_id").alias(doc_id), F.col("n_bytes").alias(size), "shard_id")
    n_bytes = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0))
    same = (F.col(row) == F.col(number)) & F.col(f"`{id_col}`").eqNullSafe(F.col(doc_id)) & (n_bytes == F.col(size))
    owned = located(docs, row).join(owner, same).drop(row, number, doc_id, size)
    owned.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    written, wanted = docs.sparkSession.read.schema("shard_id long").parquet(path).count(), shards.count()
    if written != wanted:
        raise ValueError(f"{written} of {wanted} rows were written: docs gave its rows in another order than for shards; use shard(docs, path)")


def shard(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Deal ``docs``, whatever its plan, to shards and write them; see :func:`extendible_shards` and :func:`write_shards`."""
    docs = fixed(docs)
    write_shards(docs, extendible_shards(docs, id_col=id_col, text_col=text_col, **options), path, id_col, text_col)
