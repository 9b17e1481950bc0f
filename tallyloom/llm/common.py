"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a row number that hold its place in the file; the file's number stands above them.
ROW_INDEX_BITS = 36


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings: those of the library, and few rows per Arrow batch, because texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return tune(spark)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fixed(df: DataFrame) -> DataFrame:
    """``df`` itself where it only scans, projects and filters one Parquet source, whose rows have a place of their own (file and
    position in it); otherwise its rows, written once, which gives them one. :func:`located` numbers rows by that place."""
    def scans(plan) -> bool:
        below = plan.children()
        if below.size() == 0:
            return plan.nodeName() == "LogicalRelation"
        return plan.nodeName() in ("Project", "Filter") and all(scans(below.apply(i)) for i in range(below.size()))
    if scans(df._jdf.queryExecution().optimizedPlan()):
        try:
            df.select(df.metadataColumn("_metadata")["row_index"]).schema
            return df
        except AnalysisException:      # not Parquet, or the place of rows was projected away
            pass
    return materialise(df, "fixed")


def located(df: DataFrame, name: str, *columns: Column) -> DataFrame:
    """``columns`` of ``df`` (all of them by default) and a number that tells equal rows apart: file number and place in the file.

    The number depends neither on how files are split into tasks nor on how many tasks run at once, so a decision table made
    from one pass can be joined back to another, also when executors joined or were lost in between. The files are
    numbered in order of their paths. ``df`` must come from :func:`fixed`. The list of files is what the scan itself holds on the driver.
    """
    spark = df.sparkSession
    place = df.metadataColumn("_metadata")
    path, at, file, no = (fresh(df, c) for c in ("_path", "_at", "_file", "_no"))
    plain = lambda c: F.regexp_replace(c, ":/+", ":/")
    kept = list(columns) or [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*kept, plain(place["file_path"]).alias(path), place["row_index"].alias(at))
    paths = sorted({re.sub(":/+", ":/", f) for f in df.inputFiles()})
    listed = pa.table({file: pa.array(paths, pa.string()), no: pa.array(range(len(paths)), pa.int64())})
    files = materialise(spark.createDataFrame(listed).coalesce(1), "files")      # one row per file, so that Spark sees its size
    number = F.shiftleft(F.coalesce(no, F.raise_error(F.concat(F.lit("file not listed: "), path)).cast("long")), ROW_INDEX_BITS) + F.col(at)
    return rows.join(files, rows[path] == files[file], "left").withColumn(name, number).drop(path, at, file, no)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a number that tells equal rows apart within this pass only: the result has to be written before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unit_hash(col: Column) -> Column:
    """A number in (0, 1) decided by the text of ``col``: 52 bits of its md5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
