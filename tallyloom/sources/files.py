"""Partitioned Parquet in and out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_partition(spark: SparkSession, base: str, **keys: object) -> DataFrame:
    """One partition of a table; the key filters prune folders, so files of other partitions are listed, but not read."""
    df = spark.read.parquet(base)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def read_many(spark: SparkSession, paths: Sequence[str], glob: str | None = None) -> DataFrame:
    """Many files as one table, optionally only those whose name fits a glob."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(*paths)


def collect_periods(spark: SparkSession, base: str, years: Sequence[int], forms: Sequence[str],
                    on_missing: str = "skip", form_col: str = "skjema", year_col: str = "aar",
                    where: Column | None = None) -> DataFrame:
    """Many years x forms of a partitioned table as one read, tagged ``year`` and ``skjema``.

    A missing partition is skipped or, with ``on_missing='error'``, reported. The check looks at partition
    values only and its result is at most years x forms rows.
    """
    df = spark.read.parquet(base).where(F.col(year_col).isin(list(years)) & F.col(form_col).isin(list(forms)))
    if on_missing == "error":
        found = {(r[0], r[1]) for r in df.select(year_col, form_col).distinct().collect()}
        missing = [(y, f) for y in years for f in forms if (y, f) not in found]
        if missing:
            raise FileNotFoundError(f"no partition for {missing}")
    if where is not None:
        df = df.where(where)
    return df.withColumnsRenamed({year_col: "year", form_col: "skjema"})


def collect_period_files(spark: SparkSession, paths: Mapping[tuple[int, str], str], on_missing: str = "skip") -> DataFrame:
    """The same for files that lie apart and differ in columns: ``{(year, form): path}``."""
    out = None
    for (year, form), path in paths.items():
        try:
            part = spark.read.parquet(path)
        except AnalysisException:
            if on_missing == "error":
                raise FileNotFoundError(path) from None
            continue
        part = lower_columns(part).withColumns({"year": F.lit(year), "skjema": F.lit(form)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("none of the files exists")
    return out


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def write_partitioned(df: DataFrame, base: str, keys: Sequence[str] = (), mode: str = "error",
                      stamp: str | None = None) -> str:
    """Parquet under key folders; ``stamp`` adds a dated sub-folder for update files.

    Rows are not gathered by key first: a partition holding a third of the rows would then be written by
    one task. ``spark.sql.files.maxRecordsPerFile`` bounds the size of single files.
    """
    path = f"{base}/{stamp}" if stamp else base
    df.write.mode(mode).partitionBy(*keys).parquet(path)
    return path


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = False) -> DataFrame:
    """Compute and save a stage, or reload it when it is there and ``reuse`` is set; either way read from file.

    Parquet files appear when the write job commits, so a stage that was cut off is rebuilt, not half read.
    """
    if reuse:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def conform_table(df: DataFrame, rename: Mapping[str, str], add: Mapping[str, object] | None = None,
                  drop: Sequence[str] = ()) -> DataFrame:
    """Rename by mapping, add constant columns, drop columns."""
    return df.withColumnsRenamed(dict(rename)).withColumns(
        {k: F.lit(v) for k, v in (add or {}).items()}).drop(*drop)
