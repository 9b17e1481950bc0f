"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: tempfile.TemporaryDirectory | None = None
_written: list[str] = []

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even when that costs one more shuffle further on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators count on (all are changeable on a live session), and ship the package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, so that functions inside tasks find it from any working folder."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    root = Path(__file__).parent
    handle, path = tempfile.mkstemp(prefix="tallyloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    context._tallyloom_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a folder of its own; on a cluster a machine-local
    folder would be lost with the machine, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    global _local
    _local = tempfile.TemporaryDirectory(prefix="tallyloom-", ignore_cleanup_errors=True)     # goes when the program ends
    spark.conf.set("spark.checkpoint.dir", _local.name)
    return _local.name


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove every intermediate table this program has written. Call it when the results have been saved: tables that
    are still to be computed may read them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What an action inside shuffles goes when it ends. For actions whose plan is not run again: a write, a count."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the chain), and every
    later reference sees the same rows even where the plan was not deterministic. A written table
    is computed once and stays columnar, where ``checkpoint()`` computes twice and stores rows.
    What the write shuffles goes with it: later stages read the table.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, build: Callable[[], DataFrame], name: str = "t") -> DataFrame:
    """:func:`materialise` what ``build()`` gives and remove the tables it wrote on the way: nothing but its result may read them."""
    before = len(_written)
    out = materialise(build(), name)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [jvm.org.apache.hadoop.fs.Path(p) for p in _written[before:-1]]:
        path.getFileSystem(conf).delete(path, True)
    del _written[before:-1]
    return out


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


