"""Register a query with its checking SQL.

``dbl``/``digits``: double columns rounded on both sides, because sums of doubles depend on the order of
addition in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads orders.parquet; Parquet column pruning and filters apply as usual."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"


def query(name: str, sql: str | None = None, dbl: str = "", digits: int = 6):
    """Decorator for ``fn(t: Tables) -> DataFrame``."""
    cols = dbl.split()

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols}) if cols else out
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            rounding = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in cols)
            ORACLES[name] = f"SELECT * REPLACE ({rounding}) FROM (\n{sql.strip()}\n)" if cols else sql.strip()
        return fn
    return wrap
