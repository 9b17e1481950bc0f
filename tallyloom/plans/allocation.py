"""The allocation chain from usable turnover to reconciled units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocate as a
from ..operators.grouping import Totals, WindowTotals, by_group

PARENT, FORM = ["_parent"], ["_parent", "id"]

STEPS = {
    "cost": lambda df, t: a.allocate_cost(df, FORM, totals=t),
    "turnover": lambda df, t: a.allocate_with_helpers(df, FORM, totals=t),
    "industry": lambda df, t: a.flag_industry(df, parent="_parent", totals=t),
    "income": lambda df, t: a.allocate_two_tier(df, [*PARENT, "lopenr"], totals=t),
    "single": lambda df, t: a.override_single_units(df, FORM, totals=t),
    "minimum": lambda df, t: a.enforce_minimum(df, [*PARENT, "lopenr"], totals=t),
    "single_again": lambda df, t: a.override_single_units(df, FORM, totals=t),
}


def allocate_units(df: DataFrame, until: str = "single_again", source: DataFrame | None = None) -> DataFrame:
    """Impute cost, allocate cost, turnover, sales income and consumption, single units, minimum rule.

    Some steps add up by form ``id``, some by parent ``orgnr_n_1``. A form belongs to one parent, so rows are brought
    together by parent once (a form without parent number is its own parent) and every window of the chain finds
    them in place: one shuffle in all. The split into ordinary and hot parents is also made once, by one count over
    the key columns; hand in a written stage, or the unit table before its joins as ``source``, so that this pass
    reads those columns only. ``until`` names the last step.
    """
    def keyed(x: DataFrame) -> DataFrame:
        return x.withColumn("_parent", F.coalesce(F.col("orgnr_n_1").cast("string"), F.col("id").cast("string")))

    def chain(part: DataFrame, t: Totals) -> DataFrame:
        if isinstance(t, WindowTotals):
            part = part.repartition("_parent")
        for name, step in STEPS.items():
            part = step(part, t)
            if name == until:
                break
        return part
    df = keyed(a.fix_consumption(a.impute_by_margin(df)))
    return by_group(df, PARENT, chain, source=None if source is None else keyed(source)).drop("_parent")
