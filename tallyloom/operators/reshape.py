"""Long answers to wide units, parent and child levels, cross tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import Totals, by_group, has_key


def eav_pivot(df: DataFrame, keys: Sequence[str], name: str, value: str, fields: Sequence[str],
              order: str) -> DataFrame:
    """One row per unit, one lower-cased column per field, holding its first non-missing value.

    The field list is given, so the schema does not depend on the data and no extra pass collects
    the names. Field filter and aggregation are map-side; fields absent from the data are NULL columns.
    """
    answers = df.where(F.col(name).isin(list(fields)) & F.col(value).isNotNull() & has_key(keys))
    return answers.groupBy(*keys).agg(*[
        F.min_by(F.when(F.col(name) == f, F.col(value)),
                 F.when(F.col(name) == f, F.col(order))).alias(f.lower()) for f in fields])


def split_levels(df: DataFrame, level: str, parent_cols: Sequence[str],
                 child_drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Parent rows (level 0) with their columns, child rows (level > 0) without the parent's."""
    return df.where(F.col(level) == 0).select(*parent_cols), df.where(F.col(level) > 0).drop(*child_drop)


def parent_to_children(df: DataFrame, keys: Sequence[str], level: str, cols: Sequence[str]) -> DataFrame:
    """Copy the level-0 values of a unit onto its child rows and drop the level-0 row."""
    def step(part: DataFrame, t: Totals) -> DataFrame:
        part = t.add(part, keys, **{"_p_" + c: F.max(F.when(F.col(level) == 0, F.col(c))) for c in cols})
        return part.where(F.col(level) > 0).withColumns({c: F.col("_p_" + c) for c in cols}) \
            .drop(*["_p_" + c for c in cols])
    return by_group(df, keys, step)


def pivot_wide(df: DataFrame, row: str, col: str, value: Column, values: Sequence[object],
               fill: float = 0.0, prefix: str = "") -> DataFrame:
    """Cross table of an aggregate; ``values`` names the columns, empty cells are filled."""
    out = df.groupBy(row).pivot(col, list(values)).agg(value)
    out = out.toDF(row, *[f"{prefix}{v}" for v in values])
    return out.fillna(fill, subset=out.columns[1:])


def pivot_flag(df: DataFrame, keys: Sequence[str], flag: str, value: str,
               names: tuple[str, str] = ("flag0", "flag1")) -> DataFrame:
    """Sum of ``value`` for flag 0 and flag 1 side by side; no row with the flag gives NULL."""
    return df.where(has_key(keys)).groupBy(*keys).agg(
        *[F.sum(F.when(F.col(flag) == i, F.col(value))).alias(n) for i, n in enumerate(names)])


def conform_form(df: DataFrame, renames: Mapping[str, str], refs: Sequence[tuple[DataFrame, Mapping[str, str]]] = (),
                 key: str = "id", fill: Mapping[str, object] | None = None,
                 copies: Mapping[str, str] | None = None) -> DataFrame:
    """Bring one form to the common layout: rename, add parent figures from published files, fill.

    ``refs``: pairs of (published table, {its column: our column}); each mapping must contain the key.
    Reference tables are cut to their mapped columns before the join. ``copies``: {new: existing}.
    """
    df = df.withColumnsRenamed(dict(renames))
    for table, names in refs:
        part = table.select(*[F.col(a).alias(b) for a, b in names.items()])
        df = df.join(part, key, "left")
    df = df.withColumns({new: F.col(old) for new, old in (copies or {}).items()})
    return df.fillna(dict(fill)) if fill else df


# What each form needs to reach the common layout (columns to rename, columns taken from the
# published enterprise and establishment files, figures set to 0 when missing).
FORM_RULES: dict[str, dict] = {
    "RA-1403": {"renames": {"tmp_oms": "tmp_no_omsetn"}},
    "RA-0255-1": {
        "renames": {"no_oms": "tmp_no_omsetn"},
        "enterprise": {"enhets_id": "id", "nopost_p4005": "tmp_no_p4005"},
        "enterprise_from_2023": {"nopost_driftskostnader": "tmp_driftskostnad_9010"},
        "fill": {"tmp_no_p4005": 0},
    },
    "RA-1100": {
        "renames": {"b_omsetning": "gjeldende_omsetn_kr", "b_driftskostnader": "driftskost_kr",
                    "tmp_b_sn07_1": "tmp_sn2007_5", "reg_type_bedrift": "regtype"},
        "enterprise": {"enhets_id": "id", "nopost_p4005": "tmp_no_p4005", "omsetning": "tmp_no_omsetn",
                       "naring_f": "nacef_5"},
        "establishment_last_year": {"enhets_id": "id", "sysselsetting_syss": "fjor_syssel_t1",
                                    "omsetning": "fjor_omsetn_kr_t1"},
        "copies": {"gjeldende_bdr_syss": "b_sysselsetting_syss"},
        "fill": {"tmp_no_p4005": 0, "fjor_syssel_t1": 0},
    },
}


def conform_known_form(df: DataFrame, form: str, year: int, enterprises: DataFrame | None = None,
                       establishments_last_year: DataFrame | None = None) -> DataFrame:
    """``conform_form`` with the rules of one of the known forms; other forms pass unchanged."""
    rule = FORM_RULES.get(form)
    if rule is None:
        return df
    refs = []
    if "enterprise" in rule:
        names = dict(rule["enterprise"])
        if year >= 2023:
            names |= rule.get("enterprise_from_2023", {})
        refs.append((enterprises, names))
    if "establishment_last_year" in rule:
        refs.append((establishments_last_year, rule["establishment_last_year"]))
    return conform_form(df, rule["renames"], refs, "id", rule.get("fill"), rule.get("copies"))
