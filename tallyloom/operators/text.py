"""Counts of words and characters in free-text comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_char, whole_words


def _occurrences(word: str) -> Column:
    return F.size(F.filter("_listed", lambda x: x == F.lit(word)))


def term_counts(df: DataFrame, cols: Sequence[str], words: Sequence[str], char: str = "!", phrases: Sequence[str] = ()) -> DataFrame:
    """Per row: ``n_words``, ``n_<word>`` for every listed word, ``term_total``, ``n_char``, over all text columns together.

    Words are compared in lower case and split at white space; each column is read once however often it is
    listed. ``phrases`` are counted as substrings of the lower-cased text with single spaces and added to the total.
    """
    text = F.concat_ws(" ", *[F.col(c) for c in dict.fromkeys(cols)])
    df = df.withColumns({"_text": text, "_words": whole_words(text)})
    wanted = [w.lower() for w in words]
    df = df.withColumn("_listed", F.filter("_words", lambda x: x.isin(wanted)))     # one pass over all words; each listed word then looks at what is left
    counts = {f"n_{w}": _occurrences(w) for w in wanted}
    flat = F.array_join("_words", " ")
    counts |= {f"n_{p.replace(' ', '_')}": count_char(flat, p.lower()).cast("int") for p in phrases}
    out = df.withColumns(counts)
    total = F.lit(0)
    for name in counts:
        total = total + F.col(name)
    return out.withColumns({"n_words": F.size("_words"), "term_total": total, "n_char": count_char("_text", char).cast("int")}) \
        .drop("_text", "_words", "_listed")


def term_rollup(df: DataFrame, value: str, level_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Totals for several key sets in one pass, largest first; keys outside a set are NULL, ``level`` numbers the set."""
    keys = list(dict.fromkeys(k for s in level_sets for k in s))
    out = df.groupingSets([[F.col(k) for k in s] for s in level_sets], *keys).agg(
        F.grouping_id(*keys).alias("_gid"), F.sum(value).alias("total"))
    level = F.lit(None).cast("int")
    for i, s in enumerate(level_sets):
        gid = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s)
        level = F.when(F.col("_gid") == gid, F.lit(i)).otherwise(level)
    return out.withColumn("level", level).drop("_gid").orderBy("level", F.desc("total"), *keys)
