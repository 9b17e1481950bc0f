"""Removing lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import fixed, located, lower_ascii, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text, _row)`` for every row: its text without lines that ``min_docs`` or more documents hold.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Lines are exploded with their position, keys of
    at least ``min_chars`` code points are hashed (two hashes, 128 bits), and each key's documents are counted: first one row per key
    and document, which spreads a line that a third of all documents hold over all tasks, then per key with partial counts.
    A counted key loses its lines in every document but the one with the largest id that holds it, where all of them
    stay. The positions to drop go back to their document, which is put together again from the others in order.

    Null text is one empty line, like an empty one. Every row is a document of its own: rows that repeat or share an id are
    counted each, and of those with the largest id the last in order of files keeps the line. A null id is smaller than any
    other. A document may be left with an empty text. An empty table gives an empty result; other columns are not read.
    What one task holds is bounded by the longest text.
    """
    docs = fixed(docs)
    rows = located(docs, "_row", F.col(id_col).alias("doc_id"), F.split(text_or_empty(text_col), "\n", -1).alias("lines"))
    key = lower_ascii(F.btrim("line", F.lit(BLANKS)))
    lines = rows.select("_row", "doc_id", F.posexplode("lines").alias("at", "line")).select("_row", "doc_id", "at", key.alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("_row", "doc_id", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("h2"))
    held = materialise(lines.groupBy("h", "h2", "_row", "doc_id").agg(F.collect_list("at").alias("at")), "held")       # at most the lines of one text
    often = held.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "_row")).alias("stay")).where(F.col("n") >= min_docs)
    often = materialise(often.select("h", "h2", F.col("stay._row").alias("stay")), "often")
    gone = held.join(often, ["h", "h2"]).where("_row <> stay").groupBy("_row").agg(F.flatten(F.collect_list("at")).alias("gone"))
    out = rows.join(materialise(gone, "gone").hint("merge"), "_row", "left")      # grows with the documents: never sent to every task, also where it is small
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    text = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"), "_row")
