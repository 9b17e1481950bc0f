"""Phrase collocations from depth-truncated suffix subtrees, built for groups of word prefixes that fit a memory budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import text_or_empty
from .words import mix

NO_LANG = "und"
TEXT_BYTES = 4 << 20       # texts are taken in parts of about this size, longer ones in several
WORD_BITS = 27             # bits of the table of frequent words, and of that of frequent pairs: 16 MiB each, whatever the data
BUCKET_BITS = 16           # prefixes are dealt to groups by this many bits of their hash
LONG_WORD = 64             # bytes; longer words are hashed one by one
SEPARATOR = rb"\x09-\x0d\x20.,;:!?"

_END = re.compile(b"[" + SEPARATOR + b"]")
_KIND = np.zeros(256, np.uint8)                    # 0: part of a word, 1: between words, 2: between pieces
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_rng = np.random.default_rng(12)
_VALUES = _rng.integers(0, 1 << 63, (2, 256), np.uint64)
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words of some texts of one language: two hashes of each, and the number of the piece that it stands in."""

    def __init__(self, raw: bytes, lang: str, check: bool = False):
        self.raw = raw.lower()                     # of bytes: A-Z only
        byte = np.frombuffer(self.raw, np.uint8)
        kind = _KIND[byte]
        edge = np.diff(np.concatenate([[False], kind == 0, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start] if len(self.start) else np.empty(0, np.int32)
        salt = np.uint64(xxhash.xxh3_64_intdigest(lang))
        self.id = self._hash(byte, 0, salt)
        self.check = self._hash(byte, 1, salt) if check else None

    def _hash(self, byte: np.ndarray, k: int, salt: np.uint64) -> np.ndarray:
        """Polynomials of the words' bytes, one byte of all words at a time; the few very long words one by one."""
        sizes = self.end - self.start
        order = np.argsort(-sizes, kind="stable")
        start, left = self.start[order], np.searchsorted(-sizes[order], -np.arange(LONG_WORD))       # words that have more than so many bytes
        out = sizes[order].astype(np.uint64)
        for at, n in enumerate(left.tolist()):
            if not n:
                break
            out[:n] = out[:n] * _BASES[k] + _VALUES[k][byte[start[:n] + at]]
        for i in range(int(np.searchsorted(-sizes[order], -LONG_WORD))):
            out[i] = xxhash.xxh3_64_intdigest(self.raw[start[i]:start[i] + sizes[order[i]]], k)
        found = np.empty(len(out), np.uint64)
        found[order] = mix(mix(out) ^ salt)
        return np.maximum(found, np.uint64(1))     # 0 stands for no word


def parts(batch: pa.RecordBatch, ahead: int, size: int) -> Iterator[tuple[str, bytes, int]]:
    """``(lang, bytes, own)`` from columns (lang, text): texts of one language one after the other, a line feed between them.

    A text over ``size`` bytes comes in parts that end between words; each brings the next ``ahead`` words of the text along,
    and only words that start before ``own`` are its own.
    """
    onward = re.compile(b"(?:[" + SEPARATOR + b"]*[^" + SEPARATOR + b"]+){0,%d}" % ahead)
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    texts = batch.column(1).cast(pa.binary())
    for lang, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
        if len(raw.as_buffer()) > size:
            whole, at = raw.as_py(), 0
            while at < len(whole):
                cut = _END.search(whole, min(len(whole), at + size))
                to = cut.start() if cut else len(whole)
                yield lang, whole[at:onward.match(whole, to).end()], to - at
                at = to
            continue
        held.setdefault(lang, []).append(raw.as_py())
        sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
        if sizes[lang] > size:
            joined = b"\n".join(held.pop(lang))
            del sizes[lang]
            yield lang, joined, len(joined)
    for lang, some in held.items():
        joined = b"\n".join(some)
        yield lang, joined, len(joined)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``size`` bytes for each of a few languages."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.get_total_buffer_size()
        if total > 2 * size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def word_counts(texts: DataFrame, part_bytes: int) -> DataFrame:
    """``(lang, id, word, f)``: every word of every language. Two words with the same 64-bit hash are an error, told by a second hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, part_bytes):
            for lang, raw, own in parts(batch, 0, part_bytes):
                w = Words(raw, lang, check=True)
                n = int(np.searchsorted(w.start, own))
                ids, at, back, f = np.unique(w.id[:n], return_index=True, return_inverse=True, return_counts=True)
                if (w.check[:n] != w.check[at][back]).any():
                    raise ValueError("two words have one hash")
                words = pa.array([w.raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids.view(np.int64)), pa.array(w.check[at].view(np.int64)), words, pa.array(f)],
                                                 ["lang", "id", "check", "word", "f"])
    found = texts.mapInArrow(run, "lang string, id long, check long, word string, f long")
    one = F.when(F.min("check") == F.max("check"), F.sum("f")).otherwise(F.raise_error(F.lit("two words have one hash")).cast("long"))
    return found.groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), one.alias("f"))


class BitTable:
    """A table of 2^``WORD_BITS`` bits, set for some hashes. Others may be set, too: it saves work and never decides."""

    def __init__(self, keys: DataFrame):
        place = F.expr(f"id & {(1 << WORD_BITS) - 1}")
        rows = keys.select(F.shiftright(place, 15).alias("k"), (place % 32768).alias("bit"))
        self.bits = np.zeros(1 << (WORD_BITS - 3), np.uint8)
        for r in rows.groupBy("k").agg(F.bitmap_construct_agg("bit").alias("b")).toLocalIterator():      # at most 2^(WORD_BITS - 15) rows
            self.bits[r["k"] * 4096:(r["k"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = ids & np.uint64((1 << WORD_BITS) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _MIX + b)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a table of hashes and their numbers."""
    code = None
    for k in range(rows.shape[1]):
        local = np.unique(rows[:, k], return_inverse=True)[1]
        code = local if code is None else np.unique(code * (int(local.max()) + 1) + local, return_inverse=True)[1]
    at, f = np.unique(code, return_index=True, return_counts=True)[1:]
    return rows[at], f


def pair_counts(texts: DataFrame, frequent, min_count: int, part_bytes: int) -> DataFrame:
    """``(w1, w2, f)``: pairs of neighbouring words, ``min_count`` times or more. ``frequent``: table of the words that come into question."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in _gathered(batches, part_bytes):
            for lang, raw, own in parts(batch, 1, part_bytes):
                w = Words(raw, lang)
                if len(w.id) < 2:
                    continue
                good = table(w.id)
                first = np.flatnonzero((w.piece[1:] == w.piece[:-1]) & good[1:] & good[:-1] & (w.start[:-1] < own))
                if len(first):
                    pairs, f = _distinct(np.stack([w.id[first], w.id[first + 1]], axis=1))
                    yield pa.RecordBatch.from_arrays([*[pa.array(pairs[:, k].view(np.int64)) for k in (0, 1)], pa.array(f)], ["w1", "w2", "f"])
    found = texts.mapInArrow(run, "w1 long, w2 long, f long")
    return found.groupBy("w1", "w2").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


@dataclass
class Partition:
    """Vertical partitioning: prefixes of one word; of two where a word has more suffixes than the budget; of three where a pair has. Each prefix's
    hash falls into a bucket, and consecutive buckets are one group as long as their suffixes stay within the budget."""

    words: np.ndarray          # words and pairs above the budget: at most (all suffixes / budget) of each
    pairs: np.ndarray
    group: np.ndarray | None = None

    def bucket(self, w: list[np.ndarray]) -> np.ndarray:
        prefix = w[0]
        long = np.isin(prefix, self.words)
        if long.any():
            two = _pair(w[0], w[1])
            prefix = np.where(long, two, prefix)
            if len(w) > 2:
                prefix = np.where(np.isin(two, self.pairs), _pair(two, w[2]), prefix)
        return (mix(prefix) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    @classmethod
    def plan(cls, pairs: DataFrame, budget: int) -> Partition:
        """The groups for ``pairs`` (w1, w2, f), whose counts are the numbers of suffixes."""
        def ids(rows: DataFrame, columns: int) -> list[np.ndarray]:
            table = rows.toArrow()
            return [table.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in range(columns)]

        words = ids(pairs.groupBy("w1").agg(F.sum("f").alias("n")).where(F.col("n") > budget).select("w1"), 1)[0]
        hot = ids(pairs.where(F.col("f") > budget).select("w1", "w2"), 2)
        plan = cls(words, _pair(*hot))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = [batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)]
                sums = np.bincount(plan.bucket(w), batch.column(2).to_numpy())
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some].astype(np.int64))], ["bucket", "n"])

        found = pairs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()      # at most 2^BUCKET_BITS rows
        sizes = np.zeros(1 << BUCKET_BITS, np.int64)
        sizes[[r["bucket"] for r in found]] = [r["n"] for r in found]
        plan.group, at, held = np.zeros(1 << BUCKET_BITS, np.int32), 0, 0
        for k, n in enumerate(sizes.tolist()):
            if held and held + n > budget:
                at, held = at + 1, 0
            plan.group[k] = at
            held += n
        return plan


def subtree_counts(texts: DataFrame, pairs, plan, depth: int, min_count: int, part_bytes: int) -> DataFrame:
    """``(w1 .. w<depth>, f)``: phrases of three words or more, ``min_count`` times or more; no word is 0.

    A suffix is the run of words from some place on, cut at ``depth`` words, at the end of its piece and before a pair that is not frequent:
    no frequent phrase goes on beyond that. Equal suffixes of some texts are one entry with a count before they are dealt to the group
    of their prefix. A group's entries, sorted, are the leaves of its subtrees; an inner node is a run of leaves that begin alike, and its count their total.
    """
    names = [f"w{k + 1}" for k in range(depth)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, groups = pairs.value, plan.value
        for batch in _gathered(batches, part_bytes):
            for lang, raw, own in parts(batch, depth - 1, part_bytes):
                w = Words(raw, lang)
                if len(w.id) < 3:
                    continue
                on = np.zeros(len(w.id) + depth, bool)                 # whether the word and its next belong to a frequent pair
                on[:len(w.id) - 1] = (w.piece[1:] == w.piece[:-1]) & table(_pair(w.id[:-1], w.id[1:]))
                at = np.flatnonzero(on[:len(w.id)] & on[1:len(w.id) + 1] & (w.start < own))
                if not len(at):
                    continue
                ids = np.concatenate([w.id, np.zeros(depth, np.uint64)])
                rows, going = np.zeros((len(at), depth), np.uint64), np.ones(len(at), bool)
                for k in range(depth):
                    if k:
                        going = going & on[at + k - 1]
                    rows[:, k] = np.where(going, ids[at + k], np.uint64(0))
                rows, f = _distinct(rows)
                g = groups.group[groups.bucket([rows[:, 0], rows[:, 1], rows[:, 2]])]
                yield pa.RecordBatch.from_arrays([pa.array(g), *[pa.array(rows[:, k].view(np.int64)) for k in range(depth)], pa.array(f)], ["g", *names, "f"])

    def grow(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
        f = table.column("f").to_numpy()
        order = np.lexsort(rows.T[::-1])
        rows, total = rows[order], np.concatenate([[0], np.cumsum(f[order])])
        differs = rows[1:] != rows[:-1]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)       # words that a leaf has in common with the one before
        out, counts = [], []
        for k in range(3, depth + 1):
            first = np.concatenate([[0], np.flatnonzero(shared < k) + 1])
            n = np.diff(total[np.concatenate([first, [len(rows)]])])
            some = (n >= min_count) & (rows[first, k - 1] != 0)
            node = rows[first[some]].copy()
            node[:, k:] = 0
            out.append(node)
            counts.append(n[some])
        node = np.concatenate(out)
        return pa.table([*[pa.array(node[:, k].view(np.int64)) for k in range(depth)], pa.array(np.concatenate(counts))], [*names, "f"])

    kinds = ", ".join(f"{c} long" for c in names)
    return texts.mapInArrow(cut, f"g int, {kinds}, f long").groupBy("g").applyInArrow(grow, f"{kinds}, f long")


def collocations(docs: DataFrame, min_count: int = 30, depth: int = 4, contained: int = 80, top: int = 2000, scale: int = 2_000_000, budget: int = 1 << 18,
                 part_bytes: int = TEXT_BYTES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``depth`` words.

    Texts, A-Z lower-cased, are split at ``. , ; : ! ?`` and line breaks into pieces and these at blanks and tabs into words; a
    phrase stays in its piece, overlapping occurrences count, and everything is counted per language (null: ``und``). A phrase with
    a >= ``min_count`` occurrences is a candidate. Cut after its first k words, it scores floor(scale * a / (l + r)) with the counts of
    both sides; the lowest-scoring cut counts (of equal ones the first). Candidates that stand within a longer
    candidate with at least ``contained`` percent of their count are dropped. Scores are exact (decimal arithmetic).

    Counting goes from short prefixes to long ones: words; pairs of frequent words; then, from the pairs' counts, groups of
    prefixes within ``budget`` suffixes (:class:`Partition`), whose subtrees are built independently (:func:`subtree_counts`). What goes
    to every worker are two tables of fixed size, one group number per bucket, and the words and pairs above the budget.

    Null and empty texts have no words; a text over ``part_bytes`` is taken in parts, and no part is much larger. Repeated rows count each. An empty table gives an empty
    result; other columns, the id included, are not read.
    """
    spark = docs.sparkSession
    names = [f"w{k + 1}" for k in range(depth)]
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), text_or_empty(text_col).alias("text"))
    every = materialise(word_counts(texts, part_bytes), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialise(every.where(F.col("f") >= min_count), "frequent")
    frequent = spark.sparkContext.broadcast(BitTable(words.select("id")))
    pairs = materialise(pair_counts(texts, frequent, min_count, part_bytes), "pairs")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pair(*[batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)]).view(np.int64))], ["id"])

    linked = spark.sparkContext.broadcast(BitTable(pairs.select("w1", "w2").mapInArrow(keyed, "id long")))
    plan = spark.sparkContext.broadcast(Partition.plan(pairs, budget))
    longer = subtree_counts(texts, linked, plan, depth, min_count, part_bytes)
    none = F.lit(0).cast("long")
    phrases = materialise(pairs.select("w1", "w2", *[none.alias(c) for c in names[2:]], "f").unionByName(longer), "phrases")

    counts = phrases.unionByName(words.select(F.col("id").alias("w1"), *[none.alias(c) for c in names[1:]], "f"))
    size = sum(F.when(F.col(c) != 0, 1).otherwise(0) for c in names)
    cand = phrases.select(*names, F.col("f").alias("a"), size.alias("size"))

    def part(lo: int, hi: int):
        """Words lo+1 to hi of the phrase as a phrase of its own."""
        return F.struct(*[(F.col(names[lo + k]) if lo + k < hi else none).alias(f"p{k + 1}") for k in range(depth)])

    keys = [f"p{k + 1}" for k in range(depth)]
    known = counts.select(*[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)], "f")
    sides = [F.when(F.col("size") == n, F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), part(*((0, k) if s == 0 else (k, n))).alias("p"))
                                                  for k in range(1, n) for s in (0, 1)])) for n in range(2, depth + 1)]
    asked = cand.select(*names, "a", F.explode(F.coalesce(*sides)).alias("x")).select(*names, "a", "x.k", "x.side", "x.p.*")
    cuts = asked.join(known, keys).groupBy(*names, "a", "k").agg(F.sum(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.sum(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20, 0)) * {scale}BD) div cast(l + r as decimal(20, 0))"))
    scored = cuts.groupBy(*names, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inside = [F.when(F.col("size") == n, F.array(*[part(lo, lo + m) for m in range(2, n) for lo in range(n - m + 1)])) for n in range(3, depth + 1)]
    within = cand.where("size > 2").select(F.col("a").alias("f"), F.explode(F.coalesce(*inside)).alias("p")).groupBy("p").agg(F.max("f").alias("most"))
    within = within.select(*[F.col(f"p.{k}").alias(c) for c, k in zip(names, keys, strict=True)], "most")
    kept = scored.join(within, names, "left").where(F.col("most").isNull() | (100 * F.col("most") < contained * F.col("a")))
    kept = kept.join(words.select(F.col("id").alias("w1"), "lang"), "w1").select("lang", *names, "a", "best.l", "best.r", "best.score")

    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    kept = materialise(kept.withColumn("_rank", F.rank().over(first)).where(F.col("_rank") <= top).drop("_rank"), "kept")       # ties at the end stay until phrases are known
    spelt = kept.select("*", F.posexplode(F.array(*names)).alias("at", "id")).where("id <> 0").join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", *names, "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
