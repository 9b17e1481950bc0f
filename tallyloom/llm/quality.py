"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise, shuffle_width
from .common import numbered, text_or_empty, unit_hash
from .lm import SPLIT, _bucketed, _ranges, _slices
from .words import hash_words, mix, regroup, split_words

TEXT_BYTES = 8 << 20
GROUP_BYTES = 12 << 20    # texts that are counted and looked up together
SHARD_ENTRIES = 2_000_000
NONE = np.uint32(0)       # number of a word that no training text has
MANY = 2048
LEAST_DOCS = 100      # training documents of a language that has twice as many trusted ones
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def _lang_key(langs: list) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest("" if x is None else "+" + x) for x in langs], np.uint64)


def _tokens(texts: pa.Array, langs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token and history keys of all texts, both specific to the language, and tokens per text; the end is a token."""
    vocabulary, index, counts = split_words(texts)
    keys = np.append(hash_words(vocabulary), END)
    ends = np.cumsum(counts + 1)
    token = np.full(int(ends[-1]) if len(ends) else 0, END)
    inside = np.ones(len(token), bool)
    inside[ends - 1] = False
    token[inside] = keys[index]
    history = np.roll(token, 1)
    history[ends - counts - 1] = BEGIN
    lang = np.repeat(_lang_key(langs), counts + 1)
    return mix(token ^ lang), mix(history ^ lang), counts + 1


def _pair(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(history * FACTOR + token)


@dataclass
class Tables:
    """The model as sorted shards: pairs (discounted share of the history), histories (weight of backing off), tokens."""
    pairs: np.ndarray
    share: np.ndarray
    histories: np.ndarray
    backoff: np.ndarray
    tokens: np.ndarray
    lower: np.ndarray
    unknown: dict[int, float]

    def log10(self, token: np.ndarray, history: np.ndarray, lang: np.ndarray) -> np.ndarray:
        def find(keys, values, wanted, default):
            if not len(keys):
                return np.broadcast_to(np.asarray(default, float), wanted.shape).copy()
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], default)
        kinds, place = np.unique(lang, return_inverse=True)
        unknown = np.array([self.unknown.get(int(k), 1e-7) for k in kinds])[place]
        lower = find(self.tokens, self.lower, token, unknown)
        p = find(self.pairs, self.share, _pair(history, token), 0.0) + find(self.histories, self.backoff, history, 1.0) * lower
        return np.log10(p)


def _discount(df: DataFrame, by: str, count: str) -> DataFrame:
    """Three discounts per language from the numbers of things counted 1, 2, 3 and 4 times (Chen and Goodman)."""
    n = [F.sum((F.col(count) == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = df.groupBy(by).agg(*n)
    one = lambda k: F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(0.5)
    return d.select(by, *[one(k).alias(f"d{k}") for k in (1, 2, 3)])


def fit(sample: DataFrame) -> Tables:
    """The model of a small ``sample`` ``(_t, _lang)`` in memory, one per language; :func:`perplexities` holds that of any number of texts in shards.

    Pair counts are summed by key; everything after that is joins of count tables sharded by key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, 0, TEXT_BYTES):
            langs = batch.column(1).to_pylist()
            token, history, length = _tokens(batch.column(0), langs)
            lang = np.repeat(_lang_key(langs), length)
            _, first, n = np.unique(_pair(history, token), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (lang[first], history[first], token[first])] + [pa.array(n)], ["l", "h", "w", "n"])

    pairs = materialise(sample.select("_t", "_lang").mapInArrow(run, "l long, h long, w long, n long").groupBy("l", "h", "w").agg(F.sum("n").alias("c")), "pairs")
    d = _discount(pairs, "l", "c")
    off = lambda c: F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = pairs.join(F.broadcast(d), "l").withColumn("off", off("c"))                                     # one row per language
    histories = cut.groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("taken"))
    shares = cut.join(histories, "h").select("h", "w", ((F.col("c") - F.col("off")) / F.col("total")).alias("p"))
    seen = materialise(pairs.groupBy("l", "w").agg(F.count(F.lit(1)).alias("c")), "seen")
    low = seen.join(F.broadcast(_discount(seen, "l", "c")), "l").withColumn("off", off("c"))
    totals = low.groupBy("l").agg(F.sum("c").alias("total"), F.sum("off").alias("taken"), F.count(F.lit(1)).alias("kinds"))
    totals = totals.withColumn("unknown", F.col("taken") / F.col("total") / (F.col("kinds") + 1))
    low = low.join(F.broadcast(totals.select("l", "total", "unknown")), "l").select("w", ((F.col("c") - F.col("off")) / F.col("total") + F.col("unknown")).alias("p"))

    def table(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = df.select(key, value).toArrow()
        keys, values = got[key].to_numpy().astype(np.int64).view(np.uint64), got[value].to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    got = shares.select("h", "w", "p").toArrow()
    key = _pair(got["h"].to_numpy().astype(np.int64).view(np.uint64), got["w"].to_numpy().astype(np.int64).view(np.uint64))
    order = np.argsort(key)
    h, b = table(histories.withColumn("b", F.col("taken") / F.col("total")), "h", "b")
    w, p = table(low, "w", "p")
    unknown = {int(np.int64(r["l"]).view(np.uint64)): r["unknown"] for r in totals.select("l", "unknown").collect()}
    return Tables(key[order], got["p"].to_numpy()[order], h, b, w, p, unknown)


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones, compressed: the upper bytes are mostly alike. Where there are many, each kind of byte has its own code."""
    planes = [x.tobytes() for a in arrays for x in np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T]
    frames = map(zstandard.ZstdCompressor(level=1).compress, planes if len(arrays[0]) >= MANY else [b"".join(planes)])
    return b"".join(len(x).to_bytes(4, "little") + x for x in frames)


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    frames, at, unpack = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 4], "little")
        frames.append(unpack.decompress(blob[at + 4:at + 4 + size]))
        at += 4 + size
    raw, out, at = b"".join(frames), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _blocks(table: pa.Table, *kinds: str) -> tuple[list[int], list[list[np.ndarray]]]:
    """How many numbers each block holds, and its arrays; the first one was packed as steps."""
    size = table["n"].to_pylist()
    parts = [_unpack(blob, n, *kinds) for blob, n in zip(table["blob"].to_pylist(), size, strict=True)]
    for x in parts:
        x[0] = np.cumsum(x[0], dtype=x[0].dtype)
    return size, parts


def grouped(docs: DataFrame) -> DataFrame:
    """Texts of one language as token numbers, a row per group of texts, written: ``(b, lang, doc_id[], length[], words, n_words, places, n_tokens)``.

    ``words`` are the keys of the group's tokens, the frequent ones first, the end of texts among them and the beginning last; ``places`` is every token's place there.
    """
    rows = numbered(docs.select("doc_id", "lang", text_or_empty("_t").alias("_t")), "_row").select("doc_id", "lang", "_row", "_t")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, 3, GROUP_BYTES):
            code = pc.fill_null(batch.column(1).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            for c in np.unique(code):
                part = batch.take(pa.array(np.flatnonzero(code == c)))
                lang = _lang_key([part.column(1)[0].as_py()])
                vocabulary, index, counts = split_words(part.column(3))
                word = np.append(hash_words(vocabulary), END)
                ends = np.cumsum(counts + 1)
                place = np.full(int(ends[-1]), len(word) - 1, np.int64)
                inside = np.ones(len(place), bool)
                inside[ends - 1] = False
                place[inside] = index
                times = np.bincount(place, minlength=len(word))
                order = np.argsort(-times, kind="stable")
                rank = np.argsort(order)
                keys = mix(np.append(word[order[times[order] > 0]], BEGIN) ^ lang)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                columns = [part.column(2)[:1], part.column(1)[:1], one(part.column(0)), one(pa.array(counts + 1, pa.int64())), pa.array([_pack(keys)], pa.binary()),
                           pa.array([len(keys)], pa.int64()), pa.array([_pack(rank[place].astype("u4"))], pa.binary()), pa.array([len(place)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["b", "lang", "doc_id", "length", "words", "n_words", "places", "n_tokens"])

    return _bucketed(rows.mapInArrow(run, f"b long, lang string, doc_id array<{kind}>, length array<long>, words binary, n_words long, places binary, n_tokens long"), "b")


def _answers(found: DataFrame, name: str) -> DataFrame:
    """What all shards answer a group, in the order of the shards."""
    return found.where("b IS NOT NULL").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("s", "n", "blob"))).alias(name))


def _joined(parts: list[dict] | None, *kinds: str) -> list[np.ndarray]:
    found = [_unpack(x["blob"], x["n"], *kinds) for x in parts or []]
    return [np.concatenate([np.zeros(0, kind), *(x[i] for x in found)]) for i, kind in enumerate(kinds)]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Group:
    """The words and, with ``ids``, the different pairs of a row of :func:`grouped`. Pairs are ``asked`` for where both words were seen in training."""

    def __init__(self, row: dict):
        self.n = row["n_words"]
        self.keys = _unpack(row["words"], self.n, "u8")[0]
        self.order = np.argsort(self.keys)
        self.place = _unpack(row["places"], row["n_tokens"], "u4")[0].astype(np.int64)
        self.length = np.array(row["length"], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        trained = np.zeros(len(self.length), bool)
        trained[row.get("trained") or []] = True
        self.texts, self.train = int(trained.sum()), np.repeat(trained, self.length)

    def by_word(self, sorted_by_key: np.ndarray) -> np.ndarray:
        out = np.empty_like(sorted_by_key)
        out[self.order] = sorted_by_key
        return out

    def pair(self, words: list[dict], tokens: int, shards: int) -> None:
        ids, count = map(self.by_word, _joined(words, "u4", "u8"))
        self.count = count.astype(np.int64)
        history = np.roll(self.place, 1)
        history[self.begin] = self.n - 1                                     # the beginning of a text
        pair, self.inverse = np.unique(history * self.n + self.place, return_inverse=True)
        self.first, self.second = pair // self.n, pair % self.n
        known = np.flatnonzero((ids[self.first] != NONE) & (ids[self.second] != NONE))
        h, w = ids[self.first[known]], ids[self.second[known]]
        ways = np.maximum(1, -(-self.count[self.first[known]] * SPLIT // max(1, tokens))).astype(np.uint64)
        salt = np.where(ways > 1, mix(w.astype(np.uint64) + np.uint64(1)) % ways, np.uint64(0))
        shard = _ranges(mix(mix(h.astype(np.uint64) + np.uint64(1)) ^ mix(salt + np.uint64(1))), shards)
        order = np.lexsort((w, h, shard))
        self.asked, self.h, self.w, self.shard = known[order], h[order], w[order], shard[order]


def count_words(groups: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """``(s, b, n, blob)``: numbers and training counts of the words of every group, in the order of their keys; and the number of training tokens.

    A word that was seen in training has a number: its rank by count in its shard, times the shards, plus the shard and one. So frequent words have small ones.
    """
    schema = pa.schema([("s", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            g = Group(row)
            seen = np.bincount(g.place[g.train], minlength=g.n)
            seen[g.n - 1] = g.texts
            keys, seen = g.keys[g.order], seen[g.order].astype("u4")
            for s, lo, hi in _slices(_ranges(keys, shards)):
                yield pa.RecordBatch.from_pylist([{"s": s, "b": row["b"], "n": hi - lo, "blob": _pack(_steps(keys[lo:hi]), seen[lo:hi])}], schema)

    def merge(table: pa.Table) -> pa.Table:
        s, (size, parts) = table["s"][0].as_py(), _blocks(table, "u8", "u4")
        distinct, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        count = np.bincount(place, np.concatenate([x[1] for x in parts]), len(distinct)).astype(np.int64)
        order, ids = np.lexsort((distinct, -count)), np.full(len(distinct), NONE, np.uint32)
        known = order[:int((count > 0).sum())]
        ids[known] = np.arange(len(known)) * shards + s + 1
        out, at = [{"s": s, "b": None, "n": int(count.sum()), "blob": None}], 0
        for b, n in zip(table["b"].to_pylist(), size, strict=True):
            mine = place[at:at + n]
            out.append({"s": s, "b": b, "n": n, "blob": _pack(ids[mine], count[mine].astype("u8"))})
            at += n
        return pa.Table.from_pylist(out, schema)

    found = materialise(groups.mapInArrow(ask, "s long, b long, n long, blob binary").groupBy("s").applyInArrow(merge, "s long, b long, n long, blob binary"), "words")
    return found, found.where("b IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def count_pairs(groups: DataFrame, tokens: int, shards: int, word_shards: int) -> DataFrame:
    """Three kinds of rows: ``(s, b, n, blob)`` training counts of the pairs that a group asked for, in their order; ``(l, stats)`` of how many pairs of a language
    were seen 1 to 4 times; ``(t, l, n, blob)`` for the words of a shard: pairs that begin with them and were seen once, twice, more often, and those that end with them."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            g = Group(row)
            g.pair(row["word_counts"], tokens, shards)
            train = np.bincount(g.inverse[g.train], minlength=len(g.first))[g.asked].astype("u4")
            lang = int(_lang_key([row["lang"]]).view(np.int64)[0])
            for s, lo, hi in _slices(g.shard):
                blob = _pack(_steps(g.h[lo:hi]), g.w[lo:hi], train[lo:hi])
                yield pa.RecordBatch.from_pylist([{"s": s, "b": row["b"], "l": lang, "n": hi - lo, "blob": blob}], asked)

    asked = pa.schema([("s", pa.int64()), ("b", pa.int64()), ("l", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
    schema = pa.schema([*asked, ("t", pa.int64()), ("stats", pa.list_(pa.int64()))])

    def merge(table: pa.Table) -> pa.Table:
        size, parts = _blocks(table, "u4", "u4", "u4")
        distinct, first, place = np.unique(np.concatenate([(x[0].astype(np.uint64) << np.uint64(32)) | x[1] for x in parts]), return_index=True, return_inverse=True)
        count = np.bincount(place, np.concatenate([x[2] for x in parts]), len(distinct)).astype(np.int64)
        out, at = [], 0
        for b, n in zip(table["b"].to_pylist(), size, strict=True):
            out.append({"s": table["s"][0].as_py(), "b": b, "n": n, "blob": _pack(count[place[at:at + n]].astype("u4"))})
            at += n
        seen = count > 0
        lang = np.repeat(table["l"].to_numpy(), size)[first[seen]]
        h, w, c = (distinct[seen] >> np.uint64(32)).astype(np.uint32), distinct[seen].astype(np.uint32), count[seen]
        for k in np.unique(lang):
            mine = lang == k
            out.append({"l": int(k), "stats": [int((c[mine] == j).sum()) for j in (1, 2, 3, 4)]})
            ids, at = np.unique(np.concatenate([h[mine], w[mine]]), return_inverse=True)
            begins, ends, c1 = at[:mine.sum()], at[mine.sum():], c[mine]
            sums = [np.bincount(begins[x], minlength=len(ids)) for x in (c1 == 1, c1 == 2, c1 > 2)] + [np.bincount(ends, minlength=len(ids))]
            owner = (ids - 1) % word_shards
            order = np.lexsort((ids, owner))
            for t, lo, hi in _slices(owner[order]):
                at = order[lo:hi]
                out.append({"t": t, "l": int(k), "n": hi - lo, "blob": _pack(_steps(ids[at]), *[x[at].astype("u4") for x in sums])})
        return pa.Table.from_pylist(out, schema)

    rows = groups.mapInArrow(ask, "s long, b long, l long, n long, blob binary")
    return materialise(rows.groupBy("s").applyInArrow(merge, "s long, b long, l long, n long, blob binary, t long, stats array<long>"), "pairs")


def count_kinds(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(s, b, n, blob)``: the sums over all shards of pairs for every word of a group, in the order of their keys; ``(l, stats)``: words that end 1 to 4 different
    pairs, all these pairs, and words that end any."""
    def merge(table: pa.Table) -> pa.Table:
        parts = table.filter(pc.is_null(table["b"]))
        size, sums = _blocks(parts, "u4", "u4", "u4", "u4", "u4")
        ids, first, place = np.unique(np.concatenate([np.zeros(0, np.uint32), *(x[0] for x in sums)]), return_index=True, return_inverse=True)
        total = [np.bincount(place, np.concatenate([np.zeros(0), *(x[j] for x in sums)]), len(ids)).astype("u4") for j in (1, 2, 3, 4)]
        out = []
        for r in table.filter(pc.is_valid(table["b"])).to_pylist():
            wanted = _unpack(r["blob"], r["n"], "u4", "u8")[0]
            at = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
            hit = ids[at] == wanted if len(ids) else np.zeros(len(wanted), bool)
            out.append({"s": r["s"], "b": r["b"], "n": r["n"], "blob": _pack(*[np.where(hit, x[at], 0).astype("u4") if len(ids) else np.zeros(len(wanted), np.uint32) for x in total])})
        lang, kinds = np.repeat(parts["l"].to_numpy(), size)[first], total[3].astype(np.int64)
        for k in np.unique(lang):
            mine = kinds[lang == k]
            out.append({"l": int(k), "stats": [*(int((mine == j).sum()) for j in (1, 2, 3, 4)), int(mine.sum()), int((mine > 0).sum())]})
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("s", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("l", pa.int64()), ("stats", pa.list_(pa.int64()))])
    none = F.lit(None).cast("long")
    both = words.where("b IS NOT NULL").select("s", "b", none.alias("l"), "n", "blob").unionByName(pairs.where("t IS NOT NULL").select(F.col("t").alias("s"), none.alias("b"), "l", "n", "blob"))
    return materialise(both.groupBy("s").applyInArrow(merge, "s long, b long, n long, blob binary, l long, stats array<long>"), "kinds")


def _by_language(found: DataFrame, n: int) -> dict[int, list[int]]:
    rows = found.where("stats IS NOT NULL").groupBy("l").agg(*[F.sum(F.col("stats")[i]).alias(str(i)) for i in range(n)]).collect()       # one row per language
    return {r["l"]: [int(x) for x in r[1:]] for r in rows}


def _discounts(n: list[int]) -> np.ndarray:
    """As :func:`_discount`, from the numbers of things counted 1, 2, 3 and 4 times: by count, 3 standing for more."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return np.array([0.0, *(max(0.05, min(k - 0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[0] and n[k - 1] else 0.5 for k in (1, 2, 3))])


def perplexities(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``(doc_id, lang, perplexity)`` of all ``docs`` ``(doc_id, lang, _t)`` under the model of those in ``training`` ``(_i, _l)``; null without a model of the language.

    Groups of texts ask three tables, sharded by key, in compressed blocks: words for their numbers and counts, pairs of words for their counts, words again for
    what the pairs add up to. A history with more than 1/SPLIT of the training tokens is spread over several shards. Only training texts count; texts are not moved.
    """
    groups = grouped(docs)
    size = groups.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    least = min(4 * docs.sparkSession.sparkContext.defaultParallelism, shuffle_width(docs.sparkSession))      # few: blocks of many numbers are smaller
    word_shards, shards = (max(least, x // SHARD_ENTRIES + 1) for x in size)
    each = groups.select("b", "lang", F.posexplode("doc_id").alias("at", "_id"))
    trained = each.join(training, (F.col("_id") == F.col("_i")) & F.col("lang").eqNullSafe(F.col("_l"))).groupBy("b").agg(F.collect_list("at").alias("trained"))
    flagged = groups.drop("doc_id").join(materialise(trained, "trained"), "b", "left")
    words, tokens = count_words(flagged.drop("lang"), word_shards)
    known = _answers(words, "word_counts")
    pairs = count_pairs(flagged.join(known, "b"), tokens, shards, word_shards)
    kinds = count_kinds(words, pairs)
    discounts = {k: _discounts(n) for k, n in _by_language(pairs, 4).items()}
    lower = {k: (_discounts(n[:4]), n[:4], n[4], n[5]) for k, n in _by_language(kinds, 6).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            g, lang = Group(row), int(_lang_key([row["lang"]]).view(np.int64)[0])
            names, value = [row["lang"]] * len(g.length), pa.nulls(len(g.length), pa.float64())
            if lang in discounts:
                g.pair(row["word_counts"], tokens, shards)
                d, (e, n, total, several) = discounts[lang], lower[lang]
                n1, n2, n3, ends = (g.by_word(x.astype(np.int64)) for x in _joined(row["kinds"], "u4", "u4", "u4", "u4"))
                taken = e[1] * n[0] + e[2] * n[1] + e[3] * (several - n[0] - n[1])
                unknown = taken / total / (several + 1)
                low = np.where(ends > 0, (ends - e[np.minimum(ends, 3)]) / total, 0.0) + unknown
                back = np.where(g.count > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(g.count, 1), 1.0)
                p = back[g.first] * low[g.second]
                c = _joined(row["pairs"], "u4")[0].astype(np.int64)
                p[g.asked] += np.where(c > 0, (c - d[np.minimum(c, 3)]) / np.maximum(g.count[g.first[g.asked]], 1), 0.0)
                logs = np.add.reduceat(np.log10(p)[g.inverse], g.begin)
                value = pa.array(10 ** np.minimum(-logs / g.length, 300))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], kind), pa.array(names, pa.string()), value], ["doc_id", "lang", "perplexity"])

    id_type = groups.schema["doc_id"].dataType.elementType
    kind = to_arrow_type(id_type)
    full = groups.join(known, "b").join(_answers(pairs, "pairs"), "b", "left").join(_answers(kinds, "kinds"), "b")
    return full.mapInArrow(run, f"doc_id {id_type.simpleString()}, lang string, perplexity double")


def _level(sizes: list[int], max_docs: int) -> float:
    """The most training documents of one language: half of each one's ``sizes`` up to this number are about ``max_docs``; ``LEAST_DOCS`` at least."""
    left, level = float(max_docs), float(max_docs)
    for k, n in enumerate(sorted(sizes)):
        level = left / (len(sizes) - k)
        if n / 2 > level:
            break
        left -= n / 2
        level = float(max_docs)
    return max(level, float(LEAST_DOCS))


@contextmanager
def _shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """What a step shuffles goes when the step is written: later steps read what was written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def quality(docs: DataFrame, labels: DataFrame, max_docs: int | None = None, quantile: float = 0.995, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, kept)`` for every row of ``docs``.

    Trusted are documents labelled 1. About half of each language's (chosen by md5 of their id) train a word-pair model of it, all the others set its threshold, the
    ``quantile`` of their perplexities. With ``max_docs``, fewer train: of large languages about as many as :func:`_level` leaves each for ``max_docs`` in all.
    A document is kept up to its language's threshold. At least one trusted document trains, and one of several
    does not; a language with one has no threshold, and a language with none has no model either (its perplexities are null): all its documents stay. The model is
    as large as its training texts; its tables are sharded by key (:func:`perplexities`).

    Null text counts as empty, null is a language of its own, repeated rows get equal results, a null id is never
    trusted. An empty table gives an empty result; other columns are not read.
    """
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_i")).distinct()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("_t"))
    of = source.join(trusted, F.col("doc_id") == F.col("_i")).select("_i", F.col("lang").alias("_l")).distinct()
    of = materialise(of.withColumn("_h", unit_hash(F.concat(F.lit("q"), F.col("_i").cast("string")))), "trusted")
    sizes = of.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("low"), F.max("_h").alias("high"))       # one row per language
    share = F.lit(0.5) if max_docs is None else F.least(F.lit(0.5), F.lit(_level([r["n"] for r in sizes.select("n").collect()], max_docs)) / F.col("n"))
    trains = (F.col("_h") == F.col("low")) | ((F.col("_h") < share) & (F.col("_h") < F.col("high")))
    dealt = of.join(F.broadcast(sizes.select(F.col("_l").alias("_k"), "n", "low", "high")), F.col("_l").eqNullSafe(F.col("_k")))
    dealt = materialise(dealt.select("_i", "_l", trains.alias("trains")), "dealt")
    own = (F.col("doc_id") == F.col("_i")) & F.col("lang").eqNullSafe(F.col("_l"))
    with _shuffles_end_with_writes(docs.sparkSession):
        scored = materialise(perplexities(source, dealt.where("trains").select("_i", "_l")), "perplexity")
    judged = scored.join(dealt.where("NOT trains"), own, "left_semi")
    cuts = judged.groupBy(F.col("lang").alias("_l")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("q"))
    out = scored.join(F.broadcast(cuts), F.col("lang").eqNullSafe(F.col("_l")), "left")         # one row per language
    return out.select("doc_id", "lang", "perplexity", F.col("q").alias("threshold"), F.coalesce(F.col("perplexity") <= F.col("q"), F.lit(True)).alias("kept"))
