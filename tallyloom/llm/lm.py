"""Katz backoff scores of whole texts, from Good-Turing discounted counts in sharded tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise, scratch_path, shuffle_width
from .common import numbered, text_or_empty
from .words import hash_words, mix, regroup, split_words

TEXT_BYTES = 8 << 20      # texts that are counted and looked up together
SHARD_ENTRIES = 1_000_000
SPLIT = 4096              # a history with more than 1/SPLIT of all tokens is spread over several shards
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)   # keys of the end token and of the history before a text
K = 5                     # counts up to K are discounted


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def discounts(n: Sequence[int]) -> np.ndarray:
    """Katz's factors d[0..K] for counts 0..K from the numbers n[1..K+1] of things seen so often; d[0] is not used.

    The discounted counts are Good-Turing's (r+1) n[r+1] / n[r], scaled so that the mass taken away is that of things seen once.
    If these do not all lie between 0 and 1, the range of discounted counts is shortened; if even count 1 has no
    usable factor, half of it is taken away.
    """
    n = [int(x) for x in n]
    for k in range(K, 0, -1):
        if n[1] == 0 or any(n[r] == 0 for r in range(1, k + 1)):
            continue
        last = (k + 1) * n[k + 1] / n[1]
        if last >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (K - k)])
    return np.array([1.0, 0.5, *[1.0] * (K - 1)])


class Unigrams:
    """Discounted probabilities of a token that was counted c times; together with one unknown token they sum to 1."""

    def __init__(self, tokens: int, kinds: int, seen: Sequence[int]):
        self.tokens, self.kinds = tokens, kinds
        self.d = discounts(seen)
        self.unknown = seen[1] / tokens if tokens and 0 < seen[1] < tokens else 1 / (tokens + 1)
        self.total = tokens - sum((1 - self.d[r]) * r * seen[r] for r in range(1, K + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, float)
        factor = np.where(c > K, 1.0, self.d[np.minimum(c, K).astype(int)])
        return np.where(c > 0, (1 - self.unknown) * factor * c / max(self.total, 1e-300), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c, float) + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))


def _ranges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key: equal ranges of its upper 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as token numbers, one row per group of texts: ``(b, doc_id[], held_out[], length[], words, n_words, places, train)``.

    ``words`` are the sorted keys of the group's tokens, ``places`` every token's place among them, the end token included;
    ``train`` how often each was seen in training texts.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), text_or_empty(text_col).alias("_t")), "_row").select("doc_id", "held", "_row", "_t")
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, 3, TEXT_BYTES):
            vocabulary, index, counts = split_words(batch.column(3))
            keys = np.append(hash_words(vocabulary), END)
            order = np.argsort(keys)
            keys, rank = keys[order], np.argsort(order)
            ends = np.cumsum(counts + 1)
            place = np.full(int(ends[-1]), rank[-1], np.int32)
            inside = np.ones(len(place), bool)
            inside[ends - 1] = False
            place[inside] = rank[index]
            train = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False), counts + 1)
            seen = np.bincount(place[train], minlength=len(keys)).astype(np.uint32)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            columns = [pa.array([batch.column(2)[0].as_py()]), one(batch.column(0)), one(batch.column(1)), one(pa.array(counts + 1, pa.int64())),
                       pa.array([_pack(keys)], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([_pack(place)], pa.binary()), pa.array([_pack(seen)], pa.binary()),
                       pa.array([len(place)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["b", "doc_id", "held", "length", "words", "n_words", "places", "train", "n_tokens"])

    return rows.mapInArrow(run, f"b long, doc_id array<{kind.simpleString()}>, held array<boolean>, length array<long>, words binary, n_words long, places binary, train binary, n_tokens long")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` bucketed by ``key``, so that joins on it move only the other side."""
    spark = df.sparkSession
    name = f"tokens_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_width(spark), key).option("path", scratch_path(spark, "tokens")).saveAsTable(name)
    return spark.table(name)


def _slices(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of entries that are sorted by shard."""
    cut = np.flatnonzero(np.diff(shard)) + 1
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(shard)]]), strict=True)] if len(shard) else []


def count_words(groups: DataFrame, shards: int) -> tuple[DataFrame, Unigrams]:
    """``(b, counts)``: for every group the training counts of its words over all groups; and the unigram model."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, words, n, train in zip(*(batch.column(c).to_pylist() for c in ("b", "words", "n_words", "train")), strict=True):
                keys, seen = _unpack(words, n, "u8")[0], _unpack(train, n, "u4")[0]
                for s, lo, hi in _slices(_ranges(keys, shards)):
                    yield pa.RecordBatch.from_pylist([{"s": s, "b": b, "n": hi - lo, "blob": _pack(keys[lo:hi], seen[lo:hi])}], schema)

    schema = pa.schema([("s", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpack(r["blob"], r["n"], "u8", "u4") for r in rows]
        distinct, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(place, np.concatenate([p[1] for p in parts]), len(distinct)).astype(np.uint64)
        out, at = [], 0
        for r in rows:
            out.append({"s": r["s"], "b": r["b"], "blob": _pack(count[place[at:at + r["n"]]]), "stats": None})
            at += r["n"]
        many = np.bincount(np.minimum(count, K + 2).astype(int), minlength=K + 2)[:K + 2].tolist()
        stats = [int(count.sum()), int((count > 0).sum()), *many[1:]]
        return pa.Table.from_pylist([*out, {"s": rows[0]["s"], "b": None, "blob": None, "stats": stats}], answer)

    answer = pa.schema([("s", pa.int64()), ("b", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])
    asked = groups.select("b", "words", "n_words", "train").mapInArrow(ask, "s long, b long, n long, blob binary")
    found = materialise(asked.groupBy("s").applyInArrow(merge, "s long, b long, blob binary, stats array<long>"), "words")
    totals = _totals(found, 2 + K + 1)
    answers = found.where("b IS NOT NULL").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("s", "blob"))).alias("counts"))
    return answers, Unigrams(totals[0], totals[1], [0, *totals[2:]])


def _totals(found: DataFrame, n: int) -> list[int]:
    row = found.where("stats IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(str(i)) for i in range(n)]).first()
    return [int(x) for x in row]


class Pairs:
    """The different (history, token) pairs of a group of texts, in the order of the shards they are counted in."""

    def __init__(self, b: dict, unigrams: Unigrams, shards: int):
        n = b["n_words"]
        self.keys = _unpack(b["words"], n, "u8")[0]
        count = np.concatenate([_unpack_counts(x["blob"]) for x in b["counts"]])
        place = _unpack(b["places"], b["n_tokens"], "i4")[0].astype(np.int64)
        self.length = np.array(b["length"])
        self.ends = np.cumsum(self.length)
        begin = self.ends - self.length
        held = np.array(b["held"], bool)
        self.token_count = count[place]
        history = np.empty_like(place)
        history[1:] = place[:-1]
        history[begin] = n
        ends_seen = count[np.searchsorted(self.keys, END)]
        self.word_counts = np.append(count, ends_seen)                     # the history before a text is seen once per training text
        history *= n
        history += place
        del place
        pair, inverse = np.unique(history, return_inverse=True)
        del history
        first, second = pair // n, pair % n
        h1, self.h2 = np.append(self.keys, BEGIN)[first], self.keys[second]
        c1 = self.word_counts[first]
        ways = np.maximum(1, -(-c1 * SPLIT // max(1, unigrams.tokens))).astype(np.uint64)
        salt = np.where(ways > 1, mix(self.h2) % ways, np.uint64(0))
        shard = _ranges(mix(h1 ^ mix(salt + np.uint64(1))), shards)
        order = np.lexsort((self.h2, h1, shard))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.inverse = rank[inverse]                                        # place of each token's pair
        self.h1, self.h2, self.shard, self.split = h1[order], self.h2[order], shard[order], (ways > 1)[order]
        self.c1, self.c2 = c1[order], count[second][order]
        self.train = np.bincount(self.inverse[np.repeat(~held, self.length)], minlength=len(order)).astype(np.uint32)


def _unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "u8").astype(np.int64)


def count_pairs(groups: DataFrame, unigrams: Unigrams, shards: int) -> tuple[DataFrame, np.ndarray, dict[int, np.ndarray]]:
    """``(b, pairs)``: what every group needs to know of its pairs; discounts; statistics of the histories that are split."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                p = Pairs(b, unigrams, shards)
                for s, lo, hi in _slices(p.shard):
                    blob = _pack(p.h1[lo:hi], p.h2[lo:hi], p.train[lo:hi], p.c2[lo:hi].astype("u8"), p.split[lo:hi])
                    yield pa.RecordBatch.from_pylist([{"s": s, "b": b["b"], "n": hi - lo, "blob": blob}], schema)

    schema = pa.schema([("s", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        owner, size, blobs = table["b"].to_pylist(), table["n"].to_pylist(), table["blob"].to_pylist()
        parts = [_unpack(blob, n, "u8", "u8", "u4", "u8", "?") for blob, n in zip(blobs, size, strict=True)]
        h1, h2, train, c2, split = (np.concatenate([p[i] for p in parts]) for i in range(5))
        del parts, blobs
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        r = np.bincount(place, train).astype(np.int64)
        h, c, cut = a[new], c2[order][new], split[order][new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))     # of each history's pairs
        which = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        stats = np.zeros((len(start), K + 2))
        for j in range(1, K + 1):
            stats[:, j - 1] = np.add.reduceat((r == j).astype(float), start)
        stats[:, K] = np.add.reduceat(np.where(r > K, r, 0).astype(float), start)
        stats[:, K + 1] = np.add.reduceat(np.where(r > 0, unigrams.p(c), 0.0), start)
        low = np.minimum.reduceat(np.where(r > 0, np.minimum(r, K + 1), K + 1), start).astype(np.uint8)
        out, at = [], 0
        for who, n in zip(owner, size, strict=True):
            mine = place[at:at + n]
            at += n
            unseen = r[mine] == 0
            out.append({"s": table["s"][0].as_py(), "b": who, "n": n, "unseen": int(unseen.sum()), "blob": _pack(r[mine].astype("u4"), low[which[mine]], stats[which[mine[unseen]]])})
        many = np.bincount(np.minimum(r, K + 2), minlength=K + 2)[:K + 2].tolist()
        out.append({"s": table["s"][0].as_py(), "stats": many[1:]})
        for i in np.flatnonzero(cut[start]):
            out.append({"s": table["s"][0].as_py(), "history": int(h[start[i]].astype(np.int64)), "parts": stats[i].tolist()})
        return pa.Table.from_pylist(out, answer)

    answer = pa.schema([("s", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("unseen", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64())),
                        ("history", pa.int64()), ("parts", pa.list_(pa.float64()))])
    asked = groups.mapInArrow(ask, "s long, b long, n long, blob binary")
    found = materialise(asked.groupBy("s").applyInArrow(merge, "s long, b long, n long, unseen long, blob binary, stats array<long>, history long, parts array<double>"), "pairs")
    d = discounts([0, *_totals(found, K + 1)])
    sums = found.where("history IS NOT NULL").groupBy("history").agg(*[F.sum(F.col("parts")[i]).alias(f"p{i}") for i in range(K + 2)]).collect()   # at most SPLIT histories
    answers = found.where("b IS NOT NULL").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("s", "n", "unseen", "blob"))).alias("pairs"))
    return answers, d, {r["history"]: np.array(r[1:]) for r in sums}


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    A Katz backoff model of word pairs. A token w after a history h that was seen r > 0 times with it has probability d(r) r / c(h), where d are
    Good-Turing discounts (1 above 5); any other token has alpha(h) P(w), with the discounted unigram probability P and
    alpha(h) = (1 - sum of the first) / (1 - sum of P over the tokens seen after h), so that probabilities sum to 1 exactly. A history
    that was never seen backs off with weight 1, and one whose pairs were all seen more than 5 times counts as seen once more, with an unseen token. Tokens that
    were never seen are one unknown token. The history of the first token is the beginning of the text. Rows whose crc32(id) mod 10
    is 0 are scored but not learned from.

    Counts live in two tables sharded by key: words, then pairs by history. Groups of texts (about 8 MB) ask a shard for their
    different words or pairs, in compressed blocks; the shard adds up what all groups have and answers. A history
    with more than 1/4096 of all tokens is spread over several shards, and its statistics (a few numbers for each of at most 4096 such
    histories) are added up afterwards. Token keys are 64-bit hashes.

    Null text counts as empty: its only token is the end. Repeated rows are learned and scored as often as they occur. A null id
    counts as an empty one (its crc32 is 0, held out). Without training rows every token is unknown. An empty table gives an empty
    result; other columns are not read.
    """
    groups = _bucketed(tokens(docs, id_col, text_col), "b")
    size = groups.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    least = shuffle_width(docs.sparkSession)
    counts, unigrams = count_words(groups, max(least, size[0] // SHARD_ENTRIES + 1))
    named = groups.select("b", "doc_id", "held", "length", "words", "n_words", "places", "n_tokens").join(materialise(counts, "counts"), "b")
    shards = max(least, size[1] // SHARD_ENTRIES + 1)
    pairs, d, hot = count_pairs(named.drop("doc_id"), unigrams, shards)

    def alpha(stats: np.ndarray, c: np.ndarray) -> np.ndarray:
        left = (stats[:, :K] * ((1 - d[1:]) * np.arange(1, K + 1))).sum(axis=1)
        return np.where(left > 0, left / np.maximum(c, 1), 1 / (c + 1)) / (1 - stats[:, K + 1])

    discounted = max((r for r in range(1, K + 1) if d[r] < 1), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = batch.slice(row, 1).to_pylist()[0]
                p = Pairs(b, unigrams, shards)
                r, low, parts = np.empty(len(p.h1), np.uint32), np.empty(len(p.h1), np.uint8), []
                at = 0
                for x in b.pop("pairs"):
                    raw, n, u = zstandard.ZstdDecompressor().decompress(x["blob"]), x["n"], x["unseen"]
                    r[at:at + n], low[at:at + n] = np.frombuffer(raw, "u4", n), np.frombuffer(raw, "u1", n, 4 * n)
                    parts.append(np.frombuffer(raw, "f8", u * (K + 2), 5 * n).reshape(u, K + 2))
                    at += n
                unseen = np.flatnonzero(r == 0)
                stats = np.concatenate(parts)                               # of the histories of pairs that were never seen
                for k in np.flatnonzero(p.split[unseen]):
                    stats[k] = hot[int(p.h1[unseen[k]].astype(np.int64))]
                split = np.flatnonzero(p.split)
                if len(split):
                    kinds, place = np.unique(p.h1[split], return_inverse=True)
                    lowest = [next((j for j in range(1, K + 1) if hot[int(h.astype(np.int64))][j - 1]), K + 1) for h in kinds]
                    low[split] = np.array(lowest, np.uint8)[place]
                flat = low > discounted                                     # nothing after this history is discounted
                logs = d[np.minimum(r, K)] * r / np.maximum(p.c1 + flat, 1)
                logs[r > K] = (r / np.maximum(p.c1 + flat, 1))[r > K]
                c1 = p.c1[unseen]
                logs[unseen] = np.where(c1 > 0, alpha(stats, c1), 1.0) * unigrams.p(p.c2[unseen])
                logs = np.log10(logs)
                first = p.ends - p.length
                known = np.add.reduceat((p.token_count > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_id"], kind), pa.array(b["held"], pa.bool_()), pa.array(p.length), pa.array(known), pa.array(np.full(len(known), unigrams.tokens)),
                     pa.array(np.add.reduceat(unigrams.base(p.token_count), first)), pa.array(np.add.reduceat(logs[p.inverse], first))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = to_arrow_type(groups.schema["doc_id"].dataType.elementType)
    full = named.join(materialise(pairs, "pairs"), "b")
    return full.mapInArrow(run, f"doc_id {groups.schema['doc_id'].dataType.elementType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")
