"""Best-fit packing of token sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import numbered, text_or_empty
from .words import regroup

#: Text in which a blank stands before more white space, or at the end. Such texts, and those with strings of added tokens, are encoded whole; in all others every
#: blank begins a new word for the tokenizer, so a text's ids are those of its blank-separated words one after the other.
ODD_BLANKS = " (?:[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
TEXT_BYTES = 8 << 20   # texts are encoded in groups of about this size


class Encoder:
    """Ids of a byte-level BPE vocabulary, the same as the tokenizers library gives without adding special tokens.

    The strings of added tokens that stand in a text are their ids, as in that library (``special=False``: ordinary text). The vocabulary file is that library's; ids are computed by the tiktoken library's encoder over its merges, which is several
    times faster for single words (a test holds the two against each other).
    """

    def __init__(self, path: str, special: bool = True):
        import public_tokenizers
        import tiktoken
        spec = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        added = spec.get("added_tokens", [])
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that match by more than their string are not known here")
        self.added = {t["content"]: t["id"] for t in added} if special else {}
        self.marks = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in {t["content"] for t in added}}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        found = [self.bpe.encode_ordinary(t) for t in texts]
        return self._flat(found)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that may hold the strings of added tokens."""
        if self.marks is None:
            return self.words(texts)
        return self._flat([[i for part in self.marks.split(t) for i in ([self.added[part]] if part in self.added else self.bpe.encode_ordinary(part))] for t in texts])

    @staticmethod
    def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        return flat, sizes


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[starts:starts+sizes], one after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return flat[np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)]


def encode(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, and ids per text. Every distinct word is encoded once."""
    odd = pc.match_substring_regex(texts, ODD_BLANKS).to_numpy(zero_copy_only=False)
    for mark in encoder.added:
        odd = odd | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts) if odd.any() else texts
    parts = pc.split_pattern(plain, " ")
    offsets = np.diff(parts.offsets.to_numpy())
    words = parts.flatten().dictionary_encode()
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(len(index), bool)
    first[np.cumsum(offsets) - offsets] = True
    vocabulary = words.dictionary.to_pylist()
    starters, place = np.unique(index[first], return_inverse=True)
    index[first] = len(vocabulary) + place
    flat, sizes = encoder.words([" " + w for w in vocabulary] + [vocabulary[i] for i in starters])
    starts = np.cumsum(sizes) - sizes
    ids = gather(flat, starts[index], sizes[index])
    counts = np.add.reduceat(sizes[index], np.cumsum(offsets) - offsets) if len(index) else np.zeros(len(texts), np.int64)
    if odd.any():
        where = np.flatnonzero(odd)
        extra, extra_sizes = encoder.whole([texts[i].as_py() for i in where])
        begin = np.cumsum(counts) - counts
        pool = np.concatenate([ids, extra])
        begin[where], counts[where] = len(ids) + np.cumsum(extra_sizes) - extra_sizes, extra_sizes
        ids = gather(pool, begin, counts)
    return ids, counts


def pieces(docs: DataFrame, capacity: int, path: str | None, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; only documents over ``capacity`` are cut, their first piece is the short one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        encoder = Encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        for part in regroup(batches, 1, TEXT_BYTES):
            ids, counts = encode(encoder, part.column(1))
            out: list[list[int]] = [[], [], [], [], []]
            begin = 0
            for row, n in enumerate(counts.tolist()):
                doc = np.append(ids[begin:begin + n], np.uint32(end_id)).astype("<u4")
                begin += n
                start, number = 0, 0
                while start < n + 1:
                    length = (n + 1) % capacity or capacity if not start else capacity
                    for col, v in zip(out, (row, number, start, length, zlib.crc32(doc[start:start + length].tobytes())), strict=True):
                        col.append(v)
                    start, number = start + length, number + 1
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]   # (size, how many), one after the other


def reduce_dominated(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sequences that dominate every other choice for their largest document, taking them out of ``counts``.

    ``counts[s]`` is the number of documents of size s. For a document of size s, with r = capacity - s left:
    nothing fits beside it: it is alone; a document of exactly r exists, or no two documents fit into r together: it goes with
    the largest that fits; no three fit: the largest single document dominates if it is no smaller than the best pair, and the
    best pair dominates if it holds the largest document that fits and no feasible pair has a larger second.
    What is fixed once is fixed for as many equal documents as there are: taking documents away never adds a choice.
    """
    fixed = []

    def take(pattern: dict[int, int]) -> None:
        times = min(counts[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            counts[s] -= n * times
        fixed.append((tuple(sorted(pattern.items(), reverse=True)), times))

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s]:
                r = capacity - s
                counts[s] -= 1
                small: list[int] = []      # the three smallest others
                for t in range(1, r + 1):
                    small += [t] * min(counts[t], 3 - len(small))
                    if len(small) == 3:
                        break
                best = next((t for t in range(r, 0, -1) if counts[t]), 0)
                chosen = None
                if not best:
                    chosen = [s]
                elif best == r or len(small) < 2 or small[0] + small[1] > r:
                    chosen = [s, best]
                elif len(small) < 3 or sum(small) > r:
                    pair = max(((a + b, a, b) for a in range(r, 0, -1) if counts[a] for b in (_fitting(counts, a, r - a),) if b), default=(0, 0, 0))
                    _, a, b = max(pair, (pair[0], pair[2], pair[1]))
                    if best >= pair[0]:
                        chosen = [s, best]
                    elif a == best and not _larger_second(counts, a, b, r):
                        chosen = [s, a, b]
                counts[s] += 1
                if chosen is None:
                    break
                take(Counter(chosen))
                changed = True
    return fixed


def _fitting(counts: list[int], a: int, room: int) -> int:
    """The largest size up to ``room`` left when one document of size a is taken."""
    return next((b for b in range(min(room, a), 0, -1) if counts[b] - (a == b) > 0), 0)


def _larger_second(counts: list[int], a: int, b: int, room: int) -> bool:
    """Whether two documents both larger than b fit into ``room``."""
    above = [t for t in range(b + 1, a + 1) for _ in range(min(counts[t], 2))][:2]
    return len(above) == 2 and sum(above) <= room


def best_fit(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in order of decreasing size, for all documents of a size at once. Bins that are alike form one group."""
    groups: dict[int, list[list]] = {}       # room left: [pattern, how many bins]
    rooms: list[int] = []                    # sorted

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if bins:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append([pattern, bins])

    for s in range(capacity, 0, -1):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                put(capacity - each * s, ((s, each),), n // each)
                if n % each:
                    put(capacity - n % each * s, ((s, n % each),), 1)
                n = 0
                break
            room = rooms[at]
            pattern, bins = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // s
            full = min(bins, n // each)
            rest = bins - full
            put(room - each * s, (*pattern, (s, each)), full)
            n -= full * each
            if rest and n:
                put(room - n * s, (*pattern, (s, n)), 1)
                rest, n = rest - 1, 0
            put(room, pattern, rest)
        counts[s] = 0
    return [(pattern, bins) for found in groups.values() for pattern, bins in found]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Sequences to fill, as (pattern, how often); the size of the plan depends on ``capacity``, not on the number of documents."""
    counts = [0] * (capacity + 1)
    for s, n in histogram.items():
        counts[s] += n
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity)


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: every piece of every document and its place.

    A document is its ids and ``end_id``; null text is empty, so it is ``end_id`` alone. Only a document over ``capacity`` is cut.
    Pieces of one length are interchangeable, so the instance is its histogram (at most ``capacity`` numbers): sequences are
    planned on it, by dominance reduction and then best fit, and Spark hands the places out by each piece's number among
    those of its length. These numbers come from counts per written partition, so a length that very many
    documents share is never in one window. Null ids and repeated rows are packed like any other row; an empty table
    gives an empty result; other columns are not read. ``path`` is the vocabulary file.
    """
    part = materialise(numbered(pieces(docs, capacity, path, end_id, id_col, text_col), "_row").withColumn("_part", F.spark_partition_id()), "pieces")
    sizes = materialise(part.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = part.join(sizes, ["_part", "length"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_part", "length").orderBy("_row")) - 1)

    steps: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in plan(histogram, capacity):
        offset = 0
        for s, each in pattern:
            steps.setdefault(s, []).append((used[s], each, sequence, offset))
            used[s] += each * times
            offset += s * each
        sequence += times
    table = {s: np.array(rows, np.int64) for s, rows in steps.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                mine = length == s
                rows = table[int(s)]
                at = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                k = rank[mine] - at[:, 0]
                seq[mine], off[mine] = at[:, 2] + k // at[:, 1], at[:, 3] + k % at[:, 1] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], out)

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = part.schema["doc_id"].dataType.simpleString()
    return ranked.select(*out[:5], "_rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
