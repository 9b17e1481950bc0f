"""Removing repeated passages: suffixes are ordered by most-significant-digit passes through the threshold length only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import fixed, located, text_or_empty
from .words import mix

GROUP_BYTES = 1 << 21     # bytes hashed at once; a longer text is taken in slices that overlap by the threshold length
POSITION = np.uint64((1 << 22) - 1)
CORE = 32                 # bytes of the first digit

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of any substring of a buffer: sums of byte values times powers modulo 2^64, shifted back to power 0."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if len(Rolling.powers) < n:
            Rolling.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            Rolling.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * Rolling.powers[:n - 1])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * Rolling.inverse[:len(self.sums) - size])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by minima from the start and to the end of blocks of that width."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts one after the other: (bytes, row in the batch, start in the bytes, end, offset of start in its text).

    Texts are grouped to about GROUP_BYTES; longer ones come in slices that begin every GROUP_BYTES and overlap by length - 1.
    """
    texts = batch.column(batch.schema.get_field_index("_t")).cast(pa.binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def joined():
        ends = np.cumsum([len(b) for _, _, b in group])
        return (np.concatenate([b for _, _, b in group]), np.array([r for r, _, _ in group]), np.concatenate([[0], ends[:-1]]), ends, np.array([o for _, o, _ in group]))

    for row, size in enumerate(sizes.tolist()):
        if size < length:
            continue
        raw = np.frombuffer(texts[row].as_buffer(), np.uint8)
        for at in range(0, max(1, size - length + 1), GROUP_BYTES):
            part = raw[at:at + GROUP_BYTES + length - 1]
            if held and held + len(part) > GROUP_BYTES + length:
                yield joined()
                group, held = [], 0
            group.append((row, at, part))
            held += len(part)
    if group:
        yield joined()


def _starts(begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """All starts of whole windows."""
    n = np.maximum(0, end - begin - length + 1)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _once(key: np.ndarray, also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its key, repeated here) for every entry."""
    order = np.lexsort((also, key))
    same = (key[order][1:] == key[order][:-1]) & (also[order][1:] == also[order][:-1])
    after, before = np.concatenate([[False], same]), np.concatenate([same, [False]])
    first, repeated = np.empty(len(key), bool), np.empty(len(key), bool)
    first[order], repeated[order] = ~after, after | before
    return first, repeated


def runs_by_digit(rows: DataFrame, length: int) -> DataFrame:
    """``(_row, lo, hi, core, ctx, dup)``: runs of suffixes [lo, hi] of a text that have their first digit at one place.

    The first digit of a suffix is the least hashed ``CORE``-gram of its first ``length`` bytes (the leftmost of equal ones), so equal
    ``length``-byte strings have the same digit at the same offset. Neighbouring suffixes share it: one row stands for up
    to length - CORE + 1 of them. ``ctx`` is a hash of all bytes the run covers and of the offset. Of rows that are equal in a
    group of texts one is passed on to be compared, and all of them are marked as repeated (``dup``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for raw, owner, begin, end, offset in slices(batch, length):
                h = Rolling(raw)
                grams = h.grams(CORE)
                least = sliding_min((grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64), length - CORE + 1)
                starts = _starts(begin, end, length)
                place = (least[starts] & POSITION).astype(np.int64)
                cut = np.flatnonzero((place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
                lo, hi = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
                place = place[np.concatenate([[0], cut])]
                core = mix(grams[place] + np.uint64(1))
                ctx = mix(h(lo, hi + length) + (place - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                first, dup = _once(core, ctx)
                slot = np.searchsorted(end, lo, "right")
                row = ids.take(pa.array(owner[slot]))
                spread = mix(ctx ^ mix(row.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(31) + lo.astype(np.uint64)))
                core = np.where(first, core, spread)
                shift = offset[slot] - begin[slot]
                yield pa.RecordBatch.from_arrays([row, pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)), pa.array(core.view(np.int64)),
                                                  pa.array(ctx.view(np.int64)), pa.array(dup)], ["_row", "lo", "hi", "core", "ctx", "dup"])
    return rows.mapInArrow(run, "_row long, lo int, hi int, core long, ctx long, dup boolean")


def packed(rows: DataFrame) -> DataFrame:
    """Texts compressed one by one, to be moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([pack(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())],
                                             [*batch.schema.names[:-1], "_z"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, _z binary")


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    unpack = zstandard.ZstdDecompressor().decompress
    at = batch.schema.get_field_index("_z")
    return batch.set_column(at, "_t", pa.array(map(unpack, batch.column(at).to_pylist()), pa.binary()))


def strings(rows: DataFrame, length: int) -> DataFrame:
    """``(core, _row, start, hs[], dups[])`` for the runs ``at`` of each text: hashes of the first ``length`` bytes of their suffixes.

    Suffixes of one run stay together up to the shard of their first digit, where they are taken apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_unpacked, batches):
            ids, wanted = batch.column(0), batch.column(2).to_pylist()
            for raw, owner, begin, end, offset in slices(batch, length):
                h = Rolling(raw)
                spans, cores, who = [], [], []
                for r, b, e, o in zip(owner, begin, end, offset, strict=True):
                    for x in wanted[r]:
                        lo, hi = max(x["lo"] - o, 0) + b, min(x["hi"] - o + b, e - length)
                        if lo <= hi:
                            spans.append((lo, hi, lo - b + o))
                            cores.append(x["core"])
                            who.append(r)
                if not spans:
                    continue
                span = np.array(spans, np.int64)
                starts = _starts(span[:, 0], span[:, 1] + length, length)
                key = h(starts, starts + length)
                first, dup = _once(key, np.zeros(len(key), np.int8))
                row = ids.take(pa.array(np.array(who)))
                sizes = span[:, 1] - span[:, 0] + 1
                spread = mix(key ^ mix(np.repeat(row.to_numpy(zero_copy_only=False), sizes).astype(np.uint64) * np.uint64(31) + starts.astype(np.uint64)))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cores, pa.int64()), row, pa.array(span[:, 2].astype(np.int32)),
                                                  pa.ListArray.from_arrays(ends, pa.array(np.where(first, key, spread).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(dup))],
                                                 ["core", "_row", "start", "hs", "dups"])
    return rows.mapInArrow(run, "core long, _row long, start int, hs array<long>, dups array<boolean>")


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256)`` for every row: the bytes covered by a ``length``-byte string that starts elsewhere, too.

    Suffixes are ordered only through ``length`` bytes, by passes from the most significant digit on, and a suffix
    that is alone after a pass is done. The first digit is the least ``CORE``-gram of these bytes, for a run of neighbouring suffixes at
    once; the second the whole run: runs that are equal are repeated as a whole. Only runs that share the first digit and not the
    second go on, and are taken apart into single suffixes, whose remaining bytes are the last digit. Equal groups after it are
    exactly the repeated strings. In every pass equal entries of one group of texts count once, so a passage
    that a third of the texts share reaches a task once per group. Digits are compared as 64-bit hashes, below a 64-bit first digit.

    Texts are UTF-8 bytes, null is empty, and matches never cross texts. All copies of a repeated string are removed, also
    overlapping ones and those within one text. Repeated rows repeat each other. Null ids are kept; an empty table
    gives an empty result; other columns are not read. ``spans`` are (start, end) byte positions.
    """
    docs = fixed(docs)
    rows = located(docs, "_row", F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t")).select("doc_id", "_t", "_row")
    by_core = Window.partitionBy("core").orderBy("ctx")
    before, after = F.lag("ctx").over(by_core), F.lead("ctx").over(by_core)
    marked = runs_by_digit(rows.select("_row", "_t"), length).withColumn("before", before).withColumn("after", after)
    whole = F.col("dup") | F.coalesce(F.col("before") == F.col("ctx"), F.lit(False)) | F.coalesce(F.col("after") == F.col("ctx"), F.lit(False))
    mixed = F.coalesce(F.col("before") != F.col("ctx"), F.lit(False)) | F.coalesce(F.col("after") != F.col("ctx"), F.lit(False))
    marked = materialise(marked.select("_row", "lo", "hi", "core", whole.alias("whole"), mixed.alias("apart")).where("whole OR apart"), "runs")

    wanted = marked.where("apart").groupBy("_row").agg(F.collect_list(F.struct("lo", "hi", "core")).alias("at"))      # at most the length of a text
    single = strings(packed(rows.select("_row", "_t")).join(wanted, "_row"), length).repartition("core")
    single = single.select("core", "_row", "start", F.posexplode(F.arrays_zip("hs", "dups")).alias("k", "x"))
    single = single.select("core", "_row", (F.col("start") + F.col("k")).alias("start"), F.col("x.hs").alias("h"), F.col("x.dups").alias("dup"))
    same = Window.partitionBy("core", "h").orderBy("_row")
    hit = F.col("dup") | F.lag("_row").over(same).isNotNull() | F.lead("_row").over(same).isNotNull()
    single = single.withColumn("hit", hit).where("hit").groupBy("_row").agg(F.collect_list("start").alias("single"))
    runs = marked.where("whole").groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    found = materialise(runs.join(single, "_row", "full"), "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_unpacked, batches):
            out: list[list] = [[], [], [], []]
            for text, runs, single in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                change = np.zeros(len(text) + 1, np.int32)
                if runs:
                    span = np.array([(x["lo"], x["hi"]) for x in runs])
                    np.add.at(change, span[:, 0], 1)
                    np.add.at(change, span[:, 1] + length, -1)
                if single:
                    np.add.at(change, np.array(single), 1)
                    np.add.at(change, np.array(single) + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                kept = text if not len(edge) else np.frombuffer(text, np.uint8)[~gone].tobytes()
                for col, v in zip(out, (len(text), len(text) - len(kept), [{"start": int(a), "end": int(b)} for a, b in edge], hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(v)
            spans = pa.array(out[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), spans, pa.array(out[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    full = packed(rows.select("doc_id", "_row", "_t")).join(found, "_row", "left").select("doc_id", "_z", "runs", "single")
    return full.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string")
