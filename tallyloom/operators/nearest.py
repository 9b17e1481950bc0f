"""Exact k nearest rows in a feature space, as a pruned block join.

Neither side is broadcast and no pairs are emitted beyond the k best per block:

1. a bounded sample of the donors gives a tree of cuts per group (``boxes.py``); every donor goes to a leaf, and the ranges of the leaves'
   numbers and their codes are kept: at most MAX_LEAVES rows (and one per group), whatever the number of donors;
2. a query is compared with the leaf it falls into first. The k-th distance found there is a bound, and the query is sent on only to
   leaves whose box is within it;
3. (leaf, chunk of queries) pairs of bounded size are the tasks' work; a leaf that equal numbers have made too long is cut by a hash.
   Inside a pair a small tree of the donors leaves a query with a few hundred comparisons, and k rows per query are sent on;
4. the k best over all blocks are kept (group limit before the shuffle).

Codes count like one-hot columns: two different known codes add 2 to the squared distance, a known against an
unknown one adds 1. Equal distances (to nine digits) are ordered by donor id.

In many dimensions boxes prune nothing. There, donors go to the cell of the nearest of a fixed number of pivots, large cells are cut into
rings by distance to the pivot, and the triangle inequality bounds the distances of a ring. Donors are product-quantised: each coordinate becomes one byte, by quantile cuts, and the
donor keeps its distance to the point that its bytes stand for. Blocks hold bytes only. The
distance of a query to that point, plus and minus the donor's, bounds the true one from both sides: a block sends on only donors
whose lower bound is within the k-th upper bound, and these alone are compared by their full vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ..session import materialise
from .boxes import FEW_CODES, Tree, columns_of, nearest_in_block, powers, slack
from .grouping import first_rows

BLOCK_ROWS = 4096      # donors, and queries, compared in one task step
MAX_LEAVES = 4096      # of all trees, but one per group at least
LEAF_SAMPLE = 32       # donors looked at per leaf when the cuts are made
LEAF_ROWS = (4096, 16384)   # donors in a leaf, for few and for many of them
ROUTED_ROWS = 1 << 16  # queries or donors sent on at a time
MAX_TASKS = 4096       # of one comparison
TASK_QUERIES = 4096    # compared in a task, where there are many
MAX_PIVOTS = 1024
MAX_RINGS = 256        # per cell
SAMPLE_ROWS = 200_000  # queries looked at when sizing the chunks
WIDE = 16              # coordinates from which on donors are quantised
LEVELS = 256           # values of a coordinate's byte
QUERY_TILE, DONOR_TILE = 256, 2048   # bounded at a time
KEYS = ["_slot", "_block", "_chunk"]


def _matrix(col: pd.Series, dtype=np.float64) -> np.ndarray:
    width = len(col.iloc[0]) if len(col) else 0
    return np.concatenate(col.to_numpy()).astype(dtype).reshape(len(col), width) if width else np.empty((len(col), 0), dtype)


def _codes_apart(ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ca), len(cb)))
    for j in range(ca.shape[1]):
        x, y = ca[:, j, None], cb[None, :, j]
        out += np.where(x == y, 0.0, np.where((x == 0) | (y == 0), 1.0, 2.0))
    return out


class Quantiser:
    """One byte per coordinate. ``points[j, b]`` is the value that byte b of coordinate j stands for; the cuts come from one aggregate over the donors."""

    def __init__(self, donors: DataFrame, width: int):
        probs = F.array(*[F.lit(i / LEVELS) for i in range(1, LEVELS)])
        one = [F.get("_v", F.lit(j)) for j in range(width)]
        row = donors.agg(F.array(*[F.min(x) for x in one]).alias("lo"), F.array(*[F.max(x) for x in one]).alias("hi"), *[F.percentile_approx(x, probs, 2000).alias(f"c{j}") for j, x in enumerate(one)]).first()
        self.cuts = np.array([row[f"c{j}"] for j in range(width)], float)
        edges = np.concatenate([np.array(row["lo"], float)[:, None], self.cuts, np.array(row["hi"], float)[:, None]], axis=1)
        self.points = (edges[:, 1:] + edges[:, :-1]) / 2

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v[:, j]) for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.stack([self.points[j, code[:, j]] for j in range(code.shape[1])], axis=1)

    def bounds(self, q: np.ndarray, cq: np.ndarray, code: np.ndarray, off: np.ndarray, cd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower and upper bounds of the distances of queries to donors with these bytes, which are ``off`` from their points."""
        return self._bounds(q, cq, self.decode(code), off, cd)

    def _bounds(self, q: np.ndarray, cq: np.ndarray, points: np.ndarray, off: np.ndarray, cd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (q * q).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None]
        apart = np.sqrt(np.maximum(0.0, size - 2 * q @ points.T))
        slack = off[None] + 1e-7 * np.sqrt(1.0 + size)               # rounding of the matrix product
        codes = _codes_apart(cq, cd)
        return np.maximum(0.0, apart - slack) ** 2 + codes, (apart + slack) ** 2 + codes

    def within(self, q: np.ndarray, cq: np.ndarray, limit: np.ndarray, code: np.ndarray, off: np.ndarray, cd: np.ndarray, k: int,
               same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """(queries, donors, upper, lower bounds) of a block: all donors whose lower bound is within ``limit`` and the k-th upper bound of the block.

        Tiles of QUERY_TILE x DONOR_TILE are held at a time, and of each tile what the bound found so far leaves. ``same``: numbers of queries and donors; equal ones are left out.
        """
        points, found = self.decode(code), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for s in range(0, len(q), QUERY_TILE):
            at, kept = slice(s, s + QUERY_TILE), []
            far, best = limit[at].copy(), np.full((len(q[at]), k), np.inf)
            for t in range(0, len(points), DONOR_TILE):
                to = slice(t, t + DONOR_TILE)
                low, up = self._bounds(q[at], cq[at], points[to], off[to], cd[to])
                if same is not None:
                    equal = same[0][at][:, None] == same[1][to][None, :]
                    low[equal], up[equal] = np.inf, np.inf
                best = np.partition(np.concatenate([best, up], axis=1), k - 1, axis=1)[:, :k]
                far = np.minimum(far, best[:, k - 1])
                r, j = np.nonzero((low <= far[:, None] + 1e-8) & np.isfinite(low))
                kept.append((r, t + j, up[r, j], low[r, j]))
            r, j, up, low = (np.concatenate(x) for x in zip(*kept, strict=True))
            left = low <= far[r] + 1e-8
            found.append((s + r[left], j[left], up[left], low[left]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _side(df: DataFrame, key: str, out: str, vec: str, cats: str | None, group, extra: Sequence[str]) -> DataFrame:
    codes = F.col(cats) if cats else F.array().cast("array<bigint>")
    df = df.select(F.col(key).alias(out), F.col(vec).cast("array<double>").alias("_v"), codes.alias("_c"), group, *extra)
    return df.where(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))


def nearest(queries: DataFrame, donors: DataFrame, k: int, qid: str, did: str, vec: str = "vec",
            cats: str | None = None, group: str | None = None, groups: str | None = None, exclude_same: bool = False,
            carry: Sequence[str] = (), block_rows: int | None = None, pivots: int | None = None, power: float = 2, wide: int = WIDE) -> DataFrame:
    """Rows ``(qid, did, distance, rank, *carry)``: the k nearest donors of each query.

    ``vec``: array<double>; rows with a missing vector or a gap in it have no neighbours and are none; ``cats``: array<bigint> of hashed codes, 0 = unknown. ``group``: donor
    column (text) restricting who is comparable, ``groups``: query column with the list of groups it may use;
    the number of groups must be small (years, folds, gap patterns). ``exclude_same``: a row is no neighbour
    of itself. A query id may come in several rows (other vectors for other groups): its best k overall are kept.
    ``power``: that of the Minkowski distance (1: sum of differences). Vectors of at least ``wide`` numbers are quantised (for power 2).
    """
    need = k + int(exclude_same)
    g_donor = (F.col(group).cast("string") if group else F.lit("")).alias("_g")
    g_query = (F.col(groups).cast("array<string>") if groups else F.array(F.lit(""))).alias("_gs")
    # Of equal donors only the first few ids can be among the k best, so copies never pile up in a cell.
    d = first_rows(_side(donors, did, "_d", vec, cats, g_donor, carry), ["_g", "_v", "_c"], ["_d"], need)
    d = materialise(d.withColumns({"_di": F.monotonically_increasing_id(), "_h": _hash("_d")}), "donors")
    q = materialise(_side(queries, qid, "_q", vec, cats, g_query, ()).withColumns({"_h": _hash("_q"), "_qi": F.monotonically_increasing_id()}), "queries")
    result = T.StructType([T.StructField("_q", q.schema["_q"].dataType), T.StructField("_d", d.schema["_d"].dataType), T.StructField("_dist", T.DoubleType()), *[d.schema[c] for c in carry]])
    n_donors, width = d.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    if n_donors == 0:
        found = donors.sparkSession.createDataFrame([], result).withColumn("rank", F.lit(0))
    elif width >= wide and power == 2:
        found = _quantised(q, d, k, n_donors, width, exclude_same, carry, block_rows or BLOCK_ROWS, pivots)
    else:
        found = _boxed(q, d, k, n_donors, result, exclude_same, carry, block_rows, power)
    return found.select(F.col("_q").alias(qid), F.col("_d").alias(did), F.col("_dist").alias("distance"), "rank", *carry)


def _hash(key: str) -> Column:
    return F.abs(F.xxhash64(key).bitwiseAND(F.lit((1 << 31) - 1)))


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: int, routed: int) -> PandasCogroupedOps:
    """Both sides by ``keys`` in as many tasks as ``routed`` queries are worth, of ``pairs`` key values: their work is far more than their bytes tell, so these do not decide."""
    n = max(1, min(pairs, MAX_TASKS, max(left.sparkSession.sparkContext.defaultParallelism, routed // TASK_QUERIES)))
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys))


def _read(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a row of zeros where there are none) and codes, columns x rows."""
    v = columns_of(table.column("_v"))
    return v if len(v) else np.zeros((1, table.num_rows)), columns_of(table.column("_c"), np.int64)


def _sent(batch: pa.RecordBatch, names: Sequence[str], rows: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """Rows of the batch, repeated as asked, with more columns of whole numbers."""
    part = batch.select(list(names)).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*part.columns, *[pa.array(np.asarray(x).astype(np.int32)) for x in more.values()]], names=[*names, *more])


def _gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays put together to about ROUTED_ROWS at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= ROUTED_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class Forest:
    """One tree of boxes per group; a slot is a leaf of one of them."""

    def __init__(self, d: DataFrame, leaf_rows: int):
        modulus = max(1, leaf_rows // LEAF_SAMPLE)
        count = {r["_g"]: r["n"] for r in d.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
        sample: dict = {g: ([], []) for g in count}
        for r in d.where(F.col("_h") % modulus == 0).select("_g", "_v", "_c").collect():       # about n_donors / modulus rows, bounded with the leaves
            sample[r["_g"]][0].append(r["_v"])
            sample[r["_g"]][1].append(r["_c"])
        matrix = lambda rows, kind: np.array(rows, kind).reshape(len(rows), -1).T if rows else np.zeros((0, 0), kind)
        self.trees, self.first, self.slots = {}, {}, 0
        for g in sorted(count, key=count.get):                                                 # the largest last: queries begin there
            v, c = matrix(sample[g][0], float), matrix(sample[g][1], np.int64)
            v = v if len(v) else np.zeros((1, c.shape[1]))
            self.trees[g], self.first[g] = Tree(v, c, max(1, leaf_rows // modulus)), self.slots
            for leaf in range(len(self.trees[g].members)):
                self.trees[g].members[leaf] = ()
            self.slots += len(self.trees[g].members)

    def find(self, batch: pa.RecordBatch) -> np.ndarray:
        """The slot of each donor."""
        v, c = _read(batch)
        names, out = batch.column("_g").to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int64)
        for g in set(names.tolist()):
            rows = np.flatnonzero(names == g)
            out[rows] = self.first[g] + self.trees[g].find(v[:, rows], c[:, rows])
        return out

    def fit(self, a: DataFrame) -> np.ndarray:
        """Boxes of all trees from the donors with their slots; rows per slot."""
        width, codes = a.agg(F.max(F.size("_v")), F.max(F.size("_c"))).first()
        one = [F.get("_v", F.lit(j)) for j in range(width)] or [F.lit(0.0)]
        n, held = np.zeros(self.slots, np.int64), [[None] * codes for _ in range(self.slots)]
        low, high = np.full((self.slots, len(one)), np.inf), np.full((self.slots, len(one)), -np.inf)
        for r in a.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(x) for x in one]).alias("lo"), F.array(*[F.max(x) for x in one]).alias("hi")).collect():
            n[r["_slot"]], low[r["_slot"]], high[r["_slot"]] = r["n"], r["lo"], r["hi"]
        if codes:
            some = a.select("_slot", F.posexplode("_c").alias("at", "code")).distinct().groupBy("_slot", "at").agg(F.collect_list("code").alias("codes")).where(F.size("codes") <= FEW_CODES)
            for r in some.collect():                                                           # slots x code columns rows
                held[r["_slot"]][r["at"]] = np.array(r["codes"], np.int64)
        for g, tree in self.trees.items():
            at = slice(self.first[g], self.first[g] + len(tree.members))
            tree.fit(low[at], high[at], held[at])
        return n

    def allowed(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Queries by the group that they may use."""
        lists = batch.column("_gs")
        names, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        found = {g: row[names == g] for g in self.trees}
        return {g: rows for g, rows in found.items() if len(rows)}

    def home(self, batch: pa.RecordBatch, v: np.ndarray, c: np.ndarray, allowed: dict[str, np.ndarray]) -> np.ndarray:
        """The slot that a query falls into, in the largest of its groups; -1 where it has none."""
        groups, best, out = list(allowed), np.full(batch.num_rows, -1), np.full(batch.num_rows, -1, np.int64)
        for i, g in enumerate(groups):
            best[allowed[g]] = i
        for i, g in enumerate(groups):
            rows = np.flatnonzero(best == i)
            out[rows] = self.first[g] + self.trees[g].find(v[:, rows], c[:, rows])
        return out


def _boxed(q: DataFrame, d: DataFrame, k: int, n_donors: int, result: T.StructType, exclude_same: bool, carry: Sequence[str], block_rows: int | None, power: float) -> DataFrame:
    """Nearest donors by trees of boxes."""
    carry, finite = list(carry), ~F.exists("_v", lambda x: F.abs(x) == float("inf"))      # infinitely far from everything
    q, d = q.where(finite), d.where(finite)
    leaf_rows = block_rows or max(min(max(LEAF_ROWS[0], n_donors // 64), LEAF_ROWS[1]), n_donors // MAX_LEAVES)
    chunk_rows = block_rows or max(BLOCK_ROWS, leaf_rows)
    forest = Forest(d, leaf_rows)
    if not forest.slots:
        return d.sparkSession.createDataFrame([], result).withColumn("rank", F.lit(0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _sent(batch, batch.schema.names, np.arange(batch.num_rows), _slot=forest.find(batch) if batch.num_rows else np.zeros(0))

    slot = T.StructField("_slot", T.IntegerType())
    a = materialise(d.mapInArrow(assign, T.StructType([*d.schema.fields, slot])), "assigned")
    blocks = -(-forest.fit(a) // (4 * leaf_rows))
    modulus = max(1, -(-q.count() // SAMPLE_ROWS))
    at = [slot, T.StructField("_block", T.IntegerType()), T.StructField("_chunk", T.IntegerType())]
    found_type = T.StructType([T.StructField("_qi", T.LongType()), *result.fields])

    def visits(batch: pa.RecordBatch, home: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row numbers, slots, blocks): the first block that a query is compared with, or all others that may hold one of its nearest."""
        if not batch.num_rows:
            return
        v, c = _read(batch)
        allowed = forest.allowed(batch)
        first = forest.home(batch, v, c, allowed)
        if home:
            rows = np.flatnonzero(first >= 0)
            yield rows, first[rows], np.zeros(len(rows), np.int64)
            return
        bound = slack(batch.column("_bound").to_numpy(zero_copy_only=False) ** power)
        for g, rows in allowed.items():
            for leaf, some in forest.trees[g].reach(v[:, rows], c[:, rows], bound[rows], power):
                here, some = forest.first[g] + leaf, rows[some]
                for block in range(blocks[here]):
                    left = some[first[some] != here] if block == 0 else some
                    yield left, np.full(len(left), here), np.full(len(left), block)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        row = donor = np.zeros(0, np.int64)
        dist = np.zeros(0)
        if left.num_rows and right.num_rows:
            right, same, n = right.take(pa.array(right.column("_d").to_pandas().sort_values(kind="stable").index.to_numpy())), None, left.num_rows
            if exclude_same:
                ids = pd.factorize(pd.concat([left.column("_q").to_pandas(), right.column("_d").to_pandas()], ignore_index=True))[0]
                same = np.where(ids[:n] < 0, -2, ids[:n]), ids[n:]                             # a missing id equals none
            bound = slack(left.column("_bound").to_numpy() ** power) if "_bound" in left.schema.names else np.full(n, np.inf)
            row, donor, dist = nearest_in_block(*_read(left), bound, *_read(right), k, power, same)
        some, near = left.select(["_qi", "_q"]).take(pa.array(row)), right.select(["_d", *carry]).take(pa.array(donor))
        return pa.Table.from_arrays([*some.columns, near.column("_d"), pa.array(dist ** (1 / power)), *[near.column(x) for x in carry]], names=[f.name for f in found_type.fields])

    def search(rows: DataFrame, home: bool) -> DataFrame:
        """Compare queries with the blocks they are sent to: k best donors per query and block."""
        def slots_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, slots, _ in _gathered(visits(batch, home)):
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32())], names=["_slot"])

        # How many queries go to each leaf, from a hash sample when there are many. This only sizes the chunks.
        load = {r["_slot"]: r["count"] * modulus for r in rows.where(F.col("_h") % modulus == 0).mapInArrow(slots_only, "_slot int").groupBy("_slot").count().collect()}
        chunks = np.full(len(blocks), 0 if modulus == 1 else 1, dtype=np.int64)                # a leaf that is not asked sends no donors
        for s, n in load.items():
            chunks[s] = max(1, -(-n // (chunk_rows * (1 if home else max(1, blocks[s])))))
        pairs = int(chunks.sum() if home else (chunks * blocks).sum())

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, slots, block in _gathered(visits(batch, home)):
                    yield _sent(batch, asked, row, _slot=slots, _block=block, _chunk=batch.column("_h").to_numpy()[row] % np.maximum(1, chunks[slots]))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = batch.column("_slot").to_numpy()
                block = batch.column("_h").to_numpy() % np.maximum(1, blocks[slots])
                times = np.where((block == 0) | (not home), chunks[slots], 0)
                ends = times.cumsum()
                for s in range(0, int(ends[-1]) if len(ends) else 0, ROUTED_ROWS):
                    place = np.arange(s, min(s + ROUTED_ROWS, ends[-1]))
                    row = np.searchsorted(ends, place, side="right")
                    yield _sent(batch, held, row, _slot=slots[row], _block=block[row], _chunk=place - (ends - times)[row])

        asked = ["_qi", "_q", "_v", "_c", *([] if home else ["_bound"])]
        held = ["_d", "_v", "_c", *carry]
        routed = rows.mapInArrow(route, T.StructType([*[rows.schema[c] for c in asked], *at]))
        spreaded = a.mapInArrow(spread, T.StructType([*[a.schema[c] for c in held], *at]))
        return paired(routed, spreaded, KEYS, pairs, sum(load.values())).applyInArrow(compare, found_type)

    if forest.slots == 1 and blocks[0] == 1:
        return _top(search(q, True), k).drop("_qi")
    found = materialise(search(q, True), "home")
    bound = found.groupBy("_qi").agg(F.max("_dist").alias("_bound"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")
    q = materialise(q.join(bound, "_qi", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf")))), "queries")
    return _top(found.unionByName(search(q, False)), k).drop("_qi")


def _quantised(q: DataFrame, d: DataFrame, k: int, n_donors: int, width: int, exclude_same: bool, carry: Sequence[str], block_rows: int, pivots: int | None) -> DataFrame:
    """Nearest donors by pivots, rings and bytes for the coordinates."""
    need = k + int(exclude_same)
    coder = Quantiser(d, width)
    donor_rows = block_rows * 16
    n_pivots = pivots or min(MAX_PIVOTS, max(1, -(-n_donors // donor_rows)))
    top = d.orderBy(F.xxhash64("_d"), "_d").limit(n_pivots).select("_v", "_c").collect()  # at most MAX_PIVOTS rows
    pv = np.array([r[0] for r in top], dtype=float).reshape(len(top), -1)
    pc = np.array([r[1] for r in top], dtype=np.int64).reshape(len(top), -1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v, c = _matrix(pdf["_v"]), _matrix(pdf["_c"], np.int64)
            cell, dist = np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf))
            for s in range(0, len(pdf), 2048):
                d2 = powers(v[s:s + 2048].T, c[s:s + 2048].T, pv.T, pc.T)
                cell[s:s + 2048] = d2.argmin(axis=1)
                dist[s:s + 2048] = np.sqrt(d2.min(axis=1))
            code = coder.encode(v)
            yield pdf.assign(_cell=cell, _pd=dist, _code=[x.tobytes() for x in code], _off=np.sqrt(((v - coder.decode(code)) ** 2).sum(axis=1)) * (1 + 1e-9))

    coded = [T.StructField("_code", T.BinaryType()), T.StructField("_off", T.DoubleType())]
    a = materialise(d.mapInPandas(assign, T.StructType(
        [*d.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_pd", T.DoubleType()), *coded])), "assigned")
    # ---- cells and rings: small tables on the driver, bounded by groups x pivots (x rings)
    near = first_rows(a.select("_g", "_cell", "_pd"), ["_g", "_cell"], ["_pd"], need) \
        .groupBy("_g", "_cell").agg(F.sort_array(F.collect_list("_pd")).alias("near"))
    cells = a.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_pd").alias("radius")) \
        .join(near, ["_g", "_cell"]).orderBy("_g", "_cell").collect()
    index = {(r["_g"], r["_cell"]): i for i, r in enumerate(cells)}
    cell_group = np.array([r["_g"] for r in cells], dtype=object)
    cell_pivot = np.array([r["_cell"] for r in cells], dtype=np.int64)
    radius = np.array([r["radius"] for r in cells])
    cell_near = np.full((len(cells), need), np.inf)
    for i, r in enumerate(cells):
        cell_near[i, :len(r["near"])] = r["near"]
    by_group = {g: np.flatnonzero(cell_group == g) for g in set(cell_group.tolist())}
    n_rings = min(MAX_RINGS, max(-(-r["n"] // donor_rows) for r in cells))
    cuts = [np.zeros(0)] * len(cells)
    if n_rings > 1:
        # Approximate cuts are good enough: they decide how even the rings are, not what is found.
        probs = F.array(*[F.lit(i / n_rings) for i in range(1, n_rings)])
        for r in a.groupBy("_g", "_cell").agg(F.percentile_approx("_pd", probs, 1000).alias("cuts")).collect():
            cuts[index[(r["_g"], r["_cell"])]] = np.array(r["cuts"])

    def place(pdf: pd.DataFrame) -> np.ndarray:
        """Ring number (cell x n_rings + ring) of each donor."""
        cell = np.array([index[x] for x in zip(pdf["_g"], pdf["_cell"])], dtype=np.int64)
        ring = np.zeros(len(pdf), dtype=np.int64)
        if n_rings > 1:
            dist = pdf["_pd"].to_numpy()
            for c in np.unique(cell):
                at = cell == c
                ring[at] = np.searchsorted(cuts[c], dist[at])
        return cell * n_rings + ring

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_slot": place(pdf).astype(np.int32), "_pd": pdf["_pd"]})

    rings = a.select("_g", "_cell", "_pd").mapInPandas(slots_of, "_slot int, _pd double").groupBy("_slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("_pd").alias("lo"), F.max("_pd").alias("hi")).collect()
    low, high = np.full(len(cells) * n_rings, np.inf), np.full(len(cells) * n_rings, -np.inf)
    blocks = np.zeros(len(cells) * n_rings, dtype=np.int64)
    for r in rings:
        low[r["_slot"]], high[r["_slot"]], blocks[r["_slot"]] = r["lo"], r["hi"], -(-r["n"] // donor_rows)

    def candidates(pdf: pd.DataFrame, home: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, slots): every ring that may hold one of the row's nearest, or (``home``) one close ring."""
        v, c = _matrix(pdf["_v"]), _matrix(pdf["_c"], np.int64)
        given = pdf["_bound"].fillna(np.inf).to_numpy() if "_bound" in pdf else np.full(len(pdf), np.inf)
        rows_out, slots_out = [], []
        labels = pd.Series([tuple(sorted(x)) for x in pdf["_gs"]])
        for label, members in labels.groupby(labels).groups.items():
            found = [by_group[g] for g in label if g in by_group]
            if not found:
                continue
            own, members = np.concatenate(found), np.asarray(members)
            for s in range(0, len(members), 128):
                rows = members[s:s + 128]
                dist = np.sqrt(powers(v[rows].T, c[rows].T, pv.T, pc.T))[:, cell_pivot[own]]
                upper = (dist[:, :, None] + cell_near[own][None]).reshape(len(rows), -1)
                bound = np.partition(upper, need - 1, axis=1)[:, need - 1] if upper.shape[1] >= need \
                    else np.full(len(rows), np.inf)
                bound = np.minimum(bound, given[rows])
                bound = bound + 1e-7 * (1.0 + np.where(np.isfinite(bound), bound, 0.0))
                if home:
                    r, z = np.arange(len(rows)), dist.argmin(axis=1)
                else:
                    r, z = np.nonzero(dist - radius[own][None] <= bound[:, None])
                slot = (own[z] * n_rings)[:, None] + np.arange(n_rings)[None]
                away = np.maximum(dist[r, z][:, None] - high[slot], low[slot] - dist[r, z][:, None])
                if home:
                    pick = away.argmin(axis=1)
                    rows_out.append(rows)
                    slots_out.append(slot[r, pick])
                else:
                    i, j = np.nonzero(away <= bound[r][:, None])
                    rows_out.append(rows[r[i]])
                    slots_out.append(slot[i, j])
        if not rows_out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows_out), np.concatenate(slots_out)

    n_queries = q.count()
    modulus = max(1, -(-n_queries // SAMPLE_ROWS))
    at = [T.StructField(n, T.IntegerType()) for n in ("_slot", "_block", "_chunk")]
    bounded = T.StructType([T.StructField("_qi", T.LongType()), T.StructField("_di", T.LongType()), T.StructField("_ub", T.DoubleType()), T.StructField("_lb", T.DoubleType())])

    def compare_codes(left: pa.Table, right: pa.Table) -> pa.Table:
        """Donors of a block whose lower bound is within the k-th upper bound, for each query."""
        q = d = np.zeros(0, np.int64)
        low = up = np.zeros(0)
        if left.num_rows and right.num_rows:
            same, n = None, left.num_rows
            if exclude_same:
                ids = pd.factorize(pd.concat([left.column("_q").to_pandas(), right.column("_d").to_pandas()], ignore_index=True))[0]
                number = pa.types.is_primitive(left.schema.field("_q").type)               # a missing number equals none
                same = np.where(number & (ids[:n] < 0), -2, ids[:n]), ids[n:]
            limit = np.nan_to_num(left.column("_bound").to_numpy(), nan=np.inf) ** 2 if "_bound" in left.schema.names else np.full(n, np.inf)
            code = np.frombuffer(b"".join(right.column("_code").to_pylist()), np.uint8).reshape(right.num_rows, width)
            q, d, up, low = coder.within(columns_of(left.column("_v")).T, columns_of(left.column("_c"), np.int64).T, limit,
                                         code, right.column("_off").to_numpy(), columns_of(right.column("_c"), np.int64).T, k, same)
        return pa.Table.from_arrays([left.column("_qi").take(pa.array(q)), right.column("_di").take(pa.array(d)), pa.array(up), pa.array(low)], names=[f.name for f in bounded.fields])

    def search(rows: DataFrame, home: bool) -> DataFrame:
        """Compare queries with the blocks they are sent to: k best donors per query and block."""
        def slots_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"_slot": candidates(pdf, home)[1].astype(np.int32)})

        # How many queries go to each ring, from a hash sample when there are many. This only sizes the chunks.
        load = rows.where(F.col("_h") % modulus == 0).mapInPandas(slots_only, "_slot int").groupBy("_slot").count().collect()
        chunks = np.ones(len(blocks), dtype=np.int64)
        for r in load:
            chunks[r["_slot"]] = max(1, -(-r["count"] * modulus // block_rows))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                row, slot = candidates(pdf, home)
                times = np.minimum(blocks[slot], 1) if home else blocks[slot]
                row, slot = np.repeat(row, times), np.repeat(slot, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                out = pdf[asked].iloc[row].reset_index(drop=True)
                out["_slot"], out["_block"] = slot.astype(np.int32), block.astype(np.int32)
                out["_chunk"] = (pdf["_h"].to_numpy()[row] % chunks[slot]).astype(np.int32)
                yield out

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                slot, h = place(pdf), pdf["_h"].to_numpy()
                block, times = h % blocks[slot], chunks[slot]
                if home:
                    times = np.where(block == 0, times, 0)
                row = np.repeat(np.arange(len(pdf)), times)
                out = pdf[held].iloc[row].reset_index(drop=True)
                out["_slot"], out["_block"] = slot[row].astype(np.int32), block[row].astype(np.int32)
                out["_chunk"] = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                yield out

        asked = ["_q", "_qi", "_v", "_c", *(["_bound"] if "_bound" in rows.columns else [])]
        held = ["_d", "_di", "_code", "_off", "_c"]
        routed = rows.mapInPandas(route, T.StructType([*[rows.schema[c] for c in asked], *at]))
        spreaded = a.mapInPandas(spread, T.StructType([*[a.schema[c] for c in held], *at]))
        pairs = int((chunks * np.maximum(1, blocks)).sum())
        return paired(routed, spreaded, KEYS, pairs, pairs * TASK_QUERIES).applyInArrow(compare_codes, bounded)       # a task each

    if n_rings > 1:
        first = kth_upper(search(q, True), k).select("_qi", F.sqrt("_most").alias("_bound"))
        q = materialise(q.join(first, "_qi", "left"), "queries")
    found = materialise(search(q, False), "candidates")
    left = found.join(kth_upper(found, k), "_qi", "left").where(F.col("_most").isNull() | (F.col("_lb") <= F.col("_most") + F.lit(1e-8))).select("_qi", "_di")
    full = left.join(q.select("_qi", "_q", F.col("_v").alias("_qv"), F.col("_c").alias("_qc")), "_qi").join(d.select("_di", "_d", "_v", "_c", *carry), "_di")
    return _top(full.withColumn("_dist", F.sqrt(F.round(exact_square("_qv", "_qc", "_v", "_c"), 9))), k)


def kth_upper(pairs: DataFrame, k: int) -> DataFrame:
    """``(_qi, _most)``: the k-th smallest upper bound of each query that has as many candidates."""
    best = first_rows(pairs.select("_qi", "_ub", "_di"), ["_qi"], ["_ub", "_di"], k)
    return best.groupBy("_qi").agg(F.max("_ub").alias("_most"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")


def exact_square(av: str, ac: str, bv: str, bc: str) -> Column:
    """Squared distance of two vectors with codes, summed in the order of the columns."""
    numbers = F.aggregate(F.zip_with(av, bv, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    apart = F.zip_with(ac, bc, lambda x, y: F.when(x == y, 0.0).when((x == 0) | (y == 0), 1.0).otherwise(2.0))
    return F.aggregate(apart, numbers, lambda s, x: s + x)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_q").orderBy("_dist", "_d")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

