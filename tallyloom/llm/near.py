"""Near-duplicate documents by an inverted join over MinHash signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.network import component_stars
from ..session import materialise
from .common import fixed, fresh, located, text_or_empty
from .words import regroup, shingle_sets

TEXT_BYTES = 8 << 20   # texts are hashed in groups of about this size
BLOCK = 1024           # larger postings and groups are compared in pairs of blocks of about this many nodes
SET_BYTES = 32 << 20   # bytes of shingle sets in a block
FEW = 16               # an element that so many sets share at most is counted by its pairs of sets


def match_threshold(coordinates: int, percent: int, missed: float = 1e-6) -> int:
    """The largest number of equal coordinates that a pair of exactly ``percent`` similarity falls short of with probability at most ``missed``."""
    p, tail, t = percent / 100, 0.0, 0
    while t < coordinates:
        tail += math.comb(coordinates, t) * p ** t * (1 - p) ** (coordinates - t)
        if tail > missed:
            break
        t += 1
    return max(1, t)


def signatures(docs: DataFrame, words: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, _row, n, fp, sig)``: size, fingerprint and MinHash signature of each document's shingle set; null fp and sig for empty sets."""
    rng = np.random.default_rng(20240501)
    mult = rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, coordinates, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, 2, TEXT_BYTES):
            n, fp, sig = [], [], []
            for s in shingle_sets(batch.column(2), words):
                n.append(len(s))
                if not len(s):
                    fp.append(None)
                    sig.append(None)
                    continue
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = np.full(coordinates, np.uint64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(s), 4096):
                    h = (s[None, at:at + 4096] ^ flip[:, None]) * mult[:, None]
                    low = np.minimum(low, (h ^ (h >> np.uint64(31))).min(axis=1))
                sig.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int32()))],
                                             ["doc_id", "_row", "n", "fp", "sig"])

    rows = located(docs, "_row", F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t")).select("doc_id", "_row", "_t")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, _row long, n long, fp binary, sig array<int>")


def _stars(linked: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """``(smallest node, other node)`` for each component of the graph with this adjacency matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in np.argsort(nodes).tolist():
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        for u in queue:
            new = np.flatnonzero(linked[u] & left)
            left[new] = False
            queue += new.tolist()
        edges += [(int(nodes[root]), int(nodes[v])) for v in queue[1:]]
    return edges


def _sides(own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nodes to compare: all with all, or block i with block j."""
    return (np.arange(len(own)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))


def _whole(size: int, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The symmetric matrix of ``size`` nodes from that of left against right."""
    out = np.zeros((size, size), bool)
    out[np.ix_(left, right)] = linked
    return out | out.T


def candidates(postings: DataFrame, t: int, percent: int) -> DataFrame:
    """``(a, b)``: for each posting, its nodes hung on the smallest of those that they are tied to by agreeing in ``t`` coordinates, with sizes
    that allow the similarity.

    ``postings`` is ``(token, node, n, sig)``. A posting of more than ``BLOCK`` nodes is compared in pairs of blocks, each a task's work
    of its own. What comes out of a posting, or of a pair of its blocks, is less than one row per node, however many nodes are alike.
    """
    def linked(n: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.empty((len(left), len(right)), bool)
        for at in range(0, len(left), 64):
            some = left[at:at + 64]
            same = (sig[some][:, None, :] == sig[right][None, :, :]).sum(axis=2)
            x, y = n[some][:, None], n[right][None, :]
            out[at:at + 64] = (same >= t) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block_i, block_j = (batch.column(k).to_numpy() for k in (0, 1))
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            flat = batch.column(2).flatten()
            node, own, n = (flat.field(k).to_numpy() for k in (0, 1, 2))
            sig = flat.field(3).flatten().to_numpy().reshape(len(node), -1)
            starts = np.cumsum(sizes) - sizes
            a, b = [], []
            two = starts[(sizes == 2) & (block_i == block_j)]
            if len(two):
                x, y = n[two], n[two + 1]
                good = ((sig[two] == sig[two + 1]).sum(axis=1) >= t) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
                a.append(node[two[good]])
                b.append(node[two[good] + 1])
            for g in np.flatnonzero((sizes > 2) | (block_i != block_j)).tolist():
                at = slice(starts[g], starts[g] + sizes[g])
                left, right = _sides(own[at], block_i[g], block_j[g])
                edges = _stars(_whole(sizes[g], left, right, linked(n[at], sig[at], left, right)), node[at])
                if edges:
                    x, y = np.array(edges, np.int64).T
                    a.append(x)
                    b.append(y)
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    sized = postings.join(postings.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "token")
    groups = _in_block_pairs(sized, "token").groupBy("token", "i", "j").agg(F.collect_list(F.struct("node", "own", "n", "sig")).alias("members"))      # at most two blocks
    return groups.select("i", "j", "members").mapInArrow(run, "a long, b long")


def _in_block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, node, blocks, ..) with ``own``, once for every pair (i, j) of blocks that the node's block is in."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * common >= ``percent`` * all holds for each of the ``left`` sets against each of the ``right`` ones, by the collisions of their elements."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(element)
    owner, element = owner[often[element] > 1], element[often[element] > 1]
    order = np.lexsort((owner, element))
    owner, element = owner[order], np.unique(element[order], return_inverse=True)[1]
    df = np.bincount(element)
    common = np.zeros((len(sets), len(sets)), np.float32)
    first = np.cumsum(df) - df
    for m in np.unique(df[df <= FEW]).tolist():                   # elements of few sets: their pairs are counted
        members = owner[first[df == m][:, None] + np.arange(m)]
        x, y = np.triu_indices(m, 1)
        for at in range(0, len(members), 1 << 16):
            some = members[at:at + (1 << 16)]
            common += np.bincount((some[:, x] * len(sets) + some[:, y]).ravel(), minlength=len(sets) ** 2).reshape(common.shape)
    common += common.T
    much = np.flatnonzero(df > FEW)                               # elements of many sets: products of 0/1 matrices
    for at in range(0, len(much), 2048):
        some = much[at:at + 2048]
        holds = np.zeros((len(some), len(sets)), np.float32)
        for k, e in enumerate(some.tolist()):
            holds[k, owner[first[e]:first[e] + df[e]]] = 1
        common += holds.T @ holds
    shared = common[np.ix_(left, right)]
    return 100 * shared.astype(np.float64) >= percent * (n[left][:, None] + n[right][None, :] - shared.astype(np.float64))


def confirm(groups: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b)``: links by the full shingle sets, each node hung on the smallest that it is linked to over any number of steps within its group, or
    pair of the group's blocks.

    ``groups`` is ``(comp, node, n, text)``. A group's sets meet in one task if they are at most ``BLOCK`` nodes and ``SET_BYTES``,
    otherwise two blocks of about that size at a time, so that no pair of texts is ever a row.
    """
    def links(nodes: list[int], own: list[int], sets: list[np.ndarray], i: int, j: int) -> list[tuple[int, int]]:
        left, right = _sides(np.array(own), i, j)
        if not len(left) or not len(right) or len(sets) < 2:
            return []
        if len(sets) == 2:
            common = len(np.intersect1d(*sets, assume_unique=True))
            good = 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common)
            return [(min(nodes), max(nodes))] if good else []
        linked = _whole(len(sets), left, right, similar(sets, left, right, percent))
        np.fill_diagonal(linked, False)
        return _stars(linked, np.array(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, own, sets, found = None, [], [], [], []
        for batch in regroup(batches, 5, TEXT_BYTES):
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True)
            for now, mine, node, words_of in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), shingle_sets(batch.column(5), words), strict=True):
                if now != key and key is not None:
                    found += links(nodes, own, sets, *key[1:])
                    nodes, own, sets = [], [], []
                key = now
                nodes.append(node)
                own.append(mine)
                sets.append(words_of)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
                found = []
        if key is not None and (found := links(nodes, own, sets, *key[1:])):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    size = groups.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / SET_BYTES)).alias("blocks"))
    dealt = _in_block_pairs(groups.join(size, "comp"), "comp").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return dealt.select("comp", "i", "j", "own", "node", "text").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, _row, stays)`` for every row of ``docs``.

    Documents are linked when 100 * common shingles >= ``percent`` * all shingles of the two, confirmed on their full sets of
    ``words``-word shingles (A-Z lower-cased). ``component_id`` is the smallest id reachable by links, the document itself included.

    * Documents with equal sets are one class; everything below is about one node per class.
    * A node is posted under each pair (coordinate, value) of its MinHash signature. Linked nodes agree in at least t of the K
      coordinates (but for one pair in a million at the very threshold). So, with every node's pairs in order of how many nodes have them,
      they share one of their K-t+1 rarest: only this prefix is posted. Values that one node alone has come first
      and are skipped: they join nothing, but use up the prefix.
    * Within a posting the collisions of the signatures are counted. Nodes with t collisions are candidates; a posting gives one row per node at
      most (:func:`candidates`), never its pairs, and the components of these rows are the groups in which links can be.
    * A group's full sets meet in one task, or two blocks of them at a time, where all their pairs are compared at once; what comes out is
      one row per node again (:func:`confirm`), and the components of these rows are the result.

    Work inside a posting or group grows with the square of its nodes, in blocks of ``BLOCK``; rows written and moved by the two comparisons
    grow with its nodes, times its blocks. A group is as large as a chain of candidates makes it: texts from one template
    that are less alike than the threshold meet there, too.

    Null text counts as empty; a document without words is linked with nothing and is its own component. Repeated rows and equal texts are in
    one component; rows that share an id are told apart by their place in the files, and ``stays`` marks exactly
    one row per component (one with the smallest id). A null id never names a component unless no other id is in
    it. An empty table gives an empty result; other columns are not read. One text's set has to fit into a task.
    """
    docs = fixed(docs)
    k, t = coordinates, match_threshold(coordinates, percent)
    rows = materialise(signatures(docs, words, k, id_col, text_col), "signatures")
    nodes = materialise(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("_row").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")

    posted = nodes.select("node", F.posexplode("sig").alias("c", "v")).select("node", F.expr("shiftleft(bigint(c), 32) + bigint(v)").alias("token"))
    often = materialise(posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "tokens")
    shared = posted.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))   # at most K per node
    first = f"transform(slice(all, 1, greatest(0, {k - t + 1} - ({k} - size(all)))), x -> x.token)"
    prefix = materialise(shared.select("node", F.expr(first).alias("pre")), "prefixes").select("node", F.explode("pre").alias("token"))
    lonely = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    postings = prefix.join(lonely, "token").join(nodes.select("node", "n", "sig"), "node")
    forest = materialise(candidates(materialise(postings, "postings"), t, percent), "candidates")

    stars = component_stars(forest, "a", "b")
    groups = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "comp")
    groups = materialise(groups.join(nodes.select("node", "n"), "node"), "groups")
    source = located(docs, "node", text_or_empty(text_col).alias("text")).join(groups.hint("merge"), "node")
    links = materialise(confirm(source, words, percent), "links")
    label = component_stars(links, "a", "b").withColumnRenamed("component", "comp")

    named = nodes.select("fp", "node").join(label, "node", "left").select("fp", F.coalesce("comp", "node").alias("comp"))
    members = materialise(rows.select("doc_id", "_row", "n", "fp").join(named, "fp", "left").select("doc_id", "_row", "n", F.coalesce("comp", "_row").alias("comp")), "members")
    first = members.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_row"))).alias("f"), F.min("_row").alias("r"))
    first = first.select("comp", "component_id", F.coalesce("f._row", "r").alias("first_row"))
    out = members.join(first, "comp")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
                      "_row", (F.col("_row") == F.col("first_row")).alias("stays"))


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``; documents without words all stay."""
    docs = fixed(docs)
    row = fresh(docs, "_row")
    stay = near_dedup(docs, **options).where("stays").select(F.col("_row").alias(row))
    return located(docs, row).join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
