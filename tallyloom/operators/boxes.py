"""Trees of boxes over rows of numbers and codes, and the nearest rows inside one block.

A tree cuts rows in two by the column that varies most (a code column counts as its one-hot columns), again and again. Every node has the
range of its rows' numbers and, where they are few, their codes; the distance of a query to that box bounds those to all its rows.
Matrices have one row per column, so that a column is contiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

LEAF_ROWS = 128     # of the trees inside a block
FEW_CODES = 32      # a box with more codes of a column holds any code
SLICE_ROWS = 8192   # queries compared at a time


def columns_of(array: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column as a matrix (numbers of a row x rows)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    width = len(array[0]) if len(array) else 0
    return np.ascontiguousarray(np.asarray(array.flatten(), dtype).reshape(len(array), width).T)


def slack(bound: np.ndarray) -> np.ndarray:
    """A little more than ``bound``: distances count to nine digits."""
    return bound + 2e-9 + 1e-9 * np.where(np.isfinite(bound), bound, 0.0)


def powers(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray, power: float = 2) -> np.ndarray:
    """Sums of ``power``-th powers of the differences of all rows of a to all rows of b, and what their codes add, column by column (same value in any block)."""
    out = np.zeros((a.shape[1], b.shape[1]))
    for x, y in zip(a, b, strict=True):
        diff = x[:, None] - y[None, :]
        out += diff * diff if power == 2 else np.abs(diff) ** power
    for x, y in zip(ca, cb, strict=True):
        out += np.where(x[:, None] == y[None, :], 0.0, np.where((x[:, None] == 0) | (y[None, :] == 0), 1.0, 2.0))
    return out


def _cut(v: np.ndarray, c: np.ndarray) -> tuple[int, object, np.ndarray] | None:
    """(column, cut, rows on the low side), or None where all rows are equal. The cut of a code column is the set of codes on the low side."""
    with np.errstate(over="ignore", invalid="ignore"):
        spread = [*v.var(axis=1), *(1.0 - ((np.unique(x, return_counts=True)[1] / len(x)) ** 2).sum() for x in c)]
    for column in np.argsort(-np.array(spread), kind="stable"):
        if not spread[column] > 0:
            break
        if column < len(v):
            x = v[column]
            cut = np.median(x)
            low = x <= cut
            if low.all():
                low = x < x.max()
                cut = x[low].max() if low.any() else cut
        else:
            x = c[column - len(v)]
            values, counts = np.unique(x, return_counts=True)
            cut = values[:min(len(values) - 1, 1 + int(np.searchsorted(counts.cumsum(), len(x) / 2)))]
            low = np.isin(x, cut)
        if low.any() and not low.all():
            return int(column), cut, low
    return None


class Tree:
    """Cuts found on ``v`` and ``c`` until a leaf has at most ``size`` of these rows (or equal ones); ``members`` are the rows of every leaf."""

    def __init__(self, v: np.ndarray, c: np.ndarray, size: int):
        self.width, self.nodes, self.members, self.boxes = len(v), [], [], []
        self._grow(v, c, np.arange(v.shape[1]), size)

    def _grow(self, v: np.ndarray, c: np.ndarray, rows: np.ndarray, size: int) -> int:
        node = len(self.nodes)
        self.nodes.append(None)
        found = _cut(v[:, rows], c[:, rows]) if len(rows) > size else None
        if found is None:
            self.nodes[node] = (-1, len(self.members), 0, 0)
            self.members.append(rows)
        else:
            column, cut, low = found
            self.nodes[node] = (column, cut, self._grow(v, c, rows[low], size), self._grow(v, c, rows[~low], size))
        return node

    def find(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, stack = np.zeros(v.shape[1], np.int64), [(0, np.arange(v.shape[1]))]
        while stack:
            node, rows = stack.pop()
            column, cut, left, right = self.nodes[node]
            if column < 0:
                out[rows] = cut
                continue
            low = v[column, rows] <= cut if column < self.width else np.isin(c[column - self.width, rows], cut)
            stack += [(child, part) for child, part in ((left, rows[low]), (right, rows[~low])) if len(part)]
        return out

    def fit(self, low: np.ndarray, high: np.ndarray, codes: Sequence[Sequence[np.ndarray | None]]) -> None:
        """Boxes of the leaves (leaves x columns, and per leaf and code column the codes or None for any), from these those of all nodes."""
        self.boxes = [None] * len(self.nodes)
        for node in reversed(range(len(self.nodes))):
            column, leaf, left, right = self.nodes[node]
            if column < 0:
                self.boxes[node] = (low[leaf], high[leaf], list(codes[leaf]))
                continue
            (la, ha, ca), (lb, hb, cb) = self.boxes[left], self.boxes[right]
            both = [None if x is None or y is None else np.union1d(x, y) for x, y in zip(ca, cb, strict=True)]
            self.boxes[node] = (np.minimum(la, lb), np.maximum(ha, hb), [None if x is None or len(x) > FEW_CODES else x for x in both])

    def _below(self, node: int, v: np.ndarray, c: np.ndarray, power: float) -> np.ndarray:
        low, high, codes = self.boxes[node]
        out = np.zeros(v.shape[1])
        for j, x in enumerate(v):
            gap = np.maximum(np.maximum(low[j] - x, x - high[j]), 0.0)
            out += gap * gap if power == 2 else gap ** power
        for x, held in zip(c, codes, strict=True):
            if held is not None:
                out += np.where((x[:, None] == held[None]).any(axis=1), 0.0, np.where((x == 0) | (held == 0).any(), 1.0, 2.0))
        return out

    def reach(self, v: np.ndarray, c: np.ndarray, bound: np.ndarray, power: float) -> Iterator[tuple[int, np.ndarray]]:
        """For every leaf whose box is within ``bound`` of some queries, these."""
        stack = [(0, np.arange(len(bound)))]
        while stack:
            node, rows = stack.pop()
            rows = rows[self._below(node, v[:, rows], c[:, rows], power) <= bound[rows]]
            column, leaf, left, right = self.nodes[node]
            if len(rows) and column < 0:
                yield leaf, rows
            elif len(rows):
                stack += [(left, rows), (right, rows)]


def nearest_in_block(v: np.ndarray, c: np.ndarray, bound: np.ndarray, dv: np.ndarray, dc: np.ndarray, k: int, power: float,
                     same: tuple[np.ndarray, np.ndarray] | None = None, blown: tuple[int, int] = (1, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, donors, powers to nine digits): of each query the k nearest donors within ``bound``, equal ones in the order of the donors.

    ``same``: numbers of the queries and of the donors; a donor with the query's number is left out. ``blown``: sums of powers count
    (and ``bound`` is) times its first number and divided by its second.
    """
    n = len(bound)
    tree = Tree(dv, dc, LEAF_ROWS)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    code = lambda at: [u if len(u := np.unique(x[at])) <= FEW_CODES else None for x in dc]
    tree.fit(np.array([dv[:, m].min(axis=1) for m in tree.members]), np.array([dv[:, m].max(axis=1) for m in tree.members]), [code(m) for m in tree.members])

    def apart(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = powers(v[:, rows], c[:, rows], dv[:, at], dc[:, at], power)
        if blown[0] != blown[1]:
            out = out * blown[0] / blown[1]
        if same is not None:
            out[same[0][rows][:, None] == same[1][at][None, :]] = np.inf
        return out

    for s in range(0, n, SLICE_ROWS):
        part = np.arange(s, min(n, s + SLICE_ROWS))
        limit, home, kept = bound[part].copy(), tree.find(v[:, part], c[:, part]), []
        for leaf in np.unique(home):
            at, rows = tree.members[leaf], np.flatnonzero(home == leaf)
            if len(at) >= k:
                limit[rows] = np.minimum(limit[rows], slack(np.partition(apart(part[rows], at), k - 1, axis=1)[:, k - 1]))
        for leaf, rows in tree.reach(v[:, part], c[:, part], limit * blown[1] / blown[0], power):
            at = tree.members[leaf]
            dist = apart(part[rows], at)
            keep = (dist <= limit[rows][:, None]) & np.isfinite(dist)
            many = np.flatnonzero(keep.sum(axis=1) > k)
            if len(many):                                  # equal ones may be many: the first k of a leaf are enough
                first = np.zeros((len(many), len(at)), bool)
                np.put_along_axis(first, np.argsort(np.round(dist[many], 9), axis=1, kind="stable")[:, :k], True, axis=1)
                keep[many] &= first
            r, j = np.nonzero(keep)
            kept.append((part[rows[r]], at[j], np.round(dist[r, j], 9)))
        if kept:
            row, donor, dist = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((donor, dist, row))
            row, donor, dist = row[order], donor[order], dist[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((row[best], donor[best], dist[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
