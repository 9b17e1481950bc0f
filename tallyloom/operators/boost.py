"""Boosted trees for any number of classes: one tree per class and round, grown on the gradients of the softmax.

Spark's own boosting knows two classes. Here numbers become quantile bins and codes their numbers, once; a level of all
classes' trees is one aggregate: every task adds up gradients and curvatures per (class, node, column, bin), a node's sums meet in one small
group, which picks the best cut. Only cuts and leaf values come to the driver; rows keep their running score per class in a written table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .aggregate import impute_simple
from .clean import min_class_size
from .hotdeck import in_share
from .metrics import classification_report

BINS = 32


@dataclass
class Tree:
    """Cuts by node (children of n: 2n+1 up to the cut, 2n+2 above it), leaf values by node."""

    column: dict[int, int] = field(default_factory=dict)
    cut: dict[int, int] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at = np.zeros(len(bins), np.int64)
        for n in sorted(self.column):
            here = at == n
            at[here] = np.where(bins[here, self.column[n]] <= self.cut[n], 2 * n + 1, 2 * n + 2)
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        at, out = self.nodes(bins), np.zeros(len(bins))
        for n, v in self.value.items():
            out[at == n] = v
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _table(col: pd.Series, dtype) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(dtype) if len(col) else np.empty((0, 0), dtype)


class Boosted:
    """Fitted trees. ``rate`` shrinks every leaf; ``ridge`` is added to its curvature; a child has at least ``least`` curvature."""

    def __init__(self, train: DataFrame, num: Sequence[str], cat: Sequence[str], label: str, rounds: int = 10, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0, bins: int = BINS):
        self.num, self.cat, self.rate = list(num), list(cat), rate
        spread = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        # Approximate cuts: they are the places where a tree may cut at all.
        row = train.agg(*[F.percentile_approx(F.col(c).cast("double"), spread, 10000).alias(f"c{i}") for i, c in enumerate(self.num)]).first() if self.num else []
        self.cuts = [np.unique(np.array(r or [], float)) for r in row]
        self.codes = {c: [r[0] for r in train.select(F.col(c).cast("string")).distinct().orderBy(c).collect()] for c in self.cat}        # one row per code
        self.labels = [r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]              # one row per class
        self.trees: list[list[Tree]] = []
        classes, index = len(self.labels), {v: i for i, v in enumerate(self.labels)}
        place = F.coalesce(*[F.when(F.col(label) == v, F.lit(i)) for v, i in index.items()]) if index else F.lit(0)
        state = self._binned(train.where(F.col(label).isNotNull()), [place.cast("int").alias("_y")]).withColumn("_s", F.array(*[F.lit(0.0)] * classes).cast("array<double>"))
        for _ in range(rounds if classes > 1 else 0):
            state = materialise(state, "scores")
            grown = [Tree() for _ in range(classes)]
            live = {(k, 0) for k in range(classes)}
            for level in range(depth):
                live = self._grow(state, grown, live, level, depth, ridge, least)
                if not live:
                    break
            self.trees.append(grown)
            state = self._add(state, grown)

    def _binned(self, df: DataFrame, more: Sequence) -> DataFrame:
        numbers = F.array(*[F.col(c).cast("double") for c in self.num]).cast("array<double>")
        codes = F.array(*[F.col(c).cast("string") for c in self.cat]).cast("array<string>")
        cuts, known = self.cuts, [{v: i + 1 for i, v in enumerate(self.codes[c])} for c in self.cat]
        rows = df.select(*more, numbers.alias("_x"), codes.alias("_k"))
        kept = [f for f in rows.schema.fields if f.name not in ("_x", "_k")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = _table(pdf["_x"], float)
                parts = [np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], "right") + 1) for j, c in enumerate(cuts)]
                parts += [np.array([known[j].get(k[j], 0) for k in pdf["_k"]], np.int64) for j in range(len(known))]
                yield pdf[[f.name for f in kept]].assign(_b=list(np.stack(parts, axis=1).astype(np.int32)) if parts and len(pdf) else [[]] * len(pdf))

        return rows.mapInPandas(run, T.StructType([*kept, T.StructField("_b", T.ArrayType(T.IntegerType()))]))

    def _grow(self, state: DataFrame, grown: list[Tree], live: set, level: int, depth: int, ridge: float, least: float) -> set:
        """Cut the live nodes of one level, or make them leaves; the nodes that go on."""
        widths = [len(c) + 2 for c in self.cuts] + [len(self.codes[c]) + 1 for c in self.cat]
        first, rate = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64), self.rate

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                b, y, p = _table(pdf["_b"], np.int64), pdf["_y"].to_numpy(), softmax(_table(pdf["_s"], float))
                for k, tree in enumerate(grown):
                    at, g, h = tree.nodes(b), p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-16)
                    for n in np.unique(at).tolist():
                        if (k, n) not in live:
                            continue
                        here = at == n
                        sums = held.setdefault((k, n), np.zeros((2, int(first[-1]))))
                        for j in range(b.shape[1]):
                            sums[0, first[j]:first[j + 1]] += np.bincount(b[here, j], g[here], widths[j])
                            sums[1, first[j]:first[j + 1]] += np.bincount(b[here, j], h[here], widths[j])
            for (k, n), s in held.items():
                yield pd.DataFrame({"k": [k], "n": [n], "g": [s[0]], "h": [s[1]]})

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            g, h = _table(pdf["g"], float).sum(axis=0), _table(pdf["h"], float).sum(axis=0)
            total, weight = g[:first[1]].sum(), h[:first[1]].sum()
            found = (1e-9, -1, 0, 0.0, 0.0)
            for j in range(len(widths)):
                left, below = np.cumsum(g[first[j]:first[j + 1]])[:-1], np.cumsum(h[first[j]:first[j + 1]])[:-1]
                both = (below > 0) & (weight - below > 0) & (below >= least) & (weight - below >= least)
                with np.errstate(invalid="ignore", divide="ignore"):
                    gain = np.where(both, left ** 2 / (below + ridge) + (total - left) ** 2 / (weight - below + ridge) - total ** 2 / (weight + ridge), -np.inf)
                if len(gain) and gain.max() > found[0]:
                    at = int(gain.argmax())
                    found = (float(gain[at]), j, at, float(left[at]), float(below[at]))
            return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "n": [int(pdf["n"].iloc[0])], "column": [found[1]], "cut": [found[2]], "g": [total], "h": [weight], "gl": [found[3]], "hl": [found[4]]})

        sums = state.mapInPandas(add, "k int, n int, g array<double>, h array<double>")
        goes = set()
        for r in sums.groupBy("k", "n").applyInPandas(best, "k int, n int, column int, cut int, g double, h double, gl double, hl double").collect():      # classes x nodes of a level
            tree, n = grown[r["k"]], r["n"]
            tree.value.pop(n, None)
            if r["column"] < 0:
                tree.value[n] = -rate * r["g"] / (r["h"] + ridge)
                continue
            tree.column[n], tree.cut[n] = r["column"], r["cut"]
            tree.value[2 * n + 1] = -rate * r["gl"] / (r["hl"] + ridge)
            tree.value[2 * n + 2] = -rate * (r["g"] - r["gl"]) / (r["h"] - r["hl"] + ridge)
            if level + 1 < depth:
                goes |= {(r["k"], 2 * n + 1), (r["k"], 2 * n + 2)}
        return goes

    def _add(self, state: DataFrame, grown: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                b = _table(pdf["_b"], np.int64)
                yield pdf.assign(_s=list(_table(pdf["_s"], float) + np.stack([t.values(b) for t in grown], axis=1)) if len(pdf) else [])
        return state.mapInPandas(run, state.schema)

    def predict(self, df: DataFrame, id: str, *more: str) -> DataFrame:
        """``(id, *more, probabilities, predicted)``: one probability per class, in the order of ``labels``; ties to the smallest label."""
        rows, trees = self._binned(df, [id, *more]), self.trees
        kept = [f for f in rows.schema.fields if f.name != "_b"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                b, scores = _table(pdf["_b"], np.int64), np.zeros((len(pdf), max(1, classes)))
                for grown in trees:
                    scores += np.stack([t.values(b) for t in grown], axis=1)
                yield pdf[[f.name for f in kept]].assign(probabilities=list(softmax(scores)))

        classes = len(self.labels)
        out = rows.mapInPandas(run, T.StructType([*kept, T.StructField("probabilities", T.ArrayType(T.DoubleType()))]))
        names = F.array(*[F.lit(v) for v in self.labels]) if classes else F.array(F.lit(None).cast("string"))
        return out.withColumn("predicted", F.get(names, (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")))


def boost_classify(df: DataFrame, num: Sequence[str], cat: Sequence[str], label: str, id: str, min_rows: int = 50, seed: int = 42, **options) -> tuple[DataFrame, DataFrame]:
    """Boosted trees on classes of at least ``min_rows`` rows with median / most-frequent fill: ``(test rows with probabilities and prediction,
    report)``; 80 % trains. ``options`` as for :class:`Boosted`."""
    df = materialise(impute_simple(min_class_size(df, label, min_rows), num, cat).withColumn("_train", in_share(F.col(id), F.lit(seed), "cccc")), "classes")
    model = Boosted(df.where("_train"), num, cat, label, **options)
    out = materialise(model.predict(df.where("NOT _train"), id, label).withColumnRenamed(label, "actual"), "predicted")
    return out, classification_report(out, "actual", "predicted")
