"""Toxicity by compression distance: two zstandard dictionaries, window lengths compared with calibrated thresholds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, text_or_empty, unit_hash

#: A word of a window: letters and marks; ASCII digits and signs separate words.
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
STEMS = (4, 5, 6)                      # a word's first letters are windows, too
GRID = tuple(np.round(np.arange(0.3, 1.0, 0.05), 2).tolist())
ODDS = (2.0, 4.0, 10.0)                     # how much likelier in a toxic document a unit of the toxic dictionary is; the calibration chooses
LEAST_SAVED = 8                        # bytes; where the ordinary dictionary leaves less to save, a window says little
SHIFTS = [bytes((b + k) & 255 for b in range(256)) for k in (0, 64, 128, 192)]


def spell(unit: str) -> bytes:
    """A window as it is compressed: the unit in four alphabets, so that one match in a dictionary that holds the whole unit saves
    much, while pieces of it would have to be matched four times."""
    raw = b" " + unit.encode()
    return b"".join(raw.translate(t) for t in SHIFTS)


def units(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


@dataclass
class Model:
    """Dictionaries of both classes, the share of what a whole match saves that the toxic one must save, and the calibration."""
    toxic: bytes = b""
    ordinary: bytes = b""
    common: frozenset = frozenset()
    floor: int = 0                     # compressed length of a window that is one match
    threshold: float = 1.0
    weights: list[float] = field(default_factory=lambda: [-20.0, 0.0, 0.0])


class Windows:
    """Compares both compression lengths of a word's windows. Each distinct word is compared once per worker batch."""

    def __init__(self, model: Model):
        import zstandard
        self.common, self.floor = model.common, model.floor

        def compressor(content: bytes):
            # Tables as large as the dictionary: entries that fall out of them are never found again.
            log = max(17, (2 * len(content)).bit_length())
            params = zstandard.ZstdCompressionParameters(window_log=max(20, log), hash_log=log, chain_log=log, search_log=6, min_match=5, target_length=128,
                                                         strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)

        pad = max(len(model.toxic), len(model.ordinary), 8)     # equal lengths, so that offsets cost the same
        self.toxic, self.ordinary = compressor(model.toxic.rjust(pad, b"\0")), compressor(model.ordinary.rjust(pad, b"\0"))
        self.known: dict[str, float] = {}

    def gain(self, word: str) -> float:
        """What the toxic dictionary saves over the ordinary one on a window of the word, as a share of what a whole match saves; the largest over its windows."""
        best = 0.0
        for unit in units(word):
            g = self.known.get(unit)
            if g is None:
                if unit in self.common:
                    g = 0.0
                else:
                    window = spell(unit)
                    long = len(self.ordinary.compress(window))
                    g = max(0, long - len(self.toxic.compress(window))) / max(long - self.floor, LEAST_SAVED)
                if len(self.known) > 300_000:      # memory only; a dropped entry is computed again
                    self.known.clear()
                self.known[unit] = g
            best = max(best, g)
        return best


def _words(text: str) -> dict[str, int]:
    return Counter(LETTERS.findall(text.lower()))


def _held_out(id_col: str) -> Column:
    """Rows that are never learned from; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _unit_counts(sample: DataFrame) -> DataFrame:
    """``(unit, toxic_docs, ordinary_docs)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update({u for w in _words(text) for u in units(w)})
            every = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([found[1][u] for u in every], pa.int64()),
                                              pa.array([found[0][u] for u in every], pa.int64())], ["unit", "toxic_docs", "ordinary_docs"])
    counted = sample.select("_t", F.col("_y").cast("int")).mapInArrow(run, "unit string, toxic_docs long, ordinary_docs long")
    return counted.groupBy("unit").agg(F.sum("toxic_docs").alias("t"), F.sum("ordinary_docs").alias("o"))


def _features(sample: DataFrame, model: Model) -> DataFrame:
    """``(y, words, hits)``: hits per threshold of GRID."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(model)
        for batch in batches:
            words, hits = [], []
            for text in batch.column(0).to_pylist():
                found = _words(text)
                gains = np.array([windows.gain(w) for w in found])
                words.append(sum(found.values()))
                hits.append([int((gains >= g).sum()) for g in GRID])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.int64()), pa.array(hits, pa.list_(pa.int64()))], ["y", "words", "hits"])
    return sample.select("_t", F.col("_y").cast("int")).mapInArrow(run, "y int, words long, hits array<long>")


def _inputs(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    hits, words = np.asarray(hits, float), np.asarray(words, float)
    return np.stack([np.ones(len(hits)), np.minimum(hits, 4.0), np.log1p(1000 * hits / np.maximum(words, 50.0))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """The curve and its loss; row i stands for ``weight[i]`` rows. A Newton step that makes the loss larger is halved."""
    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -30, 30)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        while np.abs(step).max() >= 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w, loss(w)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, max_words: int = 4000, max_common: int = 30_000,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Dictionaries and thresholds from labelled rows that are not held out.

    At most about ``max_docs`` documents of each class are used (chosen by the md5 of their id). Two thirds
    of them train the dictionaries: the toxic one gets the words and stems that are significantly more frequent in toxic documents
    (log-likelihood ratio above the logarithm of the number of different ones) and several times as frequent (``ODDS``), at most ``max_words``; the ordinary one
    the most frequent others among those that look like these, so that what both classes share costs the same. The remaining third
    chooses the odds and the threshold and fits a logistic curve; each of its documents counts for all that its class has for one drawn, so that
    scores keep the class ratio of all labelled rows, whatever their number. Without labels of both classes every score is about 0.
    """
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).alias("_y"))
    label = label.where(~_held_out("_i")).withColumn("_y", (F.col("_y") > 0).cast("int"))
    sizes = {r["_y"]: r["count"] for r in label.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return Model()
    shares = [min(1.0, max_docs / sizes[k]) for k in (0, 1)]
    share = F.when(F.col("_y") == 1, shares[1]).otherwise(shares[0])
    chosen = label.where(unit_hash(F.concat(F.lit("t"), F.col("_i").cast("string"))) < share)
    sample = docs.select(F.col(id_col).alias("_i"), text_or_empty(text_col).alias("_t")).join(F.broadcast(chosen), "_i")   # at most about 2 * max_docs ids
    fit = unit_hash(F.concat(F.lit("f"), F.col("_i").cast("string"))) < 2 / 3

    counts = _unit_counts(sample.where(fit)).where("t + o >= 2").persist()
    n_units = max(2, counts.count())
    rate = _toxic_share(sizes, max_docs)
    p = F.col("t") / (F.col("t") + F.col("o"))
    ratio = F.col("t") * F.log(p / rate) + F.when(F.col("o") > 0, F.col("o") * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    found = counts.where(p > rate).withColumn("llr", ratio).where((F.col("llr") > math.log(n_units)) & (F.col("t") * (1 - rate) >= min(ODDS) * rate * F.col("o"))) \
        .orderBy(F.desc("llr"), "unit").limit(max_words).collect()
    common = [r["unit"] for r in counts.where("o > 0").orderBy(F.desc("o"), "unit").limit(max_common).collect()]
    counts.unpersist()
    best = None
    for odds in ODDS:
        model = _dictionaries([r["unit"] for r in found if r["t"] * (1 - rate) >= odds * rate * r["o"]], common)
        rows = _features(sample.where(~fit), model).collect()
        if not rows:
            return Model()
        y, words, hits = np.array([r["y"] for r in rows], float), np.array([r["words"] for r in rows]), np.array([r["hits"] for r in rows])
        weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        for k, g in enumerate(GRID):
            w, loss = _logistic(_inputs(hits[:, k], words), y, weight)
            if best is None or loss < best[0] - 1e-9:
                best = (loss, model, g, w)
    model = best[1]
    model.threshold, model.weights = best[2], [float(v) for v in best[3]]
    return model


def _dictionaries(toxic: list[str], common: list[str]) -> Model:
    """Both dictionaries, and what a window that is one match of the toxic one compresses to."""
    hot = set(toxic)
    common = [u for u in common if u not in hot]
    beginnings = {u[:3] for u in hot}
    similar = [u for u in common if u[:3] in beginnings]
    model = Model(b"".join(map(spell, reversed(toxic))) + b"".join(map(spell, reversed(similar))), b"".join(map(spell, reversed(similar))), frozenset(common))
    compress = Windows(model).toxic.compress
    model.floor = min((len(compress(spell(u))) for u in toxic), default=0)
    return model


def _toxic_share(sizes: dict[int, int], max_docs: int) -> float:
    """Share of toxic documents in the sample."""
    t, o = min(sizes[1], max_docs), min(sizes[0], max_docs)
    return t / (t + o)


def score(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score", names: Sequence[str] | None = None) -> DataFrame:
    """The columns ``names`` (all) of ``docs`` with a score from 0 to 1; the text alone decides it, all of it. Null and empty texts have no windows."""
    names = list(names or docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(model)
        for batch in batches:
            hits, words = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = _words(text)
                words.append(sum(found.values()))
                hits.append(sum(windows.gain(w) >= model.threshold for w in found))
            s = 1 / (1 + np.exp(-np.clip(_inputs(np.array(hits), np.array(words)) @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], [*names, column])

    schema = StructType([*[docs.schema[c] for c in names], StructField(column, DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty(f"`{text_col}`").alias(fresh(docs, "_text"))).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Words, their stems included, are the windows; each is compressed with both dictionaries, and a window counts when the
    toxic one saves at least the calibrated share. The score comes from how many different windows count and how dense they are.
    Repeated rows get equal scores; a null id counts as an empty one; an empty table gives an empty result.
    """
    model = train(docs, labels, **options)
    ids = docs.select(F.col(options.get("id_col", "doc_id")).alias("doc_id"), F.col(options.get("text_col", "text")).alias("_t"))
    out = score(ids.withColumn("held_out", _held_out("doc_id")), model, "_t", names=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, with their own columns."""
    column = fresh(docs, "_toxicity")
    scored = score(docs, train(docs, labels, **options), options.get("text_col", "text"), column)
    return scored.where(F.col(column) < cut).select(*[F.col(f"`{c}`") for c in docs.columns])
