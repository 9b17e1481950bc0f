"""Near-duplicate vectors against all pairs."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import vectors
from tallyloom.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, comp string"


def plain(rows, least):
    def unit(v):
        if v is None or not v or any(x is None for x in v):
            return None
        a = np.array(v, np.float32).astype(float)
        n = np.sqrt((a * a).sum())
        return a / n if np.isfinite(n) and n > 0 else None
    units = [unit(r[1]) for r in rows]
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) \
                    and float(units[i] @ units[j]) >= least:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            stack, group = [i], {i}
            while stack:
                for k in links[stack.pop()] - group:
                    group.add(k)
                    stack.append(k)
            for k in group:
                seen[k] = group
        ids = [rows[k][0] for k in seen[i] if rows[k][0] is not None]
        name = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), name, rows[i][0] == name if rows[i][0] is not None and name is not None else True))
    return Counter(out)


def test_clusters_and_odd_rows(spark):
    prepare(spark)
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for label in range(3):
        for size in [1] * 60 + [2] * 10 + [5, 40]:
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((n, [float(np.float32(x)) for x in centre + 0.03 * rng.standard_normal(16)], label, "x"))
                n += 1
    rows += [rows[0], (n, rows[1][1], 0, None), (n + 1, [2 * x for x in rows[1][1]], 0, None), (n + 2, rows[1][1], None, None), (n + 3, None, 0, None), (n + 4, [0.0] * 16, 0, None),
             (n + 5, [float("nan")] + [1.0] * 15, 0, None), (n + 6, [float("inf")] + [1.0] * 15, 0, None), (n + 7, [None] + [1.0] * 15, 0, None), (n + 8, [1.0, 2.0], 0, None),
             (n + 9, [1.0, 2.0], 0, None), (None, rows[2][1], 0, None), (n + 10, [], 0, None)]
    got = vectors.embedding_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(tuple(r)[:4] for r in got.collect()) == plain(rows, 0.98)
    assert vectors.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got.where(F.col("n_links") > 30).count() >= 120


def test_links_between_saturated_groups(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    rows = []
    for label in range(2):
        for centre in (a, 0.985 * a + np.sqrt(1 - 0.985 ** 2) * b):       # cosine 0.999 inside, about 0.985 across
            for _ in range(60):
                rows.append((len(rows), [float(np.float32(x)) for x in centre + 0.0055 * rng.standard_normal(32)], label, "x"))
    # as if every list had closed inside its own group: two components of a label, both with full lists
    units = [(i, str(r[2]), [float(x) for x in np.array(r[1]) / np.linalg.norm(r[1])]) for i, r in enumerate(rows)]
    nodes = spark.createDataFrame(units, "node long, g string, unit array<double>")
    parts = spark.createDataFrame([(i, i // 60 * 60, True) for i in range(len(rows))], "node long, comp long, full boolean")
    for block in (128, 16):
        got = vectors.merge_full(nodes, parts, 0.98, block=block, centres=block // 8).collect()
        assert sorted((r.node, r.comp, r.full) for r in got) == [(i, i // 120 * 120, True) for i in range(len(rows))]
    assert {r.comp for r in vectors.merge_full(nodes, parts, 0.998).collect()} == {0, 60, 120, 180}
