"""The corpus pipeline, stage by stage, and its registration."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries
from tests.llm.test_text_operators import LOWER, WORD, check_packing, plain_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The folder of every stage's output, each run on the one before it."""
    folder, docs, path = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path[name] = str(folder / name)
        stage(spark, docs, SF).write.parquet(path[name])
        docs = spark.read.parquet(path[name])
    return path


def test_stages(spark, written):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, path in enumerate(written.values()):
        before, docs = docs, spark.read.parquet(path)
        if k < 4:
            assert docs.columns == before.columns
        if k < 3:
            assert docs.exceptAll(before).count() == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    exact = spark.read.parquet(written["exact dedup"])
    assert exact.select(lower).distinct().count() == exact.count() == spark.read.parquet(written["toxicity"]).select(lower).distinct().count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    start = spark.read.parquet(f"{SF}/documents.parquet").join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
    kept = spark.read.parquet(written["toxicity"]).join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
    assert kept >= 0.97 * start
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where("n > 1024 OR n <> e").count() == 0
    mixed = spark.read.parquet(written["mixing"]).groupBy("doc_id").count()
    packed = docs.where("piece = 0").groupBy("doc_id").count()
    assert mixed.exceptAll(packed).count() == 0 and packed.exceptAll(mixed).count() == 0


def test_stages_against_plain_versions(spark, written):
    """Every stage on what the one before it kept, beside a plain version of its operator."""
    at = {name: spark.read.parquet(p) for name, p in written.items()}
    texts = {r.doc_id: r.text for r in at["toxicity"].select("doc_id", "text").collect()}
    last = {}
    for i, t in texts.items():
        key = (t or "").translate(LOWER)
        last[key] = max(i, last.get(key, i))
    kept = {r.doc_id: r.text for r in at["exact dedup"].select("doc_id", "text").collect()}
    assert kept == {i: texts[i] for i in last.values()}
    groups = plain_near(list(kept.items()), 5, 80)
    assert {r.doc_id for r in at["near dedup"].collect()} == {g[0] for g in groups if g[3]}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{written['near dedup']}/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, taken FROM ({queries.ORACLES['op9_mix_sources']}) WHERE taken > 0").fetchall()}
    words = Counter()
    for r in at["mixing"].select("doc_id", "text").collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {i: n for i, n in words.items() if n} == want
    used, bound = check_packing([tuple(r) for r in at["packing"].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()],
                                [(r.doc_id, r.text) for r in at["mixing"].select("doc_id", "text").collect()])
    assert used <= bound * 1.02 + 1


def test_run_and_registration(spark):
    assert len([k for k in entry.queries() if k.startswith("op")]) == 13 and entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
