"""One query per operator over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, lines, lm, manifest, mixing, near, packing, phrases, quality, sharding, suffixes, toxicity, vectors
from .common import lower_ascii, prepare


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.katz_scores(_docs(spark, sf_dir))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(_docs(spark, sf_dir), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_dedup(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")).drop("_row")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(_docs(spark, sf_dir)).drop("_row")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by the crc32 of its id, is tampered with: its text is lower-cased. Its proof then has to fail."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    fields = [F.col(c) for c in manifest.FIELDS]
    seen = F.when(touched, manifest.leaf_hash(*fields[:-1], lower_ascii(fields[-1]))).otherwise(manifest.leaf_hash(*fields))
    out = manifest.manifest(_docs(spark, sf_dir), carry={"seen": seen}).withColumn("folded_root", manifest.fold(F.col("seen"), F.col("proof")))
    proof = F.sha2(manifest.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_docs(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_katz, op3_pack, op4_minhash, op5_repeats, op6_quality, op7_toxicity, op8_embeddings, op9_mix_sources, op10_sharding,
                                   op11_manifest, op12_collocations, op13_lines)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a column's decimal text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1),
  lambda i: list_transform(range(0, 8), lambda k: ((ord(substr({0}, i, 1)) >> k) & 1)::BIGINT)))), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))))"""


def _leaf(text: str) -> str:
    """A leaf of the manifest, with ``text`` in place of the column."""
    fields = [f"CAST({c} AS VARCHAR)" for c in manifest.FIELDS[:-1]] + [text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


ORACLES = {
    "op1_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op9_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
  [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0::DOUBLE)) AS level
  FROM s WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT *, target - whole * source_size AS rest FROM f),
u AS (SELECT doc_id, d.source, size, source_size, target, whole, rest, (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
  rest / source_size AS p FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM u),
k AS (SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS chosen FROM r),
e AS (SELECT *, rest - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM k),
l AS (SELECT *, rank IS NOT NULL AND NOT chosen AND abs(gap - size) < gap AS possible FROM e),
m AS (SELECT *, possible AND row_number() OVER (PARTITION BY source, possible ORDER BY abs(gap - size), rank, doc_id) = 1 AS last FROM l)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN chosen OR last THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m""",
    "op10_sharding": """
WITH t AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT AS h FROM documents),
b AS (SELECT doc_id, n_bytes, depth, h >> (48 - depth) AS prefix FROM t, (SELECT CAST(unnest(range(0, 49)) AS INTEGER) AS depth)),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM b GROUP BY 1, 2 HAVING sum(n_bytes) <= 1048576 OR count(*) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM b JOIN s USING (depth, prefix))
SELECT doc_id, n_bytes, depth, prefix, (1::BIGINT << depth) + prefix AS shard_id, shard_bytes, shard_docs, shard_bytes <= 1048576 AS fits FROM r WHERE k = 1""",
    "op11_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf('text')} AS leaf,
  CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS seen FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
tree AS (SELECT g, 0 AS lvl, pos, n, leaf AS h FROM l
  UNION ALL SELECT g, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
subs AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM subs
  UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 8, n),
high AS (SELECT g, max(lvl) AS levels FROM tree GROUP BY g),
nodes AS MATERIALIZED (SELECT g, lvl, pos, h FROM tree WHERE n > 1 UNION ALL SELECT g, high.levels + lvl, top.pos, h FROM top, high WHERE top.n > 1),
base AS (SELECT l.*, high.levels, subs.pos AS sub_at FROM l JOIN high USING (g) JOIN subs USING (g)),
steps AS (SELECT DISTINCT g, lvl FROM nodes),
walk AS MATERIALIZED (SELECT base.g, base.pos AS start, lvl, CASE WHEN lvl < levels THEN (base.pos >> (3 * lvl)::INTEGER) ELSE (sub_at >> (3 * (lvl - levels))::INTEGER) END AS own FROM base JOIN steps USING (g)),
proofs AS (SELECT w.g, w.start, string_agg(n.h, '' ORDER BY n.lvl, n.pos) AS p FROM walk w JOIN nodes n ON n.g = w.g AND n.lvl = w.lvl AND n.pos // 8 = w.own // 8 AND n.pos <> w.own GROUP BY 1, 2),
folds AS (SELECT g, pos AS start, 0 AS lvl, seen AS h FROM l
  UNION ALL SELECT f.g, f.start, f.lvl + 1, sha256(string_agg(CASE WHEN n.pos = w.own THEN f.h ELSE n.h END, '' ORDER BY n.pos))
  FROM folds f JOIN walk w ON w.g = f.g AND w.start = f.start AND w.lvl = f.lvl JOIN nodes n ON n.g = w.g AND n.lvl = w.lvl AND n.pos // 8 = w.own // 8 GROUP BY f.g, f.start, f.lvl, f.h),
last AS (SELECT g, start, max_by(h, lvl) AS folded_root FROM folds GROUP BY g, start)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM l JOIN subs USING (g) JOIN last ON last.g = l.g AND last.start = l.pos LEFT JOIN proofs ON proofs.g = l.g AND proofs.start = l.pos, (SELECT h FROM top WHERE n = 1) r""",
    "op12_collocations": f"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM grams WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.p, c.f AS a, c.cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.f) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c JOIN grams x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.cut) JOIN grams y ON y.lang = c.lang AND y.p = list_slice(c.p, c.cut + 1, c.k)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
parts AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS most
  FROM (SELECT lang, p, f, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY 1, 2),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN parts q ON q.lang = b.lang AND q.p = b.p WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_lines": f"""
WITH lines AS (SELECT row, doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS stay FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3),
marked AS (SELECT k.*, o.key IS NOT NULL AND doc_id <> stay AS gone FROM keyed k LEFT JOIN often o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INTEGER) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY row, doc_id""",
}
