"""Manifest, collocations and line removal against plain versions, and their defined results on odd rows; row numbers across passes."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact, lines, manifest, mixing, near, phrases, queries, sharding, suffixes
from tallyloom.llm.common import fixed, located, prepare

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "\n".join(f"line {i % 700} of a long text, number {i % 400}" for i in range(20000))
ODD = [(1, "A line that many share here\nown line of the first\n\nshort", "a", "en"), (2, " a LINE that many share HERE\t\nshort", "a", "en"), (2, " a LINE that many share HERE\t\nshort", "a", "en"),
       (3, None, None, None), (4, "", "b", None), (5, "\n\n", "b", "und"), (None, "a line that many share here", "a", "en"), (6, "Ünïcode É a line of it that is long", "a", "é"),
       (6, "Ünïcode É a line of it that is long", "a", "é"), (7, "x\n  Ünïcode É A line of it that is long\r\n\x0b", "a", "é"), (8, LONG, "c", "en"), (9, LONG + "\nend", "c", "fr"),
       (None, None, None, None), (10, LONG, "c", "en")]
SCHEMA = "doc_id long, text string, source string, lang string, _row string, at int, g string, h long"      # with names that the operators use


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in ODD], SCHEMA).withColumn("n_chars", F.length("text")).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- lines

def plain_lines(docs, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, text); documents in the order of the files."""
    split = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for at, (_, some) in enumerate(split):
        for line in some:
            if len(key(line)) >= min_chars:
                held[key(line)].add(at)
    rank = lambda at: (split[at][0] is not None, split[at][0] or 0, at)
    stay = {k: max(v, key=rank) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for at, (i, some) in enumerate(split):
        left = [line for line in some if stay.get(key(line), at) == at]
        out.append((i, len(some), len(some) - len(left), "\n".join(left)))
    return out


def test_lines_against_plain(spark, odd, none):
    got = rows(lines.line_dedup(odd).select("doc_id", "n_lines", "n_dropped", "text"))
    assert Counter(got) == Counter(plain_lines([r[:2] for r in ODD]))       # rows that share an id have one text here
    assert rows(lines.line_dedup(none)) == []
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for least, share in ((20, 3), (5, 2)):
        got = rows(lines.line_dedup(spark.read.parquet(f"{SF}/documents.parquet"), least, share).select("doc_id", "n_lines", "n_dropped", "text"))
        assert Counter(got) == Counter(plain_lines(docs, least, share))
    assert any(r[2] for r in plain_lines(docs))


def test_rows_of_one_id_are_documents_of_their_own(spark):
    same = "a line that is long enough to count"
    docs = spark.createDataFrame([(7, same + f"\n{i}") for i in range(3)], "doc_id long, text string").coalesce(1)
    got = sorted(rows(lines.line_dedup(docs).select("n_dropped", "text")))
    assert got == [(0, same + "\n2"), (1, "0"), (1, "1")]


# ---------------------------------------------------------------- manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*[code(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def plain_tree(nodes, fanout):
    """(root, the siblings of each node, level by level)"""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            first = at - at % fanout
            proofs[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        nodes = [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        where = [at // fanout for at in where]
    return nodes[0], proofs


def plain_manifest(docs, fanout=8):
    groups = defaultdict(list)
    for d in docs:
        groups[d["lang"]].append(d)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, plain_leaf(d)))
        trees[g] = plain_tree([plain_leaf(d) for d in groups[g]], fanout)
    root, above = plain_tree([trees[g][0] for g in order], fanout)
    return [(d["doc_id"], g, plain_leaf(d), tuple(proof + above[k]), trees[g][0], root) for k, g in enumerate(order) for d, proof in zip(groups[g], trees[g][1], strict=True)]


def manifest_rows(df):
    return Counter((r.doc_id, r.lang, r.leaf, tuple((x.left, x.right) for x in r.proof), r.subroot, r.root) for r in df.collect())


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest_against_plain(spark, odd, none, fanout):
    assert manifest_rows(manifest.manifest(odd, fanout=fanout)) == Counter(plain_manifest([r.asDict() for r in odd.collect()], fanout))
    assert rows(manifest.manifest(none, fanout=fanout)) == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [r.asDict() for r in docs.collect()]
    got = manifest.manifest(docs.repartition(5), fanout=fanout)             # with fanout 2: blocks of 8, many rounds, last subtrees that are not full
    assert manifest_rows(got) == Counter(plain_manifest(plain, fanout))
    assert got.where(manifest.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_butterfly_of_any_size(spark):
    trees = {f"g{n}": [digest(str(i)) for i in range(n)] for n in (1, 2, 7, 8, 9, 63, 64, 65, 130)}
    df = spark.createDataFrame([(g, i, len(leaves), h) for g, leaves in trees.items() for i, h in enumerate(leaves)], "g string, at long, n long, node string")
    got = {(r.g, r["at"]): (r.node, [(x.left, x.right) for x in r.path]) for r in manifest.butterfly(df, 8).collect()}
    want = {}
    for g, leaves in trees.items():
        root, proofs = plain_tree(leaves, 8)
        want |= {(g, i): (root, proofs[i]) for i in range(len(leaves))}
    assert got == want


def test_tampering_is_found(spark):
    got = {r.doc_id: r for r in queries.op11_manifest(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        touched = zlib.crc32(str(d.doc_id).encode()) % 3 == 0 and (d.text or "") != (d.text or "").translate(LOWER)
        assert got[d.doc_id].verified == (not touched) and (got[d.doc_id].folded_root == got[d.doc_id].root) == (not touched)


# ---------------------------------------------------------------- collocations

def plain_phrases(docs, least, depth, contained, top):
    count, totals = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            count.update((lang or "und", tuple(w[i:i + k])) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    most = Counter()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                most[(lang, p[i:i + m])] = max(most[(lang, p[i:i + m])], a)
    by = defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * most[(lang, p)] >= contained * a:
            continue
        score, _, l, r = min((2_000_000 * a // (count[(lang, p[:k])] + count[(lang, p[k:])]), k, count[(lang, p[:k])], count[(lang, p[k:])]) for k in range(1, len(p)))
        by[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, some in by.items() for k, (s, a, p, l, r) in enumerate(sorted(some)[:top])}


@pytest.mark.parametrize("budget,size", [(1 << 20, 4 << 20), (40, 1000)])       # the second: prefixes of two and three words, texts in parts
def test_phrases_against_plain(spark, odd, none, budget, size):
    docs = [r[1:] for r in ODD]
    got = rows(phrases.collocations(odd, min_count=3, top=50, budget=budget, part_bytes=size))
    assert set(got) == plain_phrases([(d[2], d[0]) for d in docs], 3, 4, 80, 50) and len(set(got)) == len(got)
    assert rows(phrases.collocations(none)) == []
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.lang, r.text) for r in table.select("lang", "text").collect()]
    got = rows(phrases.collocations(table, min_count=5, budget=budget * 20, part_bytes=size * 10))
    assert set(got) == plain_phrases(docs, 5, 4, 80, 2000) and len(got) > 100


def test_parts_of_long_texts_count_every_phrase_once():
    text = "One two three. four FIVE six seven eight, nine ten\t\televen " * 7 + "averyveryverylongword" * 9 + " end of it"
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x"]), pa.array([text, "short one"])], ["lang", "text"])
    for ahead in (0, 1, 3):
        got = Counter()
        for _, raw, own in phrases.parts(batch, ahead, 50):
            w = phrases.Words(raw, "x")
            for i in range(int(np.searchsorted(w.start, own))):
                same = [j for j in range(i, min(i + ahead + 1, len(w.id))) if w.piece[j] == w.piece[i]]
                got[b" ".join(w.raw[w.start[j]:w.end[j]] for j in same)] += 1
        want = Counter()
        for t in (text, "short one"):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.lower()):
                w = re.findall(r"[^\x20\x09]+", piece)
                want.update(" ".join(w[i:i + ahead + 1]).encode() for i in range(len(w)))
        assert got == want


def test_prefix_groups_stay_within_the_budget(spark):
    pairs = spark.createDataFrame([(i % 50 + 1, i + 1, 1 + i % 7) for i in range(3000)] + [(99, 1, 400), (99, 2, 30)], "w1 long, w2 long, f long")
    plan = phrases.Partition.plan(pairs, 300)
    assert len(plan.pairs) == 1 and len(plan.words) == 1
    held = Counter()
    for r in pairs.collect():
        w = [np.array([x], np.uint64) for x in (r.w1, r.w2)]
        held[int(plan.group[plan.bucket(w)][0])] += r.f if r.f <= 300 else 0
    assert max(held.values()) <= 300


# ---------------------------------------------------------------- row numbers

def test_results_do_not_depend_on_how_files_are_split(spark, tmp_path):
    """Forty files, read by 4 and by 12 tasks at a time: what one pass decides is found again by the next."""
    path = str(tmp_path / "docs")
    spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text number "), (F.col("id") % 900).cast("string"), F.lit(" with some more words than five, "), F.repeat(F.lit("word "), 40)).alias("text"),
                             F.concat(F.lit("s"), F.col("id") % 3).alias("source")).repartition(40).write.parquet(path)
    slots = "spark.sql.leafNodeDefaultParallelism"
    kept = {}
    try:
        spark.conf.set(slots, "4")
        docs = fixed(spark.read.parquet(path))
        first = {r._n: r.doc_id for r in located(docs, "_n").collect()}
        owner = sharding.extendible_shards(docs, limit_bytes=20000)
        once = {"exact": exact.exact_dedup(docs).where("kept").select("_row"), "near": near.near_dedup(docs).where("stays").select("_row"),
                "mix": mixing.mix_sources(docs).where("copies > 0").select("_row")}
        once = {k: {r._row for r in v.collect()} for k, v in once.items()}
        spark.conf.set(slots, "12")
        docs = fixed(spark.read.parquet(path))
        assert {r._n: r.doc_id for r in located(docs, "_n").collect()} == first and len(first) == 1000
        sharding.write_shards(docs, owner, str(tmp_path / "shards"))
        assert spark.read.parquet(str(tmp_path / "shards")).count() == 1000
        for name, chosen in once.items():
            kept[name] = sum(r._n in chosen for r in located(docs, "_n").collect())
            assert kept[name] == len(chosen)
        assert kept["exact"] == exact.keep_one_of_each(docs).count() == 900
        assert suffixes.repeated_spans(docs).count() == 1000
    finally:
        spark.conf.unset(slots)


def test_inputs_that_are_not_scans_are_written_once(spark):
    df = spark.range(100).repartition(7).join(spark.range(50).withColumnRenamed("id", "other"), F.col("id") == F.col("other"), "left")
    got = rows(located(fixed(df), "n"))
    assert len({r[-1] for r in got}) == 100
