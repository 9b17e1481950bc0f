"""Operators on texts against plain versions, and their defined results on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact, lm, mixing, near, packing, quality, queries, sharding, suffixes, toxicity, words
from tallyloom.llm.common import prepare
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))
ODD = [(1, "Same text here now", "a", "x"), (2, "sAME TEXT HERE NOW", "a", "y"), (2, "sAME TEXT HERE NOW", "a", "y"), (3, None, None, None), (4, "", "b", None), (5, "  \n\t ", "b", None),
       (None, "no id", "a", None), (6, "Ünïcode É", "a", "z"), (7, LONG, "a", None), (8, LONG + " end", "c", None), (9, "two words", None, None), (None, None, None, None)]
SCHEMA = "doc_id long, text string, source string, _row string"       # a column whose name the operators use, too


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame([(*r[:3], r[3]) for r in ODD], SCHEMA).withColumn("lang", F.lit(None).cast("string")).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    ok, msg, _, _ = compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, msg


def test_words_are_split_on_ascii_space_only():
    t = pa.array(["A\x1cB \x85c d\x0b\x0c e", None, "", " x ", "É"])
    vocabulary, index, counts = words.split_words(t)
    flat = [vocabulary[int(i)].as_py() for i in index]
    assert flat == [w for x in t.to_pylist() for w in WORD.findall((x or "").translate(LOWER))]
    assert counts.tolist() == [3, 0, 0, 1, 1]


# ---------------------------------------------------------------- exact duplicates

def test_exact_odd_rows(odd, none):
    got = exact.exact_dedup(odd)
    by = defaultdict(list)
    for r in got.collect():
        by[r.text_sha256].append(r)
    norm = Counter((t or "").translate(LOWER) for _, t, *_ in ODD)
    assert {k: len(v) for k, v in by.items()} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in norm.items()}
    for group in by.values():
        assert [r.kept for r in group].count(True) == 1 and {r.group_size for r in group} == {len(group)}
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids) if ids else None}
    stay = exact.keep_one_of_each(odd)
    assert stay.columns == odd.columns and stay.count() == len(norm)
    assert rows(exact.exact_dedup(none)) == [] and exact.keep_one_of_each(none).count() == 0
    assert {r.keep_id for r in exact.exact_dedup(odd, keep="smallest").where("doc_id = 2").collect()} == {1}


def test_exact_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 400)).alias("text")).repartition(37)
    got = exact.exact_dedup(df).groupBy("keep_id", "group_size").count().collect()
    assert all(r["group_size"] == r["count"] for r in got)
    assert max((r["group_size"], r["keep_id"]) for r in got) == (1000, 2997)


# ---------------------------------------------------------------- language model

def plain_katz(docs):
    """Scores by the same formulas with dictionaries, over a list of (id, text)."""
    docs = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in docs]
    held = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _ in docs}
    c, pair, ch = Counter(), Counter(), Counter()
    for i, w in docs:
        for h, x in zip(["<", *w[:-1]], w, strict=True):
            if not held[i]:
                c[x] += 1
                pair[(h, x)] += 1
                ch[h] += 1
    many = lambda counts: [0] + [sum(v == r for v in counts.values()) for r in range(1, lm.K + 2)]
    n = sum(c.values())
    uni, d = lm.Unigrams(n, len(c), many(c)), lm.discounts(many(pair))
    after = defaultdict(dict)
    for (h, x), r in pair.items():
        after[h][x] = r
    p1 = lambda x: float(uni.p(np.array([c.get(x, 0)]))[0])
    off = lambda r: d[r] if r <= lm.K else 1.0
    weight = {}

    def alpha(h):
        if h not in weight:
            f = after[h]
            flat = all(off(r) == 1 for r in f.values())
            weight[h] = (1 - sum(off(r) * r for r in f.values()) / (ch[h] + flat)) / (1 - sum(map(p1, f)))
        return weight[h]

    def p(h, x):
        if h not in after:
            return p1(x)
        f = after[h]
        return off(f[x]) * f[x] / (ch[h] + all(off(r) == 1 for r in f.values())) if x in f else alpha(h) * p1(x)

    sums = [sum(p(h, x) for x in c) + (alpha(h) if h in after else 1) * uni.unknown for h in [*list(after)[:5], "<", "never seen"]] if c else []
    out = []
    for i, w in docs:
        score = sum(math.log10(p(h, x)) for h, x in zip(["<", *w[:-1]], w, strict=True))
        base = sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w)
        out.append((i, held[i], len(w), sum(c.get(x, 0) > 0 for x in w), n, base, score))
    return out, sums


def close(a, b):
    key = lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else x or 0) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_katz_whole_table(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "TEXT_BYTES", 60_000)
    monkeypatch.setattr(lm, "SHARD_ENTRIES", 5_000)
    want, sums = plain_katz(texts.items())
    assert sums == pytest.approx([1.0] * len(sums))
    close(rows(queries.QUERIES["op2_katz"](spark, SF)), want)
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_katz_odd_rows(odd, none):
    close(rows(lm.katz_scores(odd)), plain_katz([r[:2] for r in ODD])[0])
    assert rows(lm.katz_scores(none)) == []


def test_discounts_fall_back():
    assert lm.discounts([0] * 7).tolist() == [1, 0.5, 1, 1, 1, 1]
    assert lm.discounts([0, 10, 0, 0, 0, 0, 0])[1] == 0.5
    assert ((0 < (d := lm.discounts([0, 1000, 400, 200, 120, 80, 50])[1:])) & (d < 1)).all()


# ---------------------------------------------------------------- packing

def check_packing(got, docs, capacity=1024):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        start = piece = 0
        while start < len(ids):
            n = (len(ids) % capacity or capacity) if not start else capacity
            want[(i, piece, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()))] += 1
            start, piece = start + n, piece + 1
    assert Counter(r[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r[3] for r in got) // capacity)


def test_pack_whole_table(spark, texts):
    used, bound = check_packing(rows(queries.QUERIES["op3_pack"](spark, SF)), texts.items())
    assert used <= bound * 1.02 + 1


def test_pack_odd_rows(spark, odd, none):
    check_packing(rows(packing.pack(odd)), [r[:2] for r in ODD])
    assert rows(packing.pack(none)) == []
    blanks = [(i, t) for i, t in enumerate([" ", "  a", " a  b ", "\n\n x \t y", "don't we'll  x's", "<|endoftext|> a", "x<|endoftext|><|endoftext|>y <|endoftext|", "é　 x", "a \x85b", "x \x1cb", "x   y ", "a | b"])]
    check_packing(rows(packing.pack(spark.createDataFrame(blanks, "doc_id long, text string"))), blanks)


def least_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])
    go(0, [])
    return best[0]


def test_dominance_keeps_an_optimum():
    rng = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        items = rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist()
        counts = [0] * (capacity + 1)
        for s in items:
            counts[s] += 1
        fixed = packing.reduce_dominated(counts, capacity)
        left = [s for s, n in enumerate(counts) for _ in range(n)]
        assert sum(n for _, n in fixed) + least_bins(left, capacity) == least_bins(items, capacity)
        packed = Counter()
        for pattern, n in packing.plan(Counter(items), capacity):
            assert sum(s * k for s, k in pattern) <= capacity
            for s, k in pattern:
                packed[s] += k * n
        assert packed == Counter(items)


# ---------------------------------------------------------------- near duplicates

def plain_near(docs, n, percent):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    posted, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            posted[x].append(i)
    for who in posted.values():
        for a in range(len(who)):
            for b in range(a):
                common[(who[b], who[a])] += 1
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            up[max(top(a), top(b))] = min(top(a), top(b))
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[top(i)].append(i)
    out = []
    for who in groups.values():
        ids = [docs[i][0] for i in who if docs[i][0] is not None]
        for i in who:
            name = min(ids) if ids else None
            out.append((docs[i][0], len(sets[i]), name, docs[i][0] == name if docs[i][0] is not None and name is not None else True))
    return Counter(out)


def test_near_whole_table(spark, texts):
    assert Counter(rows(queries.QUERIES["op4_minhash"](spark, SF))) == plain_near(list(texts.items()), 3, 85)


def test_near_groups_and_odd_rows(spark, odd, none, monkeypatch):
    assert Counter(rows(near.near_dedup(odd, words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept"))) == plain_near([r[:2] for r in ODD], 3, 85)
    assert rows(near.near_dedup(none)) == [] and near.keep_one_per_component(none).count() == 0
    monkeypatch.setattr(near, "BLOCK", 8)          # postings in several blocks
    rng = np.random.default_rng(1)
    docs = []
    for base in range(3):
        text = [f"b{base}w{k}" for k in range(80)]
        for _ in range(40):
            t = list(text)
            for k in rng.integers(0, 80, rng.integers(0, 5)):
                t[k] = f"e{rng.integers(1 << 30)}"
            docs.append((len(docs), " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(rows(near.near_dedup(df).select("doc_id", "n_shingles", "component_id", "kept"))) == plain_near(docs, 5, 80)
    kept = near.keep_one_per_component(df)
    assert kept.columns == df.columns and kept.count() == len({k[2] for k in plain_near(docs, 5, 80)})


# ---------------------------------------------------------------- repeated passages

def plain_repeats(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(docs, raw, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), len(b) - len(kept), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def spans(df, length):
    return Counter(rows(suffixes.repeated_spans(df, length).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256")))


def test_repeats_whole_table(spark, texts):
    assert Counter(rows(queries.QUERIES["op5_repeats"](spark, SF))) == plain_repeats(list(texts.items()), 200)


def test_repeats_odd_rows(spark, odd, none, monkeypatch):
    assert spans(none, 200) == Counter()
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 2000)          # long texts come in slices
    short = [(*r[:1], r[1][:9000] if r[1] else r[1]) for r in ODD]
    short += [(20, "a" * 3000), (21, "ab" * 150), (22, "é" * 99), (23, "é" * 99), (24, "x" * 199), (25, "y" * 200), (26, "y" * 200)]
    assert spans(spark.createDataFrame(short, "doc_id long, text string").repartition(2), 200) == plain_repeats(short, 200)
    rng = np.random.default_rng(2)
    passage = "".join(map(chr, rng.integers(97, 123, 330)))
    docs = [(i, "".join(map(chr, rng.integers(97, 123, 700)))) for i in range(30)]
    docs = [(i, t[:i * 11] + passage[i % 7:330 - i % 5] + t[i * 11:]) for i, t in docs]
    assert spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 200) == plain_repeats(docs, 200)


# ---------------------------------------------------------------- quality, toxicity

def test_perplexity_is_a_probability(spark, odd, none):
    docs = [("a b a b c", "x"), ("a c a b", "x"), ("z z y", "q"), ("", "x"), (None, None)]
    model = quality.fit(spark.createDataFrame(docs, "_t string, _lang string").select(F.coalesce("_t", F.lit("")).alias("_t"), "_lang"))
    lang = quality._lang_key(["x"])
    names = [*quality.hash_words(pa.array(["a", "b", "c"])), quality.END]
    keys = quality.mix(np.array(names, np.uint64) ^ lang)
    for h in [*keys[:3], quality.mix(np.array([quality.BEGIN]) ^ lang)[0], np.uint64(12345)]:
        many = np.full(4, h, np.uint64)
        p = 10 ** model.log10(keys, many, np.repeat(lang, 4))
        rest = 10 ** model.log10(np.array([99], np.uint64), many[:1], lang)
        assert p.sum() + rest[0] == pytest.approx(1.0)
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 1), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality(odd, labels)
    assert got.count() == len(ODD) and got.where("perplexity IS NULL OR kept IS NULL").count() == 0
    assert quality.quality(none, labels).count() == 0
    assert quality.quality(odd, labels.where("false")).where("kept").count() == len(ODD)


def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in got}
    assert share[1] > 0.93 and share[0] < 0.5


def test_quality_of_small_languages(spark):
    prepare(spark)
    rows = [(i, "en", f"the plain words number {i % 7} of a text", 1) for i in range(2000)]
    rows += [(2000 + i, "xx", f"ein kleiner satz {i % 5} mit worten", 1) for i in range(20)] + [(2020, "xx", "zq vj wk pf gh", 0), (2021, "yy", "no trusted text", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, quality int").repartition(4, "doc_id")
    scores = []
    for max_docs in (8000, 40):
        got = {r.doc_id: r for r in quality.quality(docs.drop("quality"), docs.drop("text", "lang"), max_docs=max_docs).collect()}
        assert len(got) == len(rows) and not got[2020].kept
        assert got[2021].kept and got[2021].perplexity is None and got[2021].threshold is None
        scores.append([got[i].perplexity for i in range(2000, 2021)])
    assert scores[0] == pytest.approx(scores[1])          # a large language beside it changes nothing
    assert quality._level([10, 1000, 5000], 605) == 300 and quality._level([10, 20], 600) == 600


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.6 and sum(clean) / len(clean) < 0.03


@pytest.mark.parametrize("fillers", [0, 3000, 30000])
def test_toxic_units_are_found_in_dictionaries_of_any_size(fillers):
    rng = np.random.default_rng(fillers)
    other = ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(fillers)]
    bad = [f"vile{chr(97 + i)}word" for i in range(20)]
    filler = b"".join(map(toxicity.spell, other))
    windows = toxicity.Windows(toxicity.Model(b"".join(map(toxicity.spell, bad)) + filler, filler, floor=17))
    assert min(windows.gain(w) for w in bad) > 0.9
    assert max(windows.gain(w) for w in ["harmless", "ordinary", "sunshine", *other[:50]]) < 0.5


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (7, 1), (7, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels)
    assert got.count() == len(ODD) and got.where("score IS NULL OR score NOT BETWEEN 0 AND 1 OR held_out IS NULL").count() == 0
    assert len({r.score for r in got.where("doc_id IN (1, 2)").collect()}) == 1
    for some in (labels.where("false"), labels.where("toxic = 0")):
        assert toxicity.toxicity(odd, some).where("predicted = 0").count() == len(ODD)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.where("false")).columns == odd.columns
    clash = odd.withColumn("_text_", F.lit("x")).withColumn("_text", F.lit("y")).withColumn("_toxicity", F.lit(1))
    kept = toxicity.drop_toxic(clash, labels)
    assert kept.columns == clash.columns and kept.count() == toxicity.drop_toxic(odd, labels).count()


def test_toxicity_keeps_the_class_ratio(spark):
    prepare(spark)
    rows = []
    for i in range(6600):
        y = int(i % 11 == 0)
        hit = (i // 11) % 10 < (6 if y else 2)
        rows.append((i, ("vileword " if hit else "") + f"some plain text number{i % 50} again", y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    true = sum(y for _, t, y in rows if "vileword" in t) / sum("vileword" in t for _, t, _ in rows)
    for max_docs in (8000, 350):                           # uncut; ordinary documents cut to about a twelfth
        got = toxicity.toxicity(docs.drop("toxic"), docs.drop("text"), max_docs=max_docs).join(docs, "doc_id").where("text LIKE 'vile%'").agg(F.avg("score"), F.max("predicted")).first()
        assert abs(got[0] - true) < 0.08 and got[1] == 0


# ---------------------------------------------------------------- mixing, sharding

def test_targets_refill_to_the_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0 and sum(got.values()) == pytest.approx(1.5 * 2010)
    assert got["b"] == pytest.approx(2995 * 2 / 3) and got["c"] == pytest.approx(2995 / 3)      # a is capped, b and c share the rest 2 to 1
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 1500), ("d", 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == 1000 and sum(got.values()) == pytest.approx(1.5 * 3010)    # a is capped; what is left caps b; then d (weight 5)
    assert got["d"] == 2000 and got["c"] == pytest.approx(4515 - 3020)
    nothing = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()}
    assert nothing == {"a": 0, None: 0}


def test_mixing_odd_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert {r.source: r.source_size for r in got}[None] == 2
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixture(none).count() == 0


def test_mixing_comes_near_targets(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
                                   F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    first = mixing.mix_sources(df)
    sums = first.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 25 and r.most <= 2 for r in sums)
    key = ["doc_id", "taken"]
    assert first.select(key).exceptAll(mixing.mix_sources(df.repartition(5)).select(key)).count() == 0


def test_unequal_odds_are_kept(spark):
    """Documents with three times the odds are in the sample with three times the odds."""
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20000, "a").otherwise("b").alias("source"), F.lit("one two three four").alias("text"),
                                   F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    got = mixing.mix_sources(df, weights=(1, 5), odds_col="w").where("source = 'a'")
    r = {x.w: x for x in got.join(df.select("doc_id", "w"), "doc_id").groupBy("w").agg(F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("p"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()}
    p1, p3 = r[1.0].p, r[3.0].p
    assert p3 / (1 - p3) / (p1 / (1 - p1)) == pytest.approx(3, rel=0.15)
    assert (p1 + p3) / 2 == pytest.approx(r[1.0].t / r[1.0].s % 1, abs=0.001)


def test_sharding_odd_rows(spark, odd, none):
    got = sharding.extendible_shards(odd, limit_bytes=1000).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.fits == (r.shard_bytes <= 1000) and (r.fits or r.shard_docs == 1)
    assert sharding.extendible_shards(none).count() == 0
    same = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    got = sharding.extendible_shards(same, limit_bytes=1000)
    assert got.where("fits").count() == 500 and got.groupBy("shard_id").agg(F.sum("n_bytes").alias("b")).where("b > 1000").count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards = sharding.extendible_shards(docs, limit_bytes=100_000)
    sharding.write_shards(docs, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert back.groupBy("shard_id").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).where("b > 100000 AND n > 1").count() == 0


def test_shards_hold_every_row_once(spark, tmp_path):
    same = [(7 if i % 2 else None, "x" * 100, str(i)) for i in range(200)] + [(i, None, None) for i in range(5)]
    docs = spark.createDataFrame(same, "doc_id long, text string, _row string")
    sharding.write_shards(docs, sharding.extendible_shards(docs, limit_bytes=1000), str(tmp_path / "plain"))
    sharding.shard(docs.repartition(3), str(tmp_path / "dealt"), limit_bytes=1000)           # not a plain scan
    for name in ("plain", "dealt"):
        back = spark.read.parquet(str(tmp_path / name))
        assert Counter((r.doc_id, r.text, r._row) for r in back.collect()) == Counter(same)
        assert back.groupBy("shard_id").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 1000").count() == 0
    other = docs.orderBy(F.desc("_row"), F.desc("doc_id"))
    with pytest.raises(ValueError):
        sharding.write_shards(other, sharding.extendible_shards(docs, limit_bytes=1000), str(tmp_path / "other"))


# ---------------------------------------------------------------- quality against a plain model

def plain_kneser_ney(sample):
    """``log10 p(token | history)`` of one language from its training texts, by dictionaries."""
    pairs = Counter()
    for t in sample:
        w = [*WORD.findall((t or "").translate(LOWER)), None]
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))

    def off(counts):
        n = {k: sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {k: max(0.05, min(k - 0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[1] and n[k] else 0.5 for k in (1, 2, 3)}
        return lambda c: d[min(c, 3)]
    cut, kinds = off(pairs), Counter(w for _, w in pairs)
    low, total = off(kinds), sum(kinds.values())
    unknown = sum(low(c) for c in kinds.values()) / total / (len(kinds) + 1)
    lower = {w: (c - low(c)) / total + unknown for w, c in kinds.items()}
    seen, taken = Counter(), defaultdict(float)
    for (h, _), c in pairs.items():
        seen[h] += c
        taken[h] += cut(c)

    def log(history, token):
        share = (pairs[(history, token)] - cut(pairs[(history, token)])) / seen[history] if (history, token) in pairs else 0.0
        return math.log10(share + (taken[history] / seen[history] if history in seen else 1.0) * lower.get(token, unknown))
    return log


def test_quality_against_a_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    max_docs = 40
    got = {r.doc_id: r for r in quality.quality(docs, labels, max_docs=max_docs).collect()}
    texts = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect() if r.doc_id in texts}
    h = {i: (int(hashlib.md5(f"q{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for i in good}
    by = defaultdict(list)
    for i in good:
        by[texts[i][0]].append(i)
    level = quality._level([len(v) for v in by.values()], max_docs)
    for lang, ids in by.items():
        low, high = min(h[i] for i in ids), max(h[i] for i in ids)
        trains = [i for i in ids if h[i] == low or (h[i] < min(0.5, level / len(ids)) and h[i] < high)]
        log = plain_kneser_ney([texts[i][1] for i in trains])
        want = {}
        for i, (own, t) in texts.items():
            if own == lang:
                w = [*WORD.findall((t or "").translate(LOWER)), None]
                want[i] = 10 ** min(-sum(map(log, ["<s>", *w[:-1]], w)) / len(w), 300)
                assert got[i].perplexity == pytest.approx(want[i], rel=1e-9)
        held = sorted(want[i] for i in ids if i not in trains)
        if held:
            assert got[ids[0]].threshold in [pytest.approx(x) for x in held]
            assert sum(x <= got[ids[0]].threshold for x in held) >= 0.995 * len(held) - 1
        for i in want:
            assert got[i].kept == (got[i].threshold is None or got[i].perplexity <= got[i].threshold)


def test_quality_trains_on_every_trusted_text_of_its_half(spark):
    prepare(spark)
    texts = {i: f"w{i % 53} v{i % 31} w{i * i % 41} u{i}" for i in range(18000)}
    docs = spark.createDataFrame([(i, "x", t) for i, t in texts.items()], "doc_id long, lang string, text string").repartition(4)
    got = {r.doc_id: r.perplexity for r in quality.quality(docs, docs.select("doc_id", F.lit(1).alias("quality"))).where("doc_id < 40").collect()}
    h = {i: (int(hashlib.md5(f"q{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for i in texts}
    log = plain_kneser_ney([t for i, t in texts.items() if h[i] < 0.5])
    for i, p in got.items():
        w = [*texts[i].split(), None]
        assert p == pytest.approx(10 ** (-sum(map(log, ["<s>", *w[:-1]], w)) / len(w)), rel=1e-9)
    assert len(got) == 40
