"""The registered queries as they stand: their SQL, the folds, and the pipeline's and operators' brute-force versions on the smallest tables."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawl.llm import decontam, packing, quality, queries, topk

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SPACES = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, db, name):
    want, got = db.execute(queries.ORACLE_SQL[name]).fetchdf(), queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda f: sorted(tuple(map(str, r)) for r in f[sorted(f.columns)].astype(object).fillna("").itertuples(index=False))
    assert rows(got) == rows(want)


@here
def test_packing_query(spark, texts):
    got = queries.op1_best_fit_packing(spark, DATA).toPandas()
    assert set(got.doc_id) == set(texts) and got.groupby("sequence_id").length.sum().max() <= 2048
    assert all(g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] for _, g in got.sort_values("piece").groupby("doc_id"))
    # as few as the tokens need, or a few more
    assert got.sequence_id.nunique() <= 1.04 * -(-got.length.sum() // 2048)


@here
def test_simhash_query(spark, texts):
    prints = {}
    for k, t in texts.items():
        lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        w = SPACES.findall(lower)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_near_dedup(spark, DATA).collect()}
    assert got == {k: (f"{prints[k]:016x}", find(k)) for k in ids}


@here
def test_suffix_array_query(spark, texts):
    seen = collections.defaultdict(list)
    raw = {k: (t or "").encode() for k, t in texts.items()}
    for k, b in raw.items():
        for p in range(len(b) - 399):
            seen[hash(b[p : p + 400])].append((k, p))
    marks = {k: np.zeros(len(b), bool) for k, b in raw.items()}
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                marks[k][p : p + 400] = True
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_suffix_array_dedup(spark, DATA).collect()}
    for k, b in raw.items():
        m = marks[k]
        spans = int((np.diff(np.append(0, m.astype(int))) == 1).sum())
        assert got[k] == (len(b), int(m.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())


@here
def test_folds_and_scores(spark, db, texts):
    labels = dict(db.execute("SELECT doc_id, quality FROM labels").fetchall())
    got = queries.op5_quality_classifier(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    if {y for _, y in held} == {0, 1}:
        assert min(x for x, y in held if y) > np.mean([x for x, y in held if not y])
    langs = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op7_language_id(spark, DATA).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and len(got) == len(texts)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


@here
def test_line_query(spark, texts):
    got = queries.op8_line_dedup(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(r["n_removed"] == len([x for x in r["removed"].split(",") if x]) <= r["n_lines"] for r in got)


def profile(texts, top):
    counts = collections.Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            padded = f" {w} "
            counts.update(w)
            counts.update(padded[i : i + 3] for i in range(len(w)))
        spaced = " " + "".join(f"{w} " for w in "".join(c if c.isalpha() else " " for c in t.lower()).split())
        counts.update(spaced[i : i + 2] for i in range(len(spaced) - 1) if len(spaced) > 1)
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:top]]


@here
def test_language_against_brute_force(spark, db):
    rows = db.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None]
    profiles = {x: profile([r[1] for r in learn if r[2] == x], 400) for x in {r[2] for r in learn}}
    ranks = {x: {g: k for k, g in enumerate(p)} for x, p in profiles.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op7_language_id(spark, DATA).collect()}
    for doc_id, text, _ in rows:
        mine = profile([text or ""], 400)
        if not mine:
            assert got[doc_id] == ("und", 0.0)
            continue
        d = {x: sum(abs(r[g] - k) if g in r else 400 for k, g in enumerate(mine)) for x, r in ranks.items()}
        best = min(sorted(d), key=d.get)
        assert got[doc_id][0] == best and abs(got[doc_id][1] - (1 - d[best] / (400 * len(mine)))) < 1e-12


def smith_waterman(item, words):
    best, above = 0, [0] * (len(words) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


@pytest.mark.parametrize("block_bytes", [4_000_000, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 25))] for _ in range(6)]
    texts = []
    for k in range(40):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if k % 2:
            part = list(rng.choice(items))
            for _ in range(k % 7):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            w[20:20] = part
        texts.append(w)
    texts.append([x for _ in range(300) for x in texts[0]] + items[0])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminations(docs, bench, block_bytes=block_bytes).collect()}
    want = {}
    for k, w in enumerate(texts):
        for i, item in enumerate(items):
            score = smith_waterman(item, w) / (2 * len(item))
            if score >= 0.5:
                want[k, i] = score
    # a pair without any three words in a row has no seed
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    assert got == {(k, i): s for (k, i), s in want.items() if grams(texts[k]) & grams(items[i])}
    left = {r["doc_id"] for r in decontam.clean(docs, bench, block_bytes=block_bytes).collect()}
    assert left == set(range(len(texts))) - {k for k, _ in got}


def test_best_fit_against_a_plain_search():
    rng = random.Random(6)
    for limit in (1, 3, 40):
        bins, free, open_ = packing.OpenBins(50, limit), {}, []
        for _ in range(600):
            n = rng.randint(1, 50)
            b, at = bins.place(n)
            fitting = [free[x] for x in open_ if free[x] >= n]
            if fitting:
                assert b in open_ and free[b] == min(fitting)
            else:
                assert b not in free
                if len(open_) == limit:
                    open_.remove(min(open_, key=lambda x: (free[x], x in bins.by_free[free[x]])))
                free[b] = 50
                open_.append(b)
            assert at == 50 - free[b]
            free[b] -= n
            if not free[b]:
                open_.remove(b)
            still = {x for group in bins.by_free for x in group}
            assert still == set(open_) and len(still) == bins.open <= limit


@pytest.mark.parametrize("top,block", [(1e6, 16_384), (1e6, 30), (1e12, 16_384), (3e38, 16_384)])
def test_top_k_of_large_components(spark, top, block):
    rng = np.random.default_rng(5)
    v = rng.uniform(-top, top, size=(120, 8)).astype(np.float32)
    v[60:80] = v[60] * (1 + rng.integers(0, 2, (20, 1)).astype(np.float32) * np.float32(1e-7))
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = [[int(np.floor(np.float64(256) * np.float64(x))) for x in r] for r in v]
    clip = lambda s: max(-topk.MOST, min(topk.MOST, s))
    want = set()
    for k in range(0, 120, 50):
        scored = sorted((-clip(sum(a * b for a, b in zip(q[k], q[j]))), j) for j in range(120) if j != k)[:5]
        want |= {(k, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=block, query_block=8).collect()} == want


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 9.0]), *[(k, [float(k), 1.0]) for k in range(1, 8)], (3, [3.0, 1.0]), (9, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    # the smallest of the vectors of id 0 asks; both rows of id 3 are found
    q = [128, 9 * 256]
    want = sorted((-(q[0] * 256 * x + q[1] * 256), i) for i, x in [(k, k) for k in range(1, 8)] + [(3, 3)])[:5]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_quality_takes_a_bounded_share(spark):
    rows = [(k, ("word " if k % 2 else "#! ") * (200 + k)) for k in range(60)] + [(100, "word " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(100, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.GatedAttention.fit
    try:
        quality.GatedAttention.fit = lambda self, bags, target, **o: seen.append((len(bags), sum(map(len, bags)))) or fit(self, bags, target, **o)
        quality.train(docs, labels, train_bytes=20_000)
        quality.train(docs, labels, train_docs=10)
        quality.train(docs, labels, train_bytes=0)
    finally:
        quality.GatedAttention.fit = fit
    assert 2 < seen[0][0] < 60 and seen[0][1] * quality.PASSAGE < 25_000 + 2_000_000 and seen[1][0] <= 10 and seen[2][0] == 2


def test_shared_folder_is_asked_for():
    from unittest.mock import MagicMock

    from trawl.llm import common

    session = MagicMock()
    session.conf.get.return_value = None
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session)
    session.conf.get.return_value = "hdfs:///shared"
    assert common.shared_dir(session) == "hdfs:///shared"


def test_empty_tables_of_registered_queries(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    import corpus_pipeline

    for f in (*queries.QUERIES.values(), corpus_pipeline.run):
        assert f(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_nulls_of_registered_queries(spark, tmp_path):
    """Extra columns named like results and working columns; nulls everywhere; one row twice."""
    import corpus_pipeline

    t = " ".join(f"word{k % 17} number{k}" for k in range(300))
    docs = [(1, t), (2, t + " end"), (2, t + " end"), (None, None), (3, None), (4, ""), (None, t), (5, "x" * 3000), (6, "short\nshort\n" + t)]
    names = "removed line name keys check grp cell side label block part score keep fp key at lo hi salt start end piece length verdict rule host path rank v norm gram n".split()
    extra = {x: F.lit(7) for x in names}
    write = lambda df, name: df.withColumns(extra).write.parquet(str(tmp_path / f"{name}.parquet"))
    write(spark.createDataFrame([(*r, "en" if r[0] != 4 else None, None, 1) for r in docs], "doc_id long, text string, lang string, source string, n_chars long"), "documents")
    write(spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int"), "labels")
    write(spark.createDataFrame([(1, "word1 number1 word2 nothing"), (None, "a b c"), (2, None), (3, "")], "item_id long, text string"), "benchmark")
    write(spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 3.0]), (None, [1.0, 1.0]), (2, None)], "vec_id long, embedding array<float>"), "embeddings")
    write(spark.createDataFrame([(1, "http://a.b/c", "<p>"), (1, "http://a.b/c", "<p>"), (None, None, None), (2, "x", "<p>")], "page_id long, url string, html string"), "pages")
    got = {name: f(spark, str(tmp_path)).collect() for name, f in queries.QUERIES.items()}
    assert all(len(got[n]) == len(docs) for n in got if n.split("_")[0] in ("op2", "op4", "op5", "op6", "op7", "op8"))
    assert len(got["op10_url_reputation"]) == 4 and [tuple(r) for r in got["op9_exact_top_k"]] == [(0, 1, 1, 256 * 256 * 8)]
    warc = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got["op11_warc"])
    assert warc == [(0, 0, "response", None), (1, 3, "response", None), (1, 3, "response", None), (2, 3, "revisit", 1)]
    assert len(got["op12_embedding_whitening"]) == 4 * 2 and got["op13_phrase_collocations"] == []
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert set(extra) < set(d.columns)
    corpus_pipeline.run(spark, str(tmp_path)).collect()
