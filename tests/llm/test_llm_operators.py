"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawl.llm.common import Stored, group_pieces
from trawl.llm import decontam, language, line_dedup, packing, quality, recompression, simhash, suffix_array, topk, url_reputation

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()


def words(rng, n):
    return [("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 90))
    texts = [None, "", " \n\t ", "one", "one two"]
    for k in range(30):
        w = words(rng, rng.randint(5, 260))
        t = " ".join(w)
        if k % 3 == 0:
            t = " ".join(w[: len(w) // 2]) + " " + passage + "\n" + " ".join(w[len(w) // 2 :])
        texts.append(t)
    texts += [texts[8], texts[8], texts[8].replace(" ", "  ", 3), texts[11] + " end", "ab " * 400, "ab " * 300, "x" * 5000, "é" * 700 + texts[9], "\n".join([texts[12]] * 3)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with working names of the operators
    rows = [(k, t, "en" if k % 2 else "de", "s", 1, "x", 3) for k, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, name string, keep int").repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and equal rows."""
    t = " ".join(words(random.Random(5), 120))
    return spark.createDataFrame([(None, t), (None, None), (7, t), (7, t), (7, "other text"), (8, "")], "doc_id long, text string")


def test_packing(docs, empty, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).toPandas()
    for doc_id, text in enumerate(corpus()):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        mine, at = got[got.doc_id == doc_id].sort_values("piece"), 0
        for k, r in enumerate(mine.itertuples()):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids) and (mine.length[1:] == 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack_documents(empty).count() == 0 and packing.pack_documents(odd).count() == 6
    enc = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for s in ("a\u00a0b  c\n\n d", "<|endoftext|> x", "漢字 と かな", "don't  stop\r\n", "\u200b \x1f x", "ß\u0301 'll 12ab"):
        assert enc.ids(s) == np.array(tok.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_open_bins_stay_bounded():
    bins, fill = packing.OpenBins(10, 2), {}
    for n in (6, 7, 8, 4, 10, 3, 2, 1):
        b, at = bins.place(n)
        assert at == fill.get(b, 0)
        fill[b] = at + n
        assert fill[b] <= 10 and bins.open <= 2


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def test_simhash(docs, empty, odd):
    texts = corpus()
    fps = [simhash.fingerprint(t) for t in texts]
    want = components(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert all(got[k]["fingerprint"] == f"{fps[k]:016x}" for k in range(len(texts)))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(docs).count() == len(set(want))
    assert simhash.one_of_each(odd).count() == 3 and simhash.near_duplicates(odd).count() == 6


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in base], dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    want = components(len(fps), lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= 3)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    for dense in (2048, 1):
        pairs = {(place[r["u"]], place[r["v"]]) for r in simhash.links(df, 3, Stored(spark), dense).collect()}
        assert components(len(fps), lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def five_word_sets(texts):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]


@pytest.mark.parametrize("dense", [512, 2])
def test_near_duplicates_of_the_pipeline(spark, docs, empty, odd, dense):
    from trawl.llm import queries

    rng, texts = random.Random(12), corpus()
    for k in range(60):
        w = words(rng, rng.choice([8, 14, 40, 150, 300]))
        texts.append(" ".join(w))
        for _ in range(2):
            edited = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 40))):  # each edit changes at most 5 shingles
                edited[rng.randrange(len(w))] = "".join(rng.choice(SYLLABLES) for _ in range(5))
            texts.append(" ".join(edited))
    sets = five_word_sets(texts)
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])
    root = components(len(texts), near)
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert sum(near(a, b) and (prints[a] ^ prints[b]).bit_count() > 3 for a, b in itertools.combinations(range(len(texts)), 2)) > 20
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = queries.stage_near_duplicates(spark, d, "") if dense == 512 else simhash.one_of_similar(d, dense=dense)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))
    if dense == 512:
        assert simhash.one_of_similar(docs).columns == docs.columns and simhash.one_of_similar(empty).count() == 0
        assert simhash.one_of_similar(odd).count() == 3


def test_decontamination(spark, docs, empty, odd):
    items = spark.createDataFrame([(1, " ".join(corpus()[8].split()[3:33])), (2, "zz yy xx ww vv uu tt ss"), (3, None), (None, "a b c"), (4, "")], "item_id long, text string")
    found = decontam.contaminations(docs, items).collect()
    assert {8, 35, 36, 37} <= {r["doc_id"] for r in found} and {r["item_id"] for r in found} == {1}
    assert all(r["score"] == 1.0 for r in found if r["doc_id"] == 8)
    item = corpus()[8].split()[3:33]
    edited = item[:9] + ["new"] + item[10:20] + item[21:]
    texts = spark.createDataFrame([(1, "start " + " ".join(edited) + " stop"), (2, "nothing here at all")], "doc_id long, text string")
    got = decontam.contaminations(texts, items).collect()
    assert [(r["doc_id"], r["first_word"], r["end_word"]) for r in got] == [(1, 1, 30)]
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and {8, 35, 36, 37}.isdisjoint(r["doc_id"] for r in left.collect())
    assert decontam.contaminations(empty, items).count() == 0 and decontam.contaminations(docs, items.limit(0)).count() == 0
    assert decontam.clean(odd, items).count() == 6


def test_decontamination_by_short_items_and_without_spaces(spark):
    items = spark.createDataFrame([(1, "Zorbal"), (2, "grün Quax"), (3, "東京は日本の首都です"), (4, "...")], "item_id long, text string")
    texts = ["a zorbal here", "Zorbals", "it is grün, quax!", "quax grün", "皆さん、東京は日本の首都です。", "東京は日本の大きな首都です", "京都", "nothing", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["first_word"], r["end_word"]) for r in decontam.contaminations(d, items).collect()}
    assert set(got) == {(0, 1), (2, 2), (4, 3), (5, 3)}
    assert got[0, 1] == (1.0, 1, 2) and got[2, 2] == (1.0, 2, 4) and got[4, 3] == (1.0, 3, 13)
    assert [r["doc_id"] for r in decontam.clean(d, items).orderBy("doc_id").collect()] == [1, 3, 6, 7, 8]


def repeated_bytes(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, b in enumerate(raw):
        for p in range(len(b) - n + 1):
            seen.setdefault(b[p : p + n], []).append((k, p))
    marks = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                marks[k][p : p + n] = True
    return raw, marks


@pytest.mark.parametrize("dense,colliding", [(2, False), (1, True), (1024, False), (1024, True)])
def test_suffix_array(spark, docs, empty, odd, dense, colliding, monkeypatch):
    spans, described = suffix_array.repeated_spans, suffix_array.described
    monkeypatch.setattr(suffix_array, "repeated_spans", lambda d, w, s: spans(d, w, s, dense))
    if colliding:  # all runs in one class, until digests tell them apart
        monkeypatch.setattr(suffix_array, "described", lambda *a: described(*a).withColumn("r", F.col("r") % 2))
    raw, marks = repeated_bytes(corpus(), 400)
    got = {r["doc_id"]: r for r in suffix_array.remove_repeats(docs).collect()}
    for k, (b, m) in enumerate(zip(raw, marks)):
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        assert got[k]["n_removed"] == m.sum() and got[k]["kept_sha256"] == hashlib.sha256(kept).hexdigest(), k
        assert got[k]["n_spans"] == int((np.diff(np.append(0, m.astype(int))) == 1).sum())
    assert suffix_array.remove_repeats(empty).count() == 0
    rows = suffix_array.remove_repeats(odd).collect()
    assert len(rows) == 6 and all(r["n_removed"] == r["n_bytes"] for r in rows if r["n_bytes"] > 400)


def test_windows_of_one_key_without_a_repeat():
    zero, one = np.zeros(2, np.int32), np.ones(2, np.int32)
    row, start = suffix_array.repeated_windows(np.array([1, 1]), one, zero, one, [b"abcdef", b"zbcdeg"], 5)
    assert len(row) == len(start) == 0


def test_suffix_array_survives_a_collision(monkeypatch):
    monkeypatch.setattr(suffix_array.PrefixHash, "of", lambda self, start, length: np.zeros(np.shape(start), np.uint64))
    keys, zero, hi = np.array([1, 1, 1]), np.zeros(3, np.int32), np.full(3, 1, np.int32)
    row, start = suffix_array.repeated_windows(keys, np.ones(3, np.int32), zero, hi, [b"abcdef", b"abcdeg", b"zbcdeg"], 5)
    assert sorted(zip(row.tolist(), start.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("colliding", [False, True])
def test_recompression(docs, empty, odd, colliding, monkeypatch):
    described = recompression.described
    if colliding:
        monkeypatch.setattr(recompression, "described", lambda *a: described(*a).withColumn("r", F.col("r") % 2))
    first, got = set(), {r["doc_id"]: r for r in recompression.remove_repeats(docs).collect()}
    for k, t in enumerate(corpus()):
        w = (t or "").encode().split()
        mark = np.zeros(len(w), bool)
        for p in range(len(w) - 19):
            window = tuple(w[p : p + 20])
            if window in first:
                mark[p : p + 20] = True
            first.add(window)
        kept = b" ".join(x for x, m in zip(w, mark) if not m)
        assert (got[k]["n_words"], got[k]["n_removed"]) == (len(w), mark.sum()), k
        assert got[k]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert recompression.remove_repeats(empty).count() == 0
    rows = recompression.remove_repeats(odd).collect()
    assert len(rows) == 6 and [r["n_removed"] for r in rows if r["doc_id"] is None and r["n_words"]] == [0]


def test_quality(spark, docs, empty, odd):
    rng = random.Random(2)
    rows = [(k, " ".join(words(rng, 80)) if k % 2 else "!! ".join(words(rng, 80)).upper()) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(150)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(d, labels)
    scored = quality.predict(d.withColumn("held_out", F.col("doc_id") >= 150), model).toPandas()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in scored[scored.held_out].itertuples())
    rest = quality.predict(odd.withColumn("held_out", F.lit(True)), model).toPandas()
    assert len(rest) == 6 and rest.score.between(0, 1).all()
    assert quality.predict(empty.withColumn("held_out", F.lit(True)), model).count() == 0
    assert isinstance(quality.train(d, labels.limit(0)), quality.Constant) and isinstance(quality.train(d, labels.where("quality = 1")), quality.Constant)
    assert quality.accepted(docs, model).columns == docs.columns


def test_quality_gradient():
    rng = np.random.default_rng(1)
    x, first, y = rng.normal(size=(7, quality.WIDTH)).astype(np.float32), np.array([0, 3, 4]), np.array([1, 0, 1], np.float32)
    m = quality.GatedAttention()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    loss = lambda: -np.mean(y * np.log(p := m.score(x, first)) + (1 - y) * np.log(1 - p))
    g = m.gradient(x, first, y)
    for k in m.p:
        at = tuple(s // 2 for s in m.p[k].shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4


def test_language(spark, empty, odd):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("x", None)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(model) == ["en", "fr"]
    d = spark.createDataFrame([(1, "the dog", True), (2, "le chien", True), (3, None, True), (4, "12 !", False), (None, "the", None)], "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in language.predict(d, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, None)] == ["en", "fr", "und", "und", "en"] and 0 <= got[1]["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(d, {}).collect()} == {"und"}
    assert language.predict(empty.withColumn("held_out", F.lit(True)), model).count() == 0 and language.train(spark.createDataFrame([], "text string, lang string")) == {}


def test_line_dedup(spark, empty, odd):
    rng = random.Random(9)
    lines = [" ".join(words(rng, 25)) for _ in range(40)]
    texts = []
    for k in range(30):
        own = [" ".join(words(rng, 25))]
        near = rng.choice(lines)
        near = near[: len(near) // 2] + rng.choice(["", "qq", "Z"]) + near[len(near) // 2 :]
        texts.append("\n".join([rng.choice(lines), near, "", "short", *own]))
    texts += [None, "", "short", texts[3]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = [(k, j, line_dedup.normalized(x)) for k, t in enumerate(texts) for j, x in enumerate((t or "").split("\n")) if len(line_dedup.normalized(x)) >= 10]
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for _, _, x in places]
    root = components(len(places), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = {(k, j) for n, (k, j, _) in enumerate(places) if root[n] != n}
    weak = lambda b: xxhash.xxh3_128_digest(b)[:8] + bytes(7) + bytes([len(b) % 2])
    for options in ({}, {"dense": 2}, {"digest": weak}):
        got = {(r["__id"], r["line"]) for r in line_dedup.duplicate_lines(d, **options)[1].collect()}
        assert got == want
    d = d.withColumns({"removed": F.lit("x"), "line": F.lit(3)})
    out = {r["doc_id"]: r for r in line_dedup.without_lines(d, line_dedup.removals(d)).collect()}
    assert out[0]["removed"] == "x"
    assert len(out) == len(texts) and out[30]["text"] is None and out[32]["text"] == "short"
    assert all(out[k]["text"] == "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in want) for k, t in enumerate(texts) if t is not None)
    assert line_dedup.removals(empty).count() == 0 and line_dedup.removals(odd).count() >= 1


def test_line_dedup_of_very_long_texts(spark):
    rng = random.Random(11)
    own = [" ".join(words(rng, 6)) + f" {k}" for k in range(20_000)]
    long = " ".join(words(rng, 20_000))
    texts = ["\n".join([*own, long]), "\n".join([own[5], "kept line of text", long[:-9] + " changed"]), "\n" * 50_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(d, line_dedup.removals(d)).collect()}
    assert out[1] == "kept line of text" and out[2] == texts[2] and len(out[0]) > len(long)


def test_chains_across_parts_of_a_large_group(spark):
    """A chain in which only neighbours are similar, in one band, cut into parts of two."""
    from trawl.llm import groups

    rows = [(k, 10 * k) for k in range(40)] + [(100 + k, 5000 + 1000 * k) for k in range(5)]
    values = spark.createDataFrame(rows, "name long, x long")
    grouped = values.select(F.lit(1).cast("long").alias("grp"), "name", F.lit(45).cast("long").alias("n"))

    def compare(columns, label, k):
        x, label, out = columns[0].to_numpy(), list(label), []
        for a in range(k or 0, len(x)):
            for b in range(a if k is None else k):
                if label[a] != label[b] and abs(x[a] - x[b]) <= 10:
                    old, new = label[a], label[b]
                    label = [new if y == old else y for y in label]
                    out.append((a, b))
        return out

    for dense in (2, 64):
        found = groups.linked(grouped, values, ("x",), compare, Stored(spark), dense, 10).collect()
        pairs = {(r["u"], r["v"]) for r in found}
        root = components(45, lambda a, b: (rows[a][0], rows[b][0]) in pairs or (rows[b][0], rows[a][0]) in pairs)
        assert root == [0] * 40 + list(range(40, 45))


def test_groups_larger_than_a_piece():
    import pyarrow as pa

    keys = np.sort(np.array([1] * 3 + [2] * 50 + [3] * 2 + [4] * 7))
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 4]}) for i in range(0, len(keys), 4)]
    got = [(t.column("k").to_pylist(), whole) for t, whole in group_pieces(iter(batches), "k", 5, most=10)]
    assert sum((x for x, _ in got), []) == keys.tolist()
    assert {k for x, whole in got if not whole for k in x} == {2} and all(2 not in x for x, whole in got if whole)
    whole = [t.column("k").to_pylist() for t, _ in group_pieces(iter(batches), "k", 5)]
    assert sorted(k for x in whole for k in set(x)) == [1, 2, 3, 4]


def test_line_dedup_of_short_lines(spark):
    from trawl.llm import queries

    rng = random.Random(10)
    a, b = (" ".join(words(rng, 25)) for _ in range(2))
    texts = [a + "\nLes.", a + "\nLes.", a + "\n les. \n", b + "\nLes.\n\nNeu.", "Les.", "Lea.", a + "\nLex."]
    d = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {(r["__id"], r["line"]) for r in line_dedup.duplicate_lines(d, short=True)[1].collect()}
    assert got == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 1), (4, 0), (6, 0)}
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in queries.stage_lines(spark, d, "").collect()}
    assert left == {0: (texts[0], len(texts[0])), 3: (b + "\n\nNeu.", len(b) + 6), 5: ("Lea.", 4), 6: ("Lex.", 4)}


@pytest.mark.parametrize("block", [16_384, 50])
def test_top_k(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8)) * rng.lognormal(0, 1, (400, 1))
    v[100:160] = v[100]
    v[50] = 0
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(500, None), (550, [None] * 8), (600, [float("nan")] * 8), (650, [1.0, 2.0]), (700, [float("inf")] * 8), (None, [1.0] * 8), (750, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(256 * v.astype(np.float32).astype(float))
    want = set()
    for k in range(0, 400, 50):
        s = q @ q[k]
        order = [j for j in np.lexsort((np.arange(400), -s)) if j != k][:5]
        want |= {(k, n + 1, int(j), int(s[j])) for n, j in enumerate(order)}
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=block, query_block=8).collect()}
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_url_reputation(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.org/es/x?q"), (2, "https://b.com/de/1#f"), (3, "http://spam.net/"), (4, None), (5, "nourl"), (6, "x://y.example.org/en/12"), (7, "http://org/"), (8, "http://good.net"), (None, "http://solo.xyz/a")], "page_id long, url string")
    outcomes = spark.createDataFrame([(3, 0), (8, 1), (1, 1), (2, 1), (6, None), (None, 1)], "page_id long, good int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, outcomes).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2]["rule"] == "com/de/" and got[6]["rule"] == "example.org/en/1" and got[7]["rule"] == "org/"
    assert got[4]["host"] == got[5]["path"] == "" and got[8]["path"] == "" and got[4]["rule"] is None
    assert got[3]["reputation"] < got[8]["reputation"] and all(r["verdict"] in ("allow", "block") for r in got.values()) and len(got) == 9
    assert url_reputation.judge(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in url_reputation.judge(pages, outcomes.limit(0)).collect()} <= {"allow", "block"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    item = " ".join(words(rng, 30))
    texts = [" ".join(words(rng, 120)) for _ in range(60)]
    texts[50] = texts[10]
    texts[51] = texts[11][:200] + " changed " + texts[11][210:]
    texts[52] = texts[52] + " " + item
    bad = ["!! ".join(words(rng, 60)).upper() for _ in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts + bad)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(100) if k % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == set(range(60)) - {50, 51, 52}
    docs = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns


def test_similar_documents_are_found_by_their_fingerprints(spark):
    """the stage's SimHash search proposes candidates itself; here the one MinHash band does not."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[:200] + [f"x{n}"] + words[200:]) for n in range(12)] + [" ".join(f"y{k}" for k in range(300))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = simhash.shingle_sets(simhash.plain(docs), 5, 1, 63).collect()
    first = next(r for r in sets if r["doc_id"] == 0)
    near = [r["doc_id"] for r in sets if r["doc_id"] and r["keys"] != first["keys"] and ((r["fp"] ^ first["fp"]) % 2**64).bit_count() <= 3]
    assert near  # linked by SimHash, by no band
    pair = docs.where(f"doc_id IN (0, {near[0]}, 12)")
    assert sorted(r["doc_id"] for r in simhash.one_of_similar(pair, bands=1, rows=63).collect()) == [0, 12]
