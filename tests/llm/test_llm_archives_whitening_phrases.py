"""WARC archives, embedding whitening and phrase collocations against brute force, with odd input."""

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest

from trawl.llm import collocations, warc, whitening

PAGES = "page_id long, url string, html string"


# ---- WARC


def round_trip(spark, rows, least=0):
    return sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, PAGES + ", length long" if rows and len(rows[0]) == 4 else PAGES), least).collect()), key=repr)


def expected(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == payload]
        first = min((p for p in same if p is not None), default=None) if len(payload) >= least else page
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=repr)


ODD_PAGES = [
    (5, "http://a.org/x", "dup"), (3, "http://b.org/y", "dup"), (3, "http://b.org/y", "dup"), (9, None, None), (8, "", ""), (None, "u", "dup"), (None, "v", "alone"),
    (11, "http://a b/\r\nWARC-Type: x", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (12, " é ", "\0\r\n\r\n\t"), (13, "x", "long " * 700_000), (14, "y", "long " * 700_000),
]


@pytest.mark.parametrize("least", [0, 3, 4])
def test_round_trip(spark, least):
    assert round_trip(spark, ODD_PAGES, least) == expected(ODD_PAGES, least)


def test_hot_payload_extra_columns_and_empty_table(spark):
    rows = [(k, f"u{k}", "hot" if k % 3 else f"t{k}", 7) for k in range(300)]
    assert round_trip(spark, rows) == expected(rows)
    assert round_trip(spark, []) == []


def test_archives_are_warc_files_cut_by_bytes(spark, tmp_path):
    rows = [(k, "http://h/p", f"page {k} " * 300) for k in range(60)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/w", archive_bytes=40_000)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) > 3
    seen = set()
    for f in files:
        data = gzip.decompress(f.read_bytes())
        while data:  # an independent reader: head, length, block, two line ends
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head[head.rindex(b"\r\n") :])[1])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kind = re.search(rb"WARC-Type: (\w+)", head)[1]
            if kind == b"response":
                seen.add(rest[:n].partition(b"\r\n\r\n")[2].decode())
            data = rest[n + 4 :]
    assert seen == {r[2] for r in rows}
    back = warc.assemble(warc.read(spark, f"{tmp_path}/w")).collect()
    assert {bytes(r["body"]).decode() for r in back} == seen and all(r["intact"] and r["requests"] == r["metadatas"] == 1 for r in back)


def raw(kind, rid, block=b"", **fields):
    return warc.record(kind, {"WARC-Record-ID": rid} | {k.replace("_", "-"): v for k, v in fields.items()}, block) + warc.CLOSE


def test_assembly_of_foreign_archives(spark, tmp_path):
    http = {"Content_Type": "application/http"}
    records = [
        raw("warcinfo", "i", b"software: x"),
        # links in the request; metadata by way of the request; two metadata records
        raw("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody1", WARC_Payload_Digest=f"sha1:{warc.sha1(b'body1')}", **http),
        raw("request", "q1", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="r1", **http),
        raw("metadata", "m1", b"a: 1", WARC_Concurrent_To="q1"),
        raw("metadata", "m0", b"b: 2", WARC_Concurrent_To="r1"),
        # links in the response, which comes before; broken digest
        raw("response", "r2", b"HTTP/1.1 200 OK\r\n\r\nbody2", WARC_Concurrent_To="q2", WARC_Payload_Digest="sha1:AAAA", **http),
        raw("request", "q2", b"", **http),
        raw("response", "r3", b""),
        raw("metadata", "m9", b"", WARC_Concurrent_To="nowhere"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records[:5]))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[5:]))
    (tmp_path / "broken.warc").write_bytes(raw("response", "r4", b"x") + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "none.warc").write_bytes(b"")
    found = warc.read(spark, str(tmp_path)).cache()
    got = {r["capture_id"]: r for r in warc.assemble(found).collect()}
    assert set(got) == {"r1", "r2", "r3", "r4"}
    assert (got["r1"]["request"]["record_id"], got["r1"]["metadata"]["record_id"], got["r1"]["requests"], got["r1"]["metadatas"]) == ("q1", "m0", 1, 2)
    assert bytes(got["r1"]["body"]) == b"body1" and got["r1"]["intact"] and got["r2"]["intact"] is False
    assert got["r2"]["request"]["record_id"] == "q2" and got["r2"]["metadata"] is None and got["r3"]["request"] is None and got["r3"]["metadatas"] == 0
    assert sorted((r["type"], r["record_id"]) for r in warc.unattached(found).collect()) == sorted([("damaged", None), ("metadata", "m9"), ("warcinfo", "i")], key=repr)
    assert warc.read(spark, str(tmp_path), payloads=False).where("type = 'response' AND body IS NOT NULL").isEmpty()


# ---- whitening


def exact_turn(d):
    """An orthogonal symmetric matrix whose entries are exact: a Kronecker power of 1 - J/2."""
    h, out = np.eye(4) - 0.5, np.ones((1, 1))
    while len(out) < d:
        out = np.kron(out, h)
    return out


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 64), np.geomspace(1e-9, 1e6, 64), np.r_[1 + np.arange(16) * 2.0**-36, 3 + np.arange(32), 40 + np.arange(16) * 2.0**-40], np.r_[8.0, 7.0, np.arange(14) * 2.0**-30 + 2], np.r_[[5.0] * 8, [1.0] * 8],
])
def test_eigenvectors_to_double_precision(values):
    turn, exact = exact_turn(len(values)), np.sort(values)[::-1]
    wide = (turn.astype(np.longdouble) * values.astype(np.longdouble)) @ turn.astype(np.longdouble)
    high = wide.astype(np.float64)
    got, vectors = whitening.eigen([high, (wide - high).astype(np.float64)])
    assert np.abs(got - exact).max() <= 4e-16 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 2e-15
    order = np.argsort(-values, kind="stable")
    for k, true in enumerate(turn[:, order].T):
        gap = np.abs(np.delete(exact, k) - exact[k]).min()
        if gap:  # twice the working precision parts gaps that double precision alone can't
            off = min(np.abs(vectors[:, k] - true).max(), np.abs(vectors[:, k] + true).max())
            assert off < max(2e-15, 2e-20 * exact[0] / gap) + 1e-15


def whitened(spark, rows, schema="vec_id long, embedding array<float>"):
    return whitening.whiten(spark.createDataFrame(rows, schema)).collect()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12)) + 3).astype(np.float32)
    rows = [(k, [float(x) for x in v], k) for k, v in enumerate(base)]
    odd = [(900, None, 0), (901, [float("nan")] * 12, 0), (902, [float("inf")] + [0.0] * 11, 0), (903, [None] + [0.0] * 11, 0), (904, [], 0), (905, [1.0], 0), (None, rows[0][1], 0), (3, rows[3][1], 0)]
    got = whitened(spark, rows + odd, "vec_id long, embedding array<float>, component int")
    kept = base[[*range(200), 0, 3]]
    x = np.floor(1024 * kept.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = y @ vectors / np.sqrt(values)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = collections.defaultdict(dict)
    for r in got:
        by[r["vec_id"]].setdefault(r["component"], []).append(r["whitened"])
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(y.T @ y / n)) < 1e-12
    sign = {c: np.sign(by[7][c][0] * want[7, c - 1]) for c in range(1, 9)}
    for k, i in [(k, k) for k in range(200)] + [(None, 0)]:
        assert all(abs(v * sign[c] - want[i, c - 1]) < 1e-9 for c in range(1, 9) for v in by[k][c])
    assert len(by[3][1]) == 2
    deviation = {(r["vec_id"]): r["deviation"] for r in got}
    assert all(deviation[k] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s)) for k in range(200))


def test_whitening_of_little_or_flat_tables(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == [] and whitened(spark, [(1, [1.0, 2.0])]) == [] and whitened(spark, [(1, [1.0]), (2, [1.0])]) == []
    got = whitened(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(4)])  # rank 1
    assert {r["component"] for r in got} == {1} and len(got) == 4 and abs(got[0]["explained"] - 1) < 1e-12
    wide = whitened(spark, [(k, [3e38 if k else -3e38, float(k % 2)]) for k in range(4)])  # beyond all bounds
    assert all(r["deviation"] == 2**63 - 1 and np.isfinite(r["whitened"]) for r in wide)


# ---- phrases


def brute(rows, k=2000, least=30, share=80):
    total, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = []
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        longer = [f[q] for q in f if q[0] == lang and len(q[1]) > len(g) and f[q] >= least and any(q[1][i : i + len(g)] == g for i in range(len(q[1])))]
        if any(100 * x >= share * a for x in longer):
            continue
        score, _, left, r = min((2_000_000 * a // (f[lang, g[:c]] + f[lang, g[c:]]), c, f[lang, g[:c]], f[lang, g[c:]]) for c in range(1, len(g)))
        out.append((lang, score, a, " ".join(g), left, r))
    ranked = []
    for lang in total:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        ranked += [(lang, i + 1, x[3], x[2], x[4], x[5], total[lang], x[1]) for i, x in enumerate(mine[:k])]
    return sorted(ranked)


def mined(spark, rows, **options):
    return sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "text string, lang string, w1 string"), **options).collect()))


def phrase_texts(n, seed):
    rng = random.Random(seed)
    words, out = ["a", "B", "cé", "dd", "e-e", "Ü", "x\0", " "], []
    for k in range(n):
        parts = [rng.choice(words[: 2 + k % 7]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for _ in range(rng.randrange(40))]
        out.append(("".join(parts), rng.choice(["en", "de", None, "und"]), "w"))
    return [*out, (None, "en", "w"), ("", None, "w"), ("...", "fr", "w"), ("one one one one one", "fr", None)]


@pytest.mark.parametrize(("least", "k", "bits"), [(30, 2000, 1 << 30), (5, 4, 1 << 30), (3, 2000, 64), (1, 2000, 1 << 30)])
def test_phrases_equal_brute_force(spark, least, k, bits, monkeypatch):
    rows = phrase_texts(120, least)
    if bits == 64:  # a full filter keeps every window long; the result is the same
        whole = collocations.phrase_counts
        monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: whole(docs, least, 64))
    assert mined(spark, rows, least=least, k=k) == brute([r[:2] for r in rows], k, least)


def test_blocks_and_lots_lose_no_window(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "c", "longer-word-than-a-block" * 3]) + rng.choice([" ", " ", " ", "\t", ". "]) for _ in range(2000))
    monkeypatch.setattr(collocations, "BLOCK", 50)
    monkeypatch.setattr(collocations, "MOST_WINDOWS", 120)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [text, "x y", text], "lang": ["a", "b", "a"]})
    got = collections.Counter()
    for lang, words, found in collocations.of_batches(iter([batch, batch])):
        names = list(words.code)
        got.update((lang, *(names[c] for c in column)) for column in found.T)
    want = collections.Counter()
    for lang, t in [("a", text), ("b", "x y"), ("a", text)] * 2:
        for piece in t.split("."):
            w = [x.encode() for x in re.findall("[^ \t]+", piece)]
            want.update((lang, *(w[i + k] if i + k < len(w) else b"\n" for k in range(4))) for i in range(len(w)))
    assert got == want


def test_long_text_and_empty_table(spark):
    assert mined(spark, []) == []
    rows = [("to be or not to be " * 60_000, "en", None)]
    got = mined(spark, rows)
    assert got == brute([r[:2] for r in rows])
