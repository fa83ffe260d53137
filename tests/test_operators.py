import math

import pytest
from pyspark.sql import functions as F

from trawl.operators import bm25, chunking, graph, maintain, rank, scope, storage
from trawl.plans import indexing
from trawl.sources import files, packs


def test_small_corpus_has_no_keyword_hits(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    assert bm25.score(docs, ["a"]).count() == 0
    docs = docs.union(spark.createDataFrame([(3, "c"), (4, None)], docs.schema))
    assert {r[0] for r in bm25.score(docs, ["a"]).collect()} == {1, 2}


def test_fusion_and_ties(spark):
    v = spark.createDataFrame([("a", 0), ("b", 1)], "id string, vrank int")
    k = spark.createDataFrame([("b", 0), ("c", 1)], "id string, brank int")
    rows = rank.fuse(v, k, 10).collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"]
    assert math.isclose(rows[0]["rrf"], 1 / 62 + 1 / 61)
    rows = rank.fuse(v.where("id = 'a'"), spark.createDataFrame([("c", 0)], "id string, brank int"), 10).collect()
    assert [r["id"] for r in rows] == ["a", "c"]


def test_candidate_score_strength_and_cap(spark):
    row = spark.range(1)
    score, boost = rank.candidate_score(F.lit(0.5), F.lit("docs/x.ts"), F.array(F.lit("auth"), F.lit("user")), F.lit(None).cast("string"), F.lit("auth user login"))
    got = row.select(score.alias("s"), boost.alias("b")).first()
    assert math.isclose(got["s"], 0.85) and math.isclose(got["b"], 0.2)
    none = F.lit(None).cast("string")
    s = rank.signature_strength(F.lit("processPayment"), none, F.lit(None).cast("array<string>"), F.lit("process payment"))
    assert row.select(s.alias("s")).first()[0] == 0.375
    assert math.isclose(row.select(rank.symbol_boost(F.lit(1.0), F.lit(1.0)).alias("s")).first()[0], 0.45)


def test_scope(spark):
    assert scope.toggle("Enabled") and not scope.toggle("0") and scope.toggle("maybe") and scope.toggle(None)
    assert scope.Scope.of(reranker="on").reranker == "off" and scope.Scope.of(tags="A").tags == ["a"]
    rows = spark.createDataFrame([("src/a.ts",), ("src/x/b.ts",), ("",), (None,)], "file_path string")
    assert rows.where(scope.path_matches(F.col("file_path"), ["src/*.ts"])).count() == 1
    assert rows.where(scope.path_matches(F.col("file_path"), ["src/**/*.ts"])).count() == 2
    with pytest.raises(ValueError):
        scope.glob_regex("a+(b)")


def test_line_packing_counts_once_and_overlaps():
    lines = "\n".join(f"line{k}" for k in range(1, 6))
    parts = chunking.pack_lines(lines, chunking.Limits(10, 1, 20, 4))
    assert len(parts) > 1 and parts[0][2].split("\n")[-1] == parts[1][2].split("\n")[0]
    seen = []
    chunking.pack_lines("a\nbb\nccc\ndddd\nee", chunking.Limits(5, 1, 5, 2), lambda x: seen.append(x) or len(x))
    assert len(seen) == 5


def test_chunks_of_a_file_and_fallback():
    code = "class A:\n    def f(self):\n        return 1\n\ndef g():\n    return 2\n"
    got = list(chunking.chunk_file("a.py", code, "python", chunking.Limits(50, 1, 500, 5)))
    assert [c["symbol"] for c in got] == ["A", "g", "f"] and got[1]["start_line"] == 5
    assert [c["chunk_type"] for c in chunking.chunk_file("a.py", "def (", "python", chunking.Limits())] == ["file"]
    assert chunking.budget_bins([60, 50, 50], 100) == [0, 1, 1]


def test_incremental_index_equals_full(spark):
    def table(rows):
        return spark.createDataFrame(rows, "path string, lang string, content string").withColumn("file_hash", F.sha1("content"))

    old = table([("a.py", "python", "def a():\n    return 1\n"), ("b.py", "python", "def b():\n    return 1\n")])
    new = table([("a.py", "python", "def a():\n    return 1\n"), ("c.py", "python", "def c():\n    return 3\n")])
    chunks, prints = indexing.index_files(old)
    got = indexing.update(chunks, prints, new)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in indexing.index_files(new)[0].collect())


def test_call_graph_prefers_the_own_file(spark):
    calls = spark.createDataFrame([("A", "f1", 0, "b"), ("A", "f1", 1, "a")], "src string, file string, ord int, name string")
    symbols = spark.createDataFrame([("B", "f2", "b", 0), ("B2", "f1", "b", 1), ("A", "f1", "a", 2)], "sha string, file string, name string, place int")
    assert [tuple(r) for r in graph.resolve_calls(calls, symbols).collect()] == [("A", "B2", 0)]


def test_coalescing(spark):
    e = spark.createDataFrame([("x", "add", 1, 1), ("x", "unlink", 2, 2), ("y", "change", 1, 3)], "path string, op string, ts int, seq int")
    assert {(r[0], r[1]) for r in maintain.coalesced(e).collect()} == {("x", "delete"), ("y", "upsert")}


def test_blobs_and_rotation(spark):
    old, new = bytes(32), bytes(range(32))
    rows = spark.createDataFrame([("s1", "secret"), ("s2", "")], "sha string, code string")
    blobs = storage.write_blobs(rows, old).cache()
    assert {r["code"] for r in storage.read_blobs(blobs, [new, old]).collect()} == {"secret", ""}
    assert {r["error"] for r in storage.read_blobs(blobs, [new]).collect()} == {"encrypted"}
    payload = bytes(blobs.where("sha = 's1'").first()["payload"])
    assert payload[:8] == storage.MAGIC and payload[8] == 2 and payload[9:17] == storage.key_id(old)
    assert storage.reused_ivs(blobs).count() == 0 and storage.reused_ivs(blobs.union(blobs)).count() == 2
    assert {r["code"] for r in storage.read_blobs(storage.write_blobs(rows)).collect()} == {"secret", ""}


def test_files_and_packs(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("1")
    got = files.scan(spark, str(tmp_path)).select("path", "lang").collect()
    assert [tuple(r) for r in got] == [("src/a.py", "python")]
    (tmp_path / "one.json").write_text('{"scope": {"lang": ["en"]}}')
    (tmp_path / "bad.json").write_text('{"what": 1}')
    assert [p["invalid"] for p in packs.list_packs(str(tmp_path))] == [True, False]
    packs.set_active(str(tmp_path), "one")
    assert packs.effective_scope(packs.active(str(tmp_path)), None, {"lang": ["de"]}) == {"lang": ["de"]}


def test_stream_equals_batch(spark, tmp_path):
    from trawl.streaming import watch

    rows = [("a.py", "add", "2024-01-01 00:00:00", 1), ("a.py", "unlink", "2024-01-01 00:00:01", 2), ("b.txt", "add", "2024-01-01 00:00:01", 3)]
    events = spark.createDataFrame(rows, "path string, op string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    watch.run(stream, lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert seen == [("a.py", "delete")]
