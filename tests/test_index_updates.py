"""Incremental runs against full ones, the call graph in the index, and failures that must not stop or spoil a run."""



import os
import struct

import pytest
from pyspark.sql import functions as F

from trawl import tools
from trawl.functions import vector
from trawl.operators import chunking, graph, rank, storage
from trawl.plans import indexing
from trawl.sources import files, packs

FILES = {
    "src/pay.py": "# @trawl-tags: money, billing\n# @trawl-intent: take money\ndef process_payment(order):\n    return charge(order)\n\n\ndef charge(order):\n    return send(order)\n",
    "src/net.py": "def send(data):\n    return data\n\n\ndef idle():\n    return None\n",
    "src/use.py": "def shop(order):\n    return process_payment(order)\n",
}


def write(root, path, body):
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w") as f:
        f.write(body)


def state(project):
    t = indexing.Tables(project.spark, project.out)
    symbols = {r["chunk_id"]: (r["symbol_call_targets"], r["symbol_callers"], r["symbol_neighbors"]) for r in t.symbols.read().collect()}
    plain = lambda table, *columns: sorted(map(tuple, table.read().select(*columns).collect()))
    return symbols, plain(t.chunks, "id", "code"), plain(t.vectors, "id"), plain(t.blobs, "sha"), plain(t.prints, "path", "file_hash"), plain(t.edges, "sha", "chunk_id")


def test_incremental_equals_full(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    for path, body in FILES.items():
        write(root, path, body)
    project = tools.Project(spark, root, str(tmp_path / "out"), limits=chunking.Limits(200, 1, 2000, 20))
    got = tools.index_project(project)
    assert got["added"] == 5
    twice = chunking.chunk_statistics(files.scan(spark, root), project.limits).first().asDict()
    assert got["statistics"] == twice and twice["normal"] == 5  # counted while the chunks were written
    by_symbol = {r["symbol"]: r for r in indexing.Tables(spark, project.out).symbols.read().collect()}
    sha = {s: r["sha"] for s, r in by_symbol.items()}
    assert by_symbol["process_payment"]["symbol_call_targets"] == [sha["charge"]] and by_symbol["process_payment"]["symbol_callers"] == [sha["shop"]]
    chunks = {r["symbol"]: r for r in indexing.Tables(spark, project.out).chunks.read().collect()}
    assert chunks["process_payment"]["lang"] == "python"
    # nobody asks for shop, but what it calls is named
    found = tools.search_code(project, "process payment", 10)["results"]
    assert found[0]["meta"]["symbol"] == "process_payment" and next(r for r in found if r["meta"]["symbol"] == "shop")["meta"]["symbol_boost"] > 0
    assert tools.search_code(project, "send data", 1)["results"][0]["meta"]["symbol"] == "send"

    # an unchanged tree opens no file; a touched one is read once and not chunked
    read = []
    whole = files.contents
    with monkeypatch.context() as m:
        m.setattr(files, "contents", lambda *a: read.append(whole(*a)) or read[-1])
        assert tools.update_project(project) == {"success": True, "added": 0, "removed": 0, "chunks": 5}
        assert "LocalRelation <empty>" in read[0]._jdf.queryExecution().optimizedPlan().toString()
        os.utime(os.path.join(root, "src/pay.py"), (1, 1))
        assert tools.update_project(project)["added"] == 0 and read[1].count() == 1
        assert tools.update_project(project)["added"] == 0 and read[2].count() == 0

    # send moves to a file of its own, a second charge appears, one file goes
    write(root, "src/net.py", "def idle():\n    return None\n")
    write(root, "src/wire.py", "def send(data):\n    return idle()\n\n\ndef charge(x):\n    return x\n")
    os.unlink(os.path.join(root, "src/use.py"))
    before = indexing.Tables(spark, project.out).chunks.version()
    got = tools.update_project(project)
    assert (got["added"], got["removed"], got["chunks"]) == (2, 2, 5)
    after = indexing.Tables(spark, project.out).chunks.version()
    assert after.generations[: len(before.generations)] == before.generations  # nothing was written again
    full = tools.Project(spark, root, str(tmp_path / "full"), limits=project.limits)
    tools.index_project(full)
    assert state(project) == state(full)
    assert {r["meta"]["symbol"] for r in tools.search_code(project, "charge", 9)["results"]} == {r["meta"]["symbol"] for r in tools.search_code(full, "charge", 9)["results"]}
    assert not any(r["meta"]["symbol"] == "shop" for r in tools.search_code(project, "shop", 9)["results"])


def test_affected_callers_are_found_by_name(spark):
    schema = "chunk_id string, sha string, file string, symbol string, symbol_calls array<string>"
    symbols = spark.createDataFrame([("a", "1", "f", "x", ["Y ", "z"]), ("b", "2", "f", "y", []), ("c", "3", "g", "w", ["q"])], schema)
    changed = spark.createDataFrame([("9", "y")], "sha string, symbol string")
    assert sorted(r["sha"] for r in graph.affected(symbols, changed).collect()) == ["1", "9"]
    edges = {r["sha"]: [t["dst"] for t in r["targets"]] for r in graph.edge_lists(graph.callers(symbols), symbols).collect()}
    assert edges == {"1": ["2"], "2": [], "3": []}


def test_stored_vectors_of_both_forms(spark):
    rows = [b"[0.5, 1.25, 2.0]", b'[1, "2", null, "x", {}]', struct.pack("<3f", 1, 2, 3), b"[1,2", b"{}  ", b"12345", b"", None]
    got = [r["v"] for r in spark.createDataFrame([(b,) for b in rows], "b binary").select(vector.decode_embedding(F.col("b"), 2).alias("v")).collect()]
    assert got[0] == [0.5, 1.25, 2.0] and got[1] == [1.0, 2.0, 0.0, 0.0, 0.0] and got[2] == [1.0, 2.0]
    assert len(got[3]) == 1 and len(got[4]) == 1 and got[5:] == [[], [], None]


def test_rerank_replies_and_failures(spark):
    rows = spark.createDataFrame([("a", 0.9, "x"), ("b", 0.8, "yy"), ("c", 0.7, "zzz")], "id string, score double, text string")
    order = lambda scorer, top=50: [r["id"] for r in rank.rerank(rows, scorer, top).collect()]
    lengths = lambda texts: [{"index": k, "relevance_score": len(t)} for k, t in enumerate(texts)]
    assert order(lambda t: [len(x) for x in t]) == order(lengths) == order(lambda t: {"results": lengths(t)}) == order(lambda t: {"data": lengths(t)}) == ["c", "b", "a"]
    assert order(lambda t: lengths(t)[1:2]) == ["b", "a", "c"]  # what is left out gets 0
    assert order(lengths, 2) == ["b", "a", "c"]  # the rest follows
    for broken in (lambda t: 1 / 0, lambda t: {"error": "no"}, lambda t: [1.0], lambda t: None):
        assert order(broken) == ["a", "b", "c"]


def test_payloads_without_a_version_byte(spark):
    key, salt = bytes(range(32)), bytes(range(16))
    import gzip

    plain, iv = gzip.compress(b"old text"), bytes(12)
    k = storage.derive(key, salt)
    sealed = spark.createDataFrame([(plain, k, iv)], "p binary, k binary, iv binary").select(F.aes_encrypt("p", "k", F.lit("GCM"), F.lit("DEFAULT"), F.col("iv")).alias("s")).first()["s"]
    forms = {"none": storage.MAGIC + salt + sealed, "one": storage.MAGIC + b"\x01" + salt + sealed, "two": storage.MAGIC + b"\x02" + storage.key_id(key) + salt + sealed, "later": storage.MAGIC + b"\x09" + salt + sealed}
    for first in (1, 2):  # a salt that begins like a version
        odd = bytes([first]) + salt[1:]
        s = spark.createDataFrame([(plain, storage.derive(key, odd), iv)], "p binary, k binary, iv binary").select(F.aes_encrypt("p", "k", F.lit("GCM"), F.lit("DEFAULT"), F.col("iv")).alias("s")).first()["s"]
        forms[f"salt{first}"] = storage.MAGIC + odd + s
    blobs = spark.createDataFrame([(n, bytes(b), True) for n, b in forms.items()], "sha string, payload binary, encrypted boolean")
    got = {r["sha"]: (r["code"], r["error"]) for r in storage.read_blobs(blobs, [bytes(32), key]).collect()}
    assert all(got[n] == ("old text", None) for n in ("none", "one", "two", "salt1", "salt2")) and got["later"] == (None, "version")
    assert {r["sha"]: r["error"] for r in storage.read_blobs(blobs, [bytes(32)]).collect()} == {"none": "failed", "one": "failed", "two": "encrypted", "later": "version", "salt1": "failed", "salt2": "encrypted"}


class Picky(packs.EmbeddingProvider):
    name, dims = "picky", 1

    def __init__(self, most=100, down=False):
        self.most, self.down, self.sizes = most, down, []

    def embed(self, texts):
        self.sizes.append(len(texts))
        if self.down:
            raise ConnectionError("down")
        if sum(map(len, texts)) > self.most:
            raise packs.TooLarge("too much")
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]


def test_embedding_failures_by_kind():
    provider = Picky(10)
    assert packs.embedded(provider, ["aaaa"] * 5) == [[4.0]] * 5 and max(provider.sizes[1:]) < 5
    assert packs.embedded(Picky(3), ["aaaa", "b"]) == [None, [1.0]]
    assert packs.embedded(Picky(), ["a", "bad", "ccc"]) == [[1.0], None, [3.0]]
    with pytest.raises(RuntimeError):
        packs.embedded(Picky(), ["bad", "bad too"])
    with pytest.raises(ConnectionError):
        packs.embedded(Picky(down=True), ["a"])


def test_batches_stream_in_order(spark):
    rows = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("b", 1, 100), ("b", 2, 1), (None, 1, 5)], "k string, o int, n int")
    got = sorted(((r["k"], r["o"], r["batch"]) for r in chunking.batches(rows, "k", ["o"], F.col("n"), 100).collect()), key=repr)
    assert got == sorted([("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("b", 1, 0), ("b", 2, 1), (None, 1, 0)], key=repr)
    with pytest.raises(Exception, match="exceeds"):
        chunking.batches(rows, "k", ["o"], F.col("n"), 99).collect()
