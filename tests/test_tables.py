"""Incremental tables: what a change writes, concurrent writers, and joins without an exchange."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from trawl.operators import tables

SCHEMA = "id string, n long, tags array<string>"


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, [k]) for k, v in pairs], SCHEMA)


def content(table):
    return {r["id"]: r["n"] for r in table.read().collect()}


def files(path, generation):
    return [f for f in os.listdir(f"{path}/data/{generation}") if f.endswith(".parquet")]


def test_changes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST", 3)
    table, want, rng = tables.Table(spark, str(tmp_path / "it's t"), SCHEMA, buckets=4), {}, random.Random(1)
    assert content(table) == {} and table.version().number == 0
    for step in range(9):
        put = {f"k{rng.randrange(40)}": step * 100 + i for i in range(30 if step == 0 else 4)}
        gone = {f"k{rng.randrange(50)}" for _ in range(3)}
        table.change(lambda *_: (rows(spark, put.items()), spark.createDataFrame([(g,) for g in gone], "id string")))  # noqa: B023
        want = {k: v for k, v in want.items() if k not in gone} | put
        assert content(table) == want
    assert table.version().number == 9 and len(table.version().generations) <= 3
    assert len(table.versions()) == tables.KEPT
    live = {g for n in table.versions() for g in table.version(n).generations}
    assert set(os.listdir(tmp_path / "it's t" / "data")) == live  # nothing is left over
    table.delete_where(F.col("n") >= 0)
    assert content(table) == {}


def test_a_change_writes_the_touched_buckets_only(spark, tmp_path):
    table = tables.Table(spark, str(tmp_path / "t"), SCHEMA)
    table.upsert(rows(spark, [(f"k{i}", i) for i in range(500)]))
    before = {f: os.stat(f"{tmp_path}/t/data/{table.version().generations[0]}/{f}").st_mtime_ns for f in files(tmp_path / "t", table.version().generations[0])}
    table.upsert(rows(spark, [("k7", -1)]))
    first, second = table.version().generations
    assert len(before) == tables.BUCKETS and len(files(tmp_path / "t", second)) == 1
    assert before == {f: os.stat(f"{tmp_path}/t/data/{first}/{f}").st_mtime_ns for f in files(tmp_path / "t", first)}
    assert content(table)["k7"] == -1 and len(content(table)) == 500
    assert {r["id"]: r["n"] for r in table.read(1).collect()}["k7"] == 7  # the version before


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path, wait, errors = str(tmp_path / "t"), threading.Barrier(2), []
    tables.Table(spark, path, SCHEMA, buckets=2).upsert(rows(spark, [("count", 0)]))

    def writer(name):
        table, calls = tables.Table(spark, path, SCHEMA, buckets=2), []

        def build(stored, version):
            if not calls:
                wait.wait(60)  # both have read the same version
            calls.append(version.number)
            n = stored.where("id = 'count'").first()["n"]
            return rows(spark, [(name, 1), ("count", n + 1)]), None

        try:
            table.change(build)
        except Exception as e:  # noqa: BLE001
            errors.append(e)
        seen.append(len(calls))

    seen: list[int] = []
    threads = [threading.Thread(target=writer, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(seen) == [1, 2]  # one of them built its change again
    assert content(tables.Table(spark, path, SCHEMA)) == {"count": 2, "a": 1, "b": 1}


def test_a_stopped_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = tables.Table(spark, str(tmp_path / "t"), SCHEMA, buckets=2)
    table.upsert(rows(spark, [("a", 1)]))
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda v: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            table.upsert(rows(spark, [("b", 2)]))
    assert content(table) == {"a": 1}
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda v: False)
        with pytest.raises(tables.Conflict):
            table.change(lambda *_: (rows(spark, [("b", 2)]), None), tries=2)
    table.upsert(rows(spark, [("c", 3)]))
    assert content(table) == {"a": 1, "c": 3}


def test_joins_on_the_key_need_no_exchange(spark, tmp_path):
    left, right = (tables.Table(spark, str(tmp_path / n), SCHEMA, buckets=4) for n in ("l", "r"))
    for t in (left, right):
        for k in range(3):  # several generations are merged within their buckets
            t.upsert(rows(spark, [(f"k{i}", i * k) for i in range(k, 60)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = left.read().join(right.read().withColumnRenamed("n", "m"), "id")
        assert both.where("n = m").count() == 60
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hybrid_candidates_exchange_nothing_by_id(spark, tmp_path, monkeypatch):
    from trawl.operators import postings, scope
    from trawl.plans import search

    chunks = tables.Table(spark, str(tmp_path / "c"), "id string, file_path string, lang string, tags array<string>, code string", buckets=4)
    vectors = tables.Table(spark, str(tmp_path / "v"), "id string, embedding array<float>", buckets=4)
    chunks.upsert(spark.createDataFrame([(f"k{i}", f"src/{i}.py", "python", ["a"], f"word{i % 3} text") for i in range(40)], "id string, file_path string, lang string, tags array<string>, code string"))
    chunks.upsert(spark.createDataFrame([("k3", "docs/3.md", "markdown", ["b"], "word0 text")], "id string, file_path string, lang string, tags array<string>, code string"))
    vectors.upsert(spark.createDataFrame([(f"k{i}", [1.0, float(i)]) for i in range(40)], "id string, embedding array<float>"))
    c = chunks.read().withColumns({"doc_id": F.col("id"), "text": F.col("code")}).drop("code")
    v = vectors.read().select(F.col("id").alias("doc_id"), "embedding")
    index = postings.write(c, str(tmp_path / "i"), keep=("file_path", "lang", "tags"))
    plans, held = [], search.held
    monkeypatch.setattr(search, "held", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or held(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, keyword = search.candidates(c, v, ["word1"], "word1", [1.0, 2.0], 10, scope.Scope(), index)
        assert keyword.count() == found.count() == 13 and "hashpartitioning(id" not in plans[-1]
        found, keyword = search.candidates(c, v, ["nothing"], "nothing", [1.0, 2.0], 10, scope.Scope(), index)
        assert keyword.isEmpty() and found.count() == 10 and "SortMergeJoin" in plans[-1] and "Exchange hashpartitioning" not in plans[-1]
        found, keyword = search.candidates(c, v, ["word0"], "word0", [1.0, 2.0], 10, scope.Scope(path_glob=["docs/**"]), index)
        assert keyword.isEmpty() and [r["doc_id"] for r in found.collect()] == ["k3"]  # one document has no keyword statistics
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
