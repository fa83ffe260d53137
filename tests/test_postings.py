"""The inverted index against a plain BM25 over all texts, and what its searches read."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from trawl.operators import postings


def brute(texts, terms, k, digits=6):
    words = {i: re.findall(r"[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words))
    if n < 3 or not mean:
        return []
    counts = {i: collections.Counter(w) for i, w in words.items()}
    scores = collections.Counter()
    for t in set(terms):
        df = sum(t in c for c in counts.values())
        for i, c in counts.items():
            if c[t]:
                scores[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
    return sorted(((round(s, digits), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]


def corpus(n, seed, name=lambda k: k):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    out = {name(k): " ".join(rng.choices(vocabulary, weights, k=rng.randrange(60))) for k in range(n)}
    out[name(0)], out[name(1)], out[name(2)] = None, "", out[name(5)]  # nothing, nothing, a copy
    return out


@pytest.mark.parametrize("name", [lambda k: k, lambda k: f"id{k:04}"])
@pytest.mark.parametrize(("named", "few"), [(200, 5000), (1, 5000), (1, 1)])
def test_search_equals_the_scan(spark, tmp_path, monkeypatch, name, named, few):
    monkeypatch.setattr(postings, "NAMED", named)
    monkeypatch.setattr(postings, "FEW_TERMS", few)
    monkeypatch.setattr(postings, "BLOCK", 8)
    texts = corpus(700, 3, name)
    docs = spark.createDataFrame([(i, t, k % 3) for k, (i, t) in enumerate(texts.items())], f"doc_id {'long' if name(0) == 0 else 'string'}, text string, part int")
    index = postings.write(docs, str(tmp_path / "i"), keep=("part",), buckets=4, segment_size=100)
    rng = random.Random(1)
    asked = {q: [f"w{int(300 * rng.random() ** 3)}" for _ in range(1 + q % 6)] + ["unknown"] for q in range(25)}
    queries = spark.createDataFrame(list(asked.items()), "query long, terms array<string>")
    for k in (1, 5, 1000):
        got = collections.defaultdict(list)
        for r in sorted(postings.search(index, queries, k).collect(), key=lambda r: r["rank"]):
            got[r["query"]].append((r["bm25"], r["doc_id"]))
        for q, terms in asked.items():
            want = brute(texts, terms, k)
            assert [i for _, i in got[q]] == [i for _, i in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got[q], want))
    inside = {i: t for k, (i, t) in enumerate(texts.items()) if k % 3 == 1}
    got = sorted((r["rank"], r["doc_id"]) for r in postings.search(index, queries.where("query = 4"), 7, within=index.docs.where("part = 1")).collect())
    assert [i for _, i in got] == [i for _, i in brute(inside, asked[4], 7)]
    assert postings.search(index, queries, 5, within=index.docs.where("part = 9")).isEmpty()


def test_little_tables(spark, tmp_path):
    schema = "doc_id long, text string"
    two = postings.write(spark.createDataFrame([(1, "a b"), (2, "a")], schema), str(tmp_path / "two"))
    none = postings.write(spark.createDataFrame([], schema), str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, ["a"]), (2, [])], "query long, terms array<string>")
    assert postings.search(two, asked, 3).isEmpty() and postings.search(none, asked, 3).isEmpty()
    three = postings.write(spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c")], schema), str(tmp_path / "three"))
    assert [(r["query"], r["doc_id"]) for r in postings.search(three, asked, 1).collect()] == [(1, 2)]
    assert postings.search(three, asked.where("query = 2"), 1).isEmpty()


def test_a_search_reads_the_asked_buckets_only(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"only{k} common") for k in range(200)], "doc_id long, text string")
    index = postings.write(docs, str(tmp_path / "i"), buckets=8)
    terms = spark.createDataFrame([("common",)], "term string")
    blocks = postings.asked_blocks(index, terms)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,common)" in plan
    assert blocks.agg(F.sum("n")).first()[0] == 200


def test_pruning_drops_documents_that_cannot_be_among_the_best():
    import pyarrow as pa

    rng = random.Random(5)
    lists = {"rare": sorted(rng.sample(range(2000), 40)), "common": list(range(2000))}
    rows = []
    for term, ids in lists.items():
        for at in range(0, len(ids), 128):
            part = ids[at : at + 128]
            rows.append({"term": term, "n": len(part), "ids": part, "tfs": [1] * len(part), "lens": [10] * len(part), "most": 1, "shortest": 10})
    segment = postings.Segment(pa.Table.from_pylist(rows), 10.0)
    places, scores = segment.best([("common", 0.01), ("rare", 5.0)], 5, 6)
    assert places.tolist() == lists["rare"][:5] and all(abs(s - 5.01) < 1e-9 for s in scores)
    assert scores.tolist() == sorted(scores, reverse=True)



def test_a_segment_is_counted_where_it_is_stored(spark, monkeypatch):
    """F4 to F9: texts are exchanged, not postings; blocks go on over batches and lots and end with their segment."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "LOT", 3)
    texts = [["a", "b", "a"], None, ["b"], ["a"], [], ["c", "a"], ["a"], ["a", "b"], ["a", "a", "a"]]
    rows = spark.createDataFrame([(k // 7, k, t) for k, t in enumerate(texts)], "segment int, id long, t array<string>").coalesce(1).sortWithinPartitions("segment", "id")
    got = [(r["term"], r["segment"], r["no"], r["n"], r["ids"], r["tfs"], r["lens"], r["most"], r["shortest"]) for r in postings.blocked(rows).collect()]
    assert got == [
        ("a", 0, 0, 4, [0, 3, 5, 6], [2, 1, 1, 1], [3, 1, 2, 1], 2, 1), ("b", 0, 0, 2, [0, 2], [1, 1], [3, 1], 1, 1), ("c", 0, 0, 1, [5], [1], [2], 1, 2),
        ("a", 1, 0, 2, [7, 8], [1, 3], [2, 3], 3, 2), ("b", 1, 0, 1, [7], [1], [2], 1, 2),
    ]
    many = spark.createDataFrame([(0, k, ["x"]) for k in range(9)], "segment int, id long, t array<string>").coalesce(1)
    assert [(r["no"], r["n"], r["ids"]) for r in postings.blocked(many).collect()] == [(0, 4, [0, 1, 2, 3]), (1, 4, [4, 5, 6, 7]), (2, 1, [8])]
