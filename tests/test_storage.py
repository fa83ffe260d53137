"""Blobs are packed and read in slices, so a task's Python holds a few rows, however many there are."""

import pyarrow as pa

from trawl.operators import storage


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_pydict({"sha": [str(k) for k in range(1000)]})
    parts = [p["sha"] for p in storage.sliced([batch, batch.slice(0, 0), batch.slice(0, 3)])]
    assert max(map(len, parts)) == storage.SLICE and sum(parts, []) == [str(k) for k in [*range(1000), *range(3)]]


def test_blobs_over_many_slices(spark):
    rows = [(f"s{k:04}", None if k % 100 == 7 else f"text {k} \u00e9" * (k % 5)) for k in range(700)]
    made = storage.write_blobs(spark.createDataFrame(rows * 2, "sha string, code string"), bytes(32))
    read = storage.read_blobs(made, [bytes(range(32)), bytes(32)])
    plans = read._jdf.queryExecution().toString()
    assert "MapInPandas" not in plans and "ArrowEvalPython" not in plans  # these hold whole batches as pandas columns
    assert sorted((r["sha"], r["code"], r["error"]) for r in read.collect()) == [(s, c, "missing" if c is None else None) for s, c in rows]
    counts = {r["reason"]: (r["n"], r["share"]) for r in storage.load_failures(read).collect()}
    assert counts == {"missing": (7, 1.0)}
