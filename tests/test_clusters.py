"""Clustered vector search against the scan."""

import numpy as np

from trawl.operators.clusters import Clusters
from trawl.plans.search import vector_top

SCHEMA = "vec_id long, embedding array<float>"


def test_search_equals_the_scan_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 4
    x = np.concatenate([m + rng.normal(size=(60, 16)) * 0.3 for m in middles]).astype(np.float32)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(5000, [0.0] * 16), (5001, [1.0, 2.0]), (5002, None), (5003, rows[7][1]), (5004, [])]
    first, later = spark.createDataFrame(rows[:400] + rows[720:], SCHEMA), spark.createDataFrame(rows[400:720], SCHEMA)
    found = Clusters.build(first, str(tmp_path / "c"), 12)
    found.add(later)  # radii follow
    everything = first.unionByName(later)
    shares = []
    for query in [rows[7][1], rows[650][1], [float(v) for v in rng.normal(size=16)], [-v for v in rows[100][1]], [0.0] * 16, [1.0, 2.0]]:
        for k in (1, 10, 100):
            got = found.search(query, k)
            want = [tuple(r) for r in vector_top(everything, query, k).collect()]
            assert [tuple(r) for r in got.rows.collect()] == want
        shares.append(found.search(query, 10).pruned)
    assert min(shares[:2]) >= 0.5 and shares[4] == 0.0


def test_empty_and_flat_tables(spark, tmp_path):
    none = Clusters.build(spark.createDataFrame([(1, None)], SCHEMA), str(tmp_path / "n"))
    assert [tuple(r) for r in none.search([1.0], 3).rows.collect()] == [tuple(r) for r in vector_top(spark.createDataFrame([(1, None)], SCHEMA), [1.0], 3).collect()]
    flat = Clusters.build(spark.createDataFrame([(k, [1.0, 1.0]) for k in range(9)], SCHEMA), str(tmp_path / "f"))
    assert [r["vec_id"] for r in flat.search([1.0, 1.0], 4).rows.collect()] == [0, 1, 2, 3]
