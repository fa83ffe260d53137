"""Large anchor groups of the SimHash join: how they are dealt out, and that no link is lost."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import simhash
from trawl.llm.common import Stored, local_components


@pytest.mark.parametrize("field", [0, 1])
def test_no_cell_keeps_a_hundredth_of_a_hot_anchor(spark, field):
    covering, rng, n = simhash.Covering(3), np.random.default_rng(field), 100_000
    anchor = np.uint64(field << 58)  # the codeword 0
    inside = np.uint64(field * covering.width)
    fps = rng.integers(0, 2**64, n, dtype=np.uint64) & ~(np.uint64((1 << covering.length) - 1) << inside)
    fps |= (np.uint64(1) << rng.integers(0, covering.length, n).astype(np.uint64)) << inside  # within the radius
    rows = spark.createDataFrame(pa.table({"anchor": np.full(n, anchor).view(np.int64), "fp": fps.view(np.int64)}))
    cells = rows.select(F.explode(F.array(*simhash.cells_outside(covering, 3))).alias("cell")).groupBy("cell").count()
    largest = cells.agg(F.max("count")).first()[0]
    assert largest < n / 100


def test_components_equal_brute_force_when_every_anchor_is_large(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = [base]
    for bits in (1, 2, 3, 4):  # chains at, under and over the threshold
        near = rng.choice(base, 60)
        for _ in range(bits):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
        fps.append(near)
    fps = np.unique(np.concatenate(fps))
    got = simhash.links(spark.createDataFrame(pa.table({"fp": fps.view(np.int64)})), 3, Stored(spark), dense=2).collect()
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    left, right = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    want = local_components(len(fps), left, right)
    found = local_components(len(fps), np.array([place[r["u"]] for r in got]), np.array([place[r["v"]] for r in got]))
    assert np.array_equal(found, want) and len(set(want.tolist())) < len(fps)
