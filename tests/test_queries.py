"""Every registered query of the engine against DuckDB at the smallest scale."""

import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from trawl.queries import ORACLE_SQL, QUERIES  # noqa: E402


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for values in frame.itertuples(index=False):
        out.append(tuple("" if pd.isna(v) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in values))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    if all(want[c].isna().all() or got[c].dtype == want[c].dtype for c in want):
        assert rows(got) == rows(want)
    else:
        for c in want:
            got[c], want[c] = got[c].astype("Float64") if want[c].dtype.kind in "iuf" else got[c], want[c].astype("Float64") if want[c].dtype.kind in "iuf" else want[c]
        assert rows(got) == rows(want)
