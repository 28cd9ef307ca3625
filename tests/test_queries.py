"""Each registered query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from loomset.plans import catalogue

TABLES = "documents labels pages embeddings events lineitem conversations".split()


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()[name](spark, sf)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    if name not in catalogue.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)
    rows = sorted(rows, key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(map(same, a, b)), (a, b)
