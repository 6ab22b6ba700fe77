"""Every core query with an SQL counterpart against DuckDB on the smallest tables; skipped where they are absent."""

import glob
import os
from collections import Counter

import pytest

from lodestone.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = db.execute(catalogue.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    assert got == Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
