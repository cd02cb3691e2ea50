"""Every query with SQL against DuckDB, at the smallest size; those that rank or look up also at the next, which has ties."""

import math

import duckdb
import pytest

from quillstone.plans import catalogue, design, entries, rankings, records, rounds

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    out = {}
    for sf in (SF, LARGER):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("sf,name", [(SF, q) for q in sorted(catalogue.QUERIES)] + [(LARGER, q) for q in sorted(rankings.QUERIES | records.QUERIES | entries.QUERIES | design.QUERIES | rounds.QUERIES)])
def test_query(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    cur = duck[sf].execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want
