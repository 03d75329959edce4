"""Every registered query of the engine's own operators against its SQL, as multisets of rows; those without SQL must run."""

import math
import os

import duckdb
import pytest

from lodestone.plans import catalogue

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f[:-8] for f in os.listdir(D) if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) >= 1e-9 else "0"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1e15 else str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    got = df.collect()
    assert got or name == "cache_size_evict"
    if name in catalogue.ORACLES:
        cur = duck.execute(catalogue.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        want, mine = rows_of(names, cur.fetchall()), rows_of(df.columns, got)
        assert len(mine) == len(want)
        off = [(a, b) for a, b in zip(mine, want, strict=True) if a != b]
        assert not off, off[:3]
