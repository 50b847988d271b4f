"""Every query of the engine against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from quillmask.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(x[c]) for c in cols) for x in df.collect())
    if name in Q.oracle_sql():
        cur = db.execute(Q.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
