"""Every named query against its SQL on the driver's small tables."""

import os

import duckdb
import pytest

from fathomry.plans import QUERIES, SQL

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL takes no account of keys with more rows than there are batches, which the smallest tables have.
LARGER = {"batch_allocate", "batch_allocate_lineitem", "batch_shuffle", "batch_mix"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def _norm(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return "[" + ",".join(map(_norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


#: Queries without rows on the smallest tables.
EMPTY_AT_FIRST = {"repeat_sampler"}
#: What they return depends on how the engine works.
WITHOUT_SQL = {"lexical_postings_read"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    root = f"{DATA}/{'sf0.01' if name in LARGER else 'sf0.001'}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    df = QUERIES[name](spark, root)
    want = con.execute(SQL[name])
    heads = [d[0] for d in want.description]
    assert sorted(heads) == sorted(df.columns)
    got = _rows(df.columns, df.collect())
    assert got == _rows(heads, want.fetchall())
    assert got or name in EMPTY_AT_FIRST


def test_no_query_is_empty(spark):
    """What the smallest tables have no rows for has some on the next."""
    for name in EMPTY_AT_FIRST:
        assert not QUERIES[name](spark, f"{DATA}/sf0.01").isEmpty(), name
