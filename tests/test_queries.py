"""Every registered query of the reference operators against its SQL, run by DuckDB on the same files."""

import os

import duckdb
import pytest

from lamella import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """For putting rows in the same order on both sides."""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=1.1e-6)
    return str(a) == str(b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    result = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(plain, r)))
    other = order(tuple(r[columns.index(c)] for c in df.columns) for r in result.fetchall())
    own = order(tuple(r) for r in df.collect())
    assert len(own) == len(other)
    for a, b in zip(own, other, strict=True):
        assert all(map(same, a, b)), (a, b)
