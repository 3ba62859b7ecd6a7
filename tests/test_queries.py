"""Every registered query of the base library against DuckDB, as the driver compares them."""

import duckdb
import pytest

from gleanery import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(float(v[i])) if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else str(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, con, name):
    df = Q.QUERIES[name](spark, sf)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in Q.ORACLES:
        assert got
        return
    rel = con.execute(Q.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, rel.fetchall())
