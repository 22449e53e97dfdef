"""Every query of the engine against its SQL."""

import math

import duckdb
import pytest

from voxloom import field_queries, more_queries  # noqa: F401  register their own
from voxloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events labels pages embeddings documents".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 4) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert got
    if name in SQL:
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
