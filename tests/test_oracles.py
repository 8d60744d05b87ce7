"""Every registered core query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lodestone.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return str(v) if hasattr(v, "isoformat") else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(got.columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).columns
