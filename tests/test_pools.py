"""Choices within pools, against plain grouping."""

import random
from collections import defaultdict

import pytest

from lodestone.operators import pools


def heavy(pool):
    """Places of the three heaviest rows, if the pool's sum is even."""
    if sum(r["weight"] for r in pool) % 2 == 0:
        for n, r in enumerate(pool[:3]):
            yield n, r["name"], r["tags"]


@pytest.mark.parametrize("batch,piece", [(7, 4096), (10_000, 5), (1, 1)])
def test_pools_match_plain_grouping(spark, monkeypatch, batch, piece):
    monkeypatch.setattr(pools, "ROWS", piece)
    rng = random.Random(batch)
    # One key holds a third of the rows, null is a key, names tie.
    rows = [(rng.choice([None, 1, 1, *range(5)]), rng.randrange(6), f"n{rng.randrange(9)}", [f"t{i}"] * (i % 3)) for i in range(150)]
    rows = list(dict(((k, w, n), (k, w, n, t)) for k, w, n, t in rows).values())
    by = defaultdict(list)
    for k, w, n, t in rows:
        by[k].append((-w, n, t))
    want = [(k, at, n, t) for k, some in by.items() if sum(w for w, _, _ in some) % 2 == 0 for at, (_, n, t) in enumerate(sorted(some)[:3])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "key int, weight int, name string, tags array<string>").repartition(3)
        got = pools.choose(df, "key", [df["weight"].desc(), df["name"]], heavy, "place int, name string, tags array<string>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = lambda found: sorted(found, key=repr)
    assert plain(map(tuple, got)) == plain(want) and want


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, weight int, name string, tags array<string>")
    found = pools.choose(df, "key", ["name"], heavy, "place int, name string, tags array<string>")
    assert found.count() == 0 and found.columns == ["key", "place", "name", "tags"]
