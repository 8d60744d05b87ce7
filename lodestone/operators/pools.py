"""Choices within the ranked pool of one question, for many questions in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from lodestone.session import worker_path

#: Rows that become Python objects at once, besides those of one pool.
ROWS = 4096


def choose(rows: DataFrame, key: str, order: list[Column | str], pick: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """key and the columns of `schema`: what a function picks from the rows of each key, which it gets in the given order.

    Rows are dealt by key and sorted by Spark, which may spill; tasks read them as a
    stream of batches, so they hold a slice and one pool, however many pools there are.
    Null keys are one pool; a pool may go over any number of batches.
    """
    worker_path(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    fields = StructType.fromDDL(f"{key} {kind}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(fields)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), kinds)], names=kinds.names)

        pool: list[dict] = []
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                done: list[tuple] = []
                for row in batch.slice(first, ROWS).to_pylist():
                    if pool and row[key] != pool[0][key]:
                        done += [(pool[0][key], *t) for t in pick(pool)]
                        pool = []
                    pool.append(row)
                if done:
                    yield batch_of(done)
        if pool and (done := [(pool[0][key], *t) for t in pick(pool)]):
            yield batch_of(done)

    return rows.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order).mapInArrow(run, fields)
