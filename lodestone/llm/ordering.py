"""Sorting rows by ranges and summing along the order, without a task that sees them all. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.session import materialise

#: Rows of a cell, about: a cell is a range of the order that one task sums up.
CELL_ROWS = 20_000


def running_sums(rows: DataFrame, order: list[Column], values: dict[str, Column], by: list[str] | None = None, rest: DataFrame | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with, for each name of `values`, the sum of that value over the rows before them.

    The order is by the columns `by` (no nulls in them), whose sums start anew, and
    then by `order`; rows equal in both come in any order. Rows are dealt into
    cells by ranges and written; a cell starts where those before it end, so only
    sums of cells are added up across tasks. `rest` (by and more columns, a row
    for each group) is joined to the cells, whose number is small, instead of to
    the rows, of which one group may hold most. `rows` should be cheap to read
    again, as the ranges are found in a pass of their own.
    """
    by = by or []
    cells = max(1, -(-rows.count() // cell_rows))
    named = {f"_{name}": value for name, value in values.items()}
    dealt = rows.withColumns(named).repartitionByRange(cells, *by, *order)
    dealt = materialise(dealt.withColumn("_cell", F.spark_partition_id()), "cells")
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_cell").agg(*(F.sum(n).alias(n) for n in named))
    starts = sums.select(*by, "_cell", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_start") for n in named))
    if rest is not None:
        starts = starts.join(rest, by)
    inside = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in named})
    sums_of = {name: F.col(f"_{name}") + F.col(f"_{name}_start") for name in values}
    return out.join(starts, [*by, "_cell"]).withColumns(sums_of).drop("_cell", *named, *(f"{n}_start" for n in named))
