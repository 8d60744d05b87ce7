"""Islands, carried markers and running budgets over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.session import materialise


def islands(rows: DataFrame, by: list[str], order: str, starts: Column | None = None) -> DataFrame:
    """island: number of the contiguous run a row is in. A run ends where the order skips, or where `starts` holds."""
    w = Window.partitionBy(*by).orderBy(order)
    gap = F.lag(order).over(w).isNull() | (F.col(order) != F.lag(order).over(w) + 1)
    rows = rows.withColumn("_cut", (gap | F.coalesce(starts, F.lit(False)) if starts is not None else gap).cast("long"))
    return rows.withColumn("island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def change_islands(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """island: number of the run of equal values a row is in."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_cut", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("long"))
    return rows.withColumn("island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def carry_forward(rows: DataFrame, by: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """The last marker that is not null, at or before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_m", marker).withColumn(name, F.last("_m", ignorenulls=True).over(w)).drop("_m")


def changed(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before: what an update stream would send."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def prefix_within(rows: DataFrame, by: list[str], order: list[str], size: str, budget: int, units: int | None = None) -> DataFrame:
    """The leading rows whose sizes sum up to at most the budget, at most `units` of them; stops at the first overflow."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("running", F.sum(size).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where((F.col("running") <= budget) & (F.col("_n") <= (units if units is not None else F.col("_n")))).drop("_n")


def greedy_budget(rows: DataFrame, by: str, order: list[str], group: str, size: str, budget: int, per_group: int) -> DataFrame:
    """Rows taken in order: at most per_group of a group, and sizes within the budget; rows that overflow are skipped, not final.

    What is taken depends on all rows before, so a list (one value of `by`) is
    walked by one task, as a stream of Arrow batches in order.
    """

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, taken = None, 0, {}
        for part in parts:
            keep = []
            for key, g, n in zip(part[by], part[group], part[size]):
                if key != at:
                    at, used, taken = key, 0, {}
                ok = taken.get(g, 0) < per_group and used + n <= budget
                if ok:
                    taken[g], used = taken.get(g, 0) + 1, used + n
                keep.append(ok)
            yield part[keep]

    ordered = rows.repartition(by).sortWithinPartitions(by, *order)
    return ordered.mapInPandas(walk, rows.schema)


def interleave(first: DataFrame, second: DataFrame, rank: str = "rank") -> DataFrame:
    """Two ranked lists zipped: place orders by rank, the first list first; the longer list's tail follows."""
    both = first.withColumn("list", F.lit(1)).unionByName(second.withColumn("list", F.lit(2)))
    return both.withColumn("place", F.col(rank) * 2 + F.col("list") - 2)


def fragments(text: Column, width: int) -> Column:
    """Slices of `width` characters: array of (index, start, text); none for empty text."""
    count = F.ceil(F.length(text) / F.lit(width)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("index"), (i * width).alias("start"), F.substring(text, i * width + 1, F.lit(width)).alias("text")))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<struct<index:int,start:int,text:string>>"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place from 1 in an order over all of them, without one task that sees all.

    Rows are dealt by ranges of the order and numbered inside them; only the
    ranges' sizes are summed up. Ties and repeats get places of their own.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    held = materialise(dealt, "numbered")
    sizes = held.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return held.withColumn(name, inside.cast("long")).join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
