"""Shards by a hierarchical weighted hash tree. DataFrame operations only.

A tree has regions, racks and shards with weights. A shard of weight w draws
-ln(u) / w for a key, with u a hash of the key and the shard's place; the draw of a
rack or a region is the least draw below it, which is again one of a node that has
the summed weight. A key descends from the root to the child of the least draw at
each level, so a child wins in proportion to its weight. A weight that changes
changes the draws of its own shard and of the nodes above it only: keys move into
that shard if it grew, out of it if it shrank, and between no other two shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.session import materialise

#: Rows of a cell, about: a shard's rows are numbered cell by cell.
CELL_ROWS = 20_000


@dataclass(frozen=True)
class Tree:
    """region -> rack -> shard number -> weight."""

    regions: dict[str, dict[str, dict[int, float]]]

    @staticmethod
    def of(shards: int, per_rack: int = 2, racks: int = 2) -> "Tree":
        """`shards` shards of weight one, in racks and regions filled in turn."""
        out: dict[str, dict[str, dict[int, float]]] = {}
        for s in range(shards):
            region, rack = s // (per_rack * racks), s // per_rack % racks
            out.setdefault(f"r{region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
        return Tree(out)

    def leaves(self) -> Iterator[tuple[str, int, float]]:
        """Path of the rack, number and weight of every shard of positive weight."""
        for region, racks in self.regions.items():
            for rack, shards in racks.items():
                yield from ((f"{region}/{rack}", s, float(w)) for s, w in shards.items() if w > 0)


def _hash(text: Column, first: int, digits: int) -> Column:
    """Hexadecimal digits of an MD5, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("long")


def _draw(key: Column, path: str, shard: int, weight: float) -> Column:
    """-ln(u) / weight: u in (0, 1) from 32 bits of an MD5, which four shards of a rack share."""
    bits = _hash(F.concat(key, F.lit(f"|{path}/{shard // 4}")), 1 + 8 * (shard % 4), 8)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 32))) / F.lit(weight)


def descend(key: Column, tree: Tree) -> Column:
    """The number of the shard that a key's draws lead to. A null key draws as the text 'null'.

    Nodes are structs of their least draw and the shard that made it, so that
    taking the least at each level is the descent.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    racks: dict[str, dict[str, list[Column]]] = {}
    for path, shard, weight in tree.leaves():
        node = F.struct(_draw(key, path, shard, weight).alias("draw"), F.lit(shard).alias("shard"))
        racks.setdefault(path.split("/")[0], {}).setdefault(path, []).append(node)
    if not racks:
        raise ValueError("the tree has no shard of positive weight")
    least = lambda nodes: F.array_min(F.array(*nodes))
    return least([least([least(shards) for shards in of.values()]) for of in racks.values()])["shard"]


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """Put every row into a shard of the tree and number the rows of a shard from 0.

    Returns the key, size (UTF-8 bytes of the text plus 1; 1 for a null text),
    text_crc32 (0 for a null or empty text), law, shard, slot and grown_shard (the
    shard under the grown tree; null without one). Rows of one key go to one
    shard; rows that repeat get slots of their own. Null keys go together. Other
    columns are not read, so their names cannot clash; an empty table gives none.

    Slots follow a hash of key and text, in two steps, so no task sorts a whole
    shard and rows of one key are spread: rows are numbered inside cells (ranges of
    the hash; by default as many as give CELL_ROWS rows), and a cell starts where
    the cells before it end. Only counts of shard and cell are summed up across cells.
    """
    key_col, body = F.col(key), F.coalesce(F.col(text), F.lit(""))
    placed = materialise(docs.select(
        key_col.alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        descend(key_col, tree).alias("shard"),
        (descend(key_col, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        _hash(F.concat(F.coalesce(key_col.cast("string"), F.lit("null")), F.lit("|"), body), 1, 13).alias("place"),
    ), "placed")
    cells = cells or -(-placed.count() // (CELL_ROWS * sum(1 for _ in tree.leaves()))) or 1
    placed = placed.withColumn("cell", F.floor(F.col("place") / F.lit((1 << 52) / cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("place", F.col(key).asc_nulls_first(), "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "cell"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).alias("slot"), "grown_shard")
    )


def shard_sql(tree: Tree, grown: Tree) -> str:
    """shard() over documents as DuckDB SQL: every key against every shard of a tree, and CRC-32 byte by byte."""

    def leaves(tree: Tree) -> str:
        return ", ".join(f"('{path}/{s // 4}', {s}, {w!r})" for path, s, w in tree.leaves())

    def least(name: str) -> str:
        u = "(('0x' || substr(md5(k || '|' || path), 1 + 8 * (shard % 4), 8))::BIGINT + 0.5) / 4294967296.0"
        return f"(SELECT row, arg_min(shard, -ln({u}) / weight) AS shard FROM d, {name} GROUP BY row)"

    return f"""
WITH old(path, shard, weight) AS (VALUES {leaves(tree)}), new(path, shard, weight) AS (VALUES {leaves(grown)}),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t FROM documents),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, n: xor(c >> 1, 3988292384 * (c & 1)))) AS step),
bytes AS (SELECT row, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM d),
sums AS (SELECT row, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, step[1 + (xor(c, x) & 255)]))) AS text_crc32 FROM bytes, crc),
a AS (
  SELECT doc_id, strlen(t) + 1 AS size, text_crc32, o.shard, n.shard AS grown_shard, ('0x' || substr(md5(k || '|' || t), 1, 13))::BIGINT AS place
  FROM d JOIN sums USING (row) JOIN {least("old")} o USING (row) JOIN {least("new")} n USING (row))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot FROM a
"""
