"""Token ids in directly addressable codes.

An id is split into chunks of a few bits, low chunk first. All low chunks form
level 0; a bitmap tells which ids go on, and their next chunks form level 1, and
so on. A rank directory counts the set bits before every 512th, so the place of
an id's next chunk is one directory entry and at most eight words away: any id is
read without decoding its neighbours. What is opened for many reads counts these
words once.

A file is a Parquet table of segments: a run of whole documents in ascending
order with their levels as binary columns. Any store that Spark reaches can hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lodestone.llm import pieces as P
from lodestone.session import worker_path

#: Bits of the chunk levels: they cover 32-bit ids.
WIDTHS = (8, 8, 16)
#: Ids after which a segment ends, with its document.
SEGMENT_IDS = 1_000_000


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[bytes, bytes, bytes]]:
    """Per level: chunks, continuation bitmap, rank directory. Levels that no id reaches are left out."""
    out, rest = [], ids.astype(np.uint32)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id is wider than the levels")
    for width in widths:
        more = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        on = more > 0
        padded = np.zeros(-(-max(len(on), 1) // 512) * 512, np.uint8)
        padded[: len(on)] = on
        bits = np.packbits(padded, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).reshape(-1, 64).sum(1, dtype=np.int64))[:-1]]).astype("<u4")
        chunks = (rest & np.uint32((1 << width) - 1)).astype("<u1" if width <= 8 else "<u2" if width <= 16 else "<u4")
        out.append((chunks.tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = more[on]
        if not len(rest):
            break
    return out


class Codes:
    """The ids of a segment, by position."""

    def __init__(self, levels: list[tuple[bytes, bytes, bytes]], widths: tuple[int, ...] = WIDTHS):
        self.widths, self.levels = widths, []
        for (chunks, bits, ranks), w in zip(levels, widths):
            words = np.frombuffer(bits, "<u8")
            inside = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
            before = np.frombuffer(ranks, "<u4").astype(np.int64)[:, None] + np.cumsum(inside, 1) - inside
            self.levels.append((np.frombuffer(chunks, "<u1" if w <= 8 else "<u2" if w <= 16 else "<u4"), words, before.ravel()))

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions, in their order."""
        place = np.asarray(positions, np.int64)
        out, who, shift = np.zeros(len(place), np.uint32), np.arange(len(place)), 0
        for (chunks, words, before), width in zip(self.levels, self.widths):
            out[who] |= chunks[place].astype(np.uint32) << np.uint32(shift)
            shift += width
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            on = (words[word] >> bit) & np.uint64(1) == 1
            if not on.any():
                break
            who, place, word, bit = who[on], place[on], word[on], bit[on]
            place = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of every document, each closed by end_id, in ascending order of the key.

    Null texts hold the end id only. Null keys come first. Rows of one key stay
    together, in the order of their texts. Other columns are not read; an empty
    table gives a file without segments. Documents are dealt by ranges of (key,
    text hash), so that one key with very many rows may still be split.
    """
    worker_path(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["part", "segment", "n_ids", "keys", "ends", "chunks", "bitmaps", "ranks"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, number = P.pieces(tokenizer), TaskContext.get().partitionId(), 0
        keys, bodies, size, types = [], [], 0, None

        def row() -> pa.RecordBatch:
            levels = encode(np.concatenate(bodies))
            ends = np.cumsum([len(b) for b in bodies]).tolist()
            values = [part, number, size, keys, ends, *map(list, zip(*levels))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(types), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            types = batch.column(0).type
            for k, found in zip(batch.column(0), tok.ids_of(batch.column(1))):
                body = np.concatenate([found.astype(np.uint32), end])
                keys.append(k.as_py())
                bodies.append(body)
                size += len(body)
                if size >= segment_ids:
                    yield row()
                    keys, bodies, size, number = [], [], 0, number + 1
        if keys:
            yield row()

    schema = f"part int, segment int, n_ids long, keys array<{kind}>, ends array<long>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    dealt = rows.repartitionByRange(F.asc_nulls_first("key"), "tie").sortWithinPartitions(F.asc_nulls_first("key"), "tie", "text")
    dealt.select("key", "text").mapInArrow(segments, schema).write.option("compression", "zstd").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, first: the ids in front of every segment. Summed by parts first, so no task sees all segments."""
    segments = spark.read.parquet(path).select("part", "segment", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_first"))
    return segments.withColumn("in_part", before(Window.partitionBy("part").orderBy("segment"))).join(parts, "part").select("part", "segment", (F.col("part_first") + F.col("in_part")).alias("first"))


def read(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Documents of a file: key, start (ids of all documents before it), n_tokens, ids_crc32, and with `ids` the ids."""
    file = spark.read.parquet(path)
    worker_path(spark)
    kind = file.schema["keys"].dataType.elementType.simpleString()
    names = ["part", "segment", key, "at", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(i)[n] for i, name in enumerate(batch.schema.names)}
                keys, ends = row["keys"].values, row["ends"].values.to_numpy()
                codes = Codes(list(zip(*(row[c].as_py() for c in ("chunks", "bitmaps", "ranks")))))
                at = np.concatenate([[0], ends[:-1]])
                found = np.concatenate([codes.at(np.arange(lo, min(lo + 200_000, ends[-1]))) for lo in range(0, ends[-1], 200_000)])
                for lo in range(0, len(keys), 2000):
                    hi = min(lo + 2000, len(keys))
                    bodies = [found[a:b] for a, b in zip(at[lo:hi].tolist(), ends[lo:hi].tolist())]
                    columns = [
                        pa.array(np.full(hi - lo, row["part"].as_py(), np.int32)), pa.array(np.full(hi - lo, row["segment"].as_py(), np.int32)), keys.slice(lo, hi - lo),
                        pa.array(at[lo:hi], pa.int64()), pa.array(ends[lo:hi] - at[lo:hi], pa.int64()), pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([b.astype(np.int32) for b in bodies], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"part int, segment int, {key} {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    docs = file.select("part", "segment", "keys", "ends", "chunks", "bitmaps", "ranks").mapInArrow(documents, schema)
    found = docs.join(starts(spark, path), ["part", "segment"])
    return found.select(key, (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
