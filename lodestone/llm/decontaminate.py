"""Benchmark decontamination by a prefix-filtered set join.

1. Words of items are counted over all documents, by a hash of a million slots.
2. Every window of an item takes its rarest word as prefix: a document that contains
   the window has to contain that word. Windows are filed in a table of their own.
3. Documents are read once more. At each occurrence of a prefix word the windows
   around it that fit into the text, of the lengths that items have, are looked up
   in a Bloom filter of all item windows. What passes is joined to the table of
   windows word for word, once for each window of a block of documents.

Slots and filter are broadcast; their sizes are fixed or bounded, and only how many
candidates are joined depends on them. Neither texts nor windows come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import materialise, worker_path

#: UTF-8 bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Slots that words are counted by.
SLOTS = 1 << 20
#: Bits of the filter of windows: sixteen for a window, from a mebibit to a gibibit (128 MB).
FILTER_BITS = (1 << 20, 1 << 30)
#: ASCII letters are lower-cased; of ASCII only letters and digits belong to words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[bytes]:
    """Words of a text (None: none): runs of ASCII letters, digits and all non-ASCII characters."""
    return text.encode().translate(_WORD).split() if text else []


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def digests(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of the words start to start + size, from the hashes of all words."""
    n = len(h)
    while len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            more = np.full(len(_powers[k]), pow(base, len(_powers[k]), 1 << 64), np.uint64)
            _powers[k] = np.concatenate([_powers[k], _powers[k] * more])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers[0][:n])])
    d = (total[start + size] - total[start]) * _powers[1][start] + size.astype(np.uint64)
    d ^= d >> np.uint64(31)
    return d * _MIX


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _places(d: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter of `bits` bits that stand for a digest."""
    return d & np.uint64(bits - 1), (d >> np.uint64(33)) & np.uint64(bits - 1)


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap of `bits` bits in which the bits `at` of all rows are set: bits / 8 bytes at most come to the driver."""
    at = F.col("at") + 1
    found = rows.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in found:
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["n"] - 1) * 4096 :][: len(part)] = part
    return out


def slot_counts(docs: DataFrame, asked: np.ndarray) -> np.ndarray:
    """How often all documents hold words of each asked slot (a bitmap)."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, counts = np.flatnonzero(np.unpackbits(shared.value, bitorder="little")[:SLOTS]), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                h = hashes(words(t.as_py())) & np.uint64(SLOTS - 1)
                np.add.at(counts, h, 1) if len(h) < 5000 else np.add(counts, np.bincount(h.astype(np.int64), minlength=SLOTS), out=counts)
        live = live[counts[live] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(counts[live], pa.int64())], names=["at", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def item_slots(items: DataFrame) -> DataFrame:
    """at: the slots of words of items (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                at = np.unique(hashes(words(t.as_py())) & np.uint64(SLOTS - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    return items.select("text").mapInArrow(run, "at long")


def item_windows(items: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """window, digest, prefix (slot of its rarest word), size, item: the windows of items (item, text) all whose words occur."""
    shared = items.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(t.as_py())
                if not found:
                    continue
                h = hashes(found)
                slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
                size = min(width, len(found))
                start = np.arange(len(found) - size + 1)
                least = np.lib.stride_tricks.sliding_window_view(counts[slot], size).argmin(1) + start
                start, least = start[counts[slot[least]] > 0], least[counts[slot[least]] > 0]
                joined = [b" ".join(found[a : a + size]) for a in start.tolist()]
                d = digests(h, start, np.full(len(start), size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(joined, pa.binary()), pa.array(d), pa.array(slot[least]), pa.array(np.full(len(start), size, np.int32)), pa.array([name] * len(start), pa.string())], names=["window", "digest", "prefix", "size", "item"])

    return items.select("item", "text").mapInArrow(run, "window binary, digest long, prefix long, size int, item string")


def candidates(found: list[bytes], prefixes: np.ndarray, passing: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the windows of a text that hold a prefix word and pass the filter, each once."""
    h = hashes(found)
    at = np.flatnonzero(_bit(prefixes, h & np.uint64(SLOTS - 1)))
    starts, lengths = [], []
    for size in sizes if len(at) else []:
        start = np.unique((at[:, None] - np.arange(size)).ravel())
        start = start[(start >= 0) & (start + size <= len(h))]
        starts.append(start)
        lengths.append(np.full(len(start), size))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, size = np.concatenate(starts), np.concatenate(lengths)
    one, two = _places(digests(h, start, size), 8 * len(passing))
    passed = _bit(passing, one) & _bit(passing, two)
    return start[passed], size[passed]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, items: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every occurrence of an item window (`width` words in a row, or a shorter item whole) in the documents.

    Returns, per row of docs: key, n_words, spans (array of half-open word
    spans, merged), n_hit (words in spans), items (ids of the items that occur,
    sorted, distinct). Null and word-less texts have no words; items without
    words have no windows; a null item id counts as ''. Repeated items and rows
    are kept apart by id only. Empty tables give no hits or no rows. Other columns
    aren't read.

    Documents are read twice, whatever the number of items, and never shuffled: a
    block of them asks for each of its distinct candidate windows once.
    """
    spark = docs.sparkSession
    worker_path(spark)
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    asked = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    counts = slot_counts(texts, bitmap(item_slots(asked), SLOTS))
    windows = materialise(item_windows(asked, counts, width), "windows")
    n = windows.count()
    bits = min(max(FILTER_BITS[0], 1 << (16 * n).bit_length()), FILTER_BITS[1])
    low, high = F.col("digest").bitwiseAND(bits - 1), F.shiftrightunsigned("digest", 33).bitwiseAND(bits - 1)
    passing = bitmap(windows.select(F.explode(F.array(low, high)).alias("at")), bits)
    prefixes = bitmap(windows.select(F.col("prefix").alias("at")), SLOTS)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    shared = spark.sparkContext.broadcast((prefixes, passing, sizes))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (prefixes, passing, sizes), base = shared.value, TaskContext.get().partitionId() << 32
        keys, n_words, hits, known, size, number, types = [], [], [], {}, 0, 0, None

        def row() -> pa.RecordBatch:
            packed = np.concatenate([np.empty((0, 4), "<i4"), *hits]).tobytes()
            values = [(base | number, pa.int64()), (keys, pa.list_(types)), (n_words, pa.list_(pa.int64())), (packed, pa.binary()), (list(known), pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["block", "keys", "n_words", "hits", "windows"])

        for batch in batches:
            types = batch.column(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                found = words(t.as_py())
                start, length = candidates(found, prefixes, passing, sizes)
                if len(start):
                    which = [known.setdefault(b" ".join(found[a : a + n]), len(known)) for a, n in zip(start.tolist(), length.tolist())]
                    hits.append(np.stack([np.full(len(start), len(keys)), start, length, which], 1).astype("<i4"))
                keys.append(k.as_py())
                n_words.append(len(found))
                size += len(t.as_py() or "")
                if size >= block_bytes or len(keys) >= 100_000:
                    yield row()
                    keys, n_words, hits, known, size, number = [], [], [], {}, 0, number + 1
        if keys:
            yield row()

    schema = f"block long, keys array<{kind}>, n_words array<long>, hits binary, windows array<binary>"
    held = materialise(texts.mapInArrow(blocks, schema), "candidates")
    owners = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    answers = held.select(F.col("block").alias("asker"), F.posexplode("windows").alias("number", "window")).join(owners, "window").select("asker", "number", "items")

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {name: left[name][0] for name in left.column_names}
        keys, of = row["keys"].values, dict(zip(right["number"].to_pylist(), right["items"].to_pylist()))
        spans: list[list] = [[] for _ in keys]
        names: list[set] = [set() for _ in keys]
        for d, start, size, number in np.frombuffer(row["hits"].as_py(), "<i4").reshape(-1, 4).tolist():
            if number in of:
                spans[d].append((start, start + size))
                names[d].update(of[number])
        merged = [[{"start": a, "end": b} for a, b in merge(s)] for s in spans]
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({key: keys, "n_words": row["n_words"].values, "spans": pa.array(merged, kinds), "items": pa.array([sorted(x) for x in names], pa.list_(pa.string()))})

    schema = f"{key} {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    found = held.drop("windows").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(resolve, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(key, "n_words", "spans", n_hit.alias("n_hit"), "items")


def contaminated() -> Column:
    """n_hit > 0 and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
