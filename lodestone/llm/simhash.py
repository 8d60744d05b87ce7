"""Near duplicates by SimHash fingerprints, found by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.components import components
from lodestone.session import materialise, worker_path

#: Fingerprints in a bucket beyond which it is dealt out anew by further bits.
BUCKET = 8_000
#: Depth of such dealing: beyond it (31 bits fixed, at least) a bucket is joined as it is, in the memory of one
#: task (about 100 bytes for a fingerprint); its fingerprints are distinct and share these bits.
DEPTH = 3
#: Node pairs followed, and places compared, at once.
FRONT = 100_000
COMPARED = 1_000_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the text's shingles of `width` words; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """key, fp: the fingerprint of every row as a signed long."""
    worker_path(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, fp long")


@lru_cache(maxsize=4)
def blocks(budget: int, depth: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Masks of bit blocks by id, and the ids below each id (0: the root).

    The bits that a mask leaves open are cut into budget + 1 blocks. Of two
    fingerprints that differ in at most `budget` bits, one block agrees.
    """
    masks, below = {0: 0}, {}
    level = [0]
    for _ in range(depth):
        after = []
        for parent in level:
            free = [b for b in range(63, -1, -1) if not masks[parent] >> b & 1]
            parts = np.array_split(np.array(free), budget + 1)
            below[parent] = []
            for part in parts:
                if not len(part):
                    continue
                me = len(masks)
                masks[me] = masks[parent] | sum(1 << int(b) for b in part)
                below[parent].append(me)
                after.append(me)
        level = after
    return masks, below


def _deal(rows: DataFrame, budget: int) -> DataFrame:
    """(id, fp, node) -> (id, val, fp, node): a row for each block below the row's mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, below = blocks(budget, DEPTH)
        for batch in batches:
            ids, fps, nodes = (batch.column(i).to_numpy() for i in range(3))
            for parent in np.unique(ids).tolist():
                at = ids == parent
                for me in below[parent]:
                    mask = np.uint64(masks[me])
                    vals = (fps[at].view(np.uint64) & mask).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vals), me, np.int32)), pa.array(vals), pa.array(fps[at]), pa.array(nodes[at])], names=["id", "val", "fp", "node"])

    return rows.select("id", "fp", "node").mapInArrow(run, "id int, val long, fp long, node long")


class _Forest:
    """Union of places 0 to n - 1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            self.root[np.maximum(a, b)] = np.minimum(a, b)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_join(groups: np.ndarray, fps: np.ndarray, budget: int) -> np.ndarray:
    """Root of every place: places of one group whose fingerprints differ in at most `budget` bits are linked.

    groups and then fps ascend. A node of a group's binary trie is the run of
    places that share their leading bits. Pairs of nodes descend together, bit
    by bit: children on the same side keep the differing bits of their pair,
    children on opposite sides add one, and pairs beyond the budget are dropped.
    Pairs of few places are compared directly.
    """
    n, forest = len(fps), _Forest(len(fps))
    edges = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1, append=groups[-1] + 1)) if n else np.zeros(1, np.int64)
    ones: dict[int, np.ndarray] = {}

    def ones_before(level: int) -> np.ndarray:
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - level)) & np.uint64(1))]).astype(np.int64)
        return ones[level]

    def compare(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        ends = np.cumsum((a1 - a0) * (b1 - b0))
        cuts = [0, *(np.flatnonzero(np.diff(ends // COMPARED)) + 1).tolist(), len(ends)]
        for lo, hi in zip(cuts, cuts[1:]):
            nb = b1[lo:hi] - b0[lo:hi]
            sizes = (a1[lo:hi] - a0[lo:hi]) * nb
            pair = np.repeat(np.arange(hi - lo), sizes)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = a0[lo:hi][pair] + place // nb[pair], b0[lo:hi][pair] + place % nb[pair]
            near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            forest.join(i[near], j[near])

    stack = [(0, edges[:-1], edges[1:], edges[:-1], edges[1:], np.zeros(len(edges) - 1, np.int8))]
    while stack:
        level, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [(level, a0[:half], a1[:half], b0[:half], b1[:half], diff[:half]), (level, a0[half:], a1[half:], b0[half:], b1[half:], diff[half:])]
            continue
        if level == 64:  # each node is one fingerprint, maybe repeated
            forest.join(a0, b0)
            for lo, hi in ((a0, a1), (b0, b1)):
                again = np.repeat(lo, hi - lo)
                forest.join(again, again + np.arange(len(again)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
            continue
        few = (a1 - a0) * (b1 - b0) <= 64
        if few.any():
            compare(a0[few], a1[few], b0[few], b1[few])
            a0, a1, b0, b1, diff = (x[~few] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        before = ones_before(level)
        am, bm = a1 - (before[a1] - before[a0]), b1 - (before[b1] - before[b0])
        apart, spent = a0 != b0, diff < budget
        children = [
            (a0, am, b0, bm, diff, np.ones(len(a0), bool)),
            (am, a1, bm, b1, diff, np.ones(len(a0), bool)),
            (a0, am, bm, b1, diff + 1, spent),
            (am, a1, b0, bm, diff + 1, spent & apart),
        ]
        parts = [tuple(x[(lo < hi) & (lo2 < hi2) & keep] for x in (lo, hi, lo2, hi2, d)) for lo, hi, lo2, hi2, d, keep in children]
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))
    return forest.root


def _links(buckets: DataFrame, budget: int, batch_rows: int = 200_000) -> DataFrame:
    """a, b: edges that connect what the trie self-join links inside the buckets; under one per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(ids, vals, fps, nodes):
            if not len(ids):
                return
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (vals[1:] != vals[:-1])])
            root = trie_join(np.cumsum(new), fps.view(np.uint64), budget)
            low = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[root[low]])], names=["a", "b"])

        held, rows = [], 0  # a bucket that goes on is only joined to when it ends
        for batch in batches:
            some = [batch.column(i).to_numpy() for i in range(4)]
            ids, vals = some[:2]
            ends = np.flatnonzero((ids[1:] != ids[:-1]) | (vals[1:] != vals[:-1])) + 1
            if held and batch.num_rows and (held[-1][0][-1], held[-1][1][-1]) != (ids[0], vals[0]):
                ends = np.concatenate([[0], ends])
            if rows + batch.num_rows >= batch_rows and len(ends):
                cut = int(ends[-1])
                yield from joined(*map(np.concatenate, zip(*held, [x[:cut] for x in some])))
                held, rows = [], 0
                some = [x[cut:] for x in some]
            if len(some[0]):
                held.append(some)
                rows += len(some[0])
        if held:
            yield from joined(*map(np.concatenate, zip(*held)))

    # Flipping the sign bit makes signed order that of unsigned fingerprints.
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    return buckets.repartition("id", "val").sortWithinPartitions("id", "val", order).select("id", "val", "fp", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, budget: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Fingerprint and near-duplicate class of every row.

    The key is an integer. Returns key (long), fingerprint (16 hex digits), component_id: the smallest
    key reachable over links between fingerprints of at most `budget` differing
    bits. A text without words (null, empty) has fingerprint zero and is linked
    like any other. Rows that share a key are one document. A row with a null key
    carries no links and has a null component. An empty table gives none; other
    columns aren't read.

    Equal fingerprints are one node (the least key stands for it), so copies cost
    nothing. A node goes into budget + 1 buckets, by blocks of its bits of which
    one must agree with any neighbour's. Buckets of more than `bucket` nodes are
    dealt anew by blocks of the bits left open, up to DEPTH times. Inside buckets
    runs the trie self-join, which returns fewer edges than nodes. Components are
    found by star rounds in shared storage.
    """
    found = materialise(fingerprints(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)), key, text, width), "fingerprints")
    nodes = found.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node"))
    front = nodes.select(F.lit(0).alias("id"), "fp", "node")
    links = None
    for depth in range(1, DEPTH + 1):
        dealt = materialise(_deal(front, budget), "buckets")
        last = depth == DEPTH
        hot = None if last else materialise(dealt.groupBy("id", "val").count().where(F.col("count") > bucket).select("id", "val"), "hot")
        more = not last and not hot.isEmpty()
        found_here = _links(dealt.join(hot, ["id", "val"], "left_anti") if more else dealt, budget)
        links = found_here if links is None else links.unionByName(found_here)
        if not more:
            break
        front = dealt.join(hot, ["id", "val"], "left_semi").select("id", "fp", "node")
    roots = components(links)
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    component = F.when(F.col(key).isNotNull(), F.col("root")).alias("component_id")
    return found.join(classes, "fp", "left").select(key, hexed, component)
