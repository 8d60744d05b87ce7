"""Hard negatives by product quantisation with stored residual norms.

A vector is cut into short pieces, each piece is replaced by the nearest of 256
centroids, and the index keeps the centroids' numbers and how far the exact scores
can lie from those of the centroids: the norm of what quantisation leaves over, and
the rounding of the sums. An anchor's table of inner products with all centroids
then gives an upper and a lower bound of every score by lookups alone. Rows whose
bounds rule them out are dropped; all others get exact integer scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.session import materialise, worker_path

#: Places of a piece, centroids of a piece, rows that the centroids are fitted on at most, and rounds of fitting.
PIECE, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 8_192, 8
#: Bytes of a stripe of the index, about, and rows that one has at least, on average: a task holds one at a time.
STRIPE_BYTES, STRIPE_ROWS = 24 << 20, 512
#: Bounds of scores, and components of exact ones, that a task works on at once.
SCORES, COMPONENTS = 1 << 20, 1 << 23
_LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, v: rows with a key, a label and a vector of finite components, which become floor(256 * x) as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    of = F.col(label).cast("long")
    moved = F.when(F.col(key) % 7 == 0, (of + 1) % 10).otherwise(of)
    return vectors.where(fine).select(F.col(key).cast("long").alias("id"), moved.alias("label"), v.alias("v"))


def floored(v: np.ndarray) -> np.ndarray:
    """floor(256 * x), kept in doubles, in which they are exact; what is beyond a double becomes the greatest one."""
    return np.floor(np.clip(256.0 * v, -np.finfo(float).max, np.finfo(float).max))


@dataclass(frozen=True)
class Layout:
    """Places of the longest vector, and the type that holds every component."""

    dim: int
    kind: str

    @staticmethod
    def of(dim: int, most: float) -> "Layout":
        return Layout(max(dim, 1), "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")

    def pack(self, vectors: pa.Array) -> np.ndarray:
        """Quantised vectors as rows; shorter ones end in zeros."""
        sizes = np.diff(vectors.offsets.to_numpy())
        out = np.zeros((len(vectors), self.dim))
        out[np.arange(self.dim) < sizes[:, None]] = vectors.flatten().to_numpy()
        return floored(out).astype(self.kind)

    def unpack(self, rows: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(rows.to_pylist()), self.kind).reshape(-1, self.dim)

    def dots(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact inner products of rows i of a with rows j of b, as longs; what is beyond a long becomes the nearest one."""
        most = lambda x: max(abs(float(x.min(initial=0))), float(x.max(initial=0)))
        fits = most(a) * most(b) * self.dim < 2.0**62
        out, step = np.zeros(len(i), np.int64), max(1, COMPONENTS // self.dim)
        for at in range(0, len(i), step):
            p, q = a[i[at : at + step]], b[j[at : at + step]]
            if fits:
                out[at : at + step] = np.einsum("ij,ij->i", p.astype(np.int64), q.astype(np.int64))
            else:
                exact = (sum(int(x) * int(y) for x, y in zip(*rows)) for rows in zip(p.tolist(), q.tolist()))
                out[at : at + step] = [min(max(s, _LONG.min), _LONG.max) for s in exact]
        return out


class Quantiser:
    """Centroids of every piece of a vector."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids  # piece, centroid, place

    @staticmethod
    def fit(rows: np.ndarray, piece: int = PIECE, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> "Quantiser":
        """By Lloyd's rounds from evenly spaced rows of each piece's order; an empty cluster keeps its centroid."""
        parts = Quantiser._parts(rows.astype(float), piece)
        found = []
        for x in parts:
            x = x[np.lexsort(x.T)]
            c = x[np.linspace(0, len(x) - 1, centroids).astype(int)] if len(x) else np.zeros((centroids, piece))
            for _ in range(rounds if len(x) else 0):
                at = Quantiser._nearest(x, c)
                n = np.bincount(at, minlength=centroids)
                sums = np.stack([np.bincount(at, x[:, i], centroids) for i in range(piece)], 1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            found.append(c)
        return Quantiser(np.array(found))

    @staticmethod
    def _parts(rows: np.ndarray, piece: int) -> np.ndarray:
        """piece number, row, place; the last piece is filled up with zeros."""
        filled = np.pad(rows, ((0, 0), (0, -rows.shape[1] % piece)))
        return filled.reshape(len(rows), filled.shape[1] // piece, piece).transpose(1, 0, 2)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the centroids, and per row how far a score with an anchor of norm one may lie from the looked-up one."""
        parts = self._parts(rows.astype(float), self.centroids.shape[2])
        codes = np.stack([self._nearest(x, c) for x, c in zip(parts, self.centroids)], 1).astype(np.uint8)
        kept = np.stack([c[codes[:, j]] for j, c in enumerate(self.centroids)])
        norm = lambda x: np.sqrt((x * x).sum((0, 2)))
        rounding = 4 * (self.centroids.shape[0] + self.centroids.shape[2] + 4) * np.finfo(float).eps
        return codes, (norm(parts - kept) * (1 + rounding) + rounding * (norm(kept) + norm(parts)))

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of every anchor with every row, within the range of longs as the scores are."""
        parts = self._parts(anchors.astype(float), self.centroids.shape[2])
        scores = np.zeros((len(anchors), len(codes)))
        for x, c, code in zip(parts, self.centroids, codes.T):
            scores += np.take(x @ c.T, code, axis=1)
        off = np.sqrt((anchors.astype(float) ** 2).sum(1))[:, None] * reach
        low, high = scores - off, scores + off
        most = np.nextafter(2.0**63, 0)
        return np.clip(np.where(np.isfinite(low), low, -np.inf), -(2.0**63), most), np.clip(np.where(np.isfinite(high), high, np.inf), -(2.0**63), 2.0**63)


def fitted(rows: DataFrame, layout: Layout, sample: int = SAMPLE) -> Quantiser:
    """Centroids fitted in one task on at most `sample` rows, those of the least hash of their id."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [layout.pack(b.column(0)) for b in batches if b.num_rows]
        found = Quantiser.fit(np.concatenate(some) if some else np.zeros((0, layout.dim))).centroids
        yield pa.RecordBatch.from_arrays([pa.array([list(found.shape)], pa.list_(pa.int32())), pa.array([found.astype("<f8").tobytes()], pa.binary())], names=["shape", "centroids"])

    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").repartition(1)
    model = chosen.mapInArrow(learn, "shape array<int>, centroids binary").first()
    return Quantiser(np.frombuffer(model["centroids"], "<f8").reshape(model["shape"]) if model else Quantiser.fit(np.zeros((0, layout.dim))).centroids)


def index(rows: DataFrame, layout: Layout, quantiser: Quantiser) -> DataFrame:
    """id, label, codes, reach, exact: every row of usable()."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                exact = layout.pack(some.column(2))
                codes, reach = q.encode(exact)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(reach), pa.array([e.tobytes() for e in exact], pa.binary())], names=["id", "label", "codes", "reach", "exact"])

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label long, codes binary, reach double, exact binary")


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row; minus infinity where a row has fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first of each group, by descending score and ascending id."""
    order = np.lexsort((ids, ~score, group))
    of = group[order]
    starts = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(starts, np.arange(len(of)), 0))
    return order[rank < n]


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score n for a positive score p: 50 p <= 100 n <= 95 p, in longs."""
    return positive // 2 + positive % 2, positive // 20 * 19 + positive % 20 * 19 // 20


@dataclass
class Stripe:
    """Rows of the index that a task holds."""

    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    reach: np.ndarray
    exact: np.ndarray

    @staticmethod
    def of(parts: list[pa.RecordBatch], layout: Layout) -> "Stripe":
        t = pa.Table.from_batches(parts)
        labels = t["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(order), -1)
        return Stripe(t["id"].to_numpy()[order], labels[order], codes[order], t["reach"].to_numpy()[order], layout.unpack(t["exact"])[order])

    def part(self, a: int, b: int) -> "Stripe":
        return Stripe(*(x[a:b] for x in (self.ids, self.labels, self.codes, self.reach, self.exact)))

    def positives(self, q: Quantiser, layout: Layout, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """anchor place, row id, score: the n best other rows of each anchor's label."""
        found = []
        for label in np.unique(labels):
            mine, rows = np.flatnonzero(labels == label), self.part(*np.searchsorted(self.labels, [label, label + 1]))
            if not len(rows.ids):
                continue
            other = rows.ids != ids[mine][:, None]
            low, high = q.bounds(vectors[mine], rows.codes, rows.reach)
            a, r = np.nonzero(other & (high >= _least(np.where(other, low, -np.inf), n)[:, None]))
            score = layout.dots(vectors, mine[a], rows.exact, r)
            best = _best(a, score, rows.ids[r], n)
            found.append((mine[a[best]], rows.ids[r[best]], score[best]))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3

    def negatives(self, q: Quantiser, layout: Layout, labels: np.ndarray, vectors: np.ndarray, anchor: np.ndarray, positive: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """pair place, row id, score: the n best rows of another label in the window of each (anchor place, positive score)."""
        low, high = q.bounds(vectors, self.codes, self.reach)
        other = self.labels != labels[:, None]
        least, most = window(positive)
        pair, row = [], []
        for turn in range(int(np.bincount(anchor).max(initial=0))):
            # The pairs of this turn have an anchor each.
            now = np.flatnonzero(np.arange(len(anchor)) - np.searchsorted(anchor, anchor) == turn)
            lo, hi = low[anchor[now]], high[anchor[now]]
            # Bounds of a window in doubles: a unit of rounding apart, so that none is cut off.
            first, last = (np.nextafter(x[now].astype(float), to)[:, None] for x, to in ((least, -np.inf), (most, np.inf)))
            inner, outer = (np.nextafter(x[now].astype(float), to)[:, None] for x, to in ((least, np.inf), (most, -np.inf)))
            mine = other[anchor[now]]
            sure = mine & (lo >= inner) & (hi <= outer)
            enough = _least(np.where(sure, lo, -np.inf), n)[:, None]
            p, r = np.nonzero(mine & (hi >= np.maximum(first, enough)) & (lo <= last))
            pair.append(now[p])
            row.append(r)
        pair, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pair, row))
        score = layout.dots(vectors, anchor[pair], self.exact, row)
        fits = (score >= least[pair]) & (score <= most[pair])
        pair, ids, score = pair[fits], self.ids[row[fits]], score[fits]
        best = _best(pair, score, ids, n)
        return pair[best], ids[best], score[best]


def _meet(rows: DataFrame, anchors: DataFrame, stripes: int, layout: Layout, quantiser: Quantiser, found, schema: str) -> DataFrame:
    """Every stripe of the index with all anchors, which stream past it batch by batch.

    Rows are dealt into stripes and anchors copied to each of them; in a task a
    stripe's rows come first. `found(stripe, quantiser, anchors)` gives the columns of `schema`.
    """
    shared = rows.sparkSession.sparkContext.broadcast(quantiser.centroids)
    dealt = rows.withColumn("stripe", F.pmod(F.xxhash64("id", "exact"), F.lit(stripes)).cast("int")).withColumn("asks", F.lit(False))
    copies = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("asks", F.lit(True))
    both = dealt.unionByName(copies, allowMissingColumns=True)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(shared.value)
        at, parts, stripe = None, [], None
        for batch in batches:
            number, asks = batch["stripe"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if number[a] != at:
                    at, parts, stripe = number[a], [], None
                if not asks[a]:
                    parts.append(some.select(["id", "label", "codes", "reach", "exact"]))
                    continue
                if parts:
                    stripe, parts = Stripe.of(parts, layout), []
                if stripe is None:
                    continue  # no rows here
                step = max(1, SCORES // len(stripe.ids))
                for i in range(0, some.num_rows, step):
                    columns = found(stripe, q, some.slice(i, step))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.repartition(stripes, "stripe").sortWithinPartitions("stripe", "asks").mapInArrow(run, schema)


def _ranked(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n first rows of each group with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, asked: Column | None = None, positives: int = 5, negatives: int = 3, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the usable rows that `asked` holds for (keys divisible by 50). Rows
    without a key, a label or a vector, or with a null or non-finite component, take
    no part. Vectors of different lengths are compared as if the shorter ended in
    zeros; an empty vector is all zeros. A row is another one than its anchor if its
    key is another; other rows that repeat a key count as rows of their own, and so
    do repeated anchors. Scores beyond a long are the nearest long. An anchor without positives or a
    positive without negatives has no rows. Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    worker_path(spark)
    rows = usable(vectors, key, vector, label)
    n, dim, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    layout = Layout.of(dim or 0, 256.0 * (most or 0.0) + 1)
    quantiser = fitted(rows, layout, sample)
    held = materialise(index(rows, layout, quantiser), "index")
    width = layout.dim * np.dtype(layout.kind).itemsize + layout.dim // PIECE + 40
    stripes = max(1, -(-n * width // stripe_bytes), min(-(-n // STRIPE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    anchor = held.where(asked if asked is not None else F.col("id") % 50 == 0).select(F.monotonically_increasing_id().alias("anchor"), F.col("id"), "label", "exact")
    anchor = materialise(anchor, "anchors")

    def near(stripe: Stripe, q: Quantiser, some: pa.RecordBatch) -> list[pa.Array]:
        at, ids, score = stripe.positives(q, layout, some["id"].to_numpy(), some["label"].to_numpy(), layout.unpack(some["exact"]), positives)
        return [some["anchor"].take(pa.array(at)), pa.array(ids), pa.array(score)]

    close = _ranked(_meet(held, anchor, stripes, layout, quantiser, near, "anchor long, row long, score long"), ["anchor"], positives)
    chosen = close.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "score"))).alias("positives"))
    pairs = materialise(anchor.join(chosen, "anchor"), "positives")

    def hard(stripe: Stripe, q: Quantiser, some: pa.RecordBatch) -> list[pa.Array]:
        lists = some["positives"]
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        of = np.repeat(np.arange(some.num_rows), sizes)
        rank, row, score = (flat.field(i).to_numpy() for i in range(3))
        pair, ids, found = stripe.negatives(q, layout, some["label"].to_numpy(), layout.unpack(some["exact"]), of, score, negatives)
        return [some["anchor"].take(pa.array(of[pair])), some["id"].take(pa.array(of[pair])), *(pa.array(x[pair]) for x in (rank, row, score)), pa.array(ids), pa.array(found)]

    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score long, row long, score long"
    best = _ranked(_meet(held, pairs, stripes, layout, quantiser, hard, schema), ["anchor", "place"], negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


MINE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""
