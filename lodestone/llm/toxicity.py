"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.decontaminate import words
from lodestone.session import worker_path

#: log2 of the number of features; feature 0 is the bias.
BITS = 20
#: Labelled rows of each class that a model is fitted on, at most: the least by a hash of their key.
SAMPLE = 8_000


@dataclass(frozen=True)
class Ftrl:
    """Learning rates per coordinate alpha / (beta + sqrt(n)); l1 keeps weights at zero, l2 shrinks them.

    l1 is the gradient that a feature has to gather before it gets a weight: what
    only a few rows hold stays out. The rarer class counts up to `balance` times.
    """

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.1
    epochs: int = 10
    balance: float = 5.0


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed single words, pairs, and pairs that skip one word, as they come; none for texts without words."""
    found = words(text)
    h = np.fromiter(map(zlib.crc32, found), np.uint64, len(found))
    mix = np.uint64(0x9E3779B97F4A7C15)

    def fold(x: np.ndarray) -> np.ndarray:
        return ((x * mix) >> np.uint64(64 - bits)).astype(np.uint32)

    pair = lambda a, b, salt: (a * np.uint64(0xFF51AFD7ED558CCD) + b + np.uint64(salt)) ^ (b << np.uint64(17))
    return np.concatenate([fold(h), fold(pair(h[:-1], h[1:], 1)), fold(pair(h[:-2], h[2:], 2))])


def train(rows: list[tuple[np.ndarray, int]], ftrl: Ftrl = Ftrl(), bits: int = BITS) -> np.ndarray:
    """Weights after passes over (distinct features, label) rows, in order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        free = np.abs(zs) > ftrl.l1
        return np.where(free, -(zs - np.sign(zs) * ftrl.l1) / ((ftrl.beta + np.sqrt(n[at])) / ftrl.alpha + ftrl.l2), 0.0)

    ones = sum(label for _, label in rows)
    odds = (len(rows) - ones) / ones if ones and ones < len(rows) else 1.0
    scale = (max(1.0, min(ftrl.balance, 1 / odds)), max(1.0, min(ftrl.balance, odds)))
    for _ in range(ftrl.epochs):
        for at, label in rows:
            w = weights(at)
            g = scale[label] * (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label)
            was = n[at]
            z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / ftrl.alpha * w
            n[at] = was + g * g
    return weights(np.arange(1 << bits))


def sample(labels: DataFrame, allowed: Column, per_class: int, key: str, label: str) -> tuple[DataFrame, float]:
    """At most per_class labelled keys of each class, the least by a hash of the key.

    Also how far the log odds of the classes among all allowed rows lie from those of the sample.
    """
    rows = labels.where(allowed & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(label).cast("int").alias("label"))
    ranked = rows.withColumn("at", F.xxhash64(F.col(key).cast("string")))
    n = {r["label"]: r["count"] for r in ranked.groupBy("label").count().collect()}
    shift = math.log(n[1] / n[0]) - math.log(min(n[1], per_class) / min(n[0], per_class)) if len(n) == 2 else 0.0
    parts = [ranked.where(F.col("label") == c).orderBy("at", key).limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), shift


def fit(docs: DataFrame, chosen: DataFrame, shift: float, key: str, text: str, ftrl: Ftrl = Ftrl(), bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features of non-zero weight, and the weights, of a model fitted on a bounded set of keys.

    One task fits, on at most the sample's rows, which hold at most 2 ** bits
    distinct features each; only the sparse weights come to the driver. The bias
    is moved by `shift`, so that classes the sample thins out keep their share.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, label, at in zip(batch.column(0), batch.column(1), batch.column(2)):
                f = np.unique(np.append(features(t.as_py(), bits), np.uint32(0))).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary()), pa.array([label.as_py()], pa.int32()), pa.array([at.as_py()], pa.int64())], names=["features", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(f.as_py(), "<u4"), y.as_py()) for b in batches for f, y in zip(b.column(0), b.column(1))]
        w = train(rows, ftrl, bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["feature", "weight"])

    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key).select("text", "label", "at")
    found = rows.mapInArrow(extract, "features binary, label int, at long").repartition(1).sortWithinPartitions("at", "label", "features")
    model = found.select("features", "label").mapInArrow(learn, "feature long, weight double").collect()
    if not model:
        return np.zeros(1, np.int64), np.full(1, -35.0)
    weights = {r["feature"]: r["weight"] for r in model}
    weights[0] = weights.get(0, 0.0) + shift
    return np.array(list(weights), np.int64), np.array(list(weights.values()), np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """score (probability of label 1), predicted (1 at 0.5 or more) and all columns of docs; columns of these names are replaced."""
    spark, docs = docs.sparkSession, docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = shared.value
        dense = np.zeros(1 << bits)
        dense[at] = weight
        live = np.zeros(1 << bits, bool)
        live[at] = True
        for batch in batches:
            scores = []
            for t in batch.column(batch.schema.get_field_index(text)):
                f = features(t.as_py(), bits)
                x = float(dense[np.unique(f[live[f] & (f > 0)])].sum() + dense[0])
                scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, x)))))
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["score", "predicted", *batch.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"score double, predicted int, {fields}")


def held_out(key: str = "doc_id") -> Column:
    """Keys whose CRC-32 as text is divisible by five; null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE, ftrl: Ftrl = Ftrl(), bits: int = BITS) -> DataFrame:
    """score, predicted and the columns of docs, for every row.

    Fitted on whole texts of at most per_class labelled rows of each class, none
    of them held out. Where a key has several labels the largest counts. Null
    and empty texts score by the bias alone; without usable labels nothing is taken
    for toxic (score next to 0). Repeated rows score alike, extra columns pass
    through (score and predicted are replaced), an empty table gives none.
    """
    worker_path(docs.sparkSession)
    chosen, shift = sample(labels, ~held_out(key), per_class, key, label)
    return score(docs, fit(docs, chosen, shift, key, text, ftrl, bits), key, text, bits)
