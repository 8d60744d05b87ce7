"""Lexical search over Chinese and mixed texts, and vector search, against brute force."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.constants import STOP_WORDS
from lodestone.operators import ranking as R


def tokens(text):
    low = unicodedata.normalize("NFKC", text or "").lower()
    out = re.findall("[a-z0-9]+", low) + re.findall("[a-z0-9]+(?:[._/-][a-z0-9]+)+", low)
    for run in re.findall("[㐀-鿿]+", low):
        out += [w for w in ([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]) if w not in STOP_WORDS]
    return out


def test_chinese_corpus(spark):
    rng = random.Random(7)
    syllables = "国债期货交割结算基金公司合同条款风险管理办法规定如何什么的了和"
    docs = [(i, "".join(rng.choices(syllables + "，。 ", k=rng.randint(5, 60))) + rng.choice(["", " ＡＢＣ-１２", " v1.2/x", "①ﬁ"])) for i in range(120)] + [(900, None), (901, ""), (902, "货")]
    asked = [(1, "国债期货如何交割"), (2, "ABC-12 合同"), (3, "货"), (4, ""), (5, "如何 什么")]
    of = {i: Counter(tokens(t)) for i, t in docs}
    mean, n = sum(sum(c.values()) for c in of.values()) / len(of), len(of)
    want = {}
    for q, text in asked:
        for term in set(tokens(text)):
            df = sum(1 for c in of.values() if term in c)
            for i, c in of.items():
                if tf := c.get(term):
                    size = sum(c.values())
                    want[q, i] = want.get((q, i), 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in R.bm25(d, q).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want) and {k[0] for k in want} == {1, 2, 3}
    df = {r["term"]: r["df"] for r in R.document_frequency(d).collect()}
    assert df == Counter(t for c in of.values() for t in c)


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3] if i % 7 else None, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(80)] + [(100, "a", None), (101, "a", [0.0] * 4), (102, "a", [float("nan")] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(4)
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    want = {(q, i): round(float(unit[q] @ unit[i]), 9) for q in unit if q % 5 == 0 for i in unit}
    best = lambda pairs, k: {p for p, _ in sorted(pairs, key=lambda x: (-x[1], x[0][1]))[:k]}
    top = {(r["query_id"], r["vec_id"]) for r in R.top_k(R.nearest(vectors, asked, 4), 4, "query_id", "vec_id").collect()}
    assert top == set().union(*(best([(p, s) for p, s in want.items() if p[0] == q], 4) for q in {p[0] for p in want}))
    label = {i: g for i, g, _ in rows}
    kept = {(r["query_id"], r["vec_id"]) for r in R.nearest(vectors, asked, 2, group="label").collect()}
    for q in {p[0] for p in want}:
        for g in (None, "a", "b", "c"):
            assert best([(p, s) for p, s in want.items() if p[0] == q and label[p[1]] == g], 2) <= kept
