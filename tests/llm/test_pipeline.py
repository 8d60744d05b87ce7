"""The pipeline's stages against brute-force versions, and its end."""

import hashlib
import random

import pytest

import corpus_pipeline as P
from tests.llm.test_operators import brute_classes, brute_contamination, brute_fingerprint, brute_substring, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts() * 2)]
    rows += [(1000 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=60) + (["vile"] * (i % 2))), "en", "s", 1) for i in range(200)] + [(None, "no key", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000 + i, i % 2) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", " ".join(rows[11][1].split()[3:30]))], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.drop_toxic(spark, docs, folder)
    assert kept.columns == P.COLUMNS
    left = {r["doc_id"] for r in kept.collect()}
    assert not any(1000 <= k and k % 2 for k in left if k is not None) and {1000 + 2 * i for i in range(100)} <= left and None in left

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    classes = brute_classes({k: brute_fingerprint(t) for k, t in rows if k is not None})
    want = sorted({k for k, c in classes.items() if k == c})
    found = P.drop_near_copies(spark, docs, folder)
    assert found.columns == P.COLUMNS and sorted(r["doc_id"] for r in found.collect() if r["doc_id"] is not None) == want

    cut = {r["doc_id"]: r["text"] for r in P.cut_repeats(spark, docs, folder).collect()}
    texts_of = dict(rows)
    for k, n, removed, digest in brute_substring(rows):
        if removed:
            assert hashlib.sha256(cut[k].encode()).hexdigest() == digest
        else:
            assert cut[k] == texts_of[k]

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {r[0] for r in brute_contamination(rows, items) if not r[4]}
    assert {r["doc_id"] for r in P.drop_contaminated(spark, docs, folder).collect()} == want


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0
