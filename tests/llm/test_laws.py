"""Laws that hold at every size: one more shard, and short documents."""

import math
import random

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import decontaminate, packing, quality, queries, sharding, simhash, substring, tokencount, tokenfile, toxicity
from tests.llm.test_operators import BPE, brute_classes, brute_contamination, brute_fingerprint, brute_quality, brute_substring
from tests.test_oracles import canonical


def test_one_more_shard_takes_rows_only_into_itself(spark):
    trees = [sharding.Tree.of(n) for n in range(1, 18)]
    keys = spark.range(4000).select("id", *(sharding.descend(sharding.F.col("id"), t).alias(f"n{n}") for n, t in enumerate(trees, 1)))
    rows = keys.collect()
    for n in range(1, 17):
        moved = [(r[f"n{n}"], r[f"n{n + 1}"]) for r in rows if r[f"n{n}"] != r[f"n{n + 1}"]]
        assert moved and all(to == n for _, to in moved)
        assert abs(len(moved) - 4000 / (n + 1)) < 5 * (4000 / (n + 1)) ** 0.5
        assert {r[f"n{n}"] for r in rows} == set(range(n))


def test_a_shard_that_shrinks_only_loses_rows(spark):
    tree = lambda w: sharding.Tree({"a": {"x": {0: 1.0, 1: w}, "y": {2: 2.0}}, "b": {"x": {7: 2.0}}})
    rows = spark.range(5000).select(sharding.descend(sharding.F.col("id"), tree(3.0)).alias("was"), sharding.descend(sharding.F.col("id"), tree(1.0)).alias("now")).collect()
    assert all(r["was"] == r["now"] or r["was"] == 1 for r in rows) and any(r["was"] != r["now"] for r in rows)
    with pytest.raises(ValueError):
        sharding.descend(sharding.F.col("id"), sharding.Tree({"a": {"x": {0: 0.0}}}))


def test_a_null_key_with_very_many_rows_is_spread(spark):
    docs = spark.range(3000).select(sharding.F.lit(None).cast("long").alias("doc_id"), sharding.F.concat(sharding.F.lit("text "), sharding.F.col("id")).alias("text"))
    found = sharding.shard(docs, sharding.Tree.of(8), cells=16).collect()
    assert len({r["shard"] for r in found}) == 1 and sorted(r["slot"] for r in found) == list(range(3000))


def test_all_columns_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(queries.oracle_sql()["op1_shard"])
    found = queries.op1_shard(spark, sf)
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == canonical(want.columns, want.fetchall())


def test_short_documents_are_solved_too():
    rng = np.random.default_rng(9)
    for lengths in (rng.integers(1, 40, 9000), np.minimum(rng.lognormal(3, 0.8, 9000).astype(int) + 1, 2047)):
        groups = packing.plan(lengths, 2048, 16)
        taken = [i for g in groups for i in g]
        assert len(taken) == len(set(taken)) and all(lengths[g].sum() <= 2048 for g in groups)
        assert lengths[taken].sum() > 0.9 * lengths.sum()
        assert lengths[taken].sum() / len(groups) > 0.95 * 2048


def test_very_long_texts_and_items(spark):
    rng = random.Random(6)
    long = " ".join(rng.choices([f"w{i}" for i in range(4000)], k=60_000))
    item = " ".join(long.split()[20_000:41_000])
    data = [(1, long), (2, "the " * 30_000), (3, None), (4, item[:300])]
    items = [("big", item), ("big2", item), ("the", "the"), ("no", "absent words of no document at all in this small corpus")]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = {r["doc_id"]: r for r in decontaminate.find(docs, bench, block_bytes=100_000).collect()}
    assert [(r["start"], r["end"]) for r in found[1]["spans"]] == [(20_000, 41_000)] and found[1]["items"] == ["big", "big2"] and found[1]["n_hit"] == 21_000
    assert found[2]["n_hit"] == 30_000 and found[2]["items"] == ["the"] and found[3]["n_words"] == 0
    want = brute_contamination(data[3:], items)
    assert [(r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), None) for r in [found[4]]] == [(*want[0][:4], None)]


def test_one_very_long_text_through_all_operators(spark, tmp_path):
    rng = random.Random(8)
    long = " ".join(rng.choices([f"word{i}" for i in range(3000)], k=120_000))
    data = [(1, long), (2, "short " + long[5000:6000]), (3, long), (4, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    tok = Tokenizer.from_file(BPE)
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids for k, t in data}
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, BPE).collect()} == {k: len(v) for k, v in ids.items()}
    near = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert near == {k: (f"{brute_fingerprint(t):016x}", {3: 1}.get(k, k)) for k, t in data}
    cut = {r["doc_id"]: r["n_removed"] for r in substring.dedup(docs).collect()}
    assert cut[1] == cut[4] == 0 and cut[3] == 120_000 and cut[2] == {r[0]: r[2] for r in brute_substring(data[:2])}[2] > 50
    packed: dict = {}
    for r in packing.pack(docs, BPE, end_id=1).collect():
        packed.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert {k: [i for _, some in sorted(v) for i in some] for k, v in packed.items()} == {k: [*v, 1] for k, v in ids.items()}
    path = f"file://{tmp_path}/long"
    tokenfile.write(docs, path, BPE, end_id=2)
    assert {r["doc_id"]: r["ids"] for r in tokenfile.read(spark, path).collect()} == {k: [*v, 2] for k, v in ids.items()}
    found = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.ledger(docs).collect()}
    assert found == {k: brute_quality(t) for k, t in data}


def test_ftrl_equals_its_definition():
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(1, 60), 8)) + [0], np.int64), rng.randint(0, 1)) for _ in range(80)]
    f = toxicity.Ftrl(l1=0.5, epochs=3)
    z, n = [0.0] * 64, [0.0] * 64

    def weight(i):
        return 0.0 if abs(z[i]) <= f.l1 else -(z[i] - math.copysign(f.l1, z[i])) / ((f.beta + math.sqrt(n[i])) / f.alpha + f.l2)

    ones = sum(y for _, y in rows)
    odds = (len(rows) - ones) / ones
    for _ in range(f.epochs):
        for at, y in rows:
            w = {int(i): weight(i) for i in at}
            g = (max(1, min(f.balance, odds)) if y else max(1, min(f.balance, 1 / odds))) * (1 / (1 + math.exp(-sum(w.values()))) - y)
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / f.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(toxicity.train(rows, f, 6), [weight(i) for i in range(64)], atol=1e-12)


def test_buckets_that_span_batches(spark):
    rng = random.Random(2)
    rows = [(1, b, fp, 1000 * b + n) for b in range(6) for n, fp in enumerate(sorted({rng.getrandbits(12) for _ in range(40)}))]
    want = set()
    for b in range(6):
        of = {n: fp for _, v, fp, n in rows if v == b}
        want |= set(brute_classes(of, 1).items())
    df = spark.createDataFrame(rows, "id int, val long, fp long, node long").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        links = [(r["a"], r["b"]) for r in simhash._links(df, 1, batch_rows=50).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = {n: n for *_, n in rows}
    for _ in range(50):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root.items()) == want
