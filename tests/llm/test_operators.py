"""The ten operators against brute-force versions, on texts that are awkward in every way."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lodestone.llm import decontaminate, extraction, packing, pieces, quality, sharding, simhash, substring, tokencount, tokenfile, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
SPACES = "[^\x20\x09-\x0d]+"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [sentence(120) for _ in range(6)]
    out = [None, "", " ", "one", "one two", "A\tB\nC\x0bD\x0cE\rF", "x<|endoftext|>y  z", "  lead\n\ntrail  ", "café 　x\x85y", "a\x00b \x00c", "don't I'LL 'S 12a3 ½², ok!?"]
    out += base + base[:3]  # exact copies
    for b in base:
        w = b.split()
        w[60] = "changed"
        out.append(" ".join(w))  # near copies
        out.append(sentence(30) + "\n" + " ".join(w[5:58]) + "  " + sentence(40))  # a passage of 53 words
        out.append(sentence(10) + " " + " ".join(w[5:54]) + " " + sentence(9))  # 49 words: no window
    out.append("the " * 400)
    out.append(base[0] + " " + base[0])
    out += [sentence(3000), "###$$$ " * 60, "LOUD!! " * 70, "same line here\n" * 30]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans int, shard string, fp string"


@pytest.fixture(scope="module")
def rows():
    out = [(100 + 3 * i, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(out)
    return out + [out[7], out[7], (None, "a row without a key"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1, 0.5, 1, "x", "y") for k, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_key(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_pieces_equal_the_library(rows):
    p, tok = pieces.Pieces(BPE, room=50), Tokenizer.from_file(BPE)
    assert p.piecewise and p._core is not None
    odd = [f"a{c}b {c} c{c}{c}d{c}" for c in pieces.WHITE + pieces.ALSO_WHITE + "​⁠﻿"]
    for t in [t for _, t in rows if t] + odd + ["日本 語", "!\x1c!", "<|endoftext|>", " <|endoftext|> "]:
        want = tok.encode(t, add_special_tokens=False).ids
        assert p.ids(t).tolist() == want, repr(t)
        assert p.ids(t).tolist() == want


def test_sharding(spark, docs, none, rows):
    tree, grown = sharding.Tree.of(8), sharding.Tree.of(9)
    found = sharding.shard(docs, tree, grown, cells=4).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == want
    assert sharding.shard(none, tree).count() == 0

    ids = spark.range(20_000).select(sharding.F.col("id").alias("doc_id"), sharding.F.lit("t").alias("text"))
    heavy = sharding.Tree({"a": {"x": {0: 1.0, 1: 3.0}, "y": {2: 2.0}}, "b": {"x": {3: 2.0}, "y": {4: 0.0, 5: 2.0}}})
    more = sharding.Tree({"a": {"x": {0: 1.0, 1: 5.0}, "y": {2: 2.0}}, "b": {"x": {3: 2.0}, "y": {4: 0.0, 5: 2.0}}})
    moved = sharding.shard(ids, heavy, more).groupBy("shard", "grown_shard").count().collect()
    sizes = Counter()
    for r in moved:
        sizes[r["shard"]] += r["count"]
        if r["shard"] != r["grown_shard"]:  # only towards the subtree that grew
            assert r["grown_shard"] in (0, 1, 2) and (r["shard"] in (3, 5) or r["grown_shard"] in (0, 1))
    assert abs(sizes[1] - 6000) < 400 and abs(sizes[0] - 2000) < 300 and sizes[4] == 0


def test_sharding_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    tree, grown = sharding.Tree.of(8), sharding.Tree.of(9)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(c.sql(f"SELECT doc_id, size, shard, grown_shard FROM ({sharding.shard_sql(tree, grown)})").fetchall())
    assert by_key(sharding.shard(spark.read.parquet(f"{sf}/documents.parquet"), tree, grown), "doc_id", "size", "shard", "grown_shard") == sorted(want, key=repr)


def test_token_counts(docs, none, rows):
    tok = Tokenizer.from_file(BPE)
    want = sorted(((k, len((t or "").encode()), n, n > 512) for k, t in rows for n in [len(tok.encode(t or "", add_special_tokens=False).ids)]), key=repr)
    for size, buckets in ((1, 3), (2000, 256), (1 << 20, 7)):
        found = tokencount.count_tokens(docs, BPE, block_bytes=size, buckets=buckets)
        assert by_key(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert tokencount.count_tokens(none, BPE).count() == 0


def test_token_counts_of_another_kind_of_file(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    data = [(1, "Some Words, here"), (2, None), (3, "Some Words, here")]
    found = tokencount.count_tokens(spark.createDataFrame(data, "doc_id long, text string"), path)
    assert by_key(found, "doc_id", "n_tokens") == [(k, len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in data]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text, width=4):
    w = re.findall(SPACES, lower(text))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, budget=4):
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("bucket", [1, 8_000])
def test_simhash(docs, none, rows, bucket):
    fps = {k: brute_fingerprint(t) for k, t in rows if k is not None}
    classes = brute_classes(fps)
    want = sorted(((k, f"{brute_fingerprint(t):016x}", classes.get(k)) for k, t in rows), key=repr)
    assert by_key(simhash.near_duplicates(docs, bucket=bucket), "doc_id", "fingerprint", "component_id") == want
    if bucket > 1:
        assert simhash.near_duplicates(none).count() == 0


def test_trie_join_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 250))
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 12)), dtype=np.uint64)
        fps = base[rng.integers(0, len(base), n)]
        for _ in range(int(rng.integers(0, 8))):
            hit = rng.random(n) < 0.5
            fps[hit] ^= np.uint64(1) << rng.integers(0, 64, hit.sum()).astype(np.uint64)
        groups = rng.integers(0, 3, n)
        order = np.lexsort((fps, groups))
        fps, groups = fps[order], groups[order]
        want = {}
        for g in set(groups.tolist()):
            want |= brute_classes({int(i): int(fps[i]) for i in np.flatnonzero(groups == g)})
        assert simhash.trie_join(groups, fps, 4).tolist() == [want[i] for i in range(n)]


def brute_substring(rows, width=50):
    words = [(k, re.findall(SPACES, t or "")) for k, t in rows]
    least = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - width + 1):
                s = tuple(w[i : i + width])
                least[s] = min(least.get(s, k), k)
    out = []
    for k, w in words:
        gone = set()
        if k is not None:
            for i in range(len(w) - width + 1):
                if least[tuple(w[i : i + width])] < k:
                    gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [300, 6 << 20])
def test_substring(docs, none, rows, shard_bytes):
    found = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring.dedup(docs, shard_bytes=shard_bytes).collect()]
    want = brute_substring(rows)
    assert sum(r[2] for r in want) > 500
    assert sorted(found, key=repr) == want
    if shard_bytes > 300:
        assert substring.dedup(none).count() == 0


def test_html(spark):
    page = lambda n, body: f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a href=x>menu {n}</a></nav><div class='promo-banner'>buy {n}</div><div class=strip>follow us</div>{body}<footer>f</footer></body>"
    data = [(i, f"http://h.example/{i}", page(i, f"<article><h1>Head {i}</h1><p>One&nbsp;&amp; <b>tw</b>o {i}<p>three<div class=comments>no</div><p class=share>share it</p></article>")) for i in range(8)]
    data += [(20, None, None), (21, "odd", ""), (22, "http://one.example/a", "<p>a\n\n b<br>c</p><ul><li><a href=x>l</a><li>text that is long</ul>"), (23, "http://h.example/0", data[0][2]), (None, "http://x.example", "plain &lt; text")]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "page_id long, url string, html string, n_chars int, template string")
    found = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in extraction.main_text(df).collect()}
    want = {(i, f"http://h.example/{i}"): f"Head {i} One & two {i} three" for i in range(8)}
    want |= {(20, None): "", (21, "odd"): "", (22, "http://one.example/a"): "a b c text that is long", (23, "http://h.example/0"): "Head 0 One & two 0 three", (None, "http://x.example"): "plain < text"}
    assert found == {k: (t, len(t)) for k, t in want.items()}
    assert extraction.main_text(df.where("false")).count() == 0
    for bad in ("<", "<a", "<p " + "x='1" * 500, "</p>" * 50, "<ul>" * 300, "<!--", "<script>x"):
        extraction.extract(bad, None)


def test_tree_matching_folds_repeats():
    tree = lambda h, p: extraction.shape(extraction.parse(h), p)
    t = tree("<div><p>a<p>b</div><h2>x</h2>", 1)
    for n in range(2, 9):
        t = extraction.fold(t, tree(f"<div><p>a<p>b<p>c{n}</div><aside>z</aside><h2>x</h2>", n))
    kids = {k[0]: k for k in t[4]}
    assert set(kids) == {"div", "aside", "h2"} and kids["div"][4][0][0] == "p" and kids["div"][4][0][3]
    assert extraction._constant(kids["h2"]) and not extraction._constant(kids["div"][4][0])


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    clean = ["alpha", "beta", "gamma", "delta", "omega", "zeta"]
    data, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        w = rng.choices(clean, k=40)
        if bad:
            w[rng.randrange(40)] = "Vile!"
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(df, known).select("doc_id", "score", "predicted", toxicity.held_out().alias("held")).collect()
    held = [r for r in found if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) and all(0 <= r["score"] <= 1 for r in found)
    odd = toxicity.toxicity(docs, known.where("false"))
    assert odd.count() == docs.count() and odd.where("predicted = 1").count() == 0
    assert toxicity.toxicity(none, known).count() == 0


def test_training_ignores_held_out_labels(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(300)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(300)]
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    a, b = (by_key(toxicity.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")), "doc_id", "score") for x in (labels, flipped))
    assert a == b


def brute_contamination(rows, items, width=13):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = {}
    for name, body in items:
        w = re.findall(pattern, lower(body))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(name)
    out = []
    for k, t in rows:
        w = re.findall(pattern, lower(t))
        hit, names = set(), set()
        for i in range(len(w)):
            for n in range(1, width + 1):
                if i + n <= len(w) and (of := windows.get(tuple(w[i : i + n]))):
                    hit.update(range(i, i + n))
                    names |= of
        out.append((k, len(w), len(hit), ",".join(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1, 8 << 20])
def test_decontamination(spark, docs, none, rows, block_bytes):
    long = next(t for _, t in rows if t and len(t.split()) == 120)
    items = [("a", " ".join(long.split()[3:20])), ("b", long.upper()[:200]), ("c", "one"), ("d", ""), ("e", None), ("c2", "ONE, two"), ("the", "the"), ("f", "never to be found " * 5), ("a", "LOUD LOUD")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, n_words int")
    want = brute_contamination(rows, items)
    assert sum(r[2] for r in want) > 100
    found = decontaminate.find(docs, bench, block_bytes=block_bytes).select("*", decontaminate.contaminated().alias("bad"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["bad"]) for r in found.collect()), key=repr) == want
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(docs, bench.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("cell", [1, 5_000, 1 << 22])
def test_packing(docs, none, rows, cell):
    tok = Tokenizer.from_file(BPE)
    found = packing.pack(docs, BPE, end_id=1, window=256, cell_tokens=cell).collect()
    sequences, pieces_of = {}, {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces_of.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids"], r["ids_crc32"], r["doc_tokens"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    copies = Counter(k for k, _ in rows)
    for k, t in dict(rows).items():
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        if copies[k] > 1:
            continue
        at = 0
        for start, n, ids, crc, total in sorted(pieces_of[k]):
            assert start == at and total == len(want) and ids == want[start : start + n] and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += n
        assert at == len(want)
    if cell > 5_000:
        assert packing.pack(none, BPE, end_id=1).count() == 0


def test_packing_fills_windows():
    rng = np.random.default_rng(3)
    for lengths in (rng.lognormal(6, 1, 8000).astype(int) + 1, np.full(3000, 1100), rng.integers(1, 40, 9000)):
        used = {}
        for d, s, n, q, o in packing.pack_cell(lengths, 2048, 16):
            used[q] = used.get(q, 0) + n
        assert sum(used.values()) == lengths.sum() and max(used.values()) <= 2048
        assert lengths.sum() / 2048 / len(used) > 0.97


def test_nnls_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.integers(0, 3, (12, 30)).astype(float), rng.random(12) * 5
        x = packing.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient > -1e-6).all() and (np.abs(gradient[x > 1e-9]) < 1e-6).all()


def test_token_file(spark, docs, none, rows, tmp_path):
    tok = Tokenizer.from_file(BPE)
    path = f"file://{tmp_path}/ids"
    tokenfile.write(docs, path, BPE, end_id=2, segment_ids=700)
    found = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    at = 0
    known = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows}
    for r in found:
        if r["doc_id"] is not None:
            assert r["ids"] == known[r["doc_id"]]
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    tokenfile.write(none, path + "0", BPE, end_id=2)
    assert tokenfile.read(spark, path + "0").count() == 0


def test_codes_give_random_access():
    rng = np.random.default_rng(5)
    for top in (10, 256, 60_000, 1 << 32):
        ids = rng.integers(0, top, 5000, dtype=np.uint64).astype(np.uint32)
        codes = tokenfile.Codes(tokenfile.encode(ids))
        at = rng.integers(0, 5000, 3000)
        assert (codes.at(at) == ids[at]).all() and (codes.at(np.arange(5000)) == ids).all()
    assert len(tokenfile.Codes(tokenfile.encode(np.zeros(0, np.uint32))).at(np.zeros(0, int))) == 0


def brute_quality(text):
    text = text or ""
    w = re.findall(SPACES, text)
    lines = text.split("\n")
    duplicates = sum(1 for i, line in enumerate(lines) if re.search(SPACES, line) and line in lines[:i])
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if counts[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), duplicates, len(covered)


def test_quality(docs, none, rows):
    book = quality.ledger(docs)
    want = sorted(((k, *brute_quality(t)) for k, t in rows), key=repr)
    assert by_key(book, "doc_id", *quality.MEASURES[:5]) == want
    failed = {k: (n < 50 or 100 * r > 50 * n) for k, n, _, _, _, r in want}
    assert all(r["base"] != failed[r["doc_id"]] for r in book.select("doc_id", quality.kept(quality.BASE).alias("base")).collect() if r["doc_id"] is not None)
    bits = [r["failed"] for r in book.select("failed").collect()]
    got = {r["version"]: (r["n_docs"], r["n_kept"]) for r in quality.outcomes(book).collect()}
    assert got == {p.version: (len(bits), sum(1 for b in bits if not b & p.mask)) for p in quality.POLICIES}
    policy = quality.POLICIES[-1]
    alone = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality.ablations(book, policy).collect()}
    for n, (name, _) in enumerate(quality.RULES):
        assert alone[name] == (sum(1 for b in bits if b >> n & 1), sum(1 for b in bits if b & policy.mask == 1 << n))
    assert quality.ledger(none).count() == 0
