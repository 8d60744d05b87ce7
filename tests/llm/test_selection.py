"""Hard negatives, mixing and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestone.llm import mixing, negatives, queries, resampling
from lodestone.llm.ordering import running_sums
from tests.llm.test_operators import SCHEMA, by_key, lower, texts
from tests.test_oracles import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_mixing", "op13_resampling"])
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == canonical(want.columns, want.fetchall())


def brute_negatives(data):
    rows = []
    for k, v, y in data:
        if k is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((k, (y + 1) % 10 if k % 7 == 0 else y, [math.floor(256 * x) for x in v]))
    out = []
    most = (1 << 63) - 1
    for a, la, va in rows:
        if a % 50:
            continue
        score = [(min(max(sum(x * y for x, y in zip(va, v)), -most - 1), most), k, y) for k, y, v in rows]
        near = sorted((-s, k) for s, k, y in score if y == la and k != a)[:5]
        for p, k in near:
            fits = sorted((-s, n) for s, n, y in score if y != la and 50 * -p <= 100 * s <= 95 * -p)[:3]
            out += [(a, k, i + 1, n, -p, -s) for i, (s, n) in enumerate(fits)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.1, 1.0], (n, 1))
    return [(int(k), [float(x) * scale for x in v], int(y)) for k, v, y in zip(rng.permutation(3 * n)[:n] - n // 2, rows, rng.integers(0, 3, n))]


@pytest.mark.parametrize(("dim", "scale"), [(7, 0.2), (16, 3e4), (3, 1e8), (5, 1e300)])
def test_hard_negatives(spark, dim, scale):
    data = vectors(dim, 900, dim, scale)
    odd = [(None, data[0][1], 1), (100_000, None, 1), (100_050, data[0][1], None), (100_100, [1.0, None], 1), (100_150, [float("nan")] * dim, 2), (100_200, [float("inf")] * dim, 2), (100_250, [], 1), (100_300, data[3][1][:2], 0), (100_350, [0.0] * dim, 2), (-100_050, data[5][1], 1)]
    twice = [(*data[9],), (*data[9],), (data[10][0], data[11][1], data[10][2])]
    rows = data + odd + twice
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, anchor int").repartition(5)
    want = brute_negatives(rows)
    assert len(want) >= 30
    assert by_key(negatives.mine(df), *COLUMNS) == sorted(want, key=repr)
    if scale == 0.2:
        assert by_key(negatives.mine(df, stripe_bytes=4000, sample=10), *COLUMNS) == sorted(want, key=repr)
        assert negatives.mine(df.where("false")).count() == 0
        assert negatives.mine(df.where("label is null")).count() == 0


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(1)
    rows = negatives.floored(rng.normal(size=(3000, 20)) * 0.3)
    q = negatives.Quantiser.fit(rows[:1000])
    codes, reach = q.encode(rows)
    low, high = q.bounds(rows[:50], codes, reach)
    exact = rows[:50] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.sort(low, axis=1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.2


def test_windows_of_scores():
    for p in [*range(-60, 200), (1 << 63) - 1, -(1 << 63), 10**18 + 7]:
        lo, hi = negatives.window(np.array([p], np.int64))
        assert int(lo[0]) == -(-p // 2) and int(hi[0]) == 19 * p // 20


def brute_mix(rows, weights=(5, 2, 1), epochs=3):
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(epochs * total[s] for s in capped)
        shares = sum(weight[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and left * weight[s] / shares >= epochs * total[s]}
        if not above:
            break
        capped |= above
    return size, total, {s: float(epochs * total[s]) if s in capped else left * weight[s] / shares for s in names}


def mixed(spark, rows):
    df = spark.createDataFrame([(k, t, "en", s, 1, 0.5, 1, "x", "y") for k, t, s in rows], SCHEMA.replace("fp string", "name string")).repartition(3)
    return mixing.mix(df).collect()


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["b", "a", "é", "Z", None, "a", "a"])) for i, t in enumerate(texts() * 3)]
    rows += [(None, "x y z", "b")] * 3 + [(4, "x", "b"), (7, None, "void"), (8, "", "void"), (9, "only seven words in this small source", "zz"), (11, "one two", "\U0001f600"), (12, "three", "￮")]
    found = mixed(spark, rows)
    size, total, target = brute_mix(rows)
    assert len(found) == len(rows)
    assert sorted(((r["doc_id"], r["size"], r["source"], r["source_size"]) for r in found), key=repr) == sorted(((k, n, s, total[s]) for (k, _, s), n in zip(rows, size)), key=repr)
    taken = defaultdict(int)
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert taken == {s: math.floor(t + 1e-9) for s, t in target.items()}
    assert sum(target.values()) == pytest.approx(sum(size)) and any(t == 3.0 * total[s] > 0 for s, t in target.items())
    for s in total:  # whole epochs, then a prefix, with one row cut at most
        epochs = {r["taken"] / r["size"] for r in found if r["source"] == s and r["size"]}
        assert len({e for e in epochs if e == int(e)}) <= 2 and len(epochs) <= 3
    assert sorted(map(tuple, mixed(spark, rows)), key=repr) == sorted(map(tuple, found), key=repr)


def test_mixing_of_little(spark):
    assert mixed(spark, []) == []
    assert [tuple(r)[2:] for r in mixed(spark, [(1, None, None), (2, " ", "a")])] == [(0, 0, 0.0, 0)] * 2
    assert [tuple(r) for r in mixed(spark, [(1, "a b c", None)])] == [(1, None, 3, 3, 3.0, 3)]


def test_running_sums(spark):
    rng = random.Random(6)
    data = [(rng.choice(["x", "x", "x", "y", "z"]), rng.randrange(1000), rng.randrange(50)) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(4)
    f = resampling.F
    want, at = [], Counter()
    for g, o, v in sorted(data):
        want.append((g, o, v, at[g]))
        at[g] += v
    found = running_sums(df, [f.col("o"), f.col("v")], {"before": f.col("v")}, by=["g"], cell_rows=37)
    assert by_key(found, "g", "o", "v", "before") == sorted(want, key=repr)


def brute_resample(rows, items, share=5, least=20, buckets=10_000):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    held = [features(t) for _, t in rows]
    s = Counter(b for _, f in held for b in f)
    t = Counter(b for x in items for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    scored = []
    for (k, _), (n, f) in zip(rows, held):
        h = int(hashlib.sha256(f"42:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        scored.append((k, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = defaultdict(list)
    for i, r in enumerate(able[: share * len(able) // 100]):
        ranks[r].append(i + 1)
    return sorted(((*r, ranks[r].pop() if ranks[r] else None) for r in scored), key=repr)


@pytest.mark.parametrize("share", [5, 60, 100])
def test_resampling(spark, share):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcÉé9", k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(1000 - i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, " ".join(words)), (None, None), (3, "a\x00B-c\x7fdİeK"), (5000, "A b\tC " * 30), (5000, "A b\tC " * 30)]
    items = [" ".join(rng.choices(words[:9], k=30)), None, "", "One two", "a" * 3]
    df = spark.createDataFrame([(k, t, "en", "s", 1, 0.5, 1, "x", "y") for k, t in rows], SCHEMA.replace("spans int", "rank int")).repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    found = resampling.resample(df, bench, share=share)
    assert by_key(found, *columns) == brute_resample(rows, items, share)
    if share == 5:
        assert by_key(resampling.resample(df, bench.where("false")), *columns) == brute_resample(rows, [])
        assert resampling.resample(df.where("false"), bench).count() == 0
