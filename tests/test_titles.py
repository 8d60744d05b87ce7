"""Title similarity against brute force."""

import random
import re
from difflib import SequenceMatcher

import pytest

from lodestone.functions import similarity
from lodestone.operators import curation
from lodestone.plans import QUERIES
from tests.test_operators import rows


def test_title_similarity_pairs_match_brute_force(spark, tmp_path):
    long = " ".join(f"word{n * 7919 % 1000}" for n in range(200))
    firsts = ["Annual report 2020", "Annual report, 2021", "annual report 2020", "Anual report 2020", "other", "otter", long, long[:-40] + " end", "x" * 120 + "abcdefgh" * 20, "x" * 120 + "12345678" * 20, "", "..."]
    docs = [(i + 7 * k, t + "\nbody\nx", lang, "s") for k, lang in enumerate(("en", "de")) for i, t in enumerate(firsts, 100 * k)] + [(500, firsts[0], "en", "other"), (501, None, "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    key = {d: ((s, lang), re.sub(r"[!-/:-@\[-`{-~\s]", "", (t or "").split("\n")[0]).lower()) for d, t, lang, s in docs}
    first = {}
    for d in sorted(key):
        first.setdefault(key[d], d)
    want = {(first[key[d]], d): 1.0 for d in key if key[d][1] and first[key[d]] != d}
    for a in sorted(first.values()):
        for b in sorted(first.values()):
            (x, s), (y, t) = key[a], key[b]
            if a < b and x == y and s and t and (r := SequenceMatcher(None, s, t, autojunk=False).ratio()) >= 0.82:
                want[a, b] = r
    got = rows(QUERIES["title_similarity_pairs"](spark, str(tmp_path)))
    assert len(want) > 9 and {r[:2]: r[2] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_similar_titles_filter_loses_nothing(spark, chunk):
    rng = random.Random(3)
    titles = {"".join(rng.choices("abcde語", k=rng.choice([3, 41, 59, 64, 65, 130, 300]))) for _ in range(25)}
    for t in sorted(titles):
        for share in (0.05, 0.1, 0.15):
            titles.add("".join(c for c in t if rng.random() > share) or "a")
            titles.add("".join(rng.choice("abcde") if rng.random() < share else c for c in t))
    titles = sorted(titles)
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(titles)], "page long, block string, title string")
    want = {(i, j): r for i, a in enumerate(titles) for j, b in enumerate(titles[i + 1 :], i + 1) if (r := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= 0.82}
    assert {r[:2]: r[2] for r in rows(curation.similar_titles(df, chunk=chunk))} == want


def test_ratio_of_long_strings():
    rng = random.Random(4)
    for n in (900, 2500):
        a = "".join(rng.choices("abcdef", k=n))
        b = "".join(rng.choice("abcdef") if rng.random() < 0.1 else c for c in a)
        for x, y in ((a, b), (b, a), (a, a[::-1]), (a, b[n // 3 :] + b[: n // 3]), (a, "z" * n)):
            assert similarity.ratio(x, y) == SequenceMatcher(None, x, y, autojunk=False).ratio()


def _common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("one_by_one", [True, False, None])
def test_filter_is_the_common_subsequence(monkeypatch, one_by_one):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh語", k=k)) for k in (1, 2, 7, 62, 63, 64, 65, 90, 126, 127, 128, 190, 260) for _ in range(2)]
    texts += ["".join(c for c in t if rng.random() > 0.15) or "a" for t in texts] + ["".join(rng.choice("abcdefgh") if rng.random() < 0.15 else c for c in t) for t in texts]
    rng.shuffle(texts)
    if one_by_one is not None:
        monkeypatch.setattr(similarity._Long, "fits", staticmethod(lambda pairs, length: one_by_one))
    left, right = texts[:40], texts[40:]
    for least in (0.4, 0.82):
        enough = lambda a, b: 2 * _common(a, b) >= least * (len(a) + len(b)) - 1e-6
        found = [p for i, j in similarity.may_reach(left, right, least) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(found) == [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if enough(a, b)]
        found = [tuple(sorted(p)) for i, j in similarity.may_reach(left, None, least) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(found) == [(i, j) for i in range(40) for j in range(i + 1, 40) if enough(left[i], left[j])]


def test_ratio_of_near_copies():
    rng = random.Random(6)
    for n in (3, 20, 150, 600):
        for _ in range(5):
            a = "".join(rng.choices("abcd", k=n))
            b = "".join(rng.choice("abcd") if rng.random() < 0.1 else c for c in a if rng.random() > 0.05)
            for x, y in ((a, b), (b, a), (a, a), (a, ""), ("", ""), (a[:5], b), (a * 2, b)):
                assert similarity.ratio(x, y) == SequenceMatcher(None, x, y, autojunk=False).ratio()


def test_chunks_of_titles_meet_only_within_reach(spark):
    titles = [(i, block, chr(97 + i % 26) * (5 + i)) for block in "xy" for i in range(60)]
    dealt, cells = curation.title_cells(spark.createDataFrame(titles, "page long, block string, title string"), 0.82, 1)
    length = {(r["block"], r["chunk"]): r["length"] for r in dealt.collect()}
    met = {(r["block"], length[r["block"], r["x"]], length[r["block"], r["y"]]) for r in cells.collect()}
    assert len(length) == 120 and met == {(b, n, m) for b in "xy" for n in range(5, 65) for m in range(n, 65) if 2 * n >= 0.82 * (n + m)}
