"""Semantic units: whole coverage, budgets, groups and repetitions."""

import random

from lodestone.functions import units as U
from lodestone.operators import structure as O


def covered(text, rows):
    """Characters of the text that spans hold, once each, apart from what a unit repeats."""
    seen = set()
    for row in rows:
        for s in row[-1]:
            assert text[s["start"] : s["end"]] == row[-3][s["body_start"] : s["body_end"]]
        seen |= {i for s in row[-1] for i in range(s["start"], s["end"])}
    return seen


def found(text, budget, overlap=0, context=0):
    out = []
    for section, titles, headed, blocks in O.section_blocks(text):
        for u in U.units(blocks, titles, headed, budget, overlap, context):
            out.append((section, titles, u.prefix, u.text, u.tokens, [{"start": o + a, "end": o + b, "body_start": c, "body_end": d} for o, a, b, c, d in u.spans]))
    return out


def test_units_cover_all_and_keep_to_the_budget():
    rng = random.Random(4)
    pieces = ["第一章 总则", "第一条 目的", "第二条 范围", "一、项目", "word", "two words.", "借：现金", "贷：存款", "12 Note about it.", "如下：", "a\tb\tc", "| x | y |", "|---|---|", "但是例外。", "", "  ", "长" * 30 + "。" + "句" * 9, "one. two! three? " * 4, "x" * 90]
    for _ in range(400):
        text = "\n".join(rng.choices(pieces, k=rng.randint(0, 25)))
        budget = rng.choice([2, 3, 5, 9, 20, 60])
        overlap, context = rng.choice([0, 2, 8]), rng.choice([0, 3, 20])
        rows = found(text, budget, overlap, context)
        assert all(r[4] <= budget and r[4] == U.tokens(r[2] + r[3]) and r[3] for r in rows)
        assert all(U.tokens(r[2]) <= context for r in rows)
        blocks = {b.ordinal + i for *_, some in O.section_blocks(text) for b in some for i in range(len(b.text))}
        assert covered(text, rows) == blocks
        if not overlap:
            spans = sorted((s["start"], s["end"]) for r in rows for s in r[-1])
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_groups_headers_and_context():
    table = "head one\tsecond\n" + "\n".join(f"r{n}\tv{n}" for n in range(12))
    rows = found("第一章 名称\n" + table, 16, overlap=5, context=6)
    assert all(r[3].startswith(("第一章 名称\nhead one\tsecond\n", "head one\tsecond\n")) for r in rows) and len(rows) > 3
    assert {r[2] for r in rows} == {"第一章 名称\n\n"}
    booking = "分录如下：\n借：现金一\n贷：存款一\n"
    rows = found("前言" * 8 + "。\n" + booking + "后话" * 8 + "。", 19)
    assert any("分录如下：\n借：现金一\n贷：存款一" in r[3] for r in rows)
    rows = found("A rule holds.\nBut not here.\nOther text follows.", 7)
    assert [r[3] for r in rows] == ["A rule holds.\nBut not here.", "Other text follows."]
    rows = found("One two three. Four five six. Seven eight nine.", 6, overlap=3)
    assert [r[3] for r in rows] == ["One two three. Four five six. ", "Four five six. Seven eight nine."]


def test_prefixes_keep_the_nearest_heading():
    assert U.prefixes(["Part one", "Chapter two", "Rule three"], 4) == ["Rule three\n\n", ""]
    assert U.prefixes(["Part one", "Chapter two", "Rule three"], 5) == ["Chapter two / Rule three\n\n", "Rule three\n\n", ""]
    assert U.prefixes([], 9) == [""] and U.prefixes(["a b c"], 2) == [""]


def test_units_of_texts(spark):
    data = [(1, "第一章 总则\nbody text here\n" + "word " * 50), (2, None), (3, ""), (4, " \n "), (1, "again"), (None, "no key")]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, prefix string").repartition(2)
    rows = O.units(df, 10, 3, 5).collect()
    want = sorted((k, r[3], r[4]) for k, t in data if t and k for r in found(t, 10, 3, 5))
    assert sorted((r["doc_id"], r["body"], r["n_tokens"]) for r in rows if r["doc_id"]) == want
    assert [r["body"] for r in rows if r["doc_id"] is None] == ["no key"]
    assert O.units(df.where("false")).count() == 0
