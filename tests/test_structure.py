"""Parsers of structure."""

from lodestone.functions import structure as S
from lodestone.sources import html as H

LINES = ["前言", "目录", "第一章 总则 ... 1", "", "第一章 总则", "第一条 目的", "一、范围", "第二条 依据第一条", "第二章 附则", "第三条 其他"]


def test_outline_nests_and_skips_contents():
    sections = S.outline(LINES)
    assert [(s[1], s[2], s[3]) for s in sections] == [(-1, 0, 9), (0, 4, 7), (1, 5, 6), (2, 6, 6), (1, 7, 7), (0, 8, 9), (5, 9, 9)]
    assert S.minimal_union(sections, {1, 2, 3, 6}) == [1, 6] and S.promote(sections, 3, 2) == 1 and S.promote(sections, 3, 9) == 1
    assert S.resolve(LINES[7][3:], sections) == [("article", 1, "RESOLVED", 2)]
    assert S.resolve("见第九条和《别的》第一条", sections) == [("article", 9, "UNRESOLVED", -1)]


def test_statements_and_commands():
    assert S.statements("自2021年3月5日起施行。《旧规》同时废止；《某法》除第二条外废止") == [("effective", "2021-03-05", False), ("repeals", "旧规", False), ("repeals", "某法", True)]
    assert S.commands("READ: a\n```\nREAD: b\n```\n> GAP: c\nSEARCH：d\nREAD: a") == [("READ", "a"), ("SEARCH", "d")]
    assert S.missing_gaps(["《甲》规定", "乙"], ["甲规定（2020）"]) == ["乙"]


def test_greedy_choices():
    assert S.merge_lines(["a", "b", "", "c.", "d"]) == [(0, 1, "a b"), (3, 3, "c."), (4, 4, "d")]
    assert S.seeds({"q": [("u1", "s1"), ("u2", "s1"), ("u3", "s2")], "r": [("u1", "s1"), ("u4", "s3")]}, 3) == ["u1", "u4", "u3"]
    assert S.trim_tiers([("a", 0, 5), ("b", 1, 9), ("c", 1, 3), ("d", 2, 2)], 10) == ["a", "c", "d"]


def test_html():
    page = "<head><title>t</title></head><h1>A&amp;B</h1><p>x <b>y</b><br>z</p><script>s</script><table><tr><td>1<td>2</tr><tr><td>3</tr></table><ul><li>i</ul>"
    assert [b[:3] for b in H.html_blocks(page)] == [("heading", 1, "A&B"), ("paragraph", 0, "x y z"), ("table", 0, "1\t2\n3\t"), ("list", 0, "i")]
    assert H.html_blocks(None) == []
    assert H.sanitize('<p onclick="x">a<script>alert(1)</script><a href="javascript:x">b</a><a href="/c">d</a>') == '<p>a<a>b</a><a href="/c">d</a></p>'


def test_rows_of_texts_equal_their_functions(spark):
    from lodestone.functions import structure as S
    from lodestone.operators import structure as O

    data = [(1, "a\nb\n\nc.\nd\n" + "x" * 100), (2, None), (3, ""), (4, "第一条 总则\n" * 3), (1, "twice")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    want = sorted((k, *r) for k, t in data if t is not None for r in S.merge_lines(t.split("\n")))
    assert sorted(map(tuple, O.merged_lines(df).collect())) == want
    want = sorted((k, n) for k, t in data if t is not None for n, *_ in S.outline(t.split("\n")))
    assert sorted((r["doc_id"], r["section"]) for r in O.sections(df).collect()) == want
    assert O.headings(df.where("false")).count() == 0 and O.packets(df, 7).groupBy("doc_id").count().count() == 2
