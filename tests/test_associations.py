"""Located paths, references and reading closures."""

from lodestone.functions import structure as S
from lodestone.operators import associations as A

TEXT = """第一章 总则
第一条 目的
依照第二章第一条第二项和《他法》（2020）第九条第一款办理，见附件2第三条。
第二条 范围
一、甲
二、乙，按前条执行
第二章 附则
第一条 其他
一、丙
二、丁，见第一章第二条第二款和第五条[^n]
第三条 末条，依照第一条。
[^n]: 注"""


def test_locators():
    found = [(k, t, p) for _, _, k, t, p in S.locators("第四条 依照第二章第一条第（二）项、《法》（甲）第九条，见附件 2第三条；下一条，第六十条[^a] [^b]: x")]
    assert found == [
        ("path", "", [("chapter", 2), ("article", 1), ("item", 2)]), ("external", "法（甲）", [("article", 9)]), ("annex", "附件2", [("article", 3)]),
        ("relative", "下一", [("article", 1)]), ("path", "", [("article", 60)]), ("note", "a", []),
    ]


def test_references_lead_to_sections(spark):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "没有引用")], "doc_id long, text string")
    index = A.section_index(df)
    at = {(r["first_line"]): r["section"] for r in index.where("doc_id = 1 and section > 0").collect()}
    found = sorted((r["line"], r["kind"], r["title"], r["status"], r["target"]) for r in A.references(df, index).collect())
    assert found == [
        (2, "annex", "附件2", "EXTERNAL", None), (2, "external", "他法（2020）", "EXTERNAL", None), (2, "path", "", "RESOLVED", at[9]), (5, "relative", "前", "RESOLVED", at[1]),
        (9, "note", "n", "RESOLVED", at[10]), (9, "path", "", "BROADER", at[3]), (9, "path", "", "UNRESOLVED", None), (10, "path", "", "RESOLVED", at[7]),
    ]
    places = spark.createDataFrame([(1, 1, [("article", 1)], None), (1, 2, [("article", 1)], at[4]), (1, 3, [("chapter", 2), ("item", 1)], None), (1, 4, [], None), (1, 5, [("paragraph", 1)], None), (1, 6, [("item", 2)], at[9])], "doc_id long, place int, parts array<struct<family: string, number: int>>, owner int")
    got = {r["place"]: (r["status"], r["target"]) for r in A.locate(places, index).collect()}
    assert got == {1: ("AMBIGUOUS", None), 2: ("RESOLVED", at[1]), 3: ("RESOLVED", at[8]), 4: ("UNRESOLVED", None), 5: ("UNRESOLVED", None), 6: ("RESOLVED", at[9])}


def test_closure_reads_items_together_and_follows_references(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    index = A.section_index(df)
    at = {(r["first_line"]): r["section"] for r in index.where("section > 0").collect()}
    refs = A.references(df, index)
    read = lambda sections, groups=True: sorted(r["section"] for r in A.reading_closure(index, refs, spark.createDataFrame([(1, s) for s in sections], "doc_id long, section int"), groups).collect())
    # Item two of chapter one points to the article before, that to an item of chapter two, whose article points back.
    assert read([at[5]]) == sorted([at[1], at[3], at[7], at[10]])
    assert read([at[4]], groups=False) == [at[4]]
    assert read([at[10]]) == read([at[7]])
    assert read([at[0], at[1]]) == sorted([at[0], at[7], at[10]])
