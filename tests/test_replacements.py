"""Replacement facts and suggestions on hand-made texts."""

from datetime import date

from lodestone.operators import replacements as R

TEXTS = {
    "a": ["现公布《新规》，自2024年3月1日起施行。", "《旧规一》、《旧规二》第三条同时废止；《草案规》尚未废止。"],
    "b": ["《后法》替代《前法》部分条款。", "自公布之日起施行。", "2020年5月6日"],
    "c": ["自2021年1月1日起施行，自2022年1月1日起实施。《甲》废止。", "2021年1月1日"],
    "d": ["现公布《废止目录》。", "《乙》予以废止。自2024年13月1日起施行。"],
    "e": ["新修订的《丙》已审议通过，现予以发布，《丙（2010）》停止执行。"],
    "f": ["本办法自2023年7月8日起施行，《旧办法》废止。"],
    "g": [None, "没有书名废止"],
}


def test_replacement_facts(spark):
    rows = [(v, f"{v}{n}", n, t) for v, texts in TEXTS.items() for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "version_id string, block_id string, ordinal int, text string").repartition(3)
    got = sorted(((r["version_id"], r["predecessor"], r["successor"], r["effective_from"], r["scope"]) for r in R.replacement_facts(df).collect()), key=repr)
    assert got == sorted([
        ("a", "旧规一", "新规", date(2024, 3, 1), "full"), ("a", "旧规二", "新规", date(2024, 3, 1), "partial"), ("b", "前法", "后法", date(2020, 5, 6), "partial"), ("c", "甲", None, None, "full"), ("d", "乙", None, None, "full"),
        ("e", "丙（2010）", "丙", None, "full"), ("f", "旧办法", None, date(2023, 7, 8), "full"),
    ], key=repr)
    documents = [("n1", ["新规.pdf"]), ("o1", ["《旧规一》", "别名"]), ("o2", ["旧规二"]), ("o3", ["旧规 二"]), ("p", ["前法"]), ("q", ["后法"]), ("f", ["中国证券监督管理委员会新办法"]), ("g", ["旧办法"]), ("e", ["丙"]), ("x", ["丙（2010）"])]
    registered = [("p", "q", date(2020, 5, 6), "partial", "ACTIVE"), ("x", "e", None, "full", "REVOKED")]
    out = R.suggestions(R.replacement_facts(df), spark.createDataFrame(documents, "version_id string, titles array<string>"), spark.createDataFrame(registered, "predecessor string, successor string, effective_from date, scope string, state string"), df)
    found = sorted(((r["status"], r["predecessor"], r["successor"], r["evidence"], r["scope"], tuple(r["missing"])) for r in out.collect()), key=repr)
    assert found == sorted([
        ("READY", "o1", "n1", "a", "full", ()), ("NEEDS_INPUT", None, "n1", "a", "partial", ("predecessor",)), ("CONFIRMED", "p", "q", None, "partial", ()), ("NEEDS_INPUT", None, None, "c", "full", ("predecessor", "successor", "effective_from")),
        ("NEEDS_INPUT", None, None, "d", "full", ("predecessor", "successor", "effective_from")), ("READY", "g", "f", "f", "full", ()),
    ], key=repr)
    assert R.suggestions(R.replacement_facts(df.where("false")), spark.createDataFrame(documents, "version_id string, titles array<string>"), spark.createDataFrame([], "predecessor string, successor string, effective_from date, scope string, state string"), df).count() == 0


def test_title_keys(spark):
    df = spark.createDataFrame([("《 规则 》：",), ("通知—附件：附件1：《细则》",), ("中华人民共和国财政部办法（官方发布页）",), (None,), ("Ａ.DOCX",)], "t string")
    assert [r["k"] for r in df.select(R.title_keys(R.F.col("t")).alias("k")).collect()] == [["规则"], ["细则"], ["中华人民共和国财政部办法", "财政部办法"], [], ["A"]]
