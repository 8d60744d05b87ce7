"""Question plans, paragraphs and covers."""

import random
import re

from lodestone.functions import answers as P
from lodestone.operators import answers as A

VOCABULARY = [("asset", "股票", "股票"), ("asset", "债券", "债"), ("event", "trading_suspension", "停牌"), ("event", "trading_suspension", "Halt"), ("event", "bond_put", "回售"), ("special", "LOF", "lof")]


def plans(spark, *questions):
    words = spark.createDataFrame(VOCABULARY, "kind string, name string, term string")
    df = spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")
    return {r["query_id"]: r for r in A.question_plan(df, words).collect()}


def test_question_plans(spark):
    got = plans(spark, "买入股票如何入账", "halt 怎么办", "停牌期间如何申报", "现行法规", "回售如何估值，如何入账，限售", "LOF估值参数", "你好", None, "停牌限售股如何估值")
    assert [got[i]["intent"] for i in range(9)] == ["fund_accounting_practice", "specialist_valuation", "exchange_rules", "rule_validity", "specialist_valuation", "specialist_valuation", "general_knowledge", "general_knowledge", "specialist_valuation"]
    assert got[0]["dimensions"] == ["initial_measurement", "accounting_entries"] and got[0]["assets"] == ["股票"] and got[0]["roles"][0] == "accounting_manual"
    assert got[1]["assumed"] and got[1]["special"] == [] and got[1]["dimensions"] == ["applicability", "subsequent_measurement", "governance"]
    assert [(n["dimension"], n["facets"]) for n in got[2]["requirements"]] == [("applicability", ["scope"]), ("trading_procedure", ["trading_procedure"])]
    assert got[4]["dimensions"] == ["applicability", "subsequent_measurement", "exercise_state", "quote_selection", "governance", "accounting_entries"] and got[4]["assets"] == ["债券"] and got[4]["special"] == ["回售"]
    assert got[5]["roles"] == list(P.ROLES["special_case"]) and got[6]["dimensions"] == ["topic_explanation"] and not got[7]["events"]
    assert got[8]["dimensions"][1] == "inapplicability" and len(got[8]["requirements"][2]["facets"]) == 5


def test_paragraphs(spark):
    rows = [
        ("a", 1, "paragraph", "第一章", True, 1, 1), ("a", 2, "paragraph", "第一条 甲应当", False, 1, 1), ("a", 3, "paragraph", "办理。", False, 1, 1), ("a", 4, "paragraph", "另行说明，", False, 1, 1), ("a", 5, "paragraph", "5", False, 1, 5),
        ("a", 6, "paragraph", "见下页。", False, 1, 6), ("a", 7, "paragraph", "（一）若无报价：", False, 1, 6), ("a", 9, "paragraph", "12", False, 1, 6), ("a", 10, "paragraph", "续文", False, 1, 6), ("a", 11, "table", "x\ty", False, 1, 6),
        ("b", 1, "paragraph", "【原件1】如果用公式", False, 2, None), ("b", 2, "paragraph", "a + b。", False, 2, None), ("b", 3, "paragraph", "说明。", False, 2, None), ("b", 4, "paragraph", "目录……3", False, 2, None), ("b", 5, "paragraph", None, False, 2, None),
    ]
    df = spark.createDataFrame([(v, f"{v}{o}", o, k, t, h, s, p) for v, o, k, t, h, s, p in rows], "version_id string, block_id string, ordinal int, kind string, text string, heading boolean, section int, page int").repartition(3)
    got = sorted((r["version_id"], r["first_ordinal"], r["text"], len(r["block_ids"]), r["complete"], r["detail_gap"]) for r in A.paragraphs(df).collect())
    assert got == [
        ("a", 2, "第一条 甲应当办理。另行说明，", 3, False, False), ("a", 6, "见下页。", 1, True, False), ("a", 7, "（一）若无报价：", 1, False, True), ("a", 10, "续文", 1, False, False), ("a", 11, "x\ty", 1, True, False),
        ("b", 1, "如果用公式a + b。", 2, False, True), ("b", 3, "说明。", 1, True, True),
    ]
    assert A.paragraphs(df.where("false")).count() == 0


def test_facets(spark):
    df = spark.createDataFrame([("没有报价，应采用估值技术，并披露",), ("",), (None,)], "t string").select(A.facets(A.F.col("t")).alias("f"))
    assert [r["f"] for r in df.collect()] == [["no_quote", "valuation_method", "governance_disclosure"], [], []]
    assert all(re.compile(p) for p in P.FACETS.values())


def test_cover_is_greedy_and_whole():
    item = lambda v, f, n=1, size=10, exclusion=False, direct=False, ordinal=0: dict(version=v, facets=set(f), exclusion=exclusion, direct=direct, blocks=[f"{v}{ordinal}.{i}" for i in range(n)], ordinal=ordinal, bytes=size)
    items = [item("p", "a", ordinal=1), item("q", "ab", ordinal=2), item("q", "b", ordinal=3), item("p", "", ordinal=4), item("q", "c", size=500, ordinal=5), item("p", "x", n=9, ordinal=6)]
    pages = [dict(version="k", blocks=["k"], bytes=5, cites={("q", "q2.0")}), dict(version="l", blocks=["l"], bytes=5, cites={("q", "q3.0")})]
    assert A.cover(items, pages, set("abc"), "p", 6, 100) == ([(1, "supporting"), (0, "primary"), (3, "primary"), (6, "related_knowledge")], [4, 5])
    rng = random.Random(2)
    for _ in range(100):
        some = [item(rng.choice("pqr"), rng.sample("abcdef", rng.randrange(4)), rng.randint(1, 4), rng.randint(1, 60), ordinal=i) for i in range(rng.randrange(12))]
        taken, left = A.cover(some, [], set("abcd"), "p", 9, 120)
        assert sum(len(some[i]["blocks"]) for i, _ in taken) <= 9 and sum(some[i]["bytes"] for i, _ in taken) <= 120
        shown = set().union(*(some[i]["facets"] for i, _ in taken)) & set("abcd")
        for i, s in enumerate(some):  # what adds a facet is missing for the budget alone
            assert i in left or i in dict(taken) or (s["facets"] & set("abcd")) <= shown


def test_answer_context(spark):
    need = [("measure", ["a", "b"]), ("scope", ["c"])]
    frame = spark.createDataFrame([(1, need), (2, need)], "query_id int, requirements array<struct<dimension: string, facets: array<string>>>")
    units = [
        (1, "v", "Rules（已废止）", 1, ["v1"], ["a", "b", "c"], 10, True, False, True), (1, "w", "Rules", 1, ["w1", "w2"], ["a"], 10, True, False, True), (1, "w", "Rules", 4, ["w4"], ["z"], 10, True, False, False), (1, "w", "Rules", 9, ["w9"], ["b"], 10, False, False, True),
        (1, "x", "Other", 1, ["x1"], ["c"], 10, True, True, True), (2, "w", "Rules", 1, ["w1"], [], 10, False, False, True),
    ]
    units = spark.createDataFrame(units, "query_id int, version_id string, title string, first_ordinal int, block_ids array<string>, facets array<string>, n_bytes long, complete boolean, exclusion boolean, direct boolean")
    related = spark.createDataFrame([(1, "k", "k1", 4, [("w", "w2")], 0.5), (1, "l", "l1", 4, [("w", "w9")], 0.9), (2, "k", "k1", 4, [("w", "w1")], 0.5)], "query_id int, version_id string, block_id string, n_bytes long, cites array<struct<version_id: string, block_id: string>>, score double")
    got = [(r["query_id"], r["place"], r["role"], r["version_id"], r["first_ordinal"], r["primary_version"]) for r in A.answer_context(frame, units, related).orderBy("query_id", "place").collect()]
    assert got == [(1, 0, "supporting", "v", 1, "w"), (1, 1, "primary", "w", 1, "w"), (1, 2, "primary", "w", 4, "w"), (1, 3, "related_knowledge", "k", None, "w")]
