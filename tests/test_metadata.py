"""Origins of documents, claims of completion, order of steps."""

import json
from datetime import date

from pyspark.sql import functions as F

from lodestone.operators import metadata as M


def test_origins(spark):
    rows = [
        (1, "上交所关于发布《规则》的通知（上证发〔2020〕12 号）", "正文"), (2, "办法", "【发布部门】财政部\t【发布文号】财会〔2019〕3号\n第一条"),
        (3, "管理办法", "（2007年6月18日证监会令 第46号公布 自2007年7月5日起施行）\n第一条 根据证监发〔2001〕1号制定"), (4, "规定", "国税发〔2008〕9号\n正文很长"), (5, "某办法", "正文\n依据国发〔2001〕3号\n中国人民银行\n二〇二〇年一月二日"),
        (6, "关于财税〔2016〕140号文件的解读", "版权所有 中国证监会\n中国证监会决定如下事项"), (7, None, None), (8, "通知—附件1：说明", "上证发〔2020〕1号"), (9, "细则", "（2024年12月20日，经理事会审议通过，2025年1月3日中基协发〔2025〕2号公告发布）"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, title string, text string, number string")
    got = {r["doc_id"]: (r["issuer"], r["located"], r["number"], r["published"]) for r in M.origins(df).collect()}
    assert got == {
        1: ("上海证券交易所", "title", "上证发〔2020〕12号", None), 2: ("财政部", "metadata_table", "财会〔2019〕3号", None), 3: ("中国证监会", "document_number", "证监会令第46号", date(2007, 6, 18)), 4: ("国家税务总局", "document_number", "国税发〔2008〕9号", None),
        5: ("中国人民银行", "signature", None, None), 6: (None, None, None, None), 7: (None, None, None, None), 8: (None, None, None, None), 9: ("中国证券投资基金业协会", "document_number", "中基协发〔2025〕2号", date(2025, 1, 3)),
    }


def acts(spark, *texts, role=None):
    df = spark.createDataFrame([(i, t, role) for i, t in enumerate(texts)], "doc_id int, text string, role string")
    out = {}
    for r in M.completions(df).orderBy("doc_id", "clause", "place").collect():
        out.setdefault(r["doc_id"], []).append((r["said"], r["act"], r["own"]))
    return out


def test_completions(spark):
    got = acts(
        spark, "付款已完成。", "如果已付款且已过账，则已确认。", "需要核对是否已付款，但已过账", "这不代表已付款", "并非没有完成", "本助手已付款。已过账", "本助手核对后，已为您支付", "先付款，已批准后方可执行", "**已**完成", "", None, "如果已付款，已过账", "不能说明已付款了以及已批准",
    )
    assert got == {
        0: [("付款已完成", "assertion", False)], 1: [("已付款", "condition", False), ("已过账", "condition", False), ("已确认", "assertion", False)], 2: [("已付款", "requirement", False), ("已过账", "assertion", False)], 3: [("已付款", "negated", False)],
        4: [("并非没有完成", "assertion", False)], 5: [("已付款", "assertion", True), ("已过账", "assertion", False)], 6: [("已为您支付", "assertion", True)], 7: [("已批准后方可执行", "condition", False)], 8: [("已完成", "assertion", False)],
        11: [("已付款", "condition", False), ("已过账", "assertion", False)], 12: [("已付款了", "negated", False), ("已批准", "assertion", False)],
    }
    assert acts(spark, "已付款且已过账。已批准", role="condition")[0] == [("已付款", "condition", False), ("已过账", "condition", False), ("已批准", "assertion", False)]


def test_unverified(spark):
    answers = spark.createDataFrame([(1, "付款已完成，我已批准"), (2, "已过账"), (3, "如果已过账"), (4, "已确认")], "doc_id int, text string")
    support = spark.createDataFrame([(1, "经核实付款已完成；我已批准"), (2, "必须先已过账"), (4, "客户已确认收到")], "doc_id int, text string")
    assert sorted(map(tuple, M.unverified(answers, support).collect())) == [(1, "已批准"), (2, "已过账")]


def test_step_order(spark):
    at = lambda **k: json.dumps(k)
    rows = [
        ("a", "x", 5, None), ("a", "y", 2, at(step_no=1)), ("b", "x", 1, at(step_no=1)), ("b", "y", 1, at(step_no=2)), ("c", "x", None, at(step_index=3, step_no=9)), ("c", "y", 0, at(step_index=1)),
        ("d", "x", None, at(label="步骤 12")), ("d", "y", None, at(label="第2步")), ("e", "x", None, at(node_path="/p10/a2", part="1")), ("e", "y", None, at(node_path="/p9/a2", part="1")), ("f", "x", None, at(node_path="/p1", part="1")), ("f", "y", None, at(node_path="/p2", part="2")),
        ("g", "x", None, at(source_page=2)), ("g", "y", None, at(source_page=1)), ("h", "x", None, at(source_page=2, coordinate_space="top_left_points", bbox=[0, 90.5, 1, 1])), ("h", "y", None, at(source_page=2, coordinate_space="top_left_points", bbox=[5, 9.25, 1, 1])),
        ("i", "x", None, at(source_page=2, coordinate_space="top_left_points", bbox=[0, 9, 1, 1])), ("i", "y", None, at(source_page=2, coordinate_space="top_left_pixels", bbox=[0, 8, 1, 1])), ("j", "x", None, None), ("k", "x", None, None), ("k", "y", 3, None), ("l", "x", -1, at(line_start=3)), ("l", "y", 4, at(line_start=2)),
    ]
    df = spark.createDataFrame(rows, "version_id string, block_id string, ordinal long, locator string").repartition(3)
    got = {}
    for r in M.step_order(df).collect():
        got.setdefault(r["version_id"], {})[r["block_id"]] = r["position"]
    last, none = {"x": 2, "y": 1}, {"x": None, "y": None}
    assert got == {"a": last, "b": none, "c": last, "d": last, "e": last, "f": none, "g": last, "h": last, "i": none, "j": {"x": 1}, "k": none, "l": last}
    assert M.step_order(df.where(F.lit(False))).count() == 0
