"""Reviews of sources and answers on hand-made cases."""

from hashlib import sha256

from pyspark.sql import functions as F

from lodestone.operators import review as R

SCHEMA = "run_id long, evidence int, resource_id string, version_id string, block_id string, ordinal int, text string, content_sha256 string, applies boolean, title string, severity string"


def records(spark, rows):
    """rows: run, evidence, version, ordinal, text, (applies)."""
    full = [(r[0], r[1], f"r-{r[2]}", r[2], f"b{r[3]}", r[3], r[4], sha256((r[4] or "").encode()).hexdigest(), r[5] if len(r) > 5 else None, "Rules 2019 and 2021, 120210", "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def issues(df):
    return sorted((r["run_id"], r["code"], r["severity"], tuple(r["evidence"]), r["start"], r["end"]) for r in df.collect())


def test_bound_records(spark):
    good = (1, 1, "v", 0, "text")
    df = records(spark, [good, good, (1, 2, "v", 1, "one"), (1, 2, "v", 1, "other"), (1, 3, "v", 2, None), (1, -4, "v", 3, "x"), (2, 1, "w", 0, "text")])
    stale = records(spark, [(3, 1, "v", 0, "new")]).withColumn("content_sha256", F.lit("0"))
    nameless = records(spark, [(3, 2, "v", 0, "new")]).withColumn("version_id", F.lit(None).cast("string"))
    found = R.bound(df.unionByName(stale).unionByName(nameless)).select("run_id", "evidence").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 1)]
    assert R.bound(df.where("false")).count() == 0


def test_facts_carry_days_and_modes(spark):
    rows = [
        (1, 1, "v", 0, "1、第十二交易日\n按照甲模式交收，结算机构划付应收的资金；"), (1, 2, "v", 1, "管理人不支付红利，尚未扣除税款。\n管理人支付全部的红利。"),
        (1, 3, "v", 2, "第三条 其他\n管理人支付红利。"), (1, 4, "v", 4, "（2）第2日\n当日为权益登记日"), (1, 5, "v", 6, "管理人支付红利。"), (1, 6, "w", 0, "投资者在第3日支付红利"),
    ]
    found = R.event_facts(records(spark, rows)).collect()
    got = sorted((r["event"], tuple(r["aliases"]), r["mode"], r["day"], r["day_kind"], tuple(r["evidence"])) for r in found)
    assert got == [
        ("划付资金", ("划付资金", "资金划付"), "甲模式", 12, "交易日", (1,)),
        ("支付红利", ("支付红利", "红利支付"), "甲模式", 12, "交易日", (1, 2)),
        ("权益登记", ("权益登记",), None, 2, "日", (4,)),
    ]


def test_source_issues(spark):
    rows = [
        (1, 1, "v", 0, "借：甲\n借：乙"), (1, 2, "v", 1, "贷：丙"), (1, 3, "v", 2, "说明。\n借：甲"), (1, 4, "v", 3, "借: 乙", False), (1, 5, "v", 5, "借：丙\n或者借：丁"),
        (2, 1, "v", 0, "估值全价和估值净价"), (3, 1, "v", 0, "估值全价"), (3, 2, "w", 0, "估值净价", True), (4, 1, "v", 0, "借：甲"), (4, 2, "v", 2, "借：乙"),
    ]
    assert issues(R.source_issues(records(spark, rows))) == [
        (1, "SOURCE_APPLICABILITY_MISMATCH", "warning", (4,), None, None), (1, "SOURCE_JOURNAL_SIDE_ANOMALY", "critical", (3, 4), None, None), (3, "SOURCE_RULE_BASIS_COMPARISON", "warning", (1, 2), None, None),
    ]
    summary = {(r["run_id"], r["version_id"]): (r["scope_evidence"], r["basis"], r["years"]) for r in R.source_summary(records(spark, rows)).collect()}
    assert summary[2, "v"] == ([], ["全价", "净价"], ["2019", "2021"])


def test_answer_issues(spark):
    rows = [(1, 1, "v", 0, "第2日\n甲模式"), (1, 2, "v", 1, "管理人支付红利"), (1, 3, "v", 3, "仅适用于甲"), (1, 4, "v", 4, "借：甲\n借：乙"), (2, 1, "v", 0, "第2日"), (2, 2, "v", 1, "管理人支付红利")]
    text = "支付红利在第3日 E2；乙模式下第5日支付红利。\n~~~\nE4 E3 由此可见所有\n```\n~~~\n第2日支付红利 [E1-E2]\n借：丙\n\n借：丁\n> E3 一律适用\n第9日尚未支付红利 E2\nE3，因此其他同样如此"
    answers = spark.createDataFrame([(1, text), (2, "第4日红利支付，没有引文"), (3, None), (4, "")], "run_id long, text string")
    found = R.answer_issues(answers, records(spark, rows))
    last = text.index("E3，因此")
    assert issues(found) == [(1, "ANSWER_EVENT_DAY_CONFLICT", "critical", (1, 2), 0, text.index("\n")), (1, "ANSWER_SCOPE_EXTENSION_REVIEW", "warning", (3,), last, len(text))]
    assert sorted(map(tuple, R.answer_status(answers, found).collect())) == [(1, "REVIEW_REQUIRED", 2, 1), (2, "NO_STRUCTURAL_FINDING", 0, 0), (3, "NO_STRUCTURAL_FINDING", 0, 0), (4, "NO_STRUCTURAL_FINDING", 0, 0)]
    sided = spark.createDataFrame([(1, "借：甲\n借：乙\n结束 E4"), (2, "```\n借：甲\n说明。\n借：乙\n```")], "run_id long, text string")
    assert [i[:2] + i[3:] for i in issues(R.answer_issues(sided, records(spark, rows)))] == [(1, "ANSWER_JOURNAL_SIDE_ANOMALY", (), 0, 7), (1, "SOURCE_JOURNAL_SIDE_ANOMALY", (4,), None, None), (2, "ANSWER_JOURNAL_SIDE_ANOMALY", (), 4, 15)]
