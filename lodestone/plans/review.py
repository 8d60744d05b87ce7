"""Review queries: every order is a run that reads four blocks of its customer's rules and gives an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import review as R
from lodestone.plans.registry import query
from lodestone.session import spread, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day heading and event in blocks 0 and 1, bookings (one-sided for every fourth order) in 2, a scope and a price basis in 5; block 5 is stale for every ninth order."""
    k = F.col("o_orderkey")
    day = (1 + k % 5).cast("string")
    texts = [
        F.concat(F.lit("（一）第"), F.element_at(F.array(*map(F.lit, "一二三四五")), (1 + k % 5).cast("int")), F.lit("个工作日")),
        F.lit("采用甲模式，管理人支付本期的赎回款。"),
        F.concat(F.lit("借：银行存款\n"), F.when(k % 4 == 0, "借：应收款").otherwise("贷：应收款")),
        F.concat(F.lit("仅限于本产品，估值"), F.when(k % 2 == 0, "全价").otherwise("净价"), F.lit("，第"), day, F.lit("个工作日不支付赎回款。")),
    ]
    rows = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey").withColumn("b", F.explode(F.array(*(F.struct(F.lit(n + 1).alias("evidence"), F.lit(o).alias("ordinal"), t.alias("text")) for n, (o, t) in enumerate(zip((0, 1, 2, 5), texts))))))
    sha = F.when((F.col("b.evidence") == 4) & (k % 9 == 0), "stale").otherwise(F.sha2("b.text", 256))
    version = F.col("o_custkey") * 2 + (F.col("b.evidence") == 4).cast("int")
    return rows.select(k.alias("run_id"), F.col("b.evidence").alias("evidence"), F.col("o_custkey").alias("resource_id"), version.alias("version_id"), F.col("b.ordinal").alias("block_id"), F.col("b.ordinal").alias("ordinal"), F.col("b.text").alias("text"), sha.alias("content_sha256"), (k % 7 != 0).alias("applies"), F.lit("规则（2024）").alias("title"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lines = [
        F.concat(F.lit("管理人支付赎回款在第"), (1 + k % 3).cast("string"), F.lit("个工作日 [E1] E2；其他。")), F.lit("> 引文 E4 由此可见所有产品"),
        F.when(k % 2 == 0, "由此可见所有产品 E4").otherwise("E4"), F.lit("```"), F.when(k % 5 == 0, "借：甲\n说明\n借：乙").otherwise("借：甲\n贷：乙"), F.lit("```"),
    ]
    return spread(table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey").select(k.alias("run_id"), F.concat_ws("\n", *lines).alias("text"))


@query("""SELECT o_orderkey AS run_id, o_custkey * 2 AS version_id, '支付赎回款' AS event, '甲模式' AS mode, (1 + o_orderkey % 5)::INTEGER AS day, '个工作日' AS day_kind, 2 AS n_evidence FROM orders""")
def source_event_facts(spark, sf_dir):
    facts = R.event_facts(R.bound(_records(spark, sf_dir)))
    return facts.select("run_id", "version_id", "event", "mode", "day", "day_kind", F.size("evidence").alias("n_evidence"))


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderkey AS k, k % 9 <> 0 AS fresh FROM orders)
SELECT run_id, 'SOURCE_JOURNAL_SIDE_ANOMALY' AS code, 1 AS n, '3' AS evidence FROM o WHERE k % 4 = 0
UNION ALL SELECT run_id, 'SOURCE_APPLICABILITY_MISMATCH', CASE WHEN fresh THEN 2 ELSE 1 END, CASE WHEN fresh THEN '1,2,3,4' ELSE '1,2,3' END FROM o WHERE k % 7 = 0""")
def source_review(spark, sf_dir):
    issues = R.source_issues(R.bound(_records(spark, sf_dir)))
    return issues.groupBy("run_id", "code").agg(F.count("*").cast("int").alias("n"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence")))), ",").alias("evidence"))


@query("""WITH o AS (SELECT o_orderkey AS k, k % 9 <> 0 AS fresh FROM orders)
SELECT k AS run_id, 'ANSWER_EVENT_DAY_CONFLICT' AS code, 0 AS start, '1,2' AS evidence FROM o WHERE k % 5 <> k % 3
UNION ALL SELECT k, 'ANSWER_SCOPE_EXTENSION_REVIEW', length('管理人支付赎回款在第1个工作日 [E1] E2；其他。') + length('> 引文 E4 由此可见所有产品') + 2, '4' FROM o WHERE k % 2 = 0 AND fresh
UNION ALL SELECT k, 'ANSWER_JOURNAL_SIDE_ANOMALY', length('管理人支付赎回款在第1个工作日 [E1] E2；其他。') + length('> 引文 E4 由此可见所有产品') + 6 + CASE WHEN k % 2 = 0 THEN length('由此可见所有产品 E4') ELSE 2 END + 1, '' FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 'SOURCE_APPLICABILITY_MISMATCH', NULL, '1,2,3' FROM o WHERE k % 7 = 0
UNION ALL SELECT k, 'SOURCE_APPLICABILITY_MISMATCH', NULL, '4' FROM o WHERE k % 7 = 0 AND fresh""")
def answer_review(spark, sf_dir):
    issues = R.answer_issues(_answers(spark, sf_dir), R.bound(_records(spark, sf_dir)))
    return issues.select("run_id", "code", "start", F.array_join("evidence", ",").alias("evidence"))


@query("""WITH o AS (SELECT o_orderkey AS k, k % 9 <> 0 AS fresh FROM orders),
n AS (SELECT k AS run_id, (k % 5 <> k % 3)::INT + (k % 5 = 0)::INT AS critical_count, (k % 2 = 0 AND fresh)::INT + CASE WHEN k % 7 = 0 THEN 1 + fresh::INT ELSE 0 END AS other FROM o)
SELECT run_id, CASE WHEN critical_count + other > 0 THEN 'REVIEW_REQUIRED' ELSE 'NO_STRUCTURAL_FINDING' END AS status, (critical_count + other)::BIGINT AS issue_count, critical_count::BIGINT AS critical_count FROM n""")
def answer_status(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return R.answer_status(answers, R.answer_issues(answers, R.bound(_records(spark, sf_dir))))
