"""References inside regulations, and what is read with a section of them; every part has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import associations as A, reads as R
from lodestone.plans.registry import query
from lodestone.session import spread, table


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chapters with an article of the same number each, of two items; every third part's last line misses its article."""
    n = F.col("p_size").cast("string")
    lines = [
        F.lit("第一章 总则"), F.concat(F.lit("第"), n, F.lit("条 目的")), F.lit("一、甲"), F.concat(F.lit("二、见第二章第"), n, F.lit("条第1项")),
        F.lit("第二章 附则"), F.concat(F.lit("第"), n, F.lit("条 其他，依照第一章第"), n, F.lit("条第二款和《"), F.col("p_brand"), F.lit("》第九条")), F.lit("1. x"), F.concat(F.lit("2. 按第"), (F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("条，见附件"), n),
    ]
    parts = spread(table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


@query("""SELECT p_partkey AS doc_id, line, kind, CASE kind WHEN 'external' THEN p_brand WHEN 'annex' THEN '附件' || p_size ELSE '' END AS title,
  CASE WHEN kind <> 'path' THEN 'EXTERNAL' WHEN line = 7 AND p_partkey % 3 = 0 THEN 'UNRESOLVED' ELSE state END AS status, CASE WHEN line = 7 AND p_partkey % 3 = 0 THEN NULL ELSE target END AS target
FROM part, (VALUES (3, 'path', 'RESOLVED', 7), (5, 'path', 'BROADER', 2), (5, 'external', '', NULL), (7, 'path', 'RESOLVED', 6), (7, 'annex', '', NULL)) t(line, kind, state, target)""")
def located_references(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    found = A.references(rules, A.section_index(rules))
    return found.select("doc_id", "line", "kind", "title", "status", "target")


# The second item of the first article leads to the second article and back.
@query("SELECT p_partkey AS doc_id, unnest(CASE WHEN p_partkey % 2 = 0 THEN [2, 6] ELSE [1, 6] END) AS section FROM part")
def reading_closure(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    index = A.section_index(rules)
    seeds = rules.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4).otherwise(1).alias("section"))
    return A.reading_closure(index, A.references(rules, index), seeds)


# Nations read the parts of their remainder: every third whole, others around the second item; every fifth lacks a line, of every fourth the first line was seen.
@query("""WITH p AS (SELECT p_partkey AS page, p_partkey % 25 AS q FROM part WHERE p_partkey % 5 <> 0),
b AS (SELECT page, q, unnest(CASE WHEN page % 3 = 0 THEN range(8) ELSE [0, 1, 3] END) AS ordinal FROM p), s AS (SELECT *, page % 4 = 0 AND ordinal = 0 AS seen FROM b)
SELECT q AS query_id, page, ordinal, CASE WHEN seen THEN page ELSE coalesce((SELECT max(p_partkey) FROM part WHERE p_partkey % 25 = q AND p_partkey % 4 = 0), 0) + row_number() OVER (PARTITION BY q, seen ORDER BY page, ordinal) END AS evidence FROM s""")
def scoped_reads(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    page = F.col("doc_id")
    blocks = rules.select(page.alias("page"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).select("page", F.concat_ws("-", "page", "ordinal").alias("block"), "ordinal")
    pages = rules.select(page.alias("page"), F.when(page % 5 == 0, 9).otherwise(8).alias("block_count"))
    sections = A.section_index(rules).select(page.alias("page"), "section", F.col("first_line").alias("first"), F.col("last_line").alias("last"))
    requests = rules.select((page % 25).alias("query_id"), page.alias("page"), page.alias("place"), (page % 3 == 0).alias("whole"))
    anchors = requests.select("query_id", "page", F.concat_ws("-", "page", F.lit(3)).alias("block"))
    seen = requests.where("page % 4 = 0").select("query_id", "page", F.concat_ws("-", "page", F.lit(0)).alias("block"), F.col("page").alias("evidence"))
    return R.scoped_read(requests, pages, blocks, sections, anchors, seen).select("query_id", "page", "ordinal", "evidence")


@query("""SELECT c_custkey AS query_id, page, state, sections FROM customer, (VALUES (0, 'a1', 'WHOLE', ''), (0, 'a2', 'LEFT_OUT', ''), (0, 'b', 'WHOLE', ''), (0, 'c', 'WHOLE', ''), (1, 'a1', 'WHOLE', ''), (1, 'a2', 'WHOLE', ''), (1, 'b', 'LEFT_OUT', ''), (1, 'c', 'WHOLE', ''),
  (2, 'a1', 'WHOLE', ''), (2, 'a2', 'WHOLE', ''), (2, 'b', 'PARTIAL', '0'), (2, 'c', 'WHOLE', '')) t(k, page, state, sections) WHERE c_custkey % 3 = k""")
def fitted_requests(spark, sf_dir):
    """Every customer's request chooses from a group of two pages, a page of three sections, and a small one, under 100, 120 or 140 bytes."""
    section = lambda i, size, score: F.struct(F.lit(i).alias("index"), F.lit(size).alias("bytes"), F.lit(score).alias("score"))
    none = F.lit(None).cast("array<struct<index: int, bytes: int, score: double>>")
    pages = [("a", 0, "a1", 1, 40, none), ("a", 0, "a2", 2, 70, none), ("b", 1, "b", 1, 50, F.array(section(0, 20, 2.0), section(1, 20, 1.0), section(2, 10, -1.0))), ("c", 2, "c", 1, 10, none)]
    rows = F.array(*(F.struct(F.lit(r).alias("root"), F.lit(t).alias("tier"), F.lit(p).alias("page"), F.lit(o).alias("place"), F.lit(n).alias("bytes"), s.alias("sections")) for r, t, p, o, n, s in pages))
    customer = table(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "query_id")
    members = customer.select("query_id", F.explode(rows).alias("m")).select("query_id", "m.*", F.lit(False).alias("asked"), F.lit(1).alias("rank"), F.lit(True).alias("reducible"))
    found = R.fit_request(members, customer.select("query_id", (100 + 20 * (F.col("query_id") % 3)).alias("budget")))
    return found.select("query_id", "page", "state", F.array_join("sections", ",").alias("sections"))
