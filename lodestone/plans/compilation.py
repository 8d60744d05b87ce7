"""Compilation queries: orders are pages, line items are blocks of batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import compilation as C
from lodestone.plans.registry import query
from lodestone.session import table

_BLOCKS = """b AS (SELECT l_orderkey AS page, l_linenumber // 3 AS batch, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS position, l_returnflag AS section, l_suppkey % 4 AS k,
  CASE l_partkey % 5 WHEN 0 THEN 'GAP' WHEN 1 THEN 'NOT_APPLICABLE' ELSE 'SUPPORTED' END AS status, [l_partkey % 3, l_suppkey % 3] AS evidence FROM lineitem)"""


@query(f"""WITH {_BLOCKS}, s AS (SELECT page, section, k, min(position) AS pos, list(evidence ORDER BY position) AS e FROM b WHERE status = 'SUPPORTED' GROUP BY ALL),
f AS (SELECT page, section, k, position AS pos, evidence, status FROM (SELECT *, row_number() OVER (PARTITION BY page, section ORDER BY CASE status WHEN 'NOT_APPLICABLE' THEN 0 ELSE 1 END, position) AS n FROM b WHERE status <> 'SUPPORTED') WHERE n = 1 AND (page, section) NOT IN (SELECT page, section FROM s)),
u AS (SELECT page, section, k, pos, len(list_distinct(flatten(e))) AS n_evidence, 'SUPPORTED' AS status FROM s UNION ALL SELECT page, section, k, pos, 2, status FROM f)
SELECT page, section, row_number() OVER (PARTITION BY page, section ORDER BY pos) AS rank, status, n_evidence,
  CASE WHEN row_number() OVER (PARTITION BY page, section ORDER BY pos) > 1 THEN 'text ' || k ELSE '# Head' || chr(10) || 'text ' || k END AS markdown FROM u""")
def batch_page_merge(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_partkey") % 5 == 0, "GAP").when(F.col("l_partkey") % 5 == 1, "NOT_APPLICABLE").otherwise("SUPPORTED")
    blocks = items.select(
        F.col("l_orderkey").alias("page"), F.floor(F.col("l_linenumber") / 3).alias("batch"), (F.col("l_linenumber") * F.lit(1000000000000) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("position"), F.col("l_returnflag").alias("section"),
        F.concat(F.lit("# Head\ntext "), F.col("l_suppkey") % 4).alias("markdown"), status.alias("status"), F.array(F.col("l_partkey") % 3, F.col("l_suppkey") % 3).alias("evidence"),
    )
    n = F.when(F.col("status") == "SUPPORTED", F.size("evidence")).otherwise(2)
    return C.merged_blocks(blocks).select("page", "section", "rank", "status", n.cast("long").alias("n_evidence"), "markdown")


@query("""WITH r AS (SELECT l_orderkey AS page, CASE WHEN l_partkey % 3 = 0 THEN 'main' ELSE 'p' || l_partkey % 5 END AS source, CASE WHEN l_suppkey % 4 = 0 THEN 'main' ELSE 'p' || l_suppkey % 5 END AS target, l_returnflag AS type, l_linenumber AS e FROM lineitem)
SELECT page, source, target, type, string_agg(DISTINCT e::VARCHAR, ',' ORDER BY e::VARCHAR) AS evidence FROM r WHERE source <> target GROUP BY ALL""")
def batch_relation_merge(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    other = lambda c: F.concat(F.lit("p"), F.col(c) % 5)
    alias = F.when(F.col("l_linenumber") % 2 == 0, "main").otherwise("late")  # the title of the second batch
    rows = items.select(
        F.col("l_orderkey").alias("page"), F.lit(1).alias("batch"), F.col("l_linenumber").alias("position"), F.when(F.col("l_partkey") % 3 == 0, alias).otherwise(other("l_partkey")).alias("source"),
        F.when(F.col("l_suppkey") % 4 == 0, "main").otherwise(other("l_suppkey")).alias("target"), F.col("l_returnflag").alias("type"), F.array(F.col("l_linenumber").cast("string")).alias("evidence"),
    )
    titles = items.select(F.col("l_orderkey").alias("page")).distinct().select("page", F.explode(F.array(F.struct(F.lit(1).alias("batch"), F.lit("main").alias("title")), F.struct(F.lit(2).alias("batch"), F.lit("late").alias("title")))).alias("t")).select("page", "t.*")
    return C.merged_relations(rows, titles).withColumn("evidence", F.array_join("evidence", ","))


@query("""SELECT l_partkey AS source, l_suppkey AS target, l_returnflag AS type, sum(l_linenumber)::BIGINT AS evidence_count FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE l_linenumber % 3 = p_size % 3 AND l_linenumber % 2 = s_suppkey % 2 GROUP BY ALL""")
def visible_proposals(spark, sf_dir):
    n = F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("type"), n.alias("anchors"), (n % 3).alias("source_version"), F.lit(1).alias("source_epoch"), F.lit("s").alias("source_sha"),
        F.lit(0).alias("target_version"), (n % 2).alias("target_epoch"), F.lit("s").alias("target_sha"),
    )
    items = items.withColumn("target", -F.col("target") - 1)  # suppliers are pages of their own
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size") % 3).alias("version"), F.lit(1).alias("epoch"), F.lit("s").alias("sha"))
    pages = pages.unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("page"), F.lit(0).alias("version"), (F.col("s_suppkey") % 2).cast("int").alias("epoch"), F.lit("s").alias("sha")))
    return C.visible_proposals(items, pages).withColumn("target", -F.col("target") - 1)


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END, s_nationkey, s_suppkey) AS place FROM supplier")
def capability_list(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("name"), (F.col("s_suppkey") % 4 == 0).alias("structured"))
    return C.capabilities(rows).select("id", "place")
