"""Reading plans: parts are pages, every third a document; line items are links to the page of their supplier's number; nations ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import planning as P
from lodestone.plans.registry import query
from lodestone.session import materialise, table


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """pages, links, anchors, eligible."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part", "p_partkey")
    pages = part.select(k.alias("page"), F.when(k % 3 == 0, "document").otherwise("knowledge").alias("kind"), F.when(k % 17 == 0, k - 1).alias("canonical"))
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumn("edge", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    kind = F.when(F.col("l_linenumber") == 1, "CITES").when(F.col("l_linenumber") == 2, "REQUIRES").when(F.col("l_linenumber") == 7, "EXCEPTION_OF").otherwise("MENTIONS")
    edges = items.select("edge", F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("type"), (F.col("l_quantity") == 7).alias("proposed"))
    anchors = items.select("edge", F.col("l_suppkey").alias("page"), F.concat(F.lit("b"), F.col("l_orderkey") % 50).alias("block"))
    eligible = part.select((k % 25).alias("query_id"), k.alias("page"), F.lit(None).cast("int").alias("rank"), (k % 2 == 0).alias("strong"))
    return pages, edges, anchors, eligible


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation", "n_nationkey").select(n.alias("query_id"), (3 * (n + 1)).alias("page"), F.array(F.concat(F.lit("b"), n), F.concat(F.lit("b"), n + 25)).alias("blocks"))


_WORLD = """p AS (SELECT p_partkey AS page, p_partkey % 3 = 0 AS document FROM part),
e AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS edge, l_partkey AS source, l_suppkey AS target, CASE l_linenumber WHEN 1 THEN 'CITES' WHEN 2 THEN 'REQUIRES' ELSE 'EXCEPTION_OF' END AS type, l_quantity = 7 AS proposed, 'b' || (l_orderkey % 50) AS block
  FROM lineitem WHERE l_linenumber IN (1, 2, 7) AND l_partkey IN (SELECT page FROM p) AND l_suppkey IN (SELECT page FROM p)),
s AS (SELECT n_nationkey::BIGINT AS q, 3 * (n_nationkey::BIGINT + 1) AS page, unnest(['b' || n_nationkey, 'b' || (n_nationkey + 25)]) AS block FROM nation),
c AS (SELECT e.* FROM e JOIN p ON p.page = source WHERE type = 'CITES' AND NOT proposed AND NOT document),
f AS (SELECT target, block, count(DISTINCT source) AS n FROM c GROUP BY ALL),
b AS (SELECT DISTINCT s.q, c.edge, c.source, c.target FROM s JOIN c ON c.target = s.page AND c.block = s.block JOIN f ON f.target = c.target AND f.block = c.block WHERE f.n <= 2 OR (c.source % 25 = s.q AND c.source % 2 = 0)),
r(q, page) AS (
  SELECT q, page FROM s UNION (
    SELECT r.q, e.target FROM r JOIN e ON e.source = r.page WHERE NOT proposed OR e.target % 25 = r.q
    UNION SELECT r.q, e.source FROM r JOIN e ON e.target = r.page AND type = 'EXCEPTION_OF' WHERE NOT proposed OR e.source % 25 = r.q
    UNION SELECT r.q, b.source FROM r JOIN b ON b.target = r.page AND b.q = r.q
    UNION SELECT r.q, r.page - 1 FROM r JOIN p ON p.page = r.page - 1 WHERE r.page % 17 = 0))"""


@query(f"""WITH RECURSIVE {_WORLD},
u AS (
  SELECT r.q, e.edge, e.target, e.block FROM r JOIN e ON e.source = r.page WHERE NOT proposed OR e.target % 25 = r.q
  UNION SELECT r.q, e.edge, e.target, e.block FROM r JOIN e ON e.target = r.page AND type = 'EXCEPTION_OF' WHERE NOT proposed OR e.source % 25 = r.q
  UNION SELECT b.q, e.edge, e.target, e.block FROM b JOIN e USING (edge)),
x AS (SELECT q, target AS page, block FROM u UNION SELECT q, page, block FROM s)
SELECT r.q AS query_id, r.page, count(x.block) AS n_blocks FROM r LEFT JOIN x ON x.q = r.q AND x.page = r.page GROUP BY ALL""")
def reading_plan(spark, sf_dir):
    reads, _ = P.expand(_seeds(spark, sf_dir), *_world(spark, sf_dir), selective=True)
    return reads.select("query_id", "page", F.size("blocks").cast("long").alias("n_blocks"))


@query()
def evidence_plan(spark, sf_dir):
    """Units of a question: its nation's customers, each a place in the page of its number; every segment is a search."""
    pages, edges, anchors, eligible = _world(spark, sf_dir)
    k = F.col("c_custkey")
    units = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), k.cast("string").alias("unit"), k.alias("page"), (k % 4).cast("string").alias("section"), F.array(F.concat(F.lit("b"), k % 50)).alias("blocks"), F.col("c_acctbal").alias("score"), F.when(k % 2 == 0, F.col("c_acctbal")).alias("rerank"), F.col("c_mktsegment").alias("search"))
    searches = units.select("query_id", "search", "unit", F.row_number().over(P.Window.partitionBy("query_id", "search").orderBy(F.col("score").desc(), "unit")).alias("rank"))
    seeds = materialise(P.unit_seeds(units.drop("search"), searches, pages, edges, anchors), "seeds")
    reads, links = P.expand(seeds, pages, edges, anchors, eligible, spelled=False)
    queries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"))
    return P.plan_warnings(queries, reads, links, pages, edges, seeds, searches).select("query_id", F.array_join("warnings", ",").alias("warnings"), "sources", "wikis", "by_links", "missed")


@query("""WITH c AS (SELECT c_nationkey AS q, c_custkey AS page, c_acctbal AS x, c_mktsegment AS s FROM customer), b AS (SELECT q, s, max(x) AS x FROM c GROUP BY ALL),
f AS (SELECT c.q, c.s, min(page) AS page FROM c JOIN b ON b.q = c.q AND b.s = c.s AND b.x = c.x GROUP BY ALL)
SELECT q::BIGINT AS query_id, page FROM f""")
def relevance_seed_cover(spark, sf_dir):
    """Each segment is a term; of those that hold it a nation's question takes the customer of the largest balance."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("page"), F.lit("wiki").alias("role"), (F.col("c_acctbal") + 1e6).alias("relevance"), F.lit(0.0).alias("hit"), F.lit(0).alias("channels"), F.lit(True).alias("strong"), F.array("c_mktsegment").alias("terms"))
    terms = rows.select("query_id", F.explode("terms").alias("term")).distinct().withColumn("mass", F.lit(1.0))
    return P.relevance_seeds(rows, terms).select("query_id", "page")
