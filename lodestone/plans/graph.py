"""Graph queries: parts cite suppliers, pages link to pages, numbers point to halves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import graph as G
from lodestone.plans.registry import query
from lodestone.session import table

_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 100000 AS dst FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey")
    return rows.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst")).distinct()


@query("SELECT l_partkey AS src, l_suppkey + 100000 AS dst, CASE WHEN l_returnflag = 'R' THEN 'CITES' ELSE 'REQUIRES' END AS type, count(DISTINCT l_linenumber) AS n_anchors FROM lineitem GROUP BY ALL")
def edge_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst"), "l_returnflag", F.col("l_linenumber").alias("anchor"), F.lit("relation").alias("origin"))
    cites = rows.where("l_returnflag = 'R'").drop("l_returnflag").withColumn("type", F.lit("CITES"))
    needs = rows.where("l_returnflag <> 'R'").drop("l_returnflag").withColumn("type", F.lit("REQUIRES"))
    return G.assemble(cites, needs).select("src", "dst", "type", F.size("anchors").cast("long").alias("n_anchors"))


@query(f"WITH {_EDGES}, o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (node)")
def backlink_degrees(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE src % 3 = 0 AND dst % 2 = 0")
def induced_subgraph(spark, sf_dir):
    """Parts and suppliers are nodes of two kinds; their numbers overlap once there are more than 100 000 parts."""
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    edges = _edges(spark, sf_dir).select(node("part", "src").alias("src"), node("supplier", "dst").alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).where("node.key % 3 = 0").unionByName(edges.select(F.col("dst").alias("node")).where("node.key % 2 = 0")).distinct()
    return G.induced(edges, nodes).select(F.col("src.key").alias("src"), F.col("dst.key").alias("dst"))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN b ON src = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def bfs_depth3(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst"))
    return G.reach(edges, spark.range(1, 2).withColumnRenamed("id", "node"), 3, undirected=True)


_HALF = "h AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1)"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))


@query(f"""WITH RECURSIVE {_HALF}, r(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 10 = 7 UNION SELECT root, dst, depth + 1 FROM r JOIN h ON src = node WHERE depth < 8)
SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL""")
def dependency_closure(spark, sf_dir):
    seeds = table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 10 = 7").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("node"))
    return G.reach(_halves(spark, sf_dir), seeds, 8, keep_root=True)


@query(f"""WITH RECURSIVE {_HALF}, r(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT src, depth + 1 FROM r JOIN h ON dst = node WHERE depth < 9) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def invalidation_closure(spark, sf_dir):
    back = _halves(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reach(back, spark.range(3, 4).withColumnRenamed("id", "node"), 9)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey IN (10, 20) THEN 30 - p_partkey WHEN p_partkey % 16 > 0 THEN p_partkey - 1 END AS target FROM part),
r(node, cur, n) AS (SELECT node, node, 0 FROM p UNION ALL SELECT r.node, p.target, n + 1 FROM r JOIN p ON p.node = r.cur WHERE p.target IS NOT NULL AND n < 60)
SELECT node, coalesce(max(CASE WHEN n < 60 AND cur IN (SELECT node FROM p WHERE target IS NULL) THEN cur END), -1) AS root FROM r GROUP BY node""")
def canonical_root(spark, sf_dir):
    key = F.col("p_partkey")
    target = F.when(key.isin(10, 20), F.lit(30) - key).when(key % 16 > 0, key - 1)
    return G.roots(table(spark, sf_dir, "part", "p_partkey").select(key.alias("node"), target.cast("long").alias("target"))).na.fill(-1)


@query(f"""WITH RECURSIVE {_HALF}, f AS (SELECT * FROM h WHERE src % 7 <> 0), r(root, node, n) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT root, dst, n + 1 FROM r JOIN f ON src = node WHERE n < 20)
SELECT root, node FROM r WHERE node NOT IN (SELECT src FROM f)""")
def successor_leaves(spark, sf_dir):
    seeds = table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("node"))
    return G.leaves(_halves(spark, sf_dir).where("src % 7 <> 0"), seeds, 20)


@query("SELECT p_partkey AS step FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey // 2) % 3 = 0 AND (p_partkey // 3) % 3 = 0 AND p_partkey // 3 > 0 AND p_partkey > 1")
def dag_ready_steps(spark, sf_dir):
    key = F.col("p_partkey")
    steps = table(spark, sf_dir, "part", "p_partkey").where("p_partkey > 2").select(key.alias("step"), F.array(F.floor(key / 2), F.floor(key / 3)).alias("depends_on"))
    return G.ready(steps, steps.select("step").where("step % 3 = 0")).select("step")


@query("WITH RECURSIVE p AS (SELECT p_partkey AS node FROM part), r(node, level) AS (SELECT node, 0 FROM p WHERE node <= 1 UNION ALL SELECT p.node, level + 1 FROM r JOIN p ON p.node // 2 = r.node WHERE p.node > 1) SELECT node, level FROM r")
def dag_levels(spark, sf_dir):
    nodes = table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("node"))
    edges = _halves(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.dag_levels(nodes, edges)


_RANGES = "s AS (SELECT doc_id AS doc, k AS section, (k * 3) % 20 AS start, (k * 3) % 20 + k * 4 AS \"end\" FROM documents, (SELECT unnest(range(1, 9)) AS k)), a AS (SELECT doc_id AS doc, (doc_id * 7) % 25 AS pos FROM documents)"


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id")
    ranges = docs.select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("section"))
    ranges = ranges.select("doc", "section", ((F.col("section") * 3) % 20).alias("start"), ((F.col("section") * 3) % 20 + F.col("section") * 4).alias("end"))
    return ranges, docs.select(F.col("doc_id").alias("doc"), ((F.col("doc_id") * 7) % 25).alias("at"))


@query(f'WITH {_RANGES} SELECT doc, pos, section FROM (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY "end" - start, start, section) AS n FROM a JOIN s USING (doc) WHERE start <= pos AND pos <= "end") WHERE n = 1')
def minimal_sections(spark, sf_dir):
    return G.minimal_ranges(*_ranges(spark, sf_dir)).select("doc", F.col("at").alias("pos"), F.col("section").cast("long").alias("section"))


@query(f'WITH {_RANGES} SELECT doc, section FROM (SELECT *, max("end") OVER (PARTITION BY doc ORDER BY start, "end" DESC, section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM s) WHERE c IS NULL OR "end" > c')
def outermost_sections(spark, sf_dir):
    return G.outermost(_ranges(spark, sf_dir)[0]).select("doc", F.col("section").cast("long").alias("section"))


_STAMP = "n AS (SELECT p_partkey AS node, p_name AS own FROM part)"


@query(f"""WITH {_STAMP}, a AS (SELECT node, sha256(own) AS stamp FROM n),
b AS (SELECT n.node, sha256(n.own || coalesce(string_agg(a.stamp, '' ORDER BY a.stamp), '')) AS stamp FROM n LEFT JOIN a ON a.node // 2 = n.node AND a.node > 1 GROUP BY n.node, n.own),
c AS (SELECT n.node, sha256(n.own || coalesce(string_agg(b.stamp, '' ORDER BY b.stamp), '')) AS stamp FROM n LEFT JOIN b ON b.node // 2 = n.node AND b.node > 1 GROUP BY n.node, n.own) SELECT node, stamp FROM c""")
def merkle_stamp(spark, sf_dir):
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("own"))
    edges = nodes.where("node > 1").select(F.floor(F.col("node") / 2).alias("src"), F.col("node").alias("dst"))
    return G.stamps(nodes, edges, 2)


_HREFS = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@query(f"WITH {_HREFS} SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM l GROUP BY page_id")
def html_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"))


@query(f"WITH {_HREFS} SELECT href AS name, count(DISTINCT page_id) AS n_pages, count(DISTINCT page_id) = 1 AS resolved FROM l GROUP BY href")
def link_resolution(spark, sf_dir):
    links = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("name"))
    return links.groupBy("name").agg(F.countDistinct("page_id").alias("n_pages")).withColumn("resolved", F.col("n_pages") == 1)
