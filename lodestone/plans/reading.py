"""Reading queries: terms of documents and questions, order and coverage of what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.operators import reading as R
from lodestone.plans.registry import query
from lodestone.session import table


def _terms(stops: tuple[str, ...], source: str, key: str, least: int = 1, numbers: bool = True) -> str:
    """SQL of terms; these tables have no CJK text, so stop phrases and pairs are left out. Words are marked, then stop words fall."""
    words = "|".join(w.replace("*", r"[\p{L}\p{N}_]*") for w in stops)
    marked = r"regexp_replace(translate(replace(lower(coalesce(text, '')), 'ß', 'ss'), '<>', '  '), '([\p{L}\p{N}_]+)', '<\1>', 'g')"
    kept = f"regexp_replace(regexp_replace({marked}, '<(?:{words})>', ' ', 'g'), '[<>]', '', 'g')"
    terms = f"list_distinct(regexp_extract_all({kept}, '[a-z0-9]+(?:[._/-][a-z0-9]+)*'))"
    number = "" if numbers else " AND NOT regexp_full_match(x, '[0-9]+')"
    return f"SELECT {key}, array_to_string(list_sort(list_filter({terms}, lambda x: len(x) >= {least}{number})), ' ') AS terms FROM {source}"


@query(_terms(K.DISCOVERY_STOP_WORDS, "documents", "doc_id"))
def graph_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(R.graph_terms("text"), " ").alias("terms"))


@query(_terms((*K.DISCOVERY_STOP_WORDS, *K.ACTION_WORDS), "benchmark", "item_id", 2, numbers=False))
def subject_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.array_join(R.subject_terms("text"), " ").alias("terms"))


@query(_terms(K.ROUTER_STOP_WORDS, "documents", "doc_id", 2))
def router_features(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(R.router_features("text"), " ").alias("terms"))


# Every third order is read for one question; an order needs the one of a quarter of its number.
@query("""WITH RECURSIVE p AS (SELECT o_orderkey % 3 AS query_id, o_orderkey AS page, o_orderkey % 101 AS place, o_orderkey % 17 AS score FROM orders),
e AS (SELECT a.query_id, a.page AS src, b.page AS dst FROM p a JOIN p b ON b.query_id = a.query_id AND b.page = a.page // 4 AND a.page > 0),
r(query_id, root, page) AS (SELECT query_id, page, page FROM p UNION SELECT r.query_id, root, dst FROM r JOIN e ON src = page AND e.query_id = r.query_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, page) AS at FROM p),
f AS (SELECT r.query_id, r.page, min((o.at, CASE WHEN r.root = r.page THEN 0 ELSE 1 END, p.place, p.page)) AS first FROM r JOIN o ON o.query_id = r.query_id AND o.page = r.root JOIN p ON p.query_id = r.query_id AND p.page = r.page GROUP BY ALL)
SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM f""")
def context_order(spark, sf_dir):
    k = F.col("o_orderkey")
    place = F.struct((k % 101).alias("a"), k.alias("b"))
    pages = table(spark, sf_dir, "orders", "o_orderkey").select((k % 3).alias("query_id"), k.alias("page"), place.alias("place"), (k % 17).alias("score"))
    edges = pages.where("page > 0").select(F.col("page").alias("src"), F.floor(F.col("page") / 4).alias("dst"))
    return R.context_order(pages, edges)


_EVIDENCE = """v AS (SELECT l_orderkey // 8 AS query_id, l_orderkey AS group_id, l_linenumber AS block, l_suppkey AS version, l_linenumber + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END AS needs,
  l_quantity > 1 AS whole, CASE WHEN l_partkey % 2 = 0 THEN 'AIR' ELSE 'RAIL' END AS dimension, l_returnflag AS f1, l_linestatus AS f2 FROM lineitem)"""


@query(f"""WITH {_EVIDENCE}, g AS (SELECT query_id, group_id, bool_and(whole) AND len(list_filter(list_distinct(flatten(list([block, needs]))), lambda x: NOT list_contains(list(block), x))) = 0 AS ok, list(DISTINCT dimension) AS d, list(f1) || list(f2) AS f FROM v GROUP BY ALL),
q AS (SELECT query_id, list_distinct(flatten(list(d) FILTER (ok))) AS named, list_distinct(flatten(list(f) FILTER (ok))) AS facets, count(*) FILTER (NOT ok) AS broken FROM g GROUP BY query_id),
s AS (SELECT query_id, bool_or(version = query_id % 50) AS has FROM v GROUP BY query_id),
c AS (SELECT q.*, has, CASE WHEN query_id % 2 = 1 THEN coalesce(named, []) ELSE list_filter(['done', 'open'], lambda x: CASE x WHEN 'done' THEN list_has_all(coalesce(facets, []), ['R', 'F']) ELSE list_has_all(coalesce(facets, []), ['O']) END) END AS covered FROM q JOIN s USING (query_id)),
m AS (SELECT *, len(list_filter(CASE WHEN query_id % 2 = 1 THEN ['AIR', 'RAIL'] ELSE ['done', 'open'] END, lambda x: NOT list_contains(covered, x))) AS missing FROM c)
SELECT query_id, CASE WHEN len(coalesce(facets, [])) = 0 AND len(covered) = 0 THEN 'EMPTY' WHEN len(covered) > 0 AND missing = 0 AND broken = 0 AND has THEN 'COMPLETE' ELSE 'PARTIAL' END AS status,
  array_to_string(list_sort(covered), ',') AS covered, missing AS n_missing, broken AS n_incomplete, len(covered) > 0 AND has AS ready FROM m""")
def evidence_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    q = F.floor(F.col("l_orderkey") / 8)
    text = lambda c: F.col(c).cast("string")
    also = F.when(F.col("l_partkey") % 9 == 0, (F.col("l_linenumber") + 1).cast("string")).otherwise(text("l_linenumber"))
    evidence = items.select(
        q.alias("query_id"), F.col("l_orderkey").alias("group_id"), text("l_linenumber").alias("block"), F.col("l_suppkey").alias("version"), F.array(text("l_linenumber"), also).alias("expected"),
        (F.col("l_quantity") > 1).alias("whole"), F.array(F.when(F.col("l_partkey") % 2 == 0, "AIR").otherwise("RAIL")).alias("dimensions"), F.array("l_returnflag", "l_linestatus").alias("facets"),
    )
    asked = evidence.select("query_id").distinct()
    odd = F.col("query_id") % 2 == 1
    dimensions = F.when(odd, F.array(F.lit("AIR"), F.lit("RAIL"))).otherwise(F.array(F.lit("done"), F.lit("open")))
    plans = asked.select("query_id", dimensions.alias("dimensions"), (F.col("query_id") % 50).alias("primary"), F.lit(False).alias("detail_gap"))
    needs = F.explode(F.array(F.struct(F.lit("done").alias("dimension"), F.array(F.lit("R"), F.lit("F")).alias("facets")), F.struct(F.lit("open").alias("dimension"), F.array(F.lit("O")).alias("facets"))))
    requirements = asked.where(~odd).select("query_id", needs.alias("n")).select("query_id", "n.*")
    found = R.coverage(plans, evidence, requirements)
    return found.select("query_id", "status", F.array_join("covered", ",").alias("covered"), F.size("missing").cast("long").alias("n_missing"), F.size("incomplete_groups").cast("long").alias("n_incomplete"), "ready")


@query("""WITH w AS (SELECT vec_id % 40 AS k, 1 + vec_id % 7 AS w, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT k, w, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM w),
m AS (SELECT k, i, sum(w * x) / sum(w) AS x FROM x GROUP BY ALL), n AS (SELECT k, sqrt(sum(x * x)) AS size FROM m GROUP BY k) SELECT k, i, round(x / size, 6) AS x FROM m JOIN n USING (k)""")
def pooled_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("k"), (1 + F.col("vec_id") % 7).alias("weight"), F.col("embedding").alias("vector"))
    return R.pooled(rows, "k").select("k", F.posexplode("vector").alias("i", "x")).select("k", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(lang, '') || chr(10) || coalesce(text, '')), 'then') OR (doc_id % 5 = 0 AND contains(lower(source), 'then')) OR doc_id % 11 = 3")
def page_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    pages = docs.select("doc_id", F.col("lang").alias("name"), F.col("text").alias("title"), F.lit(None).cast("string").alias("text"))
    aliases = docs.where("doc_id % 5 = 0").select("doc_id", F.col("source").alias("alias")).unionByName(docs.where("doc_id % 11 = 3").select("doc_id", F.lit("Known as THEN, too").alias("alias")))
    return R.page_match(pages, aliases, F.lit(" THEN "), "doc_id").select("doc_id")


# A question of four words in three facets; part n matches those that the bits of its size name.
@query("""WITH p AS (SELECT p_partkey AS page, p_size % 16 AS b FROM part), m AS (SELECT *, (b & 1) * 1e0 + (b >> 1 & 1) * 2e0 + (b >> 2 & 1) * 3e0 + (b >> 3 & 1) * 4e0 AS mass, (b & 1) + (b >> 1 & 1) + (b >> 2 & 1) + (b >> 3 & 1) AS n FROM p)
SELECT page, b > 0 AND (b & 4 > 0 OR b & 8 > 0 OR b & 3 = 3 OR (n >= 2 AND mass >= 2) OR (n = 1 AND mass >= 3)) AS strong, (CASE WHEN b & 2 > 0 THEN 1 ELSE 0 END + (b >> 2 & 1) + (b >> 3 & 1))::INTEGER AS n_facets FROM m""")
def strong_pages(spark, sf_dir):
    words = ("alpha", "beta", "gamma", "delta")
    question = spark.createDataFrame([("Alpha beta, gamma and delta",)], "question string").select(F.lower("question").alias("question"), R.subject_terms("question").alias("subject"), R.question_facets("question").alias("facets"))
    bits = F.array_compact(F.array(*(F.when(F.col("p_size").bitwiseAND(F.lit(1 << n)) > 0, F.lit(w)) for n, w in enumerate(words))))
    masses = F.create_map(*(x for n, w in enumerate(words) for x in (F.lit(w), F.lit(n + 1.0))))
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("page"), bits.alias("matched")).crossJoin(F.broadcast(question))
    return rows.select("page", R.strong(F.col("matched"), F.col("subject"), F.col("question"), masses, F.col("facets")).alias("strong"), R.covered_facets(F.col("matched"), F.col("facets"), masses).alias("n_facets"))
