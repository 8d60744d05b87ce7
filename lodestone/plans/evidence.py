"""Evidence queries. Line items cite parts, orders replace orders, parts are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evidence as E
from lodestone.plans.registry import query
from lodestone.session import table


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 2 = 0")
def signature_fence(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    current = hits.where("l_partkey % 3 = 0 and l_suppkey % 2 = 0").select("l_partkey", "l_suppkey")
    return E.fence(hits, current, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("""WITH h AS (SELECT doc_id % 300 AS hit, doc_id AS block, doc_id % 7 AS s, doc_id % 7 + 1 + doc_id % 50 AS e, doc_id % 31 = 0 AS bad, length(text) AS n FROM documents)
SELECT hit, count(*) AS n_spans FROM h GROUP BY hit HAVING bool_and(NOT bad AND e <= n)""")
def verified_hits(spark, sf_dir):
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sha = F.sha2("text", 256)
    hits = docs.select((k % 300).alias("hit"), k.alias("block"), (k % 7).alias("start"), (k % 7 + 1 + k % 50).alias("end"), F.when(k % 31 == 0, F.lit("stale")).otherwise(sha).alias("content_sha256"))
    return E.verified_hits(hits, docs.select(k.alias("block"), sha.alias("content_sha256"), F.length("text").alias("length")))


@query("SELECT doc_id FROM documents WHERE contains(text, 'tionth') OR contains(text, 'eaux') OR contains(text, 'heit')")
def plan_term_match(spark, sf_dir):
    terms = spark.createDataFrame([("tionth",), ("eaux",), ("heit",)], "term string")
    return E.term_match(table(spark, sf_dir, "documents", "doc_id", "text"), terms, "doc_id", "text")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_name), 'o')) AND contains(lower(p_name), 'e') AND p_size <= 20")
def reading_rules(spark, sf_dir):
    groups = F.array(F.array(F.lit("a"), F.lit("o")), F.array(F.lit("e")))
    return table(spark, sf_dir, "part").where(E.rule_active(groups, F.lower("p_name"), F.col("p_size"), F.lit(20))).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)red|rose') THEN 'law' WHEN regexp_matches(p_name, '(?i)blue|sky') THEN 'rule' ELSE 'other' END AS role FROM part")
def source_role(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", E.class_of(F.col("p_name"), [("(?i)red|rose", "law"), ("(?i)blue|sky", "rule")], "other").alias("role"))


@query("SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT (l_suppkey, l_returnflag)) = 1")
def conflicting_identity(spark, sf_dir):
    return E.single_identity(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


@query("SELECT l_partkey AS block, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 2 = 0 AND l_suppkey IN (SELECT p_partkey FROM part) GROUP BY 1")
def citation_closure(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("block"), F.col("l_suppkey").alias("cited"))
    kept = table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "block")
    return E.closed_pairs(links, kept).select("block", F.size("citations").cast("long").alias("n"))


@query("""WITH l AS (SELECT o_custkey AS src, o_custkey + 1 + o_orderkey % 3 AS dst FROM orders), p AS (SELECT c_custkey AS resource FROM customer WHERE c_custkey % 10 < 6)
SELECT resource FROM p WHERE resource NOT IN (SELECT dst FROM l WHERE src NOT IN (SELECT resource FROM p))""")
def inbound_dependencies(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("dst"))
    resources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource"))
    return E.inbound_free(resources, links, resources.where("resource % 10 < 6"))


@query("""WITH s AS (SELECT o_orderkey AS statement, o_orderkey % 300 AS base, year(o_orderdate) AS y FROM orders), t AS (SELECT p_partkey AS page, p_partkey % 300 AS base, 1995 + p_size % 7 AS of FROM part WHERE p_partkey % 7 <> 0),
j AS (SELECT *, count(*) OVER (PARTITION BY statement) AS n, sum(CASE WHEN of = y THEN 1 ELSE 0 END) OVER (PARTITION BY statement) AS same FROM s JOIN t USING (base)) SELECT statement, page FROM j WHERE n = 1 OR (same = 1 AND of = y)""")
def title_links(spark, sf_dir):
    statements = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("statement"), (F.col("o_orderkey") % 300).alias("base"), F.year("o_orderdate").alias("year"))
    titles = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("page"), (F.col("p_partkey") % 300).alias("base"), (F.lit(1995) + F.col("p_size") % 7).alias("year"))
    return E.title_links(statements, titles)


# Every part is a rule with an edition in two of three cases; every supplier names rules, with an edition in every second.
_TITLES = """t AS (SELECT p_partkey AS page, p_name || CASE WHEN p_size % 3 > 0 THEN ' ' || (2000 + p_size % 3) ELSE '' END AS title, p_name AS base, CASE WHEN p_size % 3 > 0 THEN 2000 + p_size % 3 END AS version FROM part),
own AS (SELECT *, CASE WHEN page % 4 = 0 THEN base || ', as amended' ELSE title END AS own, version AS year FROM t),
n AS (SELECT s_suppkey AS source, p_name AS base, CASE WHEN s_suppkey % 2 = 0 THEN 2001 END AS version, p_name || CASE WHEN s_suppkey % 2 = 0 THEN ' 2001' ELSE '' END AS full, 2000 + s_suppkey % 4 AS year, s_suppkey % 5 = 0 AS partial, 'part ' || s_suppkey AS own_base
  FROM supplier JOIN part ON p_partkey = (s_suppkey * 7) % 150),
m AS (SELECT n.*, own.page, own.base AS of_base, own.year AS of_year FROM n, own WHERE len(n.base) >= 6 AND NOT coalesce(n.version <> own.version, false) AND CASE WHEN n.version IS NOT NULL AND own.version IS NULL THEN n.full = title
  ELSE n.full = title OR n.base = own.base OR (len(n.base) >= 10 AND contains(own, n.base)) END)"""


def _named_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    version = F.when(F.col("p_size") % 3 > 0, F.lit(2000) + F.col("p_size") % 3)
    title = F.concat("p_name", F.coalesce(F.concat(F.lit(" "), version.cast("string")), F.lit("")))
    own = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(", as amended"))).otherwise(title)
    titles = part.select(F.col("p_partkey").alias("page"), title.alias("title"), own.alias("own"), F.col("p_name").alias("base"), version.alias("version"), version.alias("year"))
    k, even = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0
    named = table(spark, sf_dir, "supplier", "s_suppkey").join(part, F.col("p_partkey") == (k * 7) % 150).select(
        k.alias("source"), F.col("p_name").alias("base"), F.when(even, 2001).alias("version"), F.concat("p_name", F.when(even, " 2001").otherwise("")).alias("full"),
        (F.lit(2000) + k % 4).alias("year"), (k % 5 == 0).alias("partial"), F.concat(F.lit("part "), k).alias("own_base"),
    )
    return named, titles


@query(f"WITH {_TITLES} SELECT DISTINCT source, page, partial FROM m WHERE source <> page AND NOT coalesce(of_year > year, false)")
def abolition_links(spark, sf_dir):
    return E.abolitions(*_named_titles(spark, sf_dir))


@query(f"""WITH {_TITLES}, r AS (SELECT *, coalesce(of_year = year, false) AS same FROM m WHERE source <> page AND of_base <> own_base), g AS (SELECT source, "full", count(DISTINCT page) AS k, bool_or(same) AS dated FROM r GROUP BY ALL)
SELECT DISTINCT source, page FROM r JOIN g USING (source, "full") WHERE k = 1 OR NOT dated OR same""")
def publication_links(spark, sf_dir):
    return E.publications(*_named_titles(spark, sf_dir))


@query("SELECT p_partkey, p_partkey % 3 > 0 AS kept FROM part")
def deletions_only(spark, sf_dir):
    from lodestone.functions.text import deletions_only as only

    k = F.col("p_partkey")
    narrowed = F.when(k % 3 == 0, F.concat("p_name", F.lit("!"))).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 100)))
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", only(F.col("p_name"), narrowed).alias("kept"))


@query("SELECT page, next_page FROM (SELECT p_partkey AS page, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS next_page FROM part) WHERE next_page IS NOT NULL")
def edition_order(spark, sf_dir):
    return E.editions(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_brand").alias("base"), F.col("p_type").alias("kind"), F.array(F.col("p_size")).alias("version")))


@query("""WITH f AS (SELECT o_custkey AS predecessor, o_orderkey % 2000 AS successor FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1996-01-01')
SELECT predecessor, CASE WHEN n > 1 THEN 'CONFLICT' WHEN n = 1 THEN 'REPLACED' ELSE 'UNRESOLVED' END AS state FROM (SELECT predecessor, count(DISTINCT successor) FILTER (successor < 700) AS n FROM f GROUP BY predecessor)""")
def temporal_facts(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("DRAFT")
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("predecessor"), (F.col("o_orderkey") % 2000).alias("successor"), F.col("o_orderdate").alias("effective_from"), state.alias("state"), F.lit("full").alias("scope"))
    return E.facts_on(facts, spark.range(700).withColumnRenamed("id", "page"), F.lit("1996-01-01").cast("timestamp"))


@query("SELECT o_orderkey AS span, CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 5 > 0 THEN 'BOUND' WHEN o_custkey % 3 > 0 THEN 'HASH_MISMATCH' ELSE 'MISSING' END AS state FROM orders")
def span_binding(spark, sf_dir):
    k = F.col("o_orderkey")
    spans = table(spark, sf_dir, "orders").select(k.alias("span"), F.col("o_custkey").alias("resource"), k.alias("version"), F.lit(0).alias("block"), F.when(k % 5 > 0, F.lit("h")).otherwise("x").alias("sha"))
    return E.bound(spans, spans.where("resource % 3 > 0").withColumn("sha", F.lit("h")))


@query("SELECT doc_id, count(*) AS n_blocks, sum(length(l))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def version_size_stats(spark, sf_dir):
    return E.size_stats(table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "doc_id", "line")


@query("SELECT o_custkey AS profile, CASE WHEN bool_and(o_orderkey % 50 <> 0) THEN 'CURRENT' ELSE 'SYNC_REQUIRED' END AS state, count(*) FILTER (o_orderkey % 50 <> 0) AS n_current, max(o_orderkey) AS last_indexed FROM orders GROUP BY 1")
def index_observation(spark, sf_dir):
    receipts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile"), F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(2).alias("generation"), F.col("o_orderkey").alias("indexed_at"))
    return E.index_state(receipts, "profile", F.lit(2))


@query("""WITH u AS (SELECT l_suppkey AS batch, l_partkey AS unit, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS s FROM lineitem GROUP BY ALL)
SELECT batch, count(*) FILTER (s = 0) AS n_done, count(*) FILTER (s = 1) AS n_failed, count(*) FILTER (s = 2) AS n_pending, CASE WHEN max(s) = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS state FROM u GROUP BY batch""")
def batch_coverage(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "A", "DONE").when(F.col("l_returnflag") == "R", "FAILED").otherwise("PENDING")
    return E.batch_state(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("batch"), F.col("l_partkey").alias("unit"), state.alias("state")), "batch")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'UNKNOWN' WHEN p_size % 5 = 0 THEN 'COMPLETE' WHEN p_size % 5 = 1 THEN '2 MISSING' ELSE '1 MISSING' END AS coverage FROM part")
def step_coverage(spark, sf_dir):
    s = F.col("p_size")
    declared = F.when(s % 4 != 0, F.array(F.lit(1), F.lit(2), F.lit(3)))
    used = F.when(s % 5 == 0, F.array(F.lit(3), F.lit(2), F.lit(1))).when(s % 5 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(3), F.lit(9)))
    return table(spark, sf_dir, "part").select("p_partkey", E.step_coverage(declared, used).alias("coverage"))


@query("SELECT o_custkey, bool_or(o_orderkey % 9 = 0) AS blocked FROM orders GROUP BY o_custkey")
def snapshot_references(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    snapshots = orders.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("run"), F.array("o_custkey").alias("resources"))
    return E.referenced(snapshots, orders.select(F.col("o_custkey").alias("resource")).distinct()).withColumnRenamed("resource", "o_custkey")


@query("SELECT s_suppkey, 'W' || row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END, s_name, s_suppkey) AS id FROM supplier")
def catalog_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("version"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 3 == 0, "knowledge").otherwise("document").alias("kind"))
    return E.catalog_ids(pages).select(F.col("version").alias("s_suppkey"), "id")


@query("SELECT l_partkey AS unit, min(l_linenumber) AS query_rank FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1")
def passage_conflicts(spark, sf_dir):
    return E.passage_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("passage"), F.col("l_linenumber").alias("query_rank")))


@query("SELECT s_nationkey AS page, min(s_suppkey % 13) AS priority, row_number() OVER (ORDER BY bool_or(s_acctbal > 9000) DESC, min(s_suppkey % 13), s_nationkey) AS place FROM supplier GROUP BY s_nationkey")
def route_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), (F.col("s_suppkey") % 13).alias("priority"), F.col("s_suppkey").alias("query"), "s_acctbal")
    return E.routes(rows, F.col("s_acctbal") > 9000).select("page", "priority", "place")


@query("""WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(greatest(ceil((n - 16) / 112e0), 1)::BIGINT)) AS i FROM d)
SELECT doc_id, count(*) AS n_windows, max(least(i * 112 + 128, n)) AS last_end FROM w GROUP BY doc_id""")
def token_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(E.windows(F.size(F.split("text", " ")), 128, 16)).alias("w"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.max("w.end").cast("long").alias("last_end"))


@query("SELECT o_orderkey, CAST(o_orderdate::DATE AS VARCHAR) AS day FROM orders")
def date_extraction(spark, sf_dir):
    text = F.concat(F.lit("from "), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(" on"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.iso_date(text).cast("string").alias("day"))


@query("SELECT r_name, count(*) AS n, string_agg(n_name, '; ' ORDER BY n_name, n_nationkey) AS titles FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def library_map(spark, sf_dir):
    pages = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.col("n_name").alias("title"), F.col("n_nationkey").alias("page"))
    return E.library_map(pages, ["r_name"])


@query("""WITH t AS (SELECT p_partkey, len(list_filter(['blue', 'part', '7'], lambda x: contains(lower(p_name), x))) AS n FROM part) SELECT p_partkey, n FROM t WHERE n > 0 AND n = (SELECT max(n) FROM t)""")
def fallback_pages(spark, sf_dir):
    terms = F.array(F.lit("blue"), F.lit("part"), F.lit("7"))
    return E.best_by_terms(table(spark, sf_dir, "part", "p_partkey", "p_name"), terms, "p_name", "p_partkey").withColumn("n", F.col("n").cast("long"))


_TYPED = "e AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_returnflag = 'A' THEN 'CITES' WHEN l_returnflag = 'R' THEN 'EXCEPTION_OF' ELSE 'REQUIRES' END AS type FROM lineitem)"


@query(f"WITH {_TYPED} SELECT DISTINCT src AS page, dst, CASE WHEN type = 'CITES' THEN 'citation' ELSE 'relation' END AS why FROM e WHERE src IN (SELECT p_partkey FROM part) UNION SELECT dst, src, 'exception' FROM e WHERE type = 'EXCEPTION_OF' AND dst IN (SELECT p_partkey FROM part)")
def related_reads(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "CITES").when(F.col("l_returnflag") == "R", "EXCEPTION_OF").otherwise("REQUIRES")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), kind.alias("type"))
    return E.neighbours(edges, table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "page"))


@query("SELECT l_orderkey AS page, count(*) AS n_drifted FROM lineitem WHERE l_linenumber < 1 + l_partkey % 5 GROUP BY 1")
def version_drift(spark, sf_dir):
    inputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("resource"), F.col("l_linenumber").alias("version"))
    return E.drifted(inputs, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resource"), (F.lit(1) + F.col("p_partkey") % 5).alias("version")))


@query("SELECT l_orderkey AS run FROM lineitem GROUP BY 1 HAVING bool_and(l_suppkey % 4 <> 1)")
def readable_runs(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("version"))
    return E.readable_runs(uses, table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("version")))


@query("""SELECT o_orderkey, o_orderstatus = 'F' OR r IN ('reviewer', 'publisher') OR (r = 'editor' AND (o_orderkey % 5 = 0 OR (o_orderstatus = 'P' AND o_custkey % 2 = 0))) AS readable
FROM (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'reader' WHEN 1 THEN 'editor' WHEN 2 THEN 'editor' ELSE 'reviewer' END AS r FROM orders)""")
def version_access(spark, sf_dir):
    from lodestone.operators.catalog import version_readable

    role = F.element_at(F.array(*map(F.lit, ("reader", "editor", "editor", "reviewer"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    state = F.when(F.col("o_orderstatus") == "P", "DRAFT").otherwise("OTHER")
    ok = version_readable(F.array(role), F.col("o_orderstatus") == "F", state, F.col("o_orderkey") % 5 == 0, F.col("o_custkey") % 2 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("readable"))


@query("SELECT c_custkey AS resource_id, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END AS version_no FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def visible_version(spark, sf_dir):
    from lodestone.operators.catalog import visible_version as pick

    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource_id"))
    return pick(*(users.where(f"resource_id % {d} = 0").withColumn("version_no", F.lit(n)) for n, d in ((1, 3), (2, 5), (3, 7))))


@query("""WITH n AS (SELECT p_partkey AS node, 'r' || p_size % 3 AS role FROM part UNION ALL SELECT 100000 + s_suppkey, 's' FROM supplier WHERE s_suppkey % 2 = 0),
e AS (SELECT DISTINCT l_partkey AS src, 100000 + l_suppkey AS dst FROM lineitem)
SELECT role, count(DISTINCT node) AS n_nodes, count(dst) AS n_edges FROM n LEFT JOIN (SELECT * FROM e WHERE dst IN (SELECT node FROM n)) ON src = node GROUP BY role""")
def node_role_counts(spark, sf_dir):
    from lodestone.operators.graph import role_counts

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat(F.lit("r"), F.col("p_size") % 3).alias("role"))
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 100000).alias("node"), F.lit("s").alias("role"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst")).distinct()
    return role_counts(parts.unionByName(suppliers), edges)


@query("""WITH t AS (SELECT unnest(['the', 'of', 'reea', 'schen']) AS term, unnest([false, false, true, true]) AS subject), n AS (SELECT count(*) AS n FROM documents),
m AS (SELECT doc_id AS page, term, 'text' AS w FROM documents, t WHERE contains(text, term) UNION ALL SELECT doc_id, 'the', 'category' FROM documents WHERE lang = 'en'),
k AS (SELECT term, subject, ln(1e0 + (n + 5e-1) / ((SELECT count(*) FROM m WHERE m.term = t.term AND w = 'text') + 5e-1)) AS mass FROM t, n), s AS (SELECT sum(mass) AS total, sum(mass) FILTER (subject) AS st FROM k)
SELECT page, round(sum(CASE WHEN w = 'text' THEN (CASE WHEN subject THEN 82e-2 * mass / st ELSE 0e0 END) + 15e-2 * mass / total ELSE 3e-2 * mass / total END), 6) AS score FROM m JOIN k USING (term), s GROUP BY page""")
def relevance_mass(spark, sf_dir):
    from lodestone.operators.ranking import relevance

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    words = ("the", "of", "reea", "schen")
    terms = spark.createDataFrame([(w, n > 1) for n, w in enumerate(words)], "term string, subject boolean")
    found = docs.select(F.col("doc_id").alias("page"), F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w))).alias("term"), F.lit("text").alias("where"))
    matches = found.unionByName(docs.where("lang = 'en'").select(F.col("doc_id").alias("page"), F.lit("the").alias("term"), F.lit("category").alias("where")))
    return relevance(matches, terms, docs).select("page", F.round("score", 6).alias("score"))
