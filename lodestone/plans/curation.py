"""Text, source and curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lodestone.constants import STOP_WORDS
from lodestone.functions import text as T
from lodestone.operators import curation as C
from lodestone.plans.registry import query
from lodestone.session import table
from lodestone.sources import text as S


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT doc_id, i AS ordinal, i + 1 AS line, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)), 0)::BIGINT AS char_start, sha256(s[i + 1]) AS content_sha256 FROM l WHERE trim(s[i + 1]) <> ''""")
def block_explode(spark, sf_dir):
    return S.line_blocks(_docs(spark, sf_dir)).drop("text")


@query("SELECT sha256(text) AS body, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_bodies(spark, sf_dir):
    return C.body_groups(_docs(spark, sf_dir))


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS a, doc_id AS b FROM documents QUALIFY a < b")
def duplicate_body_pairs(spark, sf_dir):
    return C.body_pairs(_docs(spark, sf_dir))


@query("SELECT DISTINCT a, b FROM (SELECT min(doc_id) OVER (PARTITION BY lower(split_part(text, chr(10), 1))) AS a, doc_id AS b FROM documents) WHERE a < b")
def name_overlap_pairs(spark, sf_dir):
    names = _docs(spark, sf_dir).select(F.col("doc_id").alias("page"), F.lower(F.split("text", "\n")[0]).alias("name"))
    return C.name_pairs(names)


@query()
def title_similarity_pairs(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("block"), T.title_key(F.split("text", "\n")[0]).alias("title"))
    return C.similar_titles(titles)


@query("""WITH r AS (SELECT event_id, user_id, ts, ['missing ' || (event_id % 11) || '｜use ' || (event_id % 3), 'Missing ' || (event_id % 11) || '.'] AS p FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)
SELECT 'missing ' || (event_id % 11) AS gap, count(*) AS runs, min(event_id) AS first_run FROM r GROUP BY event_id % 11""")
def gap_aggregate(spark, sf_dir):
    e = (F.col("event_id") % 11).cast("string")
    phases = F.array(F.concat(F.lit("missing "), e, F.lit("｜use "), (F.col("event_id") % 3).cast("string")), F.concat(F.lit("Missing "), e, F.lit(".")))
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("owner_id"), F.col("ts").cast("timestamp").alias("created_at"), phases.alias("phases"))
    found = C.gaps(runs.withColumn("owner_id", F.lit(1)), F.lit(1))
    return found.select("gap", "runs", F.array_min("own_run_ids").alias("first_run"))


@query("""WITH r AS (SELECT user_id AS query_id, event_id % 400 AS page, CASE WHEN event_id % 3 = 0 THEN 'source' ELSE 'wiki' END AS kind FROM events)
SELECT query_id, CASE WHEN bool_or(page % 23 = 0 AND kind = 'source') THEN 'SOURCE_READ' WHEN bool_or(page % 23 = 0 AND kind = 'wiki') THEN 'WIKI_ONLY' ELSE 'UNREAD' END AS state, count(DISTINCT page) FILTER (page % 23 <> 0) AS n_next FROM r GROUP BY query_id""")
def query_coverage(spark, sf_dir):
    e = F.col("event_id")
    routes = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), (e % 400).alias("page"), F.when(e % 3 == 0, "source").otherwise("wiki").alias("kind"))
    read = spark.range(400).where("id % 23 = 0").withColumnRenamed("id", "page")
    return C.query_coverage(routes, read).select("query_id", "state", F.size("next").cast("long").alias("n_next"))


@query("""WITH q AS (SELECT o_custkey AS rule, o_orderkey AS source, o_orderstatus = 'F' AS needed FROM orders), f AS (SELECT o_orderkey AS source, o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AS ok FROM orders)
SELECT rule, coalesce(bool_and(ok) FILTER (needed), true) AS all_required, coalesce(bool_or(ok) FILTER (NOT needed), false) AS any_candidate FROM q JOIN f USING (source) GROUP BY rule""")
def primary_citation_cover(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    required = orders.select(F.col("o_custkey").alias("rule"), F.col("o_orderkey").alias("source"), (F.col("o_orderstatus") == "F").alias("needed"))
    facts = orders.select(F.col("o_orderkey").alias("source"), (F.col("o_orderkey") % 3 > 0).alias("is_read"), (F.col("o_orderkey") % 5 > 0).alias("is_cited"))
    return C.primary_coverage(required, facts).select("rule", F.coalesce("all_required", F.lit(True)).alias("all_required"), F.coalesce("any_candidate", F.lit(False)).alias("any_candidate"))


@query("SELECT l_orderkey AS block, count(DISTINCT l_partkey) AS n_cited FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 4 <> 0)")
def bundle_all_or_nothing(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("block"), F.col("l_partkey").alias("cited")).distinct()
    eligible = table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("block"))
    return C.bundles(items.select("block").distinct(), items, eligible)


@query("""WITH n AS (SELECT lower(p_name) AS name, p_partkey // 2 AS target FROM part), g AS (SELECT name, count(DISTINCT target) AS k, min(target) AS t FROM n GROUP BY name)
SELECT name, CASE WHEN k = 1 THEN 'RESOLVED' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS state, CASE WHEN k = 1 THEN t ELSE -1 END AS target FROM (SELECT DISTINCT name FROM n UNION SELECT 'no such part') LEFT JOIN g USING (name)""")
def alias_resolution(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.floor(F.col("p_partkey") / 2).alias("target"))
    asked = names.select("name").unionByName(spark.range(1).select(F.lit("no such part").alias("name")))
    return C.resolve_names(asked, names).na.fill(-1)


@query("SELECT p_brand AS name, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def alias_collisions(spark, sf_dir):
    return C.collisions(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("target")))


@query("SELECT p_partkey AS passage, CASE WHEN p_size % 2 = 1 THEN 'REJECTED' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'EXTRACTED' ELSE 'NEEDS_REVIEW' END AS status FROM part")
def cited_only_disposition(spark, sf_dir):
    passages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("passage"), F.when(F.col("p_size") % 2 == 1, "REJECTED").otherwise("EXTRACTED").alias("status"))
    cited = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("passage"))
    return C.dispositions(passages, cited)


@query("""WITH p AS (SELECT conv_id * 1000 + turn AS paragraph, [conv_id % 9, turn % 9, (conv_id + turn) % 9] AS marks FROM conversations), m AS (SELECT DISTINCT paragraph, unnest(marks) AS e FROM p)
SELECT paragraph, count(*) AS n_marks, count(*) FILTER (e < 6) AS n_linked, count(DISTINCT CASE WHEN e < 6 THEN e // 2 END) AS n_versions FROM m GROUP BY paragraph""")
def citation_map(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    mark = lambda n: F.format_string("[E%d]", n % 9)
    paragraphs = table(spark, sf_dir, "conversations").select((c * 1000 + t).alias("paragraph"), F.concat_ws(" ", mark(c), F.lit("and"), mark(t), mark(c + t)).alias("text")).distinct()
    sources = spark.range(6).select(F.col("id").alias("evidence"), F.floor(F.col("id") / 2).alias("version"))
    return C.citation_map(paragraphs, sources)


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'kept' WHEN p_partkey % 7 = 0 THEN 'created' WHEN p_size > 25 THEN 'updated' ELSE 'unchanged' END AS outcome FROM part) GROUP BY outcome")
def metadata_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 7 <> 0 or p_partkey % 5 = 0").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("doc"))
    new = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") > 25, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("doc"))
    return C.upserts(old, new)


@query("SELECT a, b, CASE WHEN bool_or(m = 'body') AND bool_or(m = 'name') THEN 'body,name' ELSE max(m) END AS methods FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS a, doc_id AS b, 'body' AS m FROM documents UNION ALL SELECT min(doc_id) OVER (PARTITION BY lower(split_part(text, chr(10), 1))), doc_id, 'name' FROM documents) WHERE a < b GROUP BY a, b")
def duplicate_signals(spark, sf_dir):
    pairs = C.merge_signals(duplicate_body_pairs(spark, sf_dir).withColumn("method", F.lit("body")), name_overlap_pairs(spark, sf_dir).withColumn("method", F.lit("name")))
    return pairs.select("a", "b", F.array_join("methods", ",").alias("methods"))


@query(rf"""WITH p AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\s\x0B,.;:!?()\[\]{{}}|/\\]+'), lambda x: len(x) BETWEEN 2 AND 160 AND x NOT IN {STOP_WORDS!r}) AS w FROM benchmark)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:24], ' ') AS terms FROM p""")
def plan_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))


@query("SELECT doc_id, substr(text, 1, 280) AS excerpt, lang || '/' || source AS path FROM documents")
def snippet_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.category_path(F.concat_ws("/", F.lit(" "), "lang", "source")).alias("path"))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, length(text)::BIGINT AS covered FROM documents WHERE length(text) > 0")
def byte_split_chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    parts = S.split_rows(docs, 900, 100)
    before = F.coalesce(F.max("end").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("fresh", F.col("end") - F.greatest(before, "start")).groupBy("doc_id").agg(F.sum("fresh").alias("covered"), F.max("end").cast("long").alias("n_chars"))
    return rows.select("doc_id", "n_chars", "covered")


@query("SELECT doc_id, sum(len(string_split_regex(trim(l, ' '), ' +')))::BIGINT AS n_tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id")
def semantic_units(spark, sf_dir):
    return S.semantic_units(_docs(spark, sf_dir), 120).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))


@query()
def html_blocks(spark, sf_dir):
    from lodestone.sources.html import page_blocks

    return page_blocks(table(spark, sf_dir, "pages", "page_id", "html")).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))
