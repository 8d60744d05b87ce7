"""Catalogue queries. Customers stand for users and resources, orders for versions, nations for spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import text as T
from lodestone.operators import catalog as C
from lodestone.plans.registry import query
from lodestone.session import table

_PATHS = "(SELECT doc_id, lang || '/' || source AS category, split_part(text, chr(10), 1) AS name, [lang, source, 'alias:x'] AS tags, text FROM documents)"


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "lang", "source").alias("category"), F.col("lang").alias("kind"), F.split("text", "\n")[0].alias("name"), F.array("lang", "source", F.lit("alias:x")).alias("tags"), F.lit(None).cast("date").alias("deleted_at"))


@query(f"SELECT doc_id, category FROM {_PATHS} WHERE (category = 'en' OR category LIKE 'en/%') AND list_contains(tags, 'src3')")
def list_filter_subtree(spark, sf_dir):
    return _resources(spark, sf_dir).where(C.resource_filter(category="en", tag="src3")).select("doc_id", "category")


@query(f"SELECT doc_id FROM {_PATHS} WHERE contains(lower(name), 'then')")
def list_filter_text(spark, sf_dir):
    return _resources(spark, sf_dir).where(C.resource_filter(text="THEN")).select("doc_id")


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, true AS has_more FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 500) ORDER BY 2 DESC, 1 DESC LIMIT 20")
def keyset_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey")
    anchor = (F.lit("1998-01-01").cast("timestamp"), F.lit(500).cast("long"))
    rows = orders.where(F.struct("o_orderdate", "o_orderkey") < F.struct(anchor[0].alias("o_orderdate"), anchor[1].alias("o_orderkey")))
    return C.keyset_page(rows, ["o_orderdate", "o_orderkey"], 20).select("o_orderkey", "o_orderdate", "place", "has_more")


@query("SELECT tag, count(*) AS n FROM (SELECT doc_id, unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def tag_counts(spark, sf_dir):
    return C.tag_counts(_resources(spark, sf_dir))


@query("""WITH p AS (SELECT p_type || '/' || p_brand AS path, count(*) AS k FROM part GROUP BY 1), u AS (SELECT unnest([split_part(path, '/', 1), path]) AS up, path, k FROM p)
SELECT up AS path, sum(k)::BIGINT AS n, coalesce(sum(k) FILTER (up = path), 0)::BIGINT AS n_direct FROM u GROUP BY up""")
def taxonomy_rollup(spark, sf_dir):
    return C.taxonomy(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("path")))


@query("""WITH c AS (SELECT r_name || '/' || n_name AS path, count(c_custkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1),
u AS (SELECT unnest([split_part(path, '/', 1), path]) AS up, path, k FROM c)
SELECT up AS path, sum(k)::BIGINT AS n, coalesce(sum(k) FILTER (up = path), 0)::BIGINT AS n_direct FROM u GROUP BY up""")
def taxonomy_registered(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("path")
    return C.taxonomy(rows, registered=places.select(F.explode(T.ancestors(F.col("path"))).alias("path")))


_ROLE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'editor' WHEN 'MACHINERY' THEN 'reviewer' ELSE 'admin' END"


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    users = customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("active"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "team").when(F.col("n_nationkey") % 3 == 1, "personal").otherwise("other")
    spaces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("space_id"), kind.alias("kind"), (F.col("n_nationkey") + 1).cast("long").alias("owner_id"))
    members = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("space_id"), F.expr(_ROLE).alias("role"))
    return C.effective_roles(users, spaces, members)


_ROLES = f"""roles AS (SELECT c_custkey AS user_id, c_nationkey AS space_id, CASE WHEN c_nationkey % 3 = 0 THEN list_sort(list_distinct([{_ROLE}, 'reader'])) ELSE [{_ROLE}] END AS roles FROM customer WHERE c_acctbal >= 0 AND c_nationkey % 3 <> 1
UNION ALL SELECT c_custkey, n_nationkey, ['admin', 'editor', 'publisher', 'reader', 'reviewer'] FROM nation JOIN customer ON c_custkey = n_nationkey + 1 WHERE n_nationkey % 3 = 1 AND c_acctbal >= 0)"""


@query(f"WITH {_ROLES} SELECT user_id, space_id, array_to_string(roles, ',') AS roles FROM roles")
def role_resolution(spark, sf_dir):
    return _roles(spark, sf_dir).select("user_id", "space_id", F.array_join("roles", ",").alias("roles"))


@query(f"""WITH {_ROLES}, r AS (SELECT s_suppkey AS resource_id, s_nationkey AS space_id, s_acctbal < 3000 AS restricted FROM supplier)
SELECT user_id, resource_id FROM r JOIN roles USING (space_id) WHERE user_id % 20 = 0 AND (NOT restricted OR (user_id, resource_id) IN (SELECT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey))""")
def acl_readable(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    resources = supplier.select(F.col("s_suppkey").alias("resource_id"), F.col("s_nationkey").alias("space_id"), (F.col("s_acctbal") < 3000).alias("restricted"), F.lit(None).cast("date").alias("deleted_at"))
    bought = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").where("o_custkey % 20 = 0").join(table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    grants = bought.select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("resource_id"), F.lit("read").alias("permission"))
    asked = _roles(spark, sf_dir).where("user_id % 20 = 0")  # the stated users; open resources come for each of them
    return C.readable(resources, asked, grants).select("user_id", "resource_id")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def grant_semijoin(spark, sf_dir):
    granted = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "part", "p_partkey").join(granted, F.col("p_partkey") == F.col("l_partkey"), "left_semi")


_VERSIONS = """v AS (SELECT o_custkey AS resource_id, o_orderkey, o_orderstatus, row_number() OVER w AS version_no, o_orderdate::DATE AS valid_from, (lead(o_orderdate) OVER w)::DATE AS valid_to
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return orders.select(
        F.col("o_custkey").alias("resource_id"), "o_orderkey", "o_orderstatus", F.row_number().over(w).cast("long").alias("version_no"), F.to_date("o_orderdate").alias("valid_from"), F.to_date(F.lead("o_orderdate").over(w)).alias("valid_to"),
    )


@query(f"WITH {_VERSIONS} SELECT resource_id, o_orderkey, version_no FROM (SELECT *, max(version_no) OVER (PARTITION BY resource_id) AS m FROM v) WHERE version_no = m")
def latest_version(spark, sf_dir):
    return C.latest(_versions(spark, sf_dir)).select("resource_id", "o_orderkey", "version_no")


@query(f"""WITH {_VERSIONS}, s AS (SELECT *, CASE o_orderstatus WHEN 'P' THEN NULL ELSE true END AS applicable FROM v WHERE version_no % 5 <> 0 AND valid_from <= DATE '1998-06-01'),
n AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY version_no DESC) AS r FROM s)
SELECT resource_id, o_orderkey, version_no FROM n WHERE r = 1 AND (valid_to IS NULL OR DATE '1998-06-01' < valid_to) AND applicable AND o_orderkey % 7 <> 0""")
def asof_version(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 7 == 0, "UNKNOWN").otherwise("CURRENT")
    rows = _versions(spark, sf_dir).select(
        "*", F.when(F.col("version_no") % 5 == 0, "DRAFT").otherwise("APPROVED").alias("state"), F.lit(True).alias("released"), F.when(F.col("o_orderstatus") != "P", F.lit(True)).alias("applicable"),
        status.alias("legal_status"), F.lit(True).alias("verified"), F.lit(True).alias("hash_ok"),
    )
    return C.as_of(rows, F.lit("1998-06-01").cast("date")).select("resource_id", "o_orderkey", "version_no")


@query(f"WITH {_VERSIONS} SELECT resource_id, o_orderkey FROM v WHERE valid_from <= DATE '1997-01-15' AND (valid_to IS NULL OR DATE '1997-01-15' < valid_to)")
def validity_filter(spark, sf_dir):
    return _versions(spark, sf_dir).where(C.valid_on(F.col("valid_from"), F.col("valid_to"), F.lit("1997-01-15").cast("date"))).select("resource_id", "o_orderkey")


@query("SELECT event_id, (ts + INTERVAL 8 HOUR)::DATE::VARCHAR AS day FROM events WHERE event_type = 'click'")
def effective_day_utc8(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts", "event_type").where("event_type = 'click'").select("event_id", C.effective_day(F.lit(None).cast("date"), F.col("ts")).cast("string").alias("day"))


@query("""SELECT d.doc_id, CASE WHEN lang NOT IN ('en', 'fr') OR coalesce(quality = 0, false) THEN 'false' WHEN quality IS NULL THEN 'unknown' ELSE 'true' END AS applicable FROM documents d LEFT JOIN labels USING (doc_id)""")
def applicability_3vl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    term = lambda g, f, *v: F.struct(F.lit(g).alias("group"), F.lit(f).alias("field"), F.array(*map(F.lit, v)).alias("values"))
    context = F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.coalesce(F.col("quality").cast("string"), F.lit("")))
    return docs.select("doc_id", C.applicable(F.array(term("all", "lang", "en", "fr"), term("none", "quality", "0")), context).cast("string").alias("applicable")).na.fill("unknown", ["applicable"])


_REASON = "CASE WHEN toxic = 1 THEN 'RESOURCE_SUSPENDED' WHEN doc_id % 10 = 0 THEN 'NOT_PUBLISHED' WHEN quality = 0 THEN 'UNVERIFIED_SOURCE' WHEN quality IS NULL THEN 'CONTEXT_REQUIRED' ELSE 'ELIGIBLE' END"


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [(F.col("toxic") == 1, "RESOURCE_SUSPENDED"), (F.col("doc_id") % 10 == 0, "NOT_PUBLISHED"), (F.col("quality") == 0, "UNVERIFIED_SOURCE"), (F.col("quality").isNull(), "CONTEXT_REQUIRED")]
    return docs.select("doc_id", "source", C.first_reason(rules, "ELIGIBLE").alias("reason"))


@query(f"SELECT d.doc_id, {_REASON} AS reason FROM documents d LEFT JOIN labels USING (doc_id)")
def eligibility_reason(spark, sf_dir):
    return _reasons(spark, sf_dir).select("doc_id", "reason")


@query(f"SELECT source, count(*) AS visible, count(*) FILTER (r = 'ELIGIBLE') AS eligible, count(*) FILTER (r <> 'ELIGIBLE') AS excluded FROM (SELECT d.source, {_REASON} AS r FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY source")
def eligibility_summary(spark, sf_dir):
    ok = F.col("reason") == "ELIGIBLE"
    return _reasons(spark, sf_dir).groupBy("source").agg(F.count("*").alias("visible"), F.count(F.when(ok, 1)).alias("eligible"), F.count(F.when(~ok, 1)).alias("excluded"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")
def partial_uniqueness(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    return C.duplicates_of_key(orders.where("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'BASIC' || substr(p_type || '/' || p_brand, 9) ELSE p_type || '/' || p_brand END AS path FROM part")
def subtree_rename(spark, sf_dir):
    path = F.concat_ws("/", "p_type", "p_brand")
    return table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand").select("p_partkey", C.rename_subtree(path, "STANDARD", "BASIC").alias("path"))


@query("SELECT doc_id, sha256(text) AS content_sha256, strlen(text) > 1000 AS big FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("content_sha256"), (F.octet_length("text") > 1000).alias("big"))


@query("""WITH b AS (SELECT doc_id, doc_id % 9 = 0 AND i = 2 AS broken FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))
SELECT doc_id, count(*) AS n_blocks FROM b GROUP BY doc_id HAVING NOT bool_or(broken)""")
def hash_verify(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "block"))
    stored = F.sha2(F.when((F.col("doc_id") % 9 == 0) & (F.col("i") == 2), F.lit("tampered")).otherwise(F.col("block")), 256)
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.bool_and(F.sha2("block", 256) == stored).alias("ok")).where("ok").select("doc_id", "n_blocks")


@query("""WITH l AS (SELECT o_custkey AS id, max(o_orderdate)::DATE AS deleted_on, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT id, deleted_on + 400 AS expiry, id % 11 = 0 AS hold, n FROM l)
SELECT id, expiry::DATE::VARCHAR AS expiry, array_to_string(list_filter([CASE WHEN hold THEN 'LEGAL_HOLD' END, CASE WHEN DATE '2001-12-01' < expiry THEN 'RETENTION_NOT_EXPIRED' END, CASE WHEN n > 20 THEN 'DEPENDENCY_EXISTS' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def retention_eligibility(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.max("o_orderdate")).alias("deleted_on"), F.count("*").alias("n"))
    rows = rows.select("id", "deleted_on", F.lit(None).cast("date").alias("retain_until"), (F.col("id") % 11 == 0).alias("legal_hold"), F.greatest(F.col("n") - 20, F.lit(0)).alias("n_dependents"))
    return C.purgeable(rows, F.lit("2001-12-01").cast("date"), 400).select("id", F.col("expiry").cast("string").alias("expiry"), F.array_join("reasons", ",").alias("reasons"))
