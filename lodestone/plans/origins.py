"""Origins, claims, steps and inline links over texts that are composed from the star schema's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import metadata as M, navigation as N, replacements as R
from lodestone.plans.registry import query
from lodestone.session import spread, table


@query("""SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN '上海证券交易所' WHEN 1 THEN '财政部' WHEN 2 THEN '中国证监会' WHEN 3 THEN '中国人民银行' END AS issuer,
  CASE p_partkey % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'metadata_table' WHEN 2 THEN 'document_number' WHEN 3 THEN 'signature' END AS located,
  CASE p_partkey % 5 WHEN 0 THEN '上证发〔2020〕' || p_size || '号' WHEN 1 THEN '财会〔2019〕' || p_size || '号' WHEN 2 THEN '证监会令第' || p_size || '号' END AS number,
  CASE WHEN p_partkey % 5 = 2 THEN make_date(2007, 1 + p_size % 12, 5) END AS published FROM part""")
def document_origins(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    title = F.when(k == 0, F.concat(F.lit("上交所关于发布《"), F.col("p_brand"), F.lit("》的通知（上证发〔2020〕"), n, F.lit("号）"))).when(k == 4, "关于财税〔2016〕140号文件的解读").otherwise("办法")
    text = F.when(k == 1, F.concat(F.lit("【发布部门】财政部\t【发布文号】财会〔2019〕"), n, F.lit("号\n第一条"))).when(k == 2, F.concat(F.lit("（2007年"), (1 + F.col("p_size") % 12).cast("string"), F.lit("月5日证监会令第"), n, F.lit("号公布）\n第一条 根据证监发〔2001〕1号制定")))
    text = text.when(k == 3, "正文\n依据国发〔2001〕3号\n中国人民银行\n二〇二〇年一月二日").otherwise("正文。\n版权所有 中国证监会")
    return M.origins(spread(table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), title.alias("title"), text.alias("text")))


@query("""SELECT o_orderkey AS doc_id, said, act FROM orders, (VALUES (0, '已付款', 'condition'), (0, '已过账', 'condition'), (0, '已确认', 'assertion'), (1, '已付款', 'requirement'), (1, '已过账', 'assertion'), (2, '已付款', 'negated'), (3, '已审批', 'assertion')) t(k, said, act) WHERE o_orderkey % 4 = k""")
def completion_claims(spark, sf_dir):
    texts = F.element_at(F.array(*map(F.lit, ("如果已付款且已过账，则已确认。", "需要核对是否已付款，但已过账", "这不代表已付款", "本助手已审批"))), (1 + F.col("o_orderkey") % 4).cast("int"))
    return M.completions(table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), texts.alias("text"))).select("doc_id", "said", "act")


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 2 THEN '已过账' ELSE '已审批' END AS said FROM orders WHERE o_orderkey % 4 >= 2")
def unverified_claims(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (1 + k).cast("int"))
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    answers = orders.select(F.col("o_orderkey").alias("doc_id"), pick("已付款。", "如果已过账", "已过账", "我们已审批").alias("text"))
    support = orders.select(F.col("o_orderkey").alias("doc_id"), pick("客户已付款。", "", "必须核对是否已过账", "我们已审批").alias("text"))
    return M.unverified(answers, support)


# The steps of an order are its items: by ordinal, by a counter, by a path, or not told.
@query("""SELECT l_orderkey AS version_id, l_linenumber AS block_id, CASE WHEN l_orderkey % 4 < 3 OR count(*) OVER (PARTITION BY l_orderkey) = 1 THEN row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 4 = 1 THEN -l_linenumber ELSE l_linenumber END) END AS position FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def step_positions(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey") % 4
    locator = F.when(k == 1, F.to_json(F.struct((20 - n).alias("step_no")))).when(k == 2, F.to_json(F.struct(F.concat(F.lit("/p"), n * 7).alias("node_path"), F.lit("body").alias("part")))).otherwise("{}")
    steps = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("version_id"), n.alias("block_id"), F.when(k == 0, n).when(k == 3, 1).cast("long").alias("ordinal"), locator.alias("locator"))
    return M.step_order(steps).withColumn("position", F.col("position").cast("long"))


# Even parts have a name of their own, two odd ones share one and, but for every fifth pair, a canonical page.
@query("""WITH p AS (SELECT p_partkey AS page FROM part), v AS (SELECT page FROM p WHERE page % 50 <> 1), a AS (SELECT page, page // 4 + 1 AS g FROM v WHERE page % 3 <> 0),
t AS (
  SELECT a.page, CASE WHEN e.page IS NULL THEN 'UNAVAILABLE' ELSE 'LINK' END AS state, e.page AS target FROM a LEFT JOIN v e ON e.page = a.page - a.page % 2
  UNION SELECT page, 'UNAVAILABLE', NULL FROM a
  UNION SELECT a.page, CASE WHEN c.page IS NULL OR c.page % 50 = 1 OR d.page % 50 = 1 THEN 'UNAVAILABLE' WHEN a.g % 5 = 0 AND d.page IS NOT NULL THEN 'AMBIGUOUS' ELSE 'LINK' END,
    CASE WHEN c.page % 50 <> 1 AND coalesce(d.page, 0) % 50 <> 1 AND (a.g % 5 <> 0 OR d.page IS NULL) THEN c.page END FROM a LEFT JOIN p c ON c.page = 4 * a.g + 1 LEFT JOIN p d ON d.page = 4 * a.g + 3)
SELECT page, state, target FROM t WHERE state <> 'LINK' OR target <> page""")
def inline_links(spark, sf_dir):
    p = F.col("page")
    part = table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("page"))
    pages = part.select("page", F.when(p % 3 == 0, "document").otherwise("knowledge").alias("kind"), F.when((p % 4 == 3) & (F.floor(p / 4) % 5 != 0), p - 2).alias("canonical"), F.lit(None).cast("boolean").alias("canonical_open"))
    names = part.select("page", F.when(p % 2 == 0, F.concat(F.lit("P"), p)).otherwise(F.concat(F.lit("Q"), F.floor(p / 4))).alias("name"))
    text = F.concat(F.lit("see [[p"), p - p % 2, F.lit("]], [[q"), F.floor(p / 4) + 1, F.lit("|other]] and [[Nowhere]]"))
    blocks = part.select("page", text.alias("text"), F.when(p % 50 == 1, "stale").otherwise(F.sha2(text, 256)).alias("content_sha256"))
    return N.inline_links(pages, names, blocks).select("page", "state", "target").distinct()


def _notices(spark, sf_dir):
    """A notice for every part: the new edition of its number repeals the old one, in part for every third; every fourth gives no date."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    lines = [
        F.concat(F.lit("现公布《规则"), n, F.lit("新版》"), F.when(k % 4 == 0, "。").otherwise("，自2024年3月1日起施行。")),
        F.concat(F.lit("《规则"), n, F.lit("》"), F.when(k % 3 == 0, "第三条").otherwise(""), F.lit("同时废止；《草案》尚未废止。")),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("ordinal"), t.alias("text")) for i, t in enumerate(lines)))
    return spread(table(spark, sf_dir, "part", "p_partkey"), "p_partkey").select((k * 3).alias("version_id"), F.explode(rows).alias("b")).select("version_id", F.concat_ws("-", "version_id", "b.ordinal").alias("block_id"), "b.*")


@query("""SELECT p_partkey * 3 AS version_id, '规则' || p_partkey AS predecessor, '规则' || p_partkey || '新版' AS successor, CASE WHEN p_partkey % 4 <> 0 THEN DATE '2024-03-01' END AS effective_from, CASE WHEN p_partkey % 3 = 0 THEN 'partial' ELSE 'full' END AS scope FROM part""")
def replacement_facts(spark, sf_dir):
    return R.replacement_facts(_notices(spark, sf_dir)).select("version_id", "predecessor", "successor", "effective_from", "scope")


# Versions 3p + 1 and 3p + 2 are the old and the new rule; every fifth old one but 0 has a double, every seventh fact is registered, of which every second is revoked.
@query("""WITH p AS (SELECT p_partkey AS k FROM part),
f AS (SELECT k, CASE WHEN k % 5 <> 0 OR k = 0 THEN 3 * k + 1 END AS old, 3 * k + 2 AS new, CASE WHEN k % 4 <> 0 THEN DATE '2024-03-01' END AS day, CASE WHEN k % 3 = 0 THEN 'partial' ELSE 'full' END AS scope FROM p),
g AS (SELECT k, 3 * k + 1 AS old, 3 * k + 2 AS new, DATE '2024-03-01' AS day, CASE WHEN k % 3 = 0 THEN 'partial' ELSE 'full' END AS scope, k % 2 = 0 AS revoked FROM p WHERE k % 7 = 0)
SELECT CASE WHEN old IS NULL OR day IS NULL THEN 'NEEDS_INPUT' ELSE 'READY' END AS status, old AS predecessor, new AS successor, day AS effective_from, scope FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.old = f.old AND g.new = f.new AND (revoked OR (g.day = f.day AND g.scope = f.scope)))
UNION ALL SELECT 'CONFIRMED', old, new, day, scope FROM g WHERE NOT revoked""")
def replacement_suggestions(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    part = spread(table(spark, sf_dir, "part", "p_partkey"), "p_partkey")
    titles = F.array(F.struct((3 * k + 1).alias("version_id"), F.concat(F.lit("《规则 "), n, F.lit("》.pdf")).alias("t")), F.struct((3 * k + 2).alias("version_id"), F.concat(F.lit("规则"), n, F.lit("新版")).alias("t")), F.struct(F.when(k % 5 == 0, -k).otherwise(3 * k).alias("version_id"), F.when(k % 5 == 0, F.concat(F.lit("规则"), n)).otherwise("通知").alias("t")))
    documents = part.select(F.explode(titles).alias("d")).select("d.version_id", F.array("d.t").alias("titles"))
    registered = part.where(k % 7 == 0).select((3 * k + 1).alias("predecessor"), (3 * k + 2).alias("successor"), F.lit("2024-03-01").cast("date").alias("effective_from"), F.when(k % 3 == 0, "partial").otherwise("full").alias("scope"), F.when(k % 2 == 0, "REVOKED").otherwise("ACTIVE").alias("state"))
    notices = _notices(spark, sf_dir)
    return R.suggestions(R.replacement_facts(notices), documents, registered, notices).select("status", "predecessor", "successor", "effective_from", "scope")
