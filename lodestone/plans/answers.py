"""Question plans and answer contexts; every customer asks, and every part's rules are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import answers as A
from lodestone.plans.registry import query
from lodestone.session import table

_VOCABULARY = [("asset", "股票", "股票"), ("asset", "债券", "债券"), ("event", "trading_suspension", "停牌"), ("event", "bond_put", "回售"), ("special", "LOF", "LOF")]
_QUESTIONS = ("买入股票如何入账", "停牌怎么办", "停牌期间如何申报", "现行法规", "回售如何估值", "lof估值参数", "你好")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, _QUESTIONS)), (1 + F.col("c_custkey") % len(_QUESTIONS)).cast("int"))
    questions = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("query_id"), asked.alias("question"))
    return A.question_plan(questions, spark.createDataFrame(_VOCABULARY, "kind string, name string, term string"))


@query("""SELECT c_custkey AS query_id, intent, assets, dimensions, assumed FROM customer, (VALUES
  (0, 'fund_accounting_practice', '股票', 'initial_measurement,accounting_entries', false), (1, 'specialist_valuation', '', 'applicability,subsequent_measurement,governance', true), (2, 'exchange_rules', '', 'applicability,trading_procedure', false),
  (3, 'rule_validity', '', 'topic_explanation', false), (4, 'specialist_valuation', '债券', 'applicability,subsequent_measurement,exercise_state,quote_selection,governance', false), (5, 'specialist_valuation', '', 'subsequent_measurement', false),
  (6, 'general_knowledge', '', 'topic_explanation', false)) t(k, intent, assets, dimensions, assumed) WHERE c_custkey % 7 = k""")
def question_intents(spark, sf_dir):
    join = lambda c: F.array_join(c, ",").alias(c)
    return _plans(spark, sf_dir).select("query_id", "intent", join("assets"), join("dimensions"), "assumed")


@query("""SELECT p_partkey AS version_id, first_ordinal, replace(text, '#', p_size::VARCHAR) AS text, n_blocks, complete, detail_gap FROM part, (VALUES
  (2, '第#条 甲应当办理。另行说明。', 3, true, false, 2), (5, '（一）若无报价：', 1, false, true, 2), (7, '其他', 1, false, false, 1), (8, '其他事项。', 1, true, false, 0)) t(first_ordinal, text, n_blocks, complete, detail_gap, kind) WHERE kind = 2 OR kind = p_partkey % 2""")
def paragraph_groups(spark, sf_dir):
    k = F.col("p_partkey")
    lines = [(1, F.lit("第一章"), True), (2, F.concat(F.lit("第"), F.col("p_size").cast("string"), F.lit("条 甲应当")), False), (3, F.lit("办理。"), False), (4, F.lit("另行说明。"), False), (5, F.lit("（一）若无报价："), False), (6, F.lit("目录....1"), False), (None, F.when(k % 2 == 1, "其他").otherwise("其他事项。"), False)]
    rows = F.array(*(F.struct((F.lit(n) if n else 7 + F.when(k % 2 == 0, 1).otherwise(0)).cast("int").alias("ordinal"), t.alias("text"), F.lit(h).alias("heading")) for n, t, h in lines))
    blocks = table(spark, sf_dir, "part", "p_partkey", "p_size").select(k.alias("version_id"), F.explode(rows).alias("b")).select("version_id", F.concat_ws("-", "version_id", "b.ordinal").alias("block_id"), "b.*", F.lit("paragraph").alias("kind"), F.lit(1).alias("section"), F.lit(None).cast("int").alias("page"))
    return A.paragraphs(blocks).select("version_id", "first_ordinal", "text", F.size("block_ids").alias("n_blocks"), "complete", "detail_gap")


@query("""SELECT c_custkey AS query_id, place, role, version_id, facets FROM customer, (VALUES
  (1, 0, 'supporting', 'v', 'no_quote,valuation_method'), (1, 1, 'primary', 'w', 'scope'), (1, 2, 'primary', 'w', 'governance_disclosure'), (1, 3, 'primary', 'w', ''), (1, 4, 'related_knowledge', 'k', ''),
  (2, 0, 'primary', 'w', 'scope'), (2, 1, 'primary', 'w', 'governance_disclosure'), (2, 2, 'primary', 'w', ''),
  (4, 0, 'primary', 'w', 'scope'), (4, 1, 'primary', 'w', 'governance_disclosure'), (4, 2, 'supporting', 'v', 'no_quote,valuation_method'), (4, 3, 'primary', 'w', ''), (4, 4, 'related_knowledge', 'k', '')) t(k, place, role, version_id, facets) WHERE c_custkey % 7 = k""")
def facet_cover(spark, sf_dir):
    """Four passages of two sources for every question; a source of more hits leads, facets of the other fill what is missing."""
    plans = _plans(spark, sf_dir).where(F.size("requirements") > 0)
    texts = F.array(*(F.struct(F.lit(v).alias("version_id"), F.lit(o).alias("first_ordinal"), F.lit(t).alias("text")) for v, o, t in (("v", 1, "没有报价时采用估值技术。"), ("w", 1, "适用甲。"), ("w", 2, "应当披露。"), ("w", 3, "其他。"))))
    rows = plans.select("query_id", "events", F.explode(texts).alias("u")).select("query_id", "events", "u.*")
    units = rows.select("query_id", "version_id", F.lit("规则").alias("title"), "first_ordinal", F.array(F.concat("version_id", "first_ordinal")).alias("block_ids"), A.facets(F.col("text")).alias("facets"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(True).alias("complete"), F.lit(False).alias("exclusion"), F.lit(True).alias("direct"))
    cites = F.array(F.struct(F.lit("v").alias("version_id"), F.lit("v1").alias("block_id")))
    related = plans.select("query_id", F.lit("k").alias("version_id"), F.lit("k1").alias("block_id"), F.lit(9).cast("long").alias("n_bytes"), cites.alias("cites"), F.lit(0.5).alias("score"))
    return A.answer_context(plans, units, related).where("role is not null").select("query_id", "place", "role", "version_id", F.array_join("facets", ",").alias("facets"))
