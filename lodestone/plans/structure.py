"""Structure queries over texts that are composed from the star schema's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions.text import redact
from lodestone.operators import structure as S
from lodestone.plans.registry import query
from lodestone.session import spread, table


def _regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regulation for every part: contents, two chapters, articles p_size and p_size + 1, an item, a repeal and references."""
    n = F.col("p_size").cast("string")
    lines = [
        F.lit("目录"), F.lit("第一章 总则 …… 1"), F.lit(""), F.lit("第一章 总则"), F.concat(F.lit("第"), n, F.lit("条 "), F.col("p_type")), F.lit("1. first item"), F.lit("第二章 附则"),
        F.concat(F.lit("第"), (F.col("p_size") + 1).cast("string"), F.lit("条 依照第"), n, F.lit("条和《他法》第九条办理。")), F.concat(F.lit("自2024年"), (1 + F.col("p_partkey") % 12).cast("string"), F.lit("月7日起施行。同时废止《"), F.col("p_brand"), F.lit("》。")),
    ]
    parts = spread(table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


@query("""SELECT p_partkey AS doc_id, line, level, family, CASE family WHEN 'article' THEN p_size + number ELSE number END AS number
FROM part, (VALUES (3, 2, 'chapter', 1), (4, 4, 'article', 0), (5, 5, 'item', 1), (6, 2, 'chapter', 2), (7, 4, 'article', 1)) t(line, level, family, number)""")
def heading_lines(spark, sf_dir):
    return S.headings(_regulations(spark, sf_dir))


@query("SELECT p_partkey AS doc_id, section, parent, first_line, last_line FROM part, (VALUES (0, -1, 0, 8), (1, 0, 3, 5), (2, 1, 4, 5), (3, 2, 5, 5), (4, 0, 6, 8), (5, 4, 7, 8)) t(section, parent, first_line, last_line)")
def outline_sections(spark, sf_dir):
    return S.sections(_regulations(spark, sf_dir)).drop("title")


@query("""SELECT p_partkey AS doc_id, family, CASE family WHEN 'article' THEN p_size + number ELSE number END AS number, section
FROM part, (VALUES ('chapter', 1, 1), ('chapter', 1, 1), ('article', 0, 2), ('chapter', 2, 4), ('article', 1, 5), ('article', 0, 2)) t(family, number, section)""")
def clause_links(spark, sf_dir):
    return S.clause_links(_regulations(spark, sf_dir)).where("state = 'RESOLVED'").drop("state")


@query("SELECT p_partkey AS doc_id, 'repeals' AS kind, p_brand AS value, false AS partial FROM part UNION ALL SELECT p_partkey, 'effective', '2024-' || lpad((1 + p_partkey % 12)::VARCHAR, 2, '0') || '-07', false FROM part")
def effect_statements(spark, sf_dir):
    return S.statements(_regulations(spark, sf_dir))


@query("SELECT o_orderkey AS doc_id, command, argument || (o_custkey % n)::VARCHAR AS argument FROM orders, (VALUES ('READ', 'W', 7), ('SEARCH', 'rule ', 11), ('GAP', 'form ', 5)) t(command, argument, n)")
def answer_commands(spark, sf_dir):
    k = lambda n: (F.col("o_custkey") % n).cast("string")
    lines = [F.concat(F.lit("  READ: W"), k(7)), F.lit("> READ: quoted"), F.lit("```"), F.lit("SEARCH: in code"), F.lit("```"), F.concat(F.lit("SEARCH：rule "), k(11), F.lit(" ")), F.lit("We READ: this"), F.concat(F.lit("GAP:form "), k(5)), F.concat(F.lit("READ: W"), k(7))]
    return S.commands(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text")))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, sha256(text) AS sha256, true AS fits FROM documents WHERE text <> ''")
def utf8_packets(spark, sf_dir):
    rows = S.packets(table(spark, sf_dir, "documents", "doc_id", "text"), 1000).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("packet", "body"))).alias("p"), F.max(F.octet_length("body")).alias("most"))
    whole = F.array_join(F.transform("p", lambda p: p["body"]), "")
    return rows.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha256"), (F.col("most") <= 1000).alias("fits"))


@query("""SELECT DISTINCT doc_id, evidence FROM (SELECT conv_id * 1000 + turn AS doc_id, unnest([conv_id % 9] || range(turn % 5, turn % 5 + 3)) AS evidence FROM conversations)""")
def evidence_marks(spark, sf_dir):
    t = F.col("turn") % 5
    text = F.concat(F.lit("[E"), F.col("conv_id") % 9, F.lit("] and E"), t, F.lit("-E"), t + 2, F.lit(" but `E77` and ```\nE88\n``` not"))
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text")).distinct()
    return S.evidence_ids(docs).select("doc_id", F.col("evidence").cast("long").alias("evidence"))


@query("SELECT p_partkey AS doc_id, p_size AS value FROM part")
def chinese_numerals(spark, sf_dir):
    digit = lambda n: F.element_at(F.array(*map(F.lit, "一二三四五六七八九")), n.cast("int"))
    size = F.col("p_size")
    tens, ones = F.floor(size / 10), size % 10
    word = F.concat(F.when(tens > 1, digit(F.greatest(tens, F.lit(1)))).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(F.greatest(ones, F.lit(1)))).otherwise(""))
    return S.numerals(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), word.alias("text"))).withColumn("value", F.col("value").cast("int"))


@query("SELECT c_custkey, 'user ' || c_custkey || ' api_key=[REDACTED] and password: [REDACTED] with Bearer [REDACTED] ok' AS text FROM customer")
def redacted_text(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", redact(F.concat(F.lit("user "), k, F.lit(" api_key=k-"), k, F.lit(" and password: p"), k, F.lit(" with Bearer ab.c"), k, F.lit("== ok"))).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_missing FROM orders")
def quantity_grounding(spark, sf_dir):
    k = F.col("o_orderkey") % 50
    claim = F.concat(k.cast("string"), F.lit("% of "), k.cast("string"), F.lit("亿元 in 30天"))
    support = F.concat((k * 100).cast("string"), F.lit("bp, "), (k * 10000).cast("string"), F.lit("万元, "), F.when(F.col("o_orderkey") % 3 == 0, "31 days").otherwise("30 days"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(S.ungrounded(claim, support)).alias("n_missing"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 25 >= 5 AND c_custkey % 25 <> 7")
def gaps_left(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 5 or n_nationkey = 7").select(F.concat(F.lit("《Rules no. "), F.col("n_nationkey"), F.lit(";》")).alias("title"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("RULES no "), F.col("c_custkey") % 25, F.lit(";")).alias("gap"))
    return customer.join(S.gaps_left(customer.select("gap").distinct(), nations), "gap").select("c_custkey")


@query("SELECT p_partkey, round(55e-2 * (p_size / 50e0) + 25e-2 * (p_partkey % 2) + 3e-2 * (p_partkey % 3) + 35e-2 * (p_partkey % 5) + 3e-1 * (p_partkey % 7), 6) AS score FROM part")
def read_priority(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.read_priority(F.col("p_size") / 50.0, k % 2, k % 3, k % 5, k % 7), 6).alias("score"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, sum(length(line))::BIGINT AS n_chars, true AS fits, true AS reversible FROM l WHERE trim(line) <> '' AND NOT contains(line, chr(9)) AND NOT starts_with(ltrim(line), '|') GROUP BY doc_id""")
def reversible_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    plain = docs.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.contains(x, F.lit("\t")) & ~F.startswith(F.ltrim(x), F.lit("|"))), "\n"))
    rows = S.units(plain, 120, 0, 24).join(plain, "doc_id")
    same = F.forall("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == F.substring(F.col("body"), s["body_start"] + 1, s["body_end"] - s["body_start"]))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.groupBy("doc_id").agg(F.sum(size).alias("n_chars"), (F.max("n_tokens") <= 120).alias("fits"), F.bool_and(same).alias("reversible"))


@query("""SELECT p_partkey AS doc_id, section, prefix, n_units FROM part, (VALUES (0, '', 1), (1, '第一章 总则', 1), (2, '第一章 总则 / 第', 1), (3, NULL, 1), (4, '第二章 附则', 1), (5, '第二章 附则 / 第', 1)) t(section, prefix, n_units)""")
def unit_context(spark, sf_dir):
    rows = S.units(_regulations(spark, sf_dir), 60, 8, 40).groupBy("doc_id", "section").agg(F.first("prefix").alias("prefix"), F.count("*").cast("int").alias("n_units"))
    return rows.select("doc_id", "section", F.regexp_extract("prefix", "^(第.章 ..( / 第)?)?", 0).alias("prefix"), "n_units").withColumn("prefix", F.when(F.col("section") != 3, F.col("prefix")))
