"""Evaluation and sequence queries: benchmark passages are gold spans, events are runs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import evaluation as E
from lodestone.operators import sequences as S
from lodestone.plans.registry import query
from lodestone.session import table

_IV = "iv AS (SELECT user_id AS k, (event_id * 37 % 1000)::BIGINT AS start, (event_id * 37 % 1000 + 1 + event_id % 40)::BIGINT AS \"end\" FROM events)"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events", "user_id", "event_id").select(F.col("user_id").alias("k"), (e * 37 % 1000).alias("start"), (e * 37 % 1000 + 1 + e % 40).alias("end"))


@query(f"""WITH {_IV}, r AS (SELECT *, coalesce(max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM iv)
SELECT k, sum(greatest(0, "end" - greatest(start, reach)))::BIGINT AS covered FROM r GROUP BY k""")
def interval_union(spark, sf_dir):
    return E.union_length(_intervals(spark, sf_dir), "k")


# Required: characters [20, 80) of every tenth user; observed: that user's events as spans, ranked by event.
_SPANS = f"""{_IV}, req AS (SELECT DISTINCT k AS span_id, 20::BIGINT AS s, 620::BIGINT AS e FROM iv WHERE k % 5 = 0),
obs AS (SELECT user_id AS k, (event_id * 37 % 1000)::BIGINT AS f, (event_id * 37 % 1000 + 1 + event_id % 200)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events),
hit AS (SELECT span_id, rank, greatest(s, f) AS a, least(e, t) AS b FROM req JOIN obs ON k = span_id WHERE greatest(s, f) < least(e, t)),
pt AS (SELECT span_id, a AS p FROM hit UNION SELECT span_id, b FROM hit UNION SELECT span_id, s FROM req UNION SELECT span_id, e FROM req),
pc AS (SELECT * FROM (SELECT span_id, p, lead(p) OVER (PARTITION BY span_id ORDER BY p) AS q FROM pt) WHERE q IS NOT NULL),
mr AS (SELECT pc.span_id, p, q, min(rank) AS r FROM pc LEFT JOIN hit ON hit.span_id = pc.span_id AND a <= p AND q <= b GROUP BY ALL),
cov AS (SELECT span_id, coalesce(sum(q - p) FILTER (r IS NOT NULL), 0)::BIGINT AS covered, CASE WHEN bool_and(r IS NOT NULL) THEN max(r) END AS first_full_rank FROM mr GROUP BY span_id)"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = F.col("event_id")
    events = table(spark, sf_dir, "events", "user_id", "event_id")
    required = events.where("user_id % 5 = 0").select(F.col("user_id").alias("span_id")).distinct().select("span_id", F.col("span_id").alias("k"), F.lit(20).cast("long").alias("start"), F.lit(620).cast("long").alias("end"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    observed = events.select(F.col("user_id").alias("k"), (e * 37 % 1000).alias("from"), (e * 37 % 1000 + 1 + e % 200).alias("to"), rank.alias("rank"))
    return E.coverage(required, E.span_hits(required, observed, ["k"]))


@query(f"WITH {_SPANS} SELECT span_id, 600::BIGINT AS required, covered, coalesce(first_full_rank, -1) AS first_full_rank, CASE WHEN first_full_rank IS NOT NULL THEN 'FULL' WHEN covered > 0 THEN 'SPAN_PARTIAL' ELSE 'NO_MATCHING_SPAN' END AS code FROM cov")
def span_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).na.fill(-1, ["first_full_rank"]).na.fill("FULL", ["code"])


@query(f"WITH {_SPANS} SELECT count(*) AS n_spans, count(first_full_rank) AS n_full, max(first_full_rank) AS worst FROM cov")
def first_full_rank(spark, sf_dir):
    return _coverage(spark, sf_dir).agg(F.count("*").alias("n_spans"), F.count("first_full_rank").alias("n_full"), F.max("first_full_rank").alias("worst"))


# Gold: each benchmark item is a group of the case item_id mod 10; it is found at the rank of its first document.
_GOLD = """g AS (SELECT item_id, item_id % 10 AS case_id, item_id % 3 = 0 AS critical, min(d.doc_id) % 9 + 1 AS r FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
c AS (SELECT case_id, count(*) AS n_groups, count(r) AS n_hit, sum(coalesce(1e0 / r, 0e0)) AS rr FROM g GROUP BY case_id),
res AS (SELECT u.case_id, coalesce(n_groups, 0) AS n_groups, coalesce(n_hit, 0) AS n_hit, u.case_id % 4 <> 3 AND coalesce(n_groups, 0) > 0 AS known, rr FROM (SELECT unnest(range(12)) AS case_id) u LEFT JOIN c USING (case_id)),
out AS (SELECT case_id, n_groups, n_hit, CASE WHEN known AND n_hit = n_groups THEN 'PASS' WHEN known THEN 'FAIL' ELSE 'UNKNOWN' END AS status, CASE WHEN known THEN n_hit / n_groups END AS recall, CASE WHEN known THEN rr / n_groups END AS mean_rr FROM res)"""


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = items.withColumnRenamed("text", "gold").join(docs, F.contains("text", "gold"), "left").groupBy("item_id").agg((F.min("doc_id") % 9 + 1).alias("first_full_rank"))
    spans = found.select((F.col("item_id") % 10).alias("case_id"), F.col("item_id").alias("group_id"), (F.col("item_id") % 3 == 0).alias("critical"), F.lit(0).alias("alternative_id"), "first_full_rank")
    cases = spark.range(12).withColumnRenamed("id", "case_id")
    return E.stage_results(cases, E.group_ranks(spans), cases.select("case_id", (F.col("case_id") % 4 != 3).alias("complete")))


@query(f"WITH {_GOLD} SELECT case_id, n_groups, n_hit, status, round(recall, 6) AS recall, round(mean_rr, 6) AS mean_rr FROM out")
def stage_recall(spark, sf_dir):
    return _stages(spark, sf_dir).select("case_id", "n_groups", "n_hit", "status", F.round("recall", 6).alias("recall"), F.round("mean_rr", 6).alias("mean_rr"))


@query(f"""WITH {_GOLD} SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'UNKNOWN' END AS status, count(*) AS n_expected, count(recall) AS n_known, count(*) - count(recall) AS n_unknown,
round(avg(recall), 6) AS macro_recall, round(sum(n_hit) FILTER (recall IS NOT NULL) / sum(n_groups) FILTER (recall IS NOT NULL), 6) AS micro_recall, round(avg(mean_rr), 6) AS mean_rr FROM out""")
def macro_micro_recall(spark, sf_dir):
    out = E.stage_summary(_stages(spark, sf_dir))
    return out.select("status", "n_expected", "n_known", "n_unknown", *(F.round(c, 6).alias(c) for c in ("macro_recall", "micro_recall", "mean_rr")))


@query("SELECT user_id, CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_and(s = 'PASS') THEN 'PASS' ELSE 'UNKNOWN' END AS status FROM (SELECT user_id, CASE WHEN value > 95 THEN 'FAIL' WHEN event_id % 40 <> 0 THEN 'PASS' ELSE 'UNKNOWN' END AS s FROM events) GROUP BY user_id")
def three_state_fold(spark, sf_dir):
    s = F.when(F.col("value") > 95, "FAIL").when(F.col("event_id") % 40 != 0, "PASS").otherwise("UNKNOWN")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(E.status_fold(s).alias("status"))


@query("SELECT event_type, count(*) AS n_expected, count(v) AS n_measured, count(*) - count(v) AS n_unknown, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95 FROM (SELECT event_type, CASE WHEN event_id % 13 <> 0 THEN value END AS v FROM events) GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("v"))
    return E.distribution(rows, "v", "event_type")


@query("""WITH t AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b, user_id % 4 AS cohort FROM events GROUP BY user_id)
SELECT cohort, count(*) AS n_expected, count(b - a) AS n_comparable, round(avg(b - a), 6) AS mean_delta, count(*) FILTER (b > a) AS increased, count(*) FILTER (b < a) AS decreased, count(*) FILTER (b = a) AS unchanged FROM t GROUP BY cohort""")
def paired_delta(spark, sf_dir):
    one = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(one("view").alias("a"), one("click").alias("b")).withColumn("cohort", F.col("user_id") % 4)
    return E.paired_delta(rows, "a", "b", "cohort").withColumn("mean_delta", F.round("mean_delta", 6))


# Families take turns as holdout, dev and used; a few documents of each are filed wrongly.
_SPLIT = "CASE WHEN doc_id % 101 = 0 THEN 'dev' WHEN doc_id % 103 = 0 THEN 'used' WHEN doc_id % 97 % 3 = 0 THEN 'holdout' WHEN doc_id % 97 % 3 = 1 THEN 'dev' ELSE 'used' END"


@query(f"""WITH d AS (SELECT doc_id % 97 AS family_id, {_SPLIT} AS split FROM documents), c AS (SELECT * FROM d WHERE split <> 'used'), s AS (SELECT family_id FROM d WHERE split = 'used')
SELECT family_id, 'FAMILY_IN_BOTH_SPLITS' AS code FROM (SELECT family_id FROM c WHERE split = 'holdout' INTERSECT SELECT family_id FROM c WHERE split = 'dev')
UNION ALL SELECT family_id, 'HOLDOUT_FAMILY_USED_IN_DEVELOPMENT' FROM (SELECT family_id FROM c WHERE split = 'holdout' INTERSECT SELECT family_id FROM s)""")
def leakage_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id").select((F.col("doc_id") % 97).alias("family_id"), F.expr(_SPLIT).alias("split"))
    return E.leaked(docs.where("split <> 'used'"), docs.where("split = 'used'").select("family_id"))


@query("SELECT event_type, median(value) AS median_value, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")
def model_cost_median(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 0").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median_value"), F.count("*").alias("n"))


@query("SELECT event_type AS phase, user_id % 10 AS run, round(sum(value), 6) AS elapsed, count(*) AS calls FROM events GROUP BY ALL")
def timing_by_phase(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase"), (F.col("user_id") % 10).alias("run")).agg(F.round(F.sum("value"), 6).alias("elapsed"), F.count("*").alias("calls"))




@query("""WITH b AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE (i * 7 + doc_id) % 5 <> 0),
c AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NOT DISTINCT FROM i - 1 THEN 0 ELSE 1 END AS cut FROM b),
n AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS island FROM c) SELECT doc_id, island, min(i) AS first, count(*) AS n FROM n GROUP BY ALL""")
def ordinal_islands(spark, sf_dir):
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("(i * 7 + doc_id) % 5 <> 0")
    rows = S.islands(lines.select("doc_id", F.col("i").cast("long").alias("i")), ["doc_id"], "i")
    return rows.groupBy("doc_id", "island").agg(F.min("i").alias("first"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, event_type, event_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM c)
SELECT user_id, island, event_type, min(event_id) AS first, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 2""")
def side_islands(spark, sf_dir):
    rows = S.change_islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).where("n >= 2")


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS marker FROM events")
def carry_forward_marker(spark, sf_dir):
    return S.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "marker").select("event_id", "marker").na.fill(-1)


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 OR p <> event_type")
def change_detection(spark, sf_dir):
    return S.changed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE running <= 30000 AND n <= 12")
def prefix_batching(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return S.prefix_within(rows, ["source"], ["doc_id"], "size", 30000, 12).select("source", "doc_id", "running")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, lang, strlen(text)::INTEGER AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r(source, n, used, taken, ok) AS (SELECT DISTINCT source, 0::BIGINT, 0::BIGINT, []::VARCHAR[], false FROM d
  UNION ALL SELECT source, n, used + CASE WHEN k THEN size ELSE 0 END, CASE WHEN k THEN list_append(taken, lang) ELSE taken END, k
  FROM (SELECT d.source, d.n, used, taken, lang, size, len(list_filter(taken, lambda x: x = lang)) < 3 AND used + size <= 12000 AS k FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1))
SELECT source, doc_id, lang, size FROM r JOIN d USING (source, n) WHERE ok""")
def greedy_version_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.octet_length("text").alias("size"))
    return S.greedy_budget(rows, "source", ["doc_id"], "lang", "size", 12000, 3)


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' ORDER BY 2 LIMIT 20), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'de' ORDER BY 2 LIMIT 9)
SELECT doc_id, rank * 2 - 1 AS place FROM a UNION ALL SELECT doc_id, rank * 2 FROM b""")
def interleave_lists(spark, sf_dir):
    from lodestone.operators.ranking import top_k

    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").withColumn("score", F.col("n_chars").cast("double"))
    lists = [top_k(docs.where(F.col("lang") == lang), k, "lang", "doc_id").select("doc_id", "rank") for lang, k in (("en", 20), ("de", 9))]
    return S.interleave(*lists).select("doc_id", "place")


@query("SELECT doc_id, i AS index, i * 1200 AS start, md5(substr(text, i * 1200 + 1, 1200)) AS part FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 1200e0)::BIGINT)) AS i FROM documents)")
def fixed_fragments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(S.fragments(F.col("text"), 1200)).alias("f"))
    return rows.select("doc_id", F.col("f.index").cast("long").alias("index"), F.col("f.start").cast("long").alias("start"), F.md5(F.col("f.text").cast("binary")).alias("part"))
