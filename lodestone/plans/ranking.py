"""Ranking queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.constants import HITS_PER_VERSION, PROFILES, RERANK_POOL, STOP_WORDS
from lodestone.operators import ranking as R
from lodestone.plans.registry import query
from lodestone.session import table

# On these tables NFKC changes no token, so the SQL leaves it out.
_TOKENS = f"""list_concat(list_concat(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+'), regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+(?:[._/-][a-z0-9]+)+')),
  list_filter(flatten(list_transform(regexp_extract_all({{0}}, '[㐀-鿿]+'), lambda r: CASE WHEN len(r) = 1 THEN [r] ELSE list_transform(range(1, len(r)), lambda i: r[i:i + 1]) END)), lambda w: w NOT IN {STOP_WORDS!r}))"""
_BM25 = f"""
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark),
d AS (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS len, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, doc_id, sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * len / mean))) AS score
  FROM post JOIN df USING (term) JOIN q USING (term), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents", "doc_id", "text"), _questions(spark, sf_dir))


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return R.top_k(_scored(spark, sf_dir), 10, "query_id", "doc_id").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, b AS (SELECT s.query_id, s.doc_id, score + CASE WHEN contains(lower(d.text), lower(trim(k.text))) THEN 3e0 ELSE 0e0 END
  + CASE WHEN contains(lower(split_part(d.text, chr(10), 1)), lower(trim(k.text))) THEN 5e0 ELSE 0e0 END AS score
  FROM scored s JOIN documents d USING (doc_id) JOIN benchmark k ON k.item_id = s.query_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM b) WHERE r <= 5""")
def bm25_phrase_bonus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    points = R.phrase_points(docs.withColumn("title", F.split("text", "\n")[0]), _questions(spark, sf_dir))
    rows = _scored(spark, sf_dir).join(points, ["query_id", "doc_id"], "left").withColumn("score", F.col("score") + F.coalesce("points", F.lit(0.0)))
    return R.top_k(rows, 5, "query_id", "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, h AS (SELECT query_id, source, doc_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS hit FROM scored JOIN documents USING (doc_id)),
p AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM h WHERE hit = 1)
SELECT query_id, source, doc_id, hit, place, round(score, 6) AS score FROM h JOIN p USING (query_id, source) WHERE hit <= {HITS_PER_VERSION} AND place <= 5""")
def bm25_grouped_top3(spark, sf_dir):
    rows = _scored(spark, sf_dir).join(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    return R.grouped_top(rows, 5, "query_id", "source", "doc_id").select("query_id", "source", "doc_id", "hit", "place", F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, round(ln(1e0 + (n - count(DISTINCT doc_id) + 5e-1) / (count(DISTINCT doc_id) + 5e-1)), 6) AS idf FROM d, n GROUP BY term, n""")
def df_idf_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counts = R.document_frequency(docs).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    return counts.select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"SELECT source, count(*) AS n_docs, sum(len({_TOKENS.format('text')}))::BIGINT AS n_tokens, round(avg(len({_TOKENS.format('text')})), 6) AS mean_tokens FROM documents GROUP BY source")
def doc_length_stats(spark, sf_dir):
    docs = R.lexical_index(table(spark, sf_dir, "documents", "source", "text"), "source")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_tokens"), F.round(F.avg("len"), 6).alias("mean_tokens"))


@query(f"""WITH p AS (SELECT item_id, term, count(*) AS tf, sha256(term) AS h FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL)
SELECT item_id, (('0x' || h[1:16])::UHUGEINT % 256)::INTEGER AS bucket, round(sum((CASE WHEN ('0x' || h[17:18])::INTEGER % 2 = 0 THEN 1e0 ELSE -1e0 END) * (1e0 + ln(tf))), 6) AS weight FROM p GROUP BY ALL""")
def hash_embed_buckets(spark, sf_dir):
    index = R.postings(table(spark, sf_dir, "benchmark"), "item_id")
    return R.hash_buckets(index, 256, "item_id").select("item_id", "bucket", F.round("weight", 6).alias("weight"))


_COS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
c AS (SELECT q.vec_id AS query_id, u.vec_id, u.label, list_dot_product(q.e, u.e) AS score FROM u, u q WHERE q.vec_id % 20 = 0)"""


def _nearest(spark: SparkSession, sf_dir: str, k: int, group: str | None = None) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.nearest(vectors, asked, k, group=group)


@query(f"WITH {_COS} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM c) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return R.top_k(_nearest(spark, sf_dir, 10), 10, "query_id", "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_COS}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, vec_id) AS hit FROM c),
p AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM h WHERE hit = 1)
SELECT query_id, label, vec_id, hit, place, round(score, 6) AS score FROM h JOIN p USING (query_id, label) WHERE hit <= 3 AND place <= 4""")
def cosine_grouped_top3(spark, sf_dir):
    return R.grouped_top(_nearest(spark, sf_dir, 3, "label"), 4, "query_id", "label", "vec_id").select("query_id", "label", "vec_id", "hit", "place", F.round("score", 6).alias("score"))


#: Places of the hashing embedding.
DIM = 256
_EMBED = """SELECT id, bucket, sum(s * (1e0 + ln(tf))) AS w FROM (
    SELECT id, tf, (('0x' || h[1:16])::UHUGEINT % 256)::INTEGER AS bucket, CASE WHEN ('0x' || h[17:18])::INTEGER % 2 = 0 THEN 1e0 ELSE -1e0 END AS s
    FROM (SELECT {0} AS id, term, count(*) AS tf, sha256(term) AS h FROM (SELECT {0}, unnest({1}) AS term FROM {2}) GROUP BY ALL)) GROUP BY ALL"""
# Channels: BM25; the hashing embedding's cosine; the catalogue, by words of the question in the first line.
_CHANNELS = f"""{_BM25},
de AS ({_EMBED.format("doc_id", _TOKENS.format("text"), "documents")}), dn AS (SELECT id, sqrt(sum(w * w)) AS size FROM de GROUP BY id),
qe AS ({_EMBED.format("item_id", _TOKENS.format("text"), "benchmark")}), qn AS (SELECT id, sqrt(sum(w * w)) AS size FROM qe GROUP BY id),
cosines AS (SELECT qe.id AS query_id, de.id AS doc_id, sum((de.w / dn.size) * (qe.w / qn.size)) AS score FROM de JOIN qe USING (bucket) JOIN dn ON dn.id = de.id JOIN qn ON qn.id = qe.id WHERE dn.size > 0 AND qn.size > 0 GROUP BY ALL),
vector AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cosines WHERE round(score, 9) > 0),
catalog AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, count(*) AS n FROM q JOIN (SELECT doc_id, unnest(list_distinct({_TOKENS.format("split_part(text, chr(10), 1)")})) AS term FROM documents) USING (term) GROUP BY ALL)),
ch AS (SELECT query_id, doc_id AS unit_id, 'bm25' AS channel, rank FROM ranked WHERE rank <= 30
  UNION ALL SELECT query_id, doc_id, 'vector', rank FROM vector WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, 'catalog', rank FROM catalog WHERE rank <= 20)"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, questions = table(spark, sf_dir, "documents", "doc_id", "text"), _questions(spark, sf_dir)
    asked = R.hash_vectors(questions, DIM, "query_id", "query").select("query_id", F.col("embedding").alias("q"))
    found = (
        ("bm25", 30, R.bm25(docs, questions)),
        ("vector", 30, R.nearest(R.hash_vectors(docs, DIM), asked, 30, "doc_id").where(F.round("score", 9) > 0)),
        ("catalog", 20, R.title_overlap(docs, questions)),
    )
    ranked = [R.top_k(rows, k, "query_id", "doc_id").select("query_id", F.col("doc_id").alias("unit_id"), F.lit(name).alias("channel"), "rank") for name, k, rows in found]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


@query(f"""WITH {_CHANNELS}, f AS (SELECT query_id, unit_id, sum(1e0 / (60 + rank)) AS score, count(*) AS n_channels FROM ch GROUP BY ALL)
SELECT query_id, unit_id, n_channels, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_hybrid(spark, sf_dir):
    fused = R.rrf(_channels(spark, sf_dir))
    return R.top_k(fused, 10, "query_id", "unit_id").select("query_id", "unit_id", F.size("channels").cast("long").alias("n_channels"), "rank", F.round("score", 9).alias("score"))


_WEIGHT = "CASE profile " + " ".join(f"WHEN '{p}' THEN CASE channel " + " ".join(f"WHEN '{c}' THEN {v!r}::DOUBLE" for c, v in w.items()) + " END" for p, w in PROFILES.items()) + " END"
_FUSED = f"""{_CHANNELS}, pf AS (SELECT unnest({list(PROFILES)!r}) AS profile),
f AS (SELECT query_id, profile, unit_id, sum(({_WEIGHT}) / (60 + rank)) AS score, count(*) AS n FROM ch, pf GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id, profile ORDER BY round(score, 12) DESC, unit_id) AS fusion_rank FROM f)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = F.explode(F.array(*map(F.lit, PROFILES))).alias("profile")
    return R.weighted_rrf(_channels(spark, sf_dir).select("*", profiles))


@query(f"WITH {_FUSED} SELECT query_id, unit_id, fusion_rank, round(score, 9) AS score FROM fr WHERE profile = 'semantic' AND fusion_rank <= 10")
def weighted_unit_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).where("profile = 'semantic' and fusion_rank <= 10").select("query_id", "unit_id", "fusion_rank", F.round("score", 9).alias("score"))


@query(f"WITH {_FUSED} SELECT query_id, profile, unit_id, fusion_rank FROM fr WHERE fusion_rank <= 5")
def fusion_ablation(spark, sf_dir):
    return _fused(spark, sf_dir).where("fusion_rank <= 5").select("query_id", "profile", "unit_id", "fusion_rank")


@query(f"WITH {_FUSED} SELECT query_id, count(*) AS n_pool, count(*) FILTER (fusion_rank <= least({RERANK_POOL}, 16)) AS n_prefix FROM fr WHERE profile = 'semantic' GROUP BY query_id")
def rerank_pool_prefix(spark, sf_dir):
    rows = _fused(spark, sf_dir).where("profile = 'semantic'")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_pool"), F.count(F.when(F.col("fusion_rank") <= min(RERANK_POOL, 16), 1)).alias("n_prefix"))


@query(f"""WITH {_FUSED}, s AS (SELECT query_id, unit_id, score, CASE WHEN fusion_rank <= 8 THEN CAST(unit_id % 7 AS DOUBLE) END AS rerank_score FROM fr WHERE profile = 'semantic' AND fusion_rank <= 8)
SELECT query_id, unit_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, unit_id) AS rank FROM s""")
def rerank_order(spark, sf_dir):
    rows = _fused(spark, sf_dir).where("profile = 'semantic' and fusion_rank <= 8").withColumn("rerank_score", (F.col("unit_id") % 7).cast("double"))
    return R.rerank_order(rows).select("query_id", "unit_id", "rerank_score", "rank")


@query(f"""WITH {_FUSED}, g AS (SELECT query_id, source AS page_id, min(fusion_rank) AS r FROM fr JOIN documents ON doc_id = unit_id WHERE profile = 'semantic' AND fusion_rank <= 30 GROUP BY ALL)
SELECT query_id, page_id, round(1e0 / (60 + r), 9) AS score FROM g""")
def page_grouping(spark, sf_dir):
    rows = _fused(spark, sf_dir).where("profile = 'semantic' and fusion_rank <= 30").withColumnRenamed("fusion_rank", "rank")
    pages = table(spark, sf_dir, "documents", "doc_id", "source").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("page_id"))
    return R.page_groups(rows.join(pages, "unit_id")).select("query_id", "page_id", F.round("score", 9).alias("score"))


@query(f"WITH {_FUSED} SELECT unit_id AS page_id, round(max(score), 9) AS score, count(DISTINCT query_id) AS n_queries FROM fr WHERE profile = 'semantic' AND fusion_rank <= 5 GROUP BY unit_id")
def multi_query_merge(spark, sf_dir):
    rows = _fused(spark, sf_dir).where("profile = 'semantic' and fusion_rank <= 5").withColumnRenamed("unit_id", "page_id")
    return R.merge_queries(rows).select("page_id", F.round("score", 9).alias("score"), F.size("queries").cast("long").alias("n_queries"))


@query(f"""WITH {_FUSED}, t AS (SELECT query_id, count(*) AS candidates FROM fr WHERE profile = 'semantic' GROUP BY query_id)
SELECT t.query_id, candidates, least(candidates, 8) AS reranked, candidates - least(candidates, 8) AS unscored,
  (SELECT count(*) FROM ch WHERE ch.query_id = t.query_id AND channel = 'bm25') AS n_bm25, (SELECT count(*) FROM ch WHERE ch.query_id = t.query_id AND channel = 'vector') AS n_vector, (SELECT count(*) FROM ch WHERE ch.query_id = t.query_id AND channel = 'catalog') AS n_catalog FROM t""")
def candidate_trace(spark, sf_dir):
    rows = _fused(spark, sf_dir).where("profile = 'semantic'").withColumn("rerank_score", F.when(F.col("fusion_rank") <= 8, F.col("score")))
    return R.candidate_trace(rows)


@query("SELECT item_id AS query_id, CASE WHEN regexp_matches(text, '[“\"].{3,}[”\"]') THEN 'exact_reference' ELSE 'semantic' END AS profile FROM benchmark")
def query_route_class(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", R.query_profile(F.col("query")).alias("profile"))
