"""Ranking: postings, BM25, vectors, fusion and grouped top-k, over many queries at once."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.constants import ASPECT_PATTERN, B, EXACT_PATTERN, HITS_PER_VERSION, K1, PROFILES, RRF_K, TEXT_BONUS, TITLE_BONUS
from lodestone.functions.text import search_tokens
from lodestone.session import materialise, spread, worker_path

#: Terms that are broadcast to filter an index, and (question, term) rows that are broadcast to be joined, at most.
BROADCAST_TERMS = 500_000
#: Vectors and questions that are multiplied at once.
VECTOR_BLOCK, QUERY_BLOCK = 1024, 512
#: Texts that are embedded at once, and terms whose buckets a worker remembers.
TEXT_BLOCK, BUCKETS = 500, 50_000


def lexical_index(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """key, len (tokens of the text), terms (map of term -> tf): a row per row of docs, in one pass without a shuffle.

    With `terms` (term) only those are kept: a set of them is broadcast if there
    are at most BROADCAST_TERMS, else all terms stay. Null texts have no tokens.
    """
    spark = docs.sparkSession
    worker_path(spark)
    kind, shared = docs.schema[key].dataType.simpleString(), None
    if terms is not None:
        some = [r[0] for r in terms.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()]
        shared = spark.sparkContext.broadcast(frozenset(some)) if len(some) <= BROADCAST_TERMS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared.value if shared else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sizes, ends, words, counts = [], [0], [], []
                for t in some.column(1):
                    found = search_tokens(t.as_py())
                    tf = Counter(found if only is None else filter(only.__contains__, found))
                    sizes.append(len(found))
                    words += tf.keys()
                    counts += tf.values()
                    ends.append(len(words))
                of = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int32()), of], names=[key, "len", "terms"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, len int, terms map<string,int>")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, len (tokens of the document), term, tf: the lexical index row by row."""
    return lexical_index(docs, key, text).select(key, "len", F.explode("terms").alias("term", "tf"))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df."""
    index = lexical_index(docs.select(F.lit(0).alias("doc_id"), F.col(text)), "doc_id", text)
    return index.select(F.explode(F.map_keys("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct tokens of every query (query_id, query)."""
    return lexical_index(queries, "query_id", "query").select("query_id", F.explode(F.map_keys("terms")).alias("term"))


def _bounded(asked: DataFrame) -> DataFrame:
    """Rows of questions, broadcast if they are at most BROADCAST_TERMS."""
    return F.broadcast(asked) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else asked


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, key, score: BM25 of every document that shares a term with a query.

    queries has query_id and query. Documents are tokenised once: the index of the
    asked terms is written, and lengths, frequencies and hits are read from it. Its
    rows are dealt by their key, so pairs of question and document are summed where
    they arise: they aren't shuffled, and a task holds those of its share only.
    """
    asked = materialise(asked_terms(queries), "asked")
    index = materialise(lexical_index(docs, key, text, asked), "index")
    stats = index.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = index.select(F.explode(F.map_keys("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    hits = spread(index.where(F.size("terms") > 0), key).select(key, "len", F.explode("terms").alias("term", "tf"))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "mean", idf(F.col("n"), F.col("df")).alias("idf"))
    part = F.col("idf") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("mean")))
    return hits.join(_bounded(weights), "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))


def title_overlap(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, key, score: distinct terms of a query in the first line of a document, the catalogue's order."""
    asked = materialise(asked_terms(queries), "asked")
    titles = docs.select(F.col(key), F.split(F.col(text), "\n")[0].alias("title"))
    hits = spread(lexical_index(titles, key, "title", asked).where(F.size("terms") > 0), key).select(key, F.explode(F.map_keys("terms")).alias("term"))
    return hits.join(_bounded(asked), "term").groupBy("query_id", key).agg(F.count("*").cast("double").alias("score"))


def phrase_bonus(text: Column, title: Column, query: Column) -> Column:
    """Points for a text and a title that contain the query as it is."""
    asked = F.lower(F.trim(query))
    has = lambda where, points: F.when((asked != "") & F.contains(F.lower(F.coalesce(where, F.lit(""))), asked), F.lit(points)).otherwise(F.lit(0.0))
    return has(text, TEXT_BONUS) + has(title, TITLE_BONUS)


def phrase_points(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title") -> DataFrame:
    """query_id, key, points: phrase_bonus() of the documents (key, text, title) that hold a query as it is; no others.

    An automaton of all queries reads texts and titles once, so no text meets a query that it doesn't hold.
    """
    from lodestone.operators.curation import occurrences

    asked = queries.select("query_id", F.lower(F.trim("query")).alias("name")).where("name <> ''")
    held = lambda where, points: occurrences(asked.select("name"), docs.select(F.col(key).alias("src"), F.lower(where).alias("text"))).select(F.col("src").alias(key), "name", F.lit(points).alias("points"))
    return held(text, TEXT_BONUS).unionByName(held(title, TITLE_BONUS)).join(asked, "name").groupBy("query_id", key).agg(F.sum("points").alias("points"))


def top_k(scored: DataFrame, k: int, group: str, key: str, score: str = "score") -> DataFrame:
    """The k best rows of every group with their rank; ties go to the least key."""
    best = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def grouped_top(scored: DataFrame, limit: int, query: str, group: str, key: str, per_group: int = HITS_PER_VERSION) -> DataFrame:
    """At most per_group hits of each of the `limit` best groups of a query.

    A group enters by its best hit and is never evicted, so ranking groups by
    their best hit equals admitting hits greedily. Scores are read once: every hit
    brings the best one of its group along. Null groups take a place, but aren't returned.
    """
    value = F.round("score", 9)
    inside = Window.partitionBy(query, group).orderBy(value.desc(), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = scored.withColumns({"hit": F.row_number().over(inside).cast("long"), "_head": F.first(F.struct(value.alias("value"), F.col(key).alias("key"))).over(inside)})
    hits = hits.where(F.col("hit") <= per_group)
    heads = Window.partitionBy(query).orderBy(F.col("_head.value").desc(), "_head.key", group)
    hits = hits.withColumn("place", F.dense_rank().over(heads).cast("long")).where(F.col("place") <= limit)
    return hits.where(F.col(query).isNotNull() & F.col(group).isNotNull()).drop("_head")


def normalised(vector: Column) -> Column:
    """A vector of doubles of length one; null for a zero, empty or non-finite one."""
    v = vector.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    fine = (size > 0) & ~F.isnan(size) & (size < F.lit(float("inf")))
    return F.when(fine, F.transform(v, lambda x: x / size))


def cosine(vectors: DataFrame, asked: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score and the other columns: exact cosine of every vector with every asked one.

    asked (query_id, q) is the stated query set: its size bounds the rows per
    vector, and it may have at most QUERY_BLOCK rows; nearest() takes any number.
    """
    if asked.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        raise ValueError("too many asked vectors to return all scores; use nearest()")
    scan = vectors.withColumn("v", normalised(F.col(vector))).where("v is not null").drop(vector)
    block = asked.select("query_id", normalised(F.col("q")).alias("q")).where("q is not null")
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return scan.join(F.broadcast(block), F.lit(True)).withColumn("score", dot).drop("v", "q")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one; zeros for null, empty, zero and non-finite ones."""
    rows = [np.asarray(v, np.float64) if v else np.zeros(0) for v in vectors.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for at, r in enumerate(rows):
        if len(r):
            size = np.sqrt(r @ r)
            if 0 < size < np.inf:
                out[at, : len(r)] = r / size
    return out


def _vector_blocks(vectors: DataFrame, key: str, vector: str, group: str | None, size: int) -> DataFrame:
    """keys, groups, dim, matrix: usable vectors in blocks of `size`, as bytes."""
    kinds = [f"{vectors.schema[c].dataType.simpleString()}" for c in (key, group) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                m = _matrix(some.column(some.num_columns - 1))
                live = np.flatnonzero(m.any(1))
                columns = [pa.array([some.column(i).take(pa.array(live)).to_pylist()], pa.list_(some.column(i).type)) for i in range(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([m.shape[1]], pa.int32()), pa.array([m[live].tobytes()], pa.binary())], names=names)

    names = ["keys", *(["groups"] if group else []), "dim", "matrix"]
    schema = ", ".join(f"{n} array<{k}>" for n, k in zip(names, kinds)) + ", dim int, matrix binary"
    return vectors.select(key, *([group] if group else []), F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def nearest(vectors: DataFrame, asked: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """query_id, key, (group,) score: for every asked vector (query_id, q) at least its k best by exact cosine, of each group if there is one.

    Blocks of vectors meet blocks of questions, never row by row. A pair of blocks
    keeps the k best of each question and all that tie with them to nine places, so
    ranks taken over the result are exact. Null, zero and non-finite vectors have no
    neighbours.
    """
    worker_path(vectors.sparkSession)
    left = _vector_blocks(vectors, key, vector, group, VECTOR_BLOCK)
    right = materialise(_vector_blocks(asked, "query_id", "q", None, QUERY_BLOCK), "asked").select(F.col("keys").alias("queries"), F.col("dim").alias("asked_dim"), F.col("matrix").alias("asked_matrix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(i)[n] for i, name in enumerate(batch.schema.names)}
                keys, queries = row["keys"].values, row["queries"].values
                if not len(keys) or not len(queries):
                    continue
                a, b = (np.frombuffer(row[m].as_py()).reshape(-1, row[d].as_py()) for m, d in (("matrix", "dim"), ("asked_matrix", "asked_dim")))
                if a.shape[1] != b.shape[1]:
                    raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} places cannot be compared")
                scores = a @ b.T
                rounded = np.round(scores, 9)
                codes = row["groups"].values.dictionary_encode() if group else None
                of = codes.indices.fill_null(-1).to_numpy() if group else np.zeros(len(keys), np.int64)
                at, to = [], []
                for g in np.unique(of):
                    mine = np.flatnonzero(of == g)
                    least = np.partition(rounded[mine], max(len(mine) - k, 0), axis=0)[max(len(mine) - k, 0)]
                    i, j = np.nonzero(rounded[mine] >= least)
                    at.append(mine[i])
                    to.append(j)
                at, to = np.concatenate(at), np.concatenate(to)
                columns = [queries.take(pa.array(to)), keys.take(pa.array(at)), *([row["groups"].values.take(pa.array(at))] if group else []), pa.array(scores[at, to])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", key, *([group] if group else []), "score"])

    fields = [f"query_id {asked.schema['query_id'].dataType.simpleString()}", *(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in (key, group) if c), "score double"]
    return left.crossJoin(right).mapInArrow(run, ", ".join(fields))


@lru_cache(maxsize=BUCKETS)
def _bucket(term: str, dim: int) -> tuple[int, float]:
    digest = hashlib.sha256(term.encode()).digest()
    return int.from_bytes(digest[:8], "big") % dim, 1.0 if digest[8] % 2 == 0 else -1.0


def hash_vectors(docs: DataFrame, dim: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, embedding: the hashing embedding of whole texts, as hash_buckets() defines it, in one pass."""
    worker_path(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXT_BLOCK):
                some = batch.slice(first, TEXT_BLOCK)
                out = np.zeros((some.num_rows, dim))
                for n, t in enumerate(some.column(1)):
                    tf = Counter(search_tokens(t.as_py()))
                    if tf:
                        at, sign = zip(*(_bucket(w, dim) for w in tf))
                        np.add.at(out[n], list(at), np.array(sign) * (1.0 + np.log(list(tf.values()))))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * dim, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), flat], names=[key, "embedding"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def hash_buckets(index: DataFrame, dim: int, key: str = "doc_id") -> DataFrame:
    """key, bucket, weight: the hashing embedding of postings, before normalisation.

    The bucket is the first 8 bytes of the term's SHA-256 modulo dim, the sign the
    low bit of the next byte, the weight 1 + ln(tf).
    """
    digest = F.sha2(F.col("term").cast("binary"), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    sign = F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    rows = index.select(key, (number % F.lit(dim)).cast("int").alias("bucket"), (sign * (F.lit(1.0) + F.log("tf"))).alias("w"))
    return rows.groupBy(key, "bucket").agg(F.sum("w").alias("weight"))


def query_profile(query: Column) -> Column:
    """The class of a question, by its wording."""
    return F.when(query.rlike(EXACT_PATTERN), "exact_reference").when(query.rlike(ASPECT_PATTERN), "multi_aspect").otherwise("semantic")


def profile_weights() -> Column:
    """Map of profile -> map of channel -> weight."""
    entry = lambda w: F.create_map(*(x for c, v in w.items() for x in (F.lit(c), F.lit(v))))
    return F.create_map(*(x for p, w in PROFILES.items() for x in (F.lit(p), entry(w))))


def first_positions(ranked: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Of repeated rows of a channel the first position, and positions closed up."""
    group = [k for k in keys if k != "unit_id"]
    first = ranked.groupBy(*keys).agg(F.min(rank).alias(rank))
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(rank, "unit_id")).cast("long"))


def rrf(ranked: DataFrame, query: str = "query_id", key: str = "unit_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query, channel, key, rank): query, key, score, channels."""
    return ranked.groupBy(query, key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("channel")).alias("channels"))


def weighted_rrf(ranked: DataFrame, profile: str = "profile", query: str = "query_id", key: str = "unit_id", k: int = RRF_K) -> DataFrame:
    """As rrf(), each channel weighted by the row's profile; groups by the profile too."""
    weight = F.element_at(F.element_at(profile_weights(), F.col(profile)), F.col("channel"))
    fused = ranked.groupBy(query, profile, key).agg(F.sum(F.coalesce(weight, F.lit(0.0)) / (F.lit(k) + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("channel")).alias("channels"))
    order = Window.partitionBy(query, profile).orderBy(F.round("score", 12).desc(), key)
    return fused.withColumn("fusion_rank", F.row_number().over(order).cast("long"))


def rerank_order(units: DataFrame, query: str = "query_id") -> DataFrame:
    """Units ordered by rerank score, then score, then id."""
    order = Window.partitionBy(query).orderBy(F.col("rerank_score").desc(), F.col("score").desc(), "unit_id")
    return units.withColumn("rank", F.row_number().over(order).cast("long"))


def page_groups(units: DataFrame, query: str = "query_id", page: str = "page_id") -> DataFrame:
    """Pages of ranked units: score by their first unit, and the ordered union of their channels."""
    rows = units.groupBy(query, page).agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct("rank", "channels"))).alias("parts"))
    return rows.select(query, page, (F.lit(1.0) / (F.lit(RRF_K) + F.col("first_rank"))).alias("score"), F.array_distinct(F.flatten(F.transform("parts", lambda p: p["channels"]))).alias("channels"))


def merge_queries(hits: DataFrame, page: str = "page_id") -> DataFrame:
    """Hits of several queries as one list: best score, queries in order, channels."""
    rows = hits.groupBy(page).agg(F.max("score").alias("score"), F.sort_array(F.collect_set("query_id")).alias("queries"), F.flatten(F.collect_list("channels")).alias("channels"))
    return rows.withColumn("channels", F.sort_array(F.array_distinct("channels")))


def candidate_trace(units: DataFrame, query: str = "query_id") -> DataFrame:
    """Per query: candidates, reranked and unscored ones, and candidates per channel; no text."""
    rows = units.groupBy(query).agg(F.count("*").alias("candidates"), F.count("rerank_score").alias("reranked"), *(F.count(F.when(F.array_contains("channels", c), 1)).alias(f"n_{c}") for c in ("bm25", "vector", "catalog")))
    return rows.withColumn("unscored", F.col("candidates") - F.col("reranked"))


def relevance(matches: DataFrame, terms: DataFrame, pages: DataFrame) -> DataFrame:
    """page, score: share of the question's inverse-frequency mass that a page matches.

    matches: page, term, where ('text' or 'category'), distinct; terms: term,
    subject. The subject's share counts 0.82, that of all terms 0.15, and the
    category's 0.03. Of `pages` only the number counts.
    """
    counts = matches.where("where = 'text'").groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(counts, "term", "left").crossJoin(F.broadcast(pages.agg(F.count("*").alias("n"))))
    weighed = known.withColumn("mass", F.log(F.lit(1.0) + (F.col("n") + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5)))
    totals = weighed.agg(F.sum("mass").alias("total"), F.sum(F.when(F.col("subject"), F.col("mass"))).alias("subject_total"))
    rows = matches.join(weighed.select("term", "subject", "mass"), "term").crossJoin(F.broadcast(totals))
    text = F.col("where") == "text"
    part = F.when(text & F.col("subject"), 0.82 * F.col("mass") / F.col("subject_total")).otherwise(0.0) + F.when(text, 0.15 * F.col("mass") / F.col("total")).otherwise(0.03 * F.col("mass") / F.col("total"))
    return rows.groupBy("page").agg(F.sum(part).alias("score"))
