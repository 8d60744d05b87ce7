"""Importance resampling towards a target distribution of hashed n-grams. DataFrame operations only.

Each document becomes the array of its features' buckets, by higher-order
functions, and is written once. Feature totals per bucket of the corpus and of the target are the
only things summed across tasks; they give every bucket a gain, and a document's
weight is an aggregate over its array that looks gains up in one literal array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.ordering import running_sums
from lodestone.session import materialise

BUCKETS = 10_000
#: Percent of the eligible documents that are drawn, and words that make one eligible.
SHARE, LEAST_WORDS = 5, 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, parted by all of ASCII but letters and digits; none in a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _UPPER.lower() + " " * len(_MARKS))
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def bucketed(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """keep, n_words and buckets: those of all runs of one to three words, repeats included."""
    first = lambda name, n: F.slice(name, 1, F.greatest(F.size("w") - n, F.lit(0)))
    after = lambda n: F.slice("w", n + 1, F.greatest(F.size("w") - n, F.lit(0)))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    bucket = lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("short")
    rows = docs.select(*keep, words(text).alias("w"))
    rows = rows.withColumn("pairs", F.zip_with(first("w", 1), after(1), joined))
    rows = rows.withColumn("triples", F.zip_with(first("pairs", 2), after(2), joined))
    return rows.withColumn("n_words", F.size("w").cast("long")).withColumn("buckets", F.concat(*(F.transform(c, bucket) for c in ("w", "pairs", "triples")))).drop("w", "pairs", "triples")


def totals(rows: DataFrame) -> dict[int, int]:
    """bucket -> features, of at most BUCKETS buckets; counted inside tasks first."""
    counts = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    s, t = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1.0) * (s + float(BUCKETS)) / ((corpus.get(b, 0) + 1.0) * (t + float(BUCKETS)))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)]


def noise(key: Column, seed: int = 42) -> Column:
    """A Gumbel draw in thousandths, rounded down, from 32 bits of a SHA-256 of seed and key (a null key: the text 'null')."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight, score, rank of every row; rank is null where a row isn't drawn.

    share percent of the rows of least_words words or more are drawn, by highest
    score; ties go to the smaller key, null keys last, and rows equal in both are
    ranked in any order. Null and empty texts have no features and weight 0. Other
    columns are not read, an empty table gives none; with an empty target all its
    counts are zero.
    """
    held = materialise(bucketed(docs, F.col(text), F.col(key).alias("key")), "buckets")
    table = gains(totals(held), totals(bucketed(target, F.col(target_text))))
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")  # folded into one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b.cast("int") + 1))
    rows = held.select("key", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    rows = materialise(rows.withColumn("score", F.col("weight") + noise(F.col("key"))), "scores")
    able = F.col("n_words") >= least_words
    n = rows.where(able).count()
    drawn = share * n // 100
    # A quantile, known to a thousandth, spares sorting what lies far below the cut; if it is off, everything is sorted.
    near = rows.where(able).agg(F.percentile_approx("score", max(0.0, 1 - share / 100 - 0.002), 1000).alias("cut")).first()["cut"]
    high = able & (F.col("score") >= F.lit(near)) if near is not None else able
    if rows.where(high).count() < drawn:
        high = able
    ranked = running_sums(rows.where(high), [F.col("score").desc(), F.col("key").asc_nulls_last()], {"place": F.lit(1)})
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")).drop("place")
    out = ranked.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def resample_sql(share: int = SHARE, least_words: int = LEAST_WORDS) -> str:
    """resample() of documents towards benchmark as DuckDB SQL. CRC-32 goes byte by byte, in steps of a table."""
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = lambda name: f"SELECT row, array_to_string(w[i:i + k], ' ') AS s FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM {name}, (SELECT unnest(range(3)) AS k))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {found} AS w FROM documents),
b AS (SELECT row_number() OVER () AS row, {found} AS w FROM benchmark),
dg AS ({grams("d")}), bg AS ({grams("b")}),
steps AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, n: xor(c >> 1, 3988292384 * (c & 1)))) AS step),
bytes AS MATERIALIZED (SELECT s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM (SELECT s FROM dg UNION SELECT s FROM bg)),
crc AS MATERIALIZED (SELECT s, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, step[1 + (xor(c, x) & 255)]))) % {BUCKETS} AS bucket FROM bytes, steps),
dc AS (SELECT row, bucket FROM dg JOIN crc USING (s)),
s AS (SELECT bucket, count(*) AS s FROM dc GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bg JOIN crc USING (s) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weight AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dc JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN weight USING (row)),
ranked AS (SELECT *, CASE WHEN n_words >= {least_words} THEN row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= (SELECT {share} * count(*) // 100 FROM scored WHERE n_words >= {least_words}) THEN place END AS rank FROM ranked
"""
