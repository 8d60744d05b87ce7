"""Mixing sources to target weights. DataFrame operations only.

Every row gets a hash-random key. Rows are sorted by it in ranges within their
source, running sums of their sizes are taken, and each source is cut at its
budget: as many whole epochs as fit, and of one more the rows in front of the cut;
the row on the cut gives the words that are still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.ordering import running_sums
from lodestone.session import materialise

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Epochs of a source, at most.
EPOCHS = 3
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; none in a null one."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))).cast("long")


def random_key(key: Column, text: Column) -> Column:
    """52 bits of an MD5 of key and text: the same in every run, and spread over rows that share a key."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """nil, name, source_size, target, budget (whole words of the target) of sources (nil, name, source_size).

    The sum of all sizes is shared by weight; a target stops at `epochs` times its
    source's size and the excess is shared by weight among the others, until none
    is above. Sources are capped in the order of size over weight: one is, if the
    level (words for a unit of weight) that is left by those before it would take
    it to its cap. The first source that isn't capped has the level of the rest.
    """
    placed = running_sums(sources, [F.col("nil"), F.col("name")], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    capped = placed.select("nil", "name", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    capped = materialise(capped.withColumn("ratio", F.col("cap").cast("double") / F.col("weight")), "capped")
    summed = running_sums(capped, [F.col("ratio"), F.col("nil"), F.col("name")], {"caps": F.col("cap"), "held": F.col("weight")})
    whole = capped.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    left = summed.join(F.broadcast(whole)).select("cap", "weight", (F.col("all_size") - F.col("caps")).alias("words"), (F.col("all_weight") - F.col("held")).alias("shares"))
    level = left.where(F.col("weight") * (F.col("words") / F.col("shares")) < F.col("cap")).agg(F.max_by(F.struct("words", "shares"), F.col("words") / F.col("shares")).alias("level"))
    fair = F.col("weight").cast("double") * F.col("level.words") / F.col("level.shares")
    target = F.least(F.col("cap").cast("double"), F.coalesce(fair, F.col("cap").cast("double")))
    return capped.join(F.broadcast(level)).select("nil", "name", "source_size", target.alias("target"), F.floor(target).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size (words), source_size, target, taken (words that the mix takes, repeats counted): a row per input row.

    A null source is a source of its own, the last; null and empty texts have size
    0 and are taken 0 times; a source of size 0 has target 0 and its share goes to
    the others. Repeated rows and null keys are rows of their own, rows that agree
    in all of key, text and source are cut in any order. Other columns are not read; an empty table
    gives none. The words taken of a source are its target without the fraction.
    """
    rows = materialise(docs.select(
        F.col(key).alias("key"), F.col(source).isNull().alias("nil"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
        words(F.col(text)).alias("size"), random_key(F.col(key), F.col(text)).alias("draw"),
    ), "sizes")
    sources = materialise(rows.groupBy("nil", "name").agg(F.sum("size").alias("source_size")), "sources")
    found = running_sums(rows, [F.col("draw"), F.col("key"), F.col("size")], {"before": F.col("size")}, by=["nil", "name"], rest=targets(sources, weights, epochs))
    whole = F.expr("coalesce(budget div nullif(source_size, 0), 0)")
    part = F.expr("coalesce(budget % nullif(source_size, 0), 0)") - F.col("before")
    return found.select(
        F.col("key").alias(key), F.when(~F.col("nil"), F.col("name")).alias(source), "size", "source_size", "target",
        (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))).cast("long").alias("taken"),
    )


def mix_sql(weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> str:
    """mix() over documents as DuckDB SQL."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')), 1, 13))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {epochs} * source_size AS cap, {list(weights)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS weight FROM s),
r AS (
  SELECT weight, cap, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS words, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS shares
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max_by(words, words::DOUBLE / shares) AS words, max_by(shares, words::DOUBLE / shares) AS shares FROM r WHERE weight * (words::DOUBLE / shares) < cap),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight::DOUBLE * l.words::DOUBLE / l.shares::DOUBLE), cap::DOUBLE) AS target FROM w, l),
b AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CAST(coalesce(budget // nullif(source_size, 0), 0) * size + greatest(0, least(size, coalesce(budget % nullif(source_size, 0), 0) - before)) AS BIGINT) AS taken FROM b
"""
