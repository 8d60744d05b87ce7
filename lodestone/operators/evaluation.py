"""Evaluation of retrieval runs over span intervals, with unknown kept apart from failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def union_length(intervals: DataFrame, *key: str) -> DataFrame:
    """key, covered: length of the union of half-open intervals (start, end) per key."""
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(-1)))
    return rows.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).alias("covered"))


def span_hits(required: DataFrame, observed: DataFrame, identity: list[str]) -> DataFrame:
    """Parts of required spans that observed items show: equal identity, overlapping intervals.

    required: span_id, start, end; observed: rank, from, to; both the identity columns.
    """
    joined = required.join(observed, identity)
    rows = joined.select("span_id", "rank", F.col("start").alias("need_start"), F.col("end").alias("need_end"), F.greatest("start", "from").alias("start"), F.least("end", "to").alias("end"))
    return rows.where("start < end")


def coverage(required: DataFrame, hits: DataFrame) -> DataFrame:
    """span_id, required, covered, first_full_rank (null if never), code.

    The required span is cut at all ends of hits; a piece is seen from the least
    rank that covers it, and the span is full at the greatest of these.
    """
    points = hits.select("span_id", F.explode(F.array("start", "end")).alias("p")).unionByName(required.select("span_id", F.explode(F.array("start", "end")).alias("p"))).distinct()
    pieces = points.withColumn("q", F.lead("p").over(Window.partitionBy("span_id").orderBy("p"))).where("q is not null")
    seen = pieces.join(hits.select("span_id", "start", "end", "rank"), "span_id", "left").where("start is null or (start <= p and q <= end) or rank is not null")
    inside = (F.col("start") <= F.col("p")) & (F.col("q") <= F.col("end"))
    ranks = seen.groupBy("span_id", "p", "q").agg(F.min(F.when(inside, F.col("rank"))).alias("rank"))
    out = ranks.groupBy("span_id").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("q") - F.col("p")).otherwise(0)).alias("covered"), F.max("rank").alias("last"), F.bool_and(F.col("rank").isNotNull()).alias("full"))
    sized = required.select("span_id", (F.col("end") - F.col("start")).alias("required")).join(out, "span_id", "left")
    first = F.when(F.col("full"), F.col("last")).alias("first_full_rank")
    code = F.when(F.col("full"), F.lit(None)).when(F.col("covered") > 0, "SPAN_PARTIAL").otherwise("NO_MATCHING_SPAN").alias("code")
    return sized.select("span_id", "required", F.coalesce("covered", F.lit(0)).alias("covered"), first, code)


def group_ranks(spans: DataFrame) -> DataFrame:
    """case_id, group_id, critical, first_full_rank: an alternative needs all its spans, a group any alternative.

    spans: case_id, group_id, critical, alternative_id, first_full_rank.
    """
    whole = spans.groupBy("case_id", "group_id", "critical", "alternative_id").agg(F.when(F.bool_and(F.col("first_full_rank").isNotNull()), F.max("first_full_rank")).alias("rank"))
    return whole.groupBy("case_id", "group_id", "critical").agg(F.min("rank").alias("first_full_rank"))


def stage_results(expected: DataFrame, groups: DataFrame, stages: DataFrame) -> DataFrame:
    """One row per expected (case_id): status, n_groups, n_hit, recall, reciprocal rank, critical coverage.

    A missing or incomplete stage and a case without groups are UNKNOWN.
    expected: case_id; groups: group_ranks(); stages: case_id, complete.
    """
    per_case = groups.groupBy("case_id").agg(
        F.count("*").alias("n_groups"), F.count("first_full_rank").alias("n_hit"), F.sum(F.coalesce(F.lit(1.0) / F.col("first_full_rank"), F.lit(0.0))).alias("rr"),
        F.count(F.when(F.col("critical"), 1)).alias("n_critical"), F.count(F.when(F.col("critical") & F.col("first_full_rank").isNotNull(), 1)).alias("n_critical_hit"),
    )
    rows = expected.join(per_case, "case_id", "left").join(stages, "case_id", "left")
    known = F.coalesce(F.col("complete"), F.lit(False)) & (F.coalesce("n_groups", F.lit(0)) > 0)
    full = F.col("n_hit") == F.col("n_groups")
    return rows.select(
        "case_id", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.when(known & full, "PASS").when(known, "FAIL").otherwise("UNKNOWN").alias("status"),
        F.when(known, F.col("n_hit") / F.col("n_groups")).alias("recall"), F.when(known, F.col("rr") / F.col("n_groups")).alias("mean_rr"),
        F.when(known & (F.col("n_critical") > 0), F.col("n_critical") == F.col("n_critical_hit")).alias("critical_covered"),
    )


def status_fold(status: Column) -> Column:
    """Aggregate: FAIL if any fails, PASS if all pass and there are some, else UNKNOWN."""
    return F.when(F.bool_or(status == "FAIL"), "FAIL").when(F.bool_and(F.coalesce(status == "PASS", F.lit(False))), "PASS").otherwise("UNKNOWN")


def stage_summary(results: DataFrame, *by: str) -> DataFrame:
    """Macro and micro recall over known rows, unknown rows counted apart."""
    known = F.col("recall").isNotNull()
    return results.groupBy(*by).agg(
        status_fold(F.col("status")).alias("status"), F.count("*").alias("n_expected"), F.count("recall").alias("n_known"), F.count(F.when(~known, 1)).alias("n_unknown"), F.avg("recall").alias("macro_recall"),
        (F.sum(F.when(known, F.col("n_hit"))) / F.sum(F.when(known, F.col("n_groups")))).alias("micro_recall"), F.avg("mean_rr").alias("mean_rr"),
    )


def distribution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Expected, measured and unknown counts, and nearest-rank percentiles."""
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*by).agg(F.count("*").alias("n_expected"), F.count(value).alias("n_measured"), F.count(F.when(F.col(value).isNull(), 1)).alias("n_unknown"), pick(0.5).alias("p50"), pick(0.95).alias("p95"))


def paired_delta(pairs: DataFrame, before: str, after: str, *by: str) -> DataFrame:
    """Mean difference of comparable pairs and how many rose, fell or stayed; pairs with an unknown side are counted."""
    d = F.col(after) - F.col(before)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_expected"), F.count(d).alias("n_comparable"), F.avg(d).alias("mean_delta"), F.count(F.when(d > 0, 1)).alias("increased"), F.count(F.when(d < 0, 1)).alias("decreased"), F.count(F.when(d == 0, 1)).alias("unchanged"),
    )


def leaked(cases: DataFrame, seen: DataFrame) -> DataFrame:
    """family_id, code: holdout families that are also dev families, or that development has seen."""
    holdout = cases.where("split = 'holdout'").select("family_id").distinct()
    both = holdout.intersect(cases.where("split = 'dev'").select("family_id")).withColumn("code", F.lit("FAMILY_IN_BOTH_SPLITS"))
    used = holdout.intersect(seen.select("family_id")).withColumn("code", F.lit("HOLDOUT_FAMILY_USED_IN_DEVELOPMENT"))
    return both.unionByName(used)
