"""Jobs, idempotency, outbox and receipts as batch decisions over their tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.constants import IDEMPOTENCY_HOURS, RECOVERY_BATCH, RETRY_DELAYS


def _lapsed(now: Column) -> Column:
    return F.col("lease_until").isNull() | (F.col("lease_until") <= now)


def claims(jobs: DataFrame, claims_: DataFrame, lease_seconds: int = 60) -> DataFrame:
    """job_id, worker, attempts, lease_until: the one claim that wins each claimable job.

    Claims are (job_id, worker, at). A job is claimable when queued or running
    without a live lease at that moment; a running job marked manual_retry_only
    isn't. The earliest claim wins, ties by worker.
    """
    asked = claims_.join(jobs, "job_id").where(F.col("state").isin("QUEUED", "RUNNING") & _lapsed(F.col("at")) & ~((F.col("state") == "RUNNING") & F.col("manual_retry_only")))
    won = asked.groupBy("job_id").agg(F.min(F.struct("at", "worker", "attempts")).alias("w"))
    return won.select("job_id", "w.worker", (F.col("w.attempts") + 1).alias("attempts"), (F.col("w.at") + F.expr(f"interval {int(lease_seconds)} seconds")).alias("lease_until"))


def recoverable(jobs: DataFrame, now: Column, limit: int = RECOVERY_BATCH) -> DataFrame:
    """The oldest jobs that are queued or running without a live lease."""
    return jobs.where(F.col("state").isin("QUEUED", "RUNNING") & _lapsed(now)).orderBy("created_at", "job_id").limit(limit)


def after_failure(jobs: DataFrame, delays: tuple[int, ...] = RETRY_DELAYS) -> DataFrame:
    """next_state and delay_s of a failed attempt.

    Cancelled jobs end; a retryable failure waits for its delay while attempts
    last, unless the job is for manual retry only or has billed requests.
    """
    retry = F.col("retryable") & (F.col("attempts") <= len(delays)) & ~F.col("cancel_requested") & ~F.col("manual_retry_only") & ~F.col("billed")
    delay = F.element_at(F.array(*map(F.lit, delays)), F.least(F.greatest(F.col("attempts"), F.lit(1)), F.lit(len(delays))).cast("int"))
    state = F.when(F.col("cancel_requested"), "CANCELLED").when(retry, "QUEUED").otherwise("FAILED")
    return jobs.withColumn("next_state", state).withColumn("delay_s", F.when(retry, delay))


def idempotent(requests: DataFrame, identity: list[str], hours: int = IDEMPOTENCY_HOURS) -> DataFrame:
    """outcome of every request: FIRST, REPLAY, CONFLICT or IN_PROGRESS.

    requests: identity columns, at, request_id, request_hash, done_at (null while
    running). A record opens with the first request of an identity that meets none,
    and lapses `hours` after it was opened; so a record that opens late moves all
    later ones. The requests of an identity are walked in order, in constant memory.
    """
    rows = requests.drop("outcome")
    span, names = hours * 3_600_000_000, rows.columns
    order = ["at", "request_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, opened, known, done = None, 0, None, None
        for batch in batches:
            column = lambda c: batch.column(names.index(c))
            micros = lambda c: column(c).cast(pa.timestamp("us", column(c).type.tz)).cast(pa.int64()).to_pylist()
            keys, out = zip(*(column(c).to_pylist() for c in identity)), []
            for key, at, sha, end in zip(keys, micros("at"), column("request_hash").to_pylist(), micros("done_at")):
                if key != who or at - opened >= span:
                    who, opened, known, done = key, at, sha, end
                    out.append("FIRST")
                else:
                    out.append("CONFLICT" if sha != known else "IN_PROGRESS" if done is None or done > at else "REPLAY")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "outcome"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*identity).sortWithinPartitions(*identity, *order).mapInArrow(run, f"{fields}, outcome string")


def conflicts(requests: DataFrame, identity: list[str]) -> DataFrame:
    """Identities that were used with more than one request hash."""
    return requests.groupBy(*identity).agg(F.countDistinct("request_hash").alias("n_hashes"), F.count("*").alias("n")).where("n_hashes > 1")


def pending(outbox: DataFrame) -> DataFrame:
    """Events not dispatched yet."""
    return outbox.where("dispatched_at is null")


def last_receipt(jobs: DataFrame, *by: str) -> DataFrame:
    """Per key the latest terminal job, by (updated_at, job_id), and the latest forced one."""
    key = F.struct("updated_at", "job_id")
    done = jobs.where(F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED"))
    return done.groupBy(*by).agg(F.max(key)["job_id"].alias("last_job"), F.max(F.when(F.col("forced"), key))["job_id"].alias("last_forced"))


def index_plan(versions: DataFrame, receipts: DataFrame) -> DataFrame:
    """What an incremental index run does with each version: SKIP, REBUILD, or DROP for those gone.

    versions: version_id, signature, n_chunks; receipts: version_id, signature, n_chunks, ready.
    """
    r = receipts.select("version_id", F.col("signature").alias("was"), F.col("n_chunks").alias("had"), "ready")
    rows = versions.join(r, "version_id", "full")
    same = F.col("ready") & (F.col("signature") == F.col("was")) & (F.col("n_chunks") == F.col("had"))
    return rows.select("version_id", F.when(F.col("signature").isNull(), "DROP").when(same, "SKIP").otherwise("REBUILD").alias("action"))


def upload_problems(uploads: DataFrame, parts: DataFrame) -> DataFrame:
    """upload_id, problem: uploads whose parts are not 1 to n, or whose sizes don't fit the declared ones.

    uploads: upload_id, declared_size, part_size, part_count; parts: upload_id, part_no, size.
    """
    rows = parts.join(uploads, "upload_id")
    want = F.when(F.col("part_no") < F.col("part_count"), F.col("part_size")).otherwise(F.col("declared_size") - (F.col("part_count") - 1) * F.col("part_size"))
    seen = rows.groupBy("upload_id").agg(F.countDistinct("part_no").alias("n"), F.min("part_no").alias("lo"), F.max("part_no").alias("hi"), F.sum("size").alias("total"), F.bool_or(F.col("size") != want).alias("odd"))
    out = uploads.join(seen, "upload_id", "left")
    whole = (F.col("n") == F.col("part_count")) & (F.col("lo") == 1) & (F.col("hi") == F.col("part_count"))
    problem = F.when(~F.coalesce(whole, F.lit(False)), "INCOMPLETE_UPLOAD").when(F.col("odd") | (F.col("total") != F.col("declared_size")), "UPLOAD_INTEGRITY_FAILED")
    return out.select("upload_id", problem.alias("problem")).where("problem is not null")


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """rule, n: how many rows break each rule (a null counts as broken); only broken rules appear."""
    broken = rows.agg(*(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()))
    table = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))
    return broken.select(F.explode(table).alias("r")).select("r.rule", "r.n").where("n > 0")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with side 'left' or 'right'; empty if both sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def all_of(*conditions: Column) -> Column:
    """Conjunction in which an unknown part makes the whole not hold."""
    return reduce(lambda x, y: x & y, (F.coalesce(c, F.lit(False)) for c in conditions))
