"""Job queries: events are claims, requests and outbox rows; orders are jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import jobs as J
from lodestone.plans.registry import query
from lodestone.session import table

_JOBS = """j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state, o_orderdate AS created_at,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 10 DAY END AS lease_until, o_orderkey % 5 AS attempts, o_orderkey % 6 = 0 AS manual_retry_only FROM orders)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCEEDED")
    lease = F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("interval 10 days"))
    return table(spark, sf_dir, "orders").select(k.alias("job_id"), state.alias("state"), F.col("o_orderdate").alias("created_at"), lease.alias("lease_until"), (k % 5).alias("attempts"), (k % 6 == 0).alias("manual_retry_only"))


@query(f"""WITH {_JOBS}, c AS (SELECT event_id % 500 AS job_id, 'w' || user_id AS worker, ts AS at_ FROM events),
ok AS (SELECT c.*, attempts FROM c JOIN j USING (job_id) WHERE state IN ('QUEUED', 'RUNNING') AND (lease_until IS NULL OR lease_until <= at_) AND NOT (state = 'RUNNING' AND manual_retry_only))
SELECT job_id, worker, attempts + 1 AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_, worker) AS n FROM ok) WHERE n = 1""")
def job_claim_winner(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("job_id"), F.concat(F.lit("w"), "user_id").alias("worker"), F.col("ts").alias("at"))
    return J.claims(_jobs(spark, sf_dir), asked).select("job_id", "worker", "attempts")


@query(f"WITH {_JOBS} SELECT job_id FROM j WHERE state IN ('QUEUED', 'RUNNING') AND (lease_until IS NULL OR lease_until <= TIMESTAMP '1998-01-01') ORDER BY created_at, job_id LIMIT 500")
def recoverable_jobs(spark, sf_dir):
    return J.recoverable(_jobs(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")).select("job_id")


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 'CANCELLED' WHEN r THEN 'QUEUED' ELSE 'FAILED' END AS next_state, CASE WHEN r THEN [30, 120, 600][greatest(attempts, 1)] ELSE -1 END AS delay_s
FROM (SELECT *, job_id % 2 = 1 AND attempts <= 3 AND job_id % 10 <> 0 AND NOT manual_retry_only AND job_id % 9 <> 0 AS r FROM j)""")
def retry_state(spark, sf_dir):
    k = F.col("job_id")
    rows = _jobs(spark, sf_dir).select("*", (k % 2 == 1).alias("retryable"), (k % 10 == 0).alias("cancel_requested"), (k % 9 == 0).alias("billed"))
    return J.after_failure(rows).select("job_id", "next_state", F.coalesce("delay_s", F.lit(-1)).alias("delay_s"))


@query("SELECT user_id, event_type, count(DISTINCT props) AS n_hashes, count(*) AS n FROM events GROUP BY ALL HAVING count(DISTINCT props) > 1")
def idempotency_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("props", "request_hash")
    return J.conflicts(rows, ["user_id", "event_type"])


# A record opens with the first request of its identity that no record in force meets, and is in force for 24 hours.
@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts, props::JSON->>'k' AS h, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT user_id, event_type, ts, min(n) AS n FROM e GROUP BY ALL),
later AS MATERIALIZED (SELECT t.user_id, t.event_type, t.n, x.n AS opens FROM t ASOF JOIN t x ON t.user_id = x.user_id AND t.event_type = x.event_type AND t.ts + INTERVAL 24 HOUR <= x.ts),
record(user_id, event_type, n) AS (SELECT DISTINCT user_id, event_type, 1::BIGINT FROM e UNION ALL SELECT r.user_id, r.event_type, l.opens FROM record r JOIN later l USING (user_id, event_type, n)),
f AS (SELECT e.event_id, e.n, e.ts, e.h, r.n AS n0, o.h AS h0, o.ts AS t0 FROM e ASOF JOIN record r ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n >= r.n
  JOIN e o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.n = r.n)
SELECT event_id, CASE WHEN n = n0 THEN 'FIRST' WHEN h0 <> h THEN 'CONFLICT' WHEN t0 + INTERVAL 1 HOUR > ts THEN 'IN_PROGRESS' ELSE 'REPLAY' END AS outcome FROM f""")
def idempotent_replay(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("request_id"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").alias("request_hash"), (F.col("ts") + F.expr("interval 1 hour")).alias("done_at"))
    return J.idempotent(rows, ["user_id", "event_type"]).select(F.col("request_id").alias("event_id"), "outcome")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 4 = 1 GROUP BY event_type")
def outbox_pending(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("dispatched_at", F.when(F.col("event_id") % 4 != 1, F.col("ts")))
    return J.pending(rows).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS last_job, coalesce(max_by(event_id, (ts, event_id)) FILTER (event_type = 'purchase'), -1) AS last_forced FROM events GROUP BY user_id""")
def last_operation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("job_id"), F.col("ts").alias("updated_at"), F.lit("SUCCEEDED").alias("state"), (F.col("event_type") == "purchase").alias("forced"))
    return J.last_receipt(rows, "user_id").na.fill(-1)


@query("SELECT p_partkey AS version_id, CASE WHEN p_partkey % 11 = 0 THEN 'DROP' WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 4 <> 0 THEN 'SKIP' ELSE 'REBUILD' END AS action FROM part")
def index_plan(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    versions = part.where(k % 11 != 0).select(k.alias("version_id"), F.md5(F.col("p_name").cast("binary")).alias("signature"), F.col("p_size").alias("n_chunks"))
    receipts = part.where((k % 4 != 0) | (k % 11 == 0)).select(k.alias("version_id"), F.md5(F.when(k % 5 == 0, F.lit("old")).otherwise(F.col("p_name")).cast("binary")).alias("signature"), F.col("p_size").alias("n_chunks"), (k % 7 != 0).alias("ready"))
    return J.index_plan(versions, receipts)


@query("""WITH u AS (SELECT o_orderkey AS upload_id, count(*) AS n, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT upload_id, 'INCOMPLETE_UPLOAD' AS problem FROM u WHERE d <> hi UNION ALL SELECT upload_id, 'UPLOAD_INTEGRITY_FAILED' FROM u WHERE d = hi AND upload_id % 10 = 0""")
def upload_completeness(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("part_no")).distinct()
    uploads = items.groupBy("upload_id").agg(F.max("part_no").alias("part_count")).select("upload_id", (F.col("part_count") * 100).alias("declared_size"), F.lit(100).alias("part_size"), "part_count")
    parts = items.withColumn("size", F.when((F.col("upload_id") % 10 == 0) & (F.col("part_no") == 1), 99).otherwise(100))
    return J.upload_problems(uploads, parts)


@query("SELECT * FROM (SELECT 'positive' AS rule, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'segment', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3) WHERE n > 0")
def shape_violations(spark, sf_dir):
    ok = {"positive": F.col("c_acctbal") >= 0, "segment": ~((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 3)), "key": F.col("c_custkey") >= 0}
    return J.violations(table(spark, sf_dir, "customer"), **ok)


@query("SELECT p_partkey, 'left' AS side FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 6 <> 0 UNION ALL SELECT p_partkey, 'right' FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 4 <> 0")
def exact_set_match(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey")
    return J.symmetric_difference(part.where("p_partkey % 4 = 0"), part.where("p_partkey % 6 = 0"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(coalesce(o_orderkey % 97 <> 0, false)) AND bool_and(o_totalprice > 2000)")
def attestation_valid(spark, sf_dir):
    ok = J.all_of(F.col("o_orderkey") % 97 != 0, F.col("o_totalprice") > 2000)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(ok).alias("ok")).where("ok").select("o_custkey")
