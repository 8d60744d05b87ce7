"""The same decisions on streams: claims, idempotent replay, change feeds, outbox."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_requests(requests: DataFrame, identity: list[str], at: str = "at", window: str = "24 hours") -> DataFrame:
    """Requests without replays of the same identity inside the window; state lapses with the watermark."""
    return requests.withWatermark(at, window).dropDuplicatesWithinWatermark(identity)


def job_states(events: DataFrame, lease_seconds: int = 60) -> DataFrame:
    """job_id, worker, attempts, at for every claim that wins, from a stream of (job_id, worker, action, at).

    Actions are claim, heartbeat, done and fail. A claim wins if the job is not
    done and holds no live lease; a heartbeat of the lease's worker extends it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        worker, attempts, until, over = state.get if state.exists else (None, 0, 0.0, False)
        won = []
        for part in parts:
            for row in part.sort_values(["at", "worker"]).itertuples():
                at = row.at.timestamp()
                if row.action == "claim" and not over and at >= until:
                    worker, attempts, until = row.worker, attempts + 1, at + lease_seconds
                    won.append((key[0], worker, attempts, row.at))
                elif row.action == "heartbeat" and row.worker == worker and at < until:
                    until = at + lease_seconds
                elif row.action == "done" and row.worker == worker and at < until:
                    over = True
                elif row.action == "fail" and row.worker == worker and at < until:
                    until = 0.0
        state.update((worker, attempts, until, over))
        yield pd.DataFrame(won, columns=["job_id", "worker", "attempts", "at"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, worker string, attempts int, at timestamp", "worker string, attempts int, until double, over boolean", "append", GroupStateTimeout.NoTimeout)


def counts(events: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, late ones dropped after the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def dispatch(outbox: DataFrame, path: str, checkpoint: str):
    """Append an outbox stream to a Parquet sink, exactly once, and stop when it is drained."""
    return outbox.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
