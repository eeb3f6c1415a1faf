"""Streaming forms: the outbox relay, job states and metric counters.

State is bounded by what is open: jobs that ended time out of the state, deduplication ends behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.operators.retrieval import ATTEMPTS


def relay_stream(outbox: DataFrame, jobs_path: str, checkpoint: str, delay: str = "1 day"):
    """Drain what has arrived (outbox: tenant_id, idempotency_key, kind, created_at) to jobs, each key once within the watermark.

    Delivery is at least once: a batch that is run again writes its folder again, and the folder is named by the batch.
    """
    fresh = outbox.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["tenant_id", "idempotency_key"])

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{jobs_path}/batch={batch}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_stream(events: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """job_id, status, attempts after each batch of events (job_id, ord, event): the fold of ``ingestion.job_states`` with its state kept."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("none", 0)
        for kind in pd.concat(frames).sort_values(["ord", "event"])["event"]:
            if kind == "enqueue" and status == "none":
                status = "queued"
            elif kind == "lease" and status == "queued":
                status = "leased"
            elif kind == "fail" and status != "none":
                n += 1
                status = "dead_letter" if n >= most else "queued"
            elif kind == "complete" and status != "none":
                status = "completed"
        state.update((status, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [n]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)


def counter_stream(events: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Totals of metric events (at, name, value) by window; rows later than delay behind the newest are dropped."""
    return events.withWatermark("at", delay).groupBy(F.window("at", window).alias("window"), "name").agg(F.sum("value").alias("total")).select("window.start", "name", "total")
