"""Streaming twins of the admission rules. Event time must be a timestamp: cast naive times first, with the session in UTC."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "key string, seq long, ts timestamp, admitted boolean"


def rate_limited(requests: DataFrame, window_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """(key, seq, ts) of a stream with ``admitted``, by the leading-edge rule; the state of a key is the time at which it is free."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else -(1 << 62)
        # a key's requests of one micro-batch must be put in order: 16 bytes each are held
        rows = pd.concat([p[["seq", "ts"]] for p in parts]).sort_values(["ts", "seq"])
        admitted = []
        for us in rows["ts"].astype("datetime64[us, UTC]" if rows["ts"].dt.tz else "datetime64[us]").astype("int64"):
            free = us >= until
            if free:
                until = us + window_seconds * 1_000_000
            admitted.append(bool(free))
        state.update((until,))
        end = max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"], "ts": rows["ts"], "admitted": admitted})

    marked = requests.select("key", "seq", "ts").withWatermark("ts", lateness)
    return marked.groupBy("key").applyInPandasWithState(step, ADMITTED, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first request of each key within the watermark."""
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["key"])


def debounced(requests: DataFrame, window: str, lateness: str = "1 hour") -> DataFrame:
    """Runs of a key's requests; unlike the batch rule a request exactly at the end of the window still belongs to the run."""
    return requests.withWatermark("ts", lateness).groupBy("key", F.session_window("ts", window)).agg(F.count("*").alias("requests"), F.max("ts").alias("last_ts"), F.max_by("seq", "ts").alias("last_seq"))


def windowed(requests: DataFrame, width: str, lateness: str = "1 hour") -> DataFrame:
    return requests.withWatermark("ts", lateness).groupBy(F.window("ts", width), "function_name").agg(F.count("*").alias("requests"))


def completions(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Terminal events of a stream with what the job table knows of the job."""
    return events.where(F.col("status").isin("COMPLETED", "FAILED")).join(jobs.select(F.col("id").alias("job_id"), "function_name", "queue_name"), "job_id", "left")


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Burst mode: handle what is there in micro-batches, then stop. A sink must accept a batch again after a failure."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
