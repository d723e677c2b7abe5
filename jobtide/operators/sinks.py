"""Writes to the job tables: each takes tables and returns the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import dlq_key, epoch_ms, plus_seconds
from jobtide.operators.state import JobState, upsert
from jobtide.settings import Settings


def saved(state: JobState, jobs: DataFrame) -> JobState:
    """Whole job rows, in place of those with their ids; of several rows with an id the last by enqueue time stays, of equal times the greatest as JSON."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("enqueue_time"), F.to_json(F.struct(*jobs.columns)).desc()))
    return state.with_(jobs=upsert(state.jobs, jobs.withColumn("at", last).where("at = 1").drop("at"), "id"))


def queued(state: JobState, entries: DataFrame) -> JobState:
    """Queue entries (queue_name, job_id, score_ms): an entry that is there gets the new score."""
    one = entries.groupBy("queue_name", "job_id").agg(F.max("score_ms").alias("score_ms"))
    return state.with_(queue=upsert(state.queue, one, "queue_name", "job_id"))


def unqueued(state: JobState, entries: DataFrame) -> tuple[JobState, DataFrame]:
    """The state without the entries (queue_name, job_id), and those that were there."""
    keys = ["queue_name", "job_id"]
    gone = state.queue.join(entries.select(*keys).distinct(), keys, "left_semi")
    return state.with_(queue=state.queue.join(entries.select(*keys), keys, "left_anti")), gone


def with_results(state: JobState, results: DataFrame, now: Column) -> DataFrame:
    """Jobs with the results (id, result, ttl_seconds) saved: completed now; a positive lifetime sets the expiry, 0 makes the row last, a negative one leaves it as it is."""
    r = results.select("id", F.col("result").alias("new_result"), "ttl_seconds", F.lit(True).alias("hit"))
    rows = state.jobs.join(r, "id", "left")
    old = F.col("expires_at") if "expires_at" in state.jobs.columns else F.lit(None).cast("timestamp_ntz")
    expiry = F.when(F.col("hit") & (F.col("ttl_seconds") > 0), plus_seconds(now, F.col("ttl_seconds"))).when(F.col("hit") & (F.col("ttl_seconds") == 0), F.lit(None)).otherwise(old)
    new = {"result": F.col("new_result"), "status": F.lit("COMPLETED"), "completion_time": now}
    return rows.withColumn("expires_at", expiry).select(*[F.when(F.col("hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.jobs.columns if c != "expires_at"], "expires_at")


def dead(state: JobState, jobs: DataFrame, now: Column, s: Settings) -> JobState:
    """Jobs (id, error) moved to their dead-letter list with an event; their rows then last for ``dlq_ttl_seconds``."""
    e = jobs.select("id", F.col("error").alias("new_error"), F.lit(True).alias("hit"))
    old = state.jobs if "expires_at" in state.jobs.columns else state.jobs.withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    rows = old.join(e, "id", "left")
    new = {"status": F.lit("FAILED"), "last_error": F.col("new_error"), "completion_time": now, "expires_at": plus_seconds(now, F.lit(s.dlq_ttl_seconds))}
    hit = rows.where("hit")
    pushed = hit.select(dlq_key(F.coalesce("dlq_name", F.lit(s.default_dlq_name))).alias("dlq_name"), F.col("id").alias("job_id"), (epoch_ms(now) * 1_000_000 + F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("pushed_seq"))
    out = state.with_(jobs=rows.select(*[F.when(F.col("hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns]), dlq=state.dlq.unionByName(pushed))
    if state.job_events is not None:
        out = out.with_(job_events=state.job_events.unionByName(hit.select(F.col("id").alias("job_id"), F.lit("failed").alias("event"), F.lit("FAILED").alias("status"), now.alias("ts"))))
    return out


def undead(state: JobState, ids: DataFrame) -> JobState:
    """Removes the newest entry of each (dlq_name, job_id)."""
    keys = ["dlq_name", "job_id"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pushed_seq")))
    rows = state.dlq.withColumn("at", first).join(ids.select(*keys, F.lit(True).alias("hit")).distinct(), keys, "left")
    return state.with_(dlq=rows.where(F.col("hit").isNull() | (F.col("at") > 1)).select(*state.dlq.columns))


def tracked(state: JobState, rows: DataFrame) -> JobState:
    return state.with_(active=upsert(state.active, rows, "worker_id", "job_id"))


def untracked(state: JobState, rows: DataFrame) -> JobState:
    return state.with_(active=state.active.join(rows, ["worker_id", "job_id"], "left_anti"))
