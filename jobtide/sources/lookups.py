"""Scans and lookups over the job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import epoch_ms, known_status, seconds_between
from jobtide.operators.state import JobState, by_glob, live
from jobtide.schemas import TERMINAL


def queue_names(state: JobState) -> DataFrame:
    return state.queue.select("queue_name").distinct()


def active_workers(state: JobState) -> DataFrame:
    return state.active.select("worker_id").distinct()


def live_workers(state: JobState, now: Column) -> DataFrame:
    return live(state.health, now).select("worker_id").distinct()


def keys_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(by_glob(df, column, pattern))


def deleted_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(~by_glob(df, column, pattern))


def lookup(state: JobState, ids: DataFrame) -> DataFrame:
    """Jobs by (at, id): every slot in the order asked for, missing jobs as nulls."""
    jobs = state.jobs.withColumn("found", F.lit(True))
    return ids.join(jobs, "id", "left").select("at", "id", F.coalesce("found", F.lit(False)).alias("found"), *[c for c in state.jobs.columns if c != "id"])


def statuses(state: JobState, ids: DataFrame) -> DataFrame:
    """status, result and last error as a producer sees them: what it doesn't know, cancelled included, is UNKNOWN."""
    seen = F.when(F.col("status") == "CANCELLED", "UNKNOWN").otherwise(known_status(F.col("status"), "UNKNOWN"))
    return state.jobs.join(ids.select("id"), "id", "left_semi").select("id", seen.alias("status"), "result", "last_error")


def completed_within(state: JobState, waits: DataFrame) -> DataFrame:
    """For (id, asked_at, timeout_s): whether the job reaches its end in time, and its status if so."""
    rows = waits.join(state.jobs.select("id", "status", "completion_time"), "id", "left")
    in_time = F.col("status").isin(*TERMINAL) & (F.col("completion_time").isNull() | (seconds_between(F.col("completion_time"), F.col("asked_at")) <= F.col("timeout_s")))
    return rows.select("id", F.coalesce(in_time, F.lit(False)).alias("done"), F.when(in_time, F.col("status")).alias("status"))


def sizes(state: JobState) -> DataFrame:
    """Entries by queue and by dead-letter list."""
    q = state.queue.groupBy(F.col("queue_name").alias("name")).agg(F.count("*").alias("n"))
    return q.unionByName(state.dlq.groupBy(F.col("dlq_name").alias("name")).agg(F.count("*").alias("n")))


def lock_ttls(state: JobState, now: Column) -> DataFrame:
    """Milliseconds left of each unique lock, at least 0."""
    return state.unique_locks.select("key", "job_id", F.greatest(F.lit(0).cast("long"), epoch_ms(F.col("expires_at")) - epoch_ms(now)).alias("ttl_ms"))


def job(state: JobState, job_id: str) -> DataFrame:
    """One job, typed; no row if there is none."""
    return state.jobs.where(F.col("id") == job_id)


def dead_letters(state: JobState) -> DataFrame:
    """Every dead-letter list from its newest push on: dlq_name, at (from 0), job_id."""
    order = Window.partitionBy("dlq_name").orderBy(F.desc("pushed_seq"), "job_id")
    return state.dlq.select("dlq_name", (F.row_number().over(order) - 1).cast("long").alias("at"), "job_id")


def active_jobs(state: JobState, worker_id: str | None = None) -> DataFrame:
    """The active ids of one worker, or of all, in the order of their start: worker_id, at (from 0), job_id."""
    rows = state.active if worker_id is None else state.active.where(F.col("worker_id") == worker_id)
    return rows.select("worker_id", (F.row_number().over(Window.partitionBy("worker_id").orderBy("start_s", "job_id")) - 1).cast("long").alias("at"), "job_id")


def queued_or_not(state: JobState, asked: DataFrame) -> DataFrame:
    """(queue_name, job_id, queued) for each (queue_name, job_id) asked for."""
    there = state.queue.select("queue_name", "job_id", F.lit(True).alias("there")).distinct()
    return asked.join(there, ["queue_name", "job_id"], "left").select("queue_name", "job_id", F.coalesce("there", F.lit(False)).alias("queued"))


def lock_owners(state: JobState, ids: DataFrame, now: Column) -> DataFrame:
    """(job_id, owner) for each job_id asked for; a lock that has expired has no owner."""
    return ids.select("job_id").join(live(state.job_locks, now).select("job_id", "owner"), "job_id", "left")
