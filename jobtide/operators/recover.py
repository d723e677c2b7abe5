"""Recovery: jobs whose worker is gone, malformed records, released claims, worker health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import dlq_key, epoch_ms, known_status, plus_seconds, seconds_between
from jobtide.operators.state import JobState, live
from jobtide.schemas import JOB
from jobtide.settings import Settings


def orphans(state: JobState, now: Column, limit: int = 100) -> DataFrame:
    """What becomes of each active row whose worker sends no heartbeat and whose job holds no live lock.

    action is drop (job gone or at its end), pending (already queued) or requeue (with score_ms); at most ``limit`` rows, oldest first, are requeued.
    """
    lost = state.active.join(live(state.health, now).select("worker_id").distinct(), "worker_id", "left_anti")
    lost = lost.join(live(state.job_locks, now).select("job_id").distinct(), "job_id", "left_anti")
    jobs = state.jobs.select(F.col("id").alias("job_id"), "status", "queue_name", "next_scheduled_run_time")
    queued = state.queue.select("job_id").distinct().withColumn("queued", F.lit(True))
    rows = lost.join(jobs, "job_id", "left").join(queued, "job_id", "left")
    action = F.when(F.col("status").isNull() | ~F.col("status").isin("ACTIVE", "PENDING", "RETRYING"), "drop").when(F.col("queued"), "pending").otherwise("requeue")
    due = epoch_ms(F.coalesce("next_scheduled_run_time", now)).cast("double")
    rows = rows.select("worker_id", "job_id", "start_s", action.alias("action"), "queue_name", F.when(action == "requeue", due).alias("score_ms"))
    first = rows.where("action = 'requeue'").orderBy("start_s", "job_id").limit(limit)
    return rows.where("action != 'requeue'").unionByName(first)


def recover(state: JobState, now: Column, s: Settings) -> JobState:
    """The state after one round of orphan recovery."""
    found = orphans(state, now, s.orphan_recovery_limit)
    again = found.where("action in ('pending', 'requeue')").select(F.col("job_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    jobs = state.jobs.join(again, "id", "left")
    for c, v in (("status", F.lit("PENDING")), ("start_time", F.lit(None)), ("worker_id", F.lit(None))):
        jobs = jobs.withColumn(c, F.when(F.col("hit"), v).otherwise(F.col(c)))
    entries = found.where("action = 'requeue'").select("queue_name", "job_id", "score_ms")
    return state.with_(jobs=jobs.drop("hit"), queue=state.queue.unionByName(entries), active=state.active.join(found.select("worker_id", "job_id"), ["worker_id", "job_id"], "left_anti"))


def release(state: JobState, claims: DataFrame, now: Column) -> JobState:
    """Claims (job_id, owner) given back: where lock and job are still the owner's the job is pending and, if not queued, queued again; the lock and active row go in any case."""
    mine = claims.join(live(state.job_locks, now).select("job_id", "owner"), ["job_id", "owner"], "left_semi").select(F.col("job_id").alias("id"), F.col("owner").alias("worker_id"))
    owned = state.jobs.join(mine, ["id", "worker_id"], "left_semi").select("id", "queue_name")
    hit = owned.select("id").withColumn("hit", F.lit(True))
    jobs = state.jobs.join(hit, "id", "left")
    for c, v in (("status", F.lit("PENDING")), ("start_time", F.lit(None)), ("worker_id", F.lit(None))):
        jobs = jobs.withColumn(c, F.when(F.col("hit"), v).otherwise(F.col(c)))
    entries = owned.select("queue_name", F.col("id").alias("job_id"), epoch_ms(now).cast("double").alias("score_ms")).join(state.queue.select("job_id"), "job_id", "left_anti")
    return state.with_(
        jobs=jobs.drop("hit"), queue=state.queue.unionByName(entries), job_locks=state.job_locks.join(claims.select("job_id", "owner"), ["job_id", "owner"], "left_anti"),
        active=state.active.join(claims.select("job_id", F.col("owner").alias("worker_id")), ["job_id", "worker_id"], "left_anti"),
    )


def decoded(raw: DataFrame, s: Settings) -> DataFrame:
    """Text records as typed jobs: a record without a known status or a readable enqueue time is malformed; other fields fall back to their defaults or null.

    ``key_id`` names a record that lacks its id; fields that the table does not have are null.
    """
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    time = lambda c: F.try_to_timestamp(col(c)).cast("timestamp_ntz")
    long = lambda c: col(c).try_cast("long")
    maps = lambda c: F.from_json(col(c), "map<string,string>")
    typed = {
        "id": F.coalesce(col("id"), col("key_id")), "function_name": F.coalesce(col("function_name"), F.lit("")), "job_params": F.when(F.try_parse_json(col("job_params")).isNotNull(), col("job_params")).otherwise("{}"),
        "status": known_status(col("status")), "current_retries": F.coalesce(long("current_retries"), F.lit(0).cast("long")), "max_retries": F.coalesce(long("max_retries"), F.lit(s.default_max_retries).cast("long")),
        "job_timeout_seconds": long("job_timeout_seconds"), "result_ttl_seconds": long("result_ttl_seconds"), "result": F.when(F.lower(col("result")) != "null", col("result")), "trace_context": maps("trace_context"), "correlation_context": maps("correlation_context"),
    } | {c: time(c) for c in ("enqueue_time", "start_time", "next_scheduled_run_time", "completion_time")} | {c: col(c) for c in ("job_unique_key", "last_error", "queue_name", "dlq_name", "worker_id")}
    return raw.select(*[typed[c].alias(c) for c in JOB.names], (known_status(col("status")).isNull() | time("enqueue_time").isNull()).alias("is_malformed"))


def quarantined(jobs: DataFrame, s: Settings) -> DataFrame:
    """job_id, dlq_name and the unique key to free, of malformed records."""
    return jobs.where("is_malformed").select(F.col("id").alias("job_id"), dlq_key(F.coalesce("dlq_name", F.lit(s.default_dlq_name))).alias("dlq_name"), F.col("job_unique_key").alias("freed_key"))


def latest_heartbeats(beats: DataFrame) -> DataFrame:
    """The last heartbeat of each worker."""
    rest = [c for c in beats.columns if c != "worker_id"]
    return beats.groupBy("worker_id").agg(F.max_by(F.struct(*rest), "timestamp").alias("b")).select("worker_id", "b.*")


def heartbeat(beats: DataFrame, s: Settings) -> DataFrame:
    ttl = s.worker_health_check_interval_seconds + s.worker_health_check_ttl_buffer_seconds
    return beats.withColumn("expires_at", plus_seconds(F.col("timestamp"), F.lit(ttl)))


def drained(state: JobState, workers: DataFrame, now: Column) -> JobState:
    """When workers (worker_id) stop: what they still run is given back, as in ``release``."""
    running = state.active.join(workers.select("worker_id"), "worker_id", "left_semi").select("job_id", F.col("worker_id").alias("owner"))
    return release(state, running, now)


def health_report(state: JobState, now: Column) -> DataFrame:
    """A row for each live worker with its seconds left."""
    return live(state.health, now).select("worker_id", "status", "active_jobs", "concurrency_limit", F.array_join("queues", ",").alias("queues"), F.greatest(F.lit(0.0), seconds_between(F.col("expires_at"), now)).alias("ttl_s"))


def health_verdict(state: JobState, now: Column) -> DataFrame:
    """One row: verdict FAIL if no worker is alive, else OK, and how many are."""
    return live(state.health, now).agg(F.count_distinct("worker_id").alias("workers")).select(F.when(F.col("workers") == 0, "FAIL").otherwise("OK").alias("verdict"), "workers")


def invariants(state: JobState) -> DataFrame:
    """Broken rules, if any: a job with two lock owners, one entry twice in a queue, a job both queued and dead."""
    two = state.job_locks.groupBy("job_id").agg(F.count_distinct("owner").alias("n")).where("n > 1").select(F.lit("two owners").alias("rule"), "job_id")
    twice = state.queue.withColumn("n", F.count("*").over(Window.partitionBy("queue_name", "job_id"))).where("n > 1").select(F.lit("queued twice").alias("rule"), "job_id").distinct()
    both = state.queue.join(state.dlq.select("job_id"), "job_id", "left_semi").select(F.lit("queued and dead").alias("rule"), "job_id")
    return two.unionByName(twice).unionByName(both)
