"""Counters, histograms and gauges over attempts and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import queue_wait_ms

BUCKETS_MS = (0, 1_000, 5_000, 10_000, 30_000, 60_000)


def valid(v: Column) -> Column:
    """A histogram takes finite values that are not negative."""
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))


def counter(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(rows: DataFrame, value: Column, *labels: str, buckets: tuple[int, ...] = BUCKETS_MS) -> DataFrame:
    """Observations by label and bucket; ``at_least`` is the bucket's lower bound."""
    lower = F.array_max(F.filter(F.array(*[F.lit(float(b)) for b in buckets]), lambda b: b <= value))
    return rows.where(valid(value)).groupBy(*labels, lower.alias("at_least")).agg(F.count("*").alias("observations"), F.sum(value).alias("total"))


def queue_wait(jobs: DataFrame) -> DataFrame:
    """Wait from enqueue to start by queue: count, mean, median and 95th percentile."""
    ms = queue_wait_ms(F.col("start_time"), F.col("enqueue_time")).cast("double")
    return jobs.where("start_time is not null").groupBy("queue_name").agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.percentile(ms, 0.5).alias("p50_ms"), F.percentile(ms, 0.95).alias("p95_ms"))


def processed(attempts: DataFrame, *labels: str) -> DataFrame:
    """Attempts and their duration by queue, runner (where the attempts have one) and outcome, with totals under null."""
    labels = labels or tuple(c for c in ("queue_name", "runner", "outcome") if c in attempts.columns)
    return attempts.where(valid(F.col("duration_ms"))).rollup(*labels).agg(F.count("*").alias("attempts"), F.sum("duration_ms").alias("duration_ms"), F.grouping_id().cast("long").alias("level"))


def enqueued(answers: DataFrame) -> DataFrame:
    """Enqueues by queue and result, from (queue_name, status)."""
    return counter(answers, "queue_name", "status")


def claim_attempts(heads: DataFrame) -> DataFrame:
    """Looked-at queue entries by queue and reason, from (queue_name, locked, missing): claimed, locked or missing; the first that holds of missing and locked."""
    reason = F.when(F.col("missing"), "missing").when(F.col("locked"), "locked").otherwise("claimed")
    return counter(heads.withColumn("reason", reason), "queue_name", "reason")


def fetched(claims: DataFrame) -> DataFrame:
    """Jobs fetched by queue."""
    return counter(claims, "queue_name")


def recovered(found: DataFrame) -> DataFrame:
    """One row: orphans that were queued again, of those that ``recover.orphans`` found."""
    return found.agg(F.count_if(F.col("action") == "requeue").alias("total"))


def pressure(requests: DataFrame, limit: int) -> DataFrame:
    """How full connections are when requests come, as a histogram of the share of ``limit`` in tenths: (conn, in_flight) to (at_least, observations)."""
    return requests.groupBy((F.floor(F.least(F.col("in_flight") / limit, F.lit(1.0)) * 10) / 10).alias("at_least")).agg(F.count("*").alias("observations"))


def expiries(rows: DataFrame) -> DataFrame:
    """Deadlines that had passed by runner, from (runner, expired)."""
    return counter(rows.where("expired"), "runner")


def cancellations(cancels: DataFrame) -> DataFrame:
    """Cancels by runner and scope: one request, or all of a job."""
    return counter(cancels.withColumn("scope", F.when(F.col("request_id").isNull(), "job").otherwise("request")), "runner", "scope")


def in_flight(attempts: DataFrame, by: str = "worker_id") -> DataFrame:
    """Running attempts after each start and end on one ``by``; ends come first at equal times."""
    edges = F.array(F.struct(F.col("start_ms").alias("ts_ms"), F.lit(1).alias("delta")), F.struct((F.col("start_ms") + F.col("duration_ms")).alias("ts_ms"), F.lit(-1).alias("delta")))
    # nearly all times differ, so nothing is grouped before the sort: a range takes equal times together, and the last of them stays
    times = Window.partitionBy(by).orderBy("ts_ms")
    rows = attempts.select(by, F.inline(edges)).select(by, "ts_ms", F.sum("delta").over(times.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("in_flight"), F.lead(F.struct("ts_ms")).over(times).alias("next"))
    return rows.where(F.col("next").isNull() | ~F.col("next.ts_ms").eqNullSafe(F.col("ts_ms"))).drop("next")


def runner_totals(attempts: DataFrame) -> DataFrame:
    """Attempts, mean and longest duration by runner (where the attempts have one), function and outcome."""
    labels = [c for c in ("runner", "function_name", "outcome") if c in attempts.columns]
    return attempts.groupBy(*labels).agg(F.count("*").alias("jobs"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"))


def spans(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a trace says of each attempt: job, queue, function, worker, outcome, wait, duration, the time left to the deadline, at least 0, and for a retry its delay.

    The delay is what the attempt asked for in ``retry_after_seconds``, if it has that column, in milliseconds.
    """
    j = jobs.select(F.col("id").alias("job_id"), "enqueue_time", "job_timeout_seconds")
    rows = attempts.join(j, "job_id", "left")
    left = F.greatest(F.lit(0.0), F.col("job_timeout_seconds") * 1000.0 - F.col("duration_ms"))
    asked = F.col("retry_after_seconds") if "retry_after_seconds" in attempts.columns else F.lit(None).cast("double")
    delay = F.when(F.col("outcome") == "retry", asked * 1000.0)
    return rows.select(delay.alias("retry_delay_ms"), "job_id", "attempt", "queue_name", "function_name", "worker_id", "outcome", queue_wait_ms(F.col("start_time"), F.col("enqueue_time")).alias("queue_wait_ms"), "duration_ms", left.alias("deadline_remaining_ms"))


def poll_cycles(polls: DataFrame) -> DataFrame:
    """Polls (free, fetched) by result: no_capacity, no_jobs or fetched."""
    return counter(polls.withColumn("result", F.when(F.col("free") <= 0, "no_capacity").when(F.col("fetched") == 0, "no_jobs").otherwise("fetched")), "result")
