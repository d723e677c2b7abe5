"""What the outcome of an attempt does to a job: completion, retry with backoff, dead letter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import backoff, dlq_key, epoch_ms, from_ms, plus_seconds, runner_of
from jobtide.operators import sinks
from jobtide.operators.state import JobState
from jobtide.schemas import OUTCOMES
from jobtide.settings import Settings


def classify(status: Column, error_type: Column) -> Column:
    """success, retry, timeout, error, or fatal for a missing handler and a failed precheck, which no retry can mend."""
    return F.when(status.isin("success", "retry", "timeout"), status).when(error_type.isin("handler_not_found", PRECHECK), "fatal").otherwise("error")


#: The error type of an attempt that was not sent to a runner.
PRECHECK = "precheck"


def message(kind: Column, given: Column, timeout: Column) -> Column:
    """The given message, or what the kind says without one."""
    default = (
        F.when(kind == "retry", "Job requested retry").when(kind == "timeout", F.concat(F.lit("Job timed out after "), timeout.cast("string"), F.lit("s."))).when(kind == "fatal", "Handler not found").otherwise("Job failed")
    )
    return F.coalesce(given, default)


def prechecked(jobs: DataFrame, runners: list[str]) -> DataFrame:
    """Jobs (function_name, runner, job_timeout_seconds) with ``problem``: why an attempt cannot be sent to its runner, null if it can."""
    _, handler = runner_of(F.col("function_name"))
    timeout = F.col("job_timeout_seconds")
    problem = (
        F.when(timeout <= 0, F.concat(F.lit("Invalid job timeout: "), timeout.cast("string"), F.lit(". Must be positive.")))
        .when(handler == "", "Handler name is missing")
        .when(~F.col("runner").isin(*runners), F.concat(F.lit("No runner configured for '"), "runner", F.lit("'.")))
    )
    return jobs.withColumn("problem", problem)


def refused(prechecks: DataFrame) -> DataFrame:
    """The outcomes of jobs (id, problem) whose precheck failed, as ``transitions`` takes them."""
    none = F.lit(None).cast("string")
    return prechecks.where("problem is not null").select(F.col("id").alias("job_id"), F.lit("error").alias("status"), F.lit(PRECHECK).alias("error_type"), F.col("problem").alias("error_message"), none.alias("result"), F.lit(None).cast("double").alias("retry_after_seconds"))


def transitions(jobs: DataFrame, outcomes: DataFrame, now: Column, s: Settings) -> DataFrame:
    """The changed fields of each job (id) with an outcome (job_id, status, error_type, error_message, result, retry_after_seconds).

    A retry or error has budget while retries + 1 < max_retries; then the job waits for retry_after_seconds or the backoff. Without budget, and
    after a timeout or fatal error, it fails and goes to its dead-letter list. A success lasts for the job's lifetime of results or the default (0: for good, negative: as
    long as before), a dead letter for its own.
    """
    o = outcomes.select(F.col("job_id").alias("id"), classify(F.col("status"), F.col("error_type")).alias("kind"), F.col("error_message").alias("given"), F.col("result").alias("new_result"), "retry_after_seconds")
    rows = jobs.join(o, "id")
    retries = F.col("current_retries") + 1
    again = F.col("kind").isin("retry", "error") & (retries < F.col("max_retries"))
    ok = F.col("kind") == "success"
    ttl = F.coalesce("result_ttl_seconds", F.lit(s.default_result_ttl_seconds))
    old = F.col("expires_at") if "expires_at" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    delay = F.when(F.col("kind") == "retry", F.coalesce("retry_after_seconds", backoff(retries, s.base_retry_delay_seconds, s.max_retry_delay_seconds))).otherwise(backoff(retries, s.base_retry_delay_seconds, s.max_retry_delay_seconds))
    due = epoch_ms(now) + F.floor(delay * 1000)
    return rows.select(
        "id", "kind",
        F.when(ok, "COMPLETED").when(again, "RETRYING").otherwise("FAILED").alias("status"),
        F.when(ok, F.col("current_retries")).otherwise(retries).alias("current_retries"),
        F.when(ok, F.col("last_error")).otherwise(message(F.col("kind"), F.col("given"), F.coalesce("job_timeout_seconds", F.lit(s.default_job_timeout_seconds)))).alias("last_error"),
        F.when(ok, F.col("new_result")).otherwise(F.col("result")).alias("result"),
        F.when(again, F.lit(None)).otherwise(now).alias("completion_time"),
        F.when(again, from_ms(due)).otherwise(F.col("next_scheduled_run_time")).alias("next_scheduled_run_time"),
        F.when(again, due.cast("double")).alias("score_ms"),
        "queue_name", "job_unique_key",
        F.when(~ok & ~again, dlq_key(F.coalesce("dlq_name", F.lit(s.default_dlq_name)))).alias("to_dlq"),
        F.when(ok, F.when(ttl > 0, plus_seconds(now, ttl)).when(ttl < 0, old)).when(again, old).otherwise(plus_seconds(now, F.lit(s.dlq_ttl_seconds))).alias("expires_at"),
    )


def apply_outcomes(state: JobState, outcomes: DataFrame, now: Column, s: Settings) -> JobState:
    """The state after the outcomes: jobs, queue, dead letters, events; locks, active rows and unique keys of ended attempts are gone."""
    t = transitions(state.jobs, outcomes, now, s)
    changed = ["status", "current_retries", "last_error", "result", "completion_time", "next_scheduled_run_time", "expires_at"]
    old = state.jobs if "expires_at" in state.jobs.columns else state.jobs.withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    new = t.select("id", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in changed])
    jobs = old.join(new, "id", "left").select(*[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])
    ended = t.select(F.col("id").alias("job_id"))
    queue = sinks.queued(state, t.where("score_ms is not null").select("queue_name", F.col("id").alias("job_id"), "score_ms")).queue
    last = epoch_ms(now) * 1_000_000
    dlq = state.dlq.unionByName(t.where("to_dlq is not null").select(F.col("to_dlq").alias("dlq_name"), F.col("id").alias("job_id"), (last + F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("pushed_seq")))
    done = t.where("status in ('COMPLETED', 'FAILED')")
    out = state.with_(jobs=jobs, queue=queue, dlq=dlq, active=state.active.join(ended, "job_id", "left_anti").select(*state.active.columns), job_locks=state.job_locks.join(ended, "job_id", "left_anti"))
    if state.unique_locks is not None:
        out = out.with_(unique_locks=state.unique_locks.join(done.select(F.col("job_unique_key").alias("key")), "key", "left_anti"))
    if state.job_events is not None:
        out = out.with_(job_events=state.job_events.unionByName(done.select(F.col("id").alias("job_id"), F.lower("status").alias("event"), "status", now.alias("ts"))))
    return out


def past_deadline(rows: DataFrame, now: Column) -> DataFrame:
    """deadline, expired and the milliseconds left, at least 0, of (start_time, job_timeout_seconds)."""
    deadline = plus_seconds(F.col("start_time"), F.col("job_timeout_seconds"))
    return rows.withColumn("deadline", deadline).withColumns({"expired": F.col("deadline") <= now, "left_ms": F.greatest(F.lit(0).cast("long"), epoch_ms(F.col("deadline")) - epoch_ms(now))})


def cancelled(in_flight: DataFrame, cancels: DataFrame) -> DataFrame:
    """request_id of the in-flight requests (request_id, job_id) that a cancel names, by request or, without one, by job."""
    by_request = in_flight.join(cancels.where("request_id is not null").select("request_id"), "request_id", "left_semi")
    by_job = in_flight.join(cancels.where("request_id is null").select("job_id"), "job_id", "left_semi")
    return by_request.select("request_id", "job_id").unionByName(by_job.select("request_id", "job_id")).distinct()


def busy(events: DataFrame, limit: int = 64) -> DataFrame:
    """Which requests find ``limit`` others in flight on their connection: (conn, request_id, ts, busy) of each start.

    Events are (conn, ts, delta +1 for a start or -1 for an end, request_id); of equal times ends come first. A refused request is answered at once and
    never in flight, so its end does not count. A connection's events pass in order; only its requests in flight are held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = object(), set()
        for b in batches:
            out = []
            for conn, ts, delta, request in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conn != last:
                    last, running = conn, set()
                if delta < 0:
                    running.discard(request)
                else:
                    full = len(running) >= limit
                    if not full:
                        running.add(request)
                    out.append((conn, request, ts, full))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["conn", "request_id", "ts", "busy"])

    rows = events.select(F.col("conn").cast("string").alias("conn"), F.col("ts").cast("long").alias("ts"), F.col("delta").cast("int").alias("delta"), F.col("request_id").cast("string").alias("request_id"))
    return rows.repartition("conn").sortWithinPartitions("conn", "ts", "delta", "request_id").mapInArrow(fold, "conn string, request_id string, ts long, busy boolean")


def matched(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """request_id, state: answered, open (no response yet), mismatched (another job's), unknown (no such request) or failed.

    With a connection (conn) in both tables, a response without a request id fails every request that is still open on its connection.
    """
    named = responses.where("request_id is not null")
    r = named.select("request_id", F.col("job_id").alias("answer_job"), F.lit(True).alias("answered"))
    q = requests.select("request_id", "job_id", F.lit(True).alias("asked"), *[c for c in ("conn",) if c in requests.columns])
    state = F.when(F.col("asked").isNull(), "unknown").when(F.col("answered").isNull(), "open").when(F.col("answer_job") != F.col("job_id"), "mismatched").otherwise("answered")
    rows = q.join(r, "request_id", "full")
    if "conn" not in requests.columns or "conn" not in responses.columns:
        return rows.select("request_id", state.alias("state"))
    broken = responses.where("request_id is null").select("conn").distinct().withColumn("broken", F.lit(True))
    rows = rows.join(broken, "conn", "left").withColumn("state", state)
    return rows.select("request_id", F.when((F.col("state") == "open") & F.col("broken"), "failed").otherwise(F.col("state")).alias("state"))


def cleaned_up(state: JobState, ended: DataFrame) -> JobState:
    """After attempts (job_id, worker_id) have ended: their active rows go, and their locks where the worker still owns them."""
    mine = ended.select("job_id", F.col("worker_id").alias("owner"))
    return state.with_(active=state.active.join(ended.select("worker_id", "job_id"), ["worker_id", "job_id"], "left_anti").select(*state.active.columns), job_locks=state.job_locks.join(mine, ["job_id", "owner"], "left_anti").select(*state.job_locks.columns))


def right_version(requests: DataFrame, version: str = "2") -> DataFrame:
    return requests.withColumn("accepted", F.coalesce(F.col("protocol_version") == version, F.lit(False)))


def outcome(status: str, result: Column | None = None, message: str | None = None, kind: str | None = None, retry_after: float | None = None) -> Column:
    """An outcome as a struct: outcome("success", result), outcome("retry", message=..., retry_after=...), outcome("timeout", message=...), outcome("error", message=..., kind=...)."""
    if status not in OUTCOMES:
        raise ValueError(f"{status!r} is no outcome")
    error = F.struct(F.lit(message).alias("message"), F.lit(kind).alias("type"))
    return F.struct(F.lit(status).alias("status"), (F.lit(None).cast("string") if result is None else result).alias("result"), F.when(F.lit(message is not None or kind is not None), error).alias("error"), F.lit(retry_after).cast("double").alias("retry_after_seconds"))


def handler_not_found(name: Column) -> Column:
    return F.struct(F.concat(F.lit("No handler registered for function '"), name, F.lit("'")).alias("message"), F.lit("handler_not_found").alias("type"))
