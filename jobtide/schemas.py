"""Schemas of the job tables. Times are naive UTC timestamps; every table with a lifetime carries ``expires_at``."""

from __future__ import annotations

from pyspark.sql import types as T

# The states of a job, and the outcomes of an attempt.
STATUSES = ("PENDING", "ACTIVE", "COMPLETED", "FAILED", "RETRYING", "CANCELLED")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
OUTCOMES = ("success", "retry", "timeout", "error")

_TIME = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_MAP = T.MapType(_S, _S)

JOB = _struct(
    id=_S, function_name=_S, job_params=_S, enqueue_time=_TIME, start_time=_TIME, status=_S, current_retries=_L, next_scheduled_run_time=_TIME, max_retries=_L, job_timeout_seconds=_L,
    result_ttl_seconds=_L, job_unique_key=_S, completion_time=_TIME, result=_S, last_error=_S, queue_name=_S, dlq_name=_S, worker_id=_S, trace_context=_MAP, correlation_context=_MAP,
)
QUEUE = _struct(queue_name=_S, job_id=_S, score_ms=_D)
JOB_LOCKS = _struct(job_id=_S, owner=_S, expires_at=_TIME)
UNIQUE_LOCKS = _struct(key=_S, job_id=_S, expires_at=_TIME)
GUARD_KEYS = _struct(kind=_S, key=_S, job_id=_S, expires_at=_TIME)
ACTIVE = _struct(worker_id=_S, job_id=_S, start_s=_D)
DLQ = _struct(dlq_name=_S, job_id=_S, pushed_seq=_L)
JOB_EVENTS = _struct(job_id=_S, event=_S, status=_S, ts=_TIME)
HEALTH = _struct(worker_id=_S, timestamp=_TIME, status=_S, active_jobs=_L, concurrency_limit=_L, queues=T.ArrayType(_S), expires_at=_TIME)
CRON = _struct(function_name=_S, schedule=_S, params=_S, queue_name=_S, unique=T.BooleanType())

ERROR = _struct(message=_S, type=_S, code=_S, details=_S)
CONTEXT = _struct(job_id=_S, attempt=T.IntegerType(), enqueue_time=_S, queue_name=_S, deadline=_S, trace_context=_MAP, correlation_context=_MAP, worker_id=_S)
REQUEST = _struct(protocol_version=_S, request_id=_S, job_id=_S, function_name=_S, params=_S, context=CONTEXT)
OUTCOME = _struct(job_id=_S, request_id=_S, status=_S, result=_S, error=ERROR, retry_after_seconds=_D)
CANCEL = _struct(protocol_version=_S, job_id=_S, request_id=_S, hard_kill=T.BooleanType())
ENQUEUE_OPTIONS = _struct(
    queue_name=_S, job_id=_S, unique_key=_S, unique_ttl_seconds=_D, max_retries=_L, job_timeout_seconds=_L, result_ttl_seconds=_L, enqueue_time=_S, defer_until=_S, defer_by_seconds=_D, rate_limit_key=_S,
    rate_limit_seconds=_D, debounce_key=_S, debounce_seconds=_D, trace_context=_MAP,
)
ENQUEUE_REQUEST = _struct(mode=_S, function_name=_S, params=_S, options=ENQUEUE_OPTIONS)
