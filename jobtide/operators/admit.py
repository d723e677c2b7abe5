"""Admission of enqueue requests: checks, defaults, and the keyed rules that depend on the order of requests.

Requests have seq (their order), key, ts, and what else they carry. Rules that must see a key's requests one by one run
over partitions sorted by key and time, with one key's state at a time: memory stays bounded however many requests a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.scalars import epoch_ms, from_ms, queue_key
from jobtide.operators.state import JobState, insert_new
from jobtide.settings import Settings

_FOLD = T.StructType([T.StructField("seq", T.LongType()), T.StructField("admitted", T.BooleanType()), T.StructField("leader", T.LongType()), T.StructField("until_ms", T.LongType()), T.StructField("refused", T.BooleanType())])


def leading_edge(requests: DataFrame, ttl_ms: Column, key: str = "key", held: DataFrame | None = None, blocked: Column | None = None) -> DataFrame:
    """Who takes a key: seq, admitted, leader, until_ms, refused for each request.

    A request is admitted if its key is free; it then holds the key for ``ttl_ms``. Others get the holder's seq as leader, and all
    get the time at which the key is free again. Keys in ``held`` (key, expires_at) are taken at the start, by no leader. A ``blocked`` request, one whose job
    cannot be made, leaves a free key free and is refused; a taken key answers it like any other.
    """
    rows = requests.select(F.col(key).alias("key"), epoch_ms(F.col("ts")).alias("ts_ms"), "seq", ttl_ms.cast("long").alias("ttl_ms"), (F.lit(False) if blocked is None else blocked).alias("blocked"))
    if held is not None:
        rows = rows.join(held.groupBy("key").agg(F.max(epoch_ms(F.col("expires_at"))).alias("held_ms")), "key", "left")
    else:
        rows = rows.withColumn("held_ms", F.lit(None).cast("long"))
    rows = rows.withColumn("held_ms", F.coalesce("held_ms", F.lit(-(1 << 62)))).repartition("key").sortWithinPartitions("key", "ts_ms", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until, leader = object(), 0, None
        for b in batches:
            out = []
            for k, ts, seq, ttl, held_ms, no in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != last:
                    last, until, leader = k, held_ms, None
                free = ts >= until
                if free and not no:
                    until, leader = ts + ttl, seq
                refused = free and no
                out.append((seq, free and not no, None if refused else leader, until, refused))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=_FOLD.names)

    return rows.select("key", "ts_ms", "seq", "ttl_ms", "held_ms", "blocked").mapInArrow(fold, _FOLD)


def idempotent(requests: DataFrame, ttl_seconds: int, deferral_seconds: Column | None = None, held: DataFrame | None = None, blocked: Column | None = None) -> DataFrame:
    """seq, job_seq, created: a request whose key is alive gets the job that took it; the key outlives a deferral, in whole seconds."""
    ttl = F.lit(ttl_seconds) if deferral_seconds is None else F.greatest(F.lit(ttl_seconds), F.ceil(deferral_seconds))
    return leading_edge(requests, ttl * 1000, held=held, blocked=blocked).select("seq", F.col("leader").alias("job_seq"), F.col("admitted").alias("created"))


def rate_limited(requests: DataFrame, window_seconds: float, held: DataFrame | None = None, blocked: Column | None = None) -> DataFrame:
    """seq, admitted, refused: the first request takes its key for the window, rounded up to whole seconds; others are turned away. A ``blocked`` one that would take it gives it back and is refused."""
    return leading_edge(requests, F.ceil(F.lit(window_seconds)) * 1000, held=held, blocked=blocked).select("seq", "admitted", "refused")


def rate_limit_status(admitted: Column, refused: Column | None = None) -> Column:
    status = F.when(admitted, "enqueued").otherwise("rate_limited")
    return status if refused is None else F.when(refused, "duplicate").otherwise(status)


#: What the last request of a run sets on its job. An absent trace leaves the one before, an absent correlation clears it.
OVERWRITTEN = ("function_name", "params", "max_retries", "job_timeout_seconds", "result_ttl_seconds", "queue_name", "correlation_context")


def _runs(requests: DataFrame, window_seconds: float, left_pending: DataFrame | None) -> DataFrame:
    """Requests with the number of their run within the key."""
    ttl = F.ceil(F.lit(window_seconds)) * 1000
    rows = requests.withColumn("leaves", F.lit(False))
    if left_pending is not None:
        rows = rows.unionByName(left_pending.select("key", F.col("at").alias("ts"), F.lit(True).alias("leaves")), allowMissingColumns=True)
    # at equal times a job leaves first: the request then finds it gone
    order = Window.partitionBy("key").orderBy("ts", F.desc("leaves"), "seq")
    ms = epoch_ms(F.col("ts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(~F.col("leaves"), ms)).over(before)
    left = F.max(F.when(F.col("leaves"), ms)).over(before)
    rows = rows.withColumns({"last": last, "left": left}).where(~F.col("leaves"))
    new = F.col("last").isNull() | (ms >= F.col("last") + ttl) | F.coalesce(F.col("left") > F.col("last"), F.lit(False))
    return rows.withColumn("run", F.sum(new.cast("int")).over(Window.partitionBy("key").orderBy("ts", "seq"))).drop("last", "left", "leaves")


def debounced(requests: DataFrame, window_seconds: float, left_pending: DataFrame | None = None) -> DataFrame:
    """One job for each run of a key's requests that follow each other within the window while the job is pending.

    key, job_seq (the first request), enqueue_time, last_seq, requests, scheduled (the last request plus the window), and what the last request sets
    (OVERWRITTEN, as far as the requests have it); trace_context is the last that any request gave. A request exactly at the end of the window
    starts a new run, as does one after a time in ``left_pending`` (key, at) at which the key's job was claimed or ended.
    """
    at = F.struct("ts", "seq")
    sets = [F.max_by(c, at).alias(c) for c in OVERWRITTEN if c in requests.columns]
    if "trace_context" in requests.columns:
        sets.append(F.max_by(F.col("trace_context"), F.when(F.col("trace_context").isNotNull(), at)).alias("trace_context"))
    out = _runs(requests, window_seconds, left_pending).groupBy("key", "run").agg(F.min_by("seq", at).alias("job_seq"), F.min("ts").alias("enqueue_time"), F.max_by("seq", at).alias("last_seq"), F.max("ts").alias("last_ts"), F.count("*").alias("requests"), *sets)
    return out.withColumn("scheduled", from_ms(epoch_ms(F.col("last_ts")) + F.lit(int(window_seconds * 1000)))).drop("run", "last_ts")


def debounce_entries(requests: DataFrame, window_seconds: float, left_pending: DataFrame | None = None) -> DataFrame:
    """queue_name, job_seq, score_ms of the queue rows that runs leave: a run that changes its queue has one in each, due by its last request there."""
    runs = _runs(requests, window_seconds, left_pending)
    first = F.min(F.struct("ts", "seq")).over(Window.partitionBy("key", "run"))["seq"]
    score = epoch_ms(F.col("ts")) + F.lit(int(window_seconds * 1000))
    return runs.select("queue_name", first.alias("job_seq"), score.cast("double").alias("score_ms")).groupBy("queue_name", "job_seq").agg(F.max("score_ms").alias("score_ms"))


def lock_ttl_seconds(timeout: Column, defer: Column, s: Settings) -> Column:
    """How long a unique key is held: the default, or as long as the job may run or is deferred."""
    run = F.coalesce(timeout, F.lit(s.default_job_timeout_seconds)) + s.default_lock_timeout_extension_seconds + 1
    return F.greatest(F.lit(s.default_unique_job_lock_ttl_seconds), run, F.coalesce(defer, F.lit(0)) + 1).cast("long")


def unique_deferred(requests: DataFrame, s: Settings, timeout: Column | None = None, defer: Column | None = None, held: DataFrame | None = None, blocked: Column | None = None) -> DataFrame:
    """seq, takes_lock, scheduled: a request whose unique key is held isn't dropped but scheduled for when it is free, or later if it asked so.

    The job of a ``blocked`` request is not made: a lock that it would take is released again.
    """
    timeout = F.lit(None).cast("long") if timeout is None else timeout
    defer = F.lit(0).cast("long") if defer is None else defer
    rows = leading_edge(requests, lock_ttl_seconds(timeout, defer, s) * 1000, held=held, blocked=blocked)
    wish = requests.select("seq", (epoch_ms(F.col("ts")) + F.coalesce(defer, F.lit(0)) * 1000).alias("wish_ms"))
    due = F.when(F.col("admitted") | F.col("refused"), F.col("wish_ms")).otherwise(F.greatest("wish_ms", "until_ms"))
    return rows.join(wish, "seq").select("seq", F.col("admitted").alias("takes_lock"), from_ms(due).alias("scheduled"))


def schedule(enqueue: Column, defer_until: Column, defer_by_seconds: Column) -> Column:
    """When a job is due: an absolute time beats a delay; a delay of 0 is none; milliseconds are rounded up."""
    delay = F.when(defer_by_seconds > 0, F.ceil(defer_by_seconds * 1000))
    return F.coalesce(defer_until, from_ms(epoch_ms(enqueue) + delay), enqueue)


def due(mode: Column, enqueue: Column, debounce_seconds: Column, defer_until: Column, defer_by_seconds: Column) -> Column:
    """When a request of a mode is due: a debounced one a window after it came, whatever deferral it asks for; others by ``schedule``."""
    return F.when(mode == "debounce", from_ms(epoch_ms(enqueue) + F.ceil(debounce_seconds * 1000))).otherwise(schedule(enqueue, defer_until, defer_by_seconds))


def mode(explicit: Column, rate_key: Column, debounce_key: Column) -> Column:
    """The explicit mode, else what the keys say; both keys at once are an error, given as null."""
    asked = F.when(explicit.isin("unique", "deferred"), "enqueue").otherwise(explicit)
    inferred = F.when(rate_key.isNotNull() & debounce_key.isNotNull(), None).when(rate_key.isNotNull(), "rate_limit").when(debounce_key.isNotNull(), "debounce").otherwise("enqueue")
    return F.coalesce(asked, inferred)


def rejection(function: Column, queue: Column, timeout: Column, ttl: Column, window: Column) -> Column:
    """Why a request is refused; null if it is not."""
    blank = lambda c: F.trim(c) == ""
    bad = lambda c: F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")) | (c < 0)
    return (
        F.when(function.isNull() | blank(function), "function_name cannot be empty")
        .when(blank(queue), "queue_name cannot be empty")
        .when(timeout <= 0, "job_timeout_seconds must be positive")
        .when(ttl <= 0, "ttl must be positive")
        .when(bad(window), "duration must be finite and not negative")
        .when(window == 0, "window must be positive")
    )


def enqueue(state: JobState, requests: DataFrame, s: Settings) -> tuple[JobState, DataFrame]:
    """Insert requests (id, function_name, params, ts, seq, queue_name or null): a known or repeated id is refused. Returns the new state and id, created."""
    flagged = insert_new(state.jobs.select("id"), requests, "id", "seq")
    new = flagged.where("created")
    filled = {
        "function_name": F.col("function_name"), "job_params": F.coalesce("params", F.lit("{}")), "enqueue_time": F.col("ts"), "status": F.lit("PENDING"), "current_retries": F.lit(0).cast("long"),
        "max_retries": F.lit(s.default_max_retries).cast("long"), "job_timeout_seconds": F.lit(s.default_job_timeout_seconds).cast("long"), "result_ttl_seconds": F.lit(s.default_result_ttl_seconds).cast("long"),
        "queue_name": queue_key(F.coalesce("queue_name", F.lit(s.default_queue_name))), "next_scheduled_run_time": F.col("ts"), "id": F.col("id"),
    }
    rows = new.select(*[(filled.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in state.jobs.schema.fields])
    entries = rows.select("queue_name", F.col("id").alias("job_id"), epoch_ms(F.col("enqueue_time")).cast("double").alias("score_ms"))
    return state.with_(jobs=state.jobs.unionByName(rows), queue=state.queue.unionByName(entries)), flagged.select("id", "seq", "created")


def produce(state: JobState, requests: DataFrame, s: Settings, held: DataFrame | None = None) -> tuple[JobState, DataFrame, DataFrame]:
    """The whole contract of an enqueue: (new state, answers, new keys).

    Requests have id, seq, ts, function_name, and, where given, params, queue_name, unique_key, unique_ttl_seconds, max_retries, job_timeout_seconds, result_ttl_seconds,
    defer_until, defer_by_seconds, trace_context, correlation_context. An answer is (seq, job_id, status, reason):
    rejected with a reason; existing with the id of the job that holds the live key, if that job still exists; duplicate if the id is taken by a job or
    by an earlier request, which leaves the key free; else enqueued. Keys in ``held`` are (key, job_id, expires_at); the new ones have these columns too.
    A key lives for its lifetime, or for the deferral in whole seconds if that is longer.
    """
    optional = {"params": "string", "queue_name": "string", "unique_key": "string", "unique_ttl_seconds": "double", "max_retries": "long", "job_timeout_seconds": "long", "result_ttl_seconds": "long", "defer_until": "timestamp_ntz", "defer_by_seconds": "double"}
    optional |= dict.fromkeys(("trace_context", "correlation_context"), "map<string,string>")
    rows = requests.select("id", "seq", "ts", "function_name", *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()])
    none = F.lit(None).cast("double")
    rows = rows.withColumn("reason", rejection(F.col("function_name"), F.coalesce("queue_name", F.lit("-")), F.col("job_timeout_seconds"), F.col("unique_ttl_seconds"), none))
    rows = rows.withColumn("scheduled", schedule(F.col("ts"), F.col("defer_until"), F.col("defer_by_seconds")))
    good = insert_new(state.jobs.select("id"), rows.where("reason is null"), "id", "seq").withColumnRenamed("created", "new")

    keyed = good.where("unique_key is not null").withColumn("key", F.col("unique_key"))
    alive = None if held is None else held.join(state.jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    deferral = (epoch_ms(F.col("scheduled")) - epoch_ms(F.col("ts"))) / 1000
    ttl = F.greatest(F.coalesce("unique_ttl_seconds", F.lit(float(s.default_unique_job_lock_ttl_seconds))), F.ceil(deferral).cast("double"))
    folded = leading_edge(keyed, F.ceil(ttl) * 1000, held=alive, blocked=~F.col("new"))
    leader = good.select(F.col("seq").alias("leader"), F.col("id").alias("leader_id"))
    told = good.join(folded, "seq", "left").join(leader, "leader", "left")
    if alive is None:
        told = told.withColumn("held_id", F.lit(None).cast("string"))
    else:
        told = told.join(alive.groupBy(F.col("key").alias("unique_key")).agg(F.max_by("job_id", "expires_at").alias("held_id")), "unique_key", "left")
    created = F.when(F.col("unique_key").isNull(), F.col("new")).otherwise(F.col("admitted"))
    existing = F.col("unique_key").isNotNull() & ~F.col("admitted") & ~F.col("refused")
    status = F.when(existing, "existing").when(created, "enqueued").otherwise("duplicate")
    told = told.withColumns({"status": status, "job_id": F.when(existing, F.coalesce("leader_id", "held_id")).otherwise(F.col("id"))})

    made = told.where("status = 'enqueued'")
    or_default = lambda c, v: F.coalesce(c, F.lit(v).cast("long"))
    filled = {
        "id": F.col("id"), "function_name": F.col("function_name"), "job_params": F.coalesce("params", F.lit("{}")), "enqueue_time": F.col("ts"), "status": F.lit("PENDING"), "current_retries": F.lit(0),
        "max_retries": or_default("max_retries", s.default_max_retries), "job_timeout_seconds": or_default("job_timeout_seconds", s.default_job_timeout_seconds), "result_ttl_seconds": or_default("result_ttl_seconds", s.default_result_ttl_seconds),
        "queue_name": queue_key(F.coalesce("queue_name", F.lit(s.default_queue_name))), "next_scheduled_run_time": F.col("scheduled"), "trace_context": F.col("trace_context"), "correlation_context": F.col("correlation_context"), "job_unique_key": F.col("unique_key"),
    }
    jobs = made.select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in state.jobs.schema.fields])
    entries = jobs.select("queue_name", F.col("id").alias("job_id"), epoch_ms(F.col("next_scheduled_run_time")).cast("double").alias("score_ms"))
    answers = told.select("seq", "job_id", "status", F.lit(None).cast("string").alias("reason")).unionByName(rows.where("reason is not null").select("seq", F.lit(None).cast("string").alias("job_id"), F.lit("rejected").alias("status"), "reason"))
    keys = made.where("unique_key is not null").select(F.col("unique_key").alias("key"), "job_id", from_ms(F.col("until_ms")).alias("expires_at"))
    return state.with_(jobs=state.jobs.unionByName(jobs), queue=state.queue.unionByName(entries)), answers, keys


def jitter(base: float, share: float, seed: int) -> Column:
    """A delay uniform in base * (1 ± share); the share is at most 0.99."""
    j = float(np.clip(share, 0, 0.99))
    return F.lit(base * (1 - j)) + F.rand(seed) * (2 * base * j)
