"""Operational queries over jobs, queues and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import epoch_ms, queue_key, seconds_between, shortened
from jobtide.operators.sinks import queued
from jobtide.operators.state import JobState

_RANK = ("score_ms", "job_id")


def queue_list(state: JobState, known: DataFrame | None = None) -> DataFrame:
    """Entries and the oldest and newest score of every queue, and of all under the name null; queues of ``known`` (queue_name) that have no entries are shown with 0."""
    facts = [F.count("score_ms").alias("entries"), F.min("score_ms").alias("oldest"), F.max("score_ms").alias("newest")]
    rows = state.queue.select("queue_name", "score_ms")
    if known is not None:
        rows = rows.unionByName(known.select(queue_key(F.col("queue_name")).alias("queue_name"), F.lit(None).cast("double").alias("score_ms")))
    return rows.groupBy("queue_name").agg(*facts).unionByName(rows.agg(*facts).withColumn("queue_name", F.lit(None).cast("string")))


def average_wait(state: JobState, now: Column, head: int = 100) -> DataFrame:
    """Mean seconds since their score of a queue's first ``head`` entries; negative for those still to come."""
    at = F.row_number().over(Window.partitionBy("queue_name").orderBy(*_RANK))
    first = state.queue.withColumn("at", at).where(F.col("at") <= head)
    return first.groupBy("queue_name").agg(F.avg((epoch_ms(now) - F.col("score_ms")) / 1000.0).alias("avg_wait"))


def dlq_by_queue(state: JobState) -> DataFrame:
    return state.dlq.join(state.jobs.select(F.col("id").alias("job_id"), "queue_name"), "job_id").groupBy("queue_name").agg(F.count("*").alias("dlq_count"))


def queue_stats(state: JobState, now: Column) -> DataFrame:
    """Waiting entries, running, completed, failed and all jobs, dead letters and mean wait of every queue that has any; the jobs are scanned once."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    letters = state.dlq.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("letters"))
    jobs = state.jobs.select("id", "queue_name", "status").join(letters, "id", "left").groupBy("queue_name").agg(is_("ACTIVE").alias("active"), is_("COMPLETED").alias("completed"), is_("FAILED").alias("failed"), F.sum("letters").alias("dlq_count"))
    waiting = state.queue.groupBy("queue_name").agg(F.count("*").alias("pending"))
    out = jobs.join(waiting, "queue_name", "full").join(average_wait(state, now), "queue_name", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("pending", "active", "completed", "failed", "dlq_count")}
    out = out.select("queue_name", *[v.alias(c) for c, v in counts.items()], "avg_wait")
    return out.withColumn("total", F.col("pending") + F.col("active") + F.col("completed") + F.col("failed")).where("total > 0")


def queue_page(state: JobState, queue: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a queue by rank, from 1, with what is known of the jobs."""
    rows = state.queue.where(F.col("queue_name") == queue_key(F.lit(queue))).orderBy(*_RANK).offset(offset).limit(limit)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*_RANK)) + offset)  # at most ``limit`` rows
    jobs = state.jobs.select(F.col("id").alias("job_id"), "function_name", "status")
    missing = F.lit("<missing>")
    return ranked.join(jobs, "job_id", "left").select("rank", "job_id", "score_ms", F.coalesce("function_name", missing).alias("function_name"), F.coalesce("status", missing).alias("status"))


def all_fields(jobs: DataFrame) -> DataFrame:
    """(id, field, value) of every field that is set, maps as JSON."""
    kinds = dict(jobs.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith("map") else F.col(c).cast("string")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in sorted(kinds)])
    return jobs.select("id", F.inline(fields)).where("value is not null")


def job_fields(state: JobState, job_id: str) -> DataFrame:
    """All fields of a job that are set, as (field, value), sorted by the field."""
    return all_fields(state.jobs.where(F.col("id") == job_id)).select("field", "value").orderBy("field")


def raw_maps(jobs: DataFrame) -> DataFrame:
    """(id, fields): a job's set fields as a map of texts, sorted by name."""
    kinds = dict(jobs.dtypes)
    names = sorted(kinds)
    values = F.array(*[F.to_json(c) if kinds[c].startswith("map") else F.col(c).cast("string") for c in names])
    return jobs.select("id", F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), values), lambda k, v: v.isNotNull()).alias("fields"))


def dlq_inspect(state: JobState, ids: DataFrame) -> DataFrame:
    """(id, found, fields) for each id asked for: the stored fields as one JSON object, whatever list the job is on."""
    told = raw_maps(state.jobs).select("id", F.to_json("fields").alias("fields"), F.lit(True).alias("found"))
    return ids.select("id").join(told, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "fields")


def duration(now: Column) -> Column:
    """Seconds from start to completion, of a running job to now; else null."""
    return F.when(F.col("completion_time").isNotNull(), seconds_between(F.col("completion_time"), F.col("start_time"))).when(F.col("status") == "ACTIVE", seconds_between(now, F.col("start_time")))


def job_list(state: JobState, now: Column, status: str | None = None, queue: str | None = None, function: str | None = None, limit: int = 20) -> DataFrame:
    """Jobs by enqueue time, newest first, under filters; the status in any case, the queue with or without its prefix."""
    rows = state.jobs
    if status is not None:
        rows = rows.where(F.col("status") == status.upper())
    if queue is not None:
        rows = rows.where(queue_key(F.col("queue_name")) == queue_key(F.lit(queue)))
    if function is not None:
        rows = rows.where(F.col("function_name") == function)
    return rows.select("id", "function_name", "queue_name", "status", "enqueue_time", duration(now).alias("duration_s")).orderBy(F.desc_nulls_last("enqueue_time"), "id").limit(limit)


def replay(state: JobState, ids: DataFrame, now: Column, queue: str | None = None) -> DataFrame:
    """New requests from old jobs: function and parameters stay, all else is reset."""
    target = queue_key(F.lit(queue)) if queue else F.col("queue_name")
    return state.jobs.join(ids.select("id"), "id", "left_semi").select(F.concat(F.lit("replay-"), "id").alias("id"), "function_name", "job_params", target.alias("queue_name"), now.alias("enqueue_time"), F.lit("PENDING").alias("status"), F.lit(0).cast("long").alias("current_retries"))


def cancel(state: JobState, ids: DataFrame) -> JobState:
    """Pending jobs that are queued become cancelled and leave the queue; others stay as they are."""
    queued = state.queue.select(F.col("job_id").alias("id")).distinct()
    hit = state.jobs.where("status = 'PENDING'").select("id").join(ids.select("id"), "id", "left_semi").join(queued, "id", "left_semi")
    jobs = state.jobs.join(hit.distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("hit"), "CANCELLED").otherwise(F.col("status"))).drop("hit")
    return state.with_(jobs=jobs, queue=state.queue.join(hit.select(F.col("id").alias("job_id")), "job_id", "left_anti"))


def trace(state: JobState, attempts: DataFrame) -> DataFrame:
    """The events of every job in order, the gap to the one before and the span since the first."""
    j = state.jobs
    events = F.array(*[F.struct(F.lit(k).alias("event"), F.col(c).alias("ts")) for k, c in (("Enqueued", "enqueue_time"), ("Started", "start_time"), ("Finished", "completion_time"))])
    rows = j.select("id", F.inline(events)).where("ts is not null")
    retries = attempts.where("attempt > 1").select(F.col("job_id").alias("id"), F.concat(F.lit("Retry "), (F.col("attempt") - 1).cast("string")).alias("event"), F.col("start_time").alias("ts"))
    rows = rows.unionByName(retries)
    order = Window.partitionBy("id").orderBy("ts", "event")
    return rows.select("id", "event", "ts", seconds_between(F.col("ts"), F.lag("ts").over(order)).alias("gap_s"), seconds_between(F.col("ts"), F.first("ts").over(order)).alias("since_first_s"))


def dlq_rows(state: JobState) -> DataFrame:
    cols = [c for c in state.jobs.columns if c not in ("id", "dlq_name")]
    return state.dlq.join(state.jobs.select(F.col("id").alias("job_id"), *cols), "job_id")


def dlq_list(state: JobState, dlq: str, queue: str | None = None, function: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of dead letters by completion, newest first, with the unfiltered size of the list."""
    total = state.dlq.where(F.col("dlq_name") == dlq).agg(F.count("*").alias("dlq_total"))
    rows = dlq_rows(state).where(F.col("dlq_name") == dlq)
    if queue is not None:
        rows = rows.where(queue_key(F.col("queue_name")) == queue_key(F.lit(queue)))
    if function is not None:
        rows = rows.where(F.col("function_name") == function)
    page = rows.select("job_id", "function_name", "queue_name", "last_error", "current_retries", "completion_time").orderBy(F.desc_nulls_last("completion_time"), "job_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total), F.lit(True))  # one row


def dlq_totals(state: JobState) -> DataFrame:
    return dlq_rows(state).groupBy("dlq_name").agg(F.count("*").alias("jobs"), F.min("completion_time").alias("oldest"), F.max("completion_time").alias("newest"), F.avg("current_retries").alias("avg_retries"))


def top_counts(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """The most frequent values of ``key``; ties go to the smaller."""
    return rows.groupBy(key.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def dlq_top(state: JobState) -> DataFrame:
    """The ten most frequent queues and functions and the five most frequent errors of the dead letters, counted in one pass."""
    parts = [("queue", F.col("queue_name"), 10), ("function", F.col("function_name"), 10), ("error", shortened(F.col("last_error"), 100), 5)]
    counted = dlq_rows(state).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name"), F.lit(n).alias("most")) for k, c, n in parts]))).groupBy("kind", "name", "most").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return counted.withColumn("at", at).where("at <= most").select("kind", "name", "n")


def dlq_chosen(state: JobState, dlq: str, queue: str | None = None, function: str | None = None, everything: bool = False, limit: int | None = None) -> DataFrame:
    """What ``dlq_requeue`` would take (its dry run): job_id, queue_name, function_name, newest push first. Needs a filter or ``everything``."""
    if queue is None and function is None and not everything:
        raise ValueError("a filter is needed, or everything=True")
    rows = dlq_rows(state).where(F.col("dlq_name") == dlq)
    if queue is not None:
        rows = rows.where(queue_key(F.col("queue_name")) == queue_key(F.lit(queue)))
    if function is not None:
        rows = rows.where(F.col("function_name") == function)
    rows = rows.orderBy(F.desc("pushed_seq"), "job_id").select("job_id", "queue_name", "function_name")
    return rows.limit(limit) if limit is not None else rows


def dlq_requeue(state: JobState, dlq: str, target: str, now: Column, queue: str | None = None, function: str | None = None, everything: bool = False, limit: int | None = None) -> JobState:
    """Dead letters back to a queue, newest push first: pending again, retries and last error kept. Needs a filter or ``everything``."""
    chosen = dlq_chosen(state, dlq, queue, function, everything, limit).select("job_id").distinct()
    to = queue_key(F.lit(target))
    hit = chosen.select(F.col("job_id").alias("id"), F.lit(True).alias("hit"))
    jobs = state.jobs.join(hit, "id", "left").withColumns({"status": F.when(F.col("hit"), "PENDING").otherwise(F.col("status")), "queue_name": F.when(F.col("hit"), to).otherwise(F.col("queue_name"))}).drop("hit")
    entries = chosen.select(to.alias("queue_name"), "job_id", epoch_ms(now).cast("double").alias("score_ms"))
    left = state.dlq.join(chosen.withColumn("dlq_name", F.lit(dlq)), ["dlq_name", "job_id"], "left_anti")
    return queued(state.with_(jobs=jobs, dlq=left), entries)


def status_histogram(state: JobState) -> DataFrame:
    return state.jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def drained(state: JobState) -> DataFrame:
    """One row: no queue entry is left and no job is pending, running or retrying."""
    busy = state.jobs.agg(F.count_if(F.col("status").isin("PENDING", "ACTIVE", "RETRYING")).alias("busy"))
    return busy.join(F.broadcast(state.queue.agg(F.count("*").alias("queued"))), F.lit(True)).select(((F.col("busy") == 0) & (F.col("queued") == 0)).alias("drained"))
