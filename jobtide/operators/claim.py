"""Claiming of ready jobs: time-ordered, locked ones left out, fair over queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import epoch_ms, plus_seconds, queue_key, runner_of
from jobtide.operators.state import JobState, live, upsert
from jobtide.settings import Settings

_RANK = ("score_ms", "job_id")


def ready(state: JobState, now: Column, limit: int) -> DataFrame:
    """The first ``limit`` due entries of every queue, in order."""
    due = state.queue.where(F.col("score_ms") <= epoch_ms(now))
    return due.withColumn("rn", F.row_number().over(Window.partitionBy("queue_name").orderBy(*_RANK))).where(F.col("rn") <= limit)


def rank_page(state: JobState, start: int, stop: int) -> DataFrame:
    """Entries of every queue by rank from ``start`` to ``stop``, both included; negative ranks count from the end.

    Of a page that counts from one end only the first entries of a queue from that end are kept before queues meet in a task.
    """
    own = Window.partitionBy("queue_name")
    forward, back = F.row_number().over(own.orderBy(*_RANK)), F.row_number().over(own.orderBy(*[F.desc(c) for c in _RANK]))
    if start >= 0 and stop >= 0:
        rows = state.queue.withColumn("nth", forward).where(F.col("nth") <= stop + 1).where(F.col("nth") > start).withColumn("rank", F.col("nth") - 1)
    else:
        sizes = state.queue.groupBy("queue_name").agg(F.count("*").alias("n"))
        if start < 0 and stop < 0:
            rows = state.queue.withColumn("nth", back).where(F.col("nth") <= -start).where(F.col("nth") >= -stop).join(sizes, "queue_name").withColumn("rank", F.col("n") - F.col("nth"))
        else:
            at = lambda i: F.lit(i) if i >= 0 else F.col("n") + i
            rows = state.queue.withColumn("rank", forward - 1).join(sizes, "queue_name").where(F.col("rank").between(at(start), at(stop)))
    return rows.select("queue_name", F.col("rank").cast("long").alias("rank"), "job_id", "score_ms")


def stale(state: JobState) -> DataFrame:
    """Queue entries whose job is gone."""
    return state.queue.join(state.jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def claimable(state: JobState, now: Column, per_queue: int, overfetch: int = 4) -> DataFrame:
    """At most ``per_queue`` claims a queue out of its first ``overfetch * per_queue`` due entries: job exists, no live lock."""
    head = ready(state, now, overfetch * per_queue)
    free = head.join(live(state.job_locks, now).select("job_id"), "job_id", "left_anti")
    known = free.join(state.jobs.select(F.col("id").alias("job_id"), "job_timeout_seconds"), "job_id")
    at = F.row_number().over(Window.partitionBy("queue_name").orderBy(*_RANK))
    return known.withColumn("rn", at).where(F.col("rn") <= per_queue)


def lock_ms(timeout: Column, extension: int, default_ms: int) -> Column:
    return F.when(timeout > 0, (timeout + extension) * 1000).otherwise(F.lit(default_ms)).cast("long")


def claim(state: JobState, now: Column, worker: str, per_queue: int, s: Settings) -> tuple[JobState, DataFrame]:
    """Lock and start the claimable jobs of every queue; entries of missing jobs in the looked-at head are purged. Returns the new state and the claims."""
    default = (s.default_job_timeout_seconds + s.default_lock_timeout_extension_seconds) * 1000
    claims = claimable(state, now, per_queue).withColumn("lock_ms", lock_ms(F.col("job_timeout_seconds"), s.default_lock_timeout_extension_seconds, default))
    hit = claims.select(F.col("job_id").alias("id"), F.lit(True).alias("hit"))
    jobs = state.jobs.join(hit, "id", "left")
    for c, v in (("status", F.lit("ACTIVE")), ("start_time", now), ("worker_id", F.lit(worker))):
        jobs = jobs.withColumn(c, F.when(F.col("hit"), v).otherwise(F.col(c)))
    gone = claims.select("queue_name", "job_id").unionByName(ready(state.with_(queue=stale(state).select(*state.queue.columns)), now, 4 * per_queue).select("queue_name", "job_id"))
    locks = claims.select("job_id", F.lit(worker).alias("owner"), plus_seconds(now, F.col("lock_ms") / 1000).alias("expires_at"))
    active = claims.select(F.lit(worker).alias("worker_id"), "job_id", (epoch_ms(now) / 1000.0).alias("start_s"))
    return state.with_(
        jobs=jobs.drop("hit"), queue=state.queue.join(gone, ["queue_name", "job_id"], "left_anti"), job_locks=live(state.job_locks, now).unionByName(locks), active=state.active.unionByName(active)
    ), claims


def fair_claim(state: JobState, now: Column, queues: list[str], count: int, start: int = 0) -> DataFrame:
    """Claims for one poll: pass 0 takes up to ceil(count / queues) from each queue in turn from ``start`` on, pass 1 fills up.

    Columns: pass, queue_offset, rn, queue_name, job_id. The two passes are the two values of one ordering, so a single top-k gives both.
    """
    share = -(-count // len(queues))
    order = F.array(*[F.lit(q) for q in queues])
    rows = claimable(state.with_(queue=state.queue.where(F.col("queue_name").isin(*queues))), now, count)
    rows = rows.withColumns({"pass": (F.col("rn") > share).cast("int"), "queue_offset": F.pmod(F.array_position(order, F.col("queue_name")) - 1 - start, F.lit(len(queues)))})
    return rows.select("pass", "queue_offset", "rn", "queue_name", "job_id").orderBy("pass", "queue_offset", "rn").limit(count)


def routed(rows: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """runner and handler of (function_name, queue_name): the function's prefix, else the queue's route under any form of its name, else the default."""
    prefix, handler = runner_of(F.col("function_name"))
    r = F.broadcast(routes.select(queue_key(F.col("queue")).alias("route_key"), F.col("runner").alias("routed")).dropDuplicates(["route_key"]))  # a settings table
    return rows.withColumns({"prefix": prefix, "handler": handler, "route_key": queue_key(F.col("queue_name"))}).join(r, "route_key", "left").withColumn("runner", F.coalesce("prefix", "routed", F.lit(default))).drop("prefix", "routed", "route_key")


def needed_runners(queues: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """The runners that the selected queues route to."""
    return routed(queues.select("queue_name", F.lit("f").alias("function_name")), routes, default).select("runner").distinct()


def concurrency(runners: DataFrame, needed: DataFrame) -> DataFrame:
    """max(1, sum of pool_size * max_in_flight) over the needed runners."""
    return runners.join(needed, "runner", "left_semi").agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.sum(F.col("pool_size") * F.col("max_in_flight")), F.lit(0)).cast("long")).alias("concurrency"))


def normal_queues(names: Column) -> Column:
    """Prefixed, sorted, without repeats."""
    return F.array_sort(F.array_distinct(F.transform(names, queue_key)))


def refreshed(state: JobState, owners: DataFrame, now: Column, seconds: int) -> JobState:
    """Locks of (job_id, owner) that are alive and owned get a new expiry; others stay."""
    mine = owners.select("job_id", "owner", F.lit(True).alias("mine"))
    locks = live(state.job_locks, now).join(mine, ["job_id", "owner"], "left")
    return state.with_(job_locks=locks.withColumn("expires_at", F.when(F.col("mine"), plus_seconds(now, F.lit(seconds))).otherwise(F.col("expires_at"))).select(*state.job_locks.columns))


def lock_and_start(state: JobState, wanted: DataFrame, now: Column, worker: str, lock_seconds: int) -> tuple[JobState, DataFrame]:
    """One lock and start for each of (queue_name, job_id): job_id, started. A job that is locked or not in that queue stays as it is and is not locked."""
    one = wanted.select("queue_name", "job_id").distinct()
    free = one.join(live(state.job_locks, now).select("job_id"), "job_id", "left_anti").select("queue_name", "job_id")
    got = free.join(state.queue.select("queue_name", "job_id"), ["queue_name", "job_id"], "left_semi")
    hit = got.select(F.col("job_id").alias("id"), F.lit(True).alias("hit"))
    jobs = state.jobs.join(hit, "id", "left")
    for c, v in (("status", F.lit("ACTIVE")), ("start_time", now), ("worker_id", F.lit(worker))):
        jobs = jobs.withColumn(c, F.when(F.col("hit"), v).otherwise(F.col(c)))
    locks = got.select("job_id", F.lit(worker).alias("owner"), plus_seconds(now, F.lit(lock_seconds)).alias("expires_at"))
    active = got.select(F.lit(worker).alias("worker_id"), "job_id", (epoch_ms(now) / 1000.0).alias("start_s"))
    told = wanted.select("job_id").join(hit.select(F.col("id").alias("job_id"), F.col("hit").alias("started")), "job_id", "left").select("job_id", F.coalesce("started", F.lit(False)).alias("started"))
    return state.with_(jobs=jobs.drop("hit"), queue=state.queue.join(got, ["queue_name", "job_id"], "left_anti"), job_locks=live(state.job_locks, now).unionByName(locks), active=upsert(state.active, active, "worker_id", "job_id")), told


def try_lock(state: JobState, wanted: DataFrame, now: Column) -> tuple[JobState, DataFrame]:
    """Locks of (job_id, owner, seconds, seq) where no live one is: seq, got. The first of a job's wishes wins."""
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("seq")) == 1
    rows = wanted.withColumn("first", first).join(live(state.job_locks, now).select("job_id", F.lit(True).alias("held")).distinct(), "job_id", "left").withColumn("got", F.col("first") & F.col("held").isNull())
    locks = rows.where("got").select("job_id", "owner", plus_seconds(now, F.col("seconds")).alias("expires_at"))
    return state.with_(job_locks=live(state.job_locks, now).unionByName(locks)), rows.select("seq", "got")


def unlocked(state: JobState, ids: DataFrame, owner_only: bool = True) -> JobState:
    """Locks of (job_id, owner) released; without ``owner_only`` whoever owns them."""
    keys = ["job_id", "owner"] if owner_only else ["job_id"]
    return state.with_(job_locks=state.job_locks.join(ids.select(*keys).distinct(), keys, "left_anti").select(*state.job_locks.columns))


def capacity(state: JobState, limits: DataFrame) -> DataFrame:
    """worker_id, free: how many jobs each worker of (worker_id, concurrency_limit) may still take; 0 means that it does not poll."""
    running = state.active.groupBy("worker_id").agg(F.count("*").alias("running"))
    return limits.select("worker_id", "concurrency_limit").join(running, "worker_id", "left").select("worker_id", F.greatest(F.lit(0).cast("long"), F.col("concurrency_limit") - F.coalesce("running", F.lit(0))).alias("free"))
