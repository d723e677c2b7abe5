"""All queries over the job tables, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions import scalars as fn
from jobtide.operators import admin, admit, claim, cron, handlers, metrics, outcome, recover, sinks
from jobtide.operators.state import empty
from jobtide.plans import contracts, twins
from jobtide.settings import Settings
from jobtide.sources import fixtures as fx
from jobtide.sources import lookups, wire

SETTINGS = Settings()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _over_state(name: str, f: Callable) -> None:
    QUERIES[name] = lambda spark, d: f(fx.state(spark, d))


def _over_attempts(name: str, f: Callable) -> None:
    QUERIES[name] = lambda spark, d: f(fx.attempts(spark, d))


_over_state("adm1_queue_list", admin.queue_list)
_over_state("adm2_queue_stats", lambda s: admin.queue_stats(s, fx.now()))
_over_state("adm3_avg_wait", lambda s: admin.average_wait(s, fx.now()))
_over_state("adm5_dlq_by_queue", admin.dlq_by_queue)
_over_state("adm6_queue_inspect", lambda s: admin.queue_page(s, "high", 20, 5))
_over_state("adm7_job_show", lambda s: admin.job_fields(s, "7"))
_over_state("adm8_job_list", lambda s: admin.job_list(s, fx.now(), status="failed", queue="urgent"))
_over_state("adm9_durations", lambda s: s.jobs.select("id", admin.duration(fx.now()).alias("duration_s")))
_over_state("adm10_replay", lambda s: admin.replay(s, s.jobs.where("status = 'FAILED'"), fx.now(), "again"))
_over_state("adm14_dlq_stats", admin.dlq_totals)
_over_state("adm14_dlq_top", admin.dlq_top)
_over_state("adm13_dlq_list", lambda s: admin.dlq_list(s, "dlq:default", function="fn_3", offset=5))
_over_state("adm19_status_histogram", admin.status_histogram)
_over_state("src11_ready", lambda s: claim.ready(s, fx.now(), 50).select("queue_name", "job_id", "score_ms", F.col("rn").cast("long").alias("rn")))
_over_state("src12_rank_page", lambda s: claim.rank_page(s, -30, -5))
_over_state("src15_sizes", lookups.sizes)
_over_state("src16_lock_ttl", lambda s: lookups.lock_ttls(s, fx.now()))
_over_state("src17_status", lambda s: lookups.statuses(s, s.jobs.select("id").unionByName(s.jobs.select(F.concat(F.lit("x"), "id").alias("id")))))
_over_state("src18_wait", lambda s: lookups.completed_within(s, s.jobs.select("id", F.col("enqueue_time").alias("asked_at"), F.lit(60).alias("timeout_s"))))
_over_state("clm1_claim", lambda s: claim.claimable(s, fx.now(), 25).select("queue_name", "job_id", "score_ms", "rn"))
_over_state("clm2_lock_ttl", lambda s: s.jobs.select("id", claim.lock_ms(F.col("job_timeout_seconds"), 60, 360_000).alias("lock_ms")))
_over_state("clm4_fair_claim", lambda s: claim.fair_claim(s, fx.now(), ["queue:urgent", "queue:high", "queue:low"], 25, 1))
_over_state("rec1_orphans", lambda s: recover.orphans(s, fx.now()))
_over_state("rec9_health", lambda s: recover.health_report(s, fx.now()))
_over_state("fn14_queue_wait", lambda s: s.jobs.select("id", fn.queue_wait_ms(F.col("start_time"), F.col("enqueue_time")).alias("wait_ms")))
_over_state("met5_queue_wait", lambda s: metrics.queue_wait(s.jobs))
_over_state("met5_histogram", lambda s: metrics.histogram(s.jobs.where("start_time is not null"), fn.queue_wait_ms(F.col("start_time"), F.col("enqueue_time")).cast("double"), "queue_name"))
_over_attempts("met6_processed", metrics.processed)
_over_attempts("met8_inflight", lambda a: metrics.in_flight(a.select("worker_id", fn.epoch_ms(F.col("start_time")).alias("start_ms"), F.col("duration_ms").cast("long").alias("duration_ms"))))
_over_attempts("met10_runner", metrics.runner_totals)


@query
def adm11_cancel(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    s = admin.cancel(s, s.jobs.where(F.col("id").cast("long") % 3 == 0))
    queued = s.queue.select(F.col("job_id").alias("id"), F.lit(True).alias("queued"))
    return s.jobs.select("id", "status").join(queued, "id", "left").withColumn("queued", F.coalesce("queued", F.lit(False)))


@query
def adm12_job_trace(spark: SparkSession, d: str) -> DataFrame:
    return admin.trace(fx.state(spark, d), fx.attempts(spark, d))


@query
def adm17_dlq_requeue(spark: SparkSession, d: str) -> DataFrame:
    s = admin.dlq_requeue(fx.state(spark, d), "dlq:default", "redo", fx.now(), queue="low", limit=50)
    return s.jobs.select("id", "status", "queue_name").join(s.queue.select(F.col("job_id").alias("id"), "score_ms"), "id", "left")


@query
def src7_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    k = F.col("id").cast("long")
    ids = s.jobs.select((k * 2).alias("at"), "id").unionByName(s.jobs.select((k * 2 + 1).alias("at"), F.concat(F.lit("x"), "id").alias("id")))
    return lookups.lookup(s, ids).select("at", "id", "found", "status", "function_name")


@query
def enq1_enqueue(spark: SparkSession, d: str) -> DataFrame:
    r = fx.requests(spark, d).withColumns({"id": F.concat(F.lit("r"), (F.col("seq") % 500).cast("string")), "queue_name": F.lit(None).cast("string")})
    s, _ = admit.enqueue(empty(spark), r, SETTINGS)
    return s.jobs.select("id", "function_name", "job_params", "enqueue_time", "queue_name").join(s.queue.select(F.col("job_id").alias("id"), "score_ms"), "id")


@query
def enq2_idempotent(spark: SparkSession, d: str) -> DataFrame:
    return admit.idempotent(fx.requests(spark, d), 6 * 3600)


@query
def enq4_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    from jobtide.operators.state import insert_new

    r = fx.requests(spark, d).select(F.col("key").alias("id"), "seq")
    return insert_new(fx.jobs(spark, d).select("id"), r, "id", "seq").select("seq", "created")


@query
def enq5_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return admit.rate_limited(fx.requests(spark, d), 86_400).drop("refused").withColumn("status", admit.rate_limit_status(F.col("admitted")))


@query
def enq6_debounce(spark: SparkSession, d: str) -> DataFrame:
    return admit.debounced(fx.requests(spark, d), 6 * 3600)


@query
def enq9_unique_deferral(spark: SparkSession, d: str) -> DataFrame:
    return admit.unique_deferred(fx.requests(spark, d), SETTINGS, defer=F.col("seq") % 3 * 3600)


@query
def enq10_lock_ttl(spark: SparkSession, d: str) -> DataFrame:
    return fx.jobs(spark, d).select("id", admit.lock_ttl_seconds(F.col("job_timeout_seconds") * 100, F.col("id").cast("long") * 7, SETTINGS).alias("ttl"))


@query
def enq12_mode(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    explicit = F.when(F.col("seq") % 5 == 0, F.element_at(F.array(*map(F.lit, ("unique", "deferred", "rate_limit", "debounce", "enqueue"))), (F.col("seq") % 25 / 5 + 1).cast("int"))).otherwise(none)
    return fx.requests(spark, d).select("seq", admit.mode(explicit, F.when(F.col("seq") % 2 == 0, "r"), F.when(F.col("seq") % 3 == 0, "d")).alias("mode"))


@query
def enq13_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    name = F.when(k % 11 == 0, " ").otherwise(F.col("function_name"))
    window = F.when(k % 4 == 3, F.lit(float("nan"))).when(k % 4 == 2, F.lit(0.0)).otherwise(F.lit(1.5))
    return fx.requests(spark, d).select("seq", admit.rejection(name, F.when(k % 13 == 0, "").otherwise("q"), F.when(k % 7 == 0, 0).otherwise(1), F.when(k % 5 == 0, -1).otherwise(1), window).alias("reason"))


@query
def clm8_route(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    name = F.when(k % 4 == 0, F.concat(F.lit("gpu#"), "function_name")).when(k % 4 == 1, F.lit("gpu#h#x")).when(k % 4 == 2, F.concat(F.lit("#"), "function_name")).otherwise(F.col("function_name"))
    routes = spark.createDataFrame([("urgent", "rust"), ("queue:low", "node")], "queue string, runner string")
    return claim.routed(fx.jobs(spark, d).withColumn("function_name", name), routes, "python").select("id", "runner", "handler")


@query
def clm10_needed_runners(spark: SparkSession, d: str) -> DataFrame:
    routes = spark.createDataFrame([("urgent", "rust"), ("queue:low", "node")], "queue string, runner string")
    return claim.needed_runners(fx.state(spark, d).queue, routes, "python")


@query
def clm11_concurrency(spark: SparkSession, d: str) -> DataFrame:
    runners = spark.createDataFrame([("python", 2, 8), ("rust", 1, 4), ("node", 2, 1), ("idle", 9, 9)], "runner string, pool_size long, max_in_flight long")
    return claim.concurrency(runners, clm10_needed_runners(spark, d))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    last = fx.attempts(spark, d).groupBy("job_id").agg(F.max_by("outcome", "attempt").alias("status"))
    k = F.col("job_id").cast("long")
    kind = F.when(F.col("status") == "error", F.when(k % 4 == 0, "handler_not_found").when(k % 4 == 1, "transport_error")).otherwise(none)
    return last.select("job_id", "status", kind.alias("error_type"), F.when(k % 5 == 0, "given").otherwise(none).alias("error_message"), F.lit('{"ok":1}').alias("result"), F.when(k % 6 == 0, k % 100 - 10.5).alias("retry_after_seconds"))


@query
def out3_transition(spark: SparkSession, d: str) -> DataFrame:
    t = outcome.transitions(fx.jobs(spark, d), _outcomes(spark, d), fx.now(), SETTINGS)
    return t.select("id", "kind", "status", "current_retries", "last_error", "score_ms", "to_dlq", "expires_at")


@query
def out6_backoff(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(50).select(F.col("id").alias("n"), fn.backoff(F.col("id"), 5.0, 3600.0).alias("delay"))


@query
def out8_dlq_growth(spark: SparkSession, d: str) -> DataFrame:
    s = outcome.apply_outcomes(fx.state(spark, d), _outcomes(spark, d), fx.now(), SETTINGS)
    return s.dlq.groupBy("dlq_name").agg(F.count("*").alias("n"))


@query
def out9_retried(spark: SparkSession, d: str) -> DataFrame:
    """Queue entries after all outcomes: a retried job that was queued already has one entry, with its new score."""
    return outcome.apply_outcomes(fx.state(spark, d), _outcomes(spark, d), fx.now(), SETTINGS).queue


@query
def out12_deadline(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.jobs(spark, d).where("status = 'ACTIVE' and job_timeout_seconds is not null")
    return outcome.past_deadline(rows, fx.now()).select("id", "deadline", "expired", "left_ms")


def _request_id() -> Column:
    return F.concat_ws("-", "job_id", F.col("attempt").cast("string"))


@query
def out13_cancel(spark: SparkSession, d: str) -> DataFrame:
    a = fx.attempts(spark, d).withColumn("request_id", _request_id())
    k = F.col("job_id").cast("long")
    by_request = a.where((F.col("attempt") == 1) & (k % 5 == 0)).select("request_id", "job_id")
    by_job = a.where(k % 7 == 0).select(F.lit(None).cast("string").alias("request_id"), "job_id")
    return outcome.cancelled(a.select("request_id", "job_id"), by_request.unionByName(by_job))


@query
def out14_busy(spark: SparkSession, d: str) -> DataFrame:
    a = fx.attempts(spark, d).withColumn("request_id", _request_id())
    start = fn.epoch_ms(F.col("start_time"))
    edges = F.array(F.struct(start.alias("ts"), F.lit(1).alias("delta")), F.struct((start + F.col("duration_ms").cast("long") * 1000).alias("ts"), F.lit(-1).alias("delta")))
    found = outcome.busy(a.select(F.col("worker_id").alias("conn"), "request_id", F.inline(edges)), 8)
    return found.select("conn", "request_id", "busy")


@query
def out16_match(spark: SparkSession, d: str) -> DataFrame:
    a = fx.attempts(spark, d).withColumn("request_id", _request_id())
    k, n = F.col("job_id").cast("long"), F.col("attempt")
    answers = a.where(n % 3 != 0).select("request_id", F.when((n % 3 == 1) & (k % 4 == 0), "other").otherwise(F.col("job_id")).alias("job_id"))
    late = fx.jobs(spark, d).where(F.col("id").cast("long") % 10 == 0).select(F.concat(F.lit("x"), "id").alias("request_id"), F.col("id").alias("job_id"))
    return outcome.matched(a.select("request_id", "job_id"), answers.unionByName(late))


@query
def rec3_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    h = fx.health(spark, d).select("worker_id", "timestamp", "status")
    older = h.select("worker_id", fn.plus_seconds(F.col("timestamp"), F.lit(-60)).alias("timestamp"), F.lit("old").alias("status"))
    return recover.latest_heartbeats(h.unionByName(older)).select("worker_id", "status", "timestamp")


@query
def rec5_quarantine(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    raw = fx.jobs(spark, d).select(
        "id", F.col("id").alias("key_id"), "function_name", "job_params", F.when(k % 97 == 0, "LOST").otherwise(F.col("status")).alias("status"), F.when(k % 89 == 0, "soon").otherwise(F.col("enqueue_time").cast("string")).alias("enqueue_time"),
        F.col("current_retries").cast("string").alias("current_retries"), F.lit("x").alias("max_retries"), "dlq_name", "job_unique_key",
    )
    return recover.quarantined(recover.decoded(raw, SETTINGS), SETTINGS)


@query
def rec8_stale(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    return claim.stale(s.with_(jobs=s.jobs.where(F.col("id").cast("long") % 13 != 0))).select("job_id", "queue_name")


@query
def fn1_names(spark: SparkSession, d: str) -> DataFrame:
    j = fx.jobs(spark, d)
    short = F.when(F.col("id").cast("long") % 2 == 0, F.substring("queue_name", 7, 50)).otherwise(F.col("queue_name"))
    return j.select("id", fn.queue_key(short).alias("queue_name"), fn.dlq_key(F.col("id")).alias("dlq_key"))


@query
def fn3_json_path(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("job_params")
    return fx.jobs(spark, d).select("id", fn.json_scalar(p, "k").alias("k"), fn.json_scalar(p, "params.session.id").alias("session_id"), fn.json_scalar(p, "flag").alias("flag"), fn.json_scalar(p, "session").alias("object"))


@query
def fn6_correlation(spark: SparkSession, d: str) -> DataFrame:
    return fx.jobs(spark, d).select("id", F.to_json(fn.correlation(F.col("job_params"), F.col("trace_context"), {"session_id": "session.id", "traceparent": "none", "k": "params.k"})).alias("correlation"))


@query
def snk16_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = wire.encoded(fx.jobs(spark, d), "id", "status")
    return wire.messages(frames.select(F.hex("frame").alias("path"), F.col("frame").alias("content"))).select("at", "message", "problem")


@query
def snk8_dlq_remove(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    again = s.dlq.withColumn("pushed_seq", F.col("pushed_seq") + 1).where(F.col("job_id").cast("long") % 2 == 0)
    s = s.with_(dlq=s.dlq.unionByName(again))
    return sinks.undead(s, s.dlq.where(F.col("job_id").cast("long") % 3 == 0)).dlq


@query
def snk6_results(spark: SparkSession, d: str) -> DataFrame:
    s, k = fx.state(spark, d), F.col("id").cast("long")
    done = s.jobs.where("status = 'ACTIVE'").select("id", F.lit("7").alias("result"), (k % 3 - 1).alias("ttl_seconds"))
    return sinks.with_results(s, done, fx.now()).select("id", "status", "result", "completion_time", "expires_at")


@query
def met12_spans(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spans(fx.attempts(spark, d), fx.jobs(spark, d)).drop("worker_id", "retry_delay_ms")


@query
def met3_poll_cycles(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    return metrics.poll_cycles(fx.requests(spark, d).select((seq % 4).alias("free"), (seq % 3).alias("fetched")))


@query
def src24_generated(spark: SparkSession, d: str) -> DataFrame:
    return wire.generated_jobs(spark, 1000)


@query
def udf3_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long") % 5
    name = F.when(k == 0, "echo").when(k == 1, "error").when(k == 2, "slow").when(k == 3, "retry").when(F.col("id").cast("long") % 2 == 0, "abort").otherwise("missing")
    rows = fx.jobs(spark, d).select(F.col("id").alias("request_id"), F.col("id").alias("job_id"), name.alias("handler"), F.col("job_params").alias("params"), (F.col("current_retries") + 1).alias("attempt"))
    return handlers.run_handlers(rows, handlers.examples()).select("job_id", "status", "error_type")


QUERIES |= contracts.QUERIES
ORACLE_SQL = {k: v for k, v in (twins.SQL | contracts.SQL).items() if k in QUERIES}
