"""The test tables as job tables: orders become jobs, line items attempts, suppliers workers, events enqueue requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import epoch_ms, plus_seconds
from jobtide.operators.state import JobState
from jobtide.settings import QUEUE_PREFIX

#: One day after the last order: the moment at which the job tables are looked at.
NOW = "2024-01-02 00:00:00"
ERRORS = ("Connection timeout", "Invalid input", "Rate limit exceeded", "Resource not found", "Internal error")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", F.when(key % 3 == 0, "FAILED").otherwise("COMPLETED"))
        .when(F.col("o_orderstatus") == "P", F.when(key % 2 == 0, "ACTIVE").otherwise("RETRYING"))
        .otherwise(F.when(key % 10 == 0, "CANCELLED").otherwise("PENDING"))
    )
    begun = F.col("status").isin("FAILED", "COMPLETED", "ACTIVE", "RETRYING")
    done = F.col("status").isin("FAILED", "COMPLETED")
    rows = read(spark, sf_dir, "orders").withColumns({"status": status, "enqueue_time": _time("o_orderdate")})
    start = F.when(begun, plus_seconds(F.col("enqueue_time"), key % 50 + 1))
    end = F.when(done, plus_seconds(F.col("enqueue_time"), key % 50 + 2 + cust % 100))
    params = F.format_string('{"k":%d,"session":{"id":"s%d"},"flag":%s}', cust, cust % 40, F.when(key % 2 == 0, "true").otherwise("false"))
    return rows.select(
        key.cast("string").alias("id"),
        F.concat(F.lit("fn_"), (cust % 10).cast("string")).alias("function_name"),
        params.alias("job_params"),
        "enqueue_time",
        start.alias("start_time"),
        "status",
        (key % 4).alias("current_retries"),
        F.when(F.col("status") == "RETRYING", plus_seconds(F.col("enqueue_time"), key % 50 + 11)).alias("next_scheduled_run_time"),
        F.lit(5).cast("long").alias("max_retries"),
        F.when(key % 6 != 0, 30 * (1 + key % 10)).alias("job_timeout_seconds"),
        F.when(key % 11 != 0, 86_400 * (key % 3)).alias("result_ttl_seconds"),
        F.when(key % 8 == 0, F.concat(F.lit("u"), (cust % 50).cast("string"))).alias("job_unique_key"),
        end.alias("completion_time"),
        F.when(F.col("status") == "COMPLETED", F.lit('{"ok":true}')).alias("result"),
        F.when(F.col("status").isin("FAILED", "RETRYING"), F.element_at(F.array(*map(F.lit, ERRORS)), (key % 5 + 1).cast("int"))).alias("last_error"),
        F.concat(F.lit(QUEUE_PREFIX), F.regexp_replace(F.lower(F.substring("o_orderpriority", 3, 20)), " ", "_")).alias("queue_name"),
        F.when(key % 9 == 0, F.lit("dlq:bulk")).alias("dlq_name"),
        F.when(begun, F.concat(F.lit("w"), (cust % 100 + 1).cast("string"))).alias("worker_id"),
        F.when(key % 7 == 0, F.create_map(F.lit("traceparent"), key.cast("string"))).alias("trace_context"),
        F.lit(None).cast("map<string,string>").alias("correlation_context"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, attempt (from 1), worker_id, start_time, duration_ms, outcome, queue_name, function_name."""
    # joined by the number, as the window has it dealt out and sorted already
    o = jobs(spark, sf_dir).select(F.col("id").cast("long").alias("l_orderkey"), F.col("id").alias("job_id"), "enqueue_time", "queue_name", "function_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").withColumn("attempt", F.row_number().over(order))
    outcome = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "R", "retry").when(F.col("l_linestatus") == "F", "error").otherwise("timeout")
    li = li.select("l_orderkey", "attempt", F.concat(F.lit("w"), F.col("l_suppkey").cast("string")).alias("worker_id"), (F.col("l_quantity") * 1000).cast("double").alias("duration_ms"), outcome.alias("outcome"))
    return li.join(o, "l_orderkey").select("job_id", "attempt", "worker_id", plus_seconds(F.col("enqueue_time"), F.col("attempt") * 3600).alias("start_time"), "duration_ms", "outcome", "queue_name", "function_name")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heartbeat a supplier; three in four are alive at NOW."""
    key = F.col("s_suppkey")
    alive = key % 4 != 0
    at = plus_seconds(now(), F.when(alive, -(key % 60)).otherwise(F.lit(-3600)))
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("w"), key.cast("string")).alias("worker_id"), at.alias("timestamp"), F.when(key % 5 == 0, "idle").otherwise("running").alias("status"), (key % 7).cast("long").alias("active_jobs"), F.lit(8).cast("long").alias("concurrency_limit"),
        F.array(F.concat(F.lit(QUEUE_PREFIX), F.when(key % 2 == 0, "high").otherwise("low"))).alias("queues"), plus_seconds(at, F.lit(70)).alias("expires_at"),
    )


def state(spark: SparkSession, sf_dir: str) -> JobState:
    j = jobs(spark, sf_dir)
    key = F.col("id").cast("long")
    waiting = j.where(F.col("status").isin("PENDING", "RETRYING"))
    queue = waiting.select("queue_name", F.col("id").alias("job_id"), epoch_ms(F.coalesce("next_scheduled_run_time", "enqueue_time")).cast("double").alias("score_ms"))
    running = j.where("status = 'ACTIVE'")
    active = running.select("worker_id", F.col("id").alias("job_id"), (epoch_ms(F.col("start_time")) / 1000.0).alias("start_s"))
    locks = j.where((F.col("status").isin("ACTIVE", "PENDING")) & (key % 5 == 1)).select(F.col("id").alias("job_id"), F.coalesce("worker_id", F.lit("w0")).alias("owner"), plus_seconds(now(), F.when(key % 10 == 1, 30).otherwise(-30)).alias("expires_at"))
    failed = j.where("status = 'FAILED'")
    dlq = failed.select(F.coalesce("dlq_name", F.lit("dlq:default")).alias("dlq_name"), F.col("id").alias("job_id"), (epoch_ms(F.col("completion_time")) * 1_000_000 + key % 1_000_000).alias("pushed_seq"))
    unique = j.where("job_unique_key is not null and status in ('ACTIVE', 'PENDING')").groupBy(F.col("job_unique_key").alias("key")).agg(F.min("id").alias("job_id"))
    unique = unique.withColumn("expires_at", plus_seconds(now(), F.length("key") * 100 - 200))
    return JobState(jobs=j, queue=queue, job_locks=locks, unique_locks=unique, active=active, dlq=dlq, health=health(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, function_name, ts, params of every enqueue request."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("function_name"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("props").alias("params"), "value")


@dataclass(frozen=True)
class Routes:
    """A few runners and routes, as in a settings file."""

    default: str = "python"
    routes: tuple[tuple[str, str], ...] = (("queue:urgent", "rust"), ("queue:low", "node"))
