"""Queries that hold single operators to their rules over whole tables, each next to its SQL twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions import scalars as fn
from jobtide.operators import admin, admit, claim, cron, handlers, metrics, outcome, recover, sinks
from jobtide.operators.state import patched
from jobtide.plans.twins import ALL, ATTEMPTS, NOW, NOW_MS, REQUESTS, over
from jobtide.settings import Settings
from jobtide.sources import fixtures as fx
from jobtide.sources import lookups, wire

SETTINGS = Settings()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its name with its SQL twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def key(c: str = "id") -> Column:
    return F.col(c).cast("long")


def text(c: Column) -> Column:
    return c.cast("string")


def tag(name: str, value: Column) -> Column:
    """A map of one entry, as a value that may be null."""
    return F.when(value.isNotNull(), F.create_map(F.lit(name), value))


# scans and lookups


@query(over("SELECT id FROM jobs"))
def src1_scan(spark: SparkSession, d: str) -> DataFrame:
    return fx.state(spark, d).jobs.select("id")


@query(over("SELECT DISTINCT queue_name FROM queue"))
def src2_queue_names(spark: SparkSession, d: str) -> DataFrame:
    return lookups.queue_names(fx.state(spark, d))


@query(over("SELECT DISTINCT worker_id FROM active"))
def src3_active_workers(spark: SparkSession, d: str) -> DataFrame:
    return lookups.active_workers(fx.state(spark, d))


@query(over(f"SELECT DISTINCT worker_id FROM health WHERE expires_at > {NOW}"))
def src4_live_workers(spark: SparkSession, d: str) -> DataFrame:
    return lookups.live_workers(fx.state(spark, d), fx.now())


@query(over("SELECT id, function_name FROM jobs WHERE function_name || '.' || id LIKE 'fn__._7%' AND function_name IN ('fn_1','fn_2','fn_3')"))
def src5_glob(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.jobs(spark, d).select("id", "function_name", F.concat_ws(".", "function_name", "id").alias("key"))
    return lookups.keys_like(rows, "key", "fn_[1-3].?7*").drop("key")


@query(over("SELECT id, function_name, status, queue_name, current_retries, enqueue_time FROM jobs WHERE id = '7'"))
def src6_job(spark: SparkSession, d: str) -> DataFrame:
    return lookups.job(fx.state(spark, d), "7").select("id", "function_name", "status", "queue_name", "current_retries", "enqueue_time")


_TEXTS = "completion_time correlation_context current_retries dlq_name enqueue_time function_name id job_params job_timeout_seconds job_unique_key last_error max_retries next_scheduled_run_time queue_name result result_ttl_seconds start_time status trace_context worker_id".split()
_AS_TEXT = {"correlation_context": "NULL::VARCHAR", "trace_context": """'{"traceparent":"' || traceparent || '"}'"""}
_FIELDS = "[" + ", ".join(f"struct_pack(field := '{c}', value := {_AS_TEXT.get(c, c + '::VARCHAR')})" for c in _TEXTS) + "]"


@query(over(f"SELECT f.field AS field, f.value AS value FROM (SELECT unnest({_FIELDS}) AS f FROM jobs WHERE id = '7') WHERE f.value IS NOT NULL"))
def src8_raw_map(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    return admin.raw_maps(lookups.job(s, "7")).select(F.explode("fields").alias("field", "value"))


@query(over(f"SELECT id, f.field AS field, f.value AS value FROM (SELECT id, unnest({_FIELDS}) AS f FROM jobs) WHERE f.value IS NOT NULL"))
def src9_raw_maps(spark: SparkSession, d: str) -> DataFrame:
    return admin.raw_maps(fx.state(spark, d).jobs).select("id", F.explode("fields").alias("field", "value"))


@query(over("""SELECT id, function_name, CASE WHEN k%97<>0 THEN status END AS status, CASE WHEN k%5<>0 THEN current_retries ELSE 0 END AS current_retries, 5::BIGINT AS max_retries, job_timeout_seconds,
  CASE WHEN k%89<>0 THEN enqueue_time END AS enqueue_time, start_time, completion_time, result, worker_id, CASE WHEN k%13=0 THEN '{}' ELSE job_params END AS job_params, traceparent, k%97=0 OR k%89=0 AS is_malformed FROM jobs"""))
def src10_decoded(spark: SparkSession, d: str) -> DataFrame:
    j, k = fx.jobs(spark, d), key()
    maps = ("trace_context", "correlation_context")
    raw = j.select(*[F.to_json(c).alias(c) if c in maps else text(F.col(c)).alias(c) for c in j.columns])
    spoilt = {
        "id": F.when(k % 3 != 0, F.col("id")), "status": F.when(k % 97 == 0, "LOST").otherwise(F.col("status")), "enqueue_time": F.when(k % 89 == 0, "soon").otherwise(F.col("enqueue_time")), "max_retries": F.lit("x"),
        "current_retries": F.when(k % 5 == 0, "many").otherwise(F.col("current_retries")), "job_params": F.when(k % 13 == 0, "{bad").otherwise(F.col("job_params")), "result": F.coalesce("result", F.lit("null")),
    }
    raw = raw.withColumn("key_id", F.col("id")).withColumns(spoilt)
    kept = "id function_name status current_retries max_retries job_timeout_seconds enqueue_time start_time completion_time result worker_id job_params is_malformed".split()
    return recover.decoded(raw, SETTINGS).select(*kept, F.col("trace_context")["traceparent"].alias("traceparent"))


@query(over("SELECT dlq_name, row_number() OVER (PARTITION BY dlq_name ORDER BY pushed_seq DESC, job_id)-1 AS at, job_id FROM dlq"))
def src13_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return lookups.dead_letters(fx.state(spark, d))


@query(over("SELECT worker_id, row_number() OVER (PARTITION BY worker_id ORDER BY start_s, job_id)-1 AS at, job_id FROM active"))
def src14_active_jobs(spark: SparkSession, d: str) -> DataFrame:
    return lookups.active_jobs(fx.state(spark, d))


@query(over("SELECT queue_name, id AS job_id, status IN ('PENDING','RETRYING') AS queued FROM jobs"))
def src15_membership(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    return lookups.queued_or_not(s, s.jobs.select("queue_name", F.col("id").alias("job_id")))


@query(over(f"SELECT id AS job_id, owner FROM jobs LEFT JOIN (SELECT * FROM locks WHERE expires_at > {NOW}) ON job_id = id"))
def src16_lock_owner(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    return lookups.lock_owners(s, s.jobs.select(F.col("id").alias("job_id")), fx.now())


@query(over("SELECT CASE WHEN seq%9<>0 THEN function_name END AS function_name, CASE WHEN seq%9<>0 THEN seq::VARCHAR END AS job_id, CASE WHEN seq%9<>0 THEN value END AS defer_by_seconds, CASE WHEN seq%9=0 THEN 'malformed request' END AS problem FROM requests", REQUESTS))
def src21_requests(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    body = F.to_json(F.struct("function_name", "params", F.struct(text(seq).alias("job_id"), F.col("value").alias("defer_by_seconds")).alias("options")))
    lines = fx.requests(spark, d).select(F.when(seq % 9 != 0, body).otherwise("oops").alias("value"))
    return wire.enqueue_requests(lines).select("function_name", "options.job_id", "options.defer_by_seconds", "problem")


@query(over("""SELECT id AS path, n AS at, CASE WHEN n=1 OR k%10<>0 THEN '{"id":"' || id || '","status":"' || status || '"}' END AS message, CASE WHEN n=2 AND k%10=0 THEN 'cut frame' END AS problem FROM
  (SELECT *, unnest([1, 2]) AS n FROM jobs)""").replace("n AS at", "(n-1)::BIGINT AS at"))
def src22_messages(spark: SparkSession, d: str) -> DataFrame:
    one = fn.frame(F.to_json(F.struct("id", "status")))
    two = fx.jobs(spark, d).select(F.col("id").alias("path"), F.concat(one, one).alias("content"))
    cut = F.when(key("path") % 10 == 0, F.expr("substring(content, 1, length(content) - 1)")).otherwise(F.col("content"))
    return wire.messages(two.withColumn("content", cut))


_PATH = "CASE k%4 WHEN 0 THEN function_name || '/' || id || '.py' WHEN 1 THEN function_name || '/' || id || '.txt' WHEN 2 THEN function_name || '/' || id || '.rs' ELSE '.git/' || id || '.py' END"


@query(over(f"""SELECT path, (path LIKE '%.py' OR path LIKE '%.rs') AND NOT starts_with(path, '.git/') AND NOT starts_with(path, 'fn_3/') AND NOT starts_with(path, 'fn_5/') AND NOT (path LIKE '%6.rs' AND path NOT LIKE '%/26.rs') AS restart
  FROM (SELECT {_PATH} AS path FROM jobs)"""))
def src23_restart(spark: SparkSession, d: str) -> DataFrame:
    k, of = key() % 4, lambda end: F.concat("function_name", F.lit("/"), "id", F.lit(end))
    path = F.when(k == 0, of(".py")).when(k == 1, of(".txt")).when(k == 2, of(".rs")).otherwise(F.concat(F.lit(".git/"), "id", F.lit(".py")))
    return wire.restart_for(fx.jobs(spark, d).select(path.alias("path")), ["**/*.py", "*.rs"], [".git/**", "fn_3/*"], ["# built files", "fn_5/", "*6.rs", "!26.rs"])


def _drawn(salt: int, most: int) -> str:
    return f"((((n % 2147483648) + {7919 + salt * 104729}) * 1103515245 + 12345) % 2147483648) // 65536 % {most}"


@query(f"""SELECT 'gen-w' || (n%50) AS worker_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((n//50)*60) AS timestamp, CASE WHEN {_drawn(5, 4)}=0 THEN 'idle' ELSE 'running' END AS status, ({_drawn(6, 8)})::BIGINT AS active_jobs FROM range(0, 1000) t(n)""")
def src25_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    return wire.generated_heartbeats(spark, 50, 20)


SQL["src24_generated"] = f"""SELECT 'gen-' || n AS id, 'fn_' || ({_drawn(1, 10)}) AS function_name, 'queue:' || (['default','high','low','bulk'])[({_drawn(2, 4)}+1)::INT] AS queue_name,
  (['PENDING','ACTIVE','COMPLETED','FAILED'])[({_drawn(3, 4)}+1)::INT] AS status, ({_drawn(4, 86400)})::BIGINT AS age_s FROM range(0, 1000) t(n)"""
SQL["snk16_frames"] = over("""SELECT 0::BIGINT AS at, '{"id":"' || id || '","status":"' || status || '"}' AS message, NULL::VARCHAR AS problem FROM jobs""")
SQL["adm7_job_show"] = SQL["src8_raw_map"]
SQL["fn6_correlation"] = over("""SELECT id, '{"k":"' || o_custkey || '","session_id":"s' || (o_custkey%40) || '"' || CASE WHEN k%7=0 THEN ',"traceparent":"' || k || '"' ELSE '' END || '}' AS correlation FROM jobs""")


# writes


@query(over("SELECT id, CASE WHEN status='FAILED' THEN 'CANCELLED' ELSE status END AS status, CASE WHEN status='FAILED' THEN 'late' ELSE last_error END AS last_error FROM jobs"))
def snk1_saved(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    failed = s.jobs.where("status = 'FAILED'").withColumn("status", F.lit("CANCELLED"))
    early = failed.withColumns({"last_error": F.lit("early"), "enqueue_time": fn.plus_seconds(F.col("enqueue_time"), F.lit(-5))})
    return sinks.saved(s, early.unionByName(failed.withColumn("last_error", F.lit("late")))).jobs.select("id", "status", "last_error")


@query(over("SELECT queue_name, job_id, CASE WHEN job_id::BIGINT%2=0 THEN 1.0 ELSE score_ms END::DOUBLE AS score_ms FROM queue UNION ALL SELECT 'queue:extra', job_id, 1.0 FROM queue WHERE job_id::BIGINT%4=0"))
def snk3_queued(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    again = s.queue.where(key("job_id") % 2 == 0).withColumn("score_ms", F.lit(1.0))
    other = again.where(key("job_id") % 4 == 0).withColumn("queue_name", F.lit("queue:extra"))
    return sinks.queued(s, again.unionByName(other)).queue


@query(over("SELECT queue_name, job_id, job_id::BIGINT%3=0 AS removed FROM queue"))
def snk4_unqueued(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    asked = s.jobs.where(key() % 3 == 0).select("queue_name", F.col("id").alias("job_id"))
    new, gone = sinks.unqueued(s, asked)
    return new.queue.select("queue_name", "job_id", F.lit(False).alias("removed")).unionByName(gone.select("queue_name", "job_id", F.lit(True).alias("removed")))


@query(over("SELECT id, CASE WHEN k%6=0 THEN 'X' ELSE status END AS status, CASE WHEN k%2=0 THEN 'note' ELSE last_error END AS last_error, queue_name FROM jobs"))
def snk5_patched(spark: SparkSession, d: str) -> DataFrame:
    j = fx.jobs(spark, d)
    patches = j.where(key() % 2 == 0).select("id", F.when(key() % 3 == 0, "X").alias("status"), F.lit("note").alias("last_error"))
    return patched(j, patches, "id", "status", "last_error").select("id", "status", "last_error", "queue_name")


_DEAD = f"status='ACTIVE' AND k%4=0"


@query(over(f"SELECT id, CASE WHEN {_DEAD} THEN 'FAILED' ELSE status END AS status, CASE WHEN {_DEAD} THEN 'bad' ELSE last_error END AS last_error, CASE WHEN {_DEAD} THEN {NOW} + INTERVAL 7 DAY END AS expires_at, CASE WHEN {_DEAD} OR status='FAILED' THEN coalesce(dlq_name,'dlq:default') END AS on_list FROM jobs"))
def snk7_dead(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    s = sinks.dead(s, s.jobs.where((F.col("status") == "ACTIVE") & (key() % 4 == 0)).select("id", F.lit("bad").alias("error")), fx.now(), SETTINGS)
    return s.jobs.select("id", "status", "last_error", "expires_at").join(s.dlq.select(F.col("job_id").alias("id"), F.col("dlq_name").alias("on_list")), "id", "left")


@query(over("SELECT id FROM jobs WHERE NOT (id LIKE '1%' OR id LIKE '%9')"))
def snk9_deleted(spark: SparkSession, d: str) -> DataFrame:
    return lookups.deleted_like(lookups.deleted_like(fx.jobs(spark, d).select("id"), "id", "1*"), "id", "*9")


@query(over("SELECT worker_id, timestamp, timestamp + INTERVAL 70 SECOND AS expires_at FROM health"))
def snk10_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    return recover.heartbeat(fx.health(spark, d).select("worker_id", "timestamp"), SETTINGS)


@query(over("SELECT worker_id, job_id, CASE WHEN job_id::BIGINT%3=0 THEN 5.0 ELSE start_s END::DOUBLE AS start_s FROM active WHERE job_id::BIGINT%4<>0"))
def snk11_active(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    s = sinks.tracked(s, s.active.where(key("job_id") % 3 == 0).withColumn("start_s", F.lit(5.0)))
    return sinks.untracked(s, s.active.where(key("job_id") % 4 == 0).select("worker_id", "job_id")).active.select("worker_id", "job_id", "start_s")


@query(over("""SELECT CASE WHEN k%2=0 THEN '{"k":' || k || ',x' ELSE id END AS message, CASE WHEN k%2=0 AND k%3=0 THEN 'warn' ELSE 'info' END AS level, 'r1' AS runner FROM jobs""").replace("""'{"k":' || k || ',x'""", "'m' || id"))
def snk15_events(spark: SparkSession, d: str) -> DataFrame:
    k = key()
    body = F.to_json(F.struct(F.concat(F.lit("m"), "id").alias("message"), F.when(k % 3 == 0, "warn").alias("level")))
    lines = fx.jobs(spark, d).select(F.when(k % 2 == 0, body).otherwise(F.col("id")).alias("value"))
    e = F.col("event")
    return wire.runner_events(lines, "r1", "now").select(e["message"].alias("message"), e["level"].alias("level"), e["runner"].alias("runner"))


# admission


def folded(ttl_ms: str, blocked: str, start: str = "NULL::BIGINT", source: str = "requests") -> str:
    """CTEs that jump along each key's admitted requests, past blocked ones and those before ``start`` (a column of ``r`` in milliseconds)."""
    return f"""r AS (SELECT *, epoch_us(ts)//1000 AS ms, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n, ({ttl_ms})::BIGINT AS ttl, {blocked} AS blocked, {start} AS start FROM {source}),
taken AS (SELECT key, n, seq, ms, ms + ttl AS until FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n) AS first FROM r WHERE NOT blocked AND (start IS NULL OR ms >= start)) WHERE first = 1
  UNION ALL SELECT x.key, x.n, x.seq, x.ms, x.ms + x.ttl FROM (SELECT r.key, r.n, r.seq, r.ms, r.ttl, row_number() OVER (PARTITION BY r.key ORDER BY r.n) AS first FROM taken JOIN r ON r.key = taken.key AND NOT r.blocked AND r.ms >= taken.until AND r.n > taken.n) x WHERE x.first = 1),
told AS (SELECT r.*, t.seq AS last_seq, t.until FROM r LEFT JOIN (SELECT r.seq AS of, max(t.n) AS n FROM r JOIN taken t ON t.key = r.key AND t.n <= r.n GROUP BY 1) m ON m.of = r.seq LEFT JOIN taken t ON t.key = r.key AND t.n = m.n)"""


_CONTRACT = f"""{REQUESTS}, asked AS (SELECT seq, key, ts, CASE WHEN seq%37=0 THEN ' ' ELSE function_name END AS function_name, CASE WHEN seq%53=0 THEN (seq%15)::VARCHAR ELSE 'r' || (seq - CASE WHEN seq%10=0 THEN seq%4 ELSE 0 END) END AS id, CASE WHEN seq%41=0 THEN 0 ELSE 60+seq%7 END AS timeout,
  CASE WHEN seq%4<>0 THEN key END AS ukey, CASE WHEN seq%3=0 THEN 86400.5 END AS uttl, seq%3*40000.25 AS defer FROM requests),
checked AS (SELECT *, CASE WHEN trim(function_name)='' THEN 'function_name cannot be empty' WHEN timeout<=0 THEN 'job_timeout_seconds must be positive' END AS reason FROM asked),
good AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq)=1 AND id NOT IN (SELECT id FROM jobs) AS new FROM checked WHERE reason IS NULL),
held AS (SELECT DISTINCT key, CASE WHEN key::BIGINT%20=0 THEN '1' ELSE 'gone' END AS job_id, TIMESTAMP '2024-01-06 00:00:00' AS expires_at FROM requests WHERE key::BIGINT%10=0), alive AS (SELECT * FROM held WHERE job_id IN (SELECT id FROM jobs)),
g AS (SELECT good.*, a.job_id AS held_id, epoch_ms(a.expires_at) AS held_ms FROM good LEFT JOIN alive a ON a.key = good.ukey WHERE ukey IS NOT NULL),
{folded("ceil(greatest(coalesce(uttl, 21600), ceil(defer)))*1000", "NOT new", "held_ms", "g")},
state AS (SELECT seq, CASE WHEN last_seq = seq THEN 'enqueued' WHEN last_seq IS NULL AND held_ms IS NOT NULL AND ms < held_ms OR last_seq IS NOT NULL AND ms < until THEN 'existing' ELSE 'duplicate' END AS status, last_seq, held_id FROM told),
answers AS (SELECT s.seq, CASE WHEN status='existing' THEN coalesce(l.id, s.held_id) ELSE o.id END AS job_id, status, NULL::VARCHAR AS reason FROM state s JOIN good o ON o.seq = s.seq LEFT JOIN good l ON l.seq = s.last_seq
  UNION ALL SELECT seq, id, CASE WHEN new THEN 'enqueued' ELSE 'duplicate' END, NULL FROM good WHERE ukey IS NULL UNION ALL SELECT seq, NULL, 'rejected', reason FROM checked WHERE reason IS NOT NULL)"""


def _produced(spark: SparkSession, d: str) -> tuple:
    seq, r = F.col("seq"), fx.requests(spark, d)
    asked = r.select(
        "seq", "ts", F.when(seq % 37 == 0, " ").otherwise(F.col("function_name")).alias("function_name"), F.when(seq % 53 == 0, text(seq % 15)).otherwise(F.concat(F.lit("r"), text(seq - F.when(seq % 10 == 0, seq % 4).otherwise(0)))).alias("id"), "params",
        F.when(seq % 41 == 0, 0).otherwise(60 + seq % 7).alias("job_timeout_seconds"), F.when(seq % 4 != 0, F.col("key")).alias("unique_key"), F.when(seq % 3 == 0, 86400.5).alias("unique_ttl_seconds"), (seq % 3 * 40000.25).alias("defer_by_seconds"),
        F.when(seq % 2 == 0, "low").alias("queue_name"), tag("t", F.when(seq % 5 == 0, text(seq))).alias("trace_context"),
    )
    held = r.select("key").distinct().where(key("key") % 10 == 0).select("key", F.when(key("key") % 20 == 0, "1").otherwise("gone").alias("job_id"), F.lit("2024-01-06 00:00:00").cast("timestamp_ntz").alias("expires_at"))
    return admit.produce(fx.state(spark, d), asked, SETTINGS, held)


@query(f"WITH RECURSIVE {ALL}, {_CONTRACT} SELECT seq, job_id, status, reason FROM answers")
def enq1_contract(spark: SparkSession, d: str) -> DataFrame:
    return _produced(spark, d)[1]


@query(f"""WITH RECURSIVE {ALL}, {_CONTRACT}, made AS (SELECT o.*, r.params FROM answers a JOIN good o USING (seq) JOIN requests r USING (seq) WHERE a.status='enqueued')
SELECT id, function_name, params AS job_params, timeout AS job_timeout_seconds, 5::BIGINT AS max_retries, 86400::BIGINT AS result_ttl_seconds, CASE WHEN seq%2=0 THEN 'queue:low' ELSE 'queue:default' END AS queue_name, ukey AS job_unique_key, CASE WHEN seq%5=0 THEN seq::VARCHAR END AS trace,
  (epoch_us(ts)//1000 + CASE WHEN defer > 0 THEN ceil(defer*1000) ELSE 0 END)::DOUBLE AS score_ms FROM made""")
def enq1_contract_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = _produced(spark, d)[0]
    new = s.jobs.where(F.col("id").startswith("r"))
    fields = ["id", "function_name", "job_params", "job_timeout_seconds", "max_retries", "result_ttl_seconds", "queue_name", "job_unique_key"]
    return new.select(*fields, F.col("trace_context")["t"].alias("trace")).join(s.queue.select(F.col("job_id").alias("id"), "score_ms"), "id")


@query(f"WITH RECURSIVE {REQUESTS}, {folded('greatest(3600, ceil(seq%5*7200.5))*1000', 'false')} SELECT seq, last_seq AS job_seq, last_seq = seq AS created FROM told")
def enq3_deferral(spark: SparkSession, d: str) -> DataFrame:
    return admit.idempotent(fx.requests(spark, d), 3600, F.col("seq") % 5 * 7200.5)


@query(f"WITH RECURSIVE {REQUESTS}, {folded('86400000', 'seq%3=0')} SELECT seq, CASE WHEN last_seq = seq THEN 'enqueued' WHEN last_seq IS NOT NULL AND ms < until THEN 'rate_limited' ELSE 'duplicate' END AS status FROM told")
def enq5_roll_back(spark: SparkSession, d: str) -> DataFrame:
    found = admit.rate_limited(fx.requests(spark, d), 86_400, blocked=F.col("seq") % 3 == 0)
    return found.select("seq", admit.rate_limit_status(F.col("admitted"), F.col("refused")).alias("status"))


_RUNS = f"""{REQUESTS}, leaves AS (SELECT key, ts + INTERVAL 1 HOUR AS at FROM requests WHERE seq%5=0), p AS (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS prev FROM requests),
q AS (SELECT p.*, prev IS NULL OR epoch_us(ts)//1000 >= epoch_us(prev)//1000 + 21600000 OR EXISTS (SELECT 1 FROM leaves l WHERE l.key = p.key AND epoch_us(l.at)//1000 > epoch_us(p.prev)//1000 AND l.at <= p.ts) AS new FROM p),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY key ORDER BY ts, seq) AS run FROM q)"""


def _debounce_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seq, r = F.col("seq"), fx.requests(spark, d)
    r = r.withColumns({"max_retries": seq % 7, "queue_name": F.when(seq % 2 == 0, "queue:even").otherwise("queue:odd"), "trace_context": tag("t", F.when(seq % 3 == 0, text(seq))), "correlation_context": tag("c", F.when(seq % 4 == 0, text(seq)))})
    leaves = r.where(seq % 5 == 0).select("key", fn.plus_seconds(F.col("ts"), F.lit(3600)).alias("at"))
    return r, leaves


@query(f"WITH {_RUNS} SELECT key, min_by(seq, (ts,seq)) AS job_seq, max_by(seq, (ts,seq)) AS last_seq, count(*) AS requests, make_timestamp((epoch_us(max(ts))//1000 + 21600000)*1000) AS scheduled FROM runs GROUP BY key, run")
def enq7_debounce_pending(spark: SparkSession, d: str) -> DataFrame:
    r, leaves = _debounce_input(spark, d)
    return admit.debounced(r, 6 * 3600, leaves).select("key", "job_seq", "last_seq", "requests", "scheduled")


@query(f"""WITH {_RUNS} SELECT key, min_by(seq, (ts,seq)) AS job_seq, max_by(function_name, (ts,seq)) AS function_name, max_by(params, (ts,seq)) AS params, max_by(seq, (ts,seq))%7 AS max_retries, CASE WHEN max_by(seq, (ts,seq))%2=0 THEN 'queue:even' ELSE 'queue:odd' END AS queue_name,
  max_by(seq, (ts,seq)) FILTER (seq%3=0)::VARCHAR AS trace, CASE WHEN max_by(seq, (ts,seq))%4=0 THEN max_by(seq, (ts,seq))::VARCHAR END AS correlation FROM runs GROUP BY key, run""")
def enq8_overwrite(spark: SparkSession, d: str) -> DataFrame:
    r, leaves = _debounce_input(spark, d)
    return admit.debounced(r, 6 * 3600, leaves).select("key", "job_seq", "function_name", "params", "max_retries", "queue_name", F.col("trace_context")["t"].alias("trace"), F.col("correlation_context")["c"].alias("correlation"))


@query(f"WITH {_RUNS}, f AS (SELECT *, first_value(seq) OVER (PARTITION BY key, run ORDER BY ts, seq) AS job_seq FROM runs) SELECT CASE WHEN seq%2=0 THEN 'queue:even' ELSE 'queue:odd' END AS queue_name, job_seq, max(epoch_us(ts)//1000 + 21600000)::DOUBLE AS score_ms FROM f GROUP BY 1, 2")
def enq8_entries(spark: SparkSession, d: str) -> DataFrame:
    r, leaves = _debounce_input(spark, d)
    return admit.debounce_entries(r, 6 * 3600, leaves)


_WHEN = "CASE WHEN seq%3=0 THEN ts + INTERVAL 1 DAY WHEN seq%2=0 THEN ts ELSE make_timestamp((epoch_us(ts)//1000 + ceil(seq%50*100.1234)::BIGINT)*1000) END"


def _wishes(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    seq = F.col("seq")
    rows = fx.requests(spark, d)
    return rows, F.when(seq % 3 == 0, fn.plus_seconds(F.col("ts"), F.lit(86_400))), F.when(seq % 2 == 0, 0.0).otherwise(seq % 50 * 0.1001234)


@query(over(f"SELECT seq, {_WHEN.replace('100.1234', '100.1234')} AS due FROM requests", REQUESTS))
def enq11_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows, until, by = _wishes(spark, d)
    return rows.select("seq", admit.schedule(F.col("ts"), until, by).alias("due"))


@query(f"WITH RECURSIVE {REQUESTS}, {folded('21600000', 'seq%3=1')} SELECT seq, last_seq IS NOT NULL AND last_seq = seq AS takes_lock, make_timestamp(CASE WHEN last_seq = seq OR last_seq IS NULL OR ms >= until THEN ms ELSE greatest(ms, until) END * 1000) AS scheduled FROM told")
def enq14_lock_release(spark: SparkSession, d: str) -> DataFrame:
    return admit.unique_deferred(fx.requests(spark, d), SETTINGS, blocked=F.col("seq") % 3 == 1)


@query(over(f"SELECT seq, CASE WHEN seq%4=0 THEN make_timestamp((epoch_us(ts)//1000 + 2500)*1000) ELSE {_WHEN} END AS due FROM requests", REQUESTS))
def enq15_due(spark: SparkSession, d: str) -> DataFrame:
    rows, until, by = _wishes(spark, d)
    mode = admit.mode(F.lit(None).cast("string"), F.lit(None).cast("string"), F.when(F.col("seq") % 4 == 0, "k"))
    return rows.select("seq", admit.due(mode, F.col("ts"), F.lit(2.5), until, by).alias("due"))


# claims


@query(over(f"SELECT id AS job_id, status IN ('PENDING','RETRYING') AND k%5<>1 OR status IN ('PENDING','RETRYING') AND id NOT IN (SELECT job_id FROM locks WHERE expires_at > {NOW}) AS started FROM jobs WHERE k%2=1"))
def clm3_lock_and_start(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    return claim.lock_and_start(s, s.jobs.where(key() % 2 == 1).select("queue_name", F.col("id").alias("job_id")), fx.now(), "w7", 30)[1]


@query(over(f"""SELECT id, CASE WHEN hit THEN 'ACTIVE' ELSE status END AS status, CASE WHEN hit THEN 'w7' ELSE worker_id END AS worker_id, CASE WHEN hit THEN 'w7' ELSE owner END AS owner, status IN ('PENDING','RETRYING') AND NOT hit AS queued
  FROM (SELECT jobs.*, l.owner, k%2=1 AND status IN ('PENDING','RETRYING') AND l.owner IS NULL AS hit FROM jobs LEFT JOIN (SELECT * FROM locks WHERE expires_at > {NOW}) l ON l.job_id = id)"""))
def clm3_started_state(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    s, _ = claim.lock_and_start(s, s.jobs.where(key() % 2 == 1).select("queue_name", F.col("id").alias("job_id")), fx.now(), "w7", 30)
    queued = s.queue.select(F.col("job_id").alias("id"), F.lit(True).alias("q"))
    return s.jobs.select("id", "status", "worker_id").join(s.job_locks.select(F.col("job_id").alias("id"), "owner"), "id", "left").join(queued, "id", "left").select("id", "status", "worker_id", "owner", F.coalesce("q", F.lit(False)).alias("queued"))


@query(over("SELECT worker_id, greatest(0, concurrency_limit - coalesce(n, 0)) AS free FROM health LEFT JOIN (SELECT worker_id, count(*) AS n FROM active GROUP BY 1) USING (worker_id)"))
def clm5_capacity(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    return claim.capacity(s, s.health.select("worker_id", "concurrency_limit"))


@query(over(f"SELECT job_id, owner, CASE WHEN job_id::BIGINT%3=0 THEN {NOW} + INTERVAL 99 SECOND ELSE expires_at END AS expires_at FROM locks WHERE expires_at > {NOW}"))
def clm6_refresh(spark: SparkSession, d: str) -> DataFrame:
    s, k = fx.state(spark, d), key("job_id")
    owners = s.job_locks.select("job_id", F.when(k % 3 == 0, F.col("owner")).otherwise("someone").alias("owner"))
    return claim.refreshed(s, owners, fx.now(), 99).job_locks


@query(over("SELECT job_id, owner FROM locks WHERE job_id::BIGINT%3<>0"))
def clm7_unlocked(spark: SparkSession, d: str) -> DataFrame:
    s, k = fx.state(spark, d), key("job_id")
    asked = s.job_locks.select("job_id", F.when(k % 3 == 0, F.col("owner")).otherwise("someone").alias("owner"))
    return claim.unlocked(s, asked).job_locks.select("job_id", "owner")


@query(over(f"SELECT k*2+n AS seq, n=0 AND id NOT IN (SELECT job_id FROM locks WHERE expires_at > {NOW}) AS got FROM (SELECT *, unnest([0, 1]) AS n FROM jobs)"))
def clm7_try_lock(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    wishes = s.jobs.select(F.col("id").alias("job_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    wishes = wishes.select("job_id", F.concat(F.lit("o"), text(F.col("n"))).alias("owner"), F.lit(5).alias("seconds"), (key("job_id") * 2 + F.col("n")).alias("seq"))
    return claim.try_lock(s, wishes, fx.now())[1]


@query(over("SELECT id, array_to_string(list_sort(list_distinct([queue_name, 'queue:b', 'queue:' || function_name])), ',') AS queues FROM jobs"))
def clm9_queues(spark: SparkSession, d: str) -> DataFrame:
    return fx.jobs(spark, d).select("id", F.array_join(claim.normal_queues(F.array("queue_name", F.substring("queue_name", 7, 50), F.lit("b"), F.lit("queue:b"), F.col("function_name"))), ",").alias("queues"))


# outcomes and recovery


_NAMES = "CASE k%4 WHEN 0 THEN 'gpu#' || function_name WHEN 1 THEN 'python#' ELSE function_name END"


@query(over(f"""SELECT id, CASE WHEN timeout <= 0 THEN 'Invalid job timeout: ' || timeout || '. Must be positive.' WHEN k%4=1 THEN 'Handler name is missing' WHEN k%4=0 THEN 'No runner configured for ''gpu''.' END AS problem,
  CASE WHEN timeout <= 0 OR k%4 < 2 THEN 'FAILED' END AS status FROM (SELECT *, CASE WHEN k%10=0 THEN 0 ELSE coalesce(job_timeout_seconds, 300) END AS timeout FROM jobs)"""))
def out1_prechecks(spark: SparkSession, d: str) -> DataFrame:
    k = key()
    name = F.when(k % 4 == 0, F.concat(F.lit("gpu#"), "function_name")).when(k % 4 == 1, F.lit("python#")).otherwise(F.col("function_name"))
    jobs = fx.jobs(spark, d).withColumns({"function_name": name, "job_timeout_seconds": F.when(k % 10 == 0, F.lit(0)).otherwise(F.coalesce("job_timeout_seconds", F.lit(300)))})
    routes = spark.createDataFrame([("urgent", "rust")], "queue string, runner string")
    checked = outcome.prechecked(claim.routed(jobs, routes, "python"), ["python", "rust"])
    applied = outcome.transitions(jobs, outcome.refused(checked), fx.now(), SETTINGS).select("id", "status")
    return checked.select("id", "problem").join(applied, "id", "left")


_RAN = """ran AS (SELECT *, CASE k%5 WHEN 0 THEN 'success' WHEN 1 THEN 'error' WHEN 2 THEN 'timeout' WHEN 3 THEN CASE WHEN current_retries+1 < 2 THEN 'retry' ELSE 'success' END ELSE 'fatal' END AS kind FROM jobs WHERE status='ACTIVE'),
e AS (SELECT *, kind IN ('retry','error') AND current_retries+1 < max_retries AS again FROM ran)"""


@query(over(f"""SELECT j.id, CASE WHEN e.kind IS NULL THEN j.status WHEN kind='success' THEN 'COMPLETED' WHEN again THEN 'RETRYING' ELSE 'FAILED' END AS status, CASE WHEN e.kind IS NULL OR kind='success' THEN j.current_retries ELSE j.current_retries+1 END AS current_retries,
  CASE kind WHEN 'retry' THEN 'not yet' WHEN 'error' THEN 'failed' WHEN 'timeout' THEN 'Job execution timed out' WHEN 'fatal' THEN 'No handler registered for function ''missing''' ELSE j.last_error END AS last_error FROM jobs j LEFT JOIN e ON e.id = j.id""", ALL, _RAN))
def out1_execute(spark: SparkSession, d: str) -> DataFrame:
    s, k = fx.state(spark, d), key() % 5
    name = F.when(k == 0, "echo").when(k == 1, "error").when(k == 2, "slow").when(k == 3, "retry").otherwise("missing")
    running = s.jobs.where("status = 'ACTIVE'").select(F.col("id").alias("request_id"), F.col("id").alias("job_id"), name.alias("handler"), F.col("job_params").alias("params"), (F.col("current_retries") + 1).alias("attempt"))
    return outcome.apply_outcomes(s, handlers.run_handlers(running, handlers.examples()), fx.now(), SETTINGS).jobs.select("id", "status", "current_retries", "last_error")


@query(over(f"SELECT 'active' AS kind, job_id FROM active WHERE job_id::BIGINT%4<>0 UNION ALL SELECT 'lock', l.job_id FROM locks l LEFT JOIN active a ON a.job_id = l.job_id AND a.worker_id = l.owner AND a.job_id::BIGINT%4=0 WHERE a.job_id IS NULL"))
def out10_cleanup(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    s = outcome.cleaned_up(s, s.active.where(key("job_id") % 4 == 0).select("job_id", "worker_id"))
    return s.active.select(F.lit("active").alias("kind"), "job_id").unionByName(s.job_locks.select(F.lit("lock").alias("kind"), "job_id"))


@query(over("SELECT seq, seq%3=0 AS accepted FROM requests", REQUESTS))
def out15_version(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    return outcome.right_version(fx.requests(spark, d).select("seq", F.when(seq % 3 == 0, "2").when(seq % 3 == 1, "1").alias("protocol_version"))).select("seq", "accepted")


@query(over("SELECT job_id || '-' || attempt AS request_id, CASE WHEN attempt%2=0 THEN 'answered' WHEN substr(worker_id, 2)::BIGINT%3=0 THEN 'failed' ELSE 'open' END AS state FROM attempts", ALL, ATTEMPTS))
def out16_no_id(spark: SparkSession, d: str) -> DataFrame:
    a = fx.attempts(spark, d).select(F.concat_ws("-", "job_id", text(F.col("attempt"))).alias("request_id"), "job_id", F.col("worker_id").alias("conn"), "attempt")
    broken = a.where(F.substring("conn", 2, 20).cast("long") % 3 == 0).select(F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("job_id"), "conn").distinct()
    return outcome.matched(a.drop("attempt"), a.where("attempt % 2 = 0").drop("attempt").unionByName(broken))


def _released(owners: str) -> str:
    mine = f"SELECT a.job_id FROM active a JOIN locks l ON l.job_id = a.job_id AND l.owner = a.worker_id AND l.expires_at > {NOW} WHERE {owners}"
    return over(f"SELECT id, CASE WHEN id IN ({mine}) THEN 'PENDING' ELSE status END AS status, CASE WHEN id NOT IN ({mine}) THEN worker_id END AS worker_id, id IN ({mine}) OR status IN ('PENDING','RETRYING') AS queued FROM jobs")


def _after_release(s) -> DataFrame:
    queued = s.queue.select(F.col("job_id").alias("id"), F.lit(True).alias("q"))
    return s.jobs.select("id", "status", "worker_id").join(queued, "id", "left").select("id", "status", "worker_id", F.coalesce("q", F.lit(False)).alias("queued"))


@query(_released("a.job_id::BIGINT%2=1"))
def rec4_release(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    owner = F.when(key("job_id") % 2 == 1, F.col("worker_id")).otherwise("someone")
    return _after_release(recover.release(s, s.active.select("job_id", owner.alias("owner")), fx.now()))


@query(_released("substr(a.worker_id, 2)::BIGINT%2=0"))
def rec7_drain(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    stopping = s.active.select("worker_id").distinct().where(F.substring("worker_id", 2, 20).cast("long") % 2 == 0)
    return _after_release(recover.drained(s, stopping, fx.now()))


@query(over(f"SELECT CASE WHEN count(DISTINCT worker_id)=0 THEN 'FAIL' ELSE 'OK' END AS verdict, count(DISTINCT worker_id) AS workers, false AS later FROM health WHERE expires_at > {NOW} UNION ALL SELECT 'FAIL', 0, true"))
def rec9_verdict(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    later = fn.plus_seconds(fx.now(), F.lit(86_400))
    return recover.health_verdict(s, fx.now()).withColumn("later", F.lit(False)).unionByName(recover.health_verdict(s, later).withColumn("later", F.lit(True)))


# cron: (schedule, seconds, minutes, hours, days, months, days of the week from 1 for Sunday), the lists spelt out for SQL

_EVERY = {"m": "range(0, 60)", "h": "range(0, 24)", "d": "range(1, 32)", "mo": "range(1, 13)", "w": "range(1, 8)"}
SCHEDULES = {
    "0 * * * * *": ("[0]", _EVERY["m"], _EVERY["h"], _EVERY["d"], _EVERY["mo"], _EVERY["w"]),
    "0 30 6 * * *": ("[0]", "[30]", "[6]", _EVERY["d"], _EVERY["mo"], _EVERY["w"]),
    "15,45 */7 1-3 * * *": ("[15, 45]", "range(0, 60, 7)", "[1, 2, 3]", _EVERY["d"], _EVERY["mo"], _EVERY["w"]),
    "0 0 0 1 1 *": ("[0]", "[0]", "[0]", "[1]", "[1]", _EVERY["w"]),
    "30 0 12 * * 2": ("[30]", "[0]", "[12]", _EVERY["d"], _EVERY["mo"], "[2]"),
    "0 0 0 29 2 *": ("[0]", "[0]", "[0]", "[29]", "[2]", _EVERY["w"]),
}


def _instants(first: str, last: str) -> str:
    rows = ", ".join(f"({i}, '{s}', {', '.join(f'{x}::BIGINT[]' for x in lists)})" for i, (s, lists) in enumerate(SCHEDULES.items()))
    return f"""s(i, schedule, secs, mins, hrs, doms, mons, dows) AS (VALUES {rows}), days AS (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS day),
matching AS (SELECT i, schedule, day, secs, mins, hrs FROM s JOIN days ON list_contains(doms, day(day)) AND list_contains(mons, month(day)) AND list_contains(dows, dayofweek(day)+1)),
hours AS (SELECT *, unnest(hrs) AS h FROM matching), minutes AS (SELECT *, unnest(mins) AS m FROM hours), instants AS (SELECT i, schedule, day + to_hours(h) + to_minutes(m) + to_seconds(unnest(secs)) AS t FROM minutes)"""


_CRON_ROWS = "SELECT id, k%6 AS i, enqueue_time + to_seconds(k*7919%86400) AS now FROM jobs"


@query(over(f"""SELECT id, '0 * * * * *' AS schedule, date_trunc('minute', now) + INTERVAL 1 MINUTE AS next_run FROM ({_CRON_ROWS}) WHERE i = 0
  UNION ALL SELECT c.id, s.schedule, x.t FROM (SELECT * FROM ({_CRON_ROWS}) WHERE i > 0) c JOIN s ON s.i = c.i ASOF JOIN instants x ON x.i = c.i AND x.t > date_trunc('minute', c.now)""", ALL, _instants("1994-12-30", "2009-12-31").replace("FROM s JOIN days", "FROM (SELECT * FROM s WHERE i > 0) s JOIN days")))
def crn1_next(spark: SparkSession, d: str) -> DataFrame:
    names = list(SCHEDULES)
    rows = fx.jobs(spark, d).select("id", F.element_at(F.array(*map(F.lit, names)), (key() % 6 + 1).cast("int")).alias("schedule"), fn.plus_seconds(F.col("enqueue_time"), key() * 7919 % 86_400).alias("now"))
    return cron.next_runs(rows, names, F.col("now")).select("id", "schedule", "next_run")


@query(over(f"SELECT id, next_scheduled_run_time IS NOT NULL AND next_scheduled_run_time + to_seconds(k*1000000) <= {NOW} AS due FROM jobs"))
def crn2_due(spark: SparkSession, d: str) -> DataFrame:
    # in milliseconds: with many jobs the runs lie beyond the last timestamp
    rows = fx.jobs(spark, d).select("id", (fn.epoch_ms(F.col("next_scheduled_run_time")) + key() * 1_000_000_000).alias("next_run"))
    return cron.due(rows, fn.epoch_ms(fx.now())).select("id", "due")


@query(f"""WITH RECURSIVE {_instants('2024-01-01', '2025-01-02')}, ticks AS (SELECT n, TIMESTAMP '2024-01-02 00:30:10' + to_seconds(n*30) AS tick FROM range(0, 400) t(n)),
nexts AS (SELECT s.i, n, tick, x.t AS due FROM s CROSS JOIN ticks ASOF LEFT JOIN instants x ON x.i = s.i AND x.t > date_trunc('minute', tick)),
fold AS (SELECT i, n, tick, due <= tick AS fired, due FROM nexts WHERE n = 0
  UNION ALL SELECT x.i, x.n, x.tick, coalesce(f.due, x.due) <= x.tick, CASE WHEN coalesce(f.due, x.due) <= x.tick THEN x.due ELSE coalesce(f.due, x.due) END FROM fold f JOIN nexts x ON x.i = f.i AND x.n = f.n + 1)
SELECT 'f' || s_suppkey AS function_name, tick AS fired_at FROM supplier JOIN fold ON i = s_suppkey%6 WHERE fired""")
def crn3_fires(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    crons = fx.read(spark, d, "supplier").select(F.concat(F.lit("f"), text(k)).alias("function_name"), F.element_at(F.array(*map(F.lit, SCHEDULES)), (k % 6 + 1).cast("int")).alias("schedule"))
    return cron.tick_fires(crons, dt.datetime(2024, 1, 2, 0, 30, 10), 400)


@query(f"""WITH c AS (SELECT 'f' || s_suppkey AS function_name, s_suppkey%2=0 AS uniq, s_suppkey AS k FROM supplier), held AS (SELECT 'cron:f' || s_suppkey AS key, {NOW} + to_seconds(CASE WHEN s_suppkey%5=0 THEN -5 ELSE 5 END) AS expires_at FROM supplier WHERE s_suppkey%3=0)
SELECT function_name, uniq AS "unique" FROM c WHERE NOT uniq OR NOT EXISTS (SELECT 1 FROM held h WHERE h.key = 'cron:' || c.function_name AND h.expires_at > {NOW})""")
def crn4_unique(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    workers = fx.read(spark, d, "supplier")
    due = workers.select(F.concat(F.lit("f"), text(k)).alias("function_name"), (k % 2 == 0).alias("unique"))
    held = workers.where(k % 3 == 0).select(F.concat(F.lit("cron:f"), text(k)).alias("key"), F.lit("1").alias("job_id"), fn.plus_seconds(fx.now(), F.when(k % 5 == 0, F.lit(-5)).otherwise(F.lit(5))).alias("expires_at"))
    return cron.due_unlocked(due, fx.state(spark, d).with_(unique_locks=held), fx.now())


# administration


@query(over("SELECT queue_name, count(score_ms) AS entries, min(score_ms) AS oldest, max(score_ms) AS newest FROM (SELECT queue_name, score_ms FROM queue UNION ALL SELECT unnest(['queue:idle','queue:urgent']), NULL) GROUP BY GROUPING SETS ((queue_name), ())"))
def adm1_show_empty(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("idle",), ("queue:urgent",)], "queue_name string")
    return admin.queue_list(fx.state(spark, d), known)


@query(over("SELECT id, true AS found, status, last_error FROM jobs WHERE status='FAILED' UNION ALL SELECT 'x' || id, false, NULL, NULL FROM jobs WHERE status='FAILED'"))
def adm16_dlq_inspect(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    ids = s.dlq.select(F.col("job_id").alias("id"))
    told = admin.dlq_inspect(s, ids.unionByName(ids.select(F.concat(F.lit("x"), "id").alias("id"))))
    return told.select("id", "found", F.get_json_object("fields", "$.status").alias("status"), F.get_json_object("fields", "$.last_error").alias("last_error"))


@query(over("SELECT job_id, queue_name, function_name FROM dlq JOIN jobs ON id = job_id WHERE dlq.dlq_name='dlq:default' AND function_name='fn_3' ORDER BY pushed_seq DESC, job_id LIMIT 50"))
def adm17_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return admin.dlq_chosen(fx.state(spark, d), "dlq:default", function="fn_3", limit=50)


@query(over("SELECT (SELECT count(*) FROM queue)=0 AND count(*) FILTER (status IN ('PENDING','ACTIVE','RETRYING'))=0 AS drained FROM jobs"))
def adm19_drained(spark: SparkSession, d: str) -> DataFrame:
    return admin.drained(fx.state(spark, d))


# functions


@query(over("SELECT id, 'rate_limit:' || function_name AS rate_key, 'debounce:' || function_name AS debounce_key, 'idempotency:' || CASE WHEN k%2=0 THEN 'idempotency:' ELSE '' END || function_name AS idempotency_key FROM jobs"))
def fn2_keys(spark: SparkSession, d: str) -> DataFrame:
    even = key() % 2 == 0
    of = lambda p: F.when(even, F.concat(F.lit(p), "function_name")).otherwise(F.col("function_name"))
    return fx.jobs(spark, d).select("id", fn.rate_limit_key(of("rate_limit:")).alias("rate_key"), fn.debounce_key(of("debounce:")).alias("debounce_key"), fn.idempotency_key(of("idempotency:")).alias("idempotency_key"))


@query(over("SELECT id, CASE WHEN 2*(k%300)+strlen(id) <= 256 THEN repeat('é', k%300) || id WHEN k%300 >= 128 THEN repeat('é', 128) ELSE repeat('é', k%300) || left(id, 256-2*(k%300)) END AS cut FROM jobs"))
def fn5_truncate(spark: SparkSession, d: str) -> DataFrame:
    return fx.jobs(spark, d).select("id", fn.truncate_utf8(F.concat(F.expr("repeat('é', cast(cast(id as long) % 300 as int))"), "id")).alias("cut"))


@query(over("""SELECT id, CASE WHEN k%7=0 THEN '{"traceparent":"' || k || '","x":"y"}' ELSE '{"traceparent":"span","x":"y"}' END AS kept, '{"traceparent":"span","x":"y"}' AS overwritten FROM jobs"""))
def fn7_merge_trace(spark: SparkSession, d: str) -> DataFrame:
    span = F.create_map(F.lit("traceparent"), F.lit("span"), F.lit("x"), F.lit("y"))
    return fx.jobs(spark, d).select("id", F.to_json(fn.merge_trace(F.col("trace_context"), span, False)).alias("kept"), F.to_json(fn.merge_trace(F.col("trace_context"), span, True)).alias("overwritten"))


@query(over("SELECT id, CASE k%4 WHEN 0 THEN k + 0.5 WHEN 1 THEN epoch_ms(enqueue_time)/1000.0 + 0.123 END::DOUBLE AS seconds FROM jobs"))
def fn8_parse_time(spark: SparkSession, d: str) -> DataFrame:
    k, t = key() % 4, F.col("enqueue_time")
    given = F.when(k == 0, F.concat("id", F.lit(".5"))).when(k == 1, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123789Z"))).when(k == 2, F.date_format(t, "yyyy-MM-dd")).otherwise("soon")
    return fx.jobs(spark, d).select("id", fn.parse_time(given).alias("seconds"))


@query(over("SELECT id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s//60 || 'm ago' WHEN s < 86400 THEN s//3600 || 'h ago' ELSE 'long ago' END AS ago FROM (SELECT id, k*7 AS s FROM jobs)"))
def fn9_ago(spark: SparkSession, d: str) -> DataFrame:
    return fx.jobs(spark, d).select("id", fn.ago((key() * 7).cast("double"), F.lit("long ago")).alias("ago"))


@query(over("""SELECT id, CASE k%5 WHEN 0 THEN (k%900+1) || 'μs' WHEN 1 THEN (k%900+1) || 'ms' WHEN 2 THEN (k%59+1) || '.5s' WHEN 3 THEN (k%3540+60)//60 || 'm ' || (k%3540+60)%60 || 's' ELSE (k%90000+3600)//3600 || 'h ' || (k%90000+3600)%3600//60 || 'm' END AS duration FROM jobs"""))
def fn10_duration(spark: SparkSession, d: str) -> DataFrame:
    k = key()
    s = F.when(k % 5 == 0, (k % 900 + 1) / 1e6).when(k % 5 == 1, (k % 900 + 1) / 1e3).when(k % 5 == 2, k % 59 + 1.5).when(k % 5 == 3, (k % 3540 + 60).cast("double")).otherwise((k % 90_000 + 3600).cast("double"))
    return fx.jobs(spark, d).select("id", fn.duration_text(s).alias("duration"))


@query(over("SELECT id, CASE WHEN strlen(job_params) <= 44 THEN job_params ELSE left(job_params, 41) || '...' END AS short FROM jobs"))
def fn11_shortened(spark: SparkSession, d: str) -> DataFrame:
    return fx.jobs(spark, d).select("id", fn.shortened(F.col("job_params"), 44).alias("short"))


@query(over("""SELECT id, CASE WHEN k%3=0 THEN job_params END AS parsed, CASE WHEN k%3=2 THEN 'UNKNOWN' ELSE status END AS status, strftime(make_timestamp(k*1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN k%2=1 THEN '.250' ELSE '' END || '+00:00' AS at FROM jobs"""))
def fn12_formats(spark: SparkSession, d: str) -> DataFrame:
    k = key()
    raw = F.when(k % 3 == 0, F.col("job_params")).when(k % 3 == 1, "NULL").otherwise("{bad")
    return fx.jobs(spark, d).select("id", fn.json_value(raw).alias("parsed"), fn.status_text(F.when(k % 3 != 2, F.lower("status"))).alias("status"), fn.rfc3339(k + F.when(k % 2 == 1, 0.25).otherwise(0.0)).alias("at"))


@query(over("SELECT id, CASE WHEN k%3<>0 THEN status END AS known, CASE WHEN k%3<>0 THEN status ELSE 'UNKNOWN' END AS shown FROM jobs"))
def fn13_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(key() % 3 == 0, "LOST").otherwise(F.col("status"))
    return fx.jobs(spark, d).select("id", fn.known_status(s).alias("known"), fn.known_status(s, "UNKNOWN").alias("shown"))


@query(over("SELECT id, CASE WHEN k%5=0 OR k%7=0 OR k%11=0 THEN NULL ELSE (k+60)*1000 END AS lock_ms FROM jobs"))
def fn15_lock_ms(spark: SparkSession, d: str) -> DataFrame:
    k = key()
    timeout = F.when(k % 5 == 0, F.lit(0).cast("long")).when(k % 7 == 0, F.lit((1 << 63) - 1)).otherwise(k)
    return fx.jobs(spark, d).select("id", fn.provisional_lock_ms(timeout, F.when(k % 11 == 0, -1).otherwise(60)).alias("lock_ms"))


@query("SELECT s_suppkey AS n, least(100.0*pow(2, least(s_suppkey-1, 10)), 2000.0)::DOUBLE AS delay_ms FROM supplier")
def fn16_spawn_delay(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), fn.spawn_delay_ms(F.col("s_suppkey")).alias("delay_ms"))


@query(over("SELECT id, 'redis://h' || k || ':6379/0' AS dsn FROM jobs"))
def fn17_dsn(spark: SparkSession, d: str) -> DataFrame:
    user = F.when(key() % 3 == 0, F.concat(F.lit("u:p"), "id", F.lit("@"))).when(key() % 3 == 1, F.lit("u@")).otherwise("")
    return fx.jobs(spark, d).select("id", fn.dsn_summary(F.concat(F.lit("redis://"), user, F.lit("h"), "id", F.lit(":6379/0"))).alias("dsn"))


# metrics


@query(f"WITH RECURSIVE {ALL}, {_CONTRACT} SELECT CASE WHEN seq%2=0 THEN 'queue:low' ELSE 'queue:default' END AS queue_name, status, count(*) AS total FROM answers GROUP BY 1, 2")
def met1_enqueued(spark: SparkSession, d: str) -> DataFrame:
    told = _produced(spark, d)[1]
    return metrics.enqueued(told.select(F.when(F.col("seq") % 2 == 0, "queue:low").otherwise("queue:default").alias("queue_name"), "status"))


@query(over(f"""SELECT queue_name, CASE WHEN job_id::BIGINT%13=0 THEN 'missing' WHEN job_id IN (SELECT job_id FROM locks WHERE expires_at > {NOW}) THEN 'locked' ELSE 'claimed' END AS reason, count(*) AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id) AS rn FROM queue WHERE score_ms <= {NOW_MS}) WHERE rn <= 200 GROUP BY 1, 2"""))
def met2_claim_attempts(spark: SparkSession, d: str) -> DataFrame:
    s = fx.state(spark, d)
    head = claim.ready(s, fx.now(), 200)
    locked = lookups.lock_owners(s, head.select("job_id"), fx.now()).select("job_id", F.col("owner").isNotNull().alias("locked"))
    return metrics.claim_attempts(head.join(locked, "job_id").withColumn("missing", key("job_id") % 13 == 0))


@query(over(f"""SELECT queue_name, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id) AS rn FROM queue WHERE score_ms <= {NOW_MS})
  WHERE rn <= 400 AND job_id NOT IN (SELECT job_id FROM locks WHERE expires_at > {NOW})) WHERE nth <= 100 GROUP BY 1"""))
def met4_fetched(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fetched(claim.claimable(fx.state(spark, d), fx.now(), 100))


@query(over(f"""SELECT least(100, count(*))::BIGINT AS total FROM active WHERE worker_id NOT IN (SELECT worker_id FROM health WHERE expires_at > {NOW}) AND job_id NOT IN (SELECT job_id FROM locks WHERE expires_at > {NOW}) AND job_id NOT IN (SELECT job_id FROM queue)"""))
def met7_recovered(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recovered(recover.orphans(fx.state(spark, d), fx.now()))


@query(over("SELECT floor(least((o_custkey%10)/8.0, 1.0)*10)/10 AS at_least, count(*) AS observations FROM jobs GROUP BY 1"))
def met8_pressure(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pressure(fx.jobs(spark, d).select(F.col("worker_id").alias("conn"), F.substring("function_name", 4, 5).cast("long").alias("in_flight")), 8)


@query(over(f"SELECT CASE WHEN queue_name='queue:urgent' THEN 'rust' ELSE 'python' END AS runner, count(*) AS total FROM jobs WHERE status='ACTIVE' AND start_time + to_seconds(job_timeout_seconds) <= {NOW} GROUP BY 1"))
def met9_expired(spark: SparkSession, d: str) -> DataFrame:
    routes = spark.createDataFrame([("urgent", "rust")], "queue string, runner string")
    rows = claim.routed(fx.jobs(spark, d).where("status = 'ACTIVE'"), routes, "python")
    return metrics.expiries(outcome.past_deadline(rows, fx.now()))


@query(over("SELECT CASE WHEN queue_name='queue:urgent' THEN 'rust' ELSE 'python' END AS runner, CASE WHEN k%3=0 THEN 'job' ELSE 'request' END AS scope, count(*) AS total FROM jobs GROUP BY 1, 2"))
def met9_cancelled(spark: SparkSession, d: str) -> DataFrame:
    routes = spark.createDataFrame([("urgent", "rust")], "queue string, runner string")
    return metrics.cancellations(claim.routed(fx.jobs(spark, d), routes, "python").withColumn("request_id", F.when(key() % 3 != 0, F.col("id"))))


_RUNNER = "CASE WHEN queue_name='queue:urgent' THEN 'rust' WHEN queue_name='queue:low' THEN 'node' ELSE 'python' END"


def _by_runner(spark: SparkSession, d: str) -> DataFrame:
    return claim.routed(fx.attempts(spark, d), spark.createDataFrame([("urgent", "rust"), ("queue:low", "node")], "queue string, runner string"), "python")


@query(over(f"SELECT queue_name, runner, outcome, count(*) AS attempts, sum(duration_ms) AS duration_ms, grouping(queue_name, runner, outcome)::BIGINT AS level FROM (SELECT *, {_RUNNER} AS runner FROM attempts) GROUP BY ROLLUP (queue_name, runner, outcome)", ALL, ATTEMPTS))
def met6_runner(spark: SparkSession, d: str) -> DataFrame:
    return metrics.processed(_by_runner(spark, d))


@query(over(f"SELECT {_RUNNER} AS runner, function_name, outcome, count(*) AS jobs, avg(duration_ms) AS mean_ms, max(duration_ms) AS max_ms FROM attempts GROUP BY 1, 2, 3", ALL, ATTEMPTS))
def met10_by_runner(spark: SparkSession, d: str) -> DataFrame:
    return metrics.runner_totals(_by_runner(spark, d))


@query(over("SELECT job_id, attempt, CASE WHEN outcome='retry' AND attempt%2=0 THEN attempt*1500.0 END::DOUBLE AS retry_delay_ms FROM attempts", ALL, ATTEMPTS))
def met12_retry_delay(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("attempt")
    a = fx.attempts(spark, d).withColumn("retry_after_seconds", F.when(n % 2 == 0, n * 1.5))
    return metrics.spans(a, fx.jobs(spark, d)).select("job_id", "attempt", "retry_delay_ms")
