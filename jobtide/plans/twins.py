"""DuckDB SQL of the test tables as job tables, and of the queries over them."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-02 00:00:00'"
NOW_MS = f"epoch_ms({NOW})"

JOBS = """
j0 AS (SELECT *, CASE WHEN o_orderstatus='F' THEN CASE WHEN o_orderkey%3=0 THEN 'FAILED' ELSE 'COMPLETED' END WHEN o_orderstatus='P' THEN CASE WHEN o_orderkey%2=0 THEN 'ACTIVE' ELSE 'RETRYING' END
  ELSE CASE WHEN o_orderkey%10=0 THEN 'CANCELLED' ELSE 'PENDING' END END AS status FROM orders),
jobs AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey AS k, 'fn_' || (o_custkey%10) AS function_name,
  '{"k":' || o_custkey || ',"session":{"id":"s' || (o_custkey%40) || '"},"flag":' || CASE WHEN o_orderkey%2=0 THEN 'true' ELSE 'false' END || '}' AS job_params,
  o_orderdate::TIMESTAMP AS enqueue_time, CASE WHEN status IN ('FAILED','COMPLETED','ACTIVE','RETRYING') THEN o_orderdate::TIMESTAMP + to_seconds(o_orderkey%50+1) END AS start_time, status,
  o_orderkey%4 AS current_retries, CASE WHEN status='RETRYING' THEN o_orderdate::TIMESTAMP + to_seconds(o_orderkey%50+11) END AS next_scheduled_run_time, 5::BIGINT AS max_retries,
  CASE WHEN o_orderkey%6<>0 THEN 30*(1+o_orderkey%10) END AS job_timeout_seconds, CASE WHEN o_orderkey%11<>0 THEN 86400*(o_orderkey%3) END AS result_ttl_seconds, CASE WHEN o_orderkey%7=0 THEN o_orderkey::VARCHAR END AS traceparent,
  CASE WHEN o_orderkey%8=0 THEN 'u' || (o_custkey%50) END AS job_unique_key,
  CASE WHEN status IN ('FAILED','COMPLETED') THEN o_orderdate::TIMESTAMP + to_seconds(o_orderkey%50+2+o_custkey%100) END AS completion_time, CASE WHEN status='COMPLETED' THEN '{"ok":true}' END AS result,
  CASE WHEN status IN ('FAILED','RETRYING') THEN (['Connection timeout','Invalid input','Rate limit exceeded','Resource not found','Internal error'])[(o_orderkey%5+1)::INT] END AS last_error,
  'queue:' || replace(lower(substr(o_orderpriority,3)),' ','_') AS queue_name, CASE WHEN o_orderkey%9=0 THEN 'dlq:bulk' END AS dlq_name,
  CASE WHEN status IN ('FAILED','COMPLETED','ACTIVE','RETRYING') THEN 'w' || (o_custkey%100+1) END AS worker_id, o_custkey FROM j0)"""
QUEUE = "queue AS (SELECT queue_name, id AS job_id, epoch_ms(coalesce(next_scheduled_run_time, enqueue_time))::DOUBLE AS score_ms FROM jobs WHERE status IN ('PENDING','RETRYING'))"
ACTIVE = "active AS (SELECT worker_id, id AS job_id, epoch_ms(start_time)/1000.0::DOUBLE AS start_s FROM jobs WHERE status='ACTIVE')"
LOCKS = f"locks AS (SELECT id AS job_id, coalesce(worker_id,'w0') AS owner, {NOW} + to_seconds(CASE WHEN k%10=1 THEN 30 ELSE -30 END) AS expires_at FROM jobs WHERE status IN ('ACTIVE','PENDING') AND k%5=1)"
DLQ = "dlq AS (SELECT coalesce(dlq_name,'dlq:default') AS dlq_name, id AS job_id, epoch_ms(completion_time)*1000000 + k%1000000 AS pushed_seq FROM jobs WHERE status='FAILED')"
UNIQUE = f"ulocks AS (SELECT job_unique_key AS key, min(id) AS job_id, {NOW} + to_seconds(length(job_unique_key)*100-200) AS expires_at FROM jobs WHERE job_unique_key IS NOT NULL AND status IN ('ACTIVE','PENDING') GROUP BY 1)"
HEALTH = f"""beats AS (SELECT 'w' || s_suppkey AS worker_id, {NOW} + to_seconds(CASE WHEN s_suppkey%4<>0 THEN -(s_suppkey%60) ELSE -3600 END) AS timestamp, CASE WHEN s_suppkey%5=0 THEN 'idle' ELSE 'running' END AS status,
  s_suppkey%7 AS active_jobs, 8::BIGINT AS concurrency_limit, 'queue:' || CASE WHEN s_suppkey%2=0 THEN 'high' ELSE 'low' END AS queues FROM supplier), health AS (SELECT *, timestamp + INTERVAL 70 SECOND AS expires_at FROM beats)"""
ATTEMPTS = """
a0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt FROM lineitem),
attempts AS (SELECT l_orderkey::VARCHAR AS job_id, attempt, 'w' || l_suppkey AS worker_id, jobs.enqueue_time + to_seconds(attempt*3600) AS start_time, l_quantity*1000::DOUBLE AS duration_ms,
  CASE WHEN l_returnflag='A' THEN 'success' WHEN l_returnflag='R' THEN 'retry' WHEN l_linestatus='F' THEN 'error' ELSE 'timeout' END AS outcome, jobs.queue_name, jobs.function_name FROM a0 JOIN jobs ON k=l_orderkey)"""
REQUESTS = "requests AS (SELECT event_id AS seq, user_id::VARCHAR AS key, event_type AS function_name, ts::TIMESTAMP AS ts, props AS params, value FROM events)"
ALL = ",".join([JOBS, QUEUE, ACTIVE, LOCKS, DLQ, UNIQUE, HEALTH])


def over(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{','.join(ctes or (ALL,))} {body}"


def leading(ttl_ms: str, extra: str = "") -> str:
    """CTEs that jump along each key's admitted requests; ``ttl_ms`` may use the columns of ``r``."""
    return f"""{REQUESTS}, r AS (SELECT *, epoch_us(ts)//1000 AS ms, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n {extra} FROM requests),
taken AS (SELECT key, n, seq, ms, ms + {ttl_ms} AS until FROM r WHERE n = 1
  UNION ALL SELECT x.key, x.n, x.seq, x.ms, x.ms + x.ttl FROM (SELECT r.key, r.n, r.seq, r.ms, {ttl_ms} AS ttl, row_number() OVER (PARTITION BY r.key ORDER BY r.n) AS first FROM taken JOIN r ON r.key = taken.key AND r.ms >= taken.until AND r.n > taken.n) x WHERE x.first = 1)"""


_BACK = "least(5.0 * pow(2, least(greatest(j.current_retries+1,1)-1,30)), 3600.0)"
_OUT = """outs AS (SELECT job_id, max_by(outcome, attempt) AS status, job_id::BIGINT AS ok FROM attempts GROUP BY 1),
t AS (SELECT *, kind IN ('retry','error') AND current_retries+1 < max_retries AS again FROM (SELECT j.*, CASE WHEN o.status IN ('success','retry','timeout') THEN o.status WHEN j.k%4=0 THEN 'fatal' ELSE 'error' END AS kind,
  CASE WHEN j.k%5=0 THEN 'given' END AS given, CASE WHEN j.k%6=0 THEN j.k%100-10.5 END AS after FROM jobs j JOIN outs o ON o.job_id=j.id))"""
_DUE = f"{NOW_MS} + floor(CASE WHEN kind='retry' AND after IS NOT NULL THEN after ELSE {_BACK.replace('j.', '')} END*1000)"
_QLIST = "SELECT queue_name, count(*) AS entries, min(score_ms) AS oldest, max(score_ms) AS newest FROM queue GROUP BY 1"
_AVG = f"SELECT queue_name, avg(({NOW_MS}-score_ms)/1000.0) AS avg_wait FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id) AS rn FROM queue) WHERE rn<=100 GROUP BY 1"
_CLAIM = f"""ready AS (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id) AS rn FROM queue WHERE score_ms <= {NOW_MS}),
free AS (SELECT r.* FROM ready r WHERE rn <= 4*{{n}} AND job_id NOT IN (SELECT job_id FROM locks WHERE expires_at > {NOW}))"""
_DUR = f"CASE WHEN completion_time IS NOT NULL THEN (epoch_ms(completion_time)-epoch_ms(start_time))/1000.0 WHEN status='ACTIVE' THEN ({NOW_MS}-epoch_ms(start_time))/1000.0 END::DOUBLE"
_DROWS = "drows AS (SELECT dlq.*, j.queue_name, j.function_name, j.last_error, j.current_retries, j.completion_time FROM dlq JOIN jobs j ON j.id = dlq.job_id)"
_TOP = "SELECT '{k}' AS kind, name, n FROM (SELECT {c} AS name, count(*) AS n FROM drows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {l})"
_LOST = f"""lost AS (SELECT a.*, j.status, j.queue_name, j.next_scheduled_run_time FROM active a LEFT JOIN jobs j ON j.id=a.job_id WHERE a.worker_id NOT IN (SELECT worker_id FROM health WHERE expires_at > {NOW})
  AND a.job_id NOT IN (SELECT job_id FROM locks WHERE expires_at > {NOW}))"""

SQL = {
    "adm1_queue_list": over(f"{_QLIST} UNION ALL SELECT NULL, count(*), min(score_ms), max(score_ms) FROM queue"),
    "adm2_queue_stats": over(f"""SELECT queue_name, pending, active, completed, failed, coalesce(dlq_count,0) AS dlq_count, avg_wait, pending+active+completed+failed AS total FROM
      (SELECT queue_name, count(*) FILTER (status IN ('PENDING','RETRYING')) AS pending, count(*) FILTER (status='ACTIVE') AS active, count(*) FILTER (status='COMPLETED') AS completed, count(*) FILTER (status='FAILED') AS failed FROM jobs GROUP BY 1)
      LEFT JOIN (SELECT queue_name, count(*) AS dlq_count FROM dlq JOIN jobs ON id=job_id GROUP BY 1) USING (queue_name) LEFT JOIN ({_AVG}) USING (queue_name) WHERE pending+active+completed+failed > 0"""),
    "adm3_avg_wait": over(_AVG),
    "adm5_dlq_by_queue": over("SELECT queue_name, count(*) AS dlq_count FROM dlq JOIN jobs ON id=job_id GROUP BY 1"),
    "adm6_queue_inspect": over("SELECT rn AS rank, job_id, score_ms, coalesce(function_name,'<missing>') AS function_name, coalesce(status,'<missing>') AS status FROM (SELECT *, row_number() OVER (ORDER BY score_ms, job_id) AS rn FROM queue WHERE queue_name='queue:high') q LEFT JOIN jobs ON id=job_id WHERE rn BETWEEN 6 AND 25"),
    "adm8_job_list": over(f"SELECT id, function_name, queue_name, status, enqueue_time, {_DUR} AS duration_s FROM jobs WHERE status='FAILED' AND queue_name='queue:urgent' ORDER BY enqueue_time DESC, id LIMIT 20"),
    "adm9_durations": over(f"SELECT id, {_DUR} AS duration_s FROM jobs"),
    "adm10_replay": over(f"SELECT 'replay-' || id AS id, function_name, job_params, 'queue:again' AS queue_name, {NOW} AS enqueue_time, 'PENDING' AS status, 0::BIGINT AS current_retries FROM jobs WHERE status='FAILED'"),
    "adm11_cancel": over("SELECT id, CASE WHEN status='PENDING' AND k%3=0 THEN 'CANCELLED' ELSE status END AS status, id IN (SELECT job_id FROM queue) AND NOT (status='PENDING' AND k%3=0) AS queued FROM jobs"),
    "adm12_job_trace": over("""SELECT id, event, ts, ((epoch_ms(ts)-epoch_ms(lag(ts) OVER w))/1000.0)::DOUBLE AS gap_s, ((epoch_ms(ts)-epoch_ms(min(ts) OVER (PARTITION BY id)))/1000.0)::DOUBLE AS since_first_s FROM (
      SELECT id, 'Enqueued' AS event, enqueue_time AS ts FROM jobs UNION ALL SELECT id, 'Started', start_time FROM jobs UNION ALL SELECT id, 'Finished', completion_time FROM jobs
      UNION ALL SELECT job_id, 'Retry ' || (attempt-1), start_time FROM attempts WHERE attempt>1) WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY ts, event)""", ALL, ATTEMPTS),
    "adm13_dlq_list": over("SELECT job_id, function_name, queue_name, last_error, current_retries, completion_time, (SELECT count(*) FROM dlq WHERE dlq_name='dlq:default') AS dlq_total FROM drows WHERE dlq_name='dlq:default' AND function_name='fn_3' ORDER BY completion_time DESC, job_id LIMIT 20 OFFSET 5", ALL, _DROWS),
    "adm14_dlq_stats": over("SELECT dlq_name, count(*) AS jobs, min(completion_time) AS oldest, max(completion_time) AS newest, avg(current_retries) AS avg_retries FROM drows GROUP BY 1", ALL, _DROWS),
    "adm14_dlq_top": over(" UNION ALL ".join(_TOP.format(k=k, c=c, l=n) for k, c, n in (("queue", "queue_name", 10), ("function", "function_name", 10), ("error", "last_error", 5))), ALL, _DROWS),
    "adm17_dlq_requeue": over(f"""SELECT j.id, CASE WHEN c.job_id IS NOT NULL THEN 'PENDING' ELSE j.status END AS status, CASE WHEN c.job_id IS NOT NULL THEN 'queue:redo' ELSE j.queue_name END AS queue_name, CASE WHEN c.job_id IS NOT NULL THEN {NOW_MS}::DOUBLE ELSE q.score_ms END AS score_ms
      FROM jobs j LEFT JOIN (SELECT job_id FROM drows WHERE dlq_name='dlq:default' AND queue_name='queue:low' ORDER BY pushed_seq DESC, job_id LIMIT 50) c ON c.job_id=j.id LEFT JOIN queue q ON q.job_id=j.id""", ALL, _DROWS),
    "adm19_status_histogram": over("SELECT status, count(*) AS jobs FROM jobs GROUP BY 1"),
    "src7_lookup": over("SELECT k*2 AS at, id, true AS found, status, function_name FROM jobs UNION ALL SELECT k*2+1, 'x' || id, false, NULL, NULL FROM jobs"),
    "src11_ready": over(f"SELECT queue_name, job_id, score_ms, rn FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id)::BIGINT AS rn FROM queue WHERE score_ms <= {NOW_MS}) WHERE rn<=50"),
    "src12_rank_page": over("SELECT queue_name, rank, job_id, score_ms FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id)-1 AS rank, count(*) OVER (PARTITION BY queue_name) AS n FROM queue) WHERE rank BETWEEN n-30 AND n-5"),
    "src15_sizes": over("SELECT queue_name AS name, count(*) AS n FROM queue GROUP BY 1 UNION ALL SELECT dlq_name, count(*) FROM dlq GROUP BY 1"),
    "src16_lock_ttl": over(f"SELECT key, job_id, greatest(0, epoch_ms(expires_at)-{NOW_MS}) AS ttl_ms FROM ulocks"),
    "src17_status": over("SELECT id, CASE WHEN status='CANCELLED' THEN 'UNKNOWN' ELSE status END AS status, result, last_error FROM jobs"),
    "src18_wait": over("SELECT id, status IN ('COMPLETED','FAILED','CANCELLED') AND (completion_time IS NULL OR (epoch_ms(completion_time)-epoch_ms(enqueue_time))/1000.0 <= 60) AS done, CASE WHEN status IN ('COMPLETED','FAILED','CANCELLED') AND (completion_time IS NULL OR (epoch_ms(completion_time)-epoch_ms(enqueue_time))/1000.0 <= 60) THEN status END AS status FROM jobs"),
    "enq2_idempotent": f"WITH RECURSIVE {leading('21600000')} SELECT r.seq, max_by(t.seq, t.n) AS job_seq, max(t.n)=r.n AS created FROM r JOIN taken t ON t.key=r.key AND t.n<=r.n GROUP BY r.seq, r.n",
    "enq4_duplicate_ids": over("SELECT seq, row_number() OVER (PARTITION BY key ORDER BY seq)=1 AND key NOT IN (SELECT id FROM jobs) AS created FROM requests", ALL, REQUESTS),
    "enq5_rate_limit": f"WITH RECURSIVE {leading('86400000')} SELECT r.seq, t.seq IS NOT NULL AS admitted, CASE WHEN t.seq IS NOT NULL THEN 'enqueued' ELSE 'rate_limited' END AS status FROM r LEFT JOIN taken t ON t.seq=r.seq",
    "enq6_debounce": over("""SELECT key, min_by(seq, (ts,seq)) AS job_seq, min(ts) AS enqueue_time, max_by(seq, (ts,seq)) AS last_seq, max_by(function_name, (ts,seq)) AS function_name, max_by(params, (ts,seq)) AS params, count(*) AS requests,
      make_timestamp((epoch_us(max(ts))//1000 + 21600000)*1000) AS scheduled FROM (SELECT *, sum(new) OVER w AS run FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts)//1000 >= epoch_us(lag(ts) OVER w)//1000 + 21600000 THEN 1 ELSE 0 END AS new FROM requests WINDOW w AS (PARTITION BY key ORDER BY ts, seq)) WINDOW w AS (PARTITION BY key ORDER BY ts, seq)) GROUP BY key, run""", REQUESTS),
    "enq9_unique_deferral": f"WITH RECURSIVE {leading('21600000')} SELECT r.seq, max(t.n)=r.n AS takes_lock, make_timestamp(CASE WHEN max(t.n)=r.n THEN r.ms + r.seq%3*3600000 ELSE greatest(r.ms + r.seq%3*3600000, max_by(t.until, t.n)) END * 1000) AS scheduled FROM r JOIN taken t ON t.key=r.key AND t.n<=r.n GROUP BY r.seq, r.n, r.ms",
    "enq10_lock_ttl": over("SELECT id, greatest(21600, coalesce(job_timeout_seconds*100,300)+61, k*7+1)::BIGINT AS ttl FROM jobs"),
    "enq12_mode": over("SELECT seq, CASE WHEN seq%25 IN (0,5,20) THEN 'enqueue' WHEN seq%25=10 THEN 'rate_limit' WHEN seq%25=15 THEN 'debounce' WHEN seq%2=0 AND seq%3=0 THEN NULL WHEN seq%2=0 THEN 'rate_limit' WHEN seq%3=0 THEN 'debounce' ELSE 'enqueue' END AS mode FROM requests", REQUESTS),
    "enq13_validation": over("SELECT seq, CASE WHEN seq%11=0 THEN 'function_name cannot be empty' WHEN seq%13=0 THEN 'queue_name cannot be empty' WHEN seq%7=0 THEN 'job_timeout_seconds must be positive' WHEN seq%5=0 THEN 'ttl must be positive' WHEN seq%4=3 THEN 'duration must be finite and not negative' WHEN seq%4=2 THEN 'window must be positive' END AS reason FROM requests", REQUESTS),
    "enq1_enqueue": over("SELECT 'r' || (seq%500) AS id, function_name, params AS job_params, ts AS enqueue_time, 'queue:default' AS queue_name, (epoch_us(ts)//1000)::DOUBLE AS score_ms FROM requests QUALIFY row_number() OVER (PARTITION BY seq%500 ORDER BY seq)=1", REQUESTS),
    "clm1_claim": over("SELECT queue_name, job_id, score_ms, rn FROM (SELECT f.queue_name, f.job_id, f.score_ms, row_number() OVER (PARTITION BY f.queue_name ORDER BY f.score_ms, f.job_id) AS rn FROM free f JOIN jobs ON id=job_id) WHERE rn<=25", ALL, _CLAIM.format(n=25)),
    "clm2_lock_ttl": over("SELECT id, CASE WHEN job_timeout_seconds > 0 THEN (job_timeout_seconds+60)*1000 ELSE 360000 END::BIGINT AS lock_ms FROM jobs"),
    "clm4_fair_claim": over("""SELECT CASE WHEN rn>9 THEN 1 ELSE 0 END AS pass, (list_position(['queue:urgent','queue:high','queue:low'], queue_name)-1-1+3)%3 AS queue_offset, rn, queue_name, job_id FROM (SELECT queue_name, job_id, row_number() OVER (PARTITION BY queue_name ORDER BY score_ms, job_id) AS rn FROM free WHERE queue_name IN ('queue:urgent','queue:high','queue:low'))
      WHERE rn<=25 ORDER BY 1, 2, 3 LIMIT 25""", ALL, _CLAIM.format(n=25)),
    "clm8_route": over("SELECT id, CASE WHEN k%4=0 THEN 'gpu' WHEN queue_name='queue:urgent' THEN 'rust' WHEN queue_name='queue:low' THEN 'node' ELSE 'python' END AS runner, CASE WHEN k%4=1 THEN 'h#x' ELSE function_name END AS handler FROM jobs WHERE k%4<>1 UNION ALL SELECT id, 'gpu', 'h#x' FROM jobs WHERE k%4=1"),
    "clm10_needed_runners": over("SELECT DISTINCT CASE WHEN queue_name='queue:urgent' THEN 'rust' WHEN queue_name='queue:low' THEN 'node' ELSE 'python' END AS runner FROM queue"),
    "clm11_concurrency": over("""SELECT greatest(1, coalesce(sum(pool*flight), 0))::BIGINT AS concurrency FROM (VALUES ('python', 2, 8), ('rust', 1, 4), ('node', 2, 1), ('idle', 9, 9)) v(runner, pool, flight)
      WHERE runner IN (SELECT CASE WHEN queue_name='queue:urgent' THEN 'rust' WHEN queue_name='queue:low' THEN 'node' ELSE 'python' END FROM queue)"""),
    "out3_transition": over(f"""SELECT id, kind, CASE WHEN kind='success' THEN 'COMPLETED' WHEN again THEN 'RETRYING' ELSE 'FAILED' END AS status, CASE WHEN kind='success' THEN current_retries ELSE current_retries+1 END AS current_retries,
      CASE WHEN kind='success' THEN last_error WHEN given IS NOT NULL THEN given WHEN kind='retry' THEN 'Job requested retry' WHEN kind='timeout' THEN 'Job timed out after ' || coalesce(job_timeout_seconds, 300) || 's.' WHEN kind='fatal' THEN 'Handler not found' ELSE 'Job failed' END AS last_error,
      CASE WHEN again THEN {_DUE} END::DOUBLE AS score_ms, CASE WHEN kind<>'success' AND NOT again THEN coalesce(dlq_name,'dlq:default') END AS to_dlq,
      CASE WHEN kind='success' THEN CASE WHEN coalesce(result_ttl_seconds, 86400) > 0 THEN {NOW} + to_seconds(coalesce(result_ttl_seconds, 86400)) END WHEN NOT again THEN {NOW} + INTERVAL 7 DAY END AS expires_at FROM t""", ALL, ATTEMPTS, _OUT),
    "out9_retried": over(f"""SELECT queue_name, id AS job_id, {_DUE}::DOUBLE AS score_ms FROM t WHERE again UNION ALL SELECT queue_name, job_id, score_ms FROM queue WHERE job_id NOT IN (SELECT id FROM t WHERE again)""", ALL, ATTEMPTS, _OUT),
    "out6_backoff": "SELECT n, least(5.0 * pow(2, least(greatest(n,1)-1,30)), 3600.0)::DOUBLE AS delay FROM range(0, 50) t(n)",
    "out8_dlq_growth": over("SELECT dlq_name, count(*) AS n FROM (SELECT dlq_name FROM dlq UNION ALL SELECT coalesce(dlq_name,'dlq:default') FROM t WHERE kind<>'success' AND NOT again) GROUP BY 1", ALL, ATTEMPTS, _OUT),
    "out12_deadline": over(f"SELECT id, start_time + to_seconds(job_timeout_seconds) AS deadline, start_time + to_seconds(job_timeout_seconds) <= {NOW} AS expired, greatest(0, epoch_ms(start_time + to_seconds(job_timeout_seconds)) - {NOW_MS}) AS left_ms FROM jobs WHERE status='ACTIVE' AND job_timeout_seconds IS NOT NULL"),
    "out13_cancel": over("SELECT job_id || '-' || attempt AS request_id, job_id FROM attempts WHERE attempt=1 AND job_id::BIGINT%5=0 OR job_id::BIGINT%7=0", ALL, ATTEMPTS),
    "out14_busy": over("""SELECT conn, rid AS request_id, busy FROM fold WHERE delta = 1""", ALL, ATTEMPTS, """ev AS (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY ms, delta, rid) AS n FROM (SELECT worker_id AS conn, job_id || '-' || attempt AS rid, epoch_ms(start_time) AS ms, 1 AS delta FROM attempts
      UNION ALL SELECT worker_id, job_id || '-' || attempt, epoch_ms(start_time)+duration_ms::BIGINT*1000, -1 FROM attempts)),
      fold AS (SELECT conn, n, rid, delta, CASE WHEN delta = 1 THEN [rid] ELSE []::VARCHAR[] END AS running, false AS busy FROM ev WHERE n = 1
      UNION ALL SELECT e.conn, e.n, e.rid, e.delta, CASE WHEN e.delta = -1 THEN list_filter(f.running, lambda x: x <> e.rid) WHEN len(f.running) >= 8 THEN f.running ELSE list_append(f.running, e.rid) END, e.delta = 1 AND len(f.running) >= 8 FROM fold f JOIN ev e ON e.conn = f.conn AND e.n = f.n + 1)""", recursive=True),
    "out16_match": over("SELECT job_id || '-' || attempt AS request_id, CASE WHEN attempt%3=0 THEN 'open' WHEN attempt%3=1 AND job_id::BIGINT%4=0 THEN 'mismatched' ELSE 'answered' END AS state FROM attempts UNION ALL SELECT 'x' || k, 'unknown' FROM jobs WHERE k%10=0", ALL, ATTEMPTS),
    "rec1_orphans": over(f"""SELECT worker_id, job_id, start_s, action, queue_name, CASE WHEN action='requeue' THEN epoch_ms(coalesce(next_scheduled_run_time, {NOW}))::DOUBLE END AS score_ms FROM (SELECT *, CASE WHEN status IS NULL OR status NOT IN ('ACTIVE','PENDING','RETRYING') THEN 'drop' WHEN job_id IN (SELECT job_id FROM queue) THEN 'pending' ELSE 'requeue' END AS action FROM lost)
      WHERE action<>'requeue' OR job_id IN (SELECT job_id FROM lost ORDER BY start_s, job_id LIMIT 100)""", ALL, _LOST),
    "rec3_heartbeat": over("SELECT worker_id, max_by(status, timestamp) AS status, max(timestamp) AS timestamp FROM (SELECT worker_id, timestamp, status FROM health UNION ALL SELECT worker_id, timestamp - INTERVAL 60 SECOND, 'old' FROM health) GROUP BY 1"),
    "rec5_quarantine": over("SELECT id AS job_id, coalesce(dlq_name,'dlq:default') AS dlq_name, job_unique_key AS freed_key FROM jobs WHERE k%97=0 OR k%89=0"),
    "rec8_stale": over("SELECT job_id, queue_name FROM queue WHERE job_id::BIGINT%13=0"),
    "rec9_health": over(f"SELECT worker_id, status, active_jobs, concurrency_limit, queues, greatest(0.0, (epoch_ms(expires_at)-{NOW_MS})/1000.0)::DOUBLE AS ttl_s FROM health WHERE expires_at > {NOW}"),
    "fn1_names": over("SELECT id, queue_name, 'dlq:' || id AS dlq_key FROM jobs"),
    "fn3_json_path": over("SELECT id, json_extract_string(job_params, '$.k') AS k, json_extract_string(job_params, '$.session.id') AS session_id, json_extract_string(job_params, '$.flag') AS flag, CASE WHEN json_type(job_params, '$.session') NOT IN ('OBJECT','ARRAY','NULL') THEN json_extract_string(job_params, '$.session') END AS object FROM jobs"),
    "fn14_queue_wait": over("SELECT id, greatest(0, epoch_ms(start_time)-epoch_ms(enqueue_time)) AS wait_ms FROM jobs"),
    "met5_queue_wait": over("SELECT queue_name, count(*) AS n, avg(w) AS mean_ms, quantile_cont(w, 0.5) AS p50_ms, quantile_cont(w, 0.95) AS p95_ms FROM (SELECT queue_name, greatest(0, epoch_ms(start_time)-epoch_ms(enqueue_time))::DOUBLE AS w FROM jobs WHERE start_time IS NOT NULL) GROUP BY 1"),
    "met5_histogram": over("SELECT queue_name, CASE WHEN w>=60000 THEN 60000 WHEN w>=30000 THEN 30000 WHEN w>=10000 THEN 10000 WHEN w>=5000 THEN 5000 WHEN w>=1000 THEN 1000 ELSE 0 END::DOUBLE AS at_least, count(*) AS observations, sum(w) AS total FROM (SELECT queue_name, greatest(0, epoch_ms(start_time)-epoch_ms(enqueue_time))::DOUBLE AS w FROM jobs WHERE start_time IS NOT NULL) GROUP BY 1, 2"),
    "met6_processed": over("SELECT queue_name, outcome, count(*) AS attempts, sum(duration_ms) AS duration_ms, grouping(queue_name, outcome)::BIGINT AS level FROM attempts GROUP BY ROLLUP (queue_name, outcome)", ALL, ATTEMPTS),
    "met8_inflight": over("""SELECT worker_id, ts_ms, sum(delta) OVER (PARTITION BY worker_id ORDER BY ts_ms)::BIGINT AS in_flight FROM (SELECT worker_id, ts_ms, sum(delta) AS delta FROM (SELECT worker_id, epoch_ms(start_time) AS ts_ms, 1 AS delta FROM attempts
      UNION ALL SELECT worker_id, epoch_ms(start_time)+duration_ms::BIGINT, -1 FROM attempts) GROUP BY 1, 2)""", ALL, ATTEMPTS),
    "met10_runner": over("SELECT function_name, outcome, count(*) AS jobs, avg(duration_ms) AS mean_ms, max(duration_ms) AS max_ms FROM attempts GROUP BY 1, 2", ALL, ATTEMPTS),
    "snk8_dlq_remove": over("""SELECT dlq_name, job_id, pushed_seq FROM (SELECT *, row_number() OVER (PARTITION BY dlq_name, job_id ORDER BY pushed_seq DESC) AS nth FROM (SELECT * FROM dlq UNION ALL SELECT dlq_name, job_id, pushed_seq+1 FROM dlq WHERE job_id::BIGINT%2=0))
      WHERE job_id::BIGINT%3<>0 OR nth>1"""),
    "snk6_results": over(f"SELECT id, CASE WHEN status='ACTIVE' THEN 'COMPLETED' ELSE status END AS status, CASE WHEN status='ACTIVE' THEN '7' ELSE result END AS result, CASE WHEN status='ACTIVE' THEN {NOW} ELSE completion_time END AS completion_time, CASE WHEN status='ACTIVE' AND k%3=2 THEN {NOW} + INTERVAL 1 SECOND END AS expires_at FROM jobs"),
    "met12_spans": over("SELECT a.job_id, attempt, a.queue_name, a.function_name, outcome, greatest(0, epoch_ms(a.start_time)-epoch_ms(j.enqueue_time)) AS queue_wait_ms, duration_ms, greatest(0.0, coalesce(job_timeout_seconds*1000.0-duration_ms, 0))::DOUBLE AS deadline_remaining_ms FROM attempts a JOIN jobs j ON j.id=a.job_id", ALL, ATTEMPTS),
    "met3_poll_cycles": over("SELECT CASE WHEN seq%4<=0 THEN 'no_capacity' WHEN seq%3=0 THEN 'no_jobs' ELSE 'fetched' END AS result, count(*) AS total FROM requests GROUP BY 1", REQUESTS),
    "udf3_outcomes": over("""SELECT id AS job_id, CASE k%5 WHEN 0 THEN 'success' WHEN 1 THEN 'error' WHEN 2 THEN 'timeout' WHEN 3 THEN CASE WHEN current_retries+1 < 2 THEN 'retry' ELSE 'success' END ELSE 'error' END AS status,
      CASE k%5 WHEN 1 THEN 'RuntimeError' WHEN 2 THEN 'timeout' WHEN 4 THEN CASE WHEN k%2=0 THEN 'cancelled' ELSE 'handler_not_found' END END AS error_type FROM jobs"""),
}
