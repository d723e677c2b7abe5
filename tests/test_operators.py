"""Single operators on tiny tables, and rules that hold for whole states."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtide import settings
from jobtide.functions import scalars as fn
from jobtide.client import Client, checked, submission
from jobtide.operators import admit, claim, cron, handlers, metrics, outcome, recover, sinks
from jobtide.operators.state import by_glob, empty, insert_new, patched, upsert
from jobtide.plans import catalog
from jobtide.sources import fixtures as fx
from jobtide.sources import wire
from jobtide.streaming import admission

SF = "/root/testdata/sf0.001"
S = settings.Settings()


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_settings(tmp_path):
    f = tmp_path / "x.toml"
    f.write_text('[jobtide]\ndefault_max_retries = 7\n[jobtide.runner_routes]\nhigh = "rust"\n"queue:low" = "node"\n')
    s = settings.load_settings(str(f), {"JOBTIDE_DEFAULT_MAX_RETRIES": "9"})
    assert (s.default_max_retries, s.runner_routes) == (9, {"queue:high": "rust", "queue:low": "node"})
    assert settings.deep_merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {}}) == {"a": {"b": 3, "c": 2}, "d": {}}
    with pytest.raises(ValueError):
        settings.Settings(default_max_retries=0)
    with pytest.raises(FileNotFoundError):
        settings.load_settings(str(tmp_path / "none.toml"), {})


def test_scalars(spark):
    lit = F.lit
    assert one(spark, fn.queue_key(lit("queue:a")), fn.queue_key(lit("a"))) == ("queue:a", "queue:a")
    assert one(spark, *[fn.backoff(lit(n), 2.0, 5.0) for n in (0, 1, 2, 3, 99)]) == (2.0, 2.0, 4.0, 5.0, 5.0)
    doc = lit('{"a":{"b c":"x","n":1.0,"t":true,"o":{},"l":[],"z":null,"e":""},"s.t":1}')
    assert one(spark, *[fn.json_scalar(doc, f"a.{k}") for k in ("b c", "n", "t", "o", "l", "z", "e", "none")]) == ("x", "1.0", "true", None, None, None, None, None)
    assert one(spark, fn.json_scalar(doc, "a..n"), fn.json_scalar(lit("bad"), "a"), fn.json_scalar(lit('{"params":{"a":1},"a":2}'), "params.a")) == (None, None, "2")
    assert one(spark, fn.truncate_utf8(lit("é" * 200), 255), fn.truncate_utf8(lit("ab"), 255)) == ("é" * 127, "ab")
    runners = [c for x in ("#h", "e#", "a#b#c", "f") for c in fn.runner_of(lit(x))]
    assert one(spark, *runners) == (None, "h", "e", "", "a", "b#c", None, "f")
    assert one(spark, *[fn.parse_time(lit(x)) for x in ("12.5", "2024-01-01T00:00:01.234567Z", "2024-01-01", "x")])[0::2] == (12.5, None)
    assert one(spark, *[fn.duration_text(lit(x)) for x in (0.0005, 0.25, 2.5, 75.0, 3700.0)]) == ("500μs", "250ms", "2.5s", "1m 15s", "1h 1m")
    assert one(spark, *[fn.ago(lit(x), lit("long")) for x in (5, 65, 7300, 90000)]) == ("5s ago", "1m ago", "2h ago", "long")
    assert one(spark, fn.dsn_summary(lit("redis://u:p@h:1/0")), fn.shortened(lit("abcdefgh"), 6)) == ("redis://h:1/0", "abc...")
    assert one(spark, F.hex(fn.frame(lit('{"a":1}'))))[0] == "000000077B2261223A317D"
    span, caller = F.create_map(lit("t"), lit("span")), F.create_map(lit("t"), lit("own"), lit("x"), lit("y"))
    assert one(spark, fn.merge_trace(caller, span, False), fn.merge_trace(caller, span, True)) == ({"t": "own", "x": "y"}, {"t": "span", "x": "y"})
    none = lit(None).cast("map<string,string>")
    assert one(spark, fn.correlation(doc, none, {"a": "a.n", "": "a.n", "q": "a.none"}), fn.correlation(doc, none, {"q": "none"})) == ({"a": "1.0"}, None)
    t = lit("2024-02-29 23:59:59.987654").cast("timestamp_ntz")
    assert one(spark, fn.epoch_ms(t), fn.from_ms(fn.epoch_ms(t)).cast("string")) == (1709251199987, "2024-02-29 23:59:59.987")


def requests(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, k, "f", t0 + dt.timedelta(seconds=s), f"p{i}") for i, (k, s) in enumerate(rows)], "seq long, key string, function_name string, ts timestamp_ntz, params string")


def test_admission(spark):
    r = requests(spark, [("a", 0), ("a", 9), ("a", 10), ("b", 3), ("a", 19), ("a", 20), ("b", 3)])
    assert {x["seq"] for x in admit.rate_limited(r, 9.5).collect() if x["admitted"]} == {0, 2, 3, 5}
    assert {(x["seq"], x["job_seq"]) for x in admit.idempotent(r, 10).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 2), (5, 5), (6, 3)}
    runs = {(x["key"], x["job_seq"], x["last_seq"], x["requests"]) for x in admit.debounced(r, 9).collect()}
    assert runs == {("a", 0, 0, 1), ("a", 1, 2, 2), ("a", 4, 5, 2), ("b", 3, 6, 2)}  # exactly at the end a new run starts
    held = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, 15))], "key string, expires_at timestamp_ntz")
    assert {x["seq"] for x in admit.rate_limited(r, 10, held).collect() if x["admitted"]} == {3, 4}
    due = {x["seq"]: (x["takes_lock"], x["scheduled"].second, x["scheduled"].hour) for x in admit.unique_deferred(r, S).collect()}
    assert due[0] == (True, 0, 0) and due[1] == (False, 0, 6)


def test_enqueue_and_state(spark):
    r = requests(spark, [("a", 0), ("a", 1), ("b", 2)]).withColumns({"id": F.col("key"), "queue_name": F.lit("x")})
    s, flags = admit.enqueue(empty(spark), r, S)
    assert s.jobs.count() == 2 and s.queue.where("queue_name = 'queue:x'").count() == 2 and flags.where("created").count() == 2
    s, flags = admit.enqueue(s, r, S)
    assert s.jobs.count() == 2 and flags.where("created").count() == 0
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(x) for x in upsert(base, new, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(x) for x in patched(base, new, "k", "v").collect()} == {("a", 1), ("b", 3)}
    assert insert_new(base, new, "k", "v").where("created").count() == 1
    keys = spark.createDataFrame([("queue:a.b",), ("queue:axb",), (None,)], "k string")
    assert keys.where(by_glob(keys, "k", "queue:?.*")).count() == 1


def test_claim_step(spark):
    s = fx.state(spark, SF)
    new, claims = claim.claim(s, fx.now(), "w7", 5, S)
    n = claims.count()
    assert n == 5 * s.queue.select("queue_name").distinct().count()
    assert new.queue.count() == s.queue.count() - n and new.jobs.where("status = 'ACTIVE' and worker_id = 'w7'").count() >= n
    assert recover.invariants(new).count() == 0
    back = recover.release(new, claims.select("job_id", F.lit("w7").alias("owner")), fx.now())
    assert back.queue.count() == s.queue.count() and back.job_locks.where("owner = 'w7'").join(claims, "job_id", "left_semi").count() == 0


def test_outcomes(spark):
    job = dict(id="1", current_retries=1, max_retries=3, queue_name="queue:a", dlq_name=None, last_error="old", result=None, next_scheduled_run_time=None, job_unique_key="u", result_ttl_seconds=60, job_timeout_seconds=9)
    cases = [("success", None, None, "COMPLETED", 1), ("retry", None, 7.0, "RETRYING", 2), ("error", None, None, "RETRYING", 2), ("timeout", None, None, "FAILED", 2), ("error", "handler_not_found", None, "FAILED", 2)]
    jobs = spark.createDataFrame([{**job, "id": str(i)} for i in range(len(cases))], "id string, current_retries long, max_retries long, queue_name string, dlq_name string, last_error string, result string, next_scheduled_run_time timestamp_ntz, job_unique_key string, result_ttl_seconds long, job_timeout_seconds long")
    out = spark.createDataFrame([(str(i), c[0], c[1], None, "{}", c[2]) for i, c in enumerate(cases)], "job_id string, status string, error_type string, error_message string, result string, retry_after_seconds double")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = {r["id"]: r for r in outcome.transitions(jobs, out, now, S).collect()}
    for i, c in enumerate(cases):
        assert (rows[str(i)]["status"], rows[str(i)]["current_retries"]) == c[3:]
    base = 1704067200000
    assert rows["1"]["score_ms"] == base + 7000 and rows["2"]["score_ms"] == base + 10000 and rows["3"]["to_dlq"] == "dlq:default" and rows["0"]["last_error"] == "old"
    assert rows["3"]["last_error"] == "Job timed out after 9s." and rows["4"]["last_error"] == "Handler not found" and (rows["0"]["expires_at"] - dt.datetime(2024, 1, 1)).seconds == 60


def test_recovery(spark):
    s = fx.state(spark, SF)
    new = recover.recover(s, fx.now(), S)
    n = recover.orphans(s, fx.now(), S.orphan_recovery_limit).where("action = 'requeue'").count()
    assert 0 < n <= 100 and new.queue.count() == s.queue.count() + n and recover.invariants(new).where("rule = 'queued twice'").count() == 0


def test_cron(spark):
    t = dt.datetime(2024, 1, 31, 23, 59, 40)
    assert cron.next_run("0 * * * * *", t) == dt.datetime(2024, 2, 1) and cron.next_run("30 * * * * *", t) == dt.datetime(2024, 1, 31, 23, 59, 30)
    assert cron.next_run("0 0 12 29 2 *", t) == dt.datetime(2024, 2, 29, 12) and cron.next_run("0 0 0 31 2 *", t) is None
    assert cron.fires("30 * * * * *", dt.datetime(2024, 1, 1, 0, 0, 10), 6) == [dt.datetime(2024, 1, 1, 0, 0, 40), dt.datetime(2024, 1, 1, 0, 1, 10), dt.datetime(2024, 1, 1, 0, 1, 40), dt.datetime(2024, 1, 1, 0, 2, 10), dt.datetime(2024, 1, 1, 0, 2, 40)]
    for bad in ("* * * *", "60 * * * * *", "*/0 * * * * *"):
        with pytest.raises(ValueError):
            cron.fields(bad)
    schedules = ["0 * * * * *", "30 * * * * *", "5,45 */7 1-3 * * *", "0 0 12 1 2 *"]
    got = cron.next_runs(spark.createDataFrame([(x,) for x in schedules], "schedule string"), schedules, F.lit("2024-01-31 23:59:40").cast("timestamp_ntz")).collect()
    assert {r["schedule"]: r["next_run"] for r in got} == {x: cron.next_run(x, t) for x in schedules}


def test_far_times(spark):
    """Findings of round 2, F1: seconds and milliseconds beyond what an interval's seconds hold."""
    t = F.lit("2024-01-02 03:04:05.123456").cast("timestamp_ntz")
    far = one(spark, *[fn.plus_seconds(t, F.lit(x)).cast("string") for x in (9_000_000_000_000, -5, -86400.5)], *[fn.from_ms(F.lit(x)).cast("string") for x in (9_000_000_000_000_000, -1)])
    assert far == ("+287222-08-25 19:04:05.123456", "2024-01-02 03:04:00.123456", "2024-01-01 03:04:04.623456", "+287168-08-24 16:00:00", "1969-12-31 23:59:59.999")


def test_due_with_many_jobs(spark, tmp_path):
    """Findings of round 2, F1: keys of the driver's 1 GB, and keys whose run lies beyond the last timestamp."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(60)
    key = F.monotonically_increasing_id()
    orders.withColumns({"o_orderstatus": F.lit("P"), "o_orderkey": F.when(key < 30, 2 * key + 1).when(key < 50, 9_000_001 + 2 * key).otherwise(54_000_001 + 2 * key)}).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: r["due"] for r in catalog.QUERIES["crn2_due"](spark, str(tmp_path)).collect()}
    assert len(got) == 60 and {due for k, due in got.items() if int(k) > 9_000_000} == {False} and got["1"]


def test_cron_beyond_a_day(spark):
    schedules = ["0 0 0 1 1 *", "15 30 6 1 * *", "0 0 9 * * 2", "0 0 12 29 2 *", "30 5 0 29 2 1", "0 0 0 31 2 *", "59 59 23 * * *", "10,50 0,59 0,23 * 1-3 *", "30 * * * * *"]
    for t in (dt.datetime(2024, 1, 2), dt.datetime(2024, 12, 31, 23, 59, 40), dt.datetime(2097, 1, 1), dt.datetime(1969, 6, 1, 13, 14, 15), dt.datetime(2024, 2, 29, 12)):
        got = cron.next_runs(spark.createDataFrame([(x,) for x in schedules], "schedule string"), schedules, F.lit(str(t)).cast("timestamp_ntz")).collect()
        assert {r["schedule"]: r["next_run"] for r in got} == {x: cron.next_run(x, t) for x in schedules}
    assert cron.next_run("30 5 0 29 2 1", dt.datetime(2024, 1, 2)) == dt.datetime(2032, 2, 29, 0, 5, 30)


def test_tick_fires_by_schedule(spark):
    """Findings of round 2, F3: a schedule is folded once, however many crons have it."""
    t0, schedules = dt.datetime(2024, 1, 2, 0, 30, 10), ["0 * * * * *", "15,45 */7 1-3 * * *", "0 0 0 31 2 *"]
    crons = spark.range(90).select(F.concat(F.lit("f"), "id").alias("function_name"), F.element_at(F.array(*map(F.lit, schedules)), (F.col("id") % 3 + 1).cast("int")).alias("schedule"))
    crons = crons.unionByName(crons.limit(3))  # repeated rows fire as often
    df = cron.tick_fires(crons, t0, 100)
    at = {s: cron.fires(s, t0, 100) for s in schedules}
    want = [(r["function_name"], t) for r in crons.collect() for t in at[r["schedule"]]]
    assert want and sorted(map(tuple, df.collect())) == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [schedule" in plan[plan.index("MapInArrow") :] and plan.count("MapInArrow") == 1


def test_next_runs_by_lookup(spark):
    """Findings of round 2, F4: no list of hours, minutes or seconds is searched in a row."""
    schedules = ["0 * * * * *", "15,45 */7 1-3 * * *", "30 0 12 * * 2", "10,50 0,59 0,23 * 1-3 *", "* 30-40 */5 * * *", "0 0 0 29 2 *", "0 0 0 31 2 *"]
    t0 = dt.datetime(2023, 12, 30, 22, 58, 40)
    rows = spark.range(7 * 300).select("id", F.element_at(F.array(*map(F.lit, schedules)), (F.col("id") % 7 + 1).cast("int")).alias("schedule"), fn.plus_seconds(F.lit(str(t0)).cast("timestamp_ntz"), F.col("id") * 97).alias("now"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "0 * * * * *", None), (-2, None, t0), (-3, "1 1 1 1 1 *", t0)], "id long, schedule string, now timestamp_ntz"))
    df = cron.next_runs(rows, schedules, F.col("now"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in df.collect():
        assert r["next_run"] == (None if r["id"] < 0 else cron.next_run(r["schedule"], r["now"])), r


def test_attempts_are_dealt_out_once(spark):
    """Findings of round 2, F5 and F6: the join finds line items as the window left them, and edges in flight aren't held in a map."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fx.attempts(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    a = spark.createDataFrame([("a", 0, 5), ("a", 5, 5), ("a", 5, 0), ("a", 7, 1), ("b", 1, None), ("b", None, 2)], "worker_id string, start_ms long, duration_ms long")
    df = metrics.in_flight(a)
    assert {tuple(r) for r in df.collect()} == {("a", 0, 1), ("a", 5, 1), ("a", 7, 2), ("a", 8, 1), ("a", 10, 0), ("b", None, -1), ("b", 1, 0)}
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_registry():
    r, seen = handlers.Registry(), []
    r.register("f", lambda p, n: p["x"])
    with pytest.raises(ValueError):
        r.register("f", len)
    with pytest.raises(ValueError):
        r.register(" ", len)
    assert r.run("f", '{"x": 2}', 1)[:2] == ("success", "2")
    r.register("f", lambda p, n: p["x"] + 1, replace=True)  # the last registration wins
    r.hook = lambda *call: seen.append(call)
    assert r.run("f", '{"x": 2}', 1)[:2] == ("success", "3") and r.run("f", "{}", 4)[2] == "KeyError" and seen == [("f", 1, "success"), ("f", 4, "error")]
    r.unregister("f")
    r.unregister("none")
    assert r.names() == [] and r.run("f", None, 1)[2] == "handler_not_found"
    r.register("g", len)
    r.clear()
    assert r.names() == []


def test_settings_rules():
    for bad in ({"default_job_timeout_seconds": 0}, {"max_retry_delay_seconds": float("nan")}, {"base_retry_delay_seconds": -1.0}, {"worker_health_check_interval_seconds": 0.0}, {"default_lock_timeout_extension_seconds": -1}, {"default_queue_name": " "}, {"runner_routes": {"queue:": "x"}}, {"runner_routes": {"queue:a": ""}}):
        with pytest.raises(ValueError):
            settings.Settings(**bad)
    assert settings.env_overrides({"JOBTIDE_DEFAULT_MAX_RETRIES": "3", "JOBTIDE_UNKNOWN": "1"}) == {"default_max_retries": 3}


def test_jitter_and_capacity(spark):
    got = [r[0] for r in spark.range(2000).select(admit.jitter(0.1, 0.5, 7)).collect()]
    assert 0.05 <= min(got) < 0.06 and 0.14 < max(got) <= 0.15
    assert all(0 < r[0] < 0.2 for r in spark.range(100).select(admit.jitter(0.1, 5.0, 7)).collect())


def test_handlers():
    r = handlers.examples()
    with pytest.raises(ValueError):
        r.register("echo", len)
    assert r.run("retry", "{}", 1)[:1] == ("retry",) and r.run("retry", "{}", 2)[0] == "success" and r.run("none", None, 1)[2:4] == ("handler_not_found", "No handler registered for function 'none'")
    assert r.names() == ["abort", "echo", "error", "quick", "retry", "slow"] and r.run("abort", None, 1)[2] == "cancelled"


def test_wire(spark):
    good = b"\x00\x00\x00\x02{}" + b"\x00\x00\x00\x01x"
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good + b"\x00\x00\x00\x09z")), ("c", bytearray(b"\x00\x00\x00\x00")), ("d", None)], "path string, content binary")
    got = {(r["path"], r["at"], r["message"], r["problem"]) for r in wire.messages(files).collect()}
    assert got == {("a", 0, "{}", None), ("a", 1, "x", None), ("b", 0, "{}", None), ("b", 1, "x", None), ("b", 2, None, "cut frame"), ("c", 0, None, "bad length")}
    lines = spark.createDataFrame([('{"function_name":"f","params":"{}","options":{"defer_by_seconds":2.5}}',), ("oops",)], "value string")
    rows = wire.enqueue_requests(lines).collect()
    assert rows[0]["options"]["defer_by_seconds"] == 2.5 and rows[1]["problem"] == "malformed request"
    events = wire.runner_events(spark.createDataFrame([('{"level":"warn","message":"m"}',), ("text",)], "value string"), "r", "t").collect()
    assert events[0]["event"] == {"level": "warn", "message": "m", "timestamp": "t", "runner": "r"} and events[1]["event"]["message"] == "text"
    paths = spark.createDataFrame([("src/a.py",), ("src/x/b.py",), (".git/c.py",), ("a.txt",)], "path string")
    assert {r["path"] for r in wire.restart_for(paths, ["**/*.py"], [".git/**"]).where("restart").collect()} >= {"src/a.py"}


def test_stream_agrees_with_batch(spark, tmp_path):
    r = fx.requests(spark, SF).select("key", "seq", F.col("ts").cast("timestamp").alias("ts"))
    r.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    admission.rate_limited(stream, 86_400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(x["seq"], x["admitted"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(x["seq"], x["admitted"]) for x in admit.rate_limited(fx.requests(spark, SF), 86_400).collect()}
    assert {s for s, a in got if a} == {s for s, a in want if a} and len(got) == len(want)
    seen = []
    admission.drain(admission.windowed(stream.withColumn("function_name", F.lit("f")), "1 day"), lambda df, n: seen.append(df.agg(F.sum("requests")).first()[0]), str(tmp_path / "d"))
    assert sum(x or 0 for x in seen) > 0


def test_streams_of_completions_and_load(spark, tmp_path):
    jobs = fx.jobs(spark, SF)
    events = jobs.where("status in ('COMPLETED', 'FAILED', 'PENDING')").select(F.col("id").alias("job_id"), "status")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = []
    admission.drain(admission.completions(stream, jobs), lambda df, n: got.extend(df.collect()), str(tmp_path / "c"))
    assert {(r["job_id"], r["function_name"]) for r in got} == {(r["id"], r["function_name"]) for r in jobs.where("status in ('COMPLETED', 'FAILED')").collect()}
    load = wire.generated_load(spark, 50)
    query = load.writeStream.format("memory").queryName("load").trigger(once=True).start()
    query.awaitTermination(60)
    assert load.isStreaming and load.columns == ["id", "timestamp"]


def test_rank_pages(spark):
    s = fx.state(spark, SF)
    order = {}
    for r in sorted(s.queue.collect(), key=lambda r: (r["score_ms"], r["job_id"])):
        order.setdefault(r["queue_name"], []).append(r["job_id"])
    for start, stop in ((0, 4), (3, 3), (-5, -1), (2, -3), (-4, 10_000), (-10_000, -2), (5, 2)):
        want = set()
        for q, ids in order.items():
            lo, hi = (x if x >= 0 else len(ids) + x for x in (start, stop))
            want |= {(q, i, ids[i]) for i in range(max(lo, 0), min(hi, len(ids) - 1) + 1)}
        assert {(r["queue_name"], r["rank"], r["job_id"]) for r in claim.rank_page(s, start, stop).collect()} == want


def test_client(spark):
    r = requests(spark, [("a", 0), ("a", 5), ("b", 6), ("a", 70)]).withColumns({"id": F.concat(F.lit("j"), F.col("seq").cast("string")), "queue_name": F.lit("x")})
    c = Client(empty(spark), S)
    got = {x["seq"]: (x["job_id"], x["created"]) for x in c.enqueue_with_unique_key(r, 60).collect()}
    assert got == {0: ("j0", True), 1: ("j0", False), 2: ("j2", True), 3: ("j3", True)} and c.state.jobs.count() == 3
    c = Client(empty(spark), S)
    assert {x["seq"]: x["job_id"] for x in c.enqueue_with_rate_limit(r, 10).collect()} == {0: "j0", 1: None, 2: "j2", 3: "j3"}
    assert c.state.jobs.count() == 3
    more = requests(spark, [("a", 75), ("a", 200), ("b", 201)]).withColumns({"seq": F.col("seq") + 10, "id": F.concat(F.lit("k"), F.col("seq").cast("string")), "queue_name": F.lit("x")})
    assert {x["seq"]: x["job_id"] for x in c.enqueue_with_rate_limit(more, 10).collect()} == {10: None, 11: "k1", 12: "k2"}  # the key of j3 is held until 80
    c = Client(empty(spark), S)
    assert {x["seq"]: x["status"] for x in c.submit(r.withColumn("unique_key", F.col("key"))).collect()} == {0: "enqueued", 1: "existing", 2: "enqueued", 3: "existing"}
    assert {x["seq"]: x["job_id"] for x in c.submit(more.withColumn("unique_key", F.col("key"))).collect()} == {10: "j0", 11: "j0", 12: "j2"}
    c = Client(c.state.with_(jobs=c.state.jobs.where("id != 'j0'")), S, c.keys)
    assert {x["seq"]: x["job_id"] for x in c.submit(more.withColumn("unique_key", F.col("key"))).collect()} == {10: "k0", 11: "k0", 12: "j2"}  # a key whose job is gone is free
    c = Client(empty(spark), S)
    assert c.enqueue_with_debounce(r, 10).count() == 3 and {(x["id"], x["job_params"]) for x in c.state.jobs.collect()} == {("j0", "p1"), ("j2", "p2"), ("j3", "p3")}
    assert {(x["id"], x["next_scheduled_run_time"].second) for x in c.state.jobs.collect()} == {("j0", 15), ("j2", 16), ("j3", 20)}
    answers = spark.createDataFrame([(1, "j", "enqueued", None), (2, " ", "existing", None), (3, None, "rejected", None), (4, None, "lost", None), (5, None, "rate_limited", None), (None, "j", "enqueued", None)], "seq long, job_id string, status string, reason string")
    assert {x["seq"]: x["problem"] for x in checked(answers).collect()} == {1: None, 2: "no job id", 3: "no reason", 4: "unknown status", 5: None, None: "no request"}
    assert {tuple(x)[:2] for x in c.get_job_status(c.state.jobs).collect()} == {(i, "PENDING") for i in ("j0", "j2", "j3")}
    assert submission({"x": 1}, [2]) == {"x": 1, "args": [2]}
    with pytest.raises(ValueError):
        submission({"args": 1}, [2])


def test_sinks(spark):
    s = fx.state(spark, SF)
    one = s.queue.limit(1).withColumn("score_ms", F.lit(1.0))
    assert sinks.queued(s, one).queue.count() == s.queue.count() and sinks.queued(s, one).queue.where("score_ms = 1").count() == 1
    new, gone = sinks.unqueued(s, one)
    assert new.queue.count() == s.queue.count() - 1 and gone.count() == 1
    d = sinks.dead(s, s.jobs.where("status = 'ACTIVE'").select("id", F.lit("bad").alias("error")), fx.now(), S)
    assert d.dlq.count() == s.dlq.count() + s.active.count() and d.jobs.where("last_error = 'bad' and status = 'FAILED'").count() == s.active.count()
    assert sinks.saved(s, s.jobs.limit(3).withColumn("status", F.lit("CANCELLED"))).jobs.count() == s.jobs.count()
    assert sinks.untracked(s, s.active.select("worker_id", "job_id")).active.count() == 0 and sinks.tracked(s, s.active).active.count() == s.active.count()
    assert spark.range(1).select(outcome.outcome("retry", message="m", retry_after=2.0).alias("o")).first()["o"]["retry_after_seconds"] == 2.0
    assert wire.generated_heartbeats(spark, 3, 4).count() == 12
