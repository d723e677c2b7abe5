"""A producer's view: requests in, new state and answers out. One client holds one state; calls return the answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import debounce_key, idempotency_key, plus_seconds, rate_limit_key
from jobtide.operators import admit
from jobtide.operators.state import JobState
from jobtide.settings import Settings
from jobtide.sources.lookups import completed_within, statuses

ANSWERS = ("enqueued", "existing", "duplicate", "rejected", "rate_limited")


class Client:
    """Requests are (id, seq, key, ts, function_name, params, queue_name) and what else ``admit.produce`` takes.

    Keys that a call takes are held for the calls after it: ``keys`` is a table (key, job_id, expires_at), its keys named by their kind.
    Calls come in the order of their times.
    """

    def __init__(self, state: JobState, settings: Settings | None = None, keys: DataFrame | None = None):
        self.state, self.settings, self.keys = state, settings or Settings(), keys

    def _held(self, name: Callable[[Column], Column], requests: DataFrame) -> DataFrame | None:
        """The held keys of a kind under the names that requests use."""
        if self.keys is None:
            return None
        asked = requests.select(F.col("key").alias("asked")).where("asked is not null").distinct().withColumn("key", name(F.col("asked")))
        return self.keys.join(asked, "key").select(F.col("asked").alias("key"), "job_id", "expires_at")

    def _hold(self, keys: DataFrame) -> None:
        self.keys = keys if self.keys is None else self.keys.unionByName(keys)

    def enqueue(self, requests: DataFrame) -> DataFrame:
        """id, seq, created; a known id is refused."""
        self.state, answers = admit.enqueue(self.state, requests, self.settings)
        return answers

    def submit(self, requests: DataFrame) -> DataFrame:
        """seq, job_id, status, reason by the whole contract of ``admit.produce``; the unique key is in ``unique_key``."""
        held = self._held(idempotency_key, requests.select(F.col("unique_key").alias("key")) if "unique_key" in requests.columns else requests.select(F.lit(None).cast("string").alias("key")))
        self.state, answers, keys = admit.produce(self.state, requests, self.settings, held)
        self._hold(keys.withColumn("key", idempotency_key(F.col("key"))))
        return answers

    def enqueue_with_unique_key(self, requests: DataFrame, ttl_seconds: int) -> DataFrame:
        """seq, job_id, created: a request whose key is alive gets the job that took it."""
        rows = requests.withColumns({"unique_key": F.col("key"), "unique_ttl_seconds": F.lit(float(ttl_seconds))})
        return self.submit(rows).select("seq", "job_id", (F.col("status") == "enqueued").alias("created"))

    def enqueue_with_rate_limit(self, requests: DataFrame, window_seconds: float) -> DataFrame:
        """seq, job_id or null, status."""
        known = self.state.jobs.select("id", F.lit(True).alias("known")).distinct()
        rows = requests.join(known, "id", "left")
        told = admit.rate_limited(rows, window_seconds, self._held(rate_limit_key, requests), F.coalesce("known", F.lit(False)))
        admitted = requests.join(told.where("admitted").select("seq"), "seq", "left_semi")
        self.enqueue(admitted)
        self._hold(admitted.select(rate_limit_key(F.col("key")).alias("key"), F.col("id").alias("job_id"), plus_seconds(F.col("ts"), F.ceil(F.lit(window_seconds))).alias("expires_at")))
        out = requests.select("seq", "id").join(told, "seq")
        return out.select("seq", F.when(F.col("admitted"), F.col("id")).alias("job_id"), admit.rate_limit_status(F.col("admitted"), F.col("refused")).alias("status"))

    def enqueue_with_debounce(self, requests: DataFrame, window_seconds: float) -> DataFrame:
        """The jobs that are left of the requests, each with its last payload, due a window after its last request."""
        runs = admit.debounced(requests, window_seconds)
        first = requests.select(F.col("seq").alias("job_seq"), "id")
        jobs = runs.join(first, "job_seq").select("id", F.col("job_seq").alias("seq"), "key", F.col("enqueue_time").alias("ts"), "function_name", "params", "queue_name", F.col("scheduled").alias("defer_until"))
        self.state, _, _ = admit.produce(self.state, jobs, self.settings)
        self._hold(runs.join(first, "job_seq").select(debounce_key(F.col("key")).alias("key"), F.col("id").alias("job_id"), F.col("scheduled").alias("expires_at")))
        return runs

    def enqueue_deferred(self, requests: DataFrame, until: Column, by_seconds: Column) -> DataFrame:
        return self.submit(requests.withColumns({"defer_until": until, "defer_by_seconds": by_seconds}))

    def get_job_status(self, ids: DataFrame) -> DataFrame:
        return statuses(self.state, ids)

    def wait_for_completion(self, waits: DataFrame) -> DataFrame:
        return completed_within(self.state, waits)


def checked(answers: DataFrame) -> DataFrame:
    """Answers (seq, job_id, status, reason) with ``problem``: what makes one no valid answer, null if it is one."""
    status, has_id = F.col("status"), F.coalesce(F.trim("job_id") != "", F.lit(False))
    problem = (
        F.when(F.col("seq").isNull(), "no request")
        .when(status.isNull() | ~status.isin(*ANSWERS), "unknown status")
        .when(status.isin("enqueued", "existing", "duplicate") & ~has_id, "no job id")
        .when((status == "rejected") & F.col("reason").isNull(), "no reason")
    )
    return answers.withColumn("problem", problem)


def submission(params: dict, args: list | None) -> dict:
    """Positional arguments go under ``args``; both at once are refused."""
    if args and "args" in params:
        raise ValueError("args are given twice")
    return {**params, "args": list(args)} if args else dict(params)
