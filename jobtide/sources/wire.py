"""Requests as JSON, framed messages, runner output, and generated jobs."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.scalars import frame
from jobtide.schemas import ENQUEUE_REQUEST, OUTCOME
from jobtide.settings import QUEUE_PREFIX

#: A message is not empty and has at most so many bytes.
MAX_FRAME = 16 << 20


def enqueue_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as requests; what is no such object has a reason in ``problem``."""
    parsed = F.from_json(F.col(column), ENQUEUE_REQUEST)
    rows = lines.withColumn("request", parsed)
    problem = F.when(F.col("request.function_name").isNull(), F.lit("malformed request"))
    return rows.select("request.*", problem.alias("problem"))


def encoded(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row's columns as a framed JSON message."""
    return rows.select(frame(F.to_json(F.struct(*columns))).alias("frame"))


def messages(files: DataFrame) -> DataFrame:
    """(path, content) to (path, at, message, problem): the frames of each byte string in order; a bad length or a cut frame ends it with a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, at, k = data or b"", 0, 0
                while at < len(data):
                    n = struct.unpack(">I", data[at : at + 4])[0] if at + 4 <= len(data) else -1
                    problem = "cut frame" if n < 0 or 0 < n <= MAX_FRAME and at + 4 + n > len(data) else "bad length" if not 0 < n <= MAX_FRAME else None
                    out.append((path, k, None if problem else data[at + 4 : at + 4 + n].decode("utf-8", "replace"), problem))
                    if problem:
                        break
                    at, k = at + 4 + n, k + 1
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "at", "message", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, at long, message string, problem string")


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("message", OUTCOME).alias("o")).select("o.*")


def runner_events(lines: DataFrame, runner: str, now: str) -> DataFrame:
    """A runner's output lines as structured events: a JSON object keeps its fields, other text becomes the message; time, level and runner are filled in."""
    fields = F.from_json("value", "map<string,string>")
    given = F.coalesce(F.when(F.col("value").rlike(r"^\s*\{"), fields), F.create_map(F.lit("message"), F.col("value")))
    filled = F.create_map(*[F.lit(x) for x in ("timestamp", now, "level", "info", "runner", runner)])
    return lines.select(F.map_concat(given, F.map_filter(filled, lambda k, v: ~F.array_contains(F.map_keys(given), k))).alias("event"))


def _drawn(n: Column, seed: int, salt: int, most: int) -> Column:
    """A number below ``most``, the same for the same n, seed and salt: the upper bits of one step of a linear congruential generator."""
    mixed = F.pmod((F.pmod(n, F.lit(1 << 31)) + (seed * 7919 + salt * 104_729)) * 1_103_515_245 + 12_345, F.lit(1 << 31))
    return F.pmod(F.shiftright(mixed, 16), F.lit(most))


def generated_jobs(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Synthetic jobs, the same for the same seed: function, queue, status and age drawn from small sets."""
    pick = lambda salt, *v: F.element_at(F.array(*map(F.lit, v)), (_drawn(F.col("n"), seed, salt, len(v)) + 1).cast("int"))
    return spark.range(n).withColumnRenamed("id", "n").select(
        F.concat(F.lit("gen-"), F.col("n").cast("string")).alias("id"), pick(1, *[f"fn_{i}" for i in range(10)]).alias("function_name"), F.concat(F.lit(QUEUE_PREFIX), pick(2, "default", "high", "low", "bulk")).alias("queue_name"),
        pick(3, "PENDING", "ACTIVE", "COMPLETED", "FAILED").alias("status"), _drawn(F.col("n"), seed, 4, 86_400).cast("long").alias("age_s"),
    )


def generated_heartbeats(spark: SparkSession, workers: int, beats: int, interval_s: int = 60, start: str = "2024-01-01 00:00:00", seed: int = 1) -> DataFrame:
    """Heartbeats of ``workers`` at a fixed interval."""
    n = F.col("n")
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.floor(n / workers) * interval_s).cast("decimal(18,6)"))
    return spark.range(workers * beats).withColumnRenamed("id", "n").select(
        F.concat(F.lit("gen-w"), (n % workers).cast("string")).alias("worker_id"), at.alias("timestamp"), F.when(_drawn(n, seed, 5, 4) == 0, "idle").otherwise("running").alias("status"), _drawn(n, seed, 6, 8).cast("long").alias("active_jobs")
    )


def generated_load(spark: SparkSession, per_second: int) -> DataFrame:
    """An endless stream of synthetic requests at a fixed rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.concat(F.lit("load-"), F.col("value").cast("string")).alias("id"), "timestamp")


def _globs(globs: list[str]) -> str:
    """A regular expression for paths that match a glob, as a whole or by their last part; ``**/`` stands for any folders."""
    one = lambda g: "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.split(r"(\*\*/|\*\*|\*|\?)", g) if t)
    return "|".join(f"^(?:.*/)?{one(g)}$" if "/" not in g else f"^{one(g)}$" for g in globs) or "$^"


def _gitignore(lines: list[str], path: Column) -> Column:
    """Whether a gitignore file names a path or a folder on its way; the last line that matches decides, ``!`` takes a path back."""
    verdict = F.lit(False)
    for line in lines:
        pattern = line.rstrip()
        if not pattern or pattern.startswith("#"):
            continue
        back = pattern.startswith("!")
        pattern = pattern.removeprefix("!")
        anchored = "/" in pattern.rstrip("/")
        folder = pattern.endswith("/")
        body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.split(r"(\*\*/|\*\*|\*|\?)", pattern.strip("/")) if t)
        regex = f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"
        verdict = F.when(path.rlike(regex), F.lit(not back)).otherwise(verdict)
    return verdict


def restart_for(paths: DataFrame, include: list[str], ignore: list[str], gitignore: list[str] | None = None) -> DataFrame:
    """Changed paths that call for a restart: no line of ``gitignore`` and no ignore glob names them, and some include glob does, or there is none."""
    path = F.col("path")
    wanted = path.rlike(_globs(include)) if include else F.lit(True)
    return paths.withColumn("restart", wanted & ~path.rlike(_globs(ignore)) & ~_gitignore(gitignore or [], path))
