"""Cron schedules: six fields (with seconds) in UTC; numbers, *, lists, ranges and steps."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.scalars import epoch_ms, from_ms
from jobtide.operators.state import JobState, live

# The range of each field: second, minute, hour, day, month, day of the week (1 is Sunday).
RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (1, 7))
#: How far a next run is looked for: leap days on one day of the week are at most 40 years apart, so what has no run by then has none.
YEARS = 40
DAY_MS = 86_400_000


def fields(schedule: str) -> list[list[int]]:
    """The allowed values of the six fields."""
    parts = schedule.split()
    if len(parts) != len(RANGES):
        raise ValueError(f"a schedule has {len(RANGES)} fields: {schedule!r}")
    out = []
    for part, (low, high) in zip(parts, RANGES, strict=True):
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if a in ("*", "?") else (int(a), int(b) if b else (high if step else int(a)))
            if not low <= first <= last <= high or step and int(step) < 1:
                raise ValueError(f"{item!r} is outside {low}-{high}")
            values |= set(range(first, last + 1, int(step or 1)))
        out.append(sorted(values))
    return out


def next_run(schedule: str, now: datetime) -> datetime | None:
    """The first match after ``now`` without its seconds; None within YEARS."""
    seconds, minutes, hours, days, months, weekdays = map(set, fields(schedule))
    base = now.replace(second=0, microsecond=0)
    day, end = base.replace(hour=0, minute=0), base + timedelta(days=366 * YEARS)
    while day < end:
        if day.month in months and day.day in days and day.isoweekday() % 7 + 1 in weekdays:
            for h in sorted(hours):
                for m in sorted(minutes):
                    for s in sorted(seconds):
                        t = day.replace(hour=h, minute=m, second=s)
                        if t > base:
                            return t
        day += timedelta(days=1)
    return None


def _after(values: list[int], size: int) -> tuple[list[bool], list[int | None]]:
    """For each number below ``size`` whether it is among the values, and the smallest value beyond it."""
    return [k in values for k in range(size)], [next((v for v in values if v > k), None) for k in range(size)]


def _tables(schedule: str) -> Column:
    """A schedule as lookups by hour and minute, and its allowed days: what its next run takes needs no search in a row."""
    seconds, minutes, hours, days, months, weekdays = fields(schedule)
    at_hour, later_hour = _after(hours, 24)
    at_minute, later_minute = _after(minutes, 60)
    arrays = {"at_hour": at_hour, "later_hour": later_hour, "at_minute": at_minute, "later_minute": later_minute, "days": days, "months": months, "weekdays": weekdays}
    # the base has no seconds, so a second counts within its minute if it is not 0
    single = {"later_second": next((v for v in seconds if v), None), "hour": hours[0], "minute": minutes[0], "second": seconds[0]}
    return F.struct(*[F.array(*map(F.lit, v)).cast("array<boolean>" if isinstance(v[0], bool) else "array<int>").alias(k) for k, v in arrays.items()], *[F.lit(v).cast("int").alias(k) for k, v in single.items()])


def next_runs(jobs: DataFrame, schedules: list[str], now: Column) -> DataFrame:
    """next_run of each row of (schedule, ...); null where there is none within YEARS. ``schedules`` are the distinct ones, parsed on the driver; ``now`` may be a column of the rows.

    The rest of the current day is looked up first, by hour, minute and second. Else the next day that matches is looked up in a calendar of each schedule's days, which
    has a row for each day between the first and the last ``now`` and YEARS beyond; on it the smallest hour, minute and second count.
    """
    spark = jobs.sparkSession
    known = F.create_map(*[x for s in schedules for x in (F.lit(s), _tables(s))])
    base = epoch_ms(now) - F.pmod(epoch_ms(now), F.lit(60_000))
    rows = jobs.withColumn("base", base).withColumn("day", F.floor(F.col("base") / DAY_MS)).withColumn("f", known[F.col("schedule")])
    low, high = rows.agg(F.min("day"), F.max("day")).first()
    if low is None:
        return jobs.withColumn("next_run", F.lit(None).cast("timestamp_ntz"))

    t = from_ms(F.col("day") * DAY_MS)
    matches = F.array_contains(F.col("f.days"), F.dayofmonth(t)) & F.array_contains(F.col("f.months"), F.month(t)) & F.array_contains(F.col("f.weekdays"), F.dayofweek(t))
    calendar = spark.range(low, high + 366 * YEARS + 1).select(F.col("id").alias("day"), F.explode(known).alias("schedule", "f"))
    after = Window.partitionBy("schedule").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    calendar = calendar.withColumn("on", matches).withColumn("later", F.min(F.when(F.col("on"), F.col("day"))).over(after)).where(F.col("day") <= high).select("schedule", "day", "on", "later")

    def at(day: Column, h: Column, m: Column, s: Column) -> Column:
        return day * DAY_MS + h.cast("long") * 3_600_000 + m.cast("long") * 60_000 + s.cast("long") * 1000

    minute = ((F.col("base") - F.col("day") * DAY_MS) / 60_000).cast("int")
    h, m = F.floor(minute / 60).cast("int"), minute % 60
    first = [F.col(f"f.{c}") for c in ("hour", "minute", "second")]
    next_hour, next_minute = F.get("f.later_hour", h), F.get("f.later_minute", m)
    in_hour = F.get("f.at_hour", h)
    today = (
        F.when(in_hour & F.get("f.at_minute", m) & F.col("f.later_second").isNotNull(), at(F.col("day"), h, m, F.col("f.later_second")))
        .when(in_hour & next_minute.isNotNull(), at(F.col("day"), h, next_minute, first[2]))
        .when(next_hour.isNotNull(), at(F.col("day"), next_hour, *first[1:]))
    )
    # the days that next_run looks at begin before the base and 366 * YEARS days
    later = F.when(F.col("later") * DAY_MS < F.col("base") + F.lit(366 * YEARS * DAY_MS), F.col("later"))
    # rows go to the calendar with a few numbers, not with their schedule's lookups
    rows = rows.select(*jobs.columns, "base", "day", today.alias("today"), F.struct(*first).alias("first"))
    found = rows.join(calendar, ["schedule", "day"], "left")
    return found.select(*jobs.columns, from_ms(F.coalesce(F.when(F.col("on"), F.col("today")), at(later, *[F.col(f"first.{c}") for c in ("hour", "minute", "second")]))).alias("next_run"))


def fires(schedule: str, begin: datetime, ticks: int, tick_seconds: int = 30) -> list[datetime]:
    """The ticks at which a schedule fires: due is scheduled first if unset, fires once when reached and is then scheduled anew; missed runs aren't made up."""
    out, due = [], next_run(schedule, begin)
    for k in range(ticks):
        t = begin + timedelta(seconds=k * tick_seconds)
        if due is None:  # what has no run within YEARS has none at a later tick
            break
        if t >= due:
            out.append(t)
            due = next_run(schedule, t)
    return out


def due(rows: DataFrame, now: Column) -> DataFrame:
    """Cron rows (schedule's next_run) with ``due``: the next run has come. A row without a next run yet is scheduled first, so it is not due.

    next_run and ``now`` are of one type, timestamps or milliseconds.
    """
    return rows.withColumn("due", F.coalesce(F.col("next_run") <= now, F.lit(False)))


def tick_fires(crons: DataFrame, begin: datetime, ticks: int, tick_seconds: int = 30) -> DataFrame:
    """(function_name, fired_at) of a table of crons (function_name, schedule) over a row of ticks, by the rule of ``fires``.

    When a cron fires depends on its schedule alone: each distinct schedule is folded once, and its crons are joined to what came of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schedules = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fires(s, begin, ticks, tick_seconds) for s in schedules], pa.list_(pa.timestamp("us")))], names=["schedule", "fired"])

    folded = crons.select("schedule").distinct().mapInArrow(run, "schedule string, fired array<timestamp_ntz>")
    return crons.select("function_name", "schedule").join(folded, "schedule").select("function_name", F.explode("fired").alias("fired_at"))


def due_unlocked(due: DataFrame, state: JobState, now: Column) -> DataFrame:
    """Due cron rows (function_name, unique): a unique one is left out while its key is held."""
    keyed = due.withColumn("key", F.when(F.col("unique"), F.concat(F.lit("cron:"), "function_name")))
    held = live(state.unique_locks, now).select("key").distinct().withColumn("held", F.lit(True))
    return keyed.join(held, "key", "left").where("held is null").drop("held", "key")
