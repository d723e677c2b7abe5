"""The state of a job system as a set of tables; operators return new ones and never change any."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtide import schemas


@dataclass(frozen=True)
class JobState:
    jobs: DataFrame | None = None
    queue: DataFrame | None = None
    job_locks: DataFrame | None = None
    unique_locks: DataFrame | None = None
    active: DataFrame | None = None
    dlq: DataFrame | None = None
    job_events: DataFrame | None = None
    health: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> JobState:
        return replace(self, **tables)


def empty(spark: SparkSession) -> JobState:
    """A state without rows."""
    none = lambda s: spark.createDataFrame([], s)
    return JobState(
        none(schemas.JOB), none(schemas.QUEUE), none(schemas.JOB_LOCKS), none(schemas.UNIQUE_LOCKS), none(schemas.ACTIVE), none(schemas.DLQ), none(schemas.JOB_EVENTS), none(schemas.HEALTH)
    )


def live(df: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired; a null expiry never does."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def upsert(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``new`` in place of the rows of ``base`` with its keys."""
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_new(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` with a flag ``created``: the first row of a key that ``base`` lacks is created, the others are not."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    known = base.select(F.col(key)).distinct().withColumn("known", F.lit(True))
    return new.join(known, key, "left").withColumn("created", F.col("known").isNull() & first).drop("known")


def patched(base: DataFrame, patches: DataFrame, key: str, *columns: str) -> DataFrame:
    """Non-null ``columns`` of ``patches`` over those of ``base``."""
    p = patches.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in columns])
    return base.join(p, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def by_glob(df: DataFrame, column: str, pattern: str) -> Column:
    """Whether a key matches a glob of *, ? and [sets]."""
    regex = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-" or c.isalnum() else "\\" + c) for c in pattern)
    return F.coalesce(df[column].rlike(f"(?s)^{regex}$"), F.lit(False))
