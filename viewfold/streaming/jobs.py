"""The outbox's jobs: what each waits for, and what has become of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from viewfold.functions.times import micros

KINDS = ("upload", "reference", "notify")
STATES = ("done", "failed", "timed out", "blocked", "waiting", "ready")


def job_states(jobs: DataFrame, outcomes: DataFrame, now: Column | None = None, timeout: float = 5.0) -> DataFrame:
    """``jobs`` (job_id, kind, dependent, ts, …) with ``state``.

    ``dependent`` is the job that has to wait for this one, as a notification waits for the upload
    of its clip. ``outcomes``: (job_id, state) of jobs that have run, done or failed; the last of
    several is failed. A job that has none is timed out ``timeout`` seconds after its ts, else
    blocked if one that it waits for has failed, waiting while one hasn't run or its own time
    has not come, or ready."""
    done = outcomes.groupBy("job_id").agg(F.max("state").alias("__s"))
    known = jobs.join(done, "job_id", "left")
    before = known.where("dependent is not null").groupBy(F.col("dependent").alias("job_id")).agg(
        F.bool_or(F.coalesce(F.col("__s") == "failed", F.lit(False))).alias("__broken"), F.bool_or(F.coalesce(F.col("__s") != "done", F.lit(True))).alias("__open")
    )
    age = micros(now if now is not None else F.current_timestamp()) - micros("ts")
    state = (
        F.when(F.col("__s").isNotNull(), F.col("__s"))
        .when(age < 0, "waiting")
        .when(age > int(timeout * 1_000_000), "timed out")
        .when(F.coalesce("__broken", F.lit(False)), "blocked")
        .when(F.coalesce("__open", F.lit(False)), "waiting")
        .otherwise("ready")
    )
    return known.join(before, "job_id", "left").withColumn("state", state).drop("__s", "__broken", "__open")


def run_ready(jobs: DataFrame, handlers: dict[str, Callable[[Row], None]], now: Column | None = None, timeout: float = 5.0, rounds: int = 2) -> DataFrame:
    """Runs what is ready on the driver, a row at a time, and then what has become ready by that.
    Gives (job_id, state, error). What a handler raises makes its job fail and no other; jobs of a
    kind without a handler are done."""
    spark = jobs.sparkSession
    schema = "job_id " + jobs.schema["job_id"].dataType.simpleString() + ", state string, error string"
    found: list[tuple] = []
    for _ in range(rounds):
        ready = job_states(jobs, spark.createDataFrame(found, schema), now, timeout).where("state = 'ready'")
        some = False
        for row in ready.toLocalIterator():
            some = True
            try:
                if row.kind in handlers:
                    handlers[row.kind](row)
                found.append((row.job_id, "done", None))
            except Exception as e:  # told in the job's row
                found.append((row.job_id, "failed", str(e)))
        if not some:
            break
    return spark.createDataFrame(found, schema)
