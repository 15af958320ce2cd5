"""Time as whole microseconds."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970, for timestamps with or without a zone (those without count as
    being in the session's zone)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def stamp(df: DataFrame, stage: str, at: Column | None = None, column: str = "timing") -> DataFrame:
    """``df`` with (stage, at) put behind the stages that its rows have passed; now, if no time is
    given."""
    made = F.array(F.struct(F.lit(stage).alias("stage"), (at if at is not None else F.current_timestamp()).alias("at")))
    return df.withColumn(column, F.concat(column, made) if column in df.columns else made)


def stage_durations(timing: str | Column = "timing") -> Column:
    """(stage, us) for each stage but the first: microseconds since the stage before."""
    c = F.col(timing) if isinstance(timing, str) else timing
    since = lambda x, k: F.struct(x["stage"].alias("stage"), (micros(x["at"]) - micros(F.get(c, k)["at"])).alias("us"))
    return F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), since)


def profile(make: Callable[[], DataFrame], iterations: int = 3) -> dict[str, float]:
    """Seconds that it takes to make all rows, after one warm-up: least, mean, greatest, rows a second."""
    rows, took = make().count(), []
    for _ in range(iterations):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    mean = sum(took) / len(took)
    return {"min": min(took), "mean": mean, "max": max(took), "rows_per_second": rows / mean}
