"""Filters and rate logic over ordered series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from viewfold.functions.times import micros


def lowpass_taps(cutoff: float, taps: int) -> list[float]:
    """Windowed-sinc taps for a cutoff as a share of half the rate, under a four-term
    Blackman-Harris window, with unit gain at rest."""
    if not 0 < cutoff < 1 or taps < 1:
        raise ValueError("a cutoff in (0, 1) and at least one tap are needed")
    terms = (0.35875, 0.48829, 0.14128, 0.01168)
    out = []
    for k in range(taps):
        m = k - (taps - 1) / 2
        sinc = cutoff if m == 0 else math.sin(math.pi * cutoff * m) / (math.pi * m)
        angle = 2 * math.pi * k / (taps - 1) if taps > 1 else math.pi
        out.append(sinc * sum((-1) ** j * a * math.cos(j * angle) for j, a in enumerate(terms)))
    total = sum(out)
    return [v / total for v in out]


def _over(key: str | None, order: str):
    return (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy(order)


def fir(df: DataFrame, value: str, taps: list[float], order: str = "n", key: str | None = None) -> DataFrame:
    """``filtered``: the taps over the latest samples; before the first sample the series counts
    as equal to it."""
    over = _over(key, order)
    first = F.first(value).over(over.rowsBetween(W.unboundedPreceding, 0))
    n = len(taps)
    terms: list[Column] = [F.coalesce(F.lag(value, n - 1 - k).over(over), first) * t for k, t in enumerate(taps)]
    return df.withColumn("filtered", reduce(lambda a, b: a + b, terms))


def fold_series(df: DataFrame, value: Column, start: Column, step, order: str, key: str | None = None, finish=None) -> DataFrame:
    """Fold over a key's values in order, in Catalyst."""
    rows = df.groupBy(*([key] if key else [])).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("__s"))
    out = F.aggregate("__s", start, lambda a, x: step(a, x["v"]), finish) if finish else F.aggregate("__s", start, lambda a, x: step(a, x["v"]))
    return rows.select(*([key] if key else []), out.alias("state"))


def fps_meter(df: DataFrame, ts: Column, order: str = "n", key: str | None = None, longest: int = 100) -> DataFrame:
    """Capped running mean of the time between records, in whole microseconds, rounded down at
    each step: (records, mean_us, fps)."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("n"))

    def step(a, v):
        n = F.least(a["n"] + 1, F.lit(longest))
        mean = F.floor((a["d"] * (n - 1) + (v - a["last"])) / n)
        return F.when(a["last"] < 0, F.struct(v.alias("last"), a["d"].alias("d"), a["n"].alias("n"))).otherwise(F.struct(v.alias("last"), mean.alias("d"), n.cast("long").alias("n")))

    out = fold_series(df, ts, start, step, order, key)
    d = F.col("state.d")
    return out.select(*([key] if key else []), F.col("state.n").alias("records"), d.alias("mean_us"), F.try_divide(F.lit(1e6), d).alias("fps"))


def watchdog(df: DataFrame, ts: Column, order: str = "n", key: str | None = None, smoothing: float = 0.9, now_us: Column | None = None, limit_us: int = 1_000_000, least_rate: float = 1.0) -> DataFrame:
    """Smoothed time between ticks (the newest weighs 1 - smoothing), the rate, and whether the
    last tick is recent enough and the rate high enough."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(-1.0).alias("d"))

    def step(a, v):
        gap = (v - a["last"]).cast("double")
        d = F.when(a["last"] < 0, F.lit(-1.0)).when(a["d"] < 0, gap).otherwise(a["d"] * smoothing + gap * (1 - smoothing))
        return F.struct(v.alias("last"), d.alias("d"))

    out = fold_series(df, ts, start, step, order, key)
    rate = F.when(F.col("state.d") > 0, 1e6 / F.col("state.d"))
    age = (now_us if now_us is not None else micros(F.current_timestamp())) - F.col("state.last")
    return out.select(*([key] if key else []), F.col("state.d").alias("gap_us"), rate.alias("rate"), ((age <= limit_us) & (F.coalesce(rate, F.lit(0.0)) >= least_rate)).alias("ok"))


def throttle(df: DataFrame, us: Column, fps: float, order: str = "n", key: str | None = None) -> DataFrame:
    """Records let through at no more than ``fps``: one passes when 1/fps has gone by, and the
    time over that is carried on to the next. The first passes. A fold over each key."""
    gap = int(1_000_000 / fps)
    start = F.struct(F.lit(-1).cast("long").alias("base"), F.expr("array_repeat(0L, 0)").alias("kept"))

    def step(a, v):
        first, due = a["base"] < 0, v["us"] - a["base"] >= gap
        base = F.when(first, v["us"]).when(due, v["us"] - (v["us"] - a["base"]) % gap).otherwise(a["base"])
        return F.struct(base.alias("base"), F.when(first | due, F.array_append(a["kept"], v["o"])).otherwise(a["kept"]).alias("kept"))

    value = F.struct(us.alias("us"), F.col(order).cast("long").alias("o"))
    out = fold_series(df, value, start, step, order, key, lambda a: a["kept"])
    return out.select(*([key] if key else []), F.explode("state").alias(order))


def stabilise_fps(frames: DataFrame, interval_us: int, key: str | None = None) -> DataFrame:
    """Fills gaps: when two intervals pass without a frame the last one is repeated once per
    interval, until the next frame comes, darkened by max(0.3, e^(-0.1 k)) after k repeats before, so
    that the first repeat is as bright as the frame. Frames are numbered anew. (source_frame,
    repeat, brightness, out_id)"""
    over = _over(key, "frame_id")
    us = micros("ts")
    gap = F.lead(us).over(over) - us
    n = F.greatest(F.floor(gap / interval_us) - 1, F.lit(0))
    rows = frames.withColumn("__n", F.coalesce(n, F.lit(0))).select(*([key] if key else []), F.col("frame_id").alias("source_frame"), F.explode(F.sequence(F.lit(0), F.col("__n").cast("int"))).alias("repeat"))
    bright = F.greatest(F.lit(0.3), F.exp(F.greatest(F.col("repeat") - 1, F.lit(0)) * -0.1))
    order = (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy("source_frame", "repeat")
    return rows.withColumn("brightness", bright).withColumn("out_id", F.row_number().over(order).cast("long") - 1)
