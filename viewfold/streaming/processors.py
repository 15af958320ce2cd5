"""Operators on unbounded input: keyed state with event time, and outbox sinks.

Each stateful function keeps the same state object as the batch operator, pickled per key, and
handles rows of a micro-batch in order of frame. Frames of a key have to come in order across
batches (as files of a stream do); a frame at or before the last one handled is late and dropped.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from viewfold.operators.tracking import StickySelector, Tracker
from viewfold.operators.zones import step
from viewfold.schema import BOX


def _stateful(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """``f(state, rows in order) -> (state, rows out)`` per key, state None at first."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        now = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        now, out = f(now, rows)
        state.update((pickle.dumps(now),))
        yield out

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def track_stream(df: DataFrame, stream: str = "stream_id", **settings) -> DataFrame:
    """``track_objects`` for a streaming DataFrame. Rows: (stream, frame_id, det_idx, score, box)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", track_id long"

    def run(now, rows):
        tracker, last = now or (Tracker(**settings), None)
        rows = rows.sort_values(["frame_id", "det_idx"], kind="stable")
        if last is not None:
            rows = rows[rows["frame_id"] > last]
        rows = rows.reset_index(drop=True)
        numbers, places = np.full(len(rows), -1), rows[list(BOX)].to_numpy(dtype=float).copy()
        for frame, at in rows.groupby("frame_id", sort=True).indices.items():
            if last is not None:
                for _ in range(min(int(frame - last) - 1, tracker.buffer + 2)):
                    tracker.update(np.zeros((0, 4)), np.zeros(0))
            for k, n, place in tracker.update(places[at], rows["score"].to_numpy()[at]):
                numbers[at[k]] = n
                places[at[k]] = place
            last = int(frame)
        rows[list(BOX)] = places
        rows["track_id"] = [None if n < 0 else int(n) for n in numbers]
        rows["track_id"] = rows["track_id"].astype("Int64")
        return (tracker, last), rows

    return _stateful(df, [stream], run, schema)


def hysteresis_stream(marked: DataFrame, timeout: int = 0) -> DataFrame:
    """Zone hysteresis for a streaming DataFrame: a row per sighting with counter, since, left_at
    and left_since, as in the batch operator."""
    schema = "zone_index int, track_id long, frame_id long, hit boolean, counter int, since long, left_at long, left_since long"

    def run(state, rows):
        import pandas as pd

        state = state or (-1, 0, None, None)
        out = []
        for r in rows.sort_values("frame_id", kind="stable").itertuples():
            if r.frame_id <= state[0]:
                continue
            state, ended, was = step(state, int(r.frame_id), bool(r.hit), timeout + 1)
            out.append((int(r.zone_index), int(r.track_id), int(r.frame_id), bool(r.hit), state[1], state[2], ended, was))
        names = ["zone_index", "track_id", "frame_id", "hit", "counter", "since", "left_at", "left_since"]
        made = pd.DataFrame(out, columns=names)
        return state, made.astype({c: "Int64" for c in ("since", "left_at", "left_since")})

    return _stateful(marked, ["zone_index", "track_id"], run, schema)


def select_stream(df: DataFrame, metric: str = "score", stream: str = "stream_id", top_k: int = 1, timeout: int = 30) -> DataFrame:
    """The sticky selector for a streaming DataFrame."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(now, rows):
        selector, last = now or (StickySelector(top_k, timeout), None)
        rows = rows.sort_values(["frame_id", "det_idx"], kind="stable").reset_index(drop=True)
        keep = []
        for frame, at in rows.groupby("frame_id", sort=True).indices.items():
            if last is not None and frame <= last:
                continue
            if last is not None:
                for _ in range(min(int(frame - last) - 1, timeout + 1)):
                    selector.update([], np.zeros(0))
            numbers = [None if v is None or v != v else int(v) for v in rows["track_id"].to_numpy(dtype=object, na_value=None)[at]]
            keep += [at[k] for k in selector.update(numbers, rows[metric].to_numpy()[at])]
            last = int(frame)
        return (selector, last), rows.iloc[keep]

    return _stateful(df, [stream], run, schema)


def join_crops_stream(frames: DataFrame, crops: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Frames with their crops' results as both come in, within ``delay`` of event time: a
    stream-stream left join by frame with watermarks, so state is bounded and late rows go."""
    f = frames.withWatermark("ts", delay).alias("f")
    c = crops.withWatermark("ts", delay).alias("c")
    on = (F.col("f.frame_id") == F.col("c.frame_id")) & (F.col("f.ts") == F.col("c.ts"))
    return f.join(c, on, "left").select("f.*", "c.crop_index", "c.label", "c.score")


def write_outbox(df: DataFrame, path: str, checkpoint: str, deliver=None, **trigger):
    """Notifications to an outbox: each row of (name, message, frame_id) once per batch with a job
    id made from it, so that a repeated batch overwrites its own rows. ``deliver`` is called on
    the driver with each batch's DataFrame after it has been written."""

    def batch(rows: DataFrame, number: int) -> None:
        jobs = rows.withColumn("job_id", F.sha2(F.concat_ws("|", "name", "frame_id", "message"), 256)).withColumn("state", F.lit("pending"))
        jobs.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if deliver:
            deliver(rows.sparkSession.read.parquet(f"{path}/batch={number}"))

    w = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()
