"""Streams side by side, model nodes, sinks, object stores, jobs and profiles."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewfold.functions import signal
from viewfold.functions.times import profile, stage_durations, stamp
from viewfold.operators import frames, lines, models, rules, tracking, zones
from viewfold.plans.graph import EvaluatorConfig, predict_stream
from viewfold.sources import sinks
from viewfold.sources import tables as src
from viewfold.streaming import jobs

ZONE = {"z": [(100, 100), (400, 100), (400, 400), (100, 400)]}


def run_all(t, f, stream=None):
    """Rows of zones, lines, rules and signals, as sets, for tracks and frames of one or more streams."""
    own = [stream] if stream else []
    states = zones.hysteresis(zones.mark(t, ZONE), 2, stream)
    hits = lines.crossings(lines.trails(t, stream=stream), src.LINES, whole_trail=False, stream=stream)
    counts = lines.running_counts(hits, f, 3, stream=stream)
    metric = rules.object_count(f, t, None, 0.1, key=stream)
    rule = rules.parse_rule({"Trigger": "r", "when": "ObjectCount", "is greater than": 0, "during": [3, "frames"], "for at least": [2, "frames"]})
    fired = rules.fire(rule, metric, stream)
    events = rules.events_by_frame({"r": fired}, stream).join(f, [*own, "frame_id"])
    said = rules.notify(events, "n", "r", holdoff=2, key=stream).where("fired")
    out = {
        "occupancy": zones.occupancy(states, f, ZONE, stream).select(*own, "zone_index", "frame_id", "total"),
        "events": zones.zone_events(states, f, ZONE, stream),
        "times": zones.with_times(states, f, stream).select(*own, "track_id", "frame_id", "time_in_zone"),
        "lines": counts,
        "repeated": lines.repeated_crossings(lines.trails(t, stream=stream), f, src.LINES, stream=stream).drop("ts"),
        "flags": lines.flag_objects(t, hits, 3, stream).select(*own, "frame_id", "track_id", F.col("cross_line").cast("string")),
        "best": frames.select_best(t.withColumn("det_idx", F.col("track_id")), 1, stream=stream).select(*own, "frame_id", "track_id"),
        "fired": fired.select(*own, "frame_id", "fired"),
        "said": said.select(*own, "frame_id"),
        "fps": signal.stabilise_fps(f, 2_000_000_000, stream),
        "thin": src.thin_to_fps(f, 30, 20, stream).select(*own, "frame_id", "out_id"),
    }
    return {k: sorted((tuple(r[c] for c in df.columns if c != "stream_id") for r in df.collect()), key=str) for k, df in out.items()}


def test_two_streams_in_a_table_equal_two_tables(spark, sf):
    t = src.tracks(spark, sf).withColumn("stream_id", F.col("track_id") % 2).withColumn("track_id", (F.col("track_id") / 2).cast("long"))
    f = src.frames_of(t, 2)
    both = run_all(t, f, "stream_id")
    each = [run_all(t.where(F.col("stream_id") == k).drop("stream_id"), f.where(F.col("stream_id") == k).drop("stream_id")) for k in (0, 1)]
    for name, rows in both.items():
        assert rows == sorted(each[0][name] + each[1][name], key=str), name
        assert rows, name


def test_models_see_batches_and_may_answer_late(spark):
    df = spark.range(0, 1000, 1, 2)
    seen = models.predict(df, lambda parts: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in parts), "n long", batch_rows=64).collect()
    assert sum(r.n for r in seen) == 1000 and max(r.n for r in seen) == 64

    def scale(k, parts):
        held = [*parts]
        for b in held:
            yield pa.RecordBatch.from_arrays([pa.array([k * v for v in b.column("id").to_pylist()], pa.int64())], ["x"])

    assert models.predict(df, scale, "x long", ["id"], load=lambda: 3).agg(F.sum("x")).first()[0] == 3 * 499_500
    assert models.predict(df.limit(0), scale, "x long", ["id"], load=lambda: 3).count() == 0
    none = models.predict_rows(df.withColumn("y", F.lit(None).cast("long")), lambda c: {"z": c["y"]}, "z long", ["y"])
    assert none.columns == ["id", "y", "z"] and none.where("z is not null").count() == 0


def test_predict_stream_is_source_model_analyzers(spark):
    df = spark.range(10).withColumnRenamed("id", "frame_id")
    got = predict_stream(df, lambda d: models.predict_rows(d, lambda c: {"score": c["frame_id"]}, "score long", ["frame_id"]), [lambda d: d.where("score >= 7"), None])
    assert [r.frame_id for r in sinks.iterate(got)] == [7, 8, 9]


def test_frames_are_written_by_stream(spark, tmp_path):
    df = spark.range(600).select((F.col("id") % 3).alias("stream_id"), F.col("id").alias("frame_id"))
    sinks.write_frames(df, str(tmp_path / "out"), rows_per_file=50)
    sinks.write_frames(df.where("frame_id < 3"), str(tmp_path / "out"))
    back = sinks.read_stream(spark, str(tmp_path / "out"), [1])
    assert back.count() == 201 and {r.stream_id for r in back.select("stream_id").distinct().collect()} == {1}
    files = list((tmp_path / "out" / "stream_id=1").glob("*.parquet"))
    assert len(files) >= 4 and "PartitionFilters: [isnotnull(stream_id" in back._jdf.queryExecution().explainString(back._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_object_store(spark, tmp_path):
    s = sinks.ObjectStore(spark, f"file://{tmp_path}/bucket")
    assert not s.exists()
    s.ensure()
    (tmp_path / "a.txt").write_text("hello")
    assert s.upload(str(tmp_path / "a.txt"), "x/a.txt").endswith("bucket/x/a.txt")
    assert s.exists("x/a.txt") and s.stat("x/a.txt")["size"] == 5 and s.stat("x")["folder"]
    assert [(r.name, r.size) for r in s.list(recursive=True).collect()] == [("a.txt", 5)]
    s.download("x/a.txt", str(tmp_path / "b.txt"))
    assert (tmp_path / "b.txt").read_text() == "hello"
    assert s.delete("x/a.txt") and not s.delete("x/a.txt") and not s.exists("x/a.txt")


def test_jobs_wait_run_and_time_out(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    rows = [(1, "upload", 2), (2, "notify", None), (3, "upload", 4), (4, "notify", None), (5, "reference", None)]
    js = spark.createDataFrame(rows, "job_id long, kind string, dependent long").withColumn("ts", F.expr(at))
    now = F.expr(at + " + interval 1 second")
    states = lambda done, when=now: {r.job_id: r.state for r in jobs.job_states(js, spark.createDataFrame(done, "job_id long, state string"), when).collect()}
    assert states([]) == {1: "ready", 2: "waiting", 3: "ready", 4: "waiting", 5: "ready"}
    assert states([(1, "done"), (3, "failed")]) == {1: "done", 2: "ready", 3: "failed", 4: "blocked", 5: "ready"}
    assert states([(1, "done")], F.expr(at + " + interval 1 minute"))[2] == "timed out"
    sent = []

    def upload(row):
        if row.job_id == 3:
            raise OSError("no room")

    got = {r.job_id: (r.state, r.error) for r in jobs.run_ready(js, {"upload": upload, "notify": lambda r: sent.append(r.job_id)}, now).collect()}
    assert got == {1: ("done", None), 2: ("done", None), 3: ("failed", "no room"), 5: ("done", None)} and sent == [2]


def test_stages_and_profiles(spark):
    df = spark.range(3)
    for k, name in enumerate("abc"):
        df = stamp(df, name, F.timestamp_micros(F.lit(k * k)))
    assert [(x.stage, x.us) for x in df.select(stage_durations().alias("d")).first().d] == [("b", 1), ("c", 3)]
    assert spark.range(1).select(stage_durations(F.array().cast("array<struct<stage:string,at:timestamp>>")).alias("d")).first().d == []
    p = profile(lambda: spark.range(100), 2)
    assert p["min"] <= p["mean"] <= p["max"] and p["rows_per_second"] > 0


def test_evaluator_config():
    c = EvaluatorConfig.load("{kind: keypoints, max_images: 5, sigmas: [0.1, 0.2], classes: {a: 1}}", max_images=7)
    assert (c.kind, c.max_images, c.sigmas, c.classes) == ("keypoints", 7, (0.1, 0.2), {"a": 1})
    for bad in ("{kind: other}", "{nothing: 1}", "{max_images: -1}"):
        with pytest.raises(ValueError):
            EvaluatorConfig.load(bad)


def test_crops_of_rois_are_suppressed_together(spark):
    rois = spark.createDataFrame([(1, 0, "r", 1.0, 0.0, 0.0, 50.0, 50.0), (1, 1, "r", 1.0, 10.0, 0.0, 60.0, 50.0)], "frame_id long, roi_index int, label string, score double, x1 double, y1 double, x2 double, y2 double")
    inner = spark.createDataFrame([(1, 0, 0, 0, "a", 0.9, 20.0, 20.0, 40.0, 40.0), (1, 1, 1, 0, "a", 0.8, 10.0, 20.0, 30.0, 40.0), (1, 1, 2, 0, "b", 0.7, 10.0, 20.0, 30.0, 40.0)], "frame_id long, roi_index int, det_idx long, category_id int, label string, score double, x1 double, y1 double, x2 double, y2 double")
    assert frames.detect_in_rois(rois, inner).count() == 3
    got = frames.detect_in_rois(rois, inner, nms_threshold=0.5).collect()
    assert sorted((r.label, r.score, r.crop_index) for r in got) == [("a", 0.9, 0), ("b", 0.7, 1)]
    assert frames.detect_in_rois(rois, inner, nms_threshold=0.5, class_agnostic=True).count() == 1


def test_track_sets_with_equal_ages(spark):
    schema = "track_id long, first long, last long, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 10.0, 10.0), (2, 0, 9, 50.0, 50.0, 60.0, 60.0)], schema)
    b = spark.createDataFrame([(3, 2, 7, 0.0, 0.0, 10.0, 10.5), (4, 0, 3, 50.0, 50.0, 60.0, 60.0), (1, 0, 1, 90.0, 90.0, 95.0, 95.0)], schema)
    left = [sorted(r.track_id for r in x.collect()) for x in tracking.drop_double_tracks(a, b)]
    assert left == [[2], [1, 3]]
    assert sorted(r.track_id for r in tracking.union_tracks(a, b).collect()) == [1, 2, 3, 4]
    assert [r.last for r in tracking.union_tracks(a, b).where("track_id = 1").collect()] == [5]


def test_clip_json_has_known_properties_only(spark):
    from viewfold.functions.text import clip_json

    row = spark.range(1).select(clip_json({"start_frame": F.lit(-2), "triggered_by": F.array(F.lit("e"))}, F.array(F.struct(F.lit(1).alias("n")))).alias("j")).first()
    assert json.loads(row.j) == {"properties": {"start_frame": -2, "triggered_by": ["e"]}, "results": [{"n": 1}]}
    with pytest.raises(ValueError):
        clip_json({"other": F.lit(1)}, F.array())


def test_a_table_of_part_files_is_one_object(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"12")
    for name in ("b.parquet/part-0.parquet", "b.parquet/part-1.parquet", "other/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    (tmp_path / "b.parquet/_SUCCESS").write_bytes(b"")
    assert sorted((r.name, r.size) for r in sinks.list_objects(spark, str(tmp_path), "*.parquet").collect()) == [("a.parquet", 2), ("b.parquet", 6)]
    assert sinks.list_objects(spark, str(tmp_path), "*.csv").count() == 0
