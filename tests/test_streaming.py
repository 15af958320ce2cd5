"""Streaming operators give what the batch ones give, however the input is cut into files."""

import pytest
from pyspark.sql import functions as F

from viewfold.operators import tracking, zones
from viewfold.plans.graph import Node, Pipeline, chain, load_pipeline
from viewfold.sources import tables as src
from viewfold.streaming import processors


def files(df, path, parts):
    """Files of consecutive frames, oldest first."""
    import time

    n = df.agg(F.max("frame_id")).first()[0] + 1
    for k in range(parts):
        df.where((F.col("frame_id") >= n * k // parts) & (F.col("frame_id") < n * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their time


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.mark.parametrize("parts", [1, 3])
def test_tracking_stream_equals_batch(spark, sf, tmp_path, parts):
    t = src.tracks(spark, sf).withColumn("stream_id", F.col("track_id") % 2).withColumnRenamed("track_id", "det_idx").select("stream_id", "frame_id", "det_idx", "score", "x1", "y1", "x2", "y2")
    path = str(tmp_path / "in")
    files(t, path, parts)
    stream = src.stream_frames(spark, path, t.schema, 1)
    got = drain(processors.track_stream(stream), f"tracks{parts}", tmp_path)
    key = ["stream_id", "frame_id", "det_idx", "track_id", F.round("x1", 6)]
    assert sorted(map(tuple, got.select(*key).collect()), key=str) == sorted(map(tuple, tracking.track_objects(t).select(*key).collect()), key=str)


def test_hysteresis_stream_equals_batch(spark, sf, tmp_path):
    m = zones.mark(src.tracks(spark, sf), src.ZONES).select("zone_index", "zone_id", "track_id", "frame_id", "hit")
    path = str(tmp_path / "in")
    files(m, path, 2)
    got = drain(processors.hysteresis_stream(src.stream_frames(spark, path, m.schema, 1), 2), "hyst", tmp_path)
    key = ["zone_index", "track_id", "frame_id", "counter", "since", "left_at"]
    assert sorted(map(tuple, got.select(*key).collect()), key=str) == sorted(map(tuple, zones.hysteresis(m, 2).select(*key).collect()), key=str)


def test_selector_stream_equals_batch(spark, sf, tmp_path):
    t = src.tracks(spark, sf).withColumns({"stream_id": F.lit(0), "det_idx": F.col("track_id")}).select("stream_id", "frame_id", "det_idx", "track_id", "score")
    path = str(tmp_path / "in")
    files(t, path, 2)
    got = drain(processors.select_stream(src.stream_frames(spark, path, t.schema, 1), top_k=2, timeout=3), "sel", tmp_path)
    want = tracking.select_sticky(t, F.col("score"), top_k=2, timeout=3)
    key = ["frame_id", "track_id"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_outbox_writes_each_job_once(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("n", "hello", 3), ("n", "again", 9)], "name string, message string, frame_id long").write.parquet(path)
    s = spark.readStream.schema("name string, message string, frame_id long").parquet(path)
    seen = []
    q = processors.write_outbox(s, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: seen.append(df.count()), availableNow=True)
    q.awaitTermination(60)
    assert seen == [2]
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r.job_id for r in rows}) == 2 and {r.state for r in rows} == {"pending"}


def nodes(spark):
    a = Node(lambda: spark.range(5), "a", tags=["video"])
    b = Node(lambda d: d.where("id > 1"), "b", needs=["id"], requires=["video"])
    return a, b


def test_graph_builds_and_checks(spark):
    a, b = nodes(spark)
    a >> b
    assert Pipeline(b).run().count() == 3
    c = Node(lambda x, y: x.unionByName(y), "c")
    a >> c[0]
    b >> c[1]
    assert Pipeline(c).run().count() == 8
    lone = Node(lambda d: d, "lone", requires=["boxes"])
    a >> lone
    with pytest.raises(ValueError):
        Pipeline(lone).build()
    with pytest.raises(ValueError):
        b.connect_to(a, 0)
    wrong = Node(lambda d: d, "wrong", needs=["score"])
    a >> wrong
    with pytest.raises(ValueError):
        Pipeline(wrong).build()
    assert (a >> None) is a


def test_graph_from_yaml(spark):
    kinds = {"source": lambda n: Node(lambda: spark.range(n)), "limit": lambda least: Node(lambda d: d.where(F.col("id") >= least))}
    text = """
vars: {n: 10}
nodes:
  src: {source: {n: $(n)}}
  cut: {limit: {least: 4}}
connections: [[src, cut]]
"""
    assert load_pipeline(text, kinds).run().count() == 6
    assert load_pipeline(text, kinds, {"n": 5}).run().count() == 1
    for bad in (text.replace("source:", "other:"), text.replace("[src, cut]", "[src, gone]"), text.replace("$(n)", "$(m)")):
        with pytest.raises(ValueError):
            load_pipeline(bad, kinds)


def test_chain_skips_none(spark):
    assert chain(spark.range(4), None, lambda d: d.where("id > 0")).count() == 3
