import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewfold.operators import tracking
from viewfold.operators.tracking import StickySelector, Tracker

COLS = "stream_id long, frame_id long, det_idx long, label string, score double, x1 double, y1 double, x2 double, y2 double"


def test_assignment_is_cheapest():
    rnd = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 4), (4, 2), (4, 4), (5, 3)):
        for _ in range(20):
            c = rnd.random((n, m))
            got = tracking.assign(c)
            k = min(n, m)
            rows = range(n)
            best = min(sum(c[r, q] for r, q in zip(rs, cs)) for rs in itertools.combinations(rows, k) for cs in itertools.permutations(range(m), k))
            assert len(got) == k and sum(c[r, q] for r, q in got) == pytest.approx(best)


def path(start, speed, frames, score=0.9, size=40):
    return {f: (start[0] + speed[0] * k, start[1] + speed[1] * k, start[0] + speed[0] * k + size, start[1] + speed[1] * k + size, score) for k, f in enumerate(frames)}


def table(spark, paths, stream=0):
    rows = [(stream, f, k, "car", float(p[f][4]), *map(float, p[f][:4])) for k, p in enumerate(paths) for f in p]
    return spark.createDataFrame(rows, COLS)


def numbers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.det_idx, {})[r.frame_id] = r.track_id
    return out


def test_two_objects_keep_their_numbers(spark):
    df = table(spark, [path((0, 0), (3, 0), range(20)), path((200, 200), (-3, 1), range(20))])
    got = numbers(tracking.track_objects(df))
    assert {len(set(v.values())) for v in got.values()} == {1}
    assert set(got[0].values()) != set(got[1].values())


def test_boxes_are_filtered_but_close(spark):
    df = table(spark, [path((0, 0), (3, 2), range(20))])
    a = {r.frame_id: r for r in df.collect()}
    for r in tracking.track_objects(df).collect():
        assert abs(r.x1 - a[r.frame_id].x1) <= 0.12 * 40


def test_gap_is_bridged_and_long_gap_is_not(spark):
    short = path((0, 0), (1, 0), [*range(5), *range(8, 15)])
    long = path((300, 0), (0, 0), [*range(5), *range(60, 65)])
    got = numbers(tracking.track_objects(table(spark, [short, long]), buffer=10))
    assert len({v for v in got[0].values() if v}) == 1
    assert len({v for v in got[1].values() if v}) == 2


def test_late_object_needs_a_second_sighting(spark):
    got = numbers(tracking.track_objects(table(spark, [path((0, 0), (1, 0), range(6)), path((300, 0), (1, 0), range(3, 6))])))
    assert got[1][3] is None and got[1][4] is not None


def test_low_scores_continue_but_do_not_begin(spark):
    weak = path((0, 0), (1, 0), range(10))
    weak = {f: (*v[:4], 0.9 if f < 5 else 0.15) for f, v in weak.items()}
    never = path((300, 0), (1, 0), range(10), score=0.15)
    got = numbers(tracking.track_objects(table(spark, [weak, never])))
    assert len(set(got[0].values())) == 1 and set(got[1].values()) == {None}


def test_cut_ends_tracks_and_numbers_go_on(spark):
    df = table(spark, [path((0, 0), (1, 0), range(10))])
    cut = spark.createDataFrame([(0, 5)], "stream_id long, frame_id long")
    got = numbers(tracking.track_objects(df, cuts=cut))[0]
    assert got[4] == 1 and {v for f, v in got.items() if f > 5} == {2}


def test_streams_are_independent(spark):
    a = table(spark, [path((0, 0), (1, 0), range(5))], 1)
    b = table(spark, [path((0, 0), (1, 0), range(5))], 2)
    got = tracking.track_objects(a.unionByName(b)).groupBy("stream_id").agg(F.countDistinct("track_id").alias("n"), F.max("track_id").alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [(1, 1), (1, 1)]


def test_other_classes_are_never_tracked(spark):
    df = table(spark, [path((0, 0), (1, 0), range(5))])
    assert set(numbers(tracking.track_objects(df, classes=["bike"]))[0].values()) == {None}


def test_sticky_selector_keeps_its_choice():
    s = StickySelector(top_k=1, timeout=2)
    assert s.update([1, 2], np.array([0.9, 0.5])) == [0]
    assert s.update([1, 2], np.array([0.1, 0.9])) == [0]
    assert s.update([2], np.array([0.9])) == []
    assert s.update([2], np.array([0.9])) == []
    assert s.update([2], np.array([0.9])) == [0]


def test_tracker_survives_noise():
    rnd = random.Random(0)
    t = Tracker()
    for _ in range(50):
        n = rnd.randint(0, 6)
        b = np.array([[x := rnd.uniform(0, 500), y := rnd.uniform(0, 400), x + 30, y + 30] for _ in range(n)]).reshape(-1, 4)
        got = t.update(b, np.array([rnd.random() for _ in range(n)]))
        assert len({k for k, *_ in got}) == len(got) == len({m for _, m, _ in got})


def test_near_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(0)
    for k in range(60):
        n, m = rng.integers(0, 25, 2)
        a, b = (np.concatenate([x := rng.uniform(0, 50 * (1 + k % 4), (c, 2)), x + rng.uniform(10, 100, (c, 2))], axis=1) for c in (n, m))
        w, over = rng.uniform(0.3, 1, m), tracking.iou_matrix(a, b)
        i, j, o = tracking.overlapping(a, b)
        assert list(zip(i.tolist(), j.tolist())) == [tuple(x) for x in np.argwhere(over > 0).tolist()] and (o == over[i, j]).all()
        assert tracking.match_near(a, b, 0.8, w) == tracking.match(1 - over * w[None, :], 0.8)


def test_many_objects_take_no_table_of_all_pairs():
    k = np.arange(4000)
    corner = np.stack([k % 20 * 100.0, k // 20 * 150.0], axis=1)
    boxes, t = np.concatenate([corner, corner + [40, 60]], axis=1), Tracker()
    tracemalloc.start()
    for step in range(3):
        got = t.update(boxes + step, np.full(len(k), 0.9))
        assert [(r, n) for r, n, _ in got] == [(r, r + 1) for r in range(len(k))]
    assert tracemalloc.get_traced_memory()[1] < 100e6  # a matrix of all pairs has 128 MB
    tracemalloc.stop()


def test_selection_takes_no_stream_whole(spark):
    rnd = random.Random(2)
    rows = [(s, f, k, k, rnd.random()) for s in range(3) for f in range(12) for k in range(6) if rnd.random() < 0.6]
    df = spark.createDataFrame(rows, "stream_id long, frame_id long, det_idx long, track_id long, score double")
    want = []
    for s in range(3):
        chooser = StickySelector(2, 1)
        for f in range(12):
            here = sorted(r for r in rows if r[:2] == (s, f))
            want += [here[k] for k in chooser.update([r[3] for r in here], np.array([r[4] for r in here]))]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, "4")  # frames lie across batches
    try:
        got = tracking.select_sticky(df, F.col("score"), top_k=2, timeout=1)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set(size, was)


def test_doubles_are_found_in_cells(spark):
    rng = np.random.default_rng(5)
    at, size = rng.integers(0, 90, (160, 2)), rng.integers(4, 80, (160, 2))
    rows = [(k, 0, int(rng.integers(0, 9)), *map(float, (*at[k], *(at[k] + size[k])))) for k in range(160)]
    rows += [(k + 200, 0, int(rng.integers(0, 9)), *(v + float(rng.integers(0, 3)) for v in rows[k][3:])) for k in range(160)]
    df = spark.createDataFrame(rows, "track_id long, first long, last long, x1 double, y1 double, x2 double, y2 double")
    a, b = rows[::2], rows[1::2]
    over = tracking.iou_matrix(np.array([r[3:] for r in a]), np.array([r[3:] for r in b]))
    older = np.array([r[2] for r in a])[:, None] > np.array([r[2] for r in b])[None, :]
    tables = [spark.createDataFrame(x, df.schema) for x in (a, b)]
    for distance in (0.15, 0.4, 0.9):
        near = 1 - over < distance
        want = [sorted(r[0] for r, g in zip(x, gone) if not g) for x, gone in ((a, (near & ~older).any(axis=1)), (b, (near & older).any(axis=0)))]
        got = tracking.drop_double_tracks(*tables, distance=distance)
        assert any("__cx" in x._jdf.queryExecution().toString() for x in got)
        wrong = [{r.track_id for r in x.collect()} ^ {k for k in w} for x, w in zip(got, want)]
        assert wrong == [set(), set()]
