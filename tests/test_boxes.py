import numpy as np
import pytest
from pyspark.sql import functions as F

from viewfold.functions import geometry as geo
from viewfold.operators import frames, suppress, tiles
from viewfold.operators.tiles import TileGrid

COLS = "frame_id long, det_idx long, label string, category_id int, score double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([(0, k, lab, 0, float(s), *map(float, b)) for k, (lab, s, b) in enumerate(rows)], COLS)


ROWS = [("a", 0.9, (0, 0, 10, 10)), ("a", 0.8, (1, 1, 11, 11)), ("a", 0.7, (0, 0, 12, 12)), ("b", 0.6, (0, 0, 10, 10)), ("a", 0.5, (50, 50, 60, 60))]


def kept(df):
    return sorted(r.det_idx for r in df.collect())


def test_nms_per_label_and_agnostic(spark):
    df = boxes(spark, ROWS)
    assert kept(suppress.nms(df, 0.3)) == [0, 3, 4]
    assert kept(suppress.nms(df, 0.3, class_agnostic=True)) == [0, 4]
    assert kept(suppress.nms(df, 1.5, use_iou=False)) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("policy", suppress.POLICIES[1:])
def test_nms_policies_keep_the_same_survivors(spark, policy):
    got = {r.det_idx: r for r in suppress.nms(boxes(spark, ROWS), 0.3, policy=policy).collect()}
    assert sorted(got) == [0, 3, 4]
    r = got[0]
    if policy == "largest_area":
        assert (r.x1, r.x2) == (0, 12)
    elif policy == "merge":
        assert (r.x1, r.y1, r.x2, r.y2) == (0, 0, 12, 12)
    else:
        assert r.x1 == pytest.approx(0.8 / 2.4)


def test_nms_survivors_overlap_little(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 80, (60, 2))
    rows = [("a", s, (*q, *(q + 20))) for q, s in zip(p, rng.uniform(0.1, 1, 60))]
    got = suppress.nms(boxes(spark, rows), 0.3)
    assert frames.iou_pairs(got, 0.3).count() == 0


def test_nms_rejects_policy(spark):
    with pytest.raises(ValueError):
        suppress.nms(boxes(spark, ROWS), policy="best")


def test_fusion_joins_four_corners(spark):
    rows = [("a", 0.9, (0, 0, 10, 10)), ("a", 0.8, (9, 0, 20, 10)), ("a", 0.7, (0, 9, 10, 20)), ("a", 0.6, (9, 9, 20, 20)), ("a", 0.05, (70, 70, 80, 80))]
    got = suppress.fuse_edges(boxes(spark, rows), 0.55, skip=0.1).collect()
    assert [(r.x1, r.y1, r.x2, r.y2, r.n) for r in got] == [(0, 0, 20, 20, 4)]
    assert got[0].score == pytest.approx(0.75)
    assert suppress.fuse_edges(boxes(spark, rows), 0.55, skip=0.1, destructive=False).count() == 2


def test_collinear_touching_segments_do_not_cross(spark):
    p = [tuple(map(F.lit, v)) for v in ((0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (4.0, 0.0), (1.0, -1.0), (1.0, 1.0))]
    r = spark.range(1).select(geo.segments_cross(*p[:4]).alias("a"), geo.segments_cross(p[0], p[1], p[4], p[5]).alias("b")).first()
    assert (r.a, r.b) == (False, True)


def test_polygon_edges_count_as_inside(spark):
    pts = [(0, 0), (5, 0), (5, 5), (11, 5), (10, 10), (-1, 5)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    got = [r.i for r in df.select(geo.in_polygon(F.col("x"), F.col("y"), [(0, 0), (10, 0), (10, 10), (0, 10)]).alias("i")).collect()]
    assert got == [True, True, True, False, True, False]


def test_clip_area():
    assert geo.clip_area([(0, 0), (10, 0), (10, 10), (0, 10)], (5, 5, 20, 20)) == 25
    assert geo.clip_area([(5, 0), (10, 5), (5, 10), (0, 5)], (0, 0, 10, 10)) == 50
    assert geo.clip_area([(5, 0), (10, 5), (5, 10), (0, 5)], (20, 20, 30, 30)) == 0


def test_tiles_cover_the_image(spark):
    for df in (tiles.fixed_size(spark, (640, 480), (1920, 1080), (10, 10)), tiles.fixed_ratio(spark, 1.5, (0, 3), (1920, 1080), (10, 10))):
        r = df.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
        assert r[0] == 0 and r[1] == 0 and abs(r[2] - 1920) < 2 and abs(r[3] - 1080) < 2


def test_tile_grid_shape_and_validation(spark):
    g = TileGrid(2, 2, 0.1, 1.0, (640, 480))
    for r in g.frame(spark).collect():
        assert abs((r.x2 - r.x1) - (r.y2 - r.y1)) <= 2
    with pytest.raises(ValueError):
        TileGrid(20, 1, 0.0, 1.0, (640, 480))
    with pytest.raises(ValueError):
        TileGrid(2, 2, whole=True, mask=(0,))


def test_select_best_validation(spark):
    with pytest.raises(ValueError):
        frames.select_best(boxes(spark, ROWS), 0, 0.0)
    with pytest.raises(ValueError):
        frames.select_best(boxes(spark, ROWS), 1, strategy="custom_metric")


def test_fanout_passes_empty_frames(spark):
    df = spark.createDataFrame([(1, [(0, 1.0)]), (2, [])], "frame_id long, results array<struct<det_idx:int,x1:double>>")
    got = sorted((r.frame_id, r.crop_index, r.is_last) for r in frames.crop_fanout(df).collect())
    assert got == [(1, 0, True), (2, -1, True)]
