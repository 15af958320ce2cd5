import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewfold.functions import text
from viewfold.operators import catalog, evaluate, media
from viewfold.sources import tables as src

CATALOG = {"models": {"a": {"task": "detect", "hardware": ["gpu", "cpu"], "zoo_url": "z/a", "metadata": {"fps": 30}}, "b": {"task": "detect", "hardware": ["cpu"], "alias": "best", "metadata": {"fps": 10, "size": 5}}, "c": {"task": "pose", "hardware": "gpu"}}, "defaults": {"metadata": {"size": 1}}}


def names(df):
    return [r.model_name for r in df.orderBy("ord").collect()]


def test_catalog(spark):
    c = catalog.load(spark, CATALOG)
    assert names(catalog.models(c, task="detect")) == ["a", "b"]
    assert names(catalog.models(c, hardware="gpu")) == ["a", "c"]
    assert names(catalog.models(c, metadata={"size": 1})) == ["a", "c"]
    assert names(catalog.models(c, alias="best")) == ["b"]
    assert catalog.best(c, "fps").first().model_name == "a"
    assert catalog.best(c, "fps", largest=False).first().model_name == "b"
    assert [r.value for r in catalog.distinct_values(c, "hardware").collect()] == ["cpu", "gpu"]
    assert catalog.with_defaults(c, {"zoo_url": "d"}, {"zoo_url": "o"}).first().zoo_url == "o"
    for bad in ({}, {"models": {"x": {"task": "t"}}}):
        with pytest.raises(ValueError):
            catalog.load(spark, bad)


def test_model_spec():
    s = catalog.ModelSpec(model_url="https://h/zoo/net")
    assert (s.zoo_url, s.model_name) == ("https://h/zoo", "net")
    with pytest.raises(ValueError):
        catalog.ModelSpec(model_name="net")
    with pytest.raises(ValueError):
        catalog.ModelSpec(model_name="net", model_url="a/b")


def test_kmeans_finds_clusters(spark):
    rng = np.random.default_rng(42)
    centres = rng.normal(0, 10, (10, 10))
    rows = [(k * 15 + j, (centres[k] + rng.normal(0, 0.1, 10)).tolist()) for k in range(10) for j in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = catalog.kmeans_exemplars(df, 10).collect()
    assert len(got) == 10 and {r.vec_id // 15 for r in got} == set(range(10))
    assert catalog.kmeans_exemplars(df, 0).count() <= 6


def test_kmeans_moves_centroids_by_every_vector(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (400, 3)) + np.repeat([[0], [30]], 200, axis=0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<double>").repartition(5)
    for k, parts in ((1, [x]), (2, [x[:200], x[200:]])):
        got = sorted((r.vec_id, r.n, r.d2) for r in catalog.kmeans_exemplars(df, k, fit_rows=12).collect())
        d2 = [((x - p.mean(axis=0)) ** 2).sum(axis=1) for p in parts]
        want = [(int(d.argmin()), len(p), float(d.min())) for d, p in zip(d2, parts)]
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert catalog.kmeans_exemplars(df, 50, fit_rows=12).count() == 50
    assert catalog.kmeans_exemplars(df, fit_rows=12).count() == 16
    assert catalog.kmeans_exemplars(df.where("vec_id < 3"), 5).count() == 3 and catalog.kmeans_exemplars(df.limit(0)).count() == 0


def coco(spark, preds, truths):
    p = spark.createDataFrame([(i, 0, k, float(s), *map(float, b)) for k, (i, s, b) in enumerate(preds)], "image_id long, category_id int, det_idx long, score double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame([(i, 0, k, *map(float, b)) for k, (i, b) in enumerate(truths)], "image_id long, category_id int, truth_idx long, x1 double, y1 double, x2 double, y2 double")
    return {r.name: r.value for r in evaluate.coco_summary(p, t).collect()}


def test_map_by_hand(spark):
    whole = [(0, (0, 0, 100, 100)), (1, (0, 0, 50, 50))]
    got = coco(spark, [(0, 0.9, (0, 0, 100, 100)), (1, 0.8, (0, 0, 50, 50))], whole)
    assert got["AP"] == pytest.approx(1) and got["AR100"] == pytest.approx(1) and got["AP_small"] == -1
    half = coco(spark, [(0, 0.9, (0, 0, 100, 100)), (1, 0.95, (200, 200, 300, 300))], whole)
    assert half["AP50"] == pytest.approx(0.5 * 51 / 101)
    part = coco(spark, [(0, 0.9, (0, 0, 100, 72))], whole[:1])
    assert part["AP"] == pytest.approx(0.5) and part["AP50"] == 1 and part["AP75"] == 0


def test_doubles_count_once(spark):
    got = coco(spark, [(0, 0.9, (0, 0, 100, 100)), (0, 0.8, (0, 0, 100, 100))], [(0, (0, 0, 100, 100))])
    assert got["AP"] == pytest.approx(1) and got["AR1"] == pytest.approx(1)


def test_text_functions(spark):
    df = spark.createDataFrame([("fooBarHTTPServer 2", "a/b c*?.txt", (1, "x"))], "n string, f string, r struct<i:int,s:string>")
    r = df.select(text.snake_case(F.col("n")).alias("n"), text.clean_filename(F.col("f")).alias("f"), text.template("${r.s}-${{r.i}} ${nope} ${a+b}", {"r": F.col("r")}).alias("t"), text.clip_name(F.lit("c"), F.lit(-3)).alias("c"), text.media_kind(F.lit("x.JPG")).alias("k")).first()
    assert (r.n, r.f, r.t, r.c, r.k) == ("foo_bar_http_server_2", "a_b c_.txt", "x-1 ${nope} ${a+b}", "c_-0000003", "image")


def test_templates(spark):
    df = spark.createDataFrame([(2, 3, "bar", {"foo": 123}, [5, 6], None)], "a int, b int, foo string, data map<string,int>, xs array<int>, none int")
    fields = {c: F.col(c) for c in df.columns}
    for said, want in (
        ("Sum: ${a + b}, Product: ${a * b}", "Sum: 5, Product: 6"),
        ("Value: ${y}", "Value: ${y}"),
        ("Number: ${42}", "Number: 42"),
        ("Hello ${foo}, missing: ${baz}, math: ${1+2}", "Hello bar, missing: ${baz}, math: 3"),
        ('Nested: ${data["foo"]} ${xs[1]}', "Nested: 123 6"),
        ("Nested: ${${a}}, outer: ${x+${b}}", "Nested: ${2}, outer: ${x+3}"),
        ("${{a}} ${a / 4} ${-b // 2} ${-b % 2} ${a / 0} ${none}", "2 0.5 -2 1 ${a / 0} None"),
        ("${__import__('os')} ${a if b else 1} ${a.b.c()}", "${__import__('os')} ${a if b else 1} ${a.b.c()}"),
    ):
        assert df.select(text.template(said, fields).alias("t")).first().t == want


def test_names_as_specified(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.clean_filename(F.lit("cam (1) & x.mp4"))) == "cam (1) & x.mp4"
    assert one(text.clean_filename(F.lit('a:/b"é"<>.txt'))) == "a_b_.txt"
    for name, want in (("foo-Bar", "foo__bar"), ("my_File", "my__file"), ("Traffic Light (2)", "traffic__light__2_"), ("7Up", "_7_up"), ("HTTPServer2Go", "http_server2_go")):
        assert one(text.snake_case(F.lit(name))) == want
    assert one(text.clip_name(F.lit("out/"), F.lit(5))) == "out/00000005" and one(text.clip_name(F.lit("out"), F.lit(5))) == "out_00000005"
    rows = [(0, "a"), (1, "a"), (2, "a_1"), (3, "a"), (4, "b"), (5, "b"), (6, "c_1"), (7, None), (8, None)]
    got = text.unique_names(spark.createDataFrame(rows, "k long, name string"), "name", "k")
    assert [r.name for r in got.orderBy("k").limit(7).collect()] == ["a", "a_1", "a_1_1", "a_2", "b", "b_1", "c_1"]


def solid(spark, colours, w=32, h=24):
    rows = [(k, w, h, bytearray(np.tile(np.array(c, dtype=np.uint8), w * h).tobytes())) for k, c in enumerate(colours)]
    return spark.createDataFrame(rows, "frame_id long, width int, height int, rgb binary")


def test_change_scores(spark):
    df = solid(spark, [(10, 10, 10), (10, 10, 10), (110, 110, 110)])
    got = [round(r.score, 4) for r in media.change_scores(df).orderBy("n").collect()]
    assert got == [0.0, 0.0, round(100 / 3, 4)]
    assert [round(r.score, 4) for r in media.change_scores(df, luma_only=True).orderBy("n").collect()] == [0.0, 0.0, 100.0]
    with pytest.raises(ValueError):
        media.change_scores(df, limit=8)


def test_large_pictures_are_scaled_by_area(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, (2, 60, 80, 3)).astype(np.uint8)
    small = lambda x: media._small(x.tobytes(), 80, 60, 40).reshape(30, 40, 3)
    want = np.rint(a.reshape(30, 2, 40, 2, 3).astype(float).mean(axis=(1, 3)))
    assert np.abs(small(a) - want).max() <= 1
    df = spark.createDataFrame([(k, 80, 60, bytearray(x.tobytes())) for k, x in enumerate((a, b))], "frame_id long, width int, height int, rgb binary")
    got = [r.score for r in media.change_scores(df, luma_only=True, limit=40).orderBy("n").collect()]
    assert got[1] == pytest.approx(np.abs(media.luma(small(a).reshape(-1, 3)) - media.luma(small(b).reshape(-1, 3))).mean())
    assert media.to_hsv(np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [128, 128, 128], [0, 0, 0], [255, 0, 128]], dtype=np.uint8)).tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 128], [0, 0, 0], [165, 255, 255]]


def test_motion_and_masks(spark):
    a, b = np.zeros((24, 32, 3), dtype=np.uint8), np.zeros((24, 32, 3), dtype=np.uint8)
    b[8:16, 8:16] = 255
    df = spark.createDataFrame([(0, 32, 24, bytearray(a.tobytes())), (1, 32, 24, bytearray(b.tobytes()))], "frame_id long, width int, height int, rgb binary")
    px = media.motion_pixels(df).collect()
    assert {r.frame_id for r in px} == {1} and 64 <= len(px) <= 160
    m = spark.createDataFrame([(1, 0, 2, 2, bytearray([1, 1, 1, 1]))], "x int, y int, w int, h int, d binary")
    assert m.select(media.mask_rle(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("d"), 4, 3).alias("r")).first().r == [3, 2, 1, 2, 4]


def test_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "c"}]}))
    a = src.read_coco(spark, str(tmp_path / "t.json"))["annotations"].first()
    assert (a.x1, a.y1, a.x2, a.y2) == (1, 2, 4, 6)
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "x.jpg").write_bytes(b"12")
    assert src.read_images(spark, str(tmp_path), "*.jpg").first().class_name == "cat"
    wav = np.arange(10, dtype="<i2").tobytes()
    head = lambda more: b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + b"\0" * 16 + more + b"data\x14\0\0\0"
    files = [("f", bytearray(head(b"") + wav + b"LIST\0\0\0\0")), ("g", bytearray(head(b"LIST\3\0\0\0abc\0") + wav)), ("raw", bytearray(wav)), ("none", bytearray(b""))]
    df = spark.createDataFrame(files, "path string, content binary")
    for name in ("f", "g", "raw"):
        blocks = src.audio_blocks(df, 4).where(F.col("path") == name).orderBy("block_id").collect()
        assert [r.samples for r in blocks] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert src.audio_blocks(df, 4).where("path = 'none'").count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"images": [{"file_name": "a", "value": 1}]}))
    assert src.read_regression_truth(spark, str(tmp_path / "r.json")).first().value == 1.0
    assert src.frames_from(spark, ["a", "b"], "path string").count() == 2


def test_masks_and_points_as_similarity(spark):
    assert evaluate.rle_iou([0, 4, 4], [2, 4, 2]) == pytest.approx(2 / 6) and evaluate.rle_iou([8], [8]) == 0
    assert evaluate.rle_iou([0, 4, 4], [2, 4, 2], True) == pytest.approx(0.5)
    box = dict(image_id=1, category_id=1, x1=0.0, y1=0.0, x2=10.0, y2=10.0)
    pred = spark.createDataFrame([{**box, "det_idx": 0, "score": 0.9, "rle": [0, 50, 50], "keypoints": [1.0, 1.0, 2.0, 9.0, 9.0, 2.0]}])
    truth = spark.createDataFrame([{**box, "truth_idx": 0, "rle": [10, 50, 40], "keypoints": [1.0, 1.0, 2.0, 9.0, 8.0, 2.0]}])
    state = lambda kind, t, **how: evaluate.match_truth(pred, truth, (t,), kind=kind, **how).first().state
    assert (state("segm", 0.6), state("segm", 0.7)) == (1, 0)  # 40 of 60
    like = (1 + np.exp(-1 / 0.04 / 100 / 2)) / 2
    assert (state("keypoints", like - 1e-6, sigmas=(0.1, 0.1)), state("keypoints", like + 1e-6, sigmas=(0.1, 0.1))) == (1, 0)
    with pytest.raises(ValueError):
        evaluate.match_truth(pred, truth, kind="other")


def test_curves_at_once_are_those_row_by_row(spark):
    rng = np.random.default_rng(3)
    def box():
        x = rng.integers(0, 60, 2)
        return [float(v) for v in (*x, *(x + rng.integers(20, 130, 2)))]

    rows = [(int(rng.integers(0, 25)), int(rng.integers(0, 3)), k, float(rng.integers(0, 9)) / 10, *box()) for k in range(400)]
    p = spark.createDataFrame(rows, "image_id long, category_id int, det_idx long, score double, x1 double, y1 double, x2 double, y2 double")
    t = p.where("det_idx % 3 = 0 and category_id < 2").withColumnRenamed("det_idx", "truth_idx").drop("score")
    n, limits = evaluate.positives_of(t, evaluate.AREAS), (1, 10, 100)
    want = evaluate.average_precision(evaluate.precision_recall(evaluate.match_truth(p, t, areas=evaluate.AREAS), n), n, limits=limits)
    packed = evaluate._matches(p, t, evaluate.IOU_THRESHOLDS, evaluate.AREAS, 100, "bbox", evaluate.SIGMAS, "hit long, miss long", lambda h, m, _: (h, m))
    got, kept = evaluate._curves(packed, n, [*evaluate.AREAS], evaluate.IOU_THRESHOLDS, limits)
    rows = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 60
    kept.unpersist()
