"""Per-frame operators: filters, selection, crops and the joins between frames and crops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from viewfold.functions.geometry import area, box, iou
from viewfold.operators.suppress import nms
from viewfold.schema import BOX, by, require_columns

STRATEGIES: dict[str, Callable[[], Column]] = {"highest_score": lambda: F.col("score"), "largest_area": lambda: area(box())}


def class_filter(df: DataFrame, classes: list[str], tracked: bool = False) -> DataFrame:
    """Boxes of the given classes (an empty list: all), with a track where ``tracked``. A null
    label never passes a list."""
    out = df.where(F.col("x1").isNotNull())
    if classes:
        out = out.where(F.col("label").isin(*classes))
    return out.where(F.col("track_id").isNotNull()) if tracked else out


def skip_missing(df: DataFrame, results: str = "results") -> DataFrame:
    """Frames for which a model gave a result; an empty one is a result, null is none."""
    return df.where(F.col(results).isNotNull())


def latest(df: DataFrame, stream: str = "stream_id", order: str = "frame_id") -> DataFrame:
    """The last frame of each stream: what a lossy consumer sees of a batch."""
    rest = [c for c in df.columns if c != stream]
    return df.groupBy(stream).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(stream, "__r.*")


def exclude_classes(df: DataFrame, classes: list[str]) -> DataFrame:
    """Rows of other classes stay, with score 0, so that they are never tracked."""
    return df.withColumn("score", F.when(F.col("label").isin(*classes), F.col("score")).otherwise(F.lit(0.0)))


def by_names(df: DataFrame, names: list[str], column: str = "events") -> DataFrame:
    """Frames with one of the named events or notifications (an array or a map by name)."""
    c = F.map_keys(column) if df.schema[column].dataType.typeName() == "map" else F.col(column)
    return df.where(F.arrays_overlap(c, F.array(*map(F.lit, names))))


def select_best(df: DataFrame, top_k: int = 1, threshold: float = 0.0, strategy: str = "highest_score", metric: Column | None = None, stream: str | None = None) -> DataFrame:
    """Per frame: the ``top_k`` boxes of the greatest metric (ties by det_idx), or, for top_k 0,
    those with a metric over ``threshold``."""
    if top_k == 0 and threshold <= 0:
        raise ValueError("top_k 0 needs a positive threshold")
    if strategy not in (*STRATEGIES, "custom_metric") or (strategy == "custom_metric") != (metric is not None):
        raise ValueError("a metric is needed for, and only for, custom_metric")
    m = metric if metric is not None else STRATEGIES[strategy]()
    if top_k == 0:
        return df.where(m > threshold)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by(stream, "frame_id")).orderBy(m.desc(), "det_idx"))).where(F.col("rank") <= top_k)


def overlay_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("overlay", F.concat_ws(" ", F.col("label"), F.concat(F.lit("#"), F.col("track_id").cast("string"))))


def iou_pairs(df: DataFrame, least: float = 0.0, stream: str | None = None) -> DataFrame:
    """Pairs of boxes of a frame with an IoU over ``least``."""
    a, b = df.alias("a"), df.alias("b")
    v = iou(box("a."), box("b."))
    on = F.col("a.det_idx") < F.col("b.det_idx")
    for k in by(stream, "frame_id"):
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.join(b, on)
    return joined.select(*(F.col(f"a.{k}").alias(k) for k in by(stream, "frame_id")), F.col("a.det_idx").alias("i"), F.col("b.det_idx").alias("j"), v.alias("iou")).where(F.col("iou") > least)


def crop_fanout(frames: DataFrame, results: str = "results", keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row per box to crop, the last of a frame flagged; a frame without any gives one row with
    crop_index -1. ``keep`` is a predicate on the box struct."""
    wanted = F.filter(results, lambda r: r["x1"].isNotNull() & (keep(r) if keep else F.lit(True)))
    out = frames.select("frame_id", F.size(wanted).alias("__n"), F.posexplode_outer(wanted).alias("__p", "crop"))
    return out.select("frame_id", F.coalesce("__p", F.lit(-1)).alias("crop_index"), "crop", (F.coalesce("__p", F.lit(-1)) == F.col("__n") - 1).alias("is_last"))


def combine_crops(frames: DataFrame, *crops: DataFrame) -> DataFrame:
    """Frames with what each crop stream found at each box: left joins on the frame; frames without
    crops pass, and crop_index -1 attaches nothing. The n-th stream's are in ``extra_n``."""
    for n, c in enumerate(crops):
        require_columns(c, "frame_id", "crop_index")
        rest = [x for x in c.columns if x != "frame_id"]
        grouped = c.where("crop_index >= 0").groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(f"extra_{n}"))
        frames = frames.join(grouped, "frame_id", "left")
    return frames


def rebase(df: DataFrame, origin: tuple[Column, Column], landmarks: str | None = None) -> DataFrame:
    """Boxes (and landmarks) relative to a crop moved to the image."""
    ox, oy = origin
    moved = {n: F.col(n) + (ox if n[0] == "x" else oy) for n in BOX}
    if landmarks:
        moved[landmarks] = F.transform(landmarks, lambda p: F.struct((p["x"] + ox).alias("x"), (p["y"] + oy).alias("y"), p["score"].alias("score")))
    return df.withColumns(moved)


def combine_results(*streams: DataFrame, key: str = "frame_id", results: str = "results") -> DataFrame:
    """Frames that all streams have, with their results one after another; null ones are skipped."""
    out = streams[0].select(key, F.col(results).alias("__r0"))
    for n, s in enumerate(streams[1:], 1):
        out = out.join(s.select(key, F.col(results).alias(f"__r{n}")), key)
    return out.select(key, F.concat(*(F.coalesce(f"__r{n}", F.filter("__r0", lambda r: F.lit(False)), F.array().cast(streams[0].schema[results].dataType)) for n in range(len(streams)))).alias(results))


def union_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Detections of two models over the same frames."""
    return a.unionByName(b, allowMissingColumns=True)


def patch_classes(df: DataFrame, classified: DataFrame) -> DataFrame:
    """Label, score and category of each box overwritten by its classifier's first result where
    that isn't null. ``classified``: (frame_id, det_idx, rank, label, score, category_id)."""
    first = classified.where("rank = 0").select("frame_id", "det_idx", *(F.col(c).alias(f"__{c}") for c in ("label", "score", "category_id")))
    out = df.join(first, ["frame_id", "det_idx"], "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in ("label", "score", "category_id")}).drop("__label", "__score", "__category_id")


def detect_in_rois(rois: DataFrame, inner: DataFrame, add_rois: bool = False, nms_threshold: float | None = None, stream: str | None = None, **how) -> DataFrame:
    """Detections inside regions moved to the image, with the region's number; with ``add_rois``
    the regions come too. ``inner``: (frame_id, roi_index, label, score, x1, y1, x2, y2). With
    ``nms_threshold``, what overlapping regions found twice is suppressed over the whole frame, and
    inner rows need det_idx and category_id (``how``: options of ``nms``)."""
    keys = by(stream, "frame_id", "roi_index")
    r = rois.select(*keys, F.col("x1").alias("ox"), F.col("y1").alias("oy"))
    moved = rebase(inner.join(r, keys), (F.col("ox"), F.col("oy")))
    out = [*by(stream, "frame_id"), "label", "score", *BOX, F.col("roi_index").alias("crop_index")]
    if nms_threshold is not None:
        moved = nms(moved, nms_threshold, keep=["roi_index"], stream=stream, **how)
    moved = moved.select(*out)
    if not add_rois:
        return moved
    return rois.select(*by(stream, "frame_id"), "label", "score", *BOX, F.lit(None).cast("int").alias("crop_index")).unionByName(moved)
