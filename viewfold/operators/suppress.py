"""Non-maximum suppression and fusion of overlapping boxes, as Catalyst folds over the boxes of a
frame in order of score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewfold.schema import BOX, by, require_columns

POLICIES = ("most_probable", "largest_area", "average", "merge")
OWN = ("det_idx", *BOX, "score", "label", "category_id")


def sorted_boxes(df: DataFrame, keys: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per group with its boxes by score from the highest; ties by det_idx, then place."""
    item = F.struct((-F.col("score")).alias("k"), *OWN, *keep)
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("boxes"))


def _sides(a: Column, b: Column, pixel: float = 0.0) -> tuple[Column, Column]:
    """Width and height of two boxes' intersection."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + pixel)
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + pixel)
    return w, h


def _size(v: Column, pixel: float = 0.0) -> Column:
    return (v["x2"] - v["x1"] + pixel) * (v["y2"] - v["y1"] + pixel)


def _overlap(a: Column, b: Column, use_iou: bool, pixel: float) -> Column:
    """Overlap of two box structs; ``pixel`` is added to every extent."""
    w, h = _sides(a, b, pixel)
    i = w * h
    return F.try_divide(i, _size(a, pixel) + _size(b, pixel) - i if use_iou else F.least(_size(a, pixel), _size(b, pixel)))


def kept_boxes(boxes: Column, threshold: float, use_iou: bool, pixel: float) -> Column:
    """The boxes, best first, that overlap no box kept before by more than ``threshold``."""
    over = lambda k, b: F.coalesce(_overlap(k, b, use_iou, pixel) > threshold, F.lit(False))
    none = F.filter(boxes, lambda b: F.lit(False))
    return F.aggregate(boxes, none, lambda acc, b: F.when(F.exists(acc, lambda k: over(k, b)), acc).otherwise(F.array_append(acc, b)))


def clustered_boxes(boxes: Column, threshold: float, use_iou: bool, policy: str, names: Sequence[str] = OWN) -> Column:
    """The boxes that ``kept_boxes`` keeps (extents with both end pixels), placed by what they
    suppress: a box belongs to the first kept one that it overlaps. A cluster carries the one
    thing that its policy needs along: the largest box, the sums by score, or the hull."""
    if policy == "largest_area":
        start = lambda b: {f"c_{n}": b[n] for n in BOX}
        def join(k, b):
            # of equal areas the later one, with the lower score
            larger = _size(b, 1.0) >= (k["c_x2"] - k["c_x1"] + 1.0) * (k["c_y2"] - k["c_y1"] + 1.0)
            return {f"c_{n}": F.when(larger, b[n]).otherwise(k[f"c_{n}"]) for n in BOX}

        place = lambda k: {n: k[f"c_{n}"] for n in BOX}
    elif policy == "average":
        start = lambda b: {f"c_{n}": b[n] * b["score"] for n in BOX} | {"c_s": b["score"]}
        join = lambda k, b: {f"c_{n}": k[f"c_{n}"] + b[n] * b["score"] for n in BOX} | {"c_s": k["c_s"] + b["score"]}
        place = lambda k: {n: F.when(k["c_s"] != 0, k[f"c_{n}"] / k["c_s"]).otherwise(k[n]) for n in BOX}
    else:
        pick = {"x1": F.least, "y1": F.least, "x2": F.greatest, "y2": F.greatest}
        start = lambda b: {f"c_{n}": b[n] for n in BOX}
        join = lambda k, b: {f"c_{n}": pick[n](k[f"c_{n}"], b[n]) for n in BOX}
        place = lambda k: {n: k[f"c_{n}"] for n in BOX}

    made = lambda own, more: F.struct(*(own[n].alias(n) for n in names), *(v.alias(n) for n, v in more.items()))
    none = F.transform(F.filter(boxes, lambda b: F.lit(False)), lambda b: made(b, start(b)))

    def step(acc, b):
        at = F.array_position(F.transform(acc, lambda k: F.coalesce(_overlap(k, b, use_iou, 1.0) > threshold, F.lit(False))), F.lit(True))
        grown = F.transform(acc, lambda k, i: F.when(i + 1 == at, made(k, join(k, b))).otherwise(k))
        return F.when(at > 0, grown).otherwise(F.array_append(acc, made(b, start(b))))

    return F.transform(F.aggregate(boxes, none, step), lambda k: F.struct(*((place(k)[n] if n in BOX else k[n]).alias(n) for n in names)))


def nms(df: DataFrame, threshold: float = 0.3, use_iou: bool = True, policy: str = "most_probable", class_agnostic: bool = False, frame: str = "frame_id", stream: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Greedy suppression per frame (and label): from the highest score on, a box stays unless
    its overlap with a box that stayed is over ``threshold``. ``keep``: further columns that stay
    with their boxes.

    With IoU and most_probable, boxes of score 0 or less go and extents are plain. Otherwise
    extents count both end pixels, and the policy may give the survivor another box from its
    cluster (itself and what it suppressed): the largest (ties: the lowest score), the mean by
    score, or the one that encloses all."""
    if policy not in POLICIES:
        raise ValueError(f"{policy} is not one of {POLICIES}")
    frames = by(stream, frame)
    require_columns(df, *frames, *OWN, *keep)
    keys = frames if class_agnostic else [*frames, "label"]
    plain = use_iou and policy == "most_probable"
    rows = sorted_boxes(df.where("score > 0") if plain else df, keys, keep)
    if policy == "most_probable":
        kept = kept_boxes(F.col("boxes"), threshold, use_iou, 0.0 if plain else 1.0)
    else:
        kept = clustered_boxes(F.col("boxes"), threshold, use_iou, policy, (*OWN, *keep))
    return rows.select(*frames, F.inline(kept)).select(*frames, "det_idx", "label", "category_id", "score", *BOX, *keep)


def fused_boxes(boxes: Column, threshold: float) -> Column:
    """Boxes (best first) after two passes of pairing, as structs of det_idx (the least of the
    parts'), box, score, label, category_id and n, the number of parts."""
    pick = {"x1": F.least, "y1": F.least, "x2": F.greatest, "y2": F.greatest}
    item = lambda b, n, free: F.struct(*(b[c].alias(c) for c in OWN), n.alias("n"), F.lit(free).alias("free"))

    def ratio(k, b):
        w, h = _sides(k, b)
        sides = [F.coalesce(F.try_divide(i, (k[f"{c}2"] - k[f"{c}1"]) + (b[f"{c}2"] - b[f"{c}1"]) - i), F.lit(0.0)) for i, c in ((w, "x"), (h, "y"))]
        return F.when(k["free"] & (w > 0) & (h > 0), F.greatest(*sides)).otherwise(F.lit(0.0))

    def pair(k, b):
        parts = {"det_idx": F.least(k["det_idx"], b["det_idx"]), "score": (k["score"] + b["score"]) / 2} | {c: f(k[c], b[c]) for c, f in pick.items()}
        return F.struct(*(parts.get(c, k[c]).alias(c) for c in OWN), (k["n"] + b["n"]).alias("n"), F.lit(False).alias("free"))

    def step(acc, b):
        ratios = F.transform(acc, lambda k: ratio(k, b))
        best = F.coalesce(F.array_max(ratios), F.lit(0.0))
        at = F.array_position(ratios, best)
        return F.when(best > threshold, F.transform(acc, lambda k, i: F.when(i + 1 == at, pair(k, b)).otherwise(k))).otherwise(F.array_append(acc, b))

    for again in (False, True):
        free = F.transform(boxes, lambda b: item(b, b["n"] if again else F.lit(1), True))  # noqa: B023
        boxes = F.aggregate(free, F.filter(free, lambda b: F.lit(False)), step)
    return boxes


def fuse_edges(df: DataFrame, threshold: float = 0.55, skip: float = 0.0, destructive: bool = True, frame: str = "frame_id", stream: str | None = None) -> DataFrame:
    """Fusion of boxes cut by tile edges, per frame and label, in two passes of pairing.

    In a pass, boxes come by score from the highest; each joins the single box of best match if
    the greater of their overlaps along x and along y, both being positive, is over
    ``threshold``, or else stands alone. A pair becomes its enclosing box with the mean score.
    Boxes with a score below ``skip`` go, or, if not destructive, come back as they were."""
    frames = by(stream, frame)
    require_columns(df, *frames, *OWN)
    out = [*frames, "label", "category_id", "score", *BOX, "n"]
    rows = sorted_boxes(df.where(F.col("score") >= skip), [*frames, "label"])
    fused = rows.select(*frames, F.inline(fused_boxes(F.col("boxes"), threshold))).select(*out)
    if destructive:
        return fused
    return fused.unionByName(df.where(F.col("score") < skip).withColumn("n", F.lit(1)).select(*out))
