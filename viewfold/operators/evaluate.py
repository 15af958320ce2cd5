"""Scoring predictions against ground truth."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from viewfold.functions.folds import per_list
from viewfold.functions.geometry import box, iou

#: IoU thresholds and area ranges of the public COCO protocol.
IOU_THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
KINDS = ("bbox", "keypoints", "segm")
# fixed values: the protocol's spreads of 17 body points, nose to ankles
SIGMAS = (0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089)


def topk_accuracy(pred: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5), item: str = "item", by_class: bool = True, max_images: int = 0) -> DataFrame:
    """(class, k, accuracy, n): share of items whose true class is among the k best predictions;
    ties of score go by label. The row of a null class is overall. ``pred``: (item, label, score),
    ``truth``: (item, label). With ``max_images`` only so many items count, class after class in
    order; the class in which the limit falls counts overall but has no row of its own."""
    ranked = pred.withColumn("__r", F.row_number().over(W.partitionBy(item).orderBy(F.col("score").desc(), "label")))
    t = truth.select(item, F.col("label").alias("class"))
    cut = F.lit(False)
    if max_images:
        # places within a class, and how many items the classes before it have: no sort of all items
        sizes = t.groupBy("class").agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("class").rowsBetween(W.unboundedPreceding, -1))
        t = t.join(F.broadcast(sizes.withColumn("__before", F.coalesce(before, F.lit(0)))), "class")
        t = t.withColumn("__at", F.row_number().over(W.partitionBy("class").orderBy(item)) + F.col("__before")).where(F.col("__at") <= max_images)
        cut = F.col("__before") + F.col("__n") >= max_images
    t = t.withColumn("__own", ~cut)
    hit = t.join(ranked, (t[item] == ranked[item]) & (t["class"] == ranked["label"]), "left").select(t[item], "class", "__own", F.coalesce("__r", F.lit(1 << 30)).alias("__r"))
    rows = hit.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("__h", (F.col("__r") <= F.col("k")).cast("double"))
    if not by_class:
        return rows.groupBy("k").agg(F.avg("__h").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    out = rows.groupingSets([["class", "k"], ["k"]], "class", "k").agg(F.avg("__h").alias("accuracy"), F.count(F.lit(1)).alias("n"), F.bool_and("__own").alias("__own"))
    return out.where(F.col("class").isNull() | F.col("__own")).drop("__own")


def regression_errors(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    d = F.col(pred) - F.col(truth)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.count(d).alias("n"))


def first_images(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of the first ``limit`` keys in order; 0 means all."""
    return df if not limit else df.join(F.broadcast(df.select(key).distinct().orderBy(key).limit(limit)), key)


def to_coco(df: DataFrame, classes: dict[str, int] | None = None) -> DataFrame:
    """``coco``: JSON of (image_id, category_id, bbox as corner and size to 3 places, score to 5
    places, half to even)."""
    b = box()
    category = F.col("category_id")
    if classes:
        category = F.try_element_at(F.create_map(*(x for k, v in classes.items() for x in (F.lit(k), F.lit(v)))), F.col("label"))
    size = [F.bround(v, 3) for v in (b[0], b[1], b[2] - b[0], b[3] - b[1])]
    return df.withColumns({"category_id": category, "bbox": F.array(*size), "score": F.bround("score", 5)}).withColumn("coco", F.to_json(F.struct(F.col("frame_id").alias("image_id"), "category_id", "bbox", "score")))


def flat_keypoints(landmarks: Column) -> Column:
    """[x, y, score] of each landmark, one after another."""
    return F.flatten(F.transform(landmarks, lambda p: F.array(p["x"], p["y"], p["score"])))


def oks_matrix(a, b, boxes, areas, sigmas):
    """Object keypoint similarity of predictions and truths, flat [x, y, visibility, …] each: the mean
    over the truth's visible points of exp(-d^2 / (2 (2 sigma)^2 area)). A truth without visible
    points is compared by how far points lie outside its box, doubled on every side."""
    import numpy as np

    x, y = np.array(a, dtype=float).reshape(len(a), -1, 3), np.array(b, dtype=float).reshape(len(b), -1, 3)
    out = np.zeros((len(x), len(y)))
    spread = (2 * np.array(sigmas, dtype=float)) ** 2
    for j in range(len(y)):
        seen = y[j, :, 2] > 0
        if seen.any():
            d = x[:, :, :2] - y[j, None, :, :2]
        else:
            (x1, y1, x2, y2) = boxes[j]
            w, h = x2 - x1, y2 - y1
            low, high = np.array([x1 - w, y1 - h]), np.array([x2 + w, y2 + h])
            d = np.maximum(0, low - x[:, :, :2]) + np.maximum(0, x[:, :, :2] - high)
        e = (d**2).sum(axis=2) / spread / (areas[j] + np.spacing(1)) / 2
        out[:, j] = np.exp(-(e[:, seen] if seen.any() else e)).mean(axis=1)
    return out


def rle_iou(a: list[int], b: list[int], crowd: bool = False) -> float:
    """IoU of two masks as run lengths that start with zeros; of a crowd, over the first's area."""
    import numpy as np

    ones = lambda r: np.cumsum(r, dtype=np.int64)
    ea, eb = ones(a), ones(b)
    edge = np.unique(np.concatenate([[0], ea, eb]))
    on = lambda e: np.searchsorted(e, edge[:-1], "right") % 2 == 1
    size, x, y = np.diff(edge), on(ea), on(eb)
    whole = size[x].sum() if crowd else size[x | y].sum()
    return float(size[x & y].sum() / whole) if whole else 0.0


def match_truth(pred: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = IOU_THRESHOLDS, areas: dict | None = None, max_dets: int = 100, kind: str = "bbox", sigmas: tuple[float, ...] = SIGMAS) -> DataFrame:
    """Greedy matching per image and class: (image_id, category_id, area, threshold, score, rank,
    state), state 1 for a hit, 0 for a miss, -1 for not counted.

    Predictions come by score from the highest (ties by det_idx), the first ``max_dets``; each
    takes the truth of greatest similarity not yet taken, from the threshold on, those that count
    before those that don't (crowds, areas out of range, no visible points), crowds any number of
    times. A prediction out of range without a match isn't counted either.

    ``kind``: similarity is IoU of boxes, or of masks as run lengths in ``rle`` (segm), or that of
    points in ``keypoints``, both tables' [x, y, visibility, …], with a spread for each point in
    ``sigmas``. Areas are the boxes', or the column ``area`` of the truth where there is one."""
    areas = areas or {"all": AREAS["all"]}
    each = _matches(pred, truth, thresholds, areas, max_dets, kind, sigmas, "states array<int>", lambda hits, misses, n: ([[1 if h >> k & 1 else 0 if m >> k & 1 else -1 for k in range(n)] for h, m in zip(hits, misses)],))
    each = each.select("image_id", "category_id", "score", "rank", F.posexplode("states").alias("__k", "state"))
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    area = at([*areas], F.floor(F.col("__k") / len(thresholds)))
    return each.select("image_id", "category_id", area.alias("area"), at([float(t) for t in thresholds], F.col("__k") % len(thresholds)).alias("threshold"), "score", "rank", "state")


def _matches(pred: DataFrame, truth: DataFrame, thresholds: tuple[float, ...], areas: dict, max_dets: int, kind: str, sigmas: tuple[float, ...], columns: str, told: Callable) -> DataFrame:
    """A row per prediction of ``match_truth``, with ``columns`` that ``told`` makes of two numbers for
    each: the bits of the hits and of the misses, a bit for each threshold of each area in order."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is not one of {KINDS}")
    extra = {"bbox": F.array().cast("array<double>"), "keypoints": F.col("keypoints").cast("array<double>"), "segm": F.col("rle").cast("array<double>")}[kind].alias("extra")
    item = F.struct((-F.col("score")).alias("k"), "det_idx", "score", "x1", "y1", "x2", "y2", extra)
    p = pred.groupBy("image_id", "category_id").agg(F.sort_array(F.collect_list(item)).alias("ps"))
    crowd = F.col("iscrowd") if "iscrowd" in truth.columns else F.lit(0)
    size = F.col("area") if "area" in truth.columns else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    t = truth.groupBy("image_id", "category_id").agg(F.sort_array(F.collect_list(F.struct("truth_idx", "x1", "y1", "x2", "y2", crowd.cast("int").alias("crowd"), size.cast("double").alias("size"), extra))).alias("ts"))
    pairs = p.join(t, ["image_id", "category_id"], "left")
    ts, lims, most = thresholds, list(areas.items()), max_dets

    def run(_k, _i, score, px1, py1, px2, py2, points, _t, tx1, ty1, tx2, ty2, crowds, sizes, marks):
        import numpy as np

        score, points = score[:most], points[:most]
        a = np.array([px1, py1, px2, py2], dtype=float).T[:most]
        b = np.array([tx1, ty1, tx2, ty2], dtype=float).T
        crowd, own = np.array(crowds, dtype=bool), np.array(sizes, dtype=float)
        size = (a[:, 2:] - a[:, :2]).prod(axis=1)
        if kind == "keypoints":
            over = oks_matrix(points, marks, b, own, sigmas) if len(a) and len(b) else np.zeros((len(a), len(b)))
            blank = np.array([not any(v > 0 for v in m[2::3]) for m in marks], dtype=bool)
        elif kind == "segm":
            over = np.array([[rle_iou(x, y, c) for y, c in zip(marks, crowds)] for x in points], dtype=float).reshape(len(a), len(b))
            size, blank = np.array([sum(x[1::2]) for x in points], dtype=float), np.zeros(len(b), dtype=bool)
        else:
            inter = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None).prod(axis=2)
            whole = np.where(crowd[None, :], size[:, None], size[:, None] + (b[:, 2:] - b[:, :2]).prod(axis=1)[None, :] - inter)
            over, blank = np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0), np.zeros(len(b), dtype=bool)
        top = over.max(initial=-1)
        over = over.tolist()
        hits, misses, bit = [0] * len(score), [0] * len(score), 1
        for _, (lo, hi) in lims:
            ignore = (crowd | blank | (own < lo) | (own > hi)).tolist()
            order = sorted(range(len(ignore)), key=ignore.__getitem__)
            outside = ((size < lo) | (size > hi)).tolist()
            for thr in ts:
                taken = [False] * len(ignore)
                if top < min(thr, 1 - 1e-10):  # nothing can match
                    for i, out in enumerate(outside):
                        if not out:
                            misses[i] |= bit
                    bit <<= 1
                    continue
                for i, row in enumerate(over):
                    best, at = min(thr, 1 - 1e-10), -1
                    for j in order:
                        if taken[j] and not crowds[j]:
                            continue
                        if at >= 0 and not ignore[at] and ignore[j]:
                            break
                        if row[j] >= best:
                            best, at = row[j], j
                    if at >= 0:
                        taken[at] = True
                        if not ignore[at]:
                            hits[i] |= bit
                    elif not outside[i]:
                        misses[i] |= bit
                bit <<= 1
        return score, list(range(len(score))), *told(hits, misses, len(lims) * len(ts))

    walk = per_list(run, f"score double, rank int, {columns}")
    return pairs.select("image_id", "category_id", F.inline(walk("ps", "ts")))


_CURVE = ["category_id", "area", "threshold"]


def _band(score: Column) -> Column:
    """Equal scores are in one band, higher scores in the same or a higher one; 256 bands lie between
    0 and 1. A curve's rows are sorted band by band in many tasks, and only the bands' sums are
    gone through as a whole."""
    return F.floor((0.5 + F.atan(score.cast("double")) / math.pi) * 1024).cast("int")


def _bands_before(rows: DataFrame, sums: dict[str, Column], combine: Callable[[str], Column], falling: bool) -> DataFrame:
    """``rows`` with, for each of ``sums`` over a band, what all bands above it (below it, if not
    ``falling``) come to."""
    per = rows.groupBy(*_CURVE, "__band").agg(*(v.alias(n) for n, v in sums.items()))
    band = F.col("__band").desc() if falling else F.col("__band")
    over = W.partitionBy(*_CURVE).orderBy(band).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(per.withColumns({n: combine(n).over(over) for n in sums}), [*_CURVE, "__band"])


def precision_recall(matched: DataFrame, positives: DataFrame) -> DataFrame:
    """(…, score, tp, fp, recall, precision) along falling scores, ties by image, then rank.
    ``positives``: (category_id, area, positives)."""
    over = W.partitionBy(*_CURVE, "__band").orderBy(F.col("score").desc(), "image_id", "rank").rowsBetween(W.unboundedPreceding, 0)
    rows = matched.where("state >= 0").join(F.broadcast(positives), ["category_id", "area"]).withColumn("__band", _band(F.col("score")))
    hit, miss = ((F.col("state") == v).cast("long") for v in (1, 0))
    rows = _bands_before(rows, {"__tp": F.sum(hit), "__fp": F.sum(miss)}, F.sum, True)
    tp, fp = (F.sum(c).over(over) + F.coalesce(b, F.lit(0)) for c, b in ((hit, "__tp"), (miss, "__fp")))
    out = rows.withColumns({"tp": tp, "fp": fp}).withColumns({"recall": F.try_divide("tp", "positives"), "precision": F.try_divide("tp", F.col("tp") + F.col("fp"))})
    return out.drop("__band", "__tp", "__fp")


def average_precision(curve: DataFrame, positives: DataFrame, thresholds: tuple[float, ...] = IOU_THRESHOLDS, limits: tuple[int, ...] = (100,)) -> DataFrame:
    """(category_id, area, threshold, ap, recall_n…): precision made non-increasing, then read at
    101 recall points; ``recall_n`` is the recall of the n best predictions per image and class.
    Classes without positives give no row."""
    banded = curve.where("positives > 0").withColumn("__band", _band(F.col("score")))
    banded = _bands_before(banded, {"__top": F.max("precision")}, F.max, False)
    # from the lowest score on, as a frame that grows costs one step a row and one that shrinks all
    back = W.partitionBy(*_CURVE, "__band").orderBy("score", F.col("image_id").desc(), F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    top = banded.withColumn("p", F.greatest(F.max("precision").over(back), F.coalesce("__top", F.lit(0.0))))
    # a row reads the points from the recall before it on: its own less one hit, if it is one
    point = lambda c: F.floor(F.try_divide(c * 100, F.col("positives")) + 1e-9).cast("int")
    before = F.col("tp") - (F.col("state") == 1).cast("int")
    first = F.col("tp") + F.col("fp") == 1
    marks = top.withColumns({"upto": point(F.col("tp")), "low": F.when(first, F.lit(-1)).otherwise(point(before))})
    hits = [F.count_if((F.col("state") == 1) & (F.col("rank") < n)).alias(f"tp_{n}") for n in limits]
    sums = marks.groupBy(*_CURVE).agg(F.sum((F.col("upto") - F.col("low")) * F.col("p")).alias("s"), *hits)
    grid = positives.where("positives > 0").withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    recalls = [(F.coalesce(f"tp_{n}", F.lit(0)) / F.col("positives")).alias(f"recall_{n}") for n in limits]
    return grid.join(sums, _CURVE, "left").select(*_CURVE, (F.coalesce("s", F.lit(0.0)) / 101).alias("ap"), *recalls)


def positives_of(truth: DataFrame, areas: dict | None = None, kind: str = "bbox") -> DataFrame:
    areas = areas or {"all": AREAS["all"]}
    size = F.col("area") if "area" in truth.columns else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    real = F.col("iscrowd") == 0 if "iscrowd" in truth.columns else F.lit(True)
    if kind == "keypoints":
        real = real & F.exists(F.filter("keypoints", lambda v, i: i % 3 == 2), lambda v: v > 0)
    counts = [F.count_if(real & (size >= lo) & (size <= hi)).alias(n) for n, (lo, hi) in areas.items()]
    wide = truth.groupBy("category_id").agg(*counts)
    return wide.select("category_id", F.inline(F.array(*(F.struct(F.lit(n).alias("area"), F.col(n).alias("positives")) for n in areas))))


def _curves(rows: DataFrame, positives: DataFrame, areas: list[str], thresholds: tuple[float, ...], limits: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """``average_precision`` of all curves at once, and what it keeps meanwhile. ``rows``: (category_id, image_id, rank, score, hit,
    miss), a bit for each curve. All curves of a class have one order, in which its rows are sorted
    once, band by band; a band starts from the sums of the bands above it. Precision at a recall
    point is the greatest of the hits from there on, so of each band the best hit of each point
    between two is enough."""
    count, n_points, bands = len(areas) * len(thresholds), 101, ["category_id", "__band"]
    order = [F.col("score").desc(), F.col("image_id"), F.col("rank")]
    over = W.partitionBy(*bands).orderBy(*order)
    rows = rows.withColumn("__band", _band(F.col("score"))).repartition(*bands).withColumn("__first", F.row_number().over(over) == 1).sortWithinPartitions(*bands, *order).persist()
    kinds = {c: rows.schema[c].dataType.simpleString() for c in bands}

    def bits(t, name):
        import numpy as np

        x = t.column(name).to_numpy().astype("<i8")
        return np.unpackbits(x.view(np.uint8).reshape(len(x), 8), axis=1, count=count, bitorder="little").astype(np.int64)

    def spans(batches):
        """Each batch with the stretches of rows of one band."""
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                s = np.flatnonzero(t.column("__first").to_numpy()).tolist()
                s = s if s[:1] == [0] else [0, *s]
                yield t, s, [*s[1:], b.num_rows]

    def add(batches):
        import numpy as np
        import pyarrow as pa

        for t, starts, _ in spans(batches):
            hit, miss, rank = bits(t, "hit"), bits(t, "miss"), t.column("rank").to_numpy()
            parts = [np.add.reduceat(x, starts, axis=0) for x in (hit, miss, *(hit * (rank < n)[:, None] for n in limits))]
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(at).combine_chunks() for c in bands), pa.array(np.concatenate(parts, axis=1).tolist(), pa.list_(pa.int64()))], [*bands, "s"])

    each = rows.mapInArrow(add, f"category_id {kinds['category_id']}, __band {kinds['__band']}, s array<long>").select(*bands, F.posexplode("s").alias("k", "n"))
    sums = each.groupBy(*bands, "k").agg(F.sum("n").alias("n"))
    above = W.partitionBy("category_id", "k").orderBy(F.col("__band").desc()).rowsBetween(W.unboundedPreceding, -1)
    before = sums.where(F.col("k") < 2 * count).withColumn("n", F.coalesce(F.sum("n").over(above), F.lit(0)))
    listed = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v])
    start = before.groupBy(*bands).agg(listed("k", "n").alias("__before"))
    place = F.array_position(F.array(*map(F.lit, areas)), F.col("area")) - 1
    need = positives.withColumn("k", place).groupBy("category_id").agg(listed("k", "positives").alias("__need"))
    start = start.join(F.broadcast(need), "category_id").withColumn("__first", F.lit(True))
    # only the first row of a band has its sums
    told = rows.select(*bands, "hit", "miss", "__first").join(F.broadcast(start), [*bands, "__first"], "left")

    def read(batches):
        import numpy as np
        import pyarrow as pa

        tp = fp = need = None
        for t, starts, ends in spans(batches):
            hit, miss, first = bits(t, "hit"), bits(t, "miss"), t.column("__first").to_numpy()
            out = []
            for s, e in zip(starts, ends):
                if first[s]:
                    sums, need = t.column("__before")[s].as_py(), t.column("__need")[s].as_py()
                    if sums is not None:
                        tp, fp, need = np.array(sums[:count]), np.array(sums[count:]), np.repeat(need, len(thresholds))
                if need is None:  # a class without positives
                    continue
                h, m = np.cumsum(hit[s:e], axis=0) + tp, np.cumsum(miss[s:e], axis=0) + fp
                for c in range(count):
                    at = np.flatnonzero(hit[s:e, c])
                    if len(at) and need[c]:
                        point = h[at, c] * (n_points - 1) // need[c]
                        edge = np.flatnonzero(np.diff(point, prepend=-1))
                        best = np.maximum.reduceat(h[at, c] / (h[at, c] + m[at, c]), edge)
                        out.append((s, c, point[edge], best))
                tp, fp = h[-1], m[-1]
            if out:
                n = [len(b) for *_, b in out]
                at = pa.array(np.repeat([s for s, *_ in out], n))
                yield pa.RecordBatch.from_arrays([t.column("category_id").take(at).combine_chunks(), pa.array(np.repeat([c for _, c, *_ in out], n), pa.int32()), pa.array(np.concatenate([x[2] for x in out]), pa.int32()), pa.array(np.concatenate([x[3] for x in out]), pa.float64())], ["category_id", "k", "point", "p"])

    tops = told.mapInArrow(read, f"category_id {kinds['category_id']}, k int, point int, p double").groupBy("category_id", "k", "point").agg(F.max("p").alias("p"))
    # a top holds for the points from the one after the next lower top on
    low = F.coalesce(F.lag("point").over(W.partitionBy("category_id", "k").orderBy("point")), F.lit(-1))
    env = F.max("p").over(W.partitionBy("category_id", "k").orderBy(F.col("point").desc()))
    ap = tops.withColumns({"n": F.col("point") - low, "p": env}).groupBy("category_id", "k").agg((F.sum(F.col("n") * F.col("p")) / n_points).alias("ap"))
    per = F.floor(F.col("k") / count) - 2
    hits = sums.where(F.col("k") >= 2 * count).groupBy("category_id", (F.col("k") % count).alias("k")).agg(*(F.sum(F.when(per == i, F.col("n"))).alias(f"tp_{n}") for i, n in enumerate(limits)))
    grid = positives.where("positives > 0").select("category_id", "area", "positives", F.posexplode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("__t", "threshold")).withColumn("k", (place * len(thresholds) + F.col("__t")).cast("int"))
    recalls = [(F.coalesce(f"tp_{n}", F.lit(0)) / F.col("positives")).alias(f"recall_{n}") for n in limits]
    out = grid.join(F.broadcast(ap), ["category_id", "k"], "left").join(F.broadcast(hits), ["category_id", "k"], "left")
    return out.select(*_CURVE, F.coalesce("ap", F.lit(0.0)).alias("ap"), *recalls), rows


def coco_summary(pred: DataFrame, truth: DataFrame, kind: str = "bbox", sigmas: tuple[float, ...] = SIGMAS) -> DataFrame:
    """The protocol's numbers: (ord, name, value), twelve, or ten for keypoints; -1 where nothing
    counts. Greedy matching goes by falling score, so that of the n best is the start of that of
    all: one pass. The numbers are worked out at once, as the matches are kept only meanwhile."""
    points = kind == "keypoints"
    areas = {k: v for k, v in AREAS.items() if not points or k != "small"}
    limits = (20,) if points else (1, 10, 100)
    n = positives_of(truth, areas, kind)
    matched = _matches(pred, truth, IOU_THRESHOLDS, areas, limits[-1], kind, sigmas, "hit long, miss long", lambda hits, misses, _: (hits, misses))
    per, kept = _curves(matched.where("hit != 0 or miss != 0"), n, [*areas], IOU_THRESHOLDS, limits)
    every, half, most = F.lit(True), F.col("threshold") == 0.5, F.col("threshold") == 0.75
    sizes = [a for a in areas if a != "all"]
    pick = [("AP", every, "all", "ap"), ("AP50", half, "all", "ap"), ("AP75", most, "all", "ap")] + [(f"AP_{a}", every, a, "ap") for a in sizes]
    if points:
        pick += [("AR", every, "all", "recall_20"), ("AR50", half, "all", "recall_20"), ("AR75", most, "all", "recall_20")]
    else:
        pick += [(f"AR{k}", every, "all", f"recall_{k}") for k in limits]
    pick += [(f"AR_{a}", every, a, f"recall_{limits[-1]}") for a in sizes]
    row = per.agg(*(F.coalesce(F.avg(F.when(c & (F.col("area") == a), F.col(v))), F.lit(-1.0)).alias(name) for name, c, a, v in pick)).first()
    kept.unpersist()
    return pred.sparkSession.createDataFrame([(k, name, row[name]) for k, (name, *_) in enumerate(pick, 1)], "ord int, name string, value double")


def match_boxes(a: DataFrame, b: DataFrame, key: str = "frame_id", id_col: str = "det_idx", least: float = 0.0) -> DataFrame:
    """(key, a_id, b_id, iou): the pairing of the boxes of a frame in ``a`` with those in ``b`` that
    has the greatest sum of IoU; pairs with an IoU of ``least`` or less are none."""
    from viewfold.operators.tracking import assign, iou_matrix

    own = lambda df, n: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(id_col, "x1", "y1", "x2", "y2"))).alias(n))

    def run(ia, *rest):
        import numpy as np

        x, ib, y = np.array(rest[:4], dtype=float).T, rest[4], np.array(rest[5:], dtype=float).T
        m = iou_matrix(x.reshape(-1, 4), y.reshape(-1, 4))
        pairs = [(i, j) for i, j in assign(1 - m) if m[i, j] > least]
        return [ia[i] for i, _ in pairs], [ib[j] for _, j in pairs], [float(m[i, j]) for i, j in pairs]

    kind = a.schema[id_col].dataType.simpleString()
    walk = per_list(run, f"a_id {kind}, b_id {kind}, iou double")
    return own(a, "__a").join(own(b, "__b"), key).select(key, F.inline(walk("__a", "__b")))


def iou_with_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    p, t = pred.alias("p"), truth.alias("t")
    on = (F.col("p.image_id") == F.col("t.image_id")) & (F.col("p.category_id") == F.col("t.category_id"))
    return p.join(t, on).select("p.image_id", "p.det_idx", "t.truth_idx", iou(box("p."), box("t.")).alias("iou"))
