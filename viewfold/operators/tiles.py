"""Tiles: grids over an image, detections per tile, and merging what tiles found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewfold.functions.geometry import area, box
from viewfold.operators.suppress import OWN, fused_boxes, kept_boxes, sorted_boxes
from viewfold.schema import BOX, by

GLOBAL = -999


def _spread(spark: SparkSession, cols: Column, rows: Column, tile: tuple[Column, Column], image: tuple[int, int]) -> DataFrame:
    """cols x rows tiles spread evenly from edge to edge; the top-left corner is rounded down."""
    base = spark.range(1).select(F.explode(F.sequence(F.lit(0), rows.cast("int") - 1)).alias("row"), cols.cast("int").alias("c"), rows.cast("int").alias("r"), tile[0].cast("double").alias("tw"), tile[1].cast("double").alias("th"))
    grid = base.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("col"))

    def start(k: str, n: str, size: int, t: str) -> Column:
        return F.when(F.col(n) > 1, F.floor(F.col(k) * (F.lit(float(size)) - F.col(t)) / (F.col(n) - 1))).otherwise(F.lit(0)).cast("double")

    x, y = start("col", "c", image[0], "tw"), start("row", "r", image[1], "th")
    return grid.select("row", "col", x.alias("x1"), y.alias("y1"), (x + F.col("tw")).alias("x2"), (y + F.col("th")).alias("y2"))


def _count(tile: Column, image: int, overlap: float) -> Column:
    return 1 + F.ceil((F.lit(float(image)) - tile) / (tile * (1.0 - 0.01 * overlap)))


def fixed_size(spark: SparkSession, tile: tuple[int, int], image: tuple[int, int], overlap: tuple[float, float]) -> DataFrame:
    """Tiles of a fixed size with at least ``overlap`` percent of overlap."""
    t = tuple(F.lit(float(v)) for v in tile)
    return _spread(spark, _count(t[0], image[0], overlap[0]), _count(t[1], image[1], overlap[1]), t, image)


def fixed_ratio(spark: SparkSession, ratio: float, grid: tuple[int, int], image: tuple[int, int], overlap: tuple[float, float]) -> DataFrame:
    """Tiles of a fixed width to height ratio, sized for ``grid`` tiles along the axis that is
    not 0 (the first, if both are given)."""
    if not any(grid):
        raise ValueError("one number of tiles at least must not be 0")
    size = lambda k: F.bround(F.lit(image[k] / (1 + (grid[k] - 1) * (1.0 - 0.01 * overlap[k]))))
    if grid[0]:
        w = size(0)
        h = F.bround(w / ratio)
        return _spread(spark, F.lit(grid[0]), _count(h, image[1], overlap[1]), (w, h), image)
    h = size(1)
    w = F.bround(h * ratio)
    return _spread(spark, _count(w, image[0], overlap[0]), F.lit(grid[1]), (w, h), image)


@dataclass(frozen=True)
class TileGrid:
    """cols x rows tiles that overlap by a fraction, grown to the model's shape; tiles at an edge
    grow inward, others both ways. ``whole`` adds the whole image as a tile of its own."""

    cols: int
    rows: int
    overlap: float = 0.0
    model_ratio: float = 1.0
    image: tuple[int, int] = (640, 480)
    whole: bool = False
    mask: tuple[int, ...] | None = None

    def __post_init__(self):
        if self.whole and self.mask is not None:
            raise ValueError("a mask can't be used together with the whole image")
        w, h, gx, gy = self.size()
        if gx > 2 * w or gy > 2 * h:
            raise ValueError("tiles would grow by more than twice their size; use fewer along that side")

    def size(self) -> tuple[float, float, float, float]:
        """Tile width and height, and what width and height grow by."""
        w = self.image[0] / (self.cols - self.overlap * (self.cols - 1))
        h = self.image[1] / (self.rows - self.overlap * (self.rows - 1))
        return w, h, max(0.0, h * self.model_ratio - w), max(0.0, w / self.model_ratio - h)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(tile_id, row, col, label, x1, y1, x2, y2)"""
        w, h, gx, gy = self.size()
        g = spark.range(self.cols * self.rows).select(F.col("id").alias("tile_id"), F.floor(F.col("id") / self.cols).cast("int").alias("row"), (F.col("id") % self.cols).cast("int").alias("col"))

        def span(k: str, n: int, step: float, whole: int, grow: float) -> tuple[Column, Column]:
            a = F.col(k) * (step * (1 - self.overlap))
            b = F.when(F.col(k) == n - 1, F.lit(float(whole))).otherwise(a + step)
            first, last = F.col(k) == 0, F.col(k) == n - 1
            before = F.when(first, 0.0).when(last, grow).otherwise(grow / 2)
            after = F.when(first, grow).when(last, 0.0).otherwise(grow / 2)
            return F.bround(a - before), F.bround(b + after)

        x1, x2 = span("col", self.cols, w, self.image[0], gx)
        y1, y2 = span("row", self.rows, h, self.image[1], gy)
        out = g.select("tile_id", "row", "col", F.lit("LOCAL").alias("label"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
        if self.mask is not None:
            out = out.where(F.col("tile_id").isin(*self.mask))
        if self.whole:
            one = spark.range(1).select(F.lit(GLOBAL).cast("long").alias("tile_id"), F.lit(-1).alias("row"), F.lit(-1).alias("col"), F.lit("GLOBAL").alias("label"), *(F.lit(float(v)).alias(n) for v, n in zip((0, 0, *self.image), ("x1", "y1", "x2", "y2"))))
            out = out.unionByName(one)
        return out


def rois_on_frames(frames: DataFrame, rois: list[tuple[float, float, float, float]], stream: str | None = None) -> DataFrame:
    """Fixed regions as detections ROI0, ROI1, … of every frame, with score 1."""
    items = F.array(*(F.struct(F.lit(f"ROI{k}").alias("label"), F.lit(1.0).alias("score"), *(F.lit(float(v)).alias(n) for v, n in zip(r, ("x1", "y1", "x2", "y2")))) for k, r in enumerate(rois)))
    return frames.select(*by(stream, "frame_id"), F.posexplode(items).alias("roi_index", "r")).select(*by(stream, "frame_id"), "roi_index", "r.*")


def motion_gate(rois: DataFrame, motion: DataFrame, threshold: float, look_back: int = 1, stream: str | None = None) -> DataFrame:
    """Regions with more changed pixels than ``threshold`` of their area. ``motion``: (frame_id,
    x, y) of changed pixels against the frame ``look_back`` before. The first ``look_back``
    frames keep all regions."""
    hits = rois.alias("r").join(motion.alias("m"), by(stream, "frame_id"), "left")
    inside = (F.col("m.x") >= F.col("r.x1")) & (F.col("m.x") < F.col("r.x2")) & (F.col("m.y") >= F.col("r.y1")) & (F.col("m.y") < F.col("r.y2"))
    changed = hits.groupBy(*by(stream, "frame_id"), "roi_index", "label", "score", *BOX).agg(F.count_if(inside).alias("changed"))
    return changed.where((F.col("frame_id") < look_back) | (F.col("changed") > threshold * area(box())))


def to_image(found: DataFrame, tiles: DataFrame) -> DataFrame:
    """Detections of tiles moved to image coordinates: an equi-join on the tile."""
    t = tiles.select("tile_id", "row", "col", F.col("label").alias("tile_label"), F.col("x1").alias("ox"), F.col("y1").alias("oy"))
    moved = found.join(F.broadcast(t), "tile_id")
    return moved.withColumns({"x1": F.col("x1") + F.col("ox"), "y1": F.col("y1") + F.col("oy"), "x2": F.col("x2") + F.col("ox"), "y2": F.col("y2") + F.col("oy")}).drop("ox", "oy")


def split_by_size(found: DataFrame, image: tuple[int, int], overlap: float, threshold: float = 0.01) -> DataFrame:
    """Large objects come from the whole image only, others from tiles only. The whole image's
    limit is ``threshold`` times five overlaps."""
    a, whole = area(box()), float(image[0] * image[1])
    return found.where(F.when(F.col("tile_label") == "GLOBAL", a >= whole * threshold * overlap * 5).otherwise(a < whole * threshold))


def on_inner_edge(b, tile_id: Column, grid: TileGrid, band: float = 0.02, slack: float = 1.0) -> Column:
    """Whether a box in tile coordinates, widened by ``slack``, reaches the band along a side of
    its tile that isn't a border of the image."""
    w, h, gx, gy = grid.size()
    tw, th = w + gx, h + gy
    col, row = tile_id % grid.cols, F.floor(tile_id / grid.cols)
    x1, y1, x2, y2 = b[0] - slack, b[1] - slack, b[2] + slack, b[3] + slack
    real = (x1 != x2) & (y1 != y2)
    left = (col != 0) & (x1 <= tw * band) & (x2 >= 0)
    right = (col != grid.cols - 1) & (x2 >= tw * (1 - band)) & (x1 <= tw)
    top = (row != 0) & (y1 <= th * band) & (y2 >= 0)
    bottom = (row != grid.rows - 1) & (y2 >= th * (1 - band)) & (y1 <= th)
    return real & (left | right | top | bottom)


def merge_tiles(found: DataFrame, tiles: DataFrame, grid: TileGrid, threshold: float = 0.3, large: float | None = None, fusion: float | None = None, band: float = 0.02, stream: str | None = None) -> DataFrame:
    """Detections of tiles, in tile coordinates, as detections of frames: moved to the image, split
    by size if ``large`` is given, boxes at inner edges fused if ``fusion`` is given, then NMS. A
    frame's boxes are gathered once for both."""
    edge = on_inner_edge(box(), F.col("tile_id"), grid, band) & (F.col("tile_id") != GLOBAL) if fusion is not None else F.lit(False)
    moved = to_image(found.withColumn("edge", edge), tiles)
    if large is not None:
        moved = split_by_size(moved, grid.image, grid.overlap, large)
    frames = by(stream, "frame_id")
    rows = sorted_boxes(moved, [*frames, "label"], ["edge"])
    item = lambda b: F.struct((-b["score"]).alias("k"), *(b[c].alias(c) for c in OWN))
    boxes = F.transform(F.filter("boxes", lambda b: ~b["edge"]), item)
    if fusion is not None:
        fused = fused_boxes(F.filter("boxes", lambda b: b["edge"] & (b["score"] >= 0)), fusion)
        boxes = F.sort_array(F.concat(boxes, F.transform(fused, item)))
    kept = kept_boxes(F.filter(boxes, lambda b: b["score"] > 0), threshold, True, 0.0)
    return rows.select(*frames, F.inline(kept)).select(*frames, "det_idx", "label", "category_id", "score", *BOX)
