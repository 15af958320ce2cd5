"""Trails of tracks and their crossings of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from viewfold.functions.geometry import anchor, box, segments_cross
from viewfold.schema import BOX, by, require_columns


def trails(df: DataFrame, timeout: int = 8, depth: int = 10, keep: bool = False, stream: str | None = None) -> DataFrame:
    """Tracks (of each ``stream``) with their trail: ``session`` begins anew after ``timeout`` missing frames,
    coordinates are cut to whole numbers, the label is the session's first. ``sx1``… is the box
    the trail of at most ``depth`` boxes starts with, ``px1``… the one before; with ``keep`` the
    trail itself is there as an array."""
    require_columns(df, "frame_id", "label", *by(stream, "track_id"), *BOX)
    over = W.partitionBy(*by(stream, "track_id")).orderBy("frame_id")
    gap = F.col("frame_id") - F.lag("frame_id").over(over) - 1
    cut = df.withColumns({n: F.col(n).cast("long") for n in BOX}).withColumn("__new", F.coalesce((gap >= timeout).cast("int"), F.lit(1)))
    cut = cut.withColumn("session", F.sum("__new").over(over)).drop("__new")
    own = W.partitionBy(*by(stream, "track_id", "session")).orderBy("frame_id")
    tail = own.rowsBetween(-(depth - 1), 0)
    out = cut.withColumns({f"s{n}": F.first(n).over(tail) for n in BOX} | {f"p{n}": F.lag(n).over(own) for n in BOX} | {"label": F.first("label").over(own.rowsBetween(W.unboundedPreceding, 0)), "points": F.row_number().over(own)})
    return out.withColumn("trail", F.collect_list(F.struct(*BOX)).over(tail)) if keep else out


def relative_direction(tx: Column, ty: Column, lx: float, ly: float) -> Column:
    """Which way the line is crossed as seen along it; motion along the line counts as left when
    it has the line's signs."""
    c = tx * ly - ty * lx
    same = (F.signum(tx) == F.signum(F.lit(float(lx)))) & (F.signum(ty) == F.signum(F.lit(float(ly))))
    return F.when(c > 0, "left").when(c < 0, "right").when(same, "left").otherwise("right")


def crossings(trailed: DataFrame, lines: list[tuple[float, float, float, float]], anchor_point: str = "BOTTOM_CENTER", whole_trail: bool = True, first_only: bool = True, absolute: bool = False, stream: str | None = None) -> DataFrame:
    """A row per crossing: (frame_id, track_id, session, label, line_index, direction or
    horizontal and vertical). The trail goes from its start, or from the box before, to the
    current box. ``first_only``: once per line and session. The lines are unrolled."""
    start = box("s") if whole_trail else box("p")
    (ax, ay), (zx, zy) = anchor(start, anchor_point), anchor(box(), anchor_point)
    tx, ty = zx - ax, zy - ay
    tests = []
    for k, (x1, y1, x2, y2) in enumerate(lines):
        p, q = (F.lit(float(x1)), F.lit(float(y1))), (F.lit(float(x2)), F.lit(float(y2)))
        tests.append(F.struct(F.lit(k).alias("line_index"), segments_cross(p, q, (ax, ay), (zx, zy)).alias("hit"), relative_direction(tx, ty, x2 - x1, y2 - y1).alias("direction")))
    rows = trailed.where("points > 1").withColumn("__l", F.explode(F.array(*tests)))
    hits = rows.where("__l.hit").select(*by(stream), "frame_id", "ts", "track_id", "session", "label", "__l.line_index", "__l.direction", F.when(tx < 0, "left").otherwise("right").alias("horizontal"), F.when(ty < 0, "top").otherwise("bottom").alias("vertical"))
    if first_only:
        own = W.partitionBy(*by(stream, "track_id", "session", "line_index")).orderBy("frame_id")
        hits = hits.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
    return hits.drop("direction") if absolute else hits.drop("horizontal", "vertical")


def repeated_crossings(trailed: DataFrame, frames: DataFrame, lines: list[tuple[float, float, float, float]], timeout: int = 8, stream: str | None = None, **how) -> DataFrame:
    """Crossings counted in every frame while the trail still crosses, seen or not, until the
    trail expires ``timeout`` frames after its last sighting."""
    over = W.partitionBy(*by(stream, "track_id")).orderBy("frame_id")
    # held until the track is seen again or its trail expires
    upto = F.least(F.coalesce(F.lead("frame_id").over(over), F.lit(1 << 60)) - 1, F.col("frame_id") + timeout - 1)
    held = trailed.withColumn("__upto", upto)
    hits = crossings(held.withColumn("label", F.struct("label", "__upto")), lines, first_only=False, stream=stream, **how)
    hits = hits.withColumn("frame_id", F.explode(F.sequence(F.col("frame_id"), F.greatest("label.__upto", "frame_id")))).withColumn("label", F.col("label.label")).drop("ts")
    return hits.join(frames.select(*by(stream, "frame_id"), "ts"), by(stream, "frame_id"))


def running_counts(hits: DataFrame, frames: DataFrame, n_lines: int, accumulate: bool = True, classes: list[str] | None = None, directions: tuple[str, ...] = ("left", "right"), stream: str | None = None) -> DataFrame:
    """Counts by direction per frame and line, of the frame or up to it. ``directions`` are of
    left and right, or, for crossings by absolute direction, of left, right, top and bottom. With
    ``classes`` there are counts of each of these labels as well: a column for each."""
    keys = by(stream, "frame_id", "line_index")
    has = lambda d: F.col("direction") == d if "direction" in hits.columns else F.col("horizontal" if d in ("left", "right") else "vertical") == d
    counts = {d: F.count_if(has(d)) for d in directions} | {f"{c}_{d}": F.count_if(has(d) & (F.col("label") == c)) for c in classes or () for d in directions}
    per = hits.groupBy(*keys).agg(*(v.alias(n) for n, v in counts.items()))
    grid = frames.select(*by(stream), "frame_id", F.explode(F.sequence(F.lit(0), F.lit(n_lines - 1))).alias("line_index"))
    out = grid.join(per, keys, "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in counts})
    if accumulate:
        over = W.partitionBy(*by(stream, "line_index")).orderBy("frame_id").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumns({n: F.sum(n).over(over) for n in counts})
    return out


def flag_objects(df: DataFrame, hits: DataFrame, n_lines: int, stream: str | None = None) -> DataFrame:
    """``cross_line``: per box, whether its track crosses each line in this frame, and
    ``cross_line_direction``: which way, null where it doesn't."""
    keys = by(stream, "frame_id", "track_id")
    way = F.col("direction") if "direction" in hits.columns else F.concat_ws(",", "horizontal", "vertical")
    per = hits.groupBy(*keys).agg(F.array(*(F.min(F.when(F.col("line_index") == k, way)) for k in range(n_lines))).alias("__c"))
    ways = F.coalesce("__c", F.array(*[F.lit(None).cast("string")] * n_lines))
    return df.join(per, keys, "left").withColumn("cross_line_direction", ways).withColumn("cross_line", F.transform("cross_line_direction", lambda d: d.isNotNull())).drop("__c")
