"""Name to query, and name to the SQL that gives the same rows, for the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from viewfold.functions import geometry as geo
from viewfold.functions import signal, text
from viewfold.functions.geometry import box, columns
from viewfold.functions.times import micros
from viewfold.functions.times import stage_durations, stamp
from viewfold.operators import catalog, evaluate, frames, lines, media, models, rules, suppress, tiles, tracking, zones
from viewfold.plans import graph
from viewfold.sources import sinks
from viewfold.sources import tables as src
from viewfold.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# the fixtures in SQL

DET = """det AS (
  SELECT l_orderkey AS frame_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS det_idx,
    l_returnflag AS label, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS category_id, ROUND(1.0 - l_discount*5 - l_tax, 4) AS score,
    CAST(l_partkey*7 % 561 AS DOUBLE) AS x1, CAST(l_suppkey*13 % 401 AS DOUBLE) AS y1,
    CAST(l_partkey*7 % 561 + 20 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS x2, CAST(l_suppkey*13 % 401 + 20 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS y2,
    l_partkey, l_suppkey, l_quantity FROM lineitem)"""
TRK = """k AS (SELECT greatest(5, count(DISTINCT user_id) // 3) AS k FROM events),
g AS (SELECT event_id // k AS frame_id, ts, user_id, event_type, value FROM events, k),
frm AS (SELECT frame_id, min(ts) AS ts FROM g GROUP BY frame_id),
trk AS (
  SELECT g.frame_id, frm.ts AS ts, user_id AS track_id, min(event_type) AS label, user_id % 8 AS stream_id,
    CAST((user_id*37 + g.frame_id*11) % 600 AS DOUBLE) AS x1, CAST((user_id*53 + g.frame_id*7) % 420 AS DOUBLE) AS y1,
    CAST((user_id*37 + g.frame_id*11) % 600 + 40 AS DOUBLE) AS x2, CAST((user_id*53 + g.frame_id*7) % 420 + 60 AS DOUBLE) AS y2,
    ROUND(max(value)/500.0, 4) AS score
  FROM g JOIN frm ON g.frame_id = frm.frame_id GROUP BY g.frame_id, frm.ts, user_id),
sfr AS (SELECT frm.frame_id, frm.ts, s.range AS stream_id FROM frm, range(8) s)"""
KEY = "stream_id"
BOXES = "x1, y1, x2, y2"


def det(spark, sf):
    return src.detections(spark, sf)


def trk(spark, sf):
    return src.tracks(spark, sf)


def stream_frames(t: DataFrame) -> DataFrame:
    return src.frames_of(t, src.STREAMS)


def rounded(df: DataFrame, names=("x1", "y1", "x2", "y2"), places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# box algebra


@query(f"WITH {DET} SELECT frame_id, det_idx, (x2 - x1) * (y2 - y1) AS area FROM det")
def box_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select("frame_id", "det_idx", geo.area(box()).alias("area"))


@query(f"WITH {DET} SELECT frame_id, det_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2, x1 + y1 + x2 + y1 + x2 + y2 + x1 + y2 AS corner_sum FROM det")
def box_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geo.to_center(box())
    back = geo.from_center(c)
    total = F.aggregate(geo.corners(box()), F.lit(0.0), lambda a, x: a + x)
    return det(spark, sf_dir).select("frame_id", "det_idx", *(v.alias(n) for v, n in zip(c, ("cx", "cy", "w", "h"))), *(v.alias("b" + n) for v, n in zip(back, ("x1", "y1", "x2", "y2"))), total.alias("corner_sum"))


@query(f"WITH {DET} SELECT frame_id, det_idx, x1 AS tl_x, y1 AS tl_y, (x1 + x2) / 2 AS bc_x, y2 AS bc_y, x2 AS cr_x, (y1 + y2) / 2 AS cr_y, CAST(320 AS INTEGER) AS frame_x, CAST(240 AS INTEGER) AS frame_y FROM det")
def anchor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for p, a in (("tl", "TOP_LEFT"), ("bc", "BOTTOM_CENTER"), ("cr", "CENTER_RIGHT")):
        x, y = geo.anchor(box(), a)
        out += [x.alias(f"{p}_x"), y.alias(f"{p}_y")]
    fx, fy = geo.frame_anchor(F.lit(640), F.lit(480), "CENTER")
    return det(spark, sf_dir).select("frame_id", "det_idx", *out, fx.alias("frame_x"), fy.alias("frame_y"))


_CLAMP = "greatest(0.0, least({m}, round_even({v}, 0)))"


def _extend_sql(dx: str, dy: str) -> str:
    v = [_CLAMP.format(m=m, v=e) for m, e in ((640.0, f"x1 - ({dx})"), (480.0, f"y1 - ({dy})"), (640.0, f"x2 + ({dx})"), (480.0, f"y2 + ({dy})"))]
    return f"WITH {DET}, s AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM det) SELECT frame_id, det_idx, {', '.join(f'{e} AS {n}' for e, n in zip(v, ('x1', 'y1', 'x2', 'y2')))} FROM s"


@query(_extend_sql("w * 0.15", "h * 0.15"))
def crop_extend_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select("frame_id", "det_idx", *columns(geo.extend(box(), "none", 30.0, 1.0, 640, 480)))


@query(_extend_sql("((CASE WHEN h > w THEN h * 1.25 * 1.5 ELSE w * 1.25 END) - w) / 2", "((CASE WHEN h > w THEN h * 1.25 ELSE w * 1.25 / 1.5 END) - h) / 2"))
def crop_extend_long_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select("frame_id", "det_idx", *columns(geo.extend(box(), "long_side", 25.0, 1.5, 640, 480)))


_TALL = "greatest(sqrt(w * h * 1.44 / 1.5), h)"


@query(_extend_sql(f"(greatest({_TALL} * 1.5, w) - w) / 2", f"(greatest({_TALL} * 1.5, w) / 1.5 - h) / 2"))
def crop_extend_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select("frame_id", "det_idx", *columns(geo.extend(box(), "area", 20.0, 1.5, 640, 480)))


@query(f"""WITH {DET}, r AS (SELECT frame_id, det_idx, round_even(x2 * 1.1 - 30.5, 0) AS a, round_even(y1 - 10.5, 0) AS b, round_even(x1 * 1.2 - 30.5, 0) AS c, round_even(y2 * 1.1, 0) AS d FROM det)
SELECT frame_id, det_idx, least(640.0, greatest(0.0, least(a, c))) AS x1, least(480.0, greatest(0.0, least(b, d))) AS y1, least(640.0, greatest(0.0, greatest(a, c))) AS x2, least(480.0, greatest(0.0, greatest(b, d))) AS y2
FROM r WHERE least(640.0, greatest(0.0, least(a, c))) <> least(640.0, greatest(0.0, greatest(a, c))) AND least(480.0, greatest(0.0, least(b, d))) <> least(480.0, greatest(0.0, greatest(b, d)))""")
def crop_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = (F.col("x2") * 1.1 - 30.5, F.col("y1") - 10.5, F.col("x1") * 1.2 - 30.5, F.col("y2") * 1.1)
    rect, ok = geo.crop_rect(b, 640, 480)
    return det(spark, sf_dir).where(ok).select("frame_id", "det_idx", *columns(rect))


@query(f"WITH {DET} SELECT frame_id, det_idx, round(x1 * 2.0 + 0.0, 4) AS x1, round(y1 * 2.0 - 160.0, 4) AS y1, round(x2 * 2.0 + 0.0, 4) AS x2, round(y2 * 2.0 - 160.0, 4) AS y2 FROM det")
def letterbox_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a 640 x 640 picture made from 1280 x 960 with bars above and below."""
    return rounded(det(spark, sf_dir).select("frame_id", "det_idx", *columns(geo.letterbox(box(), "letterbox", (1280, 960), (640, 640)))))


@query(f"WITH {DET} SELECT frame_id, det_idx, round(x1 * 1.5 + 160.0, 4) AS x1, round(y1 * 1.5, 4) AS y1, round(x2 * 1.5 + 160.0, 4) AS x2, round(y2 * 1.5, 4) AS y2 FROM det")
def crop_first_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(det(spark, sf_dir).select("frame_id", "det_idx", *columns(geo.letterbox(box(), "crop_first", (1280, 960), (640, 640)))))


_INTER = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1)"


@query(f"""WITH {DET}, p AS (SELECT a.frame_id, a.det_idx AS i, b.det_idx AS j, {_INTER} AS inter, {_AREA.format(p='a')} AS sa, {_AREA.format(p='b')} AS sb FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.det_idx < b.det_idx)
SELECT frame_id, i, j, round(inter / (sa + sb - inter), 6) AS iou FROM p WHERE inter / (sa + sb - inter) > 0""")
def frame_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.iou_pairs(det(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {DET}, p AS (SELECT a.frame_id, a.det_idx AS i, b.det_idx AS j, {_INTER} AS inter, least({_AREA.format(p='a')}, {_AREA.format(p='b')}) AS s FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.det_idx < b.det_idx)
SELECT frame_id, i, j, round(inter / s, 6) AS ios FROM p WHERE inter > 0""")
def ios_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir)
    a, b = d.alias("a"), d.alias("b")
    on = (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.det_idx") < F.col("b.det_idx"))
    return a.join(b, on).select(F.col("a.frame_id").alias("frame_id"), F.col("a.det_idx").alias("i"), F.col("b.det_idx").alias("j"), F.round(geo.ios(box("a."), box("b.")), 6).alias("ios")).where("ios > 0")


@query(f"""WITH {DET}, s AS (SELECT a.frame_id, a.det_idx AS i, b.det_idx AS j, sign((a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1)) AS p, sign((a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1)) AS q,
  sign((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1)) AS r, sign((b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1)) AS t FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.det_idx < b.det_idx)
SELECT frame_id, i, j FROM s WHERE p <> q AND r <> t""")
def diagonals_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir)
    pt = lambda t, k: (F.col(f"{t}.x{k}"), F.col(f"{t}.y{k}"))
    on = (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.det_idx") < F.col("b.det_idx"))
    hit = geo.segments_cross(pt("a", 1), pt("a", 2), pt("b", 1), pt("b", 2))
    return d.alias("a").join(d.alias("b"), on).where(hit).select(F.col("a.frame_id").alias("frame_id"), F.col("a.det_idx").alias("i"), F.col("b.det_idx").alias("j"))


# suppression and fusion


def _nms_sql(keys: str, over: str, where: str) -> str:
    on = " AND ".join(f"f.{k} = s.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE {DET}, s AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, det_idx, {BOXES}) AS rn FROM det WHERE {where}),
f AS (
  SELECT {keys}, CAST(1 AS BIGINT) AS rn, [{{'i': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM s WHERE rn = 1
  UNION ALL
  SELECT {', '.join(f'f.{k}' for k in keys.split(', '))}, s.rn, CASE WHEN list_bool_or(list_transform(f.kept, lambda k: {over})) THEN f.kept ELSE list_append(f.kept, {{'i': s.det_idx, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}}) END
  FROM f JOIN s ON {on} AND s.rn = f.rn + 1),
l AS (SELECT {keys}, arg_max(kept, rn) AS kept FROM f GROUP BY {keys}),
u AS (SELECT frame_id, unnest(kept).i AS det_idx FROM l)
SELECT det.frame_id, det.det_idx, label, score, {BOXES} FROM det JOIN u ON det.frame_id = u.frame_id AND det.det_idx = u.det_idx"""


def _over_sql(p: float, iou: bool) -> str:
    inter = f"greatest(0.0, least(k.x2, s.x2) - greatest(k.x1, s.x1) + {p}) * greatest(0.0, least(k.y2, s.y2) - greatest(k.y1, s.y1) + {p})"
    ka, sa = (f"({t}.x2 - {t}.x1 + {p}) * ({t}.y2 - {t}.y1 + {p})" for t in "ks")
    return f"{inter} / ({ka} + {sa} - {inter})" if iou else f"{inter} / least({ka}, {sa})"


_NMS_OUT = ["frame_id", "det_idx", "label", "score", "x1", "y1", "x2", "y2"]


@query(_nms_sql("frame_id, label", _over_sql(0.0, True) + " > 0.3", "score > 0"))
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.nms(det(spark, sf_dir)).select(*_NMS_OUT)


@query(_nms_sql("frame_id", _over_sql(0.0, True) + " > 0.2", "score > 0"))
def nms_class_agnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.nms(det(spark, sf_dir), 0.2, class_agnostic=True).select(*_NMS_OUT)


@query(_nms_sql("frame_id, label", _over_sql(1.0, False) + " > 0.4", "TRUE"))
def nms_ios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.nms(det(spark, sf_dir), 0.4, use_iou=False).select(*_NMS_OUT)


_PLACE = {
    "largest_area": (["s.x1", "s.y1", "s.x2", "s.y2"], ["CASE WHEN {l} THEN s.x1 ELSE k.c1 END", "CASE WHEN {l} THEN s.y1 ELSE k.c2 END", "CASE WHEN {l} THEN s.x2 ELSE k.c3 END", "CASE WHEN {l} THEN s.y2 ELSE k.c4 END"], "k.c{n}"),
    "average": (["s.x1 * s.score", "s.y1 * s.score", "s.x2 * s.score", "s.y2 * s.score"], ["k.c1 + s.x1 * s.score", "k.c2 + s.y1 * s.score", "k.c3 + s.x2 * s.score", "k.c4 + s.y2 * s.score"], "CASE WHEN k.cs <> 0 THEN k.c{n} / k.cs ELSE k.{b} END"),
    "merge": (["s.x1", "s.y1", "s.x2", "s.y2"], ["least(k.c1, s.x1)", "least(k.c2, s.y1)", "greatest(k.c3, s.x2)", "greatest(k.c4, s.y2)"], "k.c{n}"),
}


def _policy_sql(policy: str, threshold: float) -> str:
    """Each box joins the first kept box that it overlaps, which is what suppresses it."""
    start, join, place = _PLACE[policy]
    larger = "(s.x2 - s.x1 + 1) * (s.y2 - s.y1 + 1) >= (k.c3 - k.c1 + 1) * (k.c4 - k.c2 + 1)"
    own = lambda v, c, cs: "{'i': %s.i, 'score': %s.score, 'x1': %s.x1, 'y1': %s.y1, 'x2': %s.x2, 'y2': %s.y2, " % ((v,) * 6) + ", ".join(f"'c{n}': CAST({e} AS DOUBLE)" for n, e in enumerate(c, 1)) + f", 'cs': CAST({cs} AS DOUBLE)}}"
    new, grown = own("s", start, "s.score"), own("k", [e.format(l=larger) for e in join], "k.cs + s.score")
    return f"""WITH RECURSIVE {DET}, s AS (SELECT *, det_idx AS i, row_number() OVER (PARTITION BY frame_id, label ORDER BY score DESC, det_idx, {BOXES}) AS rn FROM det),
f AS (
  SELECT frame_id, label, CAST(1 AS BIGINT) AS rn, [{new}] AS kept FROM s WHERE rn = 1
  UNION ALL
  SELECT frame_id, label, rn, CASE WHEN pos > 0 THEN list_transform(kept, lambda k, j: CASE WHEN j = pos THEN {grown} ELSE k END) ELSE list_append(kept, {new}) END
  FROM (SELECT f.kept, s.*, coalesce(list_position(list_transform(f.kept, lambda k: {_over_sql(1.0, True)} > {threshold}), TRUE), 0) AS pos FROM f JOIN s ON f.frame_id = s.frame_id AND f.label = s.label AND s.rn = f.rn + 1) s),
l AS (SELECT frame_id, label, arg_max(kept, rn) AS kept FROM f GROUP BY ALL), u AS (SELECT frame_id, label, unnest(kept) AS k FROM l)
SELECT frame_id, k.i AS det_idx, label, k.score AS score, {', '.join(f"round({place.format(n=n, b=b)}, 7) AS {b}" for n, b in enumerate(('x1', 'y1', 'x2', 'y2'), 1))} FROM u"""


@query(_policy_sql("largest_area", 0.1))
def nms_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(suppress.nms(det(spark, sf_dir), 0.1, policy="largest_area").select(*_NMS_OUT), places=7)


@query(_policy_sql("average", 0.1))
def nms_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(suppress.nms(det(spark, sf_dir), 0.1, policy="average").select(*_NMS_OUT), places=7)


@query(_policy_sql("merge", 0.1))
def nms_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(suppress.nms(det(spark, sf_dir), 0.1, policy="merge").select(*_NMS_OUT), places=7)


def _fuse_sql(src_: str, threshold: float) -> str:
    """CTEs from ``src_`` (frame_id, label, category_id, det_idx, score, box) to fz, with n parts."""
    item = "{'i': s.i, 'score': s.score, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2, 'n': s.n, 'free': TRUE}"
    w, h = ("greatest(0.0, least(k.{c}2, s.{c}2) - greatest(k.{c}1, s.{c}1))".format(c=c) for c in "xy")
    side = lambda i, c: f"coalesce({i} / nullif((k.{c}2 - k.{c}1) + (s.{c}2 - s.{c}1) - {i}, 0), 0)"
    ratio = f"CASE WHEN k.free AND {w} > 0 AND {h} > 0 THEN greatest({side(w, 'x')}, {side(h, 'y')}) ELSE 0.0 END"
    both = "{'i': least(k.i, s.i), 'score': (k.score + s.score) / 2, 'x1': least(k.x1, s.x1), 'y1': least(k.y1, s.y1), 'x2': greatest(k.x2, s.x2), 'y2': greatest(k.y2, s.y2), 'n': k.n + s.n, 'free': FALSE}"
    out = [f"fs1 AS (SELECT frame_id, label, category_id, det_idx AS i, score, {BOXES}, CAST(1 AS INTEGER) AS n, row_number() OVER (PARTITION BY frame_id, label ORDER BY score DESC, det_idx, {BOXES}) AS rn FROM {src_})"]
    for k in (1, 2):
        out.append(f"""ff{k} AS (
  SELECT frame_id, label, category_id, CAST(1 AS BIGINT) AS rn, [{item}] AS kept FROM fs{k} s WHERE rn = 1
  UNION ALL
  SELECT frame_id, label, category_id, rn, CASE WHEN list_max(ratios) > {threshold} THEN list_transform(kept, lambda k, j: CASE WHEN j = list_position(ratios, list_max(ratios)) THEN {both} ELSE k END) ELSE list_append(kept, {item}) END
  FROM (SELECT f.kept, s.*, list_transform(f.kept, lambda k: {ratio}) AS ratios FROM ff{k} f JOIN fs{k} s ON f.frame_id = s.frame_id AND f.label = s.label AND s.rn = f.rn + 1) s),
fl{k} AS (SELECT frame_id, label, category_id, arg_max(kept, rn) AS kept FROM ff{k} GROUP BY ALL),
fs{k + 1} AS (SELECT frame_id, label, category_id, e.i AS i, e.score AS score, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2, e.n AS n, rn FROM (SELECT frame_id, label, category_id, unnest(kept) AS e, generate_subscripts(kept, 1) AS rn FROM fl{k}))""")
    return ", ".join([*out, "fz AS (SELECT * FROM fs3)"])


@query(f"WITH RECURSIVE {DET}, {_fuse_sql('(SELECT * FROM det WHERE score >= 0)', 0.55)} SELECT frame_id, label, category_id, round(score, 6) AS score, {BOXES}, n FROM fz")
def edge_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.fuse_edges(det(spark, sf_dir), 0.55).withColumn("score", F.round("score", 6))


# tiles

_SPREAD = """base AS (SELECT {c} AS c, {r} AS r, {tw} AS tw, {th} AS th),
cells AS (SELECT *, unnest(range(c)) AS col FROM base), grid AS (SELECT *, unnest(range(r)) AS row FROM cells)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, x AS x1, y AS y1, x + tw AS x2, y + th AS y2
FROM (SELECT *, CASE WHEN c > 1 THEN floor(col * ({w}.0 - tw) / (c - 1)) ELSE 0.0 END AS x, CASE WHEN r > 1 THEN floor(row * ({h}.0 - th) / (r - 1)) ELSE 0.0 END AS y FROM grid)"""


@query("WITH " + _SPREAD.format(c="CAST(1 + ceil((1920.0 - 640) / (640 * (1.0 - 0.01 * 15))) AS BIGINT)", r="CAST(1 + ceil((1080.0 - 480) / (480 * (1.0 - 0.01 * 10))) AS BIGINT)", tw="640.0::DOUBLE", th="480.0::DOUBLE", w=1920, h=1080))
def tiles_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.fixed_size(spark, (640, 480), (1920, 1080), (15, 10))


@query("WITH t AS (SELECT CAST(round_even(1920 / (1 + 3 * (1.0 - 0.01 * 15)), 0) AS DOUBLE) AS tw), t2 AS (SELECT tw, CAST(round_even(tw / 1.5, 0) AS DOUBLE) AS th FROM t), " + _SPREAD.format(c="4", r="CAST(1 + ceil((1080.0 - th) / (th * (1.0 - 0.01 * 10))) AS BIGINT)", tw="tw", th="th", w=1920, h=1080).replace("AS th),", "AS th FROM t2),", 1))
def tiles_fixed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.fixed_ratio(spark, 1.5, (4, 0), (1920, 1080), (15, 10))


GRID = tiles.TileGrid(3, 2, 0.1, 1.0, (640, 480), whole=True)
_TW, _TH, _GX, _GY = GRID.size()


def _span_sql(k: str, n: int, step: float, whole: int, grow: float) -> tuple[str, str]:
    a = f"{k} * {step * (1 - GRID.overlap)!r}"
    b = f"CASE WHEN {k} = {n - 1} THEN {float(whole)!r} ELSE {a} + {step!r} END"
    before = f"CASE WHEN {k} = 0 THEN 0.0 WHEN {k} = {n - 1} THEN {grow!r} ELSE {grow / 2!r} END"
    after = f"CASE WHEN {k} = 0 THEN {grow!r} WHEN {k} = {n - 1} THEN 0.0 ELSE {grow / 2!r} END"
    return f"round_even(CAST({a} - ({before}) AS DOUBLE), 0)", f"round_even(CAST(({b}) + ({after}) AS DOUBLE), 0)"


_SX, _SY = _span_sql("col", 3, _TW, 640, _GX), _span_sql("row", 2, _TH, 480, _GY)
TILES = f"""tl AS (SELECT tile_id, row, col, 'LOCAL' AS label, {_SX[0]} AS x1, {_SY[0]} AS y1, {_SX[1]} AS x2, {_SY[1]} AS y2
  FROM (SELECT range AS tile_id, CAST(range // 3 AS INTEGER) AS row, CAST(range % 3 AS INTEGER) AS col FROM range(6))
  UNION ALL SELECT -999, -1, -1, 'GLOBAL', 0.0, 0.0, 640.0, 480.0)"""


@query(f"WITH {TILES} SELECT tile_id, row, col, label, x1, y1, x2, y2 FROM tl")
def tile_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.frame(spark)


def _in_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of each tile in its coordinates, as if a model had run there: boxes whose centre
    falls in the tile."""
    t = F.broadcast(GRID.frame(spark).select("tile_id", *(F.col(n).alias("t" + n) for n in ("x1", "y1", "x2", "y2"))))
    cx, cy = geo.anchor(box(), "CENTER")
    inside = (cx >= F.col("tx1")) & (cx < F.col("tx2")) & (cy >= F.col("ty1")) & (cy < F.col("ty2"))
    found = det(spark, sf_dir).join(t, inside)
    return found.withColumns({"x1": F.col("x1") - F.col("tx1"), "y1": F.col("y1") - F.col("ty1"), "x2": F.col("x2") - F.col("tx1"), "y2": F.col("y2") - F.col("ty1")}).drop("tx1", "ty1", "tx2", "ty2")


_TILED = f"""{DET}, {TILES}, loc AS (
  SELECT d.frame_id, d.det_idx, d.label, d.category_id, d.score, tile_id, tl.label AS tile_label, row, col, d.x1 - tl.x1 AS x1, d.y1 - tl.y1 AS y1, d.x2 - tl.x1 AS x2, d.y2 - tl.y1 AS y2, tl.x1 AS ox, tl.y1 AS oy
  FROM det d JOIN tl ON (d.x1 + d.x2) / 2 >= tl.x1 AND (d.x1 + d.x2) / 2 < tl.x2 AND (d.y1 + d.y2) / 2 >= tl.y1 AND (d.y1 + d.y2) / 2 < tl.y2)"""


@query(f"WITH {_TILED} SELECT frame_id, det_idx, tile_id, x1 + ox AS x1, y1 + oy AS y1, x2 + ox AS x2, y2 + oy AS y2 FROM loc")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.to_image(_in_tiles(spark, sf_dir), GRID.frame(spark)).select("frame_id", "det_idx", "tile_id", *geo.box())


@query(f"WITH {_TILED} SELECT frame_id, det_idx, tile_id FROM loc WHERE CASE WHEN tile_label = 'GLOBAL' THEN (x2 - x1) * (y2 - y1) >= 640.0 * 480.0 * 0.01 * 0.1 * 5 ELSE (x2 - x1) * (y2 - y1) < 640.0 * 480.0 * 0.01 END")
def local_global_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = tiles.to_image(_in_tiles(spark, sf_dir), GRID.frame(spark))
    return tiles.split_by_size(moved, (640, 480), 0.1).select("frame_id", "det_idx", "tile_id")


_EW, _EH = _TW + _GX, _TH + _GY


@query(f"""WITH {_TILED} SELECT frame_id, det_idx, tile_id, (x1 - 1 <> x2 + 1 AND y1 - 1 <> y2 + 1) AND (
  (tile_id % 3 <> 0 AND x1 - 1 <= {_EW * 0.02!r} AND x2 + 1 >= 0) OR (tile_id % 3 <> 2 AND x2 + 1 >= {_EW * 0.98!r} AND x1 - 1 <= {_EW!r})
  OR (tile_id // 3 <> 0 AND y1 - 1 <= {_EH * 0.02!r} AND y2 + 1 >= 0) OR (tile_id // 3 <> 1 AND y2 + 1 >= {_EH * 0.98!r} AND y1 - 1 <= {_EH!r})) AS edge FROM loc WHERE tile_id >= 0""")
def edge_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _in_tiles(spark, sf_dir).where("tile_id >= 0")
    return found.select("frame_id", "det_idx", "tile_id", tiles.on_inner_edge(box(), F.col("tile_id"), GRID).alias("edge"))


_EDGE = f"""(x1 - 1 <> x2 + 1 AND y1 - 1 <> y2 + 1) AND (
  (tile_id % 3 <> 0 AND x1 - 1 <= {_EW * 0.02!r} AND x2 + 1 >= 0) OR (tile_id % 3 <> 2 AND x2 + 1 >= {_EW * 0.98!r} AND x1 - 1 <= {_EW!r})
  OR (tile_id // 3 <> 0 AND y1 - 1 <= {_EH * 0.02!r} AND y2 + 1 >= 0) OR (tile_id // 3 <> 1 AND y2 + 1 >= {_EH * 0.98!r} AND y1 - 1 <= {_EH!r}))"""


@query(f"""WITH RECURSIVE {_TILED}, mv AS (SELECT frame_id, det_idx, label, category_id, score, x1 + ox AS x1, y1 + oy AS y1, x2 + ox AS x2, y2 + oy AS y2, tile_id >= 0 AND {_EDGE} AS edge FROM loc
  WHERE CASE WHEN tile_label = 'GLOBAL' THEN (x2 - x1) * (y2 - y1) >= 640.0 * 480.0 * 0.01 * 0.1 * 5 ELSE (x2 - x1) * (y2 - y1) < 640.0 * 480.0 * 0.01 END),
{_fuse_sql('(SELECT * FROM mv WHERE edge AND score >= 0)', 0.8)},
al AS (SELECT frame_id, det_idx, label, category_id, score, {BOXES} FROM mv WHERE NOT edge UNION ALL SELECT frame_id, i, label, category_id, score, {BOXES} FROM fz),
s AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label ORDER BY score DESC, det_idx, {BOXES}) AS rn FROM al WHERE score > 0),
f AS (
  SELECT frame_id, label, CAST(1 AS BIGINT) AS rn, [{{'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM s WHERE rn = 1
  UNION ALL
  SELECT f.frame_id, f.label, s.rn, CASE WHEN list_bool_or(list_transform(f.kept, lambda k: {_over_sql(0.0, True)} > 0.3)) THEN f.kept ELSE list_append(f.kept, {{'score': s.score, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}}) END
  FROM f JOIN s ON f.frame_id = s.frame_id AND f.label = s.label AND s.rn = f.rn + 1),
l AS (SELECT frame_id, label, arg_max(kept, rn) AS kept FROM f GROUP BY ALL), u AS (SELECT frame_id, label, unnest(kept) AS k FROM l)
SELECT frame_id, label, round(k.score, 6) AS score, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM u""")
def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.merge_tiles(_in_tiles(spark, sf_dir), GRID.frame(spark), GRID, large=0.01, fusion=0.8).select("frame_id", "label", F.round("score", 6).alias("score"), *box())


@query(f"WITH {TILES} SELECT tile_id, row, col, x1, y1, x2, y2 FROM tl WHERE tile_id IN (0, 2, 5)")
def tile_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.TileGrid(3, 2, 0.1, 1.0, (640, 480), mask=(0, 2, 5)).frame(spark).select("tile_id", "row", "col", *box())


@query(f"""WITH {TRK}, r(roi_index, label, x1, y1, x2, y2) AS (VALUES (0, 'ROI0', 0.0, 0.0, 320.0, 240.0), (1, 'ROI1', 320.0, 240.0, 640.0, 480.0))
SELECT frame_id, roi_index, r.label, CAST(1.0 AS DOUBLE) AS score, CAST(r.x1 AS DOUBLE) AS x1, CAST(r.y1 AS DOUBLE) AS y1, CAST(r.x2 AS DOUBLE) AS x2, CAST(r.y2 AS DOUBLE) AS y2 FROM frm, r""")
def roi_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.rois_on_frames(src.frames_of(trk(spark, sf_dir)), [(0, 0, 320, 240), (320, 240, 640, 480)])


@query(f"""WITH {TRK}, r(roi_index, label, x1, y1, x2, y2) AS (VALUES (0, 'ROI0', 0.0, 0.0, 320.0, 240.0), (1, 'ROI1', 320.0, 240.0, 640.0, 480.0)),
c AS (SELECT frm.frame_id, roi_index, r.label, (r.x2 - r.x1) * (r.y2 - r.y1) AS a, count(*) FILTER (WHERE trk.x1 >= r.x1 AND trk.x1 < r.x2 AND trk.y1 >= r.y1 AND trk.y1 < r.y2) AS changed FROM frm CROSS JOIN r LEFT JOIN trk ON trk.frame_id = frm.frame_id GROUP BY ALL)
SELECT frame_id, roi_index, label, changed FROM c WHERE frame_id < 1 OR changed > 0.00012 * a""")
def motion_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    rois = tiles.rois_on_frames(src.frames_of(t), [(0, 0, 320, 240), (320, 240, 640, 480)])
    pixels = t.select("frame_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return tiles.motion_gate(rois, pixels, 0.00012).select("frame_id", "roi_index", "label", "changed")


# selection and counts per frame


@query(f"WITH {DET} SELECT frame_id, det_idx, score, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_idx) AS INTEGER) AS rank FROM det QUALIFY rank <= 2")
def topk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.select_best(det(spark, sf_dir), 2).select("frame_id", "det_idx", "score", "rank")


@query(f"WITH {DET} SELECT frame_id, det_idx, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY (x2 - x1) * (y2 - y1) DESC, det_idx) AS INTEGER) AS rank FROM det QUALIFY rank <= 1")
def topk_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.select_best(det(spark, sf_dir), 1, strategy="largest_area").select("frame_id", "det_idx", "rank")


@query(f"WITH {DET} SELECT frame_id, det_idx, score FROM det WHERE score > 0.8")
def threshold_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.select_best(det(spark, sf_dir), 0, 0.8).select("frame_id", "det_idx", "score")


@query(f"WITH {DET} SELECT frame_id, det_idx, label, CASE WHEN label IN ('A', 'N') THEN score ELSE 0.0 END AS score FROM det")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.exclude_classes(det(spark, sf_dir), ["A", "N"]).select("frame_id", "det_idx", "label", "score")


@query(f"WITH {TRK} SELECT frame_id, track_id, concat_ws(' ', label, '#' || track_id) AS overlay FROM trk WHERE label IN ('click', 'view', 'purchase')")
def overlay_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.overlay_labels(frames.class_filter(trk(spark, sf_dir), ["click", "view", "purchase"], True)).select("frame_id", "track_id", "overlay")


@query(f"WITH {TRK} SELECT sfr.stream_id, sfr.frame_id, CAST(count(trk.track_id) AS DOUBLE) AS value FROM sfr LEFT JOIN trk ON sfr.frame_id = trk.frame_id AND sfr.stream_id = trk.stream_id AND trk.score >= 0.2 GROUP BY ALL")
def object_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    return rules.object_count(stream_frames(t), t, None, 0.2, key=KEY).select(KEY, "frame_id", "value")


@query(f"WITH {DET} SELECT frame_id, label, count(*) AS n FROM det WHERE score >= 0.5 GROUP BY frame_id, label")
def class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).where("score >= 0.5").groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"))


# zones


def _poly_sql(poly: list[tuple[int, int]], x: str, y: str) -> str:
    px, py = f"ceil({x})", f"ceil({y})"
    on, odd = [], []
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        on.append(f"(({px} - {ax}.0) * {by - ay}.0 - ({py} - {ay}.0) * {bx - ax}.0 = 0 AND {px} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {py} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        if ay != by:
            odd.append(f"CAST(({py} < {ay}) <> ({py} < {by}) AND {px} < ({py} - {ay}.0) * CAST({(bx - ax) / (by - ay)!r} AS DOUBLE) + {ax}.0 AS INTEGER)")
    return f"({' OR '.join(on)} OR ({' + '.join(odd)}) % 2 = 1)"


_CX, _BY = "(least(640.0, greatest(0.0, x1)) + least(640.0, greatest(0.0, x2))) / 2", "least(480.0, greatest(0.0, y2))"
_ZC = [f"SELECT *, {k} AS zone_index, '{n}' AS zone_id, {_poly_sql(p, _CX, _BY)} AS hit FROM trk" for k, (n, p) in enumerate(src.ZONES.items())]
MARK = f"mark AS ({' UNION ALL '.join(_ZC)})"


@query(f"WITH {TRK}, {MARK} SELECT frame_id, track_id, zone_index, zone_id, hit FROM mark")
def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.mark(trk(spark, sf_dir), src.ZONES).select("frame_id", "track_id", "zone_index", "zone_id", "hit")


@query(f"""WITH {TRK} SELECT frame_id, track_id, round(greatest(0.0, least(x2, 400.0) - greatest(x1, 100.0)) * greatest(0.0, least(y2, 400.0) - greatest(y1, 100.0)) / 90000.0, 6) AS share,
  greatest(0.0, least(x2, 400.0) - greatest(x1, 100.0)) * greatest(0.0, least(y2, 400.0) - greatest(y1, 100.0)) / 90000.0 > 0.02 AS hit FROM trk""")
def iopa_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = geo.iopa(box(), src.ZONES["dock"])
    return trk(spark, sf_dir).select("frame_id", "track_id", F.round(share, 6).alias("share"), (share > 0.02).alias("hit"))


#: The diamond's height over x lies between 60 + |x - 320| 3/4 and 420 - |x - 320| 3/4; between the places where a bound changes, the common height is linear in x.
_BENDS = ", ".join(["x1", "x2", "80.0", "320.0", "560.0", *(f"320.0 {s} (420.0 - {y}) / 0.75" for y in ("y1", "y2") for s in "+-"), *(f"320.0 {s} ({y} - 60.0) / 0.75" for y in ("y1", "y2") for s in "+-")])
_HIGH = "greatest(0.0, least(y2, 420.0 - abs({x} - 320.0) * 0.75) - greatest(y1, 60.0 + abs({x} - 320.0) * 0.75))"


@query(f"""WITH {TRK}, b AS (SELECT *, list_sort(list_transform([{_BENDS}], lambda v: greatest(greatest(x1, 80.0), least(least(x2, 560.0), v)))) AS p FROM trk),
e AS (SELECT frame_id, track_id, y1, y2, p[i] AS a, p[i + 1] AS b FROM (SELECT *, unnest(range(1, len(p))) AS i FROM b))
SELECT frame_id, track_id, round(sum((b - a) * ({_HIGH.format(x='a')} + {_HIGH.format(x='b')}) / 2) / 86400.0, 6) AS share FROM e GROUP BY ALL""")
def iopa_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trk(spark, sf_dir).select("frame_id", "track_id", F.round(geo.iopa(box(), src.ZONES["diamond"]), 6).alias("share"))


@query(f"WITH {TRK}, {MARK} SELECT stream_id, frame_id, zone_index, zone_id, label, count(*) AS cnt FROM mark WHERE hit GROUP BY GROUPING SETS ((stream_id, frame_id, zone_index, zone_id, label), (stream_id, frame_id, zone_index, zone_id))")
def zone_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.untracked_counts(zones.mark(trk(spark, sf_dir), src.ZONES), (KEY, "frame_id"))


def _zone_agg_sql(agg: str) -> str:
    return f"""WITH {TRK}, {MARK}, c AS (SELECT stream_id, frame_id, zone_index, count(*) AS c FROM mark WHERE hit GROUP BY ALL),
    grid AS (SELECT stream_id, frame_id, z FROM sfr, (VALUES (0), (1), (2)) v(z)), f AS (SELECT grid.stream_id, grid.frame_id, coalesce(c.c, 0) AS c FROM grid LEFT JOIN c ON c.stream_id = grid.stream_id AND c.frame_id = grid.frame_id AND c.zone_index = z)
    SELECT stream_id, frame_id, round(CAST({agg} AS DOUBLE), 6) AS value FROM f GROUP BY ALL"""


def _zone_agg(agg: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = trk(spark, sf_dir)
        counts = zones.untracked_counts(zones.mark(t, src.ZONES), (KEY, "frame_id")).where("label is null")
        return rules.zone_count(counts, stream_frames(t), list(src.ZONES), aggregation=agg, key=KEY).select(KEY, "frame_id", F.round("value", 6).alias("value"))

    run.__name__ = f"zone_count_{agg}"
    return run


for _a, _s in (("sum", "sum(c)"), ("max", "max(c)"), ("min", "min(c)"), ("mean", "avg(c)"), ("std", "stddev_pop(c)")):
    query(_zone_agg_sql(_s))(_zone_agg(_a))

TIMEOUT = 2
_M = TIMEOUT + 1
#: The counter of each (zone, track) along its sightings, as a recursion; hl is the label the episode began with.
HYST = f"""q AS (SELECT stream_id, zone_index, zone_id, track_id, label, frame_id, hit, row_number() OVER (PARTITION BY zone_index, track_id ORDER BY frame_id) AS n, lead(frame_id) OVER (PARTITION BY zone_index, track_id ORDER BY frame_id) AS next_frame FROM mark),
h AS (
  SELECT zone_index, track_id, n, frame_id, CASE WHEN hit THEN 1 ELSE 0 END AS c, CASE WHEN hit AND {_M} = 1 THEN frame_id END AS since, CAST(NULL AS BIGINT) AS left_at, CAST(NULL AS BIGINT) AS left_since, CASE WHEN hit THEN label END AS hl, CAST(NULL AS VARCHAR) AS left_label FROM q WHERE n = 1
  UNION ALL
  SELECT zone_index, track_id, n, frame_id, c2, CASE WHEN c2 = 0 THEN NULL WHEN s1 IS NOT NULL THEN s1 WHEN hit AND c2 = {_M} THEN frame_id END,
    CASE WHEN c > 0 AND c1 = 0 AND since IS NOT NULL THEN pf + c WHEN NOT hit AND c1 > 0 AND c2 = 0 AND s1 IS NOT NULL THEN frame_id END,
    CASE WHEN c > 0 AND c1 = 0 AND since IS NOT NULL THEN since WHEN NOT hit AND c1 > 0 AND c2 = 0 AND s1 IS NOT NULL THEN s1 END,
    CASE WHEN hit AND c1 = 0 THEN label ELSE hl END, hl
  FROM (SELECT *, CASE WHEN hit THEN least({_M}, c1 + 1) ELSE greatest(0, c1 - 1) END AS c2, CASE WHEN c1 = 0 THEN NULL ELSE since END AS s1
    FROM (SELECT q.zone_index, q.track_id, q.n, q.frame_id, q.hit, q.label, h.hl, h.c, h.since, h.frame_id AS pf, CAST(greatest(0, h.c - (q.frame_id - h.frame_id - 1)) AS INTEGER) AS c1
      FROM h JOIN q ON q.zone_index = h.zone_index AND q.track_id = h.track_id AND q.n = h.n + 1))),
hs AS (SELECT h.*, q.zone_id, q.next_frame, q.stream_id, q.hit, q.label FROM h JOIN q ON q.zone_index = h.zone_index AND q.track_id = h.track_id AND q.n = h.n)"""


def _states(spark, sf_dir):
    t = trk(spark, sf_dir)
    return zones.hysteresis(zones.mark(t, src.ZONES), TIMEOUT, KEY), stream_frames(t)


@query(f"WITH RECURSIVE {TRK}, {MARK}, {HYST} SELECT stream_id, zone_index, zone_id, track_id, frame_id, CAST(c AS INTEGER) AS counter, since IS NOT NULL AS in_zone, CASE WHEN since IS NULL THEN 0 ELSE frame_id - since + 1 END AS frames_in_zone FROM hs")
def zone_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)[0].select(KEY, "zone_index", "zone_id", "track_id", "frame_id", "counter", "in_zone", F.col("frames_in_zone").cast("long").alias("frames_in_zone"))


@query(f"WITH RECURSIVE {TRK}, {MARK}, {HYST} SELECT zone_index, track_id, hs.frame_id, epoch_us(a.ts) - epoch_us(b.ts) AS time_in_zone FROM hs JOIN frm a ON a.frame_id = hs.frame_id LEFT JOIN frm b ON b.frame_id = hs.since")
def time_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = _states(spark, sf_dir)
    return zones.with_times(s, f, KEY).select("zone_index", "track_id", "frame_id", "time_in_zone")


OCC = """held AS (
  SELECT stream_id, zone_index, frame_id, CASE WHEN hit THEN label ELSE hl END AS label FROM hs WHERE since IS NOT NULL
  UNION ALL SELECT stream_id, zone_index, unnest(range(frame_id + 1, least(coalesce(next_frame, 1152921504606846976), frame_id + c))), hl FROM hs WHERE since IS NOT NULL AND c > 1 AND coalesce(next_frame, 1152921504606846976) > frame_id + 1),
occ AS (SELECT stream_id, zone_index, frame_id, count(*) AS total, count(*) FILTER (WHERE label = 'click') AS n_click, count(*) FILTER (WHERE label = 'purchase') AS n_purchase FROM held GROUP BY ALL),
zn(zone_index, zone_id) AS (VALUES (0, 'dock'), (1, 'gate'), (2, 'diamond')),
od AS (SELECT sfr.stream_id, zn.zone_index, zn.zone_id, sfr.frame_id, epoch_us(sfr.ts) AS us, coalesce(occ.total, 0) AS total, coalesce(n_click, 0) AS n_click, coalesce(n_purchase, 0) AS n_purchase
  FROM sfr CROSS JOIN zn LEFT JOIN occ ON occ.stream_id = sfr.stream_id AND occ.zone_index = zn.zone_index AND occ.frame_id = sfr.frame_id)"""


@query(f"WITH RECURSIVE {TRK}, {MARK}, {HYST}, {OCC} SELECT stream_id, zone_index, zone_id, frame_id, total FROM od")
def zone_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = _states(spark, sf_dir)
    return zones.occupancy(s, f, src.ZONES, KEY).select(KEY, "zone_index", "zone_id", "frame_id", "total")


@query(f"WITH RECURSIVE {TRK}, {MARK}, {HYST}, {OCC} SELECT stream_id, zone_index, frame_id, total, n_click AS class_click, n_purchase AS class_purchase FROM od")
def zone_class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = _states(spark, sf_dir)
    return zones.occupancy(s, f, src.ZONES, KEY, ["click", "purchase"]).select(KEY, "zone_index", "frame_id", "total", "class_click", "class_purchase")


@query(f"""WITH RECURSIVE {TRK}, {MARK}, {HYST}, {OCC},
tu AS (SELECT *, total > 0 AS busy, coalesce(lag(total > 0) OVER w, FALSE) AS was, row_number() OVER w AS n, min(us) OVER (PARTITION BY stream_id, zone_index) AS us0 FROM od WINDOW w AS (PARTITION BY stream_id, zone_index ORDER BY frame_id)),
tv AS (SELECT *, last_value(CASE WHEN busy <> was THEN us END IGNORE NULLS) OVER (PARTITION BY stream_id, zone_index ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ch FROM tu),
ex AS (SELECT stream_id, zone_index, zone_id, track_id, left_label, left_at AS frame_id, left_since AS since FROM hs WHERE left_at IS NOT NULL UNION ALL SELECT stream_id, zone_index, zone_id, track_id, hl, frame_id + c, since FROM hs WHERE since IS NOT NULL AND next_frame IS NULL)
SELECT 'zone_entry' AS event_type, stream_id, zone_index, zone_id, hs.frame_id, epoch_us(a.ts) AS timestamp_us, track_id, label AS object_label, CAST(NULL AS BIGINT) AS dwell_us FROM hs JOIN frm a ON a.frame_id = hs.frame_id WHERE since = hs.frame_id
UNION ALL SELECT 'zone_exit', stream_id, zone_index, zone_id, ex.frame_id, epoch_us(a.ts), track_id, left_label, epoch_us(a.ts) - epoch_us(b.ts) FROM ex JOIN frm a ON a.frame_id = ex.frame_id JOIN frm b ON b.frame_id = ex.since
UNION ALL SELECT CASE WHEN busy THEN 'zone_occupied' ELSE 'zone_empty' END, stream_id, zone_index, zone_id, frame_id, us, NULL, NULL, us - CASE WHEN n > 1 THEN coalesce(ch, us0) END FROM tv WHERE busy <> was""")
def zone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = _states(spark, sf_dir)
    return zones.zone_events(s, f, src.ZONES, KEY)


# trails and lines

TRL = """c0 AS (SELECT stream_id, frame_id, ts, track_id, label, CAST(trunc(x1) AS BIGINT) AS x1, CAST(trunc(y1) AS BIGINT) AS y1, CAST(trunc(x2) AS BIGINT) AS x2, CAST(trunc(y2) AS BIGINT) AS y2,
    CASE WHEN frame_id - lag(frame_id) OVER w - 1 >= 8 OR lag(frame_id) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
c1 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY track_id ORDER BY frame_id) AS BIGINT) AS session FROM c0),
trl AS (SELECT stream_id, frame_id, ts, track_id, session, x1, y1, x2, y2, first_value(label) OVER w AS label, row_number() OVER w AS points,
    first_value(x1) OVER t AS sx1, first_value(x2) OVER t AS sx2, first_value(y2) OVER t AS sy2, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2
  FROM c1 WINDOW w AS (PARTITION BY track_id, session ORDER BY frame_id), t AS (PARTITION BY track_id, session ORDER BY frame_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {TRK}, {TRL} SELECT frame_id, track_id, session, label, CAST(points AS INTEGER) AS points, sx1, sy2, x1, y2, CAST(least(points, 10) AS INTEGER) AS kept FROM trl")
def trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.trails(trk(spark, sf_dir), keep=True).select("frame_id", "track_id", "session", "label", "points", "sx1", "sy2", "x1", "y2", F.size("trail").alias("kept"))


def _cross_sql(p: str) -> str:
    sel = []
    for k, (x1, y1, x2, y2) in enumerate(src.LINES):
        sel.append(f"SELECT *, {k} AS line_index, {float(x1)} AS lx1, {float(y1)} AS ly1, {float(x2)} AS lx2, {float(y2)} AS ly2 FROM v")
    side = lambda ax, ay, bx, by, px, py: f"sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"
    hit = f"{side('lx1', 'ly1', 'lx2', 'ly2', 'pax', 'pay')} <> {side('lx1', 'ly1', 'lx2', 'ly2', 'pbx', 'pby')} AND {side('pax', 'pay', 'pbx', 'pby', 'lx1', 'ly1')} <> {side('pax', 'pay', 'pbx', 'pby', 'lx2', 'ly2')}"
    cross = "((pbx - pax) * (ly2 - ly1) - (pby - pay) * (lx2 - lx1))"
    return f"""v AS (SELECT stream_id, frame_id, ts, track_id, session, label, ({p}x1 + {p}x2) / 2.0 AS pax, {p}y2 AS pay, (x1 + x2) / 2.0 AS pbx, y2 AS pby FROM trl WHERE points > 1),
lv AS ({' UNION ALL '.join(sel)}),
cr AS (SELECT stream_id, frame_id, ts, track_id, session, label, line_index, CASE WHEN {cross} > 0 THEN 'left' WHEN {cross} < 0 THEN 'right' WHEN sign(pbx - pax) = sign(lx2 - lx1) AND sign(pby - pay) = sign(ly2 - ly1) THEN 'left' ELSE 'right' END AS direction,
  CASE WHEN pbx - pax < 0 THEN 'left' ELSE 'right' END AS horizontal, CASE WHEN pby - pay < 0 THEN 'top' ELSE 'bottom' END AS vertical FROM lv WHERE {hit})"""


_FIRST = "f1 AS (SELECT *, row_number() OVER (PARTITION BY track_id, session, line_index ORDER BY frame_id) AS rn FROM cr)"


@query(f"WITH {TRK}, {TRL}, {_cross_sql('s')}, {_FIRST} SELECT frame_id, track_id, session, label, line_index, direction FROM f1 WHERE rn = 1")
def line_cross_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.crossings(lines.trails(trk(spark, sf_dir)), src.LINES).drop("ts")


@query(f"WITH {TRK}, {TRL}, {_cross_sql('p')} SELECT frame_id, track_id, session, label, line_index, horizontal, vertical FROM cr")
def line_cross_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.crossings(lines.trails(trk(spark, sf_dir)), src.LINES, whole_trail=False, first_only=False, absolute=True).drop("ts")


_PER_LINE = "SELECT stream_id, frame_id, line_index, count(*) FILTER (WHERE direction = 'left') AS l, count(*) FILTER (WHERE direction = 'right') AS r, count(*) FILTER (WHERE direction = 'left' AND label = 'view') AS vl, count(*) FILTER (WHERE direction = 'right' AND label = 'view') AS vr FROM f1 WHERE rn = 1 GROUP BY ALL"


@query(f"""WITH {TRK}, {TRL}, {_cross_sql('p')}, {_FIRST}, n AS ({_PER_LINE}),
gr AS (SELECT stream_id, frame_id, z AS line_index FROM sfr, (VALUES (0), (1), (2)) v(z))
SELECT gr.stream_id, gr.frame_id, gr.line_index, CAST(sum(coalesce(l, 0)) OVER w AS BIGINT) AS "left", CAST(sum(coalesce(r, 0)) OVER w AS BIGINT) AS "right", CAST(sum(coalesce(vl, 0)) OVER w AS BIGINT) AS view_left, CAST(sum(coalesce(vr, 0)) OVER w AS BIGINT) AS view_right
FROM gr LEFT JOIN n ON n.stream_id = gr.stream_id AND n.frame_id = gr.frame_id AND n.line_index = gr.line_index WINDOW w AS (PARTITION BY gr.stream_id, gr.line_index ORDER BY gr.frame_id)""")
def line_counts_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    return lines.running_counts(lines.crossings(lines.trails(t, stream=KEY), src.LINES, whole_trail=False, stream=KEY), stream_frames(t), len(src.LINES), classes=["view"], stream=KEY)


@query(f"""WITH {TRK}, {TRL}, {_cross_sql('p')}, n AS (SELECT stream_id, frame_id, line_index, count(*) FILTER (WHERE horizontal = 'left') AS l, count(*) FILTER (WHERE horizontal = 'right') AS r, count(*) FILTER (WHERE vertical = 'top') AS t, count(*) FILTER (WHERE vertical = 'bottom') AS b FROM cr GROUP BY ALL),
gr AS (SELECT stream_id, frame_id, z AS line_index FROM sfr, (VALUES (0), (1), (2)) v(z))
SELECT gr.stream_id, gr.frame_id, gr.line_index, coalesce(l, 0) AS "left", coalesce(r, 0) AS "right", coalesce(t, 0) AS top, coalesce(b, 0) AS bottom FROM gr LEFT JOIN n ON n.stream_id = gr.stream_id AND n.frame_id = gr.frame_id AND n.line_index = gr.line_index""")
def line_counts_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    hits = lines.crossings(lines.trails(t, stream=KEY), src.LINES, whole_trail=False, first_only=False, absolute=True, stream=KEY)
    return lines.running_counts(hits, stream_frames(t), len(src.LINES), accumulate=False, directions=("left", "right", "top", "bottom"), stream=KEY)


@query(f"""WITH {TRK}, {TRL}, {_cross_sql('p')}, fl AS (SELECT frame_id, track_id, line_index, min(direction) AS way FROM cr GROUP BY ALL)
SELECT trk.frame_id, trk.track_id, {', '.join(f"bool_or(coalesce(line_index = {k}, FALSE)) AS line{k}, min(way) FILTER (WHERE line_index = {k}) AS way{k}" for k in range(3))} FROM trk LEFT JOIN fl ON fl.frame_id = trk.frame_id AND fl.track_id = trk.track_id GROUP BY ALL""")
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    hits = lines.crossings(lines.trails(t), src.LINES, whole_trail=False, first_only=False)
    return lines.flag_objects(t, hits, 3).select("frame_id", "track_id", *(F.col(c)[k].alias(f"{n}{k}") for k in range(3) for c, n in (("cross_line", "line"), ("cross_line_direction", "way"))))


@query(f"""WITH {TRK}, {TRL}, {_cross_sql('s')}, nx AS (SELECT track_id, frame_id, coalesce(lead(frame_id) OVER (PARTITION BY track_id ORDER BY frame_id), 1152921504606846976) AS nf FROM trk),
e AS (SELECT track_id, session, label, line_index, direction, unnest(range(cr.frame_id, greatest(cr.frame_id, least(nf - 1, cr.frame_id + 7)) + 1)) AS frame_id FROM cr JOIN nx USING (track_id, frame_id))
SELECT e.frame_id, track_id, session, label, line_index, direction FROM e JOIN frm ON frm.frame_id = e.frame_id""")
def line_cross_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    return lines.repeated_crossings(lines.trails(t), src.frames_of(t), src.LINES, whole_trail=True).drop("ts")


# events and notifications

OBJ = f"{TRK}, ob AS (SELECT sfr.stream_id, sfr.frame_id, sfr.ts, CAST(count(trk.track_id) AS DOUBLE) AS value FROM sfr LEFT JOIN trk ON sfr.stream_id = trk.stream_id AND sfr.frame_id = trk.frame_id AND trk.score >= 0.2 GROUP BY ALL)"
_COND = "cn AS (SELECT *, CAST(value > (SELECT avg(value) FROM ob) AS INTEGER) AS hit FROM ob)"
_BY = "PARTITION BY stream_id ORDER BY"


def _metric(spark, sf_dir):
    """Objects of high score per stream and frame, less their mean: positive in busy frames."""
    t = trk(spark, sf_dir)
    m = rules.object_count(stream_frames(t), t, None, 0.2, key=KEY)
    mean = m.agg(F.avg("value").alias("__m"))
    return m.crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("__m")).drop("__m")


RULE = """
Trigger: busy
when: ObjectCount
with: {min score: 0.2}
is greater than: 0
during: [5, frames]
for at least: [60, percent]
"""


@query(f"WITH {OBJ}, {_COND} SELECT stream_id, frame_id, sum(hit) OVER w >= 0.6 * count(*) OVER w AND row_number() OVER ({_BY} frame_id) >= 5 AS fired FROM cn WINDOW w AS ({_BY} frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.fire(rules.parse_rule(RULE), _metric(spark, sf_dir), KEY).select(KEY, "frame_id", "fired")


_SEC = "14400000000"


@query(f"""WITH {OBJ}, {_COND}, u AS (SELECT *, epoch_us(ts) - epoch_us(ts) % 3600000000 AS us FROM cn),
p AS (SELECT a.stream_id, a.frame_id, a.us, sum(b.hit) AS hits, count(*) AS n FROM u a JOIN u b ON b.stream_id = a.stream_id AND b.frame_id <= a.frame_id AND b.us >= a.us - {_SEC} GROUP BY ALL)
SELECT stream_id, frame_id, hits >= 0.5 * n AND min(us) OVER ({_BY} frame_id) < us - {_SEC} AS fired FROM p""")
def event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are cut to whole hours, so that some frames have the same."""
    rule = rules.parse_rule({"Trigger": "slow", "when": "ObjectCount", "is greater than": 0, "during": [4 * 3600, "seconds"], "for at least": [50, "percent"]})
    m = _metric(spark, sf_dir).withColumn("ts", F.timestamp_micros(micros("ts") - micros("ts") % 3_600_000_000))
    return rules.fire(rule, m, KEY).select(KEY, "frame_id", "fired")


@query(f"WITH {OBJ}, {_COND} SELECT stream_id, frame_id, sum(hit) OVER w <= 2 AS fired FROM cn WINDOW w AS ({_BY} frame_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def event_at_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.parse_rule({"Trigger": "calm", "when": "ObjectCount", "is greater than": 0, "during": [6, "frames"], "for at most": [2, "frames"]})
    return rules.fire(rule, _metric(spark, sf_dir), KEY).select(KEY, "frame_id", "fired")


@query(f"""WITH {TRK}, {TRL}, {_cross_sql('p')}, {_FIRST}, n AS (SELECT stream_id, frame_id, count(*) FILTER (WHERE direction = 'left') AS v FROM f1 WHERE rn = 1 AND line_index IN (0, 1) GROUP BY ALL)
SELECT sfr.stream_id, sfr.frame_id, CAST(coalesce(v, 0) AS DOUBLE) AS value, coalesce(v, 0) >= 1 AS fired FROM sfr LEFT JOIN n ON n.stream_id = sfr.stream_id AND n.frame_id = sfr.frame_id""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    hits = lines.crossings(lines.trails(t, stream=KEY), src.LINES, whole_trail=False, stream=KEY)
    per = lines.running_counts(hits, stream_frames(t), 3, accumulate=False, stream=KEY).where("line_index < 2")
    rule = rules.parse_rule({"Trigger": "left", "when": "LineCount", "with": {"directions": ["left"]}, "is greater than or equal to": 1, "during": [1, "frame"]})
    return rules.fire(rule, rules.line_count(per, stream_frames(t), 3, directions=["left"], key=KEY), KEY).select(KEY, "frame_id", "value", "fired")


@query(f"""WITH {TRK}, m AS (SELECT sfr.stream_id, sfr.frame_id, max(x2 - x1 + score * 100) AS value FROM sfr LEFT JOIN trk ON sfr.stream_id = trk.stream_id AND sfr.frame_id = trk.frame_id GROUP BY ALL)
SELECT stream_id, frame_id, round(value, 6) AS value, sum(CAST(coalesce(value < 120, FALSE) AS INTEGER)) OVER ({_BY} frame_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS fired FROM m""")
def event_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of one's own: null in frames without boxes, which never meets the condition."""
    t = trk(spark, sf_dir)
    tops = t.groupBy(KEY, "frame_id").agg(F.max(F.col("x2") - F.col("x1") + F.col("score") * 100).alias("top"))
    m = rules.custom_metric(stream_frames(t).join(tops, [KEY, "frame_id"], "left"), F.col("top"), KEY)
    rule = rules.parse_rule({"Trigger": "small", "when": "CustomMetric", "is less than": 120, "during": [3, "frames"], "for at least": [2, "frames"]})
    return rules.fire(rule, m, KEY).select(KEY, "frame_id", F.round("value", 6).alias("value"), "fired")


EV = f"{OBJ}, {_COND}, ev AS (SELECT stream_id, frame_id, ts, value, epoch_us(ts) AS us, hit = 1 AND frame_id % 7 <> 0 AS cond, (value > (SELECT avg(value) FROM ob)) AS busy FROM cn)"


def _events(spark, sf_dir):
    m = _metric(spark, sf_dir)
    busy = F.when(F.col("value") > 0, F.lit("busy"))
    skip = F.when(F.col("frame_id") % 7 == 0, F.lit("skip"))
    return m.select(KEY, "frame_id", "ts", F.array_compact(F.array(busy, skip)).alias("events"))


_WAS = f"coalesce(lag(cond) OVER ({_BY} frame_id), FALSE)"


@query(f"WITH {EV} SELECT stream_id, frame_id, cond AND NOT {_WAS} AS fired FROM ev")
def notify_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.notify(_events(spark, sf_dir), "n", "busy and not skip", key=KEY).select(KEY, "frame_id", "fired")


@query(f"WITH {EV} SELECT stream_id, frame_id, cond AS fired, CASE WHEN cond THEN 'Notification triggered: n' END AS message FROM ev")
def notify_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.notify(_events(spark, sf_dir), "n", "busy and not skip", while_true=True, key=KEY).select(KEY, "frame_id", "fired", F.try_element_at("notifications", F.lit("n")).alias("message"))


@query(f"WITH {EV} SELECT stream_id, frame_id, CASE WHEN cond AND NOT {_WAS} THEN 'camera ' || stream_id || ' frame ' || frame_id || ' at ' || strftime(ts, '%a %b %-d %H:%M:%S %Y') || ' ${{nobody}}' END AS message FROM ev")
def notify_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.notify(_events(spark, sf_dir), "n", "busy and not skip", message="camera ${result.stream_id} frame ${result.frame_id} at ${time} ${nobody}", key=KEY)
    return out.select(KEY, "frame_id", F.try_element_at("notifications", F.lit("n")).alias("message"))


_LAST = f"last_value(CASE WHEN cond THEN {{v}} END IGNORE NULLS) OVER ({_BY} frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {EV} SELECT stream_id, frame_id, cond AND NOT {_WAS} AND coalesce(frame_id - {_LAST.format(v='frame_id')} > 3, TRUE) AS fired FROM ev")
def notify_holdoff_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.notify(_events(spark, sf_dir), "n", "busy and not skip", holdoff=3, key=KEY).select(KEY, "frame_id", "fired")


@query(f"WITH {EV} SELECT stream_id, frame_id, cond AND coalesce(us - {_LAST.format(v='us')} > 7200000000, TRUE) AS fired FROM ev")
def notify_holdoff_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.notify(_events(spark, sf_dir), "n", "busy and not skip", while_true=True, holdoff=7200.0, key=KEY).select(KEY, "frame_id", "fired")


@query(f"WITH {EV} SELECT stream_id, frame_id FROM ev WHERE busy OR frame_id % 7 = 0")
def analyzer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return frames.by_names(e, ["busy", "skip"]).select(KEY, "frame_id")


@query(f"""WITH {EV} SELECT stream_id, frame_id, array_to_string(list_filter([CASE WHEN busy THEN 'busy' END, CASE WHEN NOT busy THEN 'calm' END, CASE WHEN frame_id % 7 = 0 THEN 'skip' END], lambda x: x IS NOT NULL), ',') AS events FROM ev""")
def events_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metric(spark, sf_dir)
    one = lambda c: m.select(KEY, "frame_id", c.alias("fired"))
    named = {"skip": one(F.col("frame_id") % 7 == 0), "busy": one(F.col("value") > 0), "calm": one(F.col("value") <= 0)}
    return rules.events_by_frame(named, KEY).select(KEY, "frame_id", F.array_join("events", ",").alias("events"))


# clips and scene cuts

_TRIG = f"{TRK}, tg AS (SELECT DISTINCT stream_id, frame_id AS t FROM trk WHERE score >= 0.4), nf AS (SELECT max(frame_id) + 1 AS n FROM frm)"
CLIP = """gd AS (
  SELECT stream_id, min(t) AS t FROM tg GROUP BY stream_id
  UNION ALL SELECT gd.stream_id, (SELECT min(t) FROM tg WHERE tg.stream_id = gd.stream_id AND t >= gd.t + 8) FROM gd WHERE gd.t IS NOT NULL),
cl AS (SELECT stream_id, t AS trigger, t - 2 AS start_frame, CASE WHEN t + 8 > n THEN greatest(0, n - 10) + t + 8 - n ELSE greatest(t - 2, 0) END AS first_frame, least(t + 7, n - 1) AS last_frame, t + 8 <= n AS whole FROM gd, nf WHERE t IS NOT NULL)"""


def _clips(spark, sf_dir):
    t = trk(spark, sf_dir)
    n = t.agg(F.max("frame_id")).first()[0] + 1
    trig = t.where("score >= 0.4").select(KEY, F.col("frame_id").alias("trigger")).distinct()
    return rules.clips(trig, n, 10, 2, KEY), t


@query(f"WITH RECURSIVE {_TRIG}, {CLIP} SELECT * FROM cl WHERE first_frame <= last_frame")
def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_TRIG}, {CLIP} SELECT stream_id, trigger, frame_id, printf('clip_%08d', start_frame) AS file_name FROM (SELECT *, unnest(range(first_frame, last_frame + 1)) AS frame_id FROM cl)")
def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, t = _clips(spark, sf_dir)
    return rules.clip_frames(found, stream_frames(t), KEY).select(KEY, "trigger", "frame_id", text.clip_name(F.lit("clip"), F.col("start_frame")).alias("file_name"))


@query(f"""WITH RECURSIVE {_TRIG}, {CLIP}, fr AS (SELECT cl.stream_id, trigger, start_frame, f.frame_id, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(first_frame, last_frame + 1)) AS frame_id FROM cl) f JOIN cl USING (stream_id, trigger, start_frame)
  LEFT JOIN (SELECT stream_id, frame_id, count(*) AS n FROM trk GROUP BY ALL) c ON c.stream_id = cl.stream_id AND c.frame_id = f.frame_id)
SELECT stream_id, trigger, '{{"properties":{{"start_frame":' || start_frame || ',"triggered_by":["high"],"duration":' || count(*) || ',"pre_trigger_delay":2,"target_fps":30.0}},"results":[' || string_agg('{{"frame_id":' || frame_id || ',"n":' || n || '}}', ',' ORDER BY frame_id) || ']}}' AS json FROM fr GROUP BY stream_id, trigger, start_frame""")
def clip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, t = _clips(spark, sf_dir)
    counts = t.groupBy(KEY, "frame_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rules.clip_frames(found, stream_frames(t), KEY).join(counts, [KEY, "frame_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = rows.groupBy(KEY, "trigger", "start_frame").agg(F.sort_array(F.collect_list(F.struct("frame_id", "n"))).alias("rs"))
    clip = {"start_frame": F.col("start_frame"), "triggered_by": F.array(F.lit("high")), "duration": F.size("rs"), "pre_trigger_delay": F.lit(2), "target_fps": F.lit(30.0)}
    return each.select(KEY, "trigger", text.clip_json(clip, F.col("rs")).alias("json"))


_SCENE = """s AS (SELECT user_id, event_id AS n, value AS score FROM events),
r AS (SELECT user_id, n, score, row_number() OVER (PARTITION BY user_id ORDER BY n) AS rn, avg(score) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m FROM s),
cand AS MATERIALIZED (SELECT user_id, n FROM r WHERE rn > 4 AND score >= 15 AND CASE WHEN abs(m) >= 0.00001 THEN least(score / m, 255.0) ELSE 255.0 END >= 1.8),
cut AS (SELECT user_id, min(n) AS n FROM cand WHERE n >= 500 GROUP BY user_id UNION ALL SELECT cut.user_id, (SELECT min(n) FROM cand WHERE cand.user_id = cut.user_id AND cand.n >= cut.n + 500) FROM cut WHERE n IS NOT NULL)"""


@query(f"WITH RECURSIVE {_SCENE} SELECT user_id, n FROM cut WHERE n IS NOT NULL")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.series(spark, sf_dir).select("user_id", "n", F.col("value").alias("score"))
    return rules.scene_cuts(s, ratio=1.8, min_length=500, key="user_id")


# signals

_TAPS = signal.lowpass_taps(0.2, 7)
_FIR = " + ".join(f"coalesce(lag(value, {6 - k}) OVER w, first_value(value) OVER w) * CAST({t!r} AS DOUBLE)" for k, t in enumerate(_TAPS))


@query(f"SELECT user_id, event_id AS n, round({_FIR}, 4) AS filtered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def fir_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.fir(src.series(spark, sf_dir), "value", _TAPS, key="user_id").select("user_id", "n", F.round("filtered", 4).alias("filtered"))


@query(f"WITH {TRK} SELECT stream_id, frame_id, row_number() OVER ({_BY} frame_id) - 1 AS out_id FROM sfr WHERE frame_id % 30 NOT IN (0, 3, 6, 9, 12, 16, 19, 22, 25, 29)")
def fps_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.thin_to_fps(stream_frames(trk(spark, sf_dir)), 30, 20, KEY).select(KEY, "frame_id", "out_id")


@query(f"WITH {TRK} SELECT frame_id, epoch_us(ts) AS us, 30.0::DOUBLE AS source_fps, 640 AS width FROM frm")
def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.with_metadata(src.frames_of(trk(spark, sf_dir)), 30.0, 20.0)
    return m.select("meta.frame_id", micros("meta.timestamp").alias("us"), "meta.source_fps", "meta.width")


@query(f"""WITH {TRK}, sf AS (SELECT DISTINCT stream_id, frame_id, ts FROM trk), gp AS (SELECT stream_id, frame_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER ({_BY} frame_id) - epoch_us(ts) AS gap FROM sf),
rp AS (SELECT stream_id, frame_id, unnest(range(0, 1 + coalesce(greatest(CAST(floor(gap / 2000000000.0) AS BIGINT) - 1, 0), 0))) AS k FROM gp)
SELECT stream_id, frame_id AS source_frame, CAST(k AS INTEGER) AS repeat, round(CASE WHEN k = 0 THEN 1.0 ELSE greatest(0.3, exp((k - 1) * -0.1)) END, 6) AS brightness, row_number() OVER ({_BY} frame_id, k) - 1 AS out_id FROM rp""")
def fps_stabilize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir).select(KEY, "frame_id", "ts").distinct()
    return signal.stabilise_fps(t, 2_000_000_000, KEY).withColumn("brightness", F.round("brightness", 6))


_TRKSEQ = f"{TRK}, sq AS (SELECT track_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY track_id ORDER BY frame_id) AS rn FROM trk)"


@query(f"""WITH RECURSIVE {_TRKSEQ}, ml AS (
  SELECT track_id, rn, us AS last, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS n FROM sq WHERE rn = 1
  UNION ALL SELECT sq.track_id, sq.rn, sq.us, (d * (least(n + 1, 20) - 1) + sq.us - last) // least(n + 1, 20), least(n + 1, 20) FROM ml JOIN sq ON sq.track_id = ml.track_id AND sq.rn = ml.rn + 1)
SELECT track_id, arg_max(n, rn) AS records, arg_max(d, rn) AS mean_us FROM ml GROUP BY track_id""")
def fps_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    return signal.fps_meter(t, micros("ts"), "frame_id", "track_id", 20).select("track_id", "records", F.col("mean_us").cast("long").alias("mean_us"))


@query(f"""WITH RECURSIVE {_TRKSEQ}, wd AS (
  SELECT track_id, rn, us AS last, CAST(-1.0 AS DOUBLE) AS d FROM sq WHERE rn = 1
  UNION ALL SELECT sq.track_id, sq.rn, sq.us, CASE WHEN d < 0 THEN CAST(sq.us - last AS DOUBLE) ELSE d * 0.9::DOUBLE + CAST(sq.us - last AS DOUBLE) * (1 - 0.9::DOUBLE) END FROM wd JOIN sq ON sq.track_id = wd.track_id AND sq.rn = wd.rn + 1)
SELECT track_id, round(arg_max(d, rn), 1) AS gap_us FROM wd GROUP BY track_id""")
def watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    return signal.watchdog(t, micros("ts"), "frame_id", "track_id", now_us=F.lit(0)).select("track_id", F.round("gap_us", 1).alias("gap_us"))


@query(f"""WITH RECURSIVE {_TRKSEQ}, th AS (
  SELECT track_id, rn, us AS base, TRUE AS kept FROM sq WHERE rn = 1
  UNION ALL SELECT sq.track_id, sq.rn, CASE WHEN sq.us - base >= 5000000000 THEN sq.us - (sq.us - base) % 5000000000 ELSE base END, sq.us - base >= 5000000000 FROM th JOIN sq ON sq.track_id = th.track_id AND sq.rn = th.rn + 1)
SELECT track_id, count(*) FILTER (WHERE kept) AS kept FROM th GROUP BY track_id""")
def fps_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir)
    return signal.throttle(t, micros("ts"), 1 / 5000, "frame_id", "track_id").groupBy("track_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH b AS (SELECT user_id AS stream_id, event_id // 100 AS block_id, list(CAST(floor(value) AS INTEGER) ORDER BY event_id) AS s FROM events GROUP BY ALL)
SELECT stream_id, block_id, CAST(list_sum(list_concat(coalesce(lag(s) OVER w, list_transform(s, lambda x: 0)), s)) AS BIGINT) AS total, CAST(len(list_concat(coalesce(lag(s) OVER w, s), s)) AS INTEGER) AS n FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY block_id)""")
def audio_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.struct("event_id", F.floor("value").cast("int").alias("v"))
    b = e.groupBy(F.col("user_id").alias("stream_id"), F.expr("event_id div 100").alias("block_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("samples"))
    o = src.overlapped_blocks(b)
    return o.select("stream_id", "block_id", F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("samples").alias("n"))


# joins of frames, crops and classifiers


def _as_results(df: DataFrame) -> DataFrame:
    item = F.struct("det_idx", "label", "score", "x1", "y1", "x2", "y2")
    return df.groupBy("frame_id").agg(F.sort_array(F.collect_list(item)).alias("results"))


@query(f"""WITH {DET}, w AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_idx) - 1 AS ci, count(*) OVER (PARTITION BY frame_id) AS n FROM det WHERE score >= 0.7)
SELECT o.frame_id, CAST(coalesce(ci, -1) AS INTEGER) AS crop_index, w.det_idx, coalesce(ci, -1) = coalesce(n, 0) - 1 AS is_last FROM (SELECT DISTINCT frame_id FROM det) o LEFT JOIN w ON w.frame_id = o.frame_id""")
def crop_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.crop_fanout(_as_results(det(spark, sf_dir)), keep=lambda r: r["score"] >= 0.7)
    return out.select("frame_id", "crop_index", F.col("crop.det_idx").alias("det_idx"), "is_last")


@query(f"""WITH {DET}, fr AS (SELECT DISTINCT frame_id FROM det), c AS (SELECT frame_id, det_idx, p_type AS label, CAST(p_size / 50.0 AS DOUBLE) AS score FROM det JOIN part ON p_partkey = l_partkey WHERE det.score >= 0.7)
SELECT fr.frame_id, CAST(count(c.det_idx) AS INTEGER) AS n, string_agg(c.label, ',' ORDER BY det_idx) AS labels FROM fr LEFT JOIN c ON c.frame_id = fr.frame_id GROUP BY fr.frame_id""")
def crop_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    crops = d.where("score >= 0.7").join(part, F.col("l_partkey") == F.col("p_partkey")).select("frame_id", F.col("det_idx").alias("crop_index"), F.col("p_type").alias("label"), (F.col("p_size") / 50.0).alias("score"))
    out = frames.combine_crops(d.select("frame_id").distinct(), crops)
    n = F.coalesce(F.size("extra_0"), F.lit(0))
    return out.select("frame_id", F.greatest(n, F.lit(0)).alias("n"), F.when(n > 0, F.array_join(F.transform("extra_0", lambda x: x["label"]), ",")).alias("labels"))


@query(f"""WITH {DET} SELECT frame_id, det_idx, CASE WHEN l_partkey % 3 = 0 THEN label ELSE p_type END AS label, round(CASE WHEN l_partkey % 3 = 0 THEN score ELSE p_size / 50.0 END, 6) AS score, category_id FROM det JOIN part ON p_partkey = l_partkey""")
def classify_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    blank = F.col("l_partkey") % 3 == 0
    cls = d.join(part, F.col("l_partkey") == F.col("p_partkey")).select("frame_id", "det_idx", F.lit(0).alias("rank"), F.when(~blank, F.col("p_type")).alias("label"), F.when(~blank, F.col("p_size") / 50.0).alias("score"), F.lit(None).cast("int").alias("category_id"))
    return frames.patch_classes(d, cls).select("frame_id", "det_idx", "label", F.round("score", 6).alias("score"), "category_id")


@query(f"WITH {DET} SELECT frame_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(det_idx AS VARCHAR), ',' ORDER BY label = 'R', det_idx) AS ids FROM det WHERE frame_id IN (SELECT frame_id FROM det WHERE label = 'R') AND frame_id IN (SELECT frame_id FROM det WHERE label <> 'R') GROUP BY frame_id")
def result_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir)
    out = frames.combine_results(_as_results(d.where("label <> 'R'")), _as_results(d.where("label = 'R'")))
    return out.select("frame_id", F.size("results").alias("n"), F.array_join(F.transform("results", lambda r: r["det_idx"].cast("string")), ",").alias("ids"))


@query(f"WITH {DET} SELECT frame_id, det_idx, label FROM det WHERE label = 'A' UNION ALL SELECT frame_id, det_idx, 'N2' FROM det WHERE label = 'N'")
def model_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir).select("frame_id", "det_idx", "label")
    return frames.union_models(d.where("label = 'A'"), d.where("label = 'N'").withColumn("label", F.lit("N2")))


@query(f"""WITH {DET}, roi AS (SELECT frame_id, det_idx AS roi_index, x1, y1 FROM det WHERE label = 'A')
SELECT roi.frame_id, roi_index AS crop_index, label, det.x1 / 10 + roi.x1 AS x1, det.y1 / 10 + roi.y1 AS y1, det.x2 / 10 + roi.x1 AS x2, det.y2 / 10 + roi.y1 AS y2 FROM roi JOIN det ON det.frame_id = roi.frame_id AND label <> 'A'""")
def detect_in_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir)
    rois = d.where("label = 'A'").withColumnRenamed("det_idx", "roi_index")
    inner = d.where("label <> 'A'").join(rois.select("frame_id", "roi_index"), "frame_id").select("frame_id", "roi_index", "label", "score", *(((F.col(n) / 10).alias(n)) for n in ("x1", "y1", "x2", "y2")))
    return frames.detect_in_rois(rois, inner).select("frame_id", F.col("crop_index"), "label", "x1", "y1", "x2", "y2")


# the catalog


def _catalog(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    meta = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"))
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("model_name"), F.lit(None).cast("string").alias("alias"), F.col("p_type").alias("task"), F.array("p_brand").alias("hardware"), F.when(F.col("p_size") > 25, F.lit("zoo/a")).alias("zoo_url"), F.lit(None).cast("string").alias("device_type"), meta.alias("metadata"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_name FROM part WHERE p_brand = (SELECT arg_min(p_brand, p_partkey) FROM part) AND p_size = (SELECT arg_min(p_size, p_partkey) FROM part)")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    first = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.min_by("p_brand", "p_partkey"), F.min_by("p_size", "p_partkey")).first()
    return catalog.models(c, hardware=first[0], metadata={"size": first[1]}).select("model_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_name, p_size AS size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def catalog_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.best(_catalog(spark, sf_dir), "size").select("model_name", F.col("metadata")["size"].cast("int").alias("size"))


@query("SELECT 'hardware' AS what, value FROM (SELECT DISTINCT p_brand AS value FROM part) UNION ALL SELECT 'task', value FROM (SELECT DISTINCT p_type AS value FROM part)")
def catalog_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return catalog.distinct_values(c, "hardware").select(F.lit("hardware").alias("what"), "value").unionByName(catalog.distinct_values(c, "task").select(F.lit("task").alias("what"), "value"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_name, 'zoo/default' AS zoo_url, p_brand AS device_type, CAST(p_size AS VARCHAR) AS size, '30' AS fps FROM part")
def catalog_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.with_defaults(_catalog(spark, sf_dir), {"zoo_url": "zoo/default", "metadata": {"size": 1, "fps": 30}})
    return c.select("model_name", "zoo_url", "device_type", F.col("metadata")["size"].alias("size"), F.col("metadata")["fps"].alias("fps"))


# evaluation


@query(f"""WITH {DET}, s AS (SELECT frame_id, label, max(score) AS score FROM det GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, label) AS rk FROM s),
t AS (SELECT frame_id, CASE WHEN frame_id % 2 = 0 THEN label ELSE CASE label WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END END AS class FROM r WHERE rk = 1),
j AS (SELECT t.class, k, CAST(coalesce(r.rk, 99) <= k AS INTEGER) AS h FROM t LEFT JOIN r ON r.frame_id = t.frame_id AND r.label = t.class, (VALUES (1), (2)) v(k))
SELECT class, k, round(avg(h), 6) AS accuracy, count(*) AS n FROM j GROUP BY GROUPING SETS ((class, k), (k))""")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.topk_accuracy(*_topk(spark, sf_dir), (1, 2)).withColumn("accuracy", F.round("accuracy", 6))


def _topk(spark, sf_dir):
    """Predictions, and truths that are the best of them in even frames only."""
    pred = det(spark, sf_dir).groupBy(F.col("frame_id").alias("item"), "label").agg(F.max("score").alias("score"))
    first = pred.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), "label"))).where("r = 1")
    other = F.when(F.col("label") == "A", "N").when(F.col("label") == "N", "R").otherwise("A")
    return pred, first.select("item", F.when(F.col("item") % 2 == 0, F.col("label")).otherwise(other).alias("label"))


@query(f"""WITH {DET}, s AS (SELECT frame_id, label, max(score) AS score FROM det GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, label) AS rk FROM s),
t AS (SELECT frame_id, CASE WHEN frame_id % 2 = 0 THEN label ELSE CASE label WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END END AS class FROM r WHERE rk = 1),
o AS (SELECT *, row_number() OVER (ORDER BY class, frame_id) AS pos, count(*) OVER () * 6 // 10 AS m FROM t),
h AS (SELECT class, CAST(coalesce(r.rk, 99) <= 1 AS INTEGER) AS hit FROM o LEFT JOIN r ON r.frame_id = o.frame_id AND r.label = o.class WHERE pos <= m),
w AS (SELECT class FROM o GROUP BY class, m HAVING max(pos) < m)
SELECT class, CAST(1 AS INTEGER) AS k, round(avg(hit), 6) AS accuracy, count(*) AS n FROM h WHERE class IN (SELECT class FROM w) GROUP BY class UNION ALL SELECT NULL, 1, round(avg(hit), 6), count(*) FROM h""")
def topk_first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the classes in order only so many images."""
    pred, truth = _topk(spark, sf_dir)
    return evaluate.topk_accuracy(pred, truth, (1,), max_images=truth.count() * 6 // 10).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH p AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS pred FROM lineitem GROUP BY l_orderkey)
SELECT round(avg(abs(pred - o_totalprice)), 2) AS mae, round(avg((pred - o_totalprice) * (pred - o_totalprice)) / 1e6, 2) AS mse_m, count(*) AS n FROM orders JOIN p ON l_orderkey = o_orderkey""")
def mae_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("truth"))
    e = evaluate.regression_errors(o.join(p, "l_orderkey"))
    return e.select(F.round("mae", 2).alias("mae"), F.round(F.col("mse") / 1e6, 2).alias("mse_m"), "n")


@query(f"WITH {DET} SELECT frame_id, det_idx, CASE label WHEN 'A' THEN 7 WHEN 'N' THEN 8 ELSE 9 END AS category_id, round_even(x1 / 3, 3) AS x, round_even(y1 / 3, 3) AS y, round_even(x2 / 3 - x1 / 3, 3) AS w, round_even(y2 / 3 - y1 / 3, 3) AS h FROM det")
def coco_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir).withColumns({n: F.col(n) / 3 for n in ("x1", "y1", "x2", "y2")})
    c = evaluate.to_coco(d, {"A": 7, "N": 8, "R": 9})
    return c.select("frame_id", "det_idx", "category_id", *(F.col("bbox")[k].alias(n) for k, n in enumerate("xywh")))


def _pred_truth(spark, sf_dir):
    d = det(spark, sf_dir)
    shift = F.col("l_quantity") % 5
    base = d.select(F.col("frame_id").alias("image_id"), "category_id", "det_idx", "score", "l_suppkey", shift.alias("s"), *box())
    truth = base.where("l_suppkey % 2 = 0").select("image_id", "category_id", F.col("det_idx").alias("truth_idx"), *box())
    pred = base.withColumns({n: F.col(n) + F.col("s") for n in ("x1", "y1", "x2", "y2")}).drop("s", "l_suppkey")
    return pred, truth


@query(f"""WITH {DET}, pr AS (SELECT frame_id, category_id, det_idx, x1 + l_quantity % 5 AS x1, y1 + l_quantity % 5 AS y1, x2 + l_quantity % 5 AS x2, y2 + l_quantity % 5 AS y2 FROM det),
p AS (SELECT a.frame_id AS image_id, a.det_idx, b.det_idx AS truth_idx, {_INTER} AS inter, {_AREA.format(p='a')} AS sa, {_AREA.format(p='b')} AS sb FROM pr a JOIN det b ON a.frame_id = b.frame_id AND a.category_id = b.category_id AND b.l_suppkey % 2 = 0)
SELECT image_id, det_idx, truth_idx, round(inter / (sa + sb - inter), 6) AS iou FROM p""")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.iou_with_truth(*_pred_truth(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {DET}, m AS (SELECT frame_id AS image_id, category_id, score, det_idx, l_suppkey % 2 = 0 AS hit FROM det), pos AS (SELECT category_id, count(*) AS n FROM det WHERE l_suppkey % 2 = 0 GROUP BY 1),
c AS (SELECT m.category_id, score, image_id, det_idx, n, sum(CAST(hit AS INTEGER)) OVER w AS tp, count(*) OVER w AS k FROM m JOIN pos ON pos.category_id = m.category_id WINDOW w AS (PARTITION BY m.category_id ORDER BY score DESC, image_id, det_idx ROWS UNBOUNDED PRECEDING))
SELECT category_id, image_id, det_idx, CAST(tp AS BIGINT) AS tp, CAST(k - tp AS BIGINT) AS fp, round(tp / n, 9) AS recall, round(tp / k, 9) AS "precision" FROM c""")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve for a match that is known: boxes of even suppliers are hits."""
    d = det(spark, sf_dir)
    m = d.select(F.col("frame_id").alias("image_id"), "category_id", F.lit("all").alias("area"), F.lit(0.5).alias("threshold"), "score", F.col("det_idx").alias("rank"), (F.col("l_suppkey") % 2 == 0).cast("int").alias("state"))
    n = d.where("l_suppkey % 2 = 0").groupBy("category_id").agg(F.count(F.lit(1)).alias("positives")).withColumn("area", F.lit("all"))
    c = evaluate.precision_recall(m, n)
    return c.select("category_id", "image_id", F.col("rank").alias("det_idx"), "tp", "fp", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


_AREAS = "ar(area, lo, hi) AS (VALUES ('all', 0.0, 1e10), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)), th AS (SELECT CAST(round(0.5 + 0.05 * range, 2) AS DOUBLE) AS thr FROM range(10))"
_IOU_SIM = f"SELECT a.image_id, a.category_id, a.rank, b.t, {_AREA.format(p='b')} AS size, {_INTER} / ({_AREA.format(p='a')} + {_AREA.format(p='b')} - {_INTER}) AS sim FROM pk a JOIN tt b ON a.image_id = b.image_id AND a.category_id = b.category_id"
#: The corners as points, all visible: the mean over four points of exp(-d^2 / (2 (2 s)^2 area)).
_SPREADS = (0.05, 0.1, 0.15, 0.2)
_OKS = " + ".join(f"exp(-(pow(a.{x} - b.{x}, 2) + pow(a.{y} - b.{y}, 2)) / {(2 * k) ** 2!r} / ({_AREA.format(p='b')}) / 2)" for k, (x, y) in zip(_SPREADS, (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
_OKS_SIM = f"SELECT a.image_id, a.category_id, a.rank, b.t, {_AREA.format(p='b')} AS size, ({_OKS}) / 4 AS sim FROM pk a JOIN tt b ON a.image_id = b.image_id AND a.category_id = b.category_id"
_MATCH = f"""pr AS (SELECT frame_id AS image_id, category_id, det_idx, score, x1 + l_quantity % 5 AS x1, y1 + l_quantity % 5 AS y1, x2 + l_quantity % 5 AS x2, y2 + l_quantity % 5 AS y2 FROM det),
pk AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_idx) - 1 AS rank FROM pr QUALIFY rank < 100),
tt AS (SELECT frame_id AS image_id, category_id, det_idx AS t, {BOXES} FROM det WHERE l_suppkey % 2 = 0),
{_AREAS},
cd0 AS ({_IOU_SIM}),
cd AS (SELECT image_id, category_id, rank, list({{'iou': sim, 't': t, 'size': size}}) AS cands FROM cd0 WHERE sim >= 0.4 GROUP BY ALL),
pa AS (SELECT pk.image_id, pk.category_id, pk.rank, pk.score, ({_AREA.format(p='pk')} < lo OR {_AREA.format(p='pk')} > hi) AS outside, area, thr, list_transform(list_filter(coalesce(cands, []), lambda c: c.iou >= thr), lambda c: {{'iou': c.iou, 't': c.t, 'ig': c.size < lo OR c.size > hi}}) AS cands FROM pk CROSS JOIN ar CROSS JOIN th LEFT JOIN cd ON cd.image_id = pk.image_id AND cd.category_id = pk.category_id AND cd.rank = pk.rank),
mt AS (
  SELECT image_id, category_id, area, thr, CAST(-1 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS INTEGER) AS state FROM (SELECT DISTINCT image_id, category_id, area, thr FROM pa)
  UNION ALL
  SELECT image_id, category_id, area, thr, rank, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.t) END, CASE WHEN pick IS NULL THEN CASE WHEN outside THEN -1 ELSE 0 END WHEN pick.ig THEN -1 ELSE 1 END
  FROM (SELECT pa.image_id, pa.category_id, pa.area, pa.thr, pa.rank, pa.outside, mt.taken, list_sort(list_filter(pa.cands, lambda c: NOT list_contains(mt.taken, c.t)), 'DESC') AS free,
    coalesce(list_filter(free, lambda c: NOT c.ig)[1], free[1]) AS pick FROM mt JOIN pa ON pa.image_id = mt.image_id AND pa.category_id = mt.category_id AND pa.area = mt.area AND pa.thr = mt.thr AND pa.rank = mt.rank + 1)),
np AS (SELECT category_id, area, count(*) FILTER (WHERE (x2 - x1) * (y2 - y1) >= lo AND (x2 - x1) * (y2 - y1) <= hi) AS n FROM tt, ar GROUP BY ALL),
ms AS (SELECT mt.category_id, mt.area, mt.thr, mt.image_id, mt.rank, state, pk.score FROM mt JOIN pk ON pk.image_id = mt.image_id AND pk.category_id = mt.category_id AND pk.rank = mt.rank WHERE state >= 0)"""
_AP = """cv AS (SELECT ms.*, n, sum(state) OVER w AS tp, count(*) OVER w AS k FROM ms JOIN np ON np.category_id = ms.category_id AND np.area = ms.area WHERE n > 0 WINDOW w AS (PARTITION BY ms.category_id, ms.area, thr ORDER BY score DESC, image_id, rank ROWS UNBOUNDED PRECEDING)),
cw AS (SELECT *, max(tp / k) OVER (PARTITION BY category_id, area, thr ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p, (tp * 100) // n AS upto, coalesce(lag((tp * 100) // n) OVER (PARTITION BY category_id, area, thr ORDER BY k), -1) AS low FROM cv),
ap0 AS (SELECT category_id, area, thr, sum((upto - low) * p) / 101 AS ap, sum(state) FILTER (WHERE rank < 1) AS t1, sum(state) FILTER (WHERE rank < 10) AS t10, sum(state) AS t100 FROM cw GROUP BY ALL),
ap AS (SELECT np.category_id, np.area, th.thr, coalesce(ap, 0.0) AS ap, coalesce(t1, 0) / n AS r1, coalesce(t10, 0) / n AS r10, coalesce(t100, 0) / n AS r100 FROM np CROSS JOIN th LEFT JOIN ap0 ON ap0.category_id = np.category_id AND ap0.area = np.area AND ap0.thr = th.thr WHERE n > 0)"""
_SUMMARY = [("AP", "ap", "area = 'all'"), ("AP50", "ap", "area = 'all' AND thr = 0.5"), ("AP75", "ap", "area = 'all' AND thr = 0.75"), *((f"AP_{a}", "ap", f"area = '{a}'") for a in ("small", "medium", "large")), *((f"AR{k}", f"r{k}", "area = 'all'") for k in (1, 10, 100)), *((f"AR_{a}", "r100", f"area = '{a}'") for a in ("small", "medium", "large"))]


@query(f"WITH RECURSIVE {DET}, {_MATCH}, {_AP} " + " UNION ALL ".join(f"SELECT {k} AS ord, '{n}' AS name, round(coalesce(avg({v}) FILTER (WHERE {w}), -1.0), 6) AS value FROM ap" for k, (n, v, w) in enumerate(_SUMMARY, 1)))
def map50_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coco_summary(*_pred_truth(spark, sf_dir)).withColumn("value", F.round("value", 6))


_POINT_SUMMARY = [("AP", "ap", "area = 'all'"), ("AP50", "ap", "area = 'all' AND thr = 0.5"), ("AP75", "ap", "area = 'all' AND thr = 0.75"), ("AP_medium", "ap", "area = 'medium'"), ("AP_large", "ap", "area = 'large'"), ("AR", "r100", "area = 'all'"), ("AR50", "r100", "area = 'all' AND thr = 0.5"), ("AR75", "r100", "area = 'all' AND thr = 0.75"), ("AR_medium", "r100", "area = 'medium'"), ("AR_large", "r100", "area = 'large'")]


@query(f"WITH RECURSIVE {DET}, {_MATCH.replace(_IOU_SIM, _OKS_SIM).replace('QUALIFY rank < 100', 'QUALIFY rank < 20')}, {_AP} " + " UNION ALL ".join(f"SELECT {k} AS ord, '{n}' AS name, round(coalesce(avg({v}) FILTER (WHERE {w}), -1.0), 6) AS value FROM ap" for k, (n, v, w) in enumerate(_POINT_SUMMARY, 1)))
def keypoint_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes' corners as points."""
    points = F.array(*(c.cast("double") for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")) for c in (F.col(x), F.col(y), F.lit(2))))
    pred, truth = (df.withColumn("keypoints", points) for df in _pred_truth(spark, sf_dir))
    return evaluate.coco_summary(pred, truth, "keypoints", _SPREADS).withColumn("value", F.round("value", 6))


@query(f"WITH RECURSIVE {DET}, {_MATCH} SELECT image_id, category_id, area, thr AS threshold, CAST(rank AS INTEGER) AS rank, state FROM mt WHERE rank >= 0 AND area IN ('all', 'small') AND thr IN (0.5, 0.75)")
def truth_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.match_truth(*_pred_truth(spark, sf_dir), (0.5, 0.75), {a: evaluate.AREAS[a] for a in ("all", "small")})
    return m.select("image_id", "category_id", "area", "threshold", "rank", "state")


_CENT = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v), c AS (SELECT label AS cluster, d, round(avg(x), 6) AS x FROM e WHERE label IS NOT NULL GROUP BY label, d), dist AS (SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x)) AS d2 FROM e JOIN c ON c.d = e.d GROUP BY ALL)"


def _vectors(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    each = v.where("label is not null").select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.round(F.avg("x"), 6).alias("x"))
    return v, each.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("c"))


@query(f"WITH {_CENT} SELECT vec_id, arg_min(cluster, d2) AS cluster FROM dist GROUP BY vec_id")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.assign_centroids(*_vectors(spark, sf_dir)).select("vec_id", "cluster")


@query(f"WITH {_CENT}, a AS (SELECT vec_id, arg_min(cluster, d2) AS cluster, min(d2) AS d2 FROM dist GROUP BY vec_id) SELECT cluster, arg_min(vec_id, d2) AS vec_id, count(*) AS n FROM a GROUP BY cluster")
def kmeans_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.exemplars(catalog.assign_centroids(*_vectors(spark, sf_dir))).select("cluster", "vec_id", "n")


def _kmeans_sql(k: int, rounds: int) -> str:
    """The rounds unrolled: coordinates of the centroids by cluster and dimension."""
    out = ["e AS MATERIALIZED (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE embedding IS NOT NULL)", f"c0 AS MATERIALIZED (SELECT CAST(rn - 1 AS INTEGER) AS cluster, d, x FROM e JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM (SELECT DISTINCT vec_id FROM e) QUALIFY rn <= {k}) USING (vec_id))"]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, {{'d2': d2, 'c': cluster}}) AS cluster, min(d2) AS d2 FROM (SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x)) AS d2 FROM e JOIN c{r} c ON c.d = e.d GROUP BY ALL) GROUP BY vec_id)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.d, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT a.cluster, e.d, avg(e.x) AS x FROM a{r} a JOIN e USING (vec_id) GROUP BY ALL) m ON m.cluster = c.cluster AND m.d = c.d)")
    return f"WITH {', '.join(out)} SELECT cluster, arg_min(vec_id, {{'d2': d2, 'v': vec_id}}) AS vec_id, count(*) AS n, round(min(d2), 6) AS d2 FROM a{rounds} GROUP BY cluster"


@query(_kmeans_sql(10, 4))
def kmeans_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds from the vectors of the ten least ids."""
    v, _ = _vectors(spark, sf_dir)
    v = v.where("v is not null")
    seeds = [r.v for r in v.orderBy("vec_id").limit(10).collect()]
    return catalog.kmeans_exemplars(v, seeds=seeds, rounds=4).withColumn("d2", F.round("d2", 6))


# tracking


@query()
def track_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir).withColumnRenamed("track_id", "det_idx")
    return rounded(tracking.track_objects(t, buffer=30).select("stream_id", "frame_id", "det_idx", "track_id", *box()), places=3)


def _far_apart(spark, sf_dir):
    """Boxes in cells of their own that move a pixel a frame; each third object comes a frame or two
    later, and each fourth is missing in frames 5 and 6."""
    users = src.series(spark, sf_dir).select("user_id").distinct()
    k = F.row_number().over(W.partitionBy(F.col("user_id") % 8).orderBy("user_id")) - 1
    o = users.select((F.col("user_id") % 8).alias(KEY), k.cast("long").alias("k")).withColumn("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    o = o.where((F.col("frame_id") >= F.col("k") % 3) & ~((F.col("k") % 4 == 1) & F.col("frame_id").isin(5, 6)))
    x, y = F.col("k") % 20 * 100 + F.col("frame_id"), F.expr("k div 20") * 150 + F.col("frame_id")
    return o.select(KEY, "frame_id", F.col("k").alias("det_idx"), F.lit(0.9).alias("score"), *(c.cast("double").alias(n) for c, n in zip((x, y, x + 40, y + 60), ("x1", "y1", "x2", "y2"))))


_FAR = """us AS (SELECT DISTINCT user_id FROM events), ok AS (SELECT user_id % 8 AS stream_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY user_id) - 1 AS k FROM us),
far AS (SELECT stream_id, k, range AS frame_id FROM ok, range(12) WHERE range >= k % 3 AND NOT (k % 4 = 1 AND range IN (5, 6)))"""


@query(f"""WITH {_FAR}, n AS (SELECT stream_id, k, row_number() OVER (PARTITION BY stream_id ORDER BY k % 3, k) AS number FROM ok)
SELECT far.stream_id, frame_id, far.k AS det_idx, CASE WHEN frame_id > 0 AND frame_id = far.k % 3 THEN NULL ELSE number END AS track_id FROM far JOIN n ON n.stream_id = far.stream_id AND n.k = far.k""")
def track_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that never meet: a track each, from the second sighting on unless it is in the first
    frame, which is found again after it was lost."""
    return tracking.track_objects(_far_apart(spark, sf_dir)).select(KEY, "frame_id", "det_idx", "track_id")


def _kalman_sql() -> str:
    """Centre x, centre y, width / height and height each have a filter of place and velocity of
    their own (m, v, p, c, q: means and covariances); only the noise, which follows the height, is
    shared."""
    z = {"x": "(x1 + x2) / 2", "y": "(y1 + y2) / 2", "a": "(x2 - x1) / (y2 - y1)", "h": "y2 - y1"}
    std = lambda n, h, place, speed: (f"pow({place!r} * ({h}), 2)", f"pow({speed!r} * ({h}), 2)") if n != "a" else ("1e-4", "1e-10")
    start, ahead, right = [], [], []
    for n in z:
        p, q = std(n, "zh", 2 / 20, 10 / 160)
        start += [f"z{n} AS m{n}", f"CAST(0 AS DOUBLE) AS v{n}", f"CAST({p} AS DOUBLE) AS p{n}", f"CAST(0 AS DOUBLE) AS c{n}", f"CAST({q} AS DOUBLE) AS q{n}"]
        p, q = std(n, "f.mh", 1 / 20, 1 / 160)
        ahead += [f"m{n} + v{n} AS m{n}", f"v{n}", f"p{n} + 2 * c{n} + q{n} + {p} AS p{n}", f"c{n} + q{n} AS c{n}", f"q{n} + {q} AS q{n}"]
        g = f"(p{n} + " + ("pow(mh / 20, 2))" if n != "a" else "1e-2)")
        right += [f"m{n} + p{n} / {g} * (z{n} - m{n})", f"v{n} + c{n} / {g} * (z{n} - m{n})", f"p{n} - p{n} * p{n} / {g}", f"c{n} - p{n} * c{n} / {g}", f"q{n} - c{n} * c{n} / {g}"]
    return f"""sq AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_id) AS rn, {', '.join(f'{e} AS z{n}' for n, e in z.items())} FROM trk),
kf AS (
  SELECT track_id, rn, {', '.join(start)} FROM sq WHERE rn = 1
  UNION ALL
  SELECT track_id, rn, {', '.join(right)} FROM (SELECT s.track_id, s.rn, s.zx, s.zy, s.za, s.zh, {', '.join(ahead)} FROM kf f JOIN sq s ON s.track_id = f.track_id AND s.rn = f.rn + 1))"""


@query(f"WITH RECURSIVE {TRK}, {_kalman_sql()} SELECT track_id, rn AS frame_id, round(mx - ma * mh / 2, 3) AS x1, round(my - mh / 2, 3) AS y1, round(mx + ma * mh / 2, 3) AS x2, round(my + mh / 2, 3) AS y2 FROM kf")
def track_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter along each track's sightings, taken as frame after frame."""
    t = trk(spark, sf_dir)
    n = F.row_number().over(W.partitionBy("track_id").orderBy("frame_id")).cast("long")
    rows = t.withColumn("n", n).select("track_id", F.col("n").alias("frame_id"), *box())
    return rounded(tracking.smooth_tracks(rows).select("track_id", "frame_id", *box()), places=3)


_STICKY = """p AS (SELECT stream_id, frame_id, list(track_id ORDER BY score DESC, track_id) AS best, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS rn FROM trk GROUP BY stream_id, frame_id),
st AS (
  SELECT stream_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS frame_id, CAST([] AS STRUCT(n BIGINT, m BIGINT)[]) AS chosen FROM (SELECT DISTINCT stream_id FROM p)
  UNION ALL
  SELECT stream_id, rn, frame_id, list_concat(old, list_transform(list_filter(best[1:greatest(0, 2 - len(old))], lambda b: NOT list_contains(list_transform(old, lambda o: o.n), b)), lambda b: {'n': b, 'm': CAST(0 AS BIGINT)}))
  FROM (SELECT p.stream_id, p.rn, p.frame_id, p.best, list_filter(list_transform(list_filter(list_transform(st.chosen, lambda o: {'n': o.n, 'm': o.m + coalesce(p.frame_id - st.frame_id - 1, 0)}), lambda o: o.m <= 5), lambda o: {'n': o.n, 'm': CASE WHEN list_contains(p.best, o.n) THEN 0 ELSE o.m + 1 END}), lambda o: o.m <= 5) AS old
    FROM st JOIN p ON p.stream_id = st.stream_id AND p.rn = st.rn + 1))"""


@query(f"WITH RECURSIVE {TRK}, {_STICKY} SELECT st.stream_id, st.frame_id, c.n AS track_id FROM (SELECT stream_id, rn, frame_id, unnest(chosen) AS c FROM st) st JOIN p ON p.stream_id = st.stream_id AND p.rn = st.rn WHERE list_contains(p.best, c.n)")
def select_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trk(spark, sf_dir).withColumn("det_idx", F.col("track_id"))
    return tracking.select_sticky(t, F.col("score"), top_k=2, timeout=5).select("stream_id", "frame_id", "track_id")


# names and templates


@query(r"SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || '): é&#$!@/' || p_type || '*?', '[^-_.()!@#$& A-Za-z0-9]+', '_', 'g') AS name FROM part")
def filename_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", text.clean_filename(F.concat("p_name", F.lit(" ("), "p_brand", F.lit("): é&#$!@/"), "p_type", F.lit("*?"))).alias("name"))


ODD_NAMES = ("foo-Bar", "my_File", "Traffic Light (2)", "HTTPServer2Go", "7Up", "aB", "simple")
_ODD_NAMES = str(list(ODD_NAMES))


@query(rf"""WITH a AS (SELECT event_id, event_type || 'EventHTTPPart' || event_id || ' x' || ({_ODD_NAMES})[1 + event_id % 7] AS s FROM events UNION ALL SELECT -i, ({_ODD_NAMES})[i] FROM range(1, 8) t(i))
SELECT event_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(s, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^0-9a-zA-Z_]', '_', 'g'), '^([0-9])', '_\1') AS name FROM a""")
def snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.array(*map(F.lit, ODD_NAMES))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat("event_type", F.lit("EventHTTPPart"), F.col("event_id").cast("string"), F.lit(" x"), F.get(odd, (F.col("event_id") % 7).cast("int"))).alias("s"))
    few = spark.range(1).select(F.posexplode(odd).alias("k", "s")).select((-1 - F.col("k")).cast("long").alias("event_id"), "s")
    return e.unionByName(few).select("event_id", text.snake_case(F.col("s")).alias("name"))


@query("""WITH RECURSIVE n AS (SELECT p_partkey, p_brand, p_brand || (['', '_1', '', '_2'])[1 + p_partkey % 4] AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
f AS (
  SELECT p_brand, rn, p_partkey, [name] AS taken, name AS got FROM n WHERE rn = 1
  UNION ALL SELECT p_brand, rn, p_partkey, list_append(taken, got), got FROM (
    SELECT n.p_brand, n.rn, n.p_partkey, f.taken, CASE WHEN NOT list_contains(f.taken, n.name) THEN n.name ELSE n.name || '_' || list_min(list_filter(range(1, len(f.taken) + 2), lambda i: NOT list_contains(f.taken, n.name || '_' || i))) END AS got
    FROM f JOIN n ON n.p_brand = f.p_brand AND n.rn = f.rn + 1))
SELECT p_partkey, got AS name FROM f""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, ("", "_1", "", "_2"))), (F.col("p_partkey") % 4).cast("int"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_brand", ending).alias("name"))
    return text.unique_names(p, "name", "p_partkey")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'out/' ELSE 'clip_' END || printf('%08d', event_id - 5) AS name FROM events")
def clip_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", text.clip_name(F.when(F.col("event_id") % 2 == 0, "out/").otherwise("clip"), F.col("event_id") - 5).alias("name"))


@query("""SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' ${nothing} 2 ' || (user_id + event_id * 2) || ' ' || CAST(floor((event_id - 3) / 4.0) AS BIGINT) || ' ' || CAST(event_id / 4.0 AS DOUBLE) || ' ' || event_id % 7 || ' ${result.user_id // 0} ${${event_id}}' AS message FROM events""".replace("${${event_id}}'", "${' || event_id || '}'"))
def template_subst(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("result", F.struct("user_id", "event_type"))
    said = "user ${result.user_id} did ${{ result['event_type'] }} ${nothing} ${1+1} ${result.user_id + n * 2} ${(n - 3) // 4} ${n / 4} ${n % 7} ${result.user_id // 0} ${${n}}"
    return e.select("event_id", text.template(said, {"result": F.col("result"), "n": F.col("event_id")}).alias("message"))


@query("""SELECT p_partkey, round(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE, 4) AS lum, CASE WHEN r * 0.2126 + g * 0.7152 + b * 0.0722 > 180 THEN 0 ELSE 255 END AS ink, CAST(255 - r AS BIGINT) AS comp, CAST(b AS BIGINT) AS swapped
FROM (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 13 % 256 AS b FROM part)""")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *((F.col("p_partkey") * k % 256).alias(n) for n, k in zip("rgb", (37, 91, 13))))
    c = [F.col(n) for n in "rgb"]
    return p.select("p_partkey", F.round(text.luminance(*c), 4).alias("lum"), text.text_colour(*c)[0].alias("ink"), text.complement(*c)[0].alias("comp"), text.swap_channels(F.array(*c))[0].alias("swapped"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS zoo_url, regexp_extract(url, '([^/]*)$', 1) AS model_name, 'http://h/b/' || page_id AS object_url FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    s = text.split_model_url(F.col("url"))
    return p.select("page_id", s["zoo_url"].alias("zoo_url"), s["model_name"].alias("model_name"), text.object_url(F.lit("http://h/"), F.lit("b"), F.col("page_id").cast("string")).alias("object_url"))


# sources, sinks and nodes


@query("SELECT l_orderkey AS frame_id, CAST(l_linenumber AS INTEGER) AS n, 12.5::DOUBLE AS fps, 1280 AS frame_width FROM lineitem")
def source_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_frames(spark, f"{sf_dir}/lineitem.parquet", fps=12.5, width=1280).select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").cast("int").alias("n"), "fps", "frame_width")


@query("SELECT range AS frame_id, 'f' || range || '.jpg' AS file_path, -1::BIGINT AS frame_count FROM range(50)")
def source_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.frames_from(spark, (f"f{k}.jpg" for k in range(50)), "file_path string")


_WAV_HEAD = b"RIFF\x00\x00\x00\x00WAVEfmt \x10\x00\x00\x00\x01\x00\x01\x00\x80>\x00\x00\x00}\x00\x00\x02\x00\x10\x00LIST\x03\x00\x00\x00abc\x00data".hex()


@query("""WITH u AS (SELECT user_id, list(CAST(floor(value) AS BIGINT) ORDER BY event_id) AS s FROM events GROUP BY user_id), b AS (SELECT user_id, unnest(range(0, (len(s) + 6) // 7)) AS block_id, s FROM u)
SELECT user_id, block_id, list_sum(s[block_id * 7 + 1:block_id * 7 + 7])::BIGINT AS total, len(s[block_id * 7 + 1:block_id * 7 + 7])::INTEGER AS n FROM b""")
def audio_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WAV file of each user's values, with a chunk before its data and an odd number of samples."""
    two = lambda v, n: F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)))
    e = src.series(spark, sf_dir)
    item = F.struct("n", two(F.floor("value").cast("long"), 2).alias("h"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["h"]), "")
    files = e.groupBy("user_id").agg(body.alias("body")).select("user_id", F.unhex(F.concat(F.lit(_WAV_HEAD), two((F.length("body") / 2).cast("long"), 4), "body")).alias("content"))
    b = src.audio_blocks(files, 7, key="user_id")
    return b.select("user_id", "block_id", F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("samples").alias("n"))


@query("SELECT table_name || '.parquet' AS name, TRUE AS filled FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')")
def object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.list_objects(spark, sf_dir, "*.parquet").select("name", (F.col("size") > 0).alias("filled"))


@query(f"WITH {TRK} SELECT stream_id, frame_id, count(*) AS n FROM trk WHERE stream_id IN (1, 5) GROUP BY ALL")
def frame_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written by stream, and two streams read back."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/frames-{sf_dir.rstrip('/').split('/')[-1]}"
    sinks.write_frames(trk(spark, sf_dir), path, KEY, mode="overwrite")
    return sinks.read_stream(spark, path, [1, 5]).groupBy(F.col(KEY).cast("long").alias(KEY), "frame_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DET} SELECT frame_id, det_idx, category_id, x1, y1, x2, y2 FROM det WHERE frame_id % 5 = 0")
def coco_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations through COCO documents, one for each hundred frames."""
    d = det(spark, sf_dir).where("frame_id % 5 = 0")
    size = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    docs = d.groupBy(F.expr("frame_id div 100")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("det_idx").alias("id"), F.col("frame_id").alias("image_id"), "category_id", size.alias("bbox"), F.lit(0).alias("iscrowd"))).alias("annotations"))).alias("value"))
    a = src.parse_coco(docs)["annotations"]
    return a.select(F.col("image_id").alias("frame_id"), F.col("id").alias("det_idx"), F.col("category_id").cast("int").alias("category_id"), *box())


@query("SELECT 'o' || o_orderkey AS file_name, o_totalprice AS value FROM orders")
def regression_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    item = F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file_name"), F.col("o_totalprice").alias("value"))
    return src.parse_regression_truth(o.groupBy(F.col("o_orderkey") % 16).agg(F.to_json(F.struct(F.collect_list(item).alias("images"))).alias("value")))


@query(f"WITH {DET} SELECT frame_id, det_idx, round((x2 - x1) * (y2 - y1) / 307200.0, 9) AS share, CASE WHEN (x2 - x1) * (y2 - y1) / 307200.0 > 0.01 THEN 'large' ELSE 'small' END AS size FROM det")
def model_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model over batches of boxes."""

    def sizes(cols):
        import pyarrow as pa
        import pyarrow.compute as pc

        share = pc.divide(pc.multiply(pc.subtract(cols["x2"], cols["x1"]), pc.subtract(cols["y2"], cols["y1"])), 307200.0)
        return {"share": share, "size": pc.if_else(pc.greater(share, 0.01), pa.scalar("large"), pa.scalar("small"))}

    made = models.predict_rows(det(spark, sf_dir).select("frame_id", "det_idx", *box()), sizes, "share double, size string", ["x1", "y1", "x2", "y2"], 500)
    return made.select("frame_id", "det_idx", F.round("share", 9).alias("share"), "size")


@query(f"WITH {DET} SELECT label, count(*) AS n FROM det GROUP BY label")
def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that keeps a state over its batches and answers at the end of each partition."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen = Counter()
        for b in batches:
            seen.update(b.column("label").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["label", "n"])

    return models.predict(det(spark, sf_dir), count, "label string, n long", ["label"], 100).groupBy("label").agg(F.sum("n").alias("n"))


_GRAPH = """
vars: {least: 0.5, labels: [A, N]}
nodes:
  boxes: source
  chosen: {filter: {least: $(least), labels: $(labels)}}
  others: {filter: {least: 0.8, labels: [R]}}
  both: merge
  best: {top: {k: 1}}
connections:
  - [boxes, chosen, both, best]
  - [boxes, others, "both[1]"]
"""


@query(f"WITH {DET}, b AS (SELECT * FROM det WHERE (score >= 0.5 AND label IN ('A', 'N')) OR (score >= 0.8 AND label = 'R')) SELECT frame_id, det_idx, label FROM b QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_idx) = 1")
def pipeline_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches of a graph written as YAML, joined again."""
    node = graph.Node
    kinds = {
        "source": lambda: node(lambda: det(spark, sf_dir), tags=["boxes"]),
        "filter": lambda least, labels: node(lambda df: frames.class_filter(df.where(F.col("score") >= least), labels), needs=["label", "score"], requires=["boxes"]),
        "merge": lambda: node(frames.union_models),
        "top": lambda k: graph.analyzer(lambda df: frames.select_best(df, k)),
    }
    return graph.load_pipeline(_GRAPH, kinds).run().select("frame_id", "det_idx", "label")


@query(f"WITH {DET}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_idx) AS r FROM det WHERE label = 'A') SELECT frame_id, det_idx, label || ' box' AS tag FROM k WHERE r <= 2")
def analyzer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyzers one after another, an absent one and one with ``apply`` among them."""

    class Tag:
        def apply(self, df):
            return df.withColumn("tag", F.concat("label", F.lit(" box")))

    return graph.chain(det(spark, sf_dir), lambda df: frames.class_filter(df, ["A"]), None, lambda df: frames.select_best(df, 2), Tag()).select("frame_id", "det_idx", "tag")


@query(f"WITH {DET}, r AS (SELECT frame_id, count(*) FILTER (WHERE label = 'A') AS n, bool_or(label = 'R') AS known FROM det GROUP BY frame_id) SELECT frame_id, n::INTEGER AS n FROM r WHERE known")
def skip_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a box R have no result (null); a result may be empty."""
    item = F.when(F.col("label") == "A", F.struct("det_idx"))
    rows = det(spark, sf_dir).groupBy("frame_id").agg(F.when(F.bool_or(F.col("label") == "R"), F.array_compact(F.collect_list(item))).alias("results"))
    return frames.skip_missing(rows).select("frame_id", F.size("results").alias("n"))


@query(f"WITH {TRK} SELECT stream_id, max(frame_id) AS frame_id, arg_max(n, frame_id) AS n FROM (SELECT stream_id, frame_id, count(*) AS n FROM trk GROUP BY ALL) GROUP BY stream_id")
def latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.latest(trk(spark, sf_dir).groupBy(KEY, "frame_id").agg(F.count(F.lit(1)).alias("n")), KEY)


@query("SELECT event_id, user_id + 1 AS decode_us, event_id % 7 * 1000 AS infer_us FROM events")
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = micros("ts")
    e = src.series(spark, sf_dir)
    at = lambda c: F.timestamp_micros(c)
    for stage, t in (("source", us), ("decode", us + F.col("user_id") + 1), ("infer", us + F.col("user_id") + 1 + F.col("n") % 7 * 1000)):
        e = stamp(e, stage, at(t))
    d = stage_durations("timing")
    return e.select(F.col("n").alias("event_id"), d[0]["us"].alias("decode_us"), d[1]["us"].alias("infer_us"))


# fixed corners of the pictures made of events: one pixel each, of three numbers below 256
_RGB = ("event_id * 37 % 256", "event_id * 91 % 256", "event_id * 13 % 256 * (event_id % 3)")


def _pictures(spark, sf_dir):
    e = src.series(spark, sf_dir)
    px = [F.expr(c.replace("event_id", "n")) % 256 for c in _RGB]
    rgb = F.unhex(F.concat(*(F.lpad(F.hex(c), 2, "0") for c in px)))
    return e.select("user_id", F.col("n").alias("frame_id"), F.lit(1).alias("width"), F.lit(1).alias("height"), rgb.alias("rgb"))


_PX = "px AS (SELECT user_id, event_id, {0} % 256 AS r, {1} % 256 AS g, {2} % 256 AS b FROM events)".format(*_RGB)
_HSV = """mx AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM px),
hs AS (SELECT *, (d * CASE WHEN v > 0 THEN CAST(round_even(1044480.0 / v, 0) AS BIGINT) ELSE 0 END + 2048) >> 12 AS s, (CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END * CASE WHEN d > 0 THEN CAST(round_even(737280.0 / (6 * d), 0) AS BIGINT) ELSE 0 END + 2048) AS h0 FROM mx),
hv AS (SELECT user_id, event_id, CASE WHEN floor(h0 / 4096.0) < 0 THEN floor(h0 / 4096.0) + 180 ELSE floor(h0 / 4096.0) END AS h, s, v FROM hs)"""


@query(f"WITH {_PX}, {_HSV} SELECT user_id, row_number() OVER w AS n, round(coalesce((abs(h - lag(h) OVER w) + abs(s - lag(s) OVER w) + abs(v - lag(v) OVER w)) / 3.0, 0.0), 6) AS score FROM hv WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def change_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.change_scores(_pictures(spark, sf_dir), key="user_id").withColumn("score", F.round("score", 6))


@query(f"WITH {_PX}, l AS (SELECT *, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS l FROM px) SELECT user_id, row_number() OVER w AS n, CAST(coalesce(abs(l - lag(l) OVER w), 0) AS DOUBLE) AS score FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def change_scores_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.change_scores(_pictures(spark, sf_dir), luma_only=True, key="user_id")


@query(f"WITH {DET} SELECT frame_id, det_idx, concat_ws(',', CAST(x1 AS BIGINT) * 480 + CAST(y1 AS BIGINT), repeat((y2 - y1)::BIGINT || ',' || (480 - (y2 - y1))::BIGINT || ',', (x2 - x1)::BIGINT - 1) || (y2 - y1)::BIGINT, (640 - x2)::BIGINT * 480 + (480 - y2)::BIGINT) AS runs FROM det WHERE frame_id % 50 = 0")
def mask_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled boxes as masks of the frame."""
    d = det(spark, sf_dir).where("frame_id % 50 = 0")
    w, h = (F.col("x2") - F.col("x1")).cast("int"), (F.col("y2") - F.col("y1")).cast("int")
    bits = F.unhex(F.repeat(F.lit("01"), w * h))
    return d.select("frame_id", "det_idx", F.array_join(media.mask_rle(F.col("x1").cast("int"), F.col("y1").cast("int"), w, h, bits, 640, 480).cast("array<string>"), ",").alias("runs"))


@query(f"WITH {DET} SELECT frame_id, det_idx, x1 || ',' || y1 || ',' || score || ',' || x2 || ',' || y2 || ',1.0' AS points FROM det")
def keypoints_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("score").alias("score")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(1.0).alias("score")))
    return det(spark, sf_dir).select("frame_id", "det_idx", F.array_join(evaluate.flat_keypoints(marks).cast("array<string>"), ",").alias("points"))


@query(f"WITH {DET} SELECT frame_id, det_idx FROM det WHERE frame_id IN (SELECT DISTINCT frame_id FROM det ORDER BY frame_id LIMIT 25)")
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_images(det(spark, sf_dir), "frame_id", 25).select("frame_id", "det_idx")


_TOP, _BOTTOM = ((100.0, 50.0), (500.0, 80.0)), ((40.0, 400.0), (600.0, 440.0))


@query("""WITH g AS (SELECT r, c, unnest([{'i': 0, 'r': r, 'c': c}, {'i': 1, 'r': r, 'c': c + 1}, {'i': 2, 'r': r + 1, 'c': c + 1}, {'i': 3, 'r': r + 1, 'c': c}]) AS p FROM (SELECT range AS r FROM range(3)), (SELECT range AS c FROM range(4)))
SELECT CAST(r * 4 + c AS INTEGER) AS zone_index, CAST(p.i AS INTEGER) AS corner, round((100.0 + 400.0 * p.c / 4) * (1 - p.r / 3) + (40.0 + 560.0 * p.c / 4) * p.r / 3, 6) AS x, round((50.0 + 30.0 * p.c / 4) * (1 - p.r / 3) + (400.0 + 40.0 * p.c / 4) * p.r / 3, 6) AS y FROM g""")
def zone_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(z, k, x, y) for z, poly in enumerate(geo.grid_polygons(_TOP, _BOTTOM, 4, 3)) for k, (x, y) in enumerate(poly)]
    return spark.createDataFrame(rows, "zone_index int, corner int, x double, y double").withColumns({c: F.round(c, 6) for c in "xy"})


@query("SELECT * FROM (VALUES (0, 'det_a', 'detection', 'cpu,gpu', 'zoo/default', '30'), (1, 'cls_b', 'classification', 'cpu', 'zoo/own', '25'), (2, 'det_c', 'detection', 'gpu', 'zoo/default', '30')) v(ord, model_name, task, hardware, zoo_url, fps)")
def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_ = """
models:
  det_a: {task: detection, hardware: [cpu, gpu]}
  cls_b: {task: classification, hardware: cpu, zoo_url: zoo/own, metadata: {fps: 25}}
  det_c: {task: detection, hardware: [gpu]}
defaults: {metadata: {fps: 30}}
"""
    c = catalog.load(spark, text_)
    return c.select("ord", "model_name", "task", F.concat_ws(",", "hardware").alias("hardware"), F.coalesce("zoo_url", F.lit("zoo/default")).alias("zoo_url"), F.col("metadata")["fps"].alias("fps"))


@query("SELECT page_id, CASE regexp_extract(lower(f), '\\.([a-z0-9]+)$', 1) WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'wav' THEN 'audio' END AS kind FROM (SELECT page_id, 'x' || page_id || (['.JPG', '.mp4', '.wav', '.txt', ''])[1 + page_id % 5] AS f FROM pages)")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    end = F.get(F.array(*map(F.lit, (".JPG", ".mp4", ".wav", ".txt", ""))), (F.col("page_id") % 5).cast("int"))
    return p.select("page_id", text.media_kind(F.concat(F.lit("x"), F.col("page_id").cast("string"), end)).alias("kind"))


# pairing and sets of tracks

_PAIR = f"""pa AS (SELECT frame_id, det_idx AS i, row_number() OVER (PARTITION BY frame_id ORDER BY det_idx) AS rn, {BOXES} FROM det WHERE label = 'A'),
pb AS (SELECT frame_id, det_idx AS j, {BOXES} FROM det WHERE label = 'N'),
pe AS (SELECT a.frame_id, a.rn, b.j, {_INTER} / ({_AREA.format(p='a')} + {_AREA.format(p='b')} - {_INTER}) AS iou FROM pa a JOIN pb b ON a.frame_id = b.frame_id WHERE {_INTER} > 0),
wk AS (
  SELECT frame_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(0.0 AS DOUBLE) AS total FROM (SELECT DISTINCT frame_id FROM pe)
  UNION ALL
  SELECT wk.frame_id, o.rn, CASE WHEN o.j IS NULL THEN used ELSE list_append(used, o.j) END, total + coalesce(o.iou, 0)
  FROM wk JOIN (SELECT frame_id, rn, j, iou FROM pe UNION ALL SELECT frame_id, rn, NULL, NULL FROM pa) o ON o.frame_id = wk.frame_id AND o.rn = wk.rn + 1 AND (o.j IS NULL OR NOT list_contains(used, o.j)))"""


@query(f"WITH RECURSIVE {DET}, {_PAIR} SELECT frame_id, round(max(total), 6) AS total FROM wk GROUP BY frame_id")
def box_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sum of IoU by pairing boxes A with boxes N; the SQL goes through all pairings."""
    d = det(spark, sf_dir)
    m = evaluate.match_boxes(d.where("label = 'A'"), d.where("label = 'N'"))
    return m.groupBy("frame_id").agg(F.round(F.sum("iou"), 6).alias("total"))


def _track_sets(spark, sf_dir):
    """Tracks by their first and last frame, at their last place; those last seen late are tracked."""
    t = trk(spark, sf_dir)
    each = t.groupBy(KEY, "track_id").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), *(F.max_by(n, "frame_id").alias(n) for n in ("x1", "y1", "x2", "y2")))
    return each.where("last % 2 = 0"), each.where("last % 2 = 1 or track_id % 3 = 0")


_SETS = """ea AS (SELECT stream_id, track_id, min(frame_id) AS first, max(frame_id) AS last, arg_max(x1, frame_id) AS x1, arg_max(y1, frame_id) AS y1, arg_max(x2, frame_id) AS x2, arg_max(y2, frame_id) AS y2 FROM trk GROUP BY ALL),
ta AS (SELECT * FROM ea WHERE last % 2 = 0), tb AS (SELECT * FROM ea WHERE last % 2 = 1 OR track_id % 3 = 0)"""


@query(f"WITH {TRK}, {_SETS} SELECT stream_id, track_id, last FROM ta UNION SELECT stream_id, track_id, last FROM tb")
def track_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.union_tracks(*_track_sets(spark, sf_dir)).select(KEY, "track_id", "last")


@query(f"WITH {TRK}, {_SETS} SELECT stream_id, track_id FROM ta WHERE track_id NOT IN (SELECT track_id FROM tb)")
def track_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.subtract_tracks(*_track_sets(spark, sf_dir)).select(KEY, "track_id")


@query(f"""WITH {TRK}, {_SETS}, nr AS (SELECT a.track_id AS ia, b.track_id AS ib, a.last - a.first > b.last - b.first AS older FROM ta a JOIN tb b ON 1 - {_INTER} / ({_AREA.format(p='a')} + {_AREA.format(p='b')} - {_INTER}) < 0.4)
SELECT 'tracked' AS side, stream_id, track_id FROM ta WHERE track_id NOT IN (SELECT ia FROM nr WHERE NOT older) UNION ALL SELECT 'lost', stream_id, track_id FROM tb WHERE track_id NOT IN (SELECT ib FROM nr WHERE older)""")
def track_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _track_sets(spark, sf_dir)
    left = tracking.drop_double_tracks(a, b, distance=0.4)
    return left[0].select(F.lit("tracked").alias("side"), KEY, "track_id").unionByName(left[1].select(F.lit("lost").alias("side"), KEY, "track_id"))


# jobs of the outbox


@query("""WITH j AS (SELECT event_id AS job_id, (['upload', 'reference', 'notify'])[1 + event_id % 3] AS kind, CASE WHEN event_id % 3 < 2 THEN event_id + 2 - event_id % 3 END AS dependent, epoch_us(ts) AS us, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 5 <> 0 THEN 'done' END AS outcome FROM events),
n AS (SELECT max(us) - 36000000000 AS now FROM j),
w AS (SELECT j.*, count(d.job_id) FILTER (WHERE d.outcome IS NULL OR d.outcome <> 'done') AS waits, bool_or(coalesce(d.outcome = 'failed', FALSE)) AS broken FROM j LEFT JOIN j d ON d.dependent = j.job_id GROUP BY ALL)
SELECT job_id, CASE WHEN outcome IS NOT NULL THEN outcome WHEN us > now THEN 'waiting' WHEN now - us > 86400000000 THEN 'timed out' WHEN broken THEN 'blocked' WHEN waits > 0 THEN 'waiting' ELSE 'ready' END AS state FROM w, n""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads and references come before the notification that names them."""
    e = src.series(spark, sf_dir).withColumn("us", micros("ts"))
    kind = F.get(F.array(*map(F.lit, ("upload", "reference", "notify"))), (F.col("n") % 3).cast("int"))
    dependent = F.when(F.col("n") % 3 < 2, F.col("n") + 2 - F.col("n") % 3)
    made = e.select(F.col("n").alias("job_id"), kind.alias("kind"), dependent.alias("dependent"), "ts")
    outcomes = e.select(F.col("n").alias("job_id"), F.when(F.col("n") % 11 == 0, "failed").when(F.col("n") % 5 != 0, "done").alias("state")).where("state is not null")
    now = e.agg(F.max("us")).first()[0] - 36_000_000_000
    return jobs.job_states(made, outcomes, F.timestamp_micros(F.lit(now)), 86_400.0).select("job_id", "state")
