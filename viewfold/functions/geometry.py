"""Box, point and polygon expressions. A box is a tuple of four columns (x1, y1, x2, y2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
ANCHORS = ("CENTER", "CENTER_LEFT", "CENTER_RIGHT", "TOP_CENTER", "TOP_LEFT", "TOP_RIGHT", "BOTTOM_LEFT", "BOTTOM_CENTER", "BOTTOM_RIGHT")


def box(prefix: str = "", names=("x1", "y1", "x2", "y2")) -> Box:
    return tuple(F.col(prefix + n) for n in names)


def columns(b: Box, prefix: str = "") -> list[Column]:
    """The box as output columns."""
    return [c.alias(prefix + n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Null where both boxes are empty."""
    i = intersection(a, b)
    return F.try_divide(i, area(a) + area(b) - i)


def ios(a: Box, b: Box) -> Column:
    return F.try_divide(intersection(a, b), F.least(area(a), area(b)))


def to_center(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def from_center(c: Box) -> Box:
    return c[0] - c[2] / 2, c[1] - c[3] / 2, c[0] + c[2] / 2, c[1] + c[3] / 2


def corners(b: Box) -> Column:
    """Array of the four corners' coordinates, clockwise from the top left."""
    return F.array(b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])


def anchor(b: Box, name: str) -> tuple[Column, Column]:
    if name not in ANCHORS:
        raise ValueError(f"{name} is not one of {ANCHORS}")
    x = b[0] if "LEFT" in name else b[2] if "RIGHT" in name else (b[0] + b[2]) / 2
    y = b[1] if "TOP" in name else b[3] if "BOTTOM" in name else (b[1] + b[3]) / 2
    return x, y


def frame_anchor(width: Column, height: Column, name: str) -> tuple[Column, Column]:
    """An anchor of the whole frame, cut to whole numbers."""
    x, y = anchor((F.lit(0), F.lit(0), width, height), name)
    return x.cast("int"), y.cast("int")


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_cross(a, b, c, d) -> Column:
    """Whether ab and cd cross; points are pairs of columns. Equal sides, both zero included, do
    not count, so segments on one line never cross."""
    return (_side(*a, *b, *c) != _side(*a, *b, *d)) & (_side(*c, *d, *a) != _side(*c, *d, *b))


def extend(b: Box, mode: str, extent: float, aspect: float, width, height) -> Box:
    """The box grown for cropping by ``extent`` percent, rounded half to even, within the frame.

    none: both sides alike. long_side: the longer side grows, the other follows the aspect ratio.
    area: the area grows by (1 + extent)^2 at the aspect ratio, never below the box."""
    w, h = b[2] - b[0], b[3] - b[1]
    if mode == "none":
        dx, dy = w * (extent / 200.0), h * (extent / 200.0)
    elif mode == "long_side":
        s = extent / 100.0 + 1.0
        tall = h > w
        dx = (F.when(tall, h * s * aspect).otherwise(w * s) - w) / 2
        dy = (F.when(tall, h * s).otherwise(w * s / aspect) - h) / 2
    elif mode == "area":
        tall = F.greatest(F.sqrt(w * h * ((extent / 100.0 + 1) ** 2) / aspect), h)
        wide = F.greatest(tall * aspect, w)
        dx, dy = (wide - w) / 2, (wide / aspect - h) / 2
    else:
        raise ValueError(f"unknown mode {mode}")
    limit = [F.lit(float(v)) if not isinstance(v, Column) else v.cast("double") for v in (width, height)]
    moved = (b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy)
    return tuple(F.least(limit[k % 2], F.greatest(F.lit(0.0), F.bround(v))) for k, v in enumerate(moved))


def crop_rect(b: Box, width: int, height: int) -> tuple[Box, Column]:
    """The rounded box with ordered corners inside the frame, and whether it has an area."""
    r = [F.bround(c) for c in b]
    lim = lambda c, m: F.least(F.lit(float(m)), F.greatest(F.lit(0.0), c))
    out = (lim(F.least(r[0], r[2]), width), lim(F.least(r[1], r[3]), height), lim(F.greatest(r[0], r[2]), width), lim(F.greatest(r[1], r[3]), height))
    return out, (out[0] != out[2]) & (out[1] != out[3])


def clip_and_scale(b: Box, width: int, height: int, scale: float = 1.0) -> Box:
    """Clipped to the frame, then shrunk about the centre by ``scale`` in (0, 1]."""
    lim = lambda c, m: F.least(F.lit(float(m)), F.greatest(F.lit(0.0), c))
    c = (lim(b[0], width), lim(b[1], height), lim(b[2], width), lim(b[3], height))
    x, y, w, h = to_center(c)
    return from_center((x, y, w * scale, h * scale))


def letterbox(b: Box, mode: str, src: tuple[int, int], dst: tuple[int, int]) -> Box:
    """A box of a ``dst`` picture mapped back to the ``src`` picture it was made from: stretch,
    letterbox (bars around), crop_first or crop_last (centred part of the destination's shape)."""
    sw, sh, dw, dh = map(float, (*src, *dst))
    if mode == "stretch":
        kx, ky, ox, oy = sw / dw, sh / dh, 0.0, 0.0
    elif mode == "letterbox":
        k = max(sw / dw, sh / dh)
        kx = ky = k
        ox, oy = -(dw * k - sw) / 2, -(dh * k - sh) / 2
    elif mode in ("crop_first", "crop_last"):
        k = min(sw / dw, sh / dh)
        kx = ky = k
        ox, oy = (sw - dw * k) / 2, (sh - dh * k) / 2
    else:
        raise ValueError(f"unknown mode {mode}")
    return b[0] * kx + ox, b[1] * ky + oy, b[2] * kx + ox, b[3] * ky + oy


def in_polygon(x: Column, y: Column, polygon: list[tuple[int, int]]) -> Column:
    """Whether a point is inside a fixed polygon or on its edge, unrolled over the edges: even-odd
    ray casting, or on a side. Zones round points up to whole numbers before this."""
    px, py = x, y
    odd, on = [], []
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        cross = (px - float(ax)) * float(by - ay) - (py - float(ay)) * float(bx - ax)
        on.append((cross == 0) & px.between(float(min(ax, bx)), float(max(ax, bx))) & py.between(float(min(ay, by)), float(max(ay, by))))
        if ay != by:
            at = (py - float(ay)) * (float(bx - ax) / float(by - ay)) + float(ax)
            odd.append((((py < float(ay)) != (py < float(by))) & (px < at)).cast("int"))
    return reduce(lambda p, q: p | q, on) | (reduce(lambda p, q: p + q, odd) % 2 == 1)


def polygon_area(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]))) / 2


def clip_area(polygon: list[tuple[float, float]], rect: tuple[float, float, float, float]) -> float:
    """Area of a convex polygon within a rectangle, by cutting it at each side in turn."""
    x1, y1, x2, y2 = rect
    pts = [(float(x), float(y)) for x, y in polygon]
    for axis, bound, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        out = []
        for p, q in zip(pts, pts[1:] + pts[:1]):
            dp, dq = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if dp >= 0:
                out.append(p)
            if dp * dq < 0:
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        pts = out
        if not pts:
            return 0.0
    return polygon_area(pts)


def is_axis_rect(polygon: list[tuple[float, float]]) -> bool:
    xs, ys = sorted({x for x, _ in polygon}), sorted({y for _, y in polygon})
    return len(polygon) == 4 and len(xs) == len(ys) == 2 and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(polygon, polygon[1:] + polygon[:1]))


def iopa(b: Box, polygon: list[tuple[int, int]]) -> Column:
    """Share of a fixed convex polygon's area that the box covers. An axis-aligned rectangle is an
    expression; other polygons go through an Arrow batch function."""
    if is_axis_rect(polygon):
        xs, ys = sorted(x for x, _ in polygon), sorted(y for _, y in polygon)
        rect = tuple(F.lit(float(v)) for v in (xs[0], ys[0], xs[-1], ys[-1]))
        return intersection(b, rect) / polygon_area(polygon)
    whole = polygon_area(polygon)

    @F.pandas_udf("double")
    def share(x1, y1, x2, y2):
        import pandas as pd

        return pd.Series([clip_area(polygon, r) / whole for r in zip(x1, y1, x2, y2)])

    return share(*b)


def grid_polygons(top: tuple[tuple[float, float], tuple[float, float]], bottom: tuple[tuple[float, float], tuple[float, float]], cols: int, rows: int) -> list[list[tuple[float, float]]]:
    """Quads of a grid between two guide lines, row by row, for writing zones."""

    def at(line, t):
        (ax, ay), (bx, by) = line
        return ax + t * (bx - ax), ay + t * (by - ay)

    def point(c, r):
        return at((at(top, c / cols), at(bottom, c / cols)), r / rows)

    return [[point(c, r), point(c + 1, r), point(c + 1, r + 1), point(c, r + 1)] for r in range(rows) for c in range(cols)]
