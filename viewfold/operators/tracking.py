"""Multi-object tracking per stream, and selection that sticks to tracks.

Both are state machines over the frames of one stream. The same class serves a batch (frames of a
stream in one Arrow group) and a stream (state kept by stream_id); streams are independent, so
the partitioning is by stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from viewfold.functions.folds import floats, in_order, per_list
from viewfold.functions.geometry import box, iou
from viewfold.schema import BOX, by, require_columns

_POSITION, _VELOCITY = 1 / 20, 1 / 160


class BoxFilter:
    """Constant-velocity Kalman filter over (centre x, centre y, width / height, height), for many
    tracks at once. Noise follows the height."""

    move = np.eye(8) + np.eye(8, k=4)

    @staticmethod
    def measure(b: np.ndarray) -> np.ndarray:
        w, h = b[..., 2] - b[..., 0], b[..., 3] - b[..., 1]
        return np.stack([b[..., 0] + w / 2, b[..., 1] + h / 2, w / h, h], axis=-1)

    @staticmethod
    def boxes(mean: np.ndarray) -> np.ndarray:
        x, y, r, h = (mean[..., k] for k in range(4))
        w = r * h
        return np.stack([x - w / 2, y - h / 2, x + w / 2, y + h / 2], axis=-1)

    @staticmethod
    def _noise(h, pos: float, vel: float, ratio: float, ratio_v: float) -> np.ndarray:
        one = np.ones_like(h)
        std = np.stack([pos * h, pos * h, ratio * one, pos * h, vel * h, vel * h, ratio_v * one, vel * h], axis=-1)
        return std**2

    def start(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.concatenate([z, np.zeros_like(z)], axis=-1)
        return mean, self._noise(z[..., 3], 2 * _POSITION, 10 * _VELOCITY, 1e-2, 1e-5)[..., None] * np.eye(8)

    def predict(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = self._noise(mean[:, 3], _POSITION, _VELOCITY, 1e-2, 1e-5)
        return mean @ self.move.T, self.move @ cov @ self.move.T + q[:, :, None] * np.eye(8)

    def update(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s2 = (_POSITION * mean[..., 3]) ** 2
        seen = cov[..., :4, :4] + np.stack([s2, s2, np.full_like(s2, 1e-2), s2], axis=-1)[..., None] * np.eye(4)
        gain = np.linalg.solve(seen, cov[..., :4, :]).swapaxes(-1, -2)
        return mean + (gain @ (z - mean[..., :4])[..., None])[..., 0], cov - gain @ cov[..., :4, :]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    inter = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None).prod(axis=2)
    size = lambda v: (v[:, 2:] - v[:, :2]).prod(axis=1)
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """A cheapest pairing of rows and columns (shortest augmenting paths with potentials)."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.full(m + 1, n)
    for r in range(n):
        row_of[m] = r
        at, least, came, used = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        while row_of[at] != n:
            used[at] = True
            i = row_of[at]
            free = np.flatnonzero(~used[:m])
            d = cost[i, free] - u[i] - v[free]
            better = d < least[free]
            least[free[better]] = d[better]
            came[free[better]] = at
            nxt = free[int(least[free].argmin())]
            delta = least[nxt]
            cols = np.flatnonzero(used)
            u[row_of[cols]] += delta
            v[cols] -= delta
            least[free] -= delta
            at = nxt
        while at != m:
            row_of[at] = row_of[came[at]]
            at = came[at]
    return sorted((int(row_of[c]), c) for c in range(m) if row_of[c] != n)


def match(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs with a cost up to ``limit``, and the rows and columns left over."""
    pairs = [(r, c) for r, c in assign(np.where(cost > limit, limit + 1e-4, cost)) if cost[r, c] <= limit]
    return pairs, *_left(pairs, *cost.shape)


def _left(pairs: list[tuple[int, int]], n: int, m: int) -> tuple[list[int], list[int]]:
    rows, cols = {r for r, _ in pairs}, {c for _, c in pairs}
    return [r for r in range(n) if r not in rows], [c for c in range(m) if c not in cols]


#: Candidates that are compared at once.
_CHUNK = 1 << 20


def overlapping(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``a``, rows of ``b``, IoU) of the boxes that overlap, in order. Boxes are compared with
    those of neighbouring cells only, for each two classes of size in cells of the larger."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    kinds = []
    for v in (a, b):
        size = v[:, 2:] - v[:, :2]
        fit = np.flatnonzero(np.isfinite(v).all(axis=1) & (size > 0).all(axis=1))
        level = np.ceil(np.log2(size[fit])).astype(np.int64)
        kinds.append([(k, fit[(level == k).all(axis=1)]) for k in np.unique(level, axis=0)])
    for ka, ra in kinds[0]:
        for kb, rb in kinds[1]:
            cell = np.exp2(np.maximum(ka, kb))
            ca, cb = np.floor(a[ra, :2] / cell), np.floor(b[rb, :2] / cell)
            low = np.minimum(ca.min(axis=0), cb.min(axis=0)) - 1
            ca, cb = (ca - low).astype(np.int64), (cb - low).astype(np.int64)
            wide = max(ca[:, 1].max(), cb[:, 1].max()) + 2
            key = cb[:, 0] * wide + cb[:, 1]
            order = np.argsort(key, kind="stable")
            key = key[order]
            for dx in (-1, 0, 1):
                # three cells of a column are one range of keys
                at = (ca[:, 0] + dx) * wide + ca[:, 1]
                first, end = np.searchsorted(key, at - 1, "left"), np.searchsorted(key, at + 1, "right")
                upto = np.cumsum(end - first)
                s = 0
                while s < len(ra):
                    e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + _CHUNK, "right")))
                    n = (end - first)[s:e]
                    i = np.repeat(np.arange(s, e), n)
                    j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s:e], n)]
                    x, y = a[ra[i]], b[rb[j]]
                    inter = np.clip(np.minimum(x[:, 2:], y[:, 2:]) - np.maximum(x[:, :2], y[:, :2]), 0, None).prod(axis=1)
                    hit = inter > 0
                    x, y, inter = x[hit], y[hit], inter[hit]
                    union = (x[:, 2:] - x[:, :2]).prod(axis=1) + (y[:, 2:] - y[:, :2]).prod(axis=1) - inter
                    found.append((ra[i[hit]], rb[j[hit]], inter / union))
                    s = e
    i, j, over = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((j, i))
    return i[order], j[order], over[order]


def assign_near(n: int, m: int, rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, single: float) -> list[tuple[int, int]]:
    """A cheapest choice of pairs among those listed (in order of rows) where a row without a pair costs
    ``single``: shortest augmenting paths with potentials along the pairs listed."""
    own = (np.bincount(rows, minlength=n)[rows] == 1) & (np.bincount(cols, minlength=m)[cols] == 1)
    pairs = list(zip(rows[own].tolist(), cols[own].tolist()))
    rows, cols, cost = rows[~own], cols[~own], cost[~own]
    names, start = np.unique(rows, return_index=True)
    start = [*start.tolist(), len(rows)]
    u, v = [0.0] * len(names), np.zeros(m)
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    for r in range(len(names)):
        least: dict[int, float] = {}
        came: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        i, base, best, alone, to = r, 0.0, np.inf, r, None
        while True:
            if base + single - u[i] < best:
                best, alone = base + single - u[i], i
            s, e = start[i], start[i + 1]
            d = base + cost[s:e] - u[i] - v[cols[s:e]]
            for j, x in zip(cols[s:e].tolist(), d.tolist()):
                if x < best and j not in done and x < least.get(j, np.inf):
                    least[j], came[j] = x, i
                    heappush(heap, (x, j))
            while heap and (heap[0][1] in done or heap[0][0] > least[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            base, to = heappop(heap)
            if to not in row_of:
                best = base
                break
            done[to] = base
            i, to = row_of[to], None
        u[r] += best
        for j, x in done.items():
            u[row_of[j]] += best - x
            v[j] -= best - x
        if to is None:  # the row that stays alone leaves its column to the one before it
            if alone == r:
                continue
            to = col_of.pop(alone)
        while True:
            i = came[to]
            row_of[to], before = i, col_of.get(i)
            col_of[i] = to
            if i == r:
                break
            to = before
    return sorted(pairs + [(int(names[i]), j) for i, j in col_of.items()])


def match_near(a: np.ndarray, b: np.ndarray, limit: float, weight: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """``match`` of boxes by 1 - IoU, or 1 - IoU times the second box's ``weight``. Below a limit of 1
    only boxes that overlap can be a pair, and no other is looked at."""
    if limit >= 1:
        over = iou_matrix(a, b)
        return match(1 - (over if weight is None else over * weight[None, :]), limit)
    rows, cols, over = overlapping(a, b)
    cost = 1 - (over if weight is None else over * weight[cols])
    near = cost <= limit
    pairs = assign_near(len(a), len(b), rows[near], cols[near], cost[near], limit + 1e-4)
    return pairs, *_left(pairs, len(a), len(b))


@dataclass
class Track:
    number: int
    box: np.ndarray
    score: float
    mean: np.ndarray
    cov: np.ndarray
    first: int
    last: int
    active: bool
    lost: bool = False
    sighting: int = -1


def places(tracks: list[Track]) -> np.ndarray:
    return BoxFilter.boxes(np.stack([t.mean for t in tracks])) if tracks else np.zeros((0, 4))


@dataclass
class Tracker:
    """Two-stage association. Boxes with a score over ``track_over`` are matched by IoU times
    score with tracked and lost tracks, then those between 0.1 and it by IoU alone with what is
    still tracked; a score equal to it joins neither. A new track needs ``track_over`` + 0.1, and
    a second match to count, unless it begins in the stream's first frame. A lost track is kept
    for ``buffer`` frames."""

    track_over: float = 0.25
    buffer: int = 30
    match_limit: float = 0.8
    frame: int = 0
    last_number: int = 0
    tracked: list[Track] = field(default_factory=list)
    lost: list[Track] = field(default_factory=list)
    gone: set[int] = field(default_factory=set)
    filter = BoxFilter()

    def reset(self) -> None:
        """At a scene cut: tracks go, the counts of frames and tracks go on."""
        self.tracked, self.lost, self.gone = [], [], set()

    def _see(self, tracks: list[Track], ks: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> None:
        if not tracks:
            return
        mean, cov = self.filter.update(np.stack([t.mean for t in tracks]), np.stack([t.cov for t in tracks]), BoxFilter.measure(boxes[ks]))
        for t, k, score, t.mean, t.cov in zip(tracks, ks.tolist(), scores[ks].tolist(), mean, cov):
            t.score, t.last, t.active, t.lost, t.sighting = score, self.frame, True, False, k

    def _match(self, tracks: list[Track], ks: np.ndarray, limit: float, boxes: np.ndarray, scores: np.ndarray, weigh: bool = True) -> tuple[list[Track], np.ndarray]:
        """Tracks and boxes that find no partner; the others are seen."""
        pairs, rest, left = match_near(places(tracks), boxes[ks], limit, scores[ks] if weigh else None)
        self._see([tracks[r] for r, _ in pairs], ks[[c for _, c in pairs]], boxes, scores)
        return [tracks[r] for r in rest], ks[left]

    def update(self, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(row, track number, filtered box) for each row of a frame that belongs to a track."""
        self.frame += 1
        boxes, scores = np.asarray(boxes, dtype=float).reshape(-1, 4), np.asarray(scores, dtype=float)
        high = np.flatnonzero(scores > self.track_over)
        low = np.flatnonzero((scores > 0.1) & (scores < self.track_over))
        for t in (*self.tracked, *self.lost):
            t.sighting = -1
        sure, unsure = [t for t in self.tracked if t.active], [t for t in self.tracked if not t.active]
        names = {t.number for t in sure}
        pool = sure + [t for t in self.lost if t.number not in names]
        if pool:
            mean = np.stack([t.mean for t in pool])
            for k, t in enumerate(pool):
                if t.lost:
                    mean[k, 7] = 0
            mean, cov = self.filter.predict(mean, np.stack([t.cov for t in pool]))
            for t, m, c in zip(pool, mean, cov):
                t.mean, t.cov = m, c
        rest, high = self._match(pool, high, self.match_limit, boxes, scores)
        newly_lost, _ = self._match([t for t in rest if not t.lost], low, 0.5, boxes, scores, weigh=False)
        for t in newly_lost:
            t.lost = True
        rest, high = self._match(unsure, high, 0.7, boxes, scores)
        removed = {t.number for t in rest}
        high = high[scores[high] >= self.track_over + 0.1]
        fresh = []
        if len(high):
            for k, score, mean, cov in zip(high.tolist(), scores[high].tolist(), *self.filter.start(BoxFilter.measure(boxes[high]))):
                self.last_number += 1
                fresh.append(Track(self.last_number, boxes[k], score, mean, cov, self.frame, self.frame, self.frame == 1, False, k))
        expired = {t.number for t in self.lost if t.lost and self.frame - t.last > self.buffer}
        found = [t for t in self.lost if not t.lost]
        now = [t for t in self.tracked if not t.lost and t.number not in removed] + fresh + found
        names = {t.number for t in now}
        # what expires in this frame still takes part in the next one
        self.lost = [t for t in (*self.lost, *newly_lost) if t.number not in names and t.number not in self.gone]
        self.gone = expired | removed
        self.tracked, self.lost = self._without_doubles(now, self.lost)
        seen = [t for t in self.tracked if t.active and t.sighting >= 0]
        return [(t.sighting, t.number, place) for t, place in zip(seen, places(seen))]

    @staticmethod
    def _without_doubles(a: list[Track], b: list[Track]) -> tuple[list[Track], list[Track]]:
        """Of a tracked and a lost track in nearly the same place the younger goes."""
        if not a or not b:
            return a, b
        rows, cols, over = overlapping(places(a), places(b))
        near = 1 - over < 0.15
        drop_a, drop_b = set(), set()
        for i, j in zip(rows[near].tolist(), cols[near].tolist()):
            if a[i].last - a[i].first > b[j].last - b[j].first:
                drop_b.add(j)
            else:
                drop_a.add(i)
        return [t for i, t in enumerate(a) if i not in drop_a], [t for j, t in enumerate(b) if j not in drop_b]


@dataclass
class StickySelector:
    """Keeps chosen tracks until they have been missing for more than ``timeout`` frames. Free
    slots go to the best others among the first of as many best boxes as there are free slots, so
    one may stay free."""

    top_k: int = 1
    timeout: int = 30
    chosen: dict[int, int] = field(default_factory=dict)

    def update(self, numbers: list, metric: np.ndarray) -> list[int]:
        """Rows of the frame to keep, the chosen ones in order of choice."""
        at = {n: k for k, n in enumerate(numbers) if n is not None}
        self.chosen = {n: 0 if n in at else missing + 1 for n, missing in self.chosen.items()}
        self.chosen = {n: m for n, m in self.chosen.items() if m <= self.timeout}
        free = self.top_k - len(self.chosen)
        if free > 0:
            best = [k for k in np.argsort(-np.asarray(metric, dtype=float), kind="stable").tolist() if numbers[k] is not None][:free]
            for k in best:
                self.chosen.setdefault(numbers[k], 0)
        return [at[n] for n in self.chosen if n in at]


def smooth_tracks(df: DataFrame, stream: str | None = None, track: str = "track_id") -> DataFrame:
    """``df`` with the boxes that the tracker's filter makes of each track's own sightings, in order
    of frame: predicted over every frame between, and corrected at each sighting."""
    keys = by(stream, track)
    filter_ = BoxFilter()

    def run(frames, *sides):
        z = BoxFilter.measure(np.array(sides, dtype=float).T)
        mean, cov = filter_.start(z[0])
        out = [BoxFilter.boxes(mean)]
        for k in range(1, len(z)):
            for _ in range(int(frames[k] - frames[k - 1])):
                mean, cov = (v[0] for v in filter_.predict(mean[None], cov[None]))
            mean, cov = filter_.update(mean, cov, z[k])
            out.append(BoxFilter.boxes(mean))
        return (frames, *np.array(out).T.tolist())

    walk = per_list(run, "frame_id long, x1 double, y1 double, x2 double, y2 double")
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame_id", *(F.col(c).cast("double").alias(c) for c in BOX)))).alias("__r"))
    return df.drop(*BOX).join(rows.select(*keys, F.inline(walk("__r"))), [*keys, "frame_id"])


def union_tracks(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """The rows of ``a`` and those of ``b`` whose track ``a`` doesn't have; of rows of a track in one
    table the first by its columns stays."""
    rows = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    over = W.partitionBy(*keys).orderBy("__side", *(c for c in a.columns if c not in keys))
    return rows.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__side", "__n")


def subtract_tracks(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def drop_double_tracks(tracked: DataFrame, lost: DataFrame, keys: tuple[str, ...] = (), distance: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Of a tracked and a lost track nearly in the same place (1 - IoU below ``distance``) the younger
    goes, the tracked one if both have the same age. Rows: (keys, track_id, first, last, box)."""
    near = 1 - distance
    age = F.col("last") - F.col("first")
    # copies of a box differ in nothing but age, and only the greatest age of the other side counts
    a, b = (df.groupBy(*keys, *BOX).agg(F.max(age).alias("age")) for df in (tracked, lost))
    if 0 < near < 1:
        a, b = _in_cells(a, b, near)
        cell = [*keys, "__lx", "__ly", "__cx", "__cy"]
    else:
        cell = [*keys]
    same = F.lit(True)
    for c in cell:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = a.alias("a").join(b.alias("b"), same & ((1 - iou(box("a."), box("b."))) < distance))

    def left(df, own, other, falls):
        most = pairs.groupBy(*(F.col(f"{own}.{c}").alias(c) for c in (*keys, *BOX))).agg(F.max(f"{other}.age").alias("__most"))
        gone = df.withColumn("__age", age).join(most, [*keys, *BOX]).where(falls).select(*keys, "track_id")
        return subtract_tracks(df, gone, (*keys, "track_id"))

    return left(tracked, "a", "b", "__age <= __most"), left(lost, "b", "a", "__age < __most")


def _in_cells(a: DataFrame, b: DataFrame, near: float) -> tuple[DataFrame, DataFrame]:
    """``b`` with the cell of each box's centre, ``a`` with a row for each cell that may hold a box
    whose IoU with it is over ``near``. Widths and heights of such boxes differ by less than
    the factor 1 / near, and their centres by less than 1 - near of the larger; so sizes are in
    classes of that factor, cells are by class, and three classes at most are looked at."""
    sides = {"x": ("x1", "x2"), "y": ("y1", "y2")}
    base = math.log(1 / near)

    def placed(df):
        for n, (lo, hi) in sides.items():
            df = df.withColumns({f"__s{n}": F.col(hi) - F.col(lo), f"__m{n}": (F.col(lo) + F.col(hi)) / 2})
        df = df.where("__sx > 0 and __sy > 0")
        return df.withColumns({f"__l{n}": F.floor(F.log(F.col(f"__s{n}")) / base) for n in sides})

    step = lambda n: F.exp(F.col(f"__l{n}") * base) * (1 - near)
    a, b = placed(a), placed(b)
    levels = b.groupBy("__lx", "__ly").agg(*(F.max(f"__s{n}").alias(f"__t{n}") for n in sides))
    a = a.withColumnsRenamed({f"__l{n}": f"__k{n}" for n in sides}).join(F.broadcast(levels), F.expr("abs(__lx - __kx) <= 1 and abs(__ly - __ky) <= 1"))
    for n in sides:
        # a little more, for what rounding does to places
        reach = F.greatest(F.col(f"__s{n}"), F.col(f"__t{n}")) * (1 - near) * 1.000001
        a = a.withColumn(f"__c{n}", F.explode(F.sequence(*(F.floor((F.col(f"__m{n}") + r) / step(n)) for r in (-reach, reach)))))
    return a, b.withColumns({f"__c{n}": F.floor(F.col(f"__m{n}") / step(n)) for n in sides})


def track_objects(df: DataFrame, stream: str = "stream_id", cuts: DataFrame | None = None, classes: list[str] | None = None, **settings) -> DataFrame:
    """``df`` (stream, frame_id, det_idx, score, box…) with ``track_id`` and the tracked rows'
    filtered boxes; every row comes back. ``cuts``: (stream, frame_id) of scene cuts, where
    tracks end. Rows of classes outside ``classes`` are never tracked. Frames without rows age
    tracks too when the frame numbers show them."""
    require_columns(df, stream, "frame_id", "det_idx", "score", *BOX)
    if classes is not None:
        df = df.withColumn("__s", F.when(F.col("label").isin(*classes), F.col("score")).otherwise(F.lit(0.0)))
    else:
        df = df.withColumn("__s", F.col("score"))
    if cuts is not None:
        df = df.join(cuts.select(stream, "frame_id").distinct().withColumn("__cut", F.lit(True)), [stream, "frame_id"], "left")
    else:
        df = df.withColumn("__cut", F.lit(False))

    df = df.drop("track_id")
    names = [c for c in df.columns if c not in ("__s", "__cut")]

    def make():
        import pyarrow as pa

        tracker, last = Tracker(**settings), None

        def walk(t: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal tracker, last
            own, fresh = floats(t, *BOX), set(starts)
            scores, frames, cut = floats(t, "__s")[:, 0], t.column("frame_id").to_pylist(), t.column("__cut").to_pylist()
            numbers = np.full(len(frames), -1)
            edge = [k for k in range(len(frames)) if not k or k in fresh or frames[k] != frames[k - 1]]
            for s, e in zip(edge, [*edge[1:], len(frames)]):
                if s in fresh:
                    tracker, last = Tracker(**settings), None
                if last is not None:
                    for _ in range(min(int(frames[s] - last) - 1, tracker.buffer + 2)):
                        tracker.update(np.zeros((0, 4)), np.zeros(0))
                if cut[s]:
                    tracker.reset()
                last = frames[s]
                for k, n, place in tracker.update(own[s:e].copy(), scores[s:e]):
                    numbers[s + k] = n
                    own[s + k] = place
            for k, c in enumerate(BOX):
                was = t.column(c)
                made = pa.array(own[:, k], pa.float64(), mask=was.is_null().to_numpy()).cast(was.type, safe=False)
                t = t.set_column(t.schema.get_field_index(c), c, made)
            yield from t.select(names).append_column("track_id", pa.array(numbers, pa.int64(), mask=numbers < 0)).to_batches()

        return walk

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(F.col(f"`{c}`") for c in names)).schema) + ", track_id long"
    return in_order(df, [stream], [F.col("frame_id"), F.col("det_idx").asc_nulls_last()], make, schema, whole=["frame_id"])


def select_sticky(df: DataFrame, metric, stream: str = "stream_id", top_k: int = 1, timeout: int = 30) -> DataFrame:
    """Rows of the tracks that the sticky selector keeps, per stream. ``metric``: a column."""
    require_columns(df, stream, "frame_id", "det_idx", "track_id")
    names = df.columns
    df = df.withColumn("__m", metric)

    def make():
        selector, last = StickySelector(top_k, timeout), None

        def walk(t, starts):
            nonlocal selector, last
            fresh, frames, numbers, best = set(starts), t.column("frame_id").to_pylist(), t.column("track_id").to_pylist(), floats(t, "__m")[:, 0]
            edge, keep = [k for k in range(len(frames)) if not k or k in fresh or frames[k] != frames[k - 1]], []
            for s, e in zip(edge, [*edge[1:], len(frames)]):
                if s in fresh:
                    selector, last = StickySelector(top_k, timeout), None
                if last is not None:
                    for _ in range(min(int(frames[s] - last) - 1, timeout + 1)):
                        selector.update([], np.zeros(0))
                last = frames[s]
                keep += [s + k for k in selector.update([None if n is None or n != n else int(n) for n in numbers[s:e]], best[s:e])]
            yield from t.select(names).take(np.array(keep, dtype=np.int64)).to_batches()

        return walk

    schema = df.drop("__m").schema
    return in_order(df, [stream], [F.col("frame_id"), F.col("det_idx").asc_nulls_last()], make, schema, whole=["frame_id"])
