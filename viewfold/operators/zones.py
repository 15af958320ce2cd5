"""Polygon zones: which boxes are inside, occupancy with hysteresis, presence times and events.

All is keyed by (zone, track), within ``stream`` where several streams are in one table; frames in
which a track has no row are never materialised for the counter, they only let it decay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window as W

from viewfold.functions.folds import in_order
from viewfold.functions.geometry import anchor, box, clip_and_scale, in_polygon, iopa
from viewfold.functions.times import micros
from viewfold.schema import BOX, by, require_columns

Zones = dict[str, list[tuple[int, int]]]


def validate(zones: Zones, scale: float = 1.0, timeout: int = 0, events: bool = False, tracked: bool = True, iopa_over: float | None = None, per_class: bool = False, classes: list[str] | None = None) -> None:
    if not zones:
        raise ValueError("at least one zone is needed")
    if not 0 < scale <= 1:
        raise ValueError("scale must be in (0, 1]")
    if not isinstance(timeout, int) or timeout < 0:
        raise ValueError("timeout must be a whole number of frames, not negative")
    if (timeout > 0 or events) and not tracked:
        raise ValueError("a timeout and events need tracking")
    if iopa_over is not None and iopa_over <= 0:
        raise ValueError("the share of a zone's area must be positive")
    if per_class and not classes:
        raise ValueError("counts per class need a list of classes")


def mark(df: DataFrame, zones: Zones, anchors: tuple[str, ...] = ("BOTTOM_CENTER",), scale: float = 1.0, iopa_over: float | None = None, width: int = 640, height: int = 480) -> DataFrame:
    """A row per box and zone with ``hit``: any of the box's anchors is in the polygon or, with
    ``iopa_over``, the box covers more than that share of the zone. The box is first clipped and
    shrunk. The zones are unrolled, nothing is joined."""
    require_columns(df, "frame_id", *BOX)
    b = clip_and_scale(box(), width, height, scale)
    if iopa_over is not None:
        made = {f"__b{k}": v for k, v in enumerate(b)}
        hits = [iopa(tuple(F.col(f"__b{k}") for k in range(4)), p) > iopa_over for p in zones.values()]
    else:
        points = [tuple(F.ceil(v).cast("double") for v in anchor(b, a)) for a in anchors]
        made = {f"__{'xy'[i]}{k}": v for k, p in enumerate(points) for i, v in enumerate(p)}
        hits = [reduce(lambda p, q: p | q, (in_polygon(F.col(f"__x{k}"), F.col(f"__y{k}"), poly) for k in range(len(points)))) for poly in zones.values()]
    tests = F.array(*(F.struct(F.lit(k).alias("zone_index"), F.lit(name).alias("zone_id"), h.alias("hit")) for k, (name, h) in enumerate(zip(zones, hits))))
    return df.withColumns(made).withColumn("__z", F.explode(tests)).select(*(F.col(f"`{c}`") for c in df.columns), "__z.*")


def untracked_counts(marked: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Boxes in each zone by label; the row of a null label is the total."""
    sets = [[*keys, "zone_index", "zone_id", "label"], [*keys, "zone_index", "zone_id"]]
    hits = marked.where(F.col("hit") & F.col("label").isNotNull())
    return hits.groupingSets(sets, *keys, "zone_index", "zone_id", "label").agg(F.count(F.lit(1)).alias("cnt"))


def step(state: tuple[int, int, int | None, int | None], frame: int, hit: bool, most: int) -> tuple[tuple[int, int, int | None, int | None], int | None, int | None]:
    """One sighting in the hysteresis of a (zone, track).

    State: (last frame, counter, frame of establishment, that of the episode's start). The
    counter falls by one per missing frame and per sighting outside, rises by one inside, up to
    ``most``, where the track is established, and at 0 the episode ends. Gives the new state,
    the frame and the established frame of an episode that ended before or on this sighting."""
    last, c, since, begun = state
    ended = was = None
    if c and frame - last - 1 >= c:
        if since is not None:
            ended, was = last + c, since
        c, since, begun = 0, None, None
    elif c:
        c -= frame - last - 1
    if hit:
        if c == 0:
            begun = frame
        c = min(most, c + 1)
        if since is None and c == most:
            since = frame
    elif c:
        c -= 1
        if c == 0:
            if since is not None:
                ended, was = frame, since
            since = begun = None
    return (frame, c, since, begun), ended, was


_STATES = "frame_id long, hit boolean, label string, counter int, since long, left_at long, left_since long, begun long, held_label string"


def hysteresis(marked: DataFrame, timeout: int = 0, stream: str | None = None) -> DataFrame:
    """A row per sighting and zone: ``counter``, ``since`` (the frame in which the track was
    established, null while it isn't), ``in_zone``, ``frames_in_zone``, and ``left_at`` with
    ``left_since`` where an episode ended on or before this sighting. ``held_label`` is the label
    with which the episode began, which counts while the track is outside or missing; after an
    ended episode it is that episode's. ``next_frame`` is the track's next sighting.

    Sightings come sorted out of the shuffle, and of a history only a batch is in memory."""
    keys = by(stream, "zone_index", "zone_id", "track_id")
    require_columns(marked, "frame_id", "hit", *keys)
    most = timeout + 1

    def make():
        import pyarrow as pa

        state, held = (-1, 0, None, None), None

        def walk(t, starts):
            nonlocal state, held
            fresh = set(starts)
            out: list[tuple] = []
            for k, (frame, hit, label) in enumerate(zip(*(t.column(c).to_pylist() for c in ("frame_id", "hit", "label")))):
                if k in fresh:
                    state, held = (-1, 0, None, None), None
                begun = state[3]
                state, ended, was = step(state, frame, bool(hit), most)
                before = held
                if state[3] is not None and state[3] != begun:
                    held = label
                out.append((bool(hit), state[1], state[2], ended, was, state[3], before if ended is not None else held))
            made = dict(zip(("hit", "counter", "since", "left_at", "left_since", "begun", "held_label"), zip(*out)))
            yield pa.RecordBatch.from_arrays([pa.array(made[n], kind) if n in made else t.column(n).cast(kind).combine_chunks() for n, kind in zip(names, to_arrow_schema(schema).types)], names)

        return walk

    label = F.col("label") if "label" in marked.columns else F.lit(None).cast("string")
    track = by(stream, "zone_index", "track_id")
    order = ["frame_id", "hit", "label"]
    rows = marked.select(*keys, "frame_id", "hit", label.alias("label")).repartition(*track)
    rows = rows.withColumn("next_frame", F.lead("frame_id").over(W.partitionBy(*track).orderBy(*order)))
    schema = StructType([*rows.select(*keys).schema, *_parse_datatype_string(_STATES), *rows.select("next_frame").schema])
    names = schema.names
    out = in_order(rows, keys, order, make, schema, dealt=track)
    return out.withColumns({"in_zone": F.col("since").isNotNull(), "frames_in_zone": F.when(F.col("since").isNotNull(), F.col("frame_id") - F.col("since") + 1).otherwise(F.lit(0))})


def with_times(states: DataFrame, frames: DataFrame, stream: str | None = None) -> DataFrame:
    """``time_in_zone`` in microseconds: since the frame of establishment."""
    t = frames.select(*by(stream, "frame_id"), micros("ts").alias("us"))
    since = t.select(*by(stream), F.col("frame_id").alias("since"), F.col("us").alias("us0"))
    return states.join(t, by(stream, "frame_id")).join(since, by(stream, "since"), "left").withColumn("time_in_zone", F.when(F.col("in_zone"), F.col("us") - F.col("us0"))).drop("us", "us0")


_FACT = "struct<kind:string,frame_id:long,track_id:long,label:string,since:long,delta:int>"


def _facts(states: DataFrame, stream: str | None) -> DataFrame:
    """What each sighting says, in one pass: entries, exits, and by how much the number of
    established tracks rises or falls from a frame on, those missing whose counter has not run out
    included. (…, kind, frame_id, track_id, label, since, delta)"""
    far = F.lit(1 << 60)
    since, frame = F.col("since"), F.col("frame_id")
    here = since.isNotNull()
    last = F.least(F.coalesce("next_frame", far) - 1, frame + F.col("counter") - 1)
    ends = here & F.col("next_frame").isNull()
    seen = F.when(F.col("hit"), F.col("label")).otherwise(F.col("held_label"))
    none = F.lit(None)

    def fact(when, kind, at, label=none, start=none, delta=none):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), at.alias("frame_id"), F.col("track_id"), label.cast("string").alias("label"), start.cast("long").alias("since"), F.lit(delta).cast("int").alias("delta")).cast(_FACT))

    apart = here & (last > frame) & ~seen.eqNullSafe(F.col("held_label"))
    rows = F.array_compact(
        F.array(
            fact(here & (since == frame), "zone_entry", frame, F.col("label")),
            fact(F.col("left_at").isNotNull(), "zone_exit", F.col("left_at"), F.col("held_label"), F.col("left_since")),
            fact(ends, "zone_exit", frame + F.col("counter"), F.col("held_label"), since),
            fact(here, "in", frame, seen, delta=1),
            fact(here, "out", F.when(apart, frame + 1).otherwise(F.greatest(frame, last) + 1), seen, delta=-1),
            fact(apart, "in", frame + 1, F.col("held_label"), delta=1),
            fact(apart, "out", last + 1, F.col("held_label"), delta=-1),
        )
    )
    keys = by(stream, "zone_index", "zone_id")
    return states.select(*keys, F.explode(rows).alias("__f")).select(*keys, "__f.*")


def _grid(frames: DataFrame, zones: Zones, stream: str | None) -> DataFrame:
    names = F.array(*(F.struct(F.lit(k).alias("zone_index"), F.lit(n).alias("zone_id")) for k, n in enumerate(zones)))
    return frames.select(*by(stream), "frame_id", "ts", F.inline(names))


def occupancy(states: DataFrame, frames: DataFrame, zones: Zones, stream: str | None = None, classes: list[str] | None = None) -> DataFrame:
    """Established tracks per frame and zone, frames without any included: those seen, and those
    missing whose counter has not run out. With ``classes`` there is a column for each besides:
    tracks inside count as what they are labelled, others as what they entered as."""
    keys = by(stream, "zone_index")
    delta = F.col("delta").cast("long")
    per = {"total": delta} | {f"class_{c}": F.when(F.col("label") == c, delta) for c in classes or ()}
    # steps may fall on numbers that no frame has, so they are summed up beside the frames
    rows = _grid(frames, zones, stream).withColumn("__frame", F.lit(True)).unionByName(_facts(states, stream).where("delta is not null"), allowMissingColumns=True)
    upto = W.partitionBy(*keys).orderBy("frame_id").rangeBetween(W.unboundedPreceding, 0)
    counted = rows.withColumns({n: F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in per.items()})
    return counted.where("__frame").select(*keys, "zone_id", "frame_id", "ts", *per)


def zone_events(states: DataFrame, frames: DataFrame, zones: Zones, stream: str | None = None) -> DataFrame:
    """(event_type, zone_index, zone_id, frame_id, timestamp_us, track_id, object_label, dwell_us):
    entries, exits with the time since establishment, and zones becoming occupied or empty with
    the time spent in the state before, counted from its start or from the first frame. An exit
    by absence falls on the frame in which the counter runs out, if the stream gets that far.
    An entry has the object's label, an exit the label with which it entered.

    The states are read once: what they say and the frames go through one sort by zone."""
    facts = _facts(states, stream)
    grid = _grid(frames, zones, stream).withColumns({"kind": F.lit("frame"), "us": micros("ts")}).drop("ts")
    t = frames.select(*by(stream), F.col("frame_id"), micros("ts").alias("us"))
    began = t.select(*by(stream), F.col("frame_id").alias("since"), F.col("us").alias("us0"))
    told = facts.join(t, by(stream, "frame_id"), "left").join(began, by(stream, "since"), "left")
    zone = W.partitionBy(*by(stream, "zone_index"))
    upto = zone.orderBy("frame_id").rangeBetween(W.unboundedPreceding, 0)
    rows = told.unionByName(grid, allowMissingColumns=True).withColumn("busy", F.coalesce(F.sum("delta").over(upto), F.lit(0)) > 0)
    own = W.partitionBy(*by(stream, "zone_index"), F.col("kind") == "frame").orderBy("frame_id")
    rows = rows.where("delta is null").withColumn("turn", F.col("busy") != F.coalesce(F.lag("busy").over(own), F.lit(False)))
    change = F.last(F.when(F.col("turn"), F.col("us")), True).over(own.rowsBetween(W.unboundedPreceding, -1))
    start = F.when(F.row_number().over(own) > 1, F.coalesce(change, F.first("us").over(own)))
    rows = rows.withColumn("start", start)
    frame, out = F.col("kind") == "frame", F.col("kind") == "zone_exit"
    kind = F.when(~frame, F.col("kind")).when(F.col("busy"), "zone_occupied").otherwise("zone_empty")
    dwell = F.when(frame, F.col("us") - F.col("start")).when(out, F.col("us") - F.col("us0"))
    return rows.where(F.col("us").isNotNull() & (~frame | F.col("turn"))).select(kind.alias("event_type"), *by(stream), "zone_index", "zone_id", "frame_id", F.col("us").alias("timestamp_us"), "track_id", F.col("label").alias("object_label"), dwell.alias("dwell_us"))
