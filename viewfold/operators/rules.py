"""Event rules over frame metrics, notifications with hold-off, scene cuts and clips."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from viewfold.functions.text import template
from viewfold.functions.times import micros
from viewfold.schema import by

#: Fixed words of the rule language.
COMPARATORS = {
    "is equal to": lambda a, b: a == b,
    "is not equal to": lambda a, b: a != b,
    "is greater than": lambda a, b: a > b,
    "is greater than or equal to": lambda a, b: a >= b,
    "is less than": lambda a, b: a < b,
    "is less than or equal to": lambda a, b: a <= b,
}
METRICS = ("ZoneCount", "LineCount", "ObjectCount", "CustomMetric")
AGGREGATIONS = ("sum", "max", "min", "mean", "std")
SECONDS, FRAMES = ("second", "seconds"), ("frame", "frames")


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    comparator: str
    threshold: float
    duration: float
    in_frames: bool
    at_most: bool = False
    quota: float = 100.0
    percent: bool = True
    params: dict = field(default_factory=dict)


def parse_rule(text: str | dict) -> Rule:
    """A rule from YAML or a dict. Exactly one comparator and ``during`` are needed; without a
    quantifier the condition has to hold all of the time; of two, at least wins."""
    if isinstance(text, str):
        import yaml

        text = yaml.safe_load(text)
    known = {"Trigger", "when", "with", "during", "for at least", "for at most", *COMPARATORS}
    if not isinstance(text, dict) or set(text) - known:
        raise ValueError(f"unknown keys in rule: {sorted(set(text) - known) if isinstance(text, dict) else text}")
    used = [c for c in COMPARATORS if c in text]
    if len(used) != 1:
        raise ValueError("exactly one comparison is needed")
    if text.get("when") not in METRICS:
        raise ValueError(f"{text.get('when')} is not one of {METRICS}")
    if not text.get("Trigger") or not isinstance(text.get("during"), (list, tuple)) or len(text["during"]) != 2:
        raise ValueError("Trigger and during: [number, unit] are needed")
    n, unit = text["during"]
    if unit not in (*SECONDS, *FRAMES) or n <= 0:
        raise ValueError("during needs a positive number of seconds or frames")
    params = text.get("with") or {}
    if params.get("aggregation", "sum") not in AGGREGATIONS:
        raise ValueError(f"aggregation is not one of {AGGREGATIONS}")
    if set(params.get("directions", ())) - {"left", "right", "top", "bottom"}:
        raise ValueError("unknown direction")
    most = "for at least" not in text and "for at most" in text
    q, u = text.get("for at least") or text.get("for at most") or (100, "percent")
    if u != "percent" and u not in FRAMES:
        raise ValueError("a quantifier is in percent or frames")
    return Rule(text["Trigger"], text["when"], used[0], float(text[used[0]]), float(n), unit in FRAMES, most, float(q), u == "percent", params)


def object_count(frames: DataFrame, detections: DataFrame, classes: list[str] | None = None, min_score: float | None = None, key: str | None = None) -> DataFrame:
    """(frame_id, ts, value): boxes of the classes with at least the score; 0 where none."""
    ok = F.lit(True)
    if classes is not None:
        ok = ok & F.col("label").isin(*classes)
    if min_score is not None:
        ok = ok & F.coalesce(F.col("score") >= min_score, F.lit(False))
    counts = detections.where(ok).groupBy(*by(key, "frame_id")).agg(F.count(F.lit(1)).alias("value"))
    return frames.select(*by(key, "frame_id"), "ts").join(counts, by(key, "frame_id"), "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))


def zone_count(counts: DataFrame, frames: DataFrame, zones: list[str], index: int | str | None = None, classes: list[str] | None = None, aggregation: str = "sum", key: str | None = None) -> DataFrame:
    """Counts per zone summed over classes, then aggregated over zones. ``counts``: (frame_id,
    zone_index, label, cnt), a null label being the total; without ``classes`` every row counts,
    total and classes alike. No zone: 0 for sum, else null, which never fires."""
    if isinstance(index, str):
        if index not in zones:
            raise ValueError(f"no zone {index}")
        index = zones.index(index)
    if index is not None and not 0 <= index < len(zones):
        raise ValueError(f"zone {index} is out of range")
    pick = counts.where(F.col("label").isin(*classes)) if classes is not None else counts
    per = pick.groupBy(*by(key, "frame_id", "zone_index")).agg(F.sum("cnt").alias("c"))
    which = [index] if index is not None else list(range(len(zones)))
    grid = frames.select(*by(key, "frame_id"), "ts", F.explode(F.array(*map(F.lit, which)) if which else F.array().cast("array<int>")).alias("zone_index"))
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop}[aggregation]
    rows = grid.join(per, by(key, "frame_id", "zone_index"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    got = rows.groupBy(*by(key, "frame_id")).agg(agg("c").cast("double").alias("value"))
    out = frames.select(*by(key, "frame_id"), "ts").join(got, by(key, "frame_id"), "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if aggregation == "sum" else out


def line_count(counts: DataFrame, frames: DataFrame, n_lines: int, index: int | None = None, directions: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Crossings in the given directions over the lines. ``counts``: (frame_id, line_index, …)."""
    if index is not None and not 0 <= index < n_lines:
        raise ValueError(f"line {index} is out of range")
    have = [d for d in (directions or ["left", "right", "top", "bottom"]) if d in counts.columns]
    rows = counts if index is None else counts.where(F.col("line_index") == index)
    total = reduce(lambda a, b: a + b, [F.col(d) for d in have], F.lit(0))
    got = rows.groupBy(*by(key, "frame_id")).agg(F.sum(total).cast("double").alias("value"))
    return frames.select(*by(key, "frame_id"), "ts").join(got, by(key, "frame_id"), "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def custom_metric(frames: DataFrame, value: Column, key: str | None = None) -> DataFrame:
    """(frame_id, ts, value): any expression over the frames' columns, null where it has none."""
    return frames.select(*by(key, "frame_id"), "ts", value.cast("double").alias("value"))


def fire(rule: Rule, metric: DataFrame, key: str | None = None) -> DataFrame:
    """``metric`` (frame_id, ts, value) with ``condition`` and ``fired``.

    A window in frames is full once it holds that many; one in seconds once anything has ever
    dropped out of it. A share in percent is only judged over a full window, a number of frames
    always. Windows run per ``key``, the stream."""
    part = W.partitionBy(key) if key else W.partitionBy(F.lit(0))
    df = metric.withColumn("condition", F.coalesce(COMPARATORS[rule.comparator](F.col("value"), F.lit(rule.threshold)), F.lit(False)))
    hit = F.col("condition").cast("int")
    if rule.in_frames:
        over = part.orderBy("frame_id").rowsBetween(-(int(rule.duration) - 1), 0)
        full = F.row_number().over(part.orderBy("frame_id")) >= int(rule.duration)
    else:
        us = micros("ts")
        d = int(rule.duration * 1_000_000)
        now = part.orderBy("frame_id").rowsBetween(W.unboundedPreceding, 0)
        # of the frames so far less what has dropped out; a later frame of the same time has not come yet
        out = part.orderBy(us).rangeBetween(W.unboundedPreceding, -d - 1)
        full = F.min(us).over(now) < us - d
    upto = (lambda c: F.sum(c).over(over)) if rule.in_frames else lambda c: F.sum(c).over(now) - F.coalesce(F.sum(c).over(out), F.lit(0))
    true, size = upto(hit), upto(F.lit(1))
    quota = size * (rule.quota / 100.0) if rule.percent else F.lit(rule.quota)
    ok = true <= quota if rule.at_most else true >= quota
    return df.withColumn("fired", ok & full if rule.percent else ok)


def events_by_frame(named: dict[str, DataFrame], key: str | None = None) -> DataFrame:
    """(frame_id, events): the sorted names of the rules that fired; a set, empty where none."""
    rows = [df.select(*by(key, "frame_id"), F.when(F.col("fired"), F.lit(n)).alias("e")) for n, df in named.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(*by(key, "frame_id")).agg(F.array_sort(F.collect_set("e")).alias("events"))


_WORD = re.compile(r"\s*(?:(\()|(\))|([A-Za-z_][\w.]*)|(\"[^\"]*\"|'[^']*'))")


def condition_column(text: str, events: str = "events") -> Column:
    """A condition over event names with and, or, not and parentheses as a column. Nothing is
    evaluated as code; names may be quoted."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"bad condition at {text[at:]!r}")
        tokens.append(m[0].strip())
        at = m.end()
    tokens.append("")

    def take(t: str | None = None) -> str:
        if t is not None and tokens[0] != t:
            raise ValueError(f"expected {t!r}, found {tokens[0]!r}")
        return tokens.pop(0)

    def either() -> Column:
        c = both()
        while tokens[0] == "or":
            take()
            c = c | both()
        return c

    def both() -> Column:
        c = single()
        while tokens[0] == "and":
            take()
            c = c & single()
        return c

    def single() -> Column:
        t = take()
        if t == "not":
            return ~single()
        if t == "(":
            c = either()
            take(")")
            return c
        if t in ("", ")", "and", "or"):
            raise ValueError(f"a name is missing before {t!r}")
        if t in ("True", "False"):
            return F.lit(t == "True")
        return F.array_contains(events, t.strip("\"'"))

    out = either()
    take("")
    return out


def notify(frames: DataFrame, name: str, condition: str, while_true: bool = False, holdoff: int | float | tuple = 0, message: str | None = None, key: str | None = None) -> DataFrame:
    """``frames`` (frame_id, ts, events) with ``condition``, ``fired`` and ``notifications``, a map.

    Fires when the condition becomes true, or always while it is; then only if more than the
    hold-off (whole number: frames, other number: seconds, or a pair with its unit) has passed
    since the last frame in which the condition was true, fired or not. In ``message``, ${time} is
    the frame's time and ${result.x} its column x; see ``template``."""
    if isinstance(holdoff, (tuple, list)):
        n, unit = holdoff
        if unit not in ("frames", "seconds"):
            raise ValueError(f"unknown unit {unit}")
        hold_frames, hold_us = (int(n), 0) if unit == "frames" else (0, int(n * 1_000_000))
    elif isinstance(holdoff, bool) or not isinstance(holdoff, (int, float)):
        raise TypeError("a hold-off is a number or a pair of number and unit")
    else:
        hold_frames, hold_us = (holdoff, 0) if isinstance(holdoff, int) else (0, int(holdoff * 1_000_000))
    part = (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy("frame_id")
    before = part.rowsBetween(W.unboundedPreceding, -1)
    df = frames.withColumn("condition", F.coalesce(condition_column(condition), F.lit(False)))
    ok = F.col("condition")
    if not while_true:
        ok = ok & ~F.coalesce(F.lag("condition").over(part), F.lit(False))
    if hold_frames:
        last = F.last(F.when(F.col("condition"), F.col("frame_id")), True).over(before)
        ok = ok & F.coalesce(F.col("frame_id") - last > hold_frames, F.lit(True))
    elif hold_us:
        us = micros("ts")
        last = F.last(F.when(F.col("condition"), us), True).over(before)
        ok = ok & F.coalesce(us - last > hold_us, F.lit(True))
    fields = {"time": F.date_format("ts", "EEE MMM d HH:mm:ss yyyy"), "result": F.struct(*(F.col(f"`{c}`") for c in frames.columns))}
    text = template(message or f"Notification triggered: {name}", fields)
    return df.withColumn("fired", ok).withColumn("notifications", F.when(F.col("fired"), F.create_map(F.lit(name), text)).otherwise(F.create_map().cast("map<string,string>")))


def cut_scores(df: DataFrame, window: int = 4, key: str | None = None) -> DataFrame:
    """``df`` (n, score) with ``ratio``: the score over the mean of the ``window`` before, at most
    255, and 255 where that mean is about 0; null in the first ``window`` frames."""
    part = (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy("n")
    mean = F.avg("score").over(part.rowsBetween(-window, -1))
    ratio = F.when(F.abs(mean) >= 0.00001, F.least(F.try_divide(F.col("score"), mean), F.lit(255.0))).otherwise(F.lit(255.0))
    return df.withColumn("ratio", F.when(F.row_number().over(part) > window, ratio))


def spaced(candidates: DataFrame, least: int, order: str = "n", key: str | None = None, first: int | None = None, keep: str | None = None) -> DataFrame:
    """Greedy spacing: a candidate counts if it is ``least`` or more after the last that counted
    (after ``first``, if given, for the first one). A fold over the candidates of a key, the least
    value of whose column ``keep`` stays with them."""
    start = F.lit(first if first is not None else -(1 << 62)).cast("long")
    extra = [F.min(keep).alias(keep)] if keep else []
    rows = candidates.groupBy(*by(key)).agg(F.sort_array(F.collect_list(F.col(order).cast("long"))).alias("__c"), *extra)
    acc = F.struct(start.alias("last"), F.expr("array_repeat(0L, 0)").alias("kept"))
    kept = F.aggregate("__c", acc, lambda a, x: F.when(x - a["last"] >= least, F.struct(x.alias("last"), F.array_append(a["kept"], x).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return rows.select(*by(key), *([keep] if keep else []), F.explode(kept).alias(order))


def scene_cuts(df: DataFrame, ratio: float = 3.0, min_length: int = 15, window: int = 4, min_content: float = 15.0, key: str | None = None) -> DataFrame:
    """Frames ``n`` (from 1) at which a scene begins, from a change score per frame."""
    if ratio <= 1 or min_length < 1 or min_content <= 0 or window < 1:
        raise ValueError("ratio over 1, lengths of 1 and more and a positive content are needed")
    found = cut_scores(df, window, key).where((F.col("ratio") >= ratio) & (F.col("score") >= min_content))
    return spaced(found, min_length, "n", key, 0)


def clips(triggers: DataFrame, n_frames: int | Column, duration: int, pre: int = 0, key: str | None = None) -> DataFrame:
    """(trigger, start_frame, first_frame, last_frame, whole): clips opened by trigger frames.
    ``n_frames``: how many frames the stream has, or a column of the triggers that says it.

    A trigger at t opens [t - pre, t - pre + duration - 1]; others up to its last frame are
    absorbed. The start may be negative, the content is not. At the end of the stream an open
    clip holds what has come; a stream shorter than a clip loses its leading frames there."""
    if not 0 <= pre < duration:
        raise ValueError("the part before the trigger must be shorter than the clip")
    n = F.lit(n_frames).cast("long")
    opened = spaced(triggers.withColumn("__n", n), duration - pre, "trigger", key, keep="__n")
    t, n = F.col("trigger"), F.col("__n")
    pending = F.greatest(t + duration - pre - n, F.lit(0))
    first = F.when(pending > 0, F.greatest(n - duration, F.lit(0)) + pending).otherwise(F.greatest(t - pre, F.lit(0)))
    out = opened.select("*", (t - pre).alias("start_frame"), first.cast("long").alias("first_frame"), F.least(t - pre + duration - 1, n - 1).alias("last_frame"), (pending == 0).alias("whole")).drop("__n")
    return out.where("first_frame <= last_frame")


def clip_frames(found: DataFrame, frames: DataFrame, key: str | None = None) -> DataFrame:
    """The frames of each clip, by an equi-join on the frame numbers of the clips."""
    each = found.withColumn("frame_id", F.explode(F.sequence("first_frame", "last_frame")))
    return each.join(frames, by(key, "frame_id"))
