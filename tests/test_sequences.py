import datetime as dt

import pytest
from pyspark.sql import functions as F

from viewfold.functions import signal
from viewfold.operators import lines, rules, zones

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(seconds=int(n))


def frames(spark, n):
    return spark.createDataFrame([(k, at(k)) for k in range(n)], "frame_id long, ts timestamp")


def metric(spark, values, seconds=None):
    return spark.createDataFrame([(k, at((seconds or range(len(values)))[k]), float(v)) for k, v in enumerate(values)], "frame_id long, ts timestamp, value double")


def rule(**kw):
    return rules.parse_rule({"Trigger": "e", "when": "ObjectCount", "is greater than": 0, **kw})


def fired(r, df):
    return [x.frame_id for x in rules.fire(r, df).orderBy("frame_id").collect() if x.fired]


@pytest.mark.parametrize(
    ("quantifier", "want"),
    [({}, [2]), ({"for at least": [50, "percent"]}, [2, 3, 4, 5]), ({"for at least": [1, "frame"]}, [0, 1, 2, 3, 4, 5]), ({"for at most": [2, "frames"]}, [0, 1, 3, 4, 5])],
)
def test_windows_of_frames(spark, quantifier, want):
    assert fired(rule(during=[3, "frames"], **quantifier), metric(spark, [1, 1, 1, 0, 1, 1])) == want


def test_window_of_seconds_is_full_after_something_dropped(spark):
    assert fired(rule(during=[2, "seconds"]), metric(spark, [1] * 5)) == [3, 4]
    assert fired(rule(during=[100, "seconds"]), metric(spark, [1] * 5)) == []


@pytest.mark.parametrize("bad", [{"is less than": 1}, {"during": [0, "frames"]}, {"during": [1, "hours"]}, {"when": "Other"}, {"odd": 1}, {"for at least": [1, "day"]}])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        rules.parse_rule({"Trigger": "e", "when": "ObjectCount", "is greater than": 0, "during": [1, "frame"]} | bad)


def events(spark, rows):
    return spark.createDataFrame([(k, at(k), list(e)) for k, e in enumerate(rows)], "frame_id long, ts timestamp, events array<string>")


def notes(df):
    return [r.frame_id for r in df.orderBy("frame_id").collect() if r.fired]


def test_notifications(spark):
    e = events(spark, ["a", "a", "", "ab", "b", "a", "a", "a"])
    assert notes(rules.notify(e, "n", "a")) == [0, 3, 5]
    assert notes(rules.notify(e, "n", "a and not b")) == [0, 5]
    assert notes(rules.notify(e, "n", "(a or b)", while_true=True)) == [0, 1, 3, 4, 5, 6, 7]
    assert notes(rules.notify(e, "n", "a", while_true=True, holdoff=1)) == [0, 3, 5]
    assert notes(rules.notify(e, "n", "a", while_true=True, holdoff=(5.0, "seconds"))) == [0]
    with pytest.raises(ValueError):
        rules.notify(e, "n", "a and (b")
    with pytest.raises(ValueError):
        rules.notify(e, "n", "a", holdoff=(1, "days"))


def test_clips_absorb_and_flush(spark):
    def starts(triggers, n, d, pre):
        df = spark.createDataFrame([(t,) for t in triggers], "trigger long")
        return [(r.trigger, r.first_frame, r.last_frame) for r in rules.clips(df, n, d, pre).orderBy("trigger").collect()]

    assert starts([7, 9, 11, 13], 30, 7, 2) == [(7, 5, 11), (13, 11, 17)]
    assert starts([0, 2, 3], 30, 5, 2) == [(0, 0, 2), (3, 1, 5)]
    assert starts([8], 10, 5, 1) == [(8, 7, 9)]
    with pytest.raises(ValueError):
        starts([1], 10, 3, 3)


def test_scene_spacing(spark):
    df = spark.createDataFrame([(n,) for n in (8, 12, 25)], "n long")
    assert sorted(r.n for r in rules.spaced(df, 10, "n").collect()) == [8, 25]


def test_scene_cuts_at_jumps(spark):
    scores = [1.0] * 60
    scores[20] = scores[25] = scores[50] = 90.0
    df = spark.createDataFrame([(k + 1, s) for k, s in enumerate(scores)], "n long, score double")
    assert sorted(r.n for r in rules.scene_cuts(df).collect()) == [21, 51]


def marks(spark, hits):
    return spark.createDataFrame([(0, "z", 1, f, h) for f, h in hits], "zone_index int, zone_id string, track_id long, frame_id long, hit boolean")


def test_hysteresis_brief_exit_and_absence(spark):
    s = zones.hysteresis(marks(spark, [(0, True), (1, True), (2, True), (3, False), (4, True), (8, True)]), 2)
    got = [(r.frame_id, r.counter, r.in_zone, r.left_at) for r in s.orderBy("frame_id").collect()]
    assert got == [(0, 1, False, None), (1, 2, False, None), (2, 3, True, None), (3, 2, True, None), (4, 3, True, None), (8, 1, False, 7)]
    f = frames(spark, 12)
    total = [r.total for r in zones.occupancy(s, f, {"z": []}).orderBy("frame_id").collect()]
    assert total == [0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
    ev = sorted((r.event_type, r.frame_id, r.dwell_us) for r in zones.zone_events(s, f, {"z": []}).collect())
    assert ev == [("zone_empty", 7, 5_000_000), ("zone_entry", 2, None), ("zone_exit", 7, 5_000_000), ("zone_occupied", 2, 2_000_000)]


def test_no_timeout_is_in_zone_now(spark):
    s = zones.hysteresis(marks(spark, [(0, True), (1, False), (2, True)]), 0)
    assert [r.in_zone for r in s.orderBy("frame_id").collect()] == [True, False, True]


def test_counter_stays_in_range():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        most, state, f = rnd.randint(1, 5), (-1, 0, None, None), -1
        for _ in range(30):
            f += rnd.randint(1, 4)
            state, _, _ = zones.step(state, f, rnd.random() < 0.6, most)
            assert 0 <= state[1] <= most and (state[2] is None or state[1] > 0)


@pytest.mark.parametrize("bad", [{"zones": {}}, {"scale": 0}, {"timeout": -1}, {"timeout": 1, "tracked": False}, {"iopa_over": 0}, {"per_class": True}])
def test_zone_validation(bad):
    with pytest.raises(ValueError):
        zones.validate(**({"zones": {"z": [(0, 0), (1, 0), (1, 1)]}} | bad))


def walk(spark, places, frame_ids=None):
    rows = [((frame_ids or range(len(places)))[k], at(k), 1, "car", float(x - 1), float(y - 2), float(x + 1), float(y)) for k, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "frame_id long, ts timestamp, track_id long, label string, x1 double, y1 double, x2 double, y2 double")


def test_line_directions_and_first_crossing(spark):
    t = lines.trails(walk(spark, [(0, 5), (10, 5), (0, 5), (10, 5)]))
    line = [(5, 0, 5, 10)]
    first = lines.crossings(t, line, whole_trail=False).collect()
    assert [(r.frame_id, r.direction) for r in first] == [(1, "left")]
    every = lines.crossings(t, line, whole_trail=False, first_only=False).orderBy("frame_id").collect()
    assert [r.direction for r in every] == ["left", "right", "left"]
    both = lines.crossings(t, line, whole_trail=False, first_only=False, absolute=True).orderBy("frame_id").collect()
    assert [(r.horizontal, r.vertical) for r in both] == [("right", "bottom"), ("left", "bottom"), ("right", "bottom")]


def test_trail_ends_after_timeout(spark):
    t = lines.trails(walk(spark, [(0, 5), (10, 5)], [0, 20]), timeout=8)
    assert [r.session for r in t.orderBy("frame_id").collect()] == [1, 2]
    assert lines.crossings(t, [(5, 0, 5, 10)]).count() == 0


def test_lowpass_settles(spark):
    taps = signal.lowpass_taps(0.1, 31)
    df = spark.createDataFrame([(n, float(n % 2)) for n in range(200)], "n long, v double")
    last = signal.fir(df, "v", taps).orderBy(F.col("n").desc()).first().filtered
    assert abs(last - 0.5) < 0.01 and abs(sum(taps) - 1) < 1e-12


def test_hysteresis_takes_no_history_as_an_array(spark):
    from viewfold.operators import zones

    m = spark.range(40).selectExpr("id % 2 AS track_id", "id div 2 AS frame_id", "0 AS zone_index", "'z' AS zone_id", "id % 7 < 4 AS hit")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, rows = spark.conf.get(size), []
    try:
        for n in ("3", "10000"):
            spark.conf.set(size, n)
            s = zones.hysteresis(m, 1)
            assert "collect_list" not in s._jdf.queryExecution().toString()
            rows.append(s.orderBy("track_id", "frame_id").collect())
    finally:
        spark.conf.set(size, was)
    assert rows[0] == rows[1] and len(rows[0]) == 40 and any(r.left_at for r in rows[0])
