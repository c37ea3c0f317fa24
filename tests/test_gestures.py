"""Movement features on hand-computed trajectories."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesia import schema as S
from kinesia.config import ConfigError, GestureConfig, point_list
from kinesia.operators import guards
from kinesia.operators.gestures import gesture_frames, gesture_sequences

WIDE = "id string, people_id double, frame long, frame_timestamp double, nx_4 double, ny_4 double, c_4 double, nx_7 double, ny_7 double, c_7 double"


def wide(spark, right, times=None, frames=None, left=None, conf=None, name="clip"):
    n = len(right)
    times = [i / 30 for i in range(n)] if times is None else times
    frames = list(range(1, n + 1)) if frames is None else frames
    conf = [0.9] * n if conf is None else conf
    rows = []
    for i, p in enumerate(right):
        r = (None, None, 0.0) if p is None else (float(p[0]), float(p[1]), conf[i])
        q = (None, None, 0.0) if left is None or left[i] is None else (*map(float, left[i]), 0.9)
        rows.append((name, 0.0, frames[i], times[i], *r, *q))
    return spark.createDataFrame(rows, WIDE)


def columns(df, *names):
    rows = df.orderBy("id", "people_id", "frame").select(*names).collect()
    return [[r[c] for r in rows] for c in names]


def test_column_counts():
    assert len(S.FRAME_COLUMNS) == 51 and len(S.EXTENDED_FRAME_COLUMNS) == 57
    assert len(S.SEQUENCE_COLUMNS) == 56 and len(S.EXTENDED_SEQUENCE_COLUMNS) == 190


def test_ramp_has_constant_velocity(spark):
    f = gesture_frames(wide(spark, [(0.03 * i, 0) for i in range(10)]))
    assert tuple(f.columns) == S.FRAME_COLUMNS
    vx, ax = columns(f, "right_velocity_x", "right_accel_x")
    assert np.allclose(vx, 0.9) and np.allclose(ax, 0, atol=1e-9)


def test_quadratic(spark):
    t = [i * 0.1 for i in range(9)]
    v, a = columns(gesture_frames(wide(spark, [(0.2 * x * x, 0) for x in t], t)), "right_velocity_x", "right_accel_x")
    assert np.allclose(v, [0.4 * x for x in t]) and np.allclose(a, 0.4)


def test_uneven_times(spark):
    v, a = columns(gesture_frames(wide(spark, [(0, 0), (1, 0), (9, 0)], [0.0, 1.0, 3.0])), "right_velocity_x", "right_accel_x")
    assert np.allclose(v, [0, 2, 6]) and np.allclose(a, 2)
    t = [0.0, 0.5, 1.5, 3.5, 6.0]
    v, a = columns(gesture_frames(wide(spark, [(0.5 * x, 0) for x in t], t)), "right_velocity_x", "right_accel_x")
    assert np.allclose(v, 0.5) and np.allclose(a, 0, atol=1e-12)


def test_smoothing_equals_local_least_squares(spark):
    r = np.random.default_rng(3)
    for n, order in ((23, 2), (5, 2), (23, 1), (23, 3)):
        t = np.cumsum(r.uniform(0.01, 0.2, n))
        x = r.normal(size=n)
        w = min(7, n if n % 2 else n - 1)
        expect = [np.polynomial.polynomial.polyfit(t[lo : lo + w] - t[i], x[lo : lo + w], order)[0] for i in range(n) for lo in [min(max(i - w // 2, 0), n - w)]]
        (got,) = columns(gesture_frames(wide(spark, [(v, 0) for v in x], t.tolist()), GestureConfig(order=order)), "right_nx_smooth")
        assert np.allclose(got, expect, atol=1e-8), (n, order)


def test_confidence_is_inclusive(spark):
    (nx,) = columns(gesture_frames(wide(spark, [(1, 1)] * 3, conf=[0.2, 0.1999, 0.0])), "right_nx")
    assert nx == [1.0, None, None]


def test_gap_of_three_is_filled_and_four_is_not(spark):
    pts = [(0, 0), (0.1, 0), None, None, None, (0.5, 0)]
    nx, it = columns(gesture_frames(wide(spark, pts, [i * 0.1 for i in range(6)])), "right_nx", "right_interpolated")
    assert np.allclose(nx, [0, 0.1, 0.2, 0.3, 0.4, 0.5]) and sum(it) == 3
    pts = [None, (0.1, 0), None, None, None, None, (0.6, 0), None]
    (nx,) = columns(gesture_frames(wide(spark, pts)), "right_nx")
    assert [v is None for v in nx] == [True, False, True, True, True, True, False, True]


def test_missing_frames_make_a_grid(spark):
    f = gesture_frames(wide(spark, [(0.1, 0)] * 5, [0.0, 0.1, 0.2, 0.5, 0.6], [1, 2, 3, 6, 7]))
    frame, seen = columns(f, "frame", "source_observed")
    assert frame == list(range(1, 8)) and seen == [True, True, True, False, False, True, True]
    s = gesture_sequences(f).first()
    assert (s.frames_source, s.frames_grid, s.frames_missing_grid) == (5, 7, 2)


@pytest.mark.parametrize("gap,timed", [(2, 3), (3, 6)])
def test_clock_hole(spark, gap, timed):
    f = gesture_frames(wide(spark, [(0.1, 0)] * 6, [0.0, 1.0, None, None, None, 6.0]), GestureConfig(max_gap=gap))
    assert f.where("clock_known").count() == timed


def test_sparse_marks(spark):
    f = gesture_frames(wide(spark, [(0, 0)] * 3, [0.0, None, 9.0], [1, 50, 99]))
    s = gesture_sequences(f).first()
    assert (f.count(), s.n_timed_frames, s.n_missing_timestamps) == (99, 2, 97)


def test_aggregates(spark):
    f = gesture_frames(wide(spark, [(x, 0) for x in (0, 0.03, 0.06, 0.36, 0.38, 0.40)], [i * 0.1 for i in range(6)]), GestureConfig(window=3, order=2))
    (speed,) = columns(f, "right_speed")
    assert np.allclose(speed, [0.3, 0.3, 1.65, 1.6, 0.2, 0.2])
    s = gesture_sequences(f).first()
    assert s.right_max_speed == pytest.approx(1.65) and s.right_path_length == pytest.approx(0.40) and s.right_time_to_peak_speed == pytest.approx(0.2)


def test_circular(spark):
    pts = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (90, 0, 90, 180)]
    s = gesture_sequences(gesture_frames(wide(spark, pts, [None] * 4))).first()
    assert s.right_angle_mean == pytest.approx(math.pi / 2) and s.right_angle_std == pytest.approx(math.sqrt(2 * math.log(2)))
    s = gesture_sequences(gesture_frames(wide(spark, [(1, 0), (-1, 0)], [None] * 2))).first()
    assert s.right_angle_mean is None and s.right_angle_std is None


def test_pair(spark):
    r = gesture_frames(wide(spark, [(0.4, 0.3)], left=[(-0.2, 0.3)])).first()
    assert r.pair_separation == pytest.approx(0.6) and (r.centroid_x, r.centroid_y) == (pytest.approx(0.1), pytest.approx(0.3))
    assert r.mirror_error_x == pytest.approx(0.2) and r.mirror_error_y == 0


@pytest.fixture(scope="module")
def extended(spark):
    """Extended features of several clips, computed together."""
    few = [(0.1 * i, 0) for i in range(8)]
    clips = [
        wide(spark, [(math.cos(4 * math.pi * i / 60), math.sin(4 * math.pi * i / 60)) for i in range(61)], name="circle"),
        wide(spark, [(1 + abs((i % 40) - 20) * 0.05, 1) for i in range(61)], name="back and forth"),
        wide(spark, [(1, 1)] * 61, name="stationary"),
        wide(spark, few, left=few, name="few"),
        wide(spark, [None] * 20, name="none"),
    ]
    every = clips[0]
    for c in clips[1:]:
        every = every.union(c)
    return {r.id: r.asDict() for r in gesture_sequences(gesture_frames(every, extended=True), extended=True).collect()}


def test_circle_areas(extended):
    s = extended["circle"]
    assert s["right_hull_area"] == pytest.approx(math.pi, rel=0.05) and s["right_ellipse_area"] == pytest.approx(2 * math.pi, rel=0.05) and s["right_bbox_area"] == pytest.approx(4, rel=0.05)


def test_back_and_forth(extended):
    s = extended["back and forth"]
    assert s["right_reversals_x"] == 2 and s["right_reversals_y"] is None and s["right_reversals_radial"] == 2
    assert s["right_reversals_per_s"] == pytest.approx(1.0)


def test_stationary(extended):
    s = extended["stationary"]
    assert s["right_cv_speed"] is None and s["right_speed_skew"] is None and s["right_frac_speed_gt_0p5"] == 0
    assert s["right_hull_area"] == 0 and s["right_ellipse_area"] == 0


def test_few_samples_and_none(extended):
    s = extended["few"]
    assert s["right_speed_p50"] is None and s["right_n_speed"] == 8 and s["n_cos_phase"] == 8 and s["coactivity_bout_n"] == 1
    s = extended["none"]
    counters = {"right_n_speed", "left_n_speed", "n_cos_phase", "coactivity_bout_n"}
    names = set(S.EXTENDED_SEQUENCE_COLUMNS) - set(S.SEQUENCE_COLUMNS)
    assert {k for k in names if s[k] is not None} == counters and all(s[k] == 0 for k in counters)


def test_sequences_do_not_touch(spark):
    a, b = wide(spark, [(0.1 * i, 0) for i in range(12)], name="a"), wide(spark, [(5 - 0.3 * i, 1) for i in range(9)], name="b")
    alone = {r.id: r for x in (a, b) for r in gesture_sequences(gesture_frames(x)).collect()}
    for r in gesture_sequences(gesture_frames(a.union(b))).collect():
        for c in S.SEQUENCE_COLUMNS[2:]:
            assert (r[c] is None) == (alone[r.id][c] is None) and (r[c] is None or r[c] == pytest.approx(alone[r.id][c])), c


def test_empty_input_keeps_columns(spark):
    f = gesture_frames(spark.createDataFrame([], WIDE), extended=True)
    assert tuple(f.columns) == S.EXTENDED_FRAME_COLUMNS and f.count() == 0
    assert gesture_sequences(f, extended=True).count() == 0


def test_one_shuffle_for_frames(spark):
    plan = gesture_frames(spark.createDataFrame([], WIDE).repartition(3))._jdf.queryExecution().executedPlan().toString()
    # The frames move once; the other two carry a row for each slice, then for each sequence.
    assert plan.count("Exchange hashpartitioning") == 3


def test_config():
    for bad in (dict(window=4), dict(order=7), dict(min_confidence=2), dict(max_gap=-1), dict(window=True)):
        with pytest.raises(ConfigError):
            GestureConfig(**bad)
    assert GestureConfig.of({"max-gap": 2}).max_gap == 2
    with pytest.raises(ConfigError):
        GestureConfig.of({"max-gap": 2, "max_gap": 3})
    assert point_list("4, 7") == (4, 7)
    with pytest.raises(ConfigError):
        point_list("4,4")


def test_nan_counts_as_null(spark):
    df = wide(spark, [(0.1, 0)] * 3).withColumn("nx_4", F.when(F.col("frame") == 2, F.lit(float("nan"))).otherwise(F.col("nx_4")))
    assert columns(gesture_frames(df, GestureConfig(max_gap=0)), "right_nx")[0] == [0.1, None, 0.1]


def fault(spark, **columns):
    """The problems of a table of four frames with some columns replaced."""
    base = {"id": "c", "people_id": 0.0, "frame_timestamp": None, "nx_4": 0.1, "ny_4": 0.1, "c_4": 0.9, "nx_7": 0.1, "ny_7": 0.1, "c_7": 0.9}
    rows = [{**base, "frame": i, "frame_timestamp": i / 10, **{k: v[i] for k, v in columns.items()}} for i in range(4)]
    df = spark.createDataFrame([tuple(r[c] for c in S.WIDE) for r in rows], WIDE.replace("frame long", f"frame {'double' if any(isinstance(f, float) for f in columns.get('frame', ())) else 'long'}"))
    return df, [r.problem for r in guards.problems(df).collect()]


@pytest.mark.parametrize(
    "columns,problem",
    [
        ({"people_id": [0.0, None, 0.0, 0.0]}, "no key"), ({"id": ["c", "c", None, "c"]}, "no key"), ({"frame": [0, 1, None, 3]}, "no key"),
        ({"people_id": [0.0, 0.0, 0.0, float("inf")]}, "person"), ({"frame": [0.0, 1.5, 2.0, 3.0]}, "frame"), ({"frame": [0.0, 1.0, 2.0, 1e30]}, "frame"),
        ({"frame_timestamp": [0.0, 0.1, float("inf"), 0.3]}, "time"), ({"c_4": [0.9, 1.7, 0.9, 0.9]}, "confidence"), ({"c_7": [0.9, 0.9, -0.1, 0.9]}, "confidence"),
        ({"frame": [0, 1, 1, 3], "frame_timestamp": [0.0, 0.1, 0.1, 0.3], "nx_4": [0.1, 0.1, 0.2, 0.1]}, "conflict"), ({"frame_timestamp": [0.0, 0.2, 0.1, 0.3]}, "clock"),
        ({"frame_timestamp": [0.0, 0.2, None, 0.2]}, "clock"), ({"frame": [0, 1, 2, 1 << 40]}, "span"),
    ],
)
def test_guards(spark, columns, problem):
    df, found = fault(spark, **columns)
    assert found == [problem]
    with pytest.raises(Exception, match=problem):
        gesture_frames(df).collect()


def test_equal_rows_count_once(spark):
    df, found = fault(spark, c_4=[0.9, None, float("nan"), 0.0])
    assert found == []
    assert gesture_frames(df.union(df).union(df)).count() == 4 and guards.checked(df.union(df)).count() == 4
    assert gesture_frames(df.drop("nx_7", "ny_7", "c_7")).where("left_valid").count() == 0
    with pytest.raises(guards.DataError, match="frame"):
        gesture_frames(df.drop("frame"))


def test_infinite_coordinates_are_not_measured(spark):
    df, found = fault(spark, nx_4=[0.1, float("inf"), float("nan"), 0.4])
    assert found == [] and gesture_frames(df, GestureConfig(max_gap=0)).where("right_observed").count() == 2


def test_hulls_hold_one_list_as_numbers_at_a_time():
    """A batch of lists stays Arrow: what the hulls take beside it is that of one list."""
    import tracemalloc

    import pyarrow as pa

    from kinesia.operators import gestures as G

    n, size = 1000, 200
    turn = np.linspace(0, 2 * np.pi, n * size)
    points = pa.ListArray.from_arrays(np.arange(0, n * size + 1, size, dtype=np.int32), pa.StructArray.from_arrays([pa.array(np.cos(turn)), pa.array(np.sin(turn))], ["x", "y"]))
    points = pa.concat_arrays([points, pa.array([None, [], [{"x": 1.0, "y": 2.0}]], points.type)])
    tracemalloc.start()
    areas, corners = G.hull_area.func(points), G.hull_corners.func(points.slice(n - 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # As dictionaries the points would be more than 50 MB.
    assert peak < 4e6
    assert areas[n:].to_pylist() == [None, 0.0, 0.0] and len(areas) == n + 3
    assert corners[1:].to_pylist() == [None, [], [{"x": 1.0, "y": 2.0}]] and len(corners[0]) == size


def test_extended_features_of_many_frames_are_dealt_by_their_number(spark, monkeypatch):
    from kinesia.operators import gestures as G

    rows = [(f"c{i % 40}", 1.0, i // 40, i / 40, 0.1, 0.2, 0.9, 0.3, 0.4, 0.9) for i in range(40 * 12)]
    wide = spark.createDataFrame(rows, WIDE)
    few = sorted(map(str, G.sequence_features(wide, extended=True).select("id", "right_n_speed", "coactivity_bout_n").collect()))
    monkeypatch.setattr(G, "TASK_FRAMES", 20)
    got = G.sequence_features(wide, extended=True).select("id", "right_n_speed", "coactivity_bout_n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    # 480 frames in 24 parts, and no shuffle of another kind between these and the windows.
    assert "24), REPARTITION_BY_NUM" in plan and plan.count("_slice#") and not [x for x in plan.splitlines() if "ENSURE_REQUIREMENTS" in x and "_slice#" in x]
    assert sorted(map(str, got.collect())) == few
