"""Per-frame and per-sequence movement features of both wrists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesia import schema as S
from kinesia.config import GestureConfig
from kinesia.functions.ranks import group_quantiles
from kinesia.operators import sequence as Q
from kinesia.operators.guards import checked_slices, extent

DEFAULT = GestureConfig()
#: Measures whose whole distribution is described.
SPREAD = ("speed", "accel_magnitude", "jerk_magnitude", "neck_distance")
#: Frames of the extended features for a task.  Spark sizes tasks by the few columns that are shuffled, but the windows take some 4 KB
#: for a frame (528 MB for 123,454 rows, measured), so it would give a task too many.
TASK_FRAMES = 25_000


def gesture_frames(wide: DataFrame, config: GestureConfig = DEFAULT, extended: bool = False, slice_bits: int = Q.SLICE_BITS) -> DataFrame:
    """``schema.FRAME_COLUMNS`` (and jerk, if ``extended``) for each frame of each sequence's span.

    Equal rows count once; what ``guards.problems`` lists raises when the frames are computed.  A sequence of any length is spread
    over tasks in slices of 2^slice_bits frames; a frame's values do not depend on them.
    """
    return frames_in_slices(wide, config, extended, slice_bits).where("_own").select(*(S.EXTENDED_FRAME_COLUMNS if extended else S.FRAME_COLUMNS))


def frames_in_slices(wide: DataFrame, config: GestureConfig = DEFAULT, extended: bool = False, slice_bits: int = Q.SLICE_BITS, only_long: bool = False, parts: int | None = None) -> DataFrame:
    """``gesture_frames`` with ``_slice``, the rows beyond a slice's edges (not ``_own``; right for the two frames next to it), and what is
    known of the whole sequence: ``_long`` (it has several slices), ``_start_t`` and ``_end_t``.
    """
    reach, bits = _slicing(config, extended, slice_bits)
    rows = checked_slices(wide, bits, reach, parts)
    with Q.sliced():
        d = _measured(Q.expand_grid(rows.where("_long") if only_long else rows), config, extended)
    return d.withColumn("_own", F.col("_slice") == Q.slice_of(F.col("frame"), bits))


def _slicing(config: GestureConfig, extended: bool, slice_bits: int) -> tuple[int, int]:
    reach = Q.reach_of(config.max_gap, config.window, extended)
    return reach, max(slice_bits, (2 * reach).bit_length() + 1)


def sequence_features(wide: DataFrame, config: GestureConfig = DEFAULT, extended: bool = False, slice_bits: int = Q.SLICE_BITS) -> DataFrame:
    """``gesture_sequences(gesture_frames(wide))`` without a second shuffle of the frames and without a task that holds a long sequence.

    Windows stay within slices; what they cannot see across an edge is added up from one small record for each slice.  Quantiles and
    hulls of sequences of several slices take passes of their own; whether there are any, and how many frames, is asked first (a scan of keys and frames).
    """
    several, n = extent(wide, _slicing(config, extended, slice_bits)[1]) if extended else (False, 0)
    # Few frames are left to Spark, which may need no shuffle at all for them.
    parts = -(-n // TASK_FRAMES) if n > 8 * TASK_FRAMES else None
    frames = frames_in_slices(wide, config, extended, slice_bits, parts=parts)
    with Q.sliced():
        out = _summed(frames if several or not extended else frames.withColumn("_long", F.lit(False)), extended)
    if not several:
        return out.select(*(S.EXTENDED_SEQUENCE_COLUMNS if extended else S.SEQUENCE_COLUMNS))
    long = frames_in_slices(wide, config, extended, slice_bits, only_long=True, parts=parts).where("_own")
    more = long_hulls(long).join(long_quantiles(long), list(S.KEYS))
    theirs = [c for c in more.columns if c not in S.KEYS]
    both = out.join(more.select(*S.KEYS, *[F.col(c).alias(f"_l_{c}") for c in theirs]), list(S.KEYS), "left")
    return both.select(*[F.coalesce(f"_l_{c}", c).alias(c) if c in theirs else F.col(c) for c in S.EXTENDED_SEQUENCE_COLUMNS])


def long_hulls(frames: DataFrame) -> DataFrame:
    """Hull areas of frames in slices: the hull of a slice's points, then of the slices' corners."""
    parts, areas = {}, {}
    for hand in S.HANDS:
        x, y = F.col(f"{hand}_nx_smooth"), F.col(f"{hand}_ny_smooth")
        placed = F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
        parts |= {f"_p_{hand}": F.collect_list(placed), f"_n_{hand}": F.count(placed)}
        areas[f"{hand}_hull_area"] = enough(F.sum(f"_n_{hand}"), F.flatten(F.collect_list(f"_p_{hand}")))
    slices = frames.groupBy(*S.KEYS, "_slice").agg(*[v.alias(k) for k, v in parts.items()]).withColumns({f"_p_{h}": hull_corners(F.col(f"_p_{h}")) for h in S.HANDS})
    rings = slices.groupBy(*S.KEYS).agg(*[v.alias(k) for k, v in areas.items()])
    return rings.select(*S.KEYS, *[hull_area(F.col(k)).alias(k) for k in areas])


def long_quantiles(frames: DataFrame) -> DataFrame:
    """Quantile columns of frames whose sequences are too long for one buffer: exact, by ranks within the group."""
    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    spread = [f"{h}_{m}" for h in S.HANDS for m in SPREAD]
    found = group_quantiles(frames.withColumn("_cos", _cos()), list(S.KEYS), [*spread, "_cos"], tuple(shares.values()))
    at = {(c, k): F.max(F.when((F.col("column") == c) & (F.col("k") == i), enough(F.col("n"), F.col("value")))) for c in (*spread, "_cos") for i, k in enumerate(shares)}
    names = {(c, k): f"{c}_{k}" for c in spread for k in shares} | {("_cos", "p05"): "cos_phase_p05", ("_cos", "p50"): "cos_phase_median", ("_cos", "p95"): "cos_phase_p95"}
    return found.groupBy(*S.KEYS).agg(*[at[key].alias(name) for key, name in names.items()])


def _measured(grid: DataFrame, config: GestureConfig, extended: bool) -> DataFrame:
    d = Q.infer_clock(grid, config.max_gap)
    d = d.withColumns({f"{h}_observed": Q.trusted(F.col(f"nx_{p}"), F.col(f"ny_{p}"), F.col(f"c_{p}"), config.min_confidence) for h, p in S.HANDS.items()})
    d = Q.fill_coordinates(d, {h: (f"nx_{p}", f"ny_{p}", f"{h}_observed") for h, p in S.HANDS.items()}, config.max_gap)
    d = d.withColumns({f"_{h}_ok": F.col(f"{h}_valid") & F.col("clock_known") for h in S.HANDS} | {f"{h}_{a}_smooth": F.col(f"{h}_{a}") for h in S.HANDS for a in ("nx", "ny")})
    d = Q.with_runs(d, {f"_{h}_ok": f"_{h}_run" for h in S.HANDS})
    for hand in S.HANDS:
        d = _motion(d, hand, config, extended)
    d = d.withColumns({k: v for hand in S.HANDS for k, v in _geometry(hand).items()})
    both = F.col("right_valid") & F.col("left_valid")
    rx, ry, lx, ly = (F.col(f"{h}_{a}_smooth") for h in ("right", "left") for a in ("nx", "ny"))
    apart = Q.norm(rx - lx, ry - ly)
    pair = {
        "both_hands_valid": both, "pair_separation": F.when(both, apart), "pair_angle": F.when(both & (apart > 0), F.atan2(ry - ly, rx - lx)),
        "centroid_x": F.when(both, (rx + lx) / 2), "centroid_y": F.when(both, (ry + ly) / 2),
        "mirror_error_x": F.when(both, F.abs(rx + lx)), "mirror_error_y": F.when(both, F.abs(ry - ly)),
    }
    names = S.EXTENDED_FRAME_COLUMNS if extended else S.FRAME_COLUMNS
    pair |= {f"{h}_confidence": F.col(f"c_{p}") for h, p in S.HANDS.items()}
    return d.select(*[pair[c].alias(c) if c in pair else F.col(c) for c in names], "_slice", "_long", "_start_t", "_end_t")


def _motion(d: DataFrame, hand: str, config: GestureConfig, extended: bool) -> DataFrame:
    """Smoothed coordinates and their derivatives, within the runs of frames that are valid and timed."""
    ok, run = f"_{hand}_ok", f"_{hand}_run"
    name = lambda m: f"{hand}_{m}"
    source = {a: name(f"n{a}_smooth") for a in ("x", "y")}
    d = d.withColumns(Q.run_places(ok, run))
    d = Q.smooth(d, list(source.values()), ok, run, config.window, config.order)
    n, out, raw = F.col("_n"), {}, []
    for least, kind in ((2, "velocity"), (3, "accel"), (4, "jerk"))[: 3 if extended else 2]:
        # Deeper derivatives are of the unrestricted ones, which two rows have already.
        deeper = {a: f"_{hand}_{kind}_{a}" for a in source}
        d = d.withColumns({deeper[a]: Q.derivative(source[a], ok, run) for a in source})
        out |= {name(f"{kind}_{a}"): F.when(n >= least, F.col(c)) for a, c in deeper.items()}
        out[name({"velocity": "speed"}.get(kind, f"{kind}_magnitude"))] = F.when(n >= least, Q.norm(*map(F.col, deeper.values())))
        source = deeper
        raw += deeper.values()
    return d.withColumns(out).drop("_n", "_t1", "_t2", "_u1", "_u2", *raw)


def _geometry(hand: str) -> dict[str, Column]:
    name = lambda m: f"{hand}_{m}"
    x, y, w = F.col(name("nx_smooth")), F.col(name("ny_smooth")), Q.by_frame()
    distance = Q.norm(x, y)
    return {
        name("step_distance"): F.when(F.col(name("valid")) & F.lag(name("valid")).over(w), Q.norm(x - F.lag(x).over(w), y - F.lag(y).over(w))),
        name("neck_distance"): distance, name("neck_angle"): F.when(distance > 0, F.atan2(y, x)), name("above_neck"): y > 0,
    }


def gesture_sequences(frames: DataFrame, extended: bool = False) -> DataFrame:
    """One row for each sequence of ``gesture_frames``' result; ``extended`` needs its jerk columns.

    This takes frames from anywhere, and a sequence in one task; ``sequence_features`` has neither limit.
    """
    whole = W.partitionBy(*S.KEYS)
    d = frames.withColumns({"_start_t": F.min("frame_timestamp").over(whole), "_end_t": F.max("frame_timestamp").over(whole), "_slice": F.lit(0), "_own": F.lit(True), "_long": F.lit(False)})
    return _summed(d, extended).select(*(S.EXTENDED_SEQUENCE_COLUMNS if extended else S.SEQUENCE_COLUMNS))


def _summed(d: DataFrame, extended: bool) -> DataFrame:
    """One row for each sequence, of frames with ``_slice``, ``_own``, ``_long``, ``_start_t`` and ``_end_t``; windows are those that ``Q.parted`` says."""
    more, after = {}, []
    if extended:
        d, more, after = _extended(d)
    d = d.where("_own").withColumnsRenamed({"_start_t": "_t0", "_end_t": "_t1"})
    t, edge = F.col("frame_timestamp"), (F.col("_t1") - F.col("_t0")) * 0.1
    d = d.withColumns({"_early": t <= F.col("_t0") + edge, "_late": t >= F.col("_t1") - edge})
    n = F.count(F.lit(1)).cast("double")
    count = lambda c: F.count_if(c).cast("double")
    aggs = {
        "frames_source": count(F.col("source_observed")), "frames_grid": n, "frames_missing_grid": count(F.col("frame_inferred")),
        "n_timed_frames": count(F.col("clock_known")), "n_timestamp_inferred": count(F.col("timestamp_inferred")),
        "n_missing_timestamps": n - count(F.col("clock_known")), "t_start": F.min("_t0"), "t_end": F.max("_t1"), "duration_s": F.max("_t1") - F.min("_t0"),
        "n_both_hands": count(F.col("both_hands_valid")), "frac_both_hands": count(F.col("both_hands_valid")) / n,
        "mean_pair_separation": F.avg("pair_separation"), "max_pair_separation": F.max("pair_separation"),
        "mean_mirror_error_x": F.avg("mirror_error_x"), "mean_mirror_error_y": F.avg("mirror_error_y"),
        "time_to_peak_pair_separation": time_to_peak("pair_separation"),
    }
    for hand in S.HANDS:
        c = lambda m, hand=hand: F.col(f"{hand}_{m}")
        mean_cos, mean_sin = F.avg(F.cos(c("neck_angle"))), F.avg(F.sin(c("neck_angle")))
        length = F.least(Q.norm(mean_cos, mean_sin), F.lit(1.0))
        directed = length > S.ZERO_RESULTANT
        aggs |= {f"{hand}_{k}": v for k, v in {
            "n_observed": count(c("observed")), "n_interpolated": count(c("interpolated")), "n_valid": count(c("valid")),
            "frac_observed": count(c("observed")) / n, "frac_interpolated": count(c("interpolated")) / n, "frac_valid": count(c("valid")) / n,
            "mean_speed": F.avg(c("speed")), "max_speed": F.max(c("speed")), "mean_accel_magnitude": F.avg(c("accel_magnitude")), "max_accel_magnitude": F.max(c("accel_magnitude")),
            "path_length": F.sum(c("step_distance")), "nx_range": F.max(c("nx_smooth")) - F.min(c("nx_smooth")), "ny_range": F.max(c("ny_smooth")) - F.min(c("ny_smooth")),
            "mean_neck_distance": F.avg(c("neck_distance")), "angle_mean": F.when(directed, F.atan2(mean_sin, mean_cos)),
            "angle_std": F.when(directed, F.sqrt(F.greatest(F.log(length) * -2, F.lit(0.0)))), "time_to_peak_speed": time_to_peak(f"{hand}_speed"),
            "early_speed_mean": F.avg(F.when(F.col("_early"), c("speed"))), "late_speed_mean": F.avg(F.when(F.col("_late"), c("speed"))),
        }.items()}
    out = d.groupBy(*S.KEYS).agg(*[v.alias(k) for k, v in (aggs | more).items()])
    for step in after:
        out = out.withColumns(step)
    return out


def time_to_peak(c: str) -> Column:
    """Elapsed time of the first greatest value since the sequence's first known clock; null if that frame is untimed."""
    best = F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("frame")).alias("f"), F.col("frame_timestamp").alias("t"))))
    return best["t"] - F.min("_t0")


def enough(n: Column, value: Column) -> Column:
    return F.when(n >= S.MIN_STAT_SAMPLES, value)


def flips(sign: Column) -> Column:
    """Whether a row's sign differs from the last row's that has one; null signs are passed over, and rows that are no slice's own."""
    own = F.when(F.col("_own"), sign)
    before = F.last(own, ignorenulls=True).over(Q.by_frame().rowsBetween(W.unboundedPreceding, -1))
    return own.isNotNull() & before.isNotNull() & (own != before)


def edge_signs(sign: Column) -> Column:
    """On one row of each slice: struct(slice, first and last sign in it); elsewhere null."""
    own = F.when(F.col("_own"), sign)
    whole = Q.by_frame().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return F.when(own.isNotNull() & F.last(own, ignorenulls=True).over(Q.by_frame().rowsBetween(W.unboundedPreceding, -1)).isNull(), F.struct(F.col("_slice").alias("slice"), own.alias("first"), F.last(own, ignorenulls=True).over(whole).alias("last")))


def flips_between(edges: Column) -> Column:
    """Changes of sign from a slice to the next one that has a sign, from a list of ``edge_signs``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("sign"))
    step = lambda s, e: F.struct((s["n"] + F.when(s["sign"] != e["first"], 1).otherwise(0)).cast("long").alias("n"), e["last"].alias("sign"))
    return F.aggregate(F.sort_array(edges), zero, step, lambda s: s["n"])


def bouts(d: DataFrame, on: Column, name: str) -> tuple[DataFrame, Column, Column]:
    """Add the runs of adjacent timed frames where ``on`` holds: the duration of a run within a slice on its last row, and the pieces
    of runs that touch a slice's edge.

    The first timed frame after a hole in the clock belongs to no run.  A sequence's first and last frames are edges too; ``joined``
    settles all pieces.
    """
    w = Q.by_frame()
    clock_before = F.lag("clock_known").over(w)
    adjacent = clock_before.isNull() | ((F.col("frame") - F.lag("frame").over(w) == 1) & F.col("clock_known") & clock_before)
    d = d.withColumn(f"_{name}", F.coalesce(on, F.lit(False)) & F.col("clock_known") & adjacent)
    # Rows beyond the edge end a run here; that they go on is settled in ``joined``.
    d = d.withColumn(f"_{name}_o", F.col(f"_{name}") & F.col("_own"))
    d = Q.with_run(d, f"_{name}_o", f"_{name}_k")
    part = Q.in_run(f"_{name}_o", f"_{name}_k")
    first, last = F.min("frame").over(part), F.max("frame").over(part)
    span = F.struct(F.min("frame_timestamp").over(part).alias("a"), F.max("frame_timestamp").over(part).alias("b"), first.alias("from"), last.alias("to"))
    at_end = F.col(f"_{name}_o") & (F.row_number().over(part.orderBy(F.desc("frame"))) == 1)
    own = F.when(F.col("_own"), F.col("frame"))
    whole = W.partitionBy(*Q.parted())
    d = d.withColumns({f"_{name}_r": F.when(at_end, span), f"_{name}_lo": F.min(own).over(whole), f"_{name}_hi": F.max(own).over(whole)})
    r = F.col(f"_{name}_r")
    touches = F.col("_long") & ((r["from"] == F.col(f"_{name}_lo")) | (r["to"] == F.col(f"_{name}_hi")))
    return d, F.when(~touches, r["b"] - r["a"]), F.when(touches, F.struct(r["from"].alias("from"), r["to"].alias("to"), r["a"].alias("a"), r["b"].alias("b")))


def joined(pieces: Column) -> Column:
    """Durations of the runs that pieces at slices' edges (a list of them) make: a piece goes on with the one that begins a frame later."""
    piece = "struct<from:bigint,to:bigint,a:double,b:double>"
    zero = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast(piece).alias("open"))

    def step(s: Column, p: Column) -> Column:
        goes_on = F.coalesce(s["open"]["to"] + 1 == p["from"], F.lit(False))
        merged = F.when(goes_on, F.struct(s["open"]["from"].alias("from"), p["to"].alias("to"), s["open"]["a"].alias("a"), p["b"].alias("b"))).otherwise(p).cast(piece)
        closed = F.when(goes_on | s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]["b"] - s["open"]["a"])))
        return F.struct(closed.alias("done"), merged.alias("open"))

    # As many pieces as twice the slices at most.
    return F.aggregate(F.sort_array(pieces), zero, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]["b"] - s["open"]["a"]))))


def _cos() -> Column:
    """Cosine of the angle between the hands' velocities where both move."""
    sr, sl = F.col("right_speed"), F.col("left_speed")
    dot = F.col("right_velocity_x") * F.col("left_velocity_x") + F.col("right_velocity_y") * F.col("left_velocity_y")
    return F.when((sr > S.MOVEMENT_SPEED) & (sl > S.MOVEMENT_SPEED), dot / (sr * sl))


def _ring(xs: np.ndarray, ys: np.ndarray) -> list[tuple[float, float]]:
    """The corners of the convex hull in order, of collinear points the outer ones; all different points if there are fewer than three."""
    xy = sorted(set(zip(xs.tolist(), ys.tolist(), strict=True)))
    if len(xy) < 3:
        return xy

    def chain(ordered):
        out: list[tuple[float, float]] = []
        for q in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return chain(xy)[:-1] + chain(xy[::-1])[:-1]


def _rings(points: pa.Array) -> Iterator[np.ndarray | None]:
    """The corners of each list of (x, y), an array of two columns; null for null.  Only one list at a time becomes Python's numbers."""
    xy = points.values
    xs, ys = (xy.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    ends = points.offsets.to_numpy()
    for known, a, b in zip(points.is_valid().to_numpy(zero_copy_only=False), ends[:-1], ends[1:], strict=True):
        yield np.array(_ring(xs[a:b], ys[a:b]), dtype=float).reshape(-1, 2) if known else None


@F.arrow_udf(T.DoubleType())
def hull_area(points: pa.Array) -> pa.Array:
    """Area of the convex hull of each list of (x, y); 0 for fewer than three distinct or collinear points."""

    def area(ring: np.ndarray) -> float:
        x, y = ring[:, 0], ring[:, 1]
        return 0.5 * abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1)))

    return pa.array([None if ring is None else area(ring) for ring in _rings(points)], pa.float64())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def hull_corners(points: pa.Array) -> pa.Array:
    """The corners of each list's hull: the hull of several lists is that of their corners, so a long clip goes through in slices."""
    rings = list(_rings(points))
    ends = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rings])]).astype(np.int32)
    xy = np.concatenate([np.empty((0, 2)), *[r for r in rings if r is not None]])
    corners = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends), corners, mask=pa.array([r is None for r in rings], pa.bool_()))


def _extended(d: DataFrame) -> tuple[DataFrame, dict[str, Column], list[dict[str, Column]]]:
    w = Q.by_frame()
    more: dict[str, Column] = {}
    early: dict[str, Column] = {}
    first: dict[str, Column] = {}
    for hand in S.HANDS:
        c = lambda m, hand=hand: F.col(f"{hand}_{m}")
        o = lambda m, hand=hand: f"{hand}_{m}"
        speed, n = c("speed"), F.count(c("speed"))
        moved = F.coalesce(F.max(speed) > S.MOVEMENT_SPEED, F.lit(False))
        for m in SPREAD:
            v = c(m)
            k = F.count(v)
            # One buffer holds a slice's values at most; those of longer sequences come by ranks.
            p = F.percentile(F.when(~F.col("_long"), v), F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)]))
            values = {"min": F.min(v), "p05": p[0], "p25": p[1], "p50": p[2], "p75": p[3], "p95": p[4], "max": F.max(v), "std": F.stddev_samp(v)}
            more |= {o(f"{m}_{s}"): enough(k, x) for s, x in values.items()}
        for axis in ("nx", "ny"):
            v = c(f"{axis}_smooth")
            more |= {o(f"{axis}_{s}"): enough(F.count(v), f(v)) for s, f in (("min", F.min), ("max", F.max), ("std", F.stddev_samp))}
        radial = (c("neck_distance") - F.lag(c("neck_distance")).over(w)) / F.nullif(F.col("frame_timestamp") - F.lag("frame_timestamp").over(w), F.lit(0.0))
        for axis, v in (("x", c("velocity_x")), ("y", c("velocity_y")), ("radial", radial)):
            d = d.withColumn(f"_sign_{hand}_{axis}", F.when(F.abs(v) > S.MOVEMENT_SPEED, F.signum(v)))
        for axis in ("x", "y", "radial"):
            sign = F.col(f"_sign_{hand}_{axis}")
            flip, edge = f"_flip_{hand}_{axis}", f"_edge_{hand}_{axis}"
            d = d.withColumns({flip: flips(sign), edge: edge_signs(sign)})
            more |= {f"_n{flip}": F.count(sign), f"_k{flip}": F.count_if(F.col(flip)), f"_e{edge}": F.collect_list(F.when(F.col("_long"), F.col(edge)))}
            early[o(f"reversals_{axis}")] = enough(F.col(f"_n{flip}"), (F.col(f"_k{flip}") + flips_between(F.col(f"_e{edge}"))).cast("double"))
        x, y = c("nx_smooth"), c("ny_smooth")
        placed = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
        more[f"_hull_{hand}"] = enough(placed, F.collect_list(F.when(x.isNotNull() & y.isNotNull() & ~F.col("_long"), F.struct(x.alias("x"), y.alias("y")))))
        # The product of a covariance matrix' eigenvalues is its determinant.
        det = F.var_samp(x) * F.var_samp(y) - F.covar_samp(x, y) * F.covar_samp(x, y)
        more[o("ellipse_area")] = enough(placed, F.sqrt(F.greatest(det, F.lit(0.0))) * (4 * np.pi))
        more[o("bbox_area")] = enough(placed, (F.max(x) - F.min(x)) * (F.max(y) - F.min(y)))
        more[o("cv_speed")] = enough(n, F.when(moved & (F.avg(speed) > 0), F.stddev_samp(speed) / F.avg(speed)))
        more[o("mean_over_max")] = enough(n, F.when(F.max(speed) > 0, F.avg(speed) / F.max(speed)))
        more[f"_n_{hand}"], more[f"_moved_{hand}"] = n, moved
        varied = F.var_pop(speed) > 0
        more[o("speed_skew")] = enough(n, F.when(moved & varied, F.skewness(speed)))
        more[o("speed_kurtosis")] = enough(n, F.when(moved & varied, F.kurtosis(speed)))
        for label, threshold in S.SPEED_THRESHOLDS.items():
            more[o(f"frac_speed_gt_{label}")] = enough(n, F.avg((speed > threshold).cast("int")))
        more[o("speed_sq_mean")], more[o("speed_sq_sum")] = enough(n, F.avg(speed * speed)), enough(n, F.sum(speed * speed))
        more[o("n_speed")] = n.cast("double")
        d, span, piece = bouts(d, speed > S.MOVEMENT_SPEED, f"move_{hand}")
        more |= {f"_longest_{hand}": F.max(span), f"_pieces_{hand}": F.collect_list(piece)}
        first[o("longest_moving_s")] = F.when(F.col(f"_n_{hand}") >= S.MIN_STAT_SAMPLES, F.greatest(f"_longest_{hand}", F.array_max(joined(F.col(f"_pieces_{hand}")))))
        rx, ry = F.col(o("reversals_x")), F.col(o("reversals_y"))
        first[o("reversals_per_s")] = F.when((F.col("duration_s") > 0) & (rx.isNotNull() | ry.isNotNull()), (F.coalesce(rx, F.lit(0.0)) + F.coalesce(ry, F.lit(0.0))) / F.col("duration_s"))
        first[o("hull_area")] = hull_area(F.col(f"_hull_{hand}"))
        first[o("t_peak_rel")] = F.when((F.col(f"_n_{hand}") >= S.MIN_STAT_SAMPLES) & (F.col("duration_s") > 0), F.col(o("time_to_peak_speed")) / F.col("duration_s"))
        first[o("early_late_speed_ratio")] = F.when((F.col(f"_n_{hand}") >= S.MIN_STAT_SAMPLES) & F.col(f"_moved_{hand}") & (F.col(o("late_speed_mean")) > 0), F.col(o("early_speed_mean")) / F.col(o("late_speed_mean")))
    sr, sl = F.col("right_speed"), F.col("left_speed")
    moving = (sr > S.MOVEMENT_SPEED) & (sl > S.MOVEMENT_SPEED)
    d = d.withColumn("_cos", _cos())
    cos, n_cos = F.col("_cos"), F.count("_cos")
    p = F.percentile(F.when(~F.col("_long"), cos), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    for k, v in (("mean", F.avg(cos)), ("median", p[1]), ("std", F.stddev_samp(cos)), ("p05", p[0]), ("p95", p[2])):
        more[f"cos_phase_{k}"] = enough(n_cos, v)
    more |= {"frac_cos_gt_0p8": enough(n_cos, F.avg((cos > 0.8).cast("int"))), "frac_cos_lt_m0p2": enough(n_cos, F.avg((cos < -0.2).cast("int"))), "n_cos_phase": n_cos.cast("double")}
    both = sr.isNotNull() & sl.isNotNull()
    n_both = F.count_if(both)
    for name, limit in (("0p5", S.MOVEMENT_SPEED), ("1p0", 1.0)):
        more[f"coactivity_frac_{name}"] = enough(n_both, F.avg(F.when(both, ((sr > limit) & (sl > limit)).cast("int"))))
    d, span, piece = bouts(d, moving, "both")
    more |= {"_bouts_n": F.count(span), "_bouts_s": F.sum(span), "_bouts_max": F.max(span), "_bouts": F.collect_list(piece), "_n_both": n_both}
    early["_bouts"] = joined(F.col("_bouts"))
    n_bouts, known = F.col("_bouts_n") + F.size("_bouts"), F.col("_n_both") >= S.MIN_STAT_SAMPLES
    total = F.coalesce("_bouts_s", F.lit(0.0)) + F.aggregate("_bouts", F.lit(0.0), lambda a, x: a + x)
    first |= {"coactivity_bout_n": n_bouts.cast("double"), "coactivity_bout_mean_s": F.when(known & (n_bouts > 0), F.try_divide(total, n_bouts)), "coactivity_bout_max_s": F.when(known, F.greatest("_bouts_max", F.array_max("_bouts")))}
    for a in ("x", "y"):
        v = F.col(f"mirror_error_{a}")
        more[f"mirror_error_{a}_std"] = enough(F.count(v), F.stddev_samp(v))
    rx, ry, lx, ly = (F.col(f"{h}_{a}_smooth") for h in ("right", "left") for a in ("nx", "ny"))
    paired = reduce(lambda x, y: x & y, [F.col("both_hands_valid"), *[v.isNotNull() for v in (rx, ry, lx, ly)]])
    mean = lambda v: enough(F.count_if(paired), F.avg(F.when(paired, v)))
    more |= {"abs_y_pair_sum_mean": mean(F.abs(ry + ly)), "pair_elevation_mean": mean((ry + ly) / 2), "bbox_area_wrists": mean(F.abs(rx - lx) * F.abs(ry - ly))}
    return d, more, [early, first]
