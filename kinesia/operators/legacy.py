"""The published baseline features: fixed frame rate, first-order edges, and measures set against the whole table.

Input is (id, frame, right_x, right_y, left_x, left_y), without gaps.  Kept for comparison; y grows downwards here.

Where the published code depends on the order of rows or mixes clips by accident, this stack decides: early and late
speeds are by clip, ties in quartile labels go by id, and quartiles with equal edges count nothing (for rings: all in the first).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia.functions.ranks import exact_quantiles
from kinesia.operators.gestures import hull_area, hull_corners
from kinesia.operators.sequence import norm

HANDS = ("right", "left")
ZONE = 0.5
FAST, COORDINATED = 2.0, 0.8
FAR, FAR_FROM_CENTRE = {"3p5": 3.5, "4p0": 4.0}, 3.0
#: Frames whose points are reduced to their hull's corners together.
SLICE = 4096

# The published names of the scores, what each takes the norms of, with their weights, the constant that is added,
# what keeps a norm's divisor from 0, and what the movement score is made of.
EPS = 1e-10
MOVEMENT = ("energy_sum", "right_speed_mean", "left_speed_mean")
SCORES: dict[str, tuple[float, dict[str, float]]] = {
    "polar_extremity_score": (0.0, dict.fromkeys(["right_radius_max", "right_frac_radius_over_3p5", "left_radius_max", "left_frac_radius_over_3p5"], 1 / 4)),
    "separation_extremity_score": (0.0, dict.fromkeys(["distance_max", "frac_distance_over_3p5"], 1 / 2)),
    "cog_extremity_score": (0.0, dict.fromkeys(["right_cog_distance_max", "right_frac_cog_far", "left_cog_distance_max", "left_frac_cog_far"], 1 / 4)),
    "velocity_intensity_score": (0.0, dict.fromkeys(["right_speed_mean", "right_frac_fast", "left_speed_mean", "left_frac_fast"], 1 / 4)),
    "acceleration_intensity_score": (0.0, dict.fromkeys([f"{h}_accel_{k}" for h in HANDS for k in ("mean", "iqr", "sign_changes")], 0.33 / 2)),
    "energy_intensity_score": (0.0, dict.fromkeys(["energy_sum", "energy_max"], 1 / 2)),
    "coordination_score": (0.0, dict.fromkeys(["coordination_mean", "coordination_max", "frac_coordinated"], 1 / 3)),
    "symmetry_score": (1.0, dict.fromkeys(["symmetry_y_mean", "symmetry_x_mean"], -1 / 2)),
    "zone_diversity_score": (0.0, dict.fromkeys(["right_zone_entropy", "left_zone_entropy"], 1 / 2)),
    "quadrant_diversity_score": (0.0, dict.fromkeys(["right_quadrant_entropy", "left_quadrant_entropy"], 1 / 2)),
    "trajectory_complexity_score": (0.0, dict.fromkeys([f"{h}_{k}" for h in HANDS for k in ("path_ratio", "hull_area", "ellipse_area", "velocity_sign_changes")], 1 / 8)),
    "time_to_extreme_score": (2 / 3, {"right_frames_to_far": -1 / 6, "left_frames_to_far": -1 / 6, "right_frames_to_peak": -1 / 3}),
    "velocity_trend_score": (0.0, dict.fromkeys(["right_speed_early", "right_speed_late", "left_speed_early", "left_speed_late"], 1 / 4)),
}
GLOBAL_SCORES: dict[str, tuple[float, dict[str, float]]] = {
    "global_ext_intensity_score": (0.0, dict.fromkeys(["polar_extremity_score", "separation_extremity_score", "velocity_intensity_score", "acceleration_intensity_score", "energy_intensity_score"], 1 / 5)),
    "global_complexity_coordination_score": (0.0, dict.fromkeys(["trajectory_complexity_score", "zone_diversity_score", "coordination_score", "symmetry_score"], 1 / 4)),
    "global_temporal_dynamics_score": (0.0, dict.fromkeys(["time_to_extreme_score", "velocity_trend_score", "frac_near_centre"], 1 / 3)),
}
# End of the fixed values.


def gradient(v: Column, dt: float) -> Column:
    """Central differences inside, plain ones at the ends; null for a single row."""
    w = W.partitionBy("id").orderBy("frame")
    a, b = F.lag(v).over(w), F.lead(v).over(w)
    return F.when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2) / dt


def smooth(hands: DataFrame, window: int = 7, degree: int = 2) -> DataFrame:
    """Each coordinate replaced by the value of a polynomial fitted to the ``window`` rows around it, whatever gaps lie between.

    Near a clip's ends the fit is that of its first or last rows.  A shorter clip takes the greatest odd window that it fills; one
    of fewer than three rows stays as it is.  A null in the window gives null.
    """
    if window < 3 or window % 2 == 0 or degree < 0:
        raise ValueError(f"window must be odd and at least 3 and degree not negative, got {window} and {degree}")
    w = W.partitionBy("id").orderBy("frame")
    around = w.rowsBetween(1 - window, window - 1)
    weights = {}
    for size in range(3, window + 1, 2):
        powers = np.vander(np.arange(size), min(degree, size - 1) + 1)
        weights[size] = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in powers @ np.linalg.pinv(powers)])
    size = F.least(F.lit(window), F.col("_n") - (F.col("_n") % 2 == 0).cast("int"))
    d = hands.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id"))).withColumn("_size", size.cast("int"))
    d = d.withColumn("_start", F.greatest(F.lit(0), F.least(F.col("_i") - F.floor((F.col("_size") - 1) / 2), F.col("_n") - F.col("_size"))).cast("int"))
    row = F.element_at(reduce(lambda c, kv: c.when(F.col("_size") == kv[0], kv[1]), list(weights.items())[1:], F.when(F.col("_size") == 3, weights[3])), F.col("_i") - F.col("_start") + 1)
    names = [f"{h}_{a}" for h in HANDS for a in "xy"]
    d = d.withColumn("_w", row).withColumns({f"_{c}": F.collect_list(F.struct(c)).over(around) for c in names})
    first = F.col("_start") - F.greatest(F.lit(0), F.col("_i") - (window - 1)) + 1
    fitted = lambda c: F.aggregate(F.zip_with(F.col("_w"), F.slice(F.col(f"_{c}"), first, F.col("_size")), lambda k, p: k * p[c]), F.lit(0.0), lambda a, x: a + x)
    return d.withColumns({c: F.when(F.col("_n") < 3, F.col(c)).otherwise(fitted(c)) for c in names}).select(hands.columns)


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Every floating-point column rounded."""
    return df.withColumns({c: F.round(c, decimals) for c, t in df.dtypes if t in ("double", "float")})


def frame_features(hands: DataFrame, fps: float = 30.0) -> DataFrame:
    dt, w, d = 1 / fps, W.partitionBy("id").orderBy("frame"), hands
    rx, ry, lx, ly = (F.col(f"{h}_{a}") for h in HANDS for a in "xy")
    d = d.withColumns({
        "distance": norm(rx - lx, ry - ly), "distance_manhattan": F.abs(rx - lx) + F.abs(ry - ly), "angle_deg": F.degrees(F.atan2(ly - ry, lx - rx)),
        "symmetry_y": F.abs(ry + ly), "symmetry_x": F.abs(rx + lx), "centroid_x": (rx + lx) / 2, "centroid_y": (ry + ly) / 2, "area_box": F.abs(rx - lx) * F.abs(ry - ly),
    }).withColumn("area_circle", F.pi() * F.pow(F.col("distance") / 2, 2))
    for h in HANDS:
        x, y = F.col(f"{h}_x"), F.col(f"{h}_y")
        column = F.when(x < -ZONE, 0).when(x > ZONE, 2).otherwise(1)
        row = F.when(y < -ZONE, 7).when(y > ZONE, 1).otherwise(4)
        d = d.withColumns({
            f"{h}_radius": norm(x, y), f"{h}_angle_deg": F.degrees(F.atan2(y, x)), f"{h}_above": y < 0, f"{h}_side": F.signum(x),
            f"{h}_quadrant": F.when((x >= 0) & (y >= 0), 1).when((x < 0) & (y >= 0), 2).when((x < 0) & (y < 0), 3).when((x >= 0) & (y < 0), 4),
            f"{h}_zone": F.coalesce(F.when(x.isNotNull() & y.isNotNull(), row + column), F.lit(5)),
            f"{h}_vx": gradient(x, dt), f"{h}_vy": gradient(y, dt), f"{h}_step": F.coalesce(norm(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0)),
        })
        d = d.withColumns({f"{h}_speed": norm(F.col(f"{h}_vx"), F.col(f"{h}_vy")), f"{h}_ax": gradient(F.col(f"{h}_vx"), dt), f"{h}_ay": gradient(F.col(f"{h}_vy"), dt)})
        d = d.withColumns({f"{h}_accel": norm(F.col(f"{h}_ax"), F.col(f"{h}_ay")), f"{h}_energy": F.pow(f"{h}_speed", F.lit(2)) / 2})
    rv, lv = F.col("right_speed"), F.col("left_speed")
    return d.withColumns({"energy": F.col("right_energy") + F.col("left_energy"), "coordination": rv * lv / (F.sqrt(rv * rv + lv * lv) + 1e-6)})


def centre_of_gravity(frames: DataFrame) -> DataFrame:
    """Add each hand's distance and angle from the clip's mean position."""
    # In the order of frames, so that the mean's last bit does not depend on where rows come from.
    w = W.partitionBy("id").orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for h in HANDS:
        x, y = F.col(f"{h}_x") - F.avg(f"{h}_x").over(w), F.col(f"{h}_y") - F.avg(f"{h}_y").over(w)
        frames = frames.withColumns({f"{h}_cog_distance": norm(x, y), f"{h}_cog_angle": F.atan2(y, x)})
    return frames


def _named(prefix: str, v: str, kinds: str) -> list[Column]:
    f = {
        "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "std": F.stddev_samp, "sum": F.sum,
        "iqr": lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25)), "range": lambda c: F.max(c) - F.min(c),
    }
    return [f[k](F.col(v)).alias(f"{prefix}_{k}") for k in kinds.split()]


def sequence_features(frames: DataFrame) -> DataFrame:
    """One row for each clip of ``centre_of_gravity(frame_features(...))``.  A zero counts as a sign here."""
    w = W.partitionBy("id").orderBy("frame")
    changed = lambda v: (F.signum(v) != F.lag(F.signum(v)).over(w)).cast("int")
    d, flips = frames, [f"{h}_{v}" for h in HANDS for v in ("vx", "vy", "ax", "ay", "accel")]
    d = d.withColumns({f"_{c}": changed(F.coalesce(c, F.lit(0.0))) for c in flips})
    d = d.withColumn("centroid_radius", norm(F.col("centroid_x"), F.col("centroid_y")))
    aggs: list[Column] = []
    for h in HANDS:
        aggs += _named(f"{h}_radius", f"{h}_radius", "min max mean median std") + _named(f"{h}_x", f"{h}_x", "range") + _named(f"{h}_y", f"{h}_y", "range")
        aggs += _named(f"{h}_speed", f"{h}_speed", "min max mean median std iqr") + _named(f"{h}_accel", f"{h}_accel", "min max mean median std iqr")
        aggs += _named(f"{h}_step", f"{h}_step", "sum") + _named(f"{h}_energy", f"{h}_energy", "sum max") + _named(f"{h}_cog_distance", f"{h}_cog_distance", "max mean median std")
        aggs.append(F.avg((F.col(f"{h}_speed") > FAST).cast("int")).alias(f"{h}_frac_fast"))
        aggs.append((-F.max(F.struct(f"{h}_speed", -F.col("frame")))["col2"] - F.min("frame")).alias(f"{h}_frames_to_peak"))
        aggs.append((F.min(F.when(F.col(f"{h}_radius") > 3.5, F.col("frame"))) - F.min("frame")).alias(f"{h}_frames_to_far"))
        x, y = F.col(f"{h}_x"), F.col(f"{h}_y")
        a, c, b = F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
        root = F.sqrt(F.pow((a - c) / 2, F.lit(2)) + b * b)
        aggs.append((F.pi() * F.sqrt(F.greatest((a + c) / 2 + root, F.lit(0.0)) + 1e-8) * F.sqrt(F.greatest((a + c) / 2 - root, F.lit(0.0)) + 1e-8)).alias(f"{h}_ellipse_area"))
    aggs += [F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(f"{c}_sign_changes") for c in flips]
    aggs += _named("angle_deg", "angle_deg", "min max mean median std range") + _named("energy", "energy", "sum max") + _named("coordination", "coordination", "mean max")
    aggs += _named("distance", "distance", "mean median max std") + _named("area_box", "area_box", "max mean") + _named("area_circle", "area_circle", "max mean")
    aggs += _named("centroid_radius", "centroid_radius", "max mean iqr") + [F.avg((F.col("coordination") > COORDINATED).cast("int")).alias("frac_coordinated"), F.avg((F.col("centroid_radius") > 3.0).cast("int")).alias("frac_centroid_far")]
    out = d.groupBy("id").agg(*aggs)
    return out.withColumn("both_step_sum", F.col("right_step_sum") + F.col("left_step_sum"))


def extra_features(frames: DataFrame) -> DataFrame:
    """More of each clip of ``centre_of_gravity(frame_features(...))``: directions, far frames, extents, early and late speeds.

    Early is the first tenth of the frames, rounded down but at least one; late starts at nine tenths, rounded up.  The hull is that
    of the hulls of slices, so no row holds more than ``SLICE`` points beside corners.
    """
    w = W.partitionBy("id")
    d = frames.withColumn("_i", F.row_number().over(w.orderBy("frame")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    early = F.col("_i") < F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    late = F.col("_i") >= F.least(F.ceil(F.col("_n") * 9 / 10), F.col("_n") - 1)
    share = lambda over: F.avg(over.cast("int"))
    aggs: list[Column] = []
    for h in HANDS:
        c = lambda v, h=h: F.col(f"{h}_{v}")
        x, y, turn = c("x"), c("y"), F.atan2(c("y"), c("x"))
        mean_sin, mean_cos = F.avg(F.sin(turn)), F.avg(F.cos(turn))
        ends = norm(F.max_by(x, "frame") - F.min_by(x, "frame"), F.max_by(y, "frame") - F.min_by(y, "frame"))
        aggs += _named(f"{h}_radius", f"{h}_radius", "iqr") + _named(f"{h}_cog_distance", f"{h}_cog_distance", "iqr")
        for name, far in FAR.items():
            aggs += [F.count_if(c("radius") > far).alias(f"{h}_n_radius_over_{name}"), share(c("radius") > far).alias(f"{h}_frac_radius_over_{name}")]
        aggs += [
            F.degrees(F.atan2(mean_sin, mean_cos)).alias(f"{h}_theta_mean"),
            F.degrees(F.sqrt(F.greatest(-2 * F.log(norm(mean_sin, mean_cos) + 1e-8), F.lit(0.0)))).alias(f"{h}_theta_std"),
            norm(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias(f"{h}_span"),
            F.when(F.count(F.lit(1)) > 1, F.sum(c("step")) / (ends + 1e-8)).alias(f"{h}_path_ratio"),
            F.count_if(c("cog_distance") > FAR_FROM_CENTRE).alias(f"{h}_n_cog_far"), share(c("cog_distance") > FAR_FROM_CENTRE).alias(f"{h}_frac_cog_far"),
            F.when(F.count(F.lit(1)) > 1, F.avg(F.when(early, c("speed")))).alias(f"{h}_speed_early"),
            F.when(F.count(F.lit(1)) > 1, F.avg(F.when(late, c("speed")))).alias(f"{h}_speed_late"),
        ]
    aggs += _named("distance", "distance", "min iqr") + _named("symmetry_x", "symmetry_x", "mean") + _named("symmetry_y", "symmetry_y", "mean")
    for name, far in FAR.items():
        aggs += [F.count_if(F.col("distance") > far).alias(f"n_distance_over_{name}"), share(F.col("distance") > far).alias(f"frac_distance_over_{name}")]
    out = d.groupBy("id").agg(*aggs).withColumn("frac_near_centre", 1 - (F.col("right_frac_radius_over_3p5") + F.col("left_frac_radius_over_3p5")) / 2)
    # Grouped by id and slice after the windows have placed the rows by id, so the slices need no second shuffle.
    points = {h: F.when(F.col(f"{h}_x").isNotNull() & F.col(f"{h}_y").isNotNull(), F.struct(F.col(f"{h}_x").alias("x"), F.col(f"{h}_y").alias("y"))) for h in HANDS}
    slices = d.groupBy("id", F.floor(F.col("_i") / SLICE).alias("_s")).agg(*[F.collect_list(points[h]).alias(h) for h in HANDS]).select("id", *[hull_corners(h).alias(h) for h in HANDS])
    hulls = slices.groupBy("id").agg(*[F.flatten(F.collect_list(h)).alias(h) for h in HANDS]).select("id", *[hull_area(h).alias(f"{h}_hull_area") for h in HANDS])
    return out.join(hulls, "id")


def quartile_bins(v: str, by: list[str]) -> tuple[Column, Column]:
    """A value's quartile (1-4, edges belong below) among the rows of its group, and whether the edges differ."""
    p = F.percentile(F.col(v), F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).over(W.partitionBy(*by))
    above = reduce(lambda a, b: a + b, [(F.col(v) > p[i]).cast("int") for i in (1, 2, 3)])
    return above + 1, reduce(lambda a, b: a & b, [p[i] < p[i + 1] for i in range(4)])


def table_quartiles(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Add ``{c}_qbin``: each value's quartile (1-4) in the whole table; null where the edges don't differ.

    The edges are exact; ``accuracy`` takes approximate ones instead, in one pass less.
    """
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    if accuracy is None:
        at = lambda c, k: F.max(F.when((F.col("column") == c) & (F.col("k") == k), F.col("value")))
        edges = exact_quantiles(df, columns, shares).agg(*[F.array(*[at(c, k) for k in range(5)]).alias(f"_e_{c}") for c in columns])
    else:
        edges = df.agg(*[F.percentile_approx(F.col(c), F.array(*[F.lit(q) for q in shares]), accuracy).alias(f"_e_{c}") for c in columns])
    x = df.join(F.broadcast(edges))
    bins = {}
    for c in columns:
        e, v = F.col(f"_e_{c}"), F.col(c)
        above = reduce(lambda a, b: a + b, [(v > e[i]).cast("int") for i in (1, 2, 3)])
        bins[f"{c}_qbin"] = F.when(reduce(lambda a, b: a & b, [e[i] < e[i + 1] for i in range(4)]), above + 1)
    return x.withColumns(bins).drop(*[f"_e_{c}" for c in columns])


def fixed_bins(v: Column, edges: list[float]) -> Column:
    """bin1, bin2, ... by right-closed edges, the lowest edge belonging to bin1; null outside."""
    out = F.when(v.between(edges[0], edges[1]), F.lit("bin1"))
    for k in range(1, len(edges) - 1):
        out = out.when((v > edges[k]) & (v <= edges[k + 1]), F.lit(f"bin{k + 1}"))
    return out


def quartile_histograms(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each clip's frames by the quartile of each column; equal edges give zeros."""
    d = frames
    for c in columns:
        q, ok = quartile_bins(c, ["id"])
        d = d.withColumn(f"_{c}", F.when(ok, q))
    return d.groupBy("id").agg(*[F.count_if(F.col(f"_{c}") == k).alias(f"{c}_q{k}") for c in columns for k in (1, 2, 3, 4)])


def entropy(shares: list[Column]) -> Column:
    return -reduce(lambda a, b: a + b, [F.when(p > 0, p * F.log(p + 1e-12)).otherwise(0.0) for p in shares])


def first_greatest(shares: list[Column]) -> Column:
    top = F.greatest(*shares)
    return F.coalesce(*[F.when(p == top, F.lit(k)) for k, p in enumerate(shares, 1)])


def zone_histograms(frames: DataFrame) -> DataFrame:
    """Shares of each clip's frames by quadrant and zone, and their entropies."""
    aggs = [F.avg((F.coalesce(F.col(f"{h}_{kind}"), F.lit(0)) == k).cast("int")).alias(f"{h}_{kind}_{k}") for h in HANDS for kind, n in (("quadrant", 4), ("zone", 9)) for k in range(1, n + 1)]
    out = frames.groupBy("id").agg(*aggs)
    return out.withColumns({f"{h}_{kind}_entropy": entropy([F.col(f"{h}_{kind}_{k}") for k in range(1, n + 1)]) for h in HANDS for kind, n in (("quadrant", 4), ("zone", 9))})


def polar_histograms(frames: DataFrame) -> DataFrame:
    """Rings (quartiles of the distance) and sectors of 90 degrees around the clip's centre, with what sums them up."""
    d = frames
    for h in HANDS:
        q, ok = quartile_bins(f"{h}_cog_distance", ["id"])
        deg = F.pmod(F.degrees(f"{h}_cog_angle"), F.lit(360.0))
        sector = F.when((deg <= 45) | (deg > 315), 1).when(deg <= 135, 2).when(deg <= 225, 3).otherwise(4)
        d = d.withColumns({f"_{h}_ring": F.when(ok, q).otherwise(1), f"_{h}_sector": sector})
    shares = {(h, kind): [F.col(f"{h}_{kind}_{k}") for k in (1, 2, 3, 4)] for h in HANDS for kind in ("ring", "sector")}
    out = d.groupBy("id").agg(*[F.avg((F.col(f"_{h}_{kind}") == k).cast("int")).alias(f"{h}_{kind}_{k}") for h, kind in shares for k in (1, 2, 3, 4)])
    for h in HANDS:
        ring, sector = shares[h, "ring"], shares[h, "sector"]
        out = out.withColumns({
            f"{h}_dominant_ring": first_greatest(ring), f"{h}_dominant_sector": first_greatest(sector), f"{h}_ring_entropy": entropy(ring), f"{h}_sector_entropy": entropy(sector),
            f"{h}_radial_preference": reduce(lambda a, b: a + b, [p * k for k, p in enumerate(ring, 1)]), f"{h}_angular_spread": reduce(lambda a, b: a + b, [(p > 0.1).cast("int") for p in sector]),
        })
    return out


def _edges(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the least and greatest value of each column in the whole table: one aggregate, a row that is joined back."""
    return df.join(F.broadcast(df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])))


def _without_edges(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_lo_", "_hi_"))])


def _norms(columns: list[str]) -> dict[str, Column]:
    return {f"{c}_norm": (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + EPS) for c in columns}


def _movement() -> dict[str, Column]:
    return {"movement_score": reduce(lambda a, b: a + b, [F.col(c) / (F.col(f"_hi_{c}") + EPS) for c in MOVEMENT]) / len(MOVEMENT)}


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column set between its least and greatest value of the whole table (0 without spread)."""
    return _without_edges(_edges(df, columns).withColumns(_norms(columns)))


def movement_score(clips: DataFrame) -> DataFrame:
    """``sequence_features`` with the mean of energy and speeds, each as a share of the table's greatest; null if one of them is."""
    return _without_edges(_edges(clips, list(MOVEMENT)).withColumns(_movement()))


def score(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The mean of the columns' norms."""
    return minmax(df, columns).withColumn(name, reduce(lambda a, b: a + b, [F.col(f"{c}_norm") for c in columns]) / len(columns))


def _weighed(df: DataFrame, scores: dict[str, tuple[float, dict[str, float]]], movement: bool = False) -> DataFrame:
    inputs = list(dict.fromkeys(c for _, parts in scores.values() for c in parts))
    x = _edges(df, list(dict.fromkeys([*inputs, *(MOVEMENT if movement else ())]))).withColumns(_norms(inputs) | (_movement() if movement else {}))
    weighed = {name: reduce(lambda a, b: a + b, [F.col(f"{c}_norm") * k for c, k in parts.items()], F.lit(constant)) for name, (constant, parts) in scores.items()}
    return _without_edges(x).withColumns(weighed)


def composite_scores(frames: DataFrame) -> DataFrame:
    """All features of each clip with the norms over the table and the scores made of them; a norm without value makes its scores null.

    The clip's features are rounded to six decimals before, as published; ``rounded`` gives the delivered form of the rest.
    """
    x = rounded(sequence_features(frames)).join(extra_features(frames), "id").join(zone_histograms(frames), "id")
    x = x.withColumns({f"{h}_velocity_sign_changes": F.col(f"{h}_vx_sign_changes") + F.col(f"{h}_vy_sign_changes") for h in HANDS})
    return _weighed(_weighed(x, SCORES, movement=True), GLOBAL_SCORES)


def rank_quartiles(df: DataFrame, v: str, by: str) -> DataFrame:
    """Quartile of the rank of ``v`` within each label, ties by id; all 1 in a label of fewer than four rows."""
    w = W.partitionBy(by)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(v, "id")).cast("double")).withColumn("_n", F.count(F.lit(1)).over(w))
    edge = lambda q: 1 + (F.col("_n") - 1) * q
    q = reduce(lambda a, b: a + b, [(F.col("_r") > edge(x)).cast("int") for x in (0.25, 0.5, 0.75)]) + 1
    return d.withColumn("quartile", F.when(F.col("_n") < 4, 1).otherwise(q)).drop("_r", "_n")
