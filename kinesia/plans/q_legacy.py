"""Queries of the baseline features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.operators import legacy as L
from kinesia.plans.adapters import WIDE_SQL, rounded, rounded_sql, table, wide
from kinesia.plans.registry import register

FPS = 2.0


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("id", "frame", (F.col("nx_4") - 3).alias("right_x"), (F.col("ny_4") - 5).alias("right_y"), F.col("nx_7").alias("left_x"), (F.col("ny_7") - 5).alias("left_y"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.centre_of_gravity(L.frame_features(hands(spark, sf_dir), FPS))


def _gradient(v: str) -> str:
    return f"(CASE WHEN lag({v}) OVER w IS NULL THEN lead({v}) OVER w - {v} WHEN lead({v}) OVER w IS NULL THEN {v} - lag({v}) OVER w ELSE (lead({v}) OVER w - lag({v}) OVER w) / 2 END) * 2.0"


_WINDOW = "WINDOW w AS (PARTITION BY id ORDER BY frame)"
_HAND = lambda h: f"""sqrt({h}_x * {h}_x + {h}_y * {h}_y) AS {h}_radius, degrees(atan2({h}_y, {h}_x)) AS {h}_angle_deg, {h}_y < 0 AS {h}_above, sign({h}_x)::DOUBLE AS {h}_side,
  CASE WHEN {h}_x >= 0 AND {h}_y >= 0 THEN 1 WHEN {h}_x < 0 AND {h}_y >= 0 THEN 2 WHEN {h}_x < 0 THEN 3 ELSE 4 END AS {h}_quadrant,
  CASE WHEN {h}_y < -0.5 THEN 7 WHEN {h}_y > 0.5 THEN 1 ELSE 4 END + CASE WHEN {h}_x < -0.5 THEN 0 WHEN {h}_x > 0.5 THEN 2 ELSE 1 END AS {h}_zone,
  {_gradient(f"{h}_x")} AS {h}_vx, {_gradient(f"{h}_y")} AS {h}_vy, coalesce(sqrt(pow({h}_x - lag({h}_x) OVER w, 2) + pow({h}_y - lag({h}_y) OVER w, 2)), 0) AS {h}_step,
  sqrt(pow({h}_x - avg({h}_x) OVER (PARTITION BY id), 2) + pow({h}_y - avg({h}_y) OVER (PARTITION BY id), 2)) AS {h}_cog_distance, atan2({h}_y - avg({h}_y) OVER (PARTITION BY id), {h}_x - avg({h}_x) OVER (PARTITION BY id)) AS {h}_cog_angle"""  # noqa: E731
LEGACY_SQL = f"""{WIDE_SQL}, hands AS (SELECT id, frame, nx_4 - 3 AS right_x, ny_4 - 5 AS right_y, nx_7 AS left_x, ny_7 - 5 AS left_y FROM wide),
v AS (SELECT *, sqrt(pow(right_x - left_x, 2) + pow(right_y - left_y, 2)) AS distance, abs(right_x - left_x) + abs(right_y - left_y) AS distance_manhattan, degrees(atan2(left_y - right_y, left_x - right_x)) AS angle_deg,
  abs(right_y + left_y) AS symmetry_y, abs(right_x + left_x) AS symmetry_x, (right_x + left_x) / 2 AS centroid_x, (right_y + left_y) / 2 AS centroid_y, abs(right_x - left_x) * abs(right_y - left_y) AS area_box,
  {_HAND("right")}, {_HAND("left")} FROM hands {_WINDOW}),
s AS (SELECT *, pi() * pow(distance / 2, 2) AS area_circle, {", ".join(f"sqrt({h}_vx * {h}_vx + {h}_vy * {h}_vy) AS {h}_speed, {_gradient(f'{h}_vx')} AS {h}_ax, {_gradient(f'{h}_vy')} AS {h}_ay" for h in L.HANDS)} FROM v {_WINDOW}),
frames AS (SELECT *, {", ".join(f"sqrt({h}_ax * {h}_ax + {h}_ay * {h}_ay) AS {h}_accel, {h}_speed * {h}_speed / 2 AS {h}_energy" for h in L.HANDS)}, (right_speed * right_speed + left_speed * left_speed) / 2 AS energy,
  right_speed * left_speed / (sqrt(right_speed * right_speed + left_speed * left_speed) + 1e-6) AS coordination FROM s)"""

_DOUBLES = "distance distance_manhattan angle_deg symmetry_y symmetry_x area_box area_circle energy coordination " + " ".join(f"{h}_{c}" for h in L.HANDS for c in ("radius", "angle_deg", "side", "vx", "vy", "speed", "ax", "ay", "accel", "energy", "step", "cog_distance", "cog_angle"))
_PLAIN = [f"{h}_{c}" for h in L.HANDS for c in ("above", "quadrant", "zone")]


@register("legacy_frame", f"WITH {LEGACY_SQL} SELECT id, frame, {', '.join(_PLAIN)}, {rounded_sql(_DOUBLES, 5)} FROM frames")
def legacy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames(spark, sf_dir).select("id", "frame", *_PLAIN, *_DOUBLES.split()), 5)


def _agg(prefix: str, kinds: str) -> str:
    f = {"min": "min({})", "max": "max({})", "mean": "avg({})", "median": "median({})", "std": "stddev_samp({})", "sum": "sum({})", "iqr": "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)", "range": "max({0}) - min({0})"}
    return ", ".join(f"{f[k].format(prefix)} AS {prefix}_{k}" for k in kinds.split())


_SEQ = [("{}_radius", "min max mean median std"), ("{}_x", "range"), ("{}_y", "range"), ("{}_speed", "min max mean median std iqr"), ("{}_accel", "min max mean median std iqr"), ("{}_step", "sum"), ("{}_energy", "sum max"), ("{}_cog_distance", "max mean median std")]
_BOTH = [("angle_deg", "min max mean median std range"), ("energy", "sum max"), ("coordination", "mean max"), ("distance", "mean median max std"), ("area_box", "max mean"), ("area_circle", "max mean"), ("centroid_radius", "max mean iqr")]
_ALL = [(p.format(h), k) for h in L.HANDS for p, k in _SEQ] + _BOTH
_AGG_DOUBLES = [f"{p}_{k}" for p, ks in _ALL for k in ks.split()] + [f"{h}_{c}" for h in L.HANDS for c in ("frac_fast", "ellipse_area")] + ["frac_coordinated", "frac_centroid_far", "both_step_sum"]
_FLIPS = [f"{h}_{v}" for h in L.HANDS for v in ("vx", "vy", "ax", "ay", "accel")]
_AGG_COUNTS = [f"{c}_sign_changes" for c in _FLIPS] + [f"{h}_frames_to_{c}" for h in L.HANDS for c in ("peak", "far")]
AGG_SQL = f"""{LEGACY_SQL}, g AS (SELECT *, sqrt(centroid_x * centroid_x + centroid_y * centroid_y) AS centroid_radius, {", ".join(f"(sign({c}) <> lag(sign({c})) OVER w)::INT AS f_{c}" for c in _FLIPS)} FROM frames {_WINDOW}),
agg AS (SELECT id, {", ".join(_agg(p, k) for p, k in _ALL)}, {", ".join(f"avg(({h}_speed > 2)::INT) AS {h}_frac_fast, pi() * sqrt(greatest((var_samp({h}_x) + var_samp({h}_y)) / 2 + sqrt(pow((var_samp({h}_x) - var_samp({h}_y)) / 2, 2) + pow(covar_samp({h}_x, {h}_y), 2)), 0) + 1e-8) * sqrt(greatest((var_samp({h}_x) + var_samp({h}_y)) / 2 - sqrt(pow((var_samp({h}_x) - var_samp({h}_y)) / 2, 2) + pow(covar_samp({h}_x, {h}_y), 2)), 0) + 1e-8) AS {h}_ellipse_area, arg_max(frame, struct_pack(a := {h}_speed, b := -frame)) - min(frame) AS {h}_frames_to_peak, min(frame) FILTER (WHERE {h}_radius > 3.5) - min(frame) AS {h}_frames_to_far" for h in L.HANDS)},
  avg((coordination > 0.8)::INT) AS frac_coordinated, avg((centroid_radius > 3)::INT) AS frac_centroid_far, sum(right_step) + sum(left_step) AS both_step_sum, {", ".join(f"coalesce(sum(f_{c}), 0)::BIGINT AS {c}_sign_changes" for c in _FLIPS)} FROM g GROUP BY id)"""


@register("legacy_agg", f"WITH {AGG_SQL} SELECT id, {', '.join(_AGG_COUNTS)}, {rounded_sql(' '.join(_AGG_DOUBLES), 4)} FROM agg")
def legacy_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.sequence_features(frames(spark, sf_dir)).select("id", *_AGG_COUNTS, *_AGG_DOUBLES), 4)


_XY = [f"{h}_{a}" for h in L.HANDS for a in "xy"]
_fit = lambda c: f"(y0_{c} * (s2 * s4 - s3 * s3) - s1 * (y1_{c} * s4 - y2_{c} * s3) + s2 * (y1_{c} * s3 - y2_{c} * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"


@register("legacy_smooth", f"""WITH {WIDE_SQL}, hands AS (SELECT id, frame, nx_4 - 3 AS right_x, ny_4 - 5 AS right_y, nx_7 AS left_x, ny_7 - 5 AS left_y FROM wide),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM hands), z AS (SELECT *, least(7, n - (n % 2 = 0)::INT) AS size FROM o), b AS (SELECT *, greatest(0, least(i - (size - 1) // 2, n - size)) AS s FROM z),
q AS (SELECT id, frame, n, i, unnest(range(s, s + size)) AS j, {", ".join(f"{c} AS own_{c}" for c in _XY)} FROM b),
f AS (SELECT q.id, q.frame, any_value(q.n) AS n, {", ".join(f"any_value(own_{c}) AS own_{c}, sum({c}) AS y0_{c}, sum({c} * (j - q.i)) AS y1_{c}, sum({c} * pow(j - q.i, 2)) AS y2_{c}" for c in _XY)}, {", ".join(f"sum(pow(j - q.i, {k})) AS s{k}" for k in range(5))} FROM q JOIN o ON o.id = q.id AND o.i = q.j GROUP BY q.id, q.frame),
x AS (SELECT id, frame, {", ".join(f"CASE WHEN n < 3 THEN own_{c} ELSE {_fit(c)} END AS {c}" for c in _XY)} FROM f) SELECT id, frame, {rounded_sql(" ".join(_XY))} FROM x""")
def legacy_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.smooth(hands(spark, sf_dir)))


def _extra_sql() -> str:
    out = []
    for h in L.HANDS:
        turn = f"atan2({h}_y, {h}_x)"
        size = f"sqrt(pow(avg(sin({turn})), 2) + pow(avg(cos({turn})), 2))"
        for v in ("radius", "cog_distance"):
            out.append(f"quantile_cont({h}_{v}, 0.75) - quantile_cont({h}_{v}, 0.25) AS {h}_{v}_iqr")
        for name, far in (("3p5", 3.5), ("4p0", 4.0)):
            out.append(f"count(*) FILTER (WHERE {h}_radius > {far}) AS {h}_n_radius_over_{name}, avg(({h}_radius > {far})::INT) AS {h}_frac_radius_over_{name}")
        out.append(f"""degrees(atan2(avg(sin({turn})), avg(cos({turn})))) AS {h}_theta_mean, degrees(sqrt(greatest(-2 * ln({size} + 1e-8), 0))) AS {h}_theta_std,
  sqrt(pow(max({h}_x) - min({h}_x), 2) + pow(max({h}_y) - min({h}_y), 2)) AS {h}_span, count(*) FILTER (WHERE {h}_cog_distance > 3) AS {h}_n_cog_far, avg(({h}_cog_distance > 3)::INT) AS {h}_frac_cog_far,
  CASE WHEN count(*) > 1 THEN sum({h}_step) / (sqrt(pow(arg_max({h}_x, frame) - arg_min({h}_x, frame), 2) + pow(arg_max({h}_y, frame) - arg_min({h}_y, frame), 2)) + 1e-8) END AS {h}_path_ratio,
  CASE WHEN count(*) > 1 THEN avg({h}_speed) FILTER (WHERE i < greatest(1, n // 10)) END AS {h}_speed_early, CASE WHEN count(*) > 1 THEN avg({h}_speed) FILTER (WHERE i >= least((n * 9 + 9) // 10, n - 1)) END AS {h}_speed_late""")
    for name, far in (("3p5", 3.5), ("4p0", 4.0)):
        out.append(f"count(*) FILTER (WHERE distance > {far}) AS n_distance_over_{name}, avg((distance > {far})::INT) AS frac_distance_over_{name}")
    out.append("min(distance) AS distance_min, quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25) AS distance_iqr, avg(symmetry_x) AS symmetry_x_mean, avg(symmetry_y) AS symmetry_y_mean")
    points = " UNION ALL ".join(f"SELECT id, '{h}' AS hand, {h}_x AS x, {h}_y AS y FROM frames" for h in L.HANDS)
    right = "(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)"
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM frames),
extra0 AS (SELECT id, {", ".join(out)} FROM placed GROUP BY id), spots AS (SELECT DISTINCT * FROM ({points})),
sides AS (SELECT a.id, a.hand, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM spots a JOIN spots b ON a.id = b.id AND a.hand = b.hand AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM spots c WHERE c.id = a.id AND c.hand = a.hand AND ({right} < -1e-12 OR (abs({right}) <= 1e-12 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 1e-12)))),
hulls AS (SELECT id, {", ".join(f"coalesce(0.5 * abs(sum(ax * by_ - bx * ay) FILTER (WHERE hand = '{h}')), 0) AS {h}_hull_area" for h in L.HANDS)} FROM sides GROUP BY id),
extra AS (SELECT extra0.*, {", ".join(f"coalesce({h}_hull_area, 0) AS {h}_hull_area" for h in L.HANDS)}, 1 - (right_frac_radius_over_3p5 + left_frac_radius_over_3p5) / 2 AS frac_near_centre FROM extra0 LEFT JOIN hulls USING (id))"""


_EXTRA_COUNTS = [f"{h}_n_{c}" for h in L.HANDS for c in ("radius_over_3p5", "radius_over_4p0", "cog_far")] + ["n_distance_over_3p5", "n_distance_over_4p0"]
_EXTRA_DOUBLES = [f"{h}_{c}" for h in L.HANDS for c in "radius_iqr cog_distance_iqr frac_radius_over_3p5 frac_radius_over_4p0 theta_mean theta_std span path_ratio frac_cog_far speed_early speed_late hull_area".split()]
_EXTRA_DOUBLES += "distance_min distance_iqr symmetry_x_mean symmetry_y_mean frac_distance_over_3p5 frac_distance_over_4p0 frac_near_centre".split()


@register("legacy_extra", f"WITH {LEGACY_SQL}, {_extra_sql()} SELECT id, {', '.join(_EXTRA_COUNTS)}, {rounded_sql(' '.join(_EXTRA_DOUBLES), 4)} FROM extra")
def legacy_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.extra_features(frames(spark, sf_dir)).select("id", *_EXTRA_COUNTS, *_EXTRA_DOUBLES), 4)


_HIST = ["right_speed", "left_speed", "right_accel", "left_accel"]
_edges = lambda c: f"quantile_cont({c}, [0.0, 0.25, 0.5, 0.75, 1.0]) OVER (PARTITION BY id) AS e_{c}"
_ok = lambda c: " AND ".join(f"e_{c}[{i}] < e_{c}[{i + 1}]" for i in range(1, 5))
_bin = lambda c: f"1 + ({c} > e_{c}[2])::INT + ({c} > e_{c}[3])::INT + ({c} > e_{c}[4])::INT"


@register("qcut_hist", f"WITH {LEGACY_SQL}, e AS (SELECT *, {', '.join(_edges(c) for c in _HIST)} FROM frames), b AS (SELECT id, {', '.join(f'CASE WHEN {_ok(c)} THEN {_bin(c)} END AS b_{c}' for c in _HIST)} FROM e) SELECT id, {', '.join(f'count(*) FILTER (WHERE b_{c} = {k}) AS {c}_q{k}' for c in _HIST for k in (1, 2, 3, 4))} FROM b GROUP BY id")
def qcut_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quartile_histograms(frames(spark, sf_dir), _HIST)


_entropy = lambda names: "-(" + " + ".join(f"CASE WHEN {n} > 0 THEN {n} * ln({n} + 1e-12) ELSE 0 END" for n in names) + ")"
_ZONES = [(h, kind, n) for h in L.HANDS for kind, n in (("quadrant", 4), ("zone", 9))]
_ZONE_NAMES = " ".join(f"{h}_{kind}_{k}" for h, kind, n in _ZONES for k in range(1, n + 1)) + " " + " ".join(f"{h}_{kind}_entropy" for h, kind, _ in _ZONES)


@register("zone_hist", f"WITH {LEGACY_SQL}, z AS (SELECT id, {', '.join(f'avg(({h}_{kind} = {k})::INT) AS {h}_{kind}_{k}' for h, kind, n in _ZONES for k in range(1, n + 1))} FROM frames GROUP BY id), x AS (SELECT *, {', '.join(f'{_entropy([f'{h}_{kind}_{k}' for k in range(1, n + 1)])} AS {h}_{kind}_entropy' for h, kind, n in _ZONES)} FROM z) SELECT id, {rounded_sql(_ZONE_NAMES)} FROM x")
def zone_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.zone_histograms(frames(spark, sf_dir)))


def _scores_sql() -> str:
    zones = f"""zones0 AS (SELECT id, {", ".join(f"avg(({h}_{kind} = {k})::INT) AS {h}_{kind}_{k}" for h, kind, n in _ZONES for k in range(1, n + 1))} FROM frames GROUP BY id),
zones AS (SELECT id, {", ".join(f"{_entropy([f'{h}_{kind}_{k}' for k in range(1, n + 1)])} AS {h}_{kind}_entropy" for h, kind, n in _ZONES)} FROM zones0)"""
    norm = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-10)"
    weighed = lambda scores: ", ".join(f"{constant!r}::DOUBLE + " + " + ".join(f"({k!r}::DOUBLE) * ({norm(c)})" for c, k in parts.items()) + f" AS {name}" for name, (constant, parts) in scores.items())
    return f"""WITH {AGG_SQL}, {_extra_sql()}, {zones},
agg6 AS (SELECT * REPLACE ({", ".join(f"round({c}, 6) AS {c}" for c in _AGG_DOUBLES)}) FROM agg),
clip AS MATERIALIZED (SELECT *, {", ".join(f"{h}_vx_sign_changes + {h}_vy_sign_changes AS {h}_velocity_sign_changes" for h in L.HANDS)} FROM agg6 JOIN extra USING (id) JOIN zones USING (id)),
one AS MATERIALIZED (SELECT id, frac_near_centre, {weighed(L.SCORES)} FROM clip), two AS (SELECT *, {weighed(L.GLOBAL_SCORES)} FROM one) SELECT id, {rounded_sql(" ".join([*L.SCORES, *L.GLOBAL_SCORES]))} FROM two"""


@register("legacy_scores", _scores_sql())
def legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.composite_scores(frames(spark, sf_dir)).select("id", *L.SCORES, *L.GLOBAL_SCORES))


_POLAR = [f"{h}_{kind}_{k}" for h in L.HANDS for kind in ("ring", "sector") for k in (1, 2, 3, 4)]


def _polar_sql() -> str:
    bins, sums = [], []
    for h in L.HANDS:
        c, a = f"{h}_cog_distance", f"(degrees({h}_cog_angle) + CASE WHEN {h}_cog_angle < 0 THEN 360 ELSE 0 END)"
        bins.append(f"CASE WHEN {_ok(c)} THEN {_bin(c)} ELSE 1 END AS {h}_ring, CASE WHEN {a} <= 45 OR {a} > 315 THEN 1 WHEN {a} <= 135 THEN 2 WHEN {a} <= 225 THEN 3 ELSE 4 END AS {h}_sector")
        for kind in ("ring", "sector"):
            n = [f"{h}_{kind}_{k}" for k in (1, 2, 3, 4)]
            sums.append(f"list_position([{', '.join(n)}], greatest({', '.join(n)}))::INT AS {h}_dominant_{kind}, {_entropy(n)} AS {h}_{kind}_entropy")
        sums.append(" + ".join(f"{k} * {h}_ring_{k}" for k in (1, 2, 3, 4)) + f" AS {h}_radial_preference, " + " + ".join(f"({h}_sector_{k} > 0.1)::INT" for k in (1, 2, 3, 4)) + f" AS {h}_angular_spread")
    return f"""WITH {LEGACY_SQL}, e AS (SELECT *, {", ".join(_edges(f"{h}_cog_distance") for h in L.HANDS)} FROM frames), b AS (SELECT id, {", ".join(bins)} FROM e),
p AS (SELECT id, {", ".join(f"avg(({n.rsplit('_', 1)[0]} = {n[-1]})::INT) AS {n}" for n in _POLAR)} FROM b GROUP BY id), x AS (SELECT *, {", ".join(sums)} FROM p)
SELECT id, {", ".join(f"{h}_dominant_{k}" for h in L.HANDS for k in ("ring", "sector"))}, {", ".join(f"{h}_angular_spread" for h in L.HANDS)}, {rounded_sql(" ".join([*_POLAR, *(f"{h}_{k}" for h in L.HANDS for k in ("ring_entropy", "sector_entropy", "radial_preference"))]))} FROM x"""


@register("polar_hist", _polar_sql())
def polar_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.polar_histograms(frames(spark, sf_dir)))


_SCORED = ["right_speed_mean", "left_speed_mean", "energy_sum", "distance_mean"]


@register("minmax_scores", f"WITH {AGG_SQL}, n AS (SELECT id, {', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-10) AS {c}_norm' for c in _SCORED)} FROM agg) SELECT id, {rounded_sql(' '.join(f'{c}_norm' for c in _SCORED))}, round(({' + '.join(f'{c}_norm' for c in _SCORED)}) / 4 + 1e-9, 6) + 0.0 AS movement FROM n")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.score(L.sequence_features(frames(spark, sf_dir)), _SCORED, "movement").select("id", *[f"{c}_norm" for c in _SCORED], "movement"))


@register("movement_score", f"WITH {AGG_SQL}, r AS (SELECT id, round(energy_sum, 6) AS e, round(right_speed_mean, 6) AS a, round(left_speed_mean, 6) AS b FROM agg), m AS (SELECT id, (e / (max(e) OVER () + 1e-10) + a / (max(a) OVER () + 1e-10) + b / (max(b) OVER () + 1e-10)) / 3 AS movement_score FROM r) SELECT id, {rounded_sql('movement_score')} FROM m")
def movement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.movement_score(L.rounded(L.sequence_features(frames(spark, sf_dir)))).select("id", "movement_score"))


@register("rank_quartiles", "WITH r AS (SELECT c_custkey AS id, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT id, label, CASE WHEN n < 4 THEN 1 ELSE 1 + (r > 1 + (n - 1) * 0.25)::INT + (r > 1 + (n - 1) * 0.5)::INT + (r > 1 + (n - 1) * 0.75)::INT END::INT AS quartile FROM r")
def rank_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), "c_acctbal")
    return L.rank_quartiles(c, "c_acctbal", "label").select("id", "label", "quartile")


@register("cog_quartiles", f"""WITH {LEGACY_SQL}, e AS (SELECT quantile_cont(right_cog_distance, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM frames)
SELECT id, frame, 1 + (right_cog_distance > q[2])::INT + (right_cog_distance > q[3])::INT + (right_cog_distance > q[4])::INT AS right_cog_distance_qbin,
  CASE WHEN right_cog_distance <= 1 THEN 'bin1' WHEN right_cog_distance <= 2 THEN 'bin2' WHEN right_cog_distance <= 3 THEN 'bin3' END AS bin FROM frames, e""")
def cog_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.table_quartiles(frames(spark, sf_dir), ["right_cog_distance"])
    return x.select("id", "frame", "right_cog_distance_qbin", L.fixed_bins(F.col("right_cog_distance"), [0.0, 1.0, 2.0, 3.0]).alias("bin"))
