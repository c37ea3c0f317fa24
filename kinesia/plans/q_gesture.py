"""Queries of the frame and sequence features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia import schema as S
from kinesia.operators import gestures as G
from kinesia.operators import guards
from kinesia.operators import sequence as Q
from kinesia.plans.adapters import WIDE_SQL, rounded, rounded_sql, wide
from kinesia.plans.frames_sql import CLOCK_SQL, COORDINATES_SQL, FRAMES_SQL, SMOOTH_SQL
from kinesia.plans.registry import register

HANDS = ("right", "left")


def frames(spark: SparkSession, sf_dir: str, extended: bool = True) -> DataFrame:
    return G.gesture_frames(wide(spark, sf_dir), extended=extended)


def of_frames(name: str, plain: str, doubles: str, where: str = "true", digits: int = 6, base: str = FRAMES_SQL):
    """A query for some columns of the frame table; ``base`` is the SQL that makes them."""
    expand = lambda names: " ".join(x for n in names.split() for x in ([n.replace("*", h) for h in HANDS] if "*" in n else [n]))
    plain, doubles = expand(plain), expand(doubles)
    sql = f"WITH {base} SELECT id, {', '.join([*plain.split()])}{', ' if plain else ''}{rounded_sql(doubles, digits)} FROM frames WHERE {where}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(frames(spark, sf_dir).where(where).select("id", *plain.split(), *doubles.split()), digits)

    register(name, sql)(run)


of_frames("grid", "frame source_observed frame_inferred", "frame_timestamp", base=CLOCK_SQL)
of_frames("clock_fill", "frame clock_known timestamp_inferred", "frame_timestamp", "timestamp_inferred OR NOT clock_known", base=CLOCK_SQL)
of_frames("coord_fill", "frame *_valid *_observed *_interpolated", "*_confidence *_nx *_ny", base=COORDINATES_SQL)
of_frames("smooth", "frame", "*_nx_smooth *_ny_smooth", base=SMOOTH_SQL)
of_frames("velocity", "frame", "*_velocity_x *_velocity_y *_speed", digits=5)
of_frames("acceleration", "frame", "*_accel_x *_accel_y *_accel_magnitude", digits=4)
of_frames("jerk", "frame", "*_jerk_x *_jerk_y *_jerk_magnitude", digits=3)
of_frames("step_path", "frame", "*_step_distance", base=SMOOTH_SQL)
of_frames("neck_geometry", "frame *_above_neck", "*_neck_distance *_neck_angle", base=SMOOTH_SQL)
of_frames("pair_geometry", "frame both_hands_valid", "pair_separation pair_angle centroid_x centroid_y mirror_error_x mirror_error_y", base=SMOOTH_SQL)


@register("runs", f"WITH {SMOOTH_SQL}, r AS (" + " UNION ALL ".join(f"SELECT id, '{h}' AS hand, {h}_run AS run, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM frames WHERE {h}_run IS NOT NULL GROUP BY id, {h}_run" for h in HANDS) + ") SELECT id, hand, first_frame, last_frame, n_frames FROM r")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches of frames where a wrist is valid and timed."""
    d = frames(spark, sf_dir, False).withColumns({f"{h}_ok": F.col(f"{h}_valid") & F.col("clock_known") for h in HANDS})
    d = Q.with_runs(d, {f"{h}_ok": f"{h}_run" for h in HANDS})
    d = d.select("id", "frame", F.explode(F.array(*[F.struct(F.lit(h).alias("hand"), F.col(f"{h}_ok").alias("ok"), F.col(f"{h}_run").alias("run")) for h in HANDS])).alias("r")).where("r.ok")
    return d.groupBy("id", "r.hand", "r.run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n_frames")).drop("run")


def _peak(v: str) -> str:
    return f"CASE WHEN max({v}) IS NOT NULL THEN (arg_max(struct_pack(t := frame_timestamp), struct_pack(v := {v}, f := -frame)) FILTER (WHERE {v} IS NOT NULL)).t - min(t0) END"


def _summary_sql() -> str:
    parts = []
    for h in HANDS:
        parts.append(f"""count(*) FILTER (WHERE {h}_observed)::DOUBLE AS {h}_n_observed, count(*) FILTER (WHERE {h}_interpolated)::DOUBLE AS {h}_n_interpolated, count(*) FILTER (WHERE {h}_valid)::DOUBLE AS {h}_n_valid,
  count(*) FILTER (WHERE {h}_observed) / count(*) AS {h}_frac_observed, count(*) FILTER (WHERE {h}_interpolated) / count(*) AS {h}_frac_interpolated, count(*) FILTER (WHERE {h}_valid) / count(*) AS {h}_frac_valid,
  avg({h}_speed) AS {h}_mean_speed, max({h}_speed) AS {h}_max_speed, avg({h}_accel_magnitude) AS {h}_mean_accel_magnitude, max({h}_accel_magnitude) AS {h}_max_accel_magnitude,
  sum({h}_step_distance) AS {h}_path_length, max({h}_nx_smooth) - min({h}_nx_smooth) AS {h}_nx_range, max({h}_ny_smooth) - min({h}_ny_smooth) AS {h}_ny_range, avg({h}_neck_distance) AS {h}_mean_neck_distance,
  CASE WHEN sqrt(pow(avg(cos({h}_neck_angle)), 2) + pow(avg(sin({h}_neck_angle)), 2)) > 1e-12 THEN atan2(avg(sin({h}_neck_angle)), avg(cos({h}_neck_angle))) END AS {h}_angle_mean,
  CASE WHEN sqrt(pow(avg(cos({h}_neck_angle)), 2) + pow(avg(sin({h}_neck_angle)), 2)) > 1e-12 THEN sqrt(greatest(-2 * ln(least(1.0, sqrt(pow(avg(cos({h}_neck_angle)), 2) + pow(avg(sin({h}_neck_angle)), 2)))), 0)) END AS {h}_angle_std,
  {_peak(h + "_speed")} AS {h}_time_to_peak_speed, avg({h}_speed) FILTER (WHERE frame_timestamp <= t0 + 0.1 * (t1 - t0)) AS {h}_early_speed_mean, avg({h}_speed) FILTER (WHERE frame_timestamp >= t1 - 0.1 * (t1 - t0)) AS {h}_late_speed_mean""")
    return f"""edged AS (SELECT *, min(frame_timestamp) OVER (PARTITION BY id, people_id) AS t0, max(frame_timestamp) OVER (PARTITION BY id, people_id) AS t1 FROM frames),
summary AS (SELECT id, people_id, count(*) FILTER (WHERE source_observed)::DOUBLE AS frames_source, count(*)::DOUBLE AS frames_grid, count(*) FILTER (WHERE frame_inferred)::DOUBLE AS frames_missing_grid,
  count(*) FILTER (WHERE clock_known)::DOUBLE AS n_timed_frames, count(*) FILTER (WHERE timestamp_inferred)::DOUBLE AS n_timestamp_inferred, count(*) FILTER (WHERE NOT clock_known)::DOUBLE AS n_missing_timestamps,
  min(t0) AS t_start, max(t1) AS t_end, max(t1) - min(t0) AS duration_s, {", ".join(parts)},
  count(*) FILTER (WHERE both_hands_valid)::DOUBLE AS n_both_hands, count(*) FILTER (WHERE both_hands_valid) / count(*) AS frac_both_hands, avg(pair_separation) AS mean_pair_separation, max(pair_separation) AS max_pair_separation,
  avg(mirror_error_x) AS mean_mirror_error_x, avg(mirror_error_y) AS mean_mirror_error_y, {_peak("pair_separation")} AS time_to_peak_pair_separation FROM edged GROUP BY id, people_id)"""


SUMMARY_SQL = f"{FRAMES_SQL}, {_summary_sql()}"


@register("seq_summary", f"WITH {SUMMARY_SQL} SELECT id, {rounded_sql(' '.join(S.SEQUENCE_COLUMNS[1:]), 4)} FROM summary")
def seq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.sequence_features(wide(spark, sf_dir)), 4)


def of_sequences(name: str, columns: list[str], sql: str, digits: int = 4):
    """A query for some columns of the extended sequence table; ``sql`` makes a table ``x`` that has them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(G.sequence_features(wide(spark, sf_dir), extended=True).select("id", *columns), digits)

    register(name, f"WITH {sql} SELECT id, {rounded_sql(' '.join(columns), digits)} FROM x")(run)


def _distribution_sql() -> str:
    out = []
    for h in HANDS:
        for m in G.SPREAD:
            v = f"{h}_{m}"
            stats = {"min": f"min({v})", "max": f"max({v})", "std": f"stddev_samp({v})"} | {f"p{q:02d}": f"quantile_cont({v}, {q / 100})" for q in (5, 25, 50, 75, 95)}
            out += [f"CASE WHEN count({v}) >= 10 THEN {e} END AS {v}_{s}" for s, e in stats.items()]
        for a in ("nx", "ny"):
            v = f"{h}_{a}_smooth"
            out += [f"CASE WHEN count({v}) >= 10 THEN {f}({v}) END AS {h}_{a}_{s}" for s, f in (("min", "min"), ("max", "max"), ("std", "stddev_samp"))]
    return f"{FRAMES_SQL}, x AS (SELECT id, {', '.join(out)} FROM frames GROUP BY id, people_id)"


of_sequences("distribution", [f"{h}_{m}_{s}" for h in HANDS for m in G.SPREAD for s in ("min", "p05", "p25", "p50", "p75", "p95", "max", "std")] + [f"{h}_{a}_{s}" for h in HANDS for a in ("nx", "ny") for s in ("min", "max", "std")], _distribution_sql(), 3)


def _reversals_sql() -> str:
    signs = ", ".join(f"CASE WHEN abs({v}) > 0.5 THEN sign({v}) END AS {h}_{a}" for h in HANDS for a, v in (("x", f"{h}_velocity_x"), ("y", f"{h}_velocity_y"), ("radial", f"({h}_neck_distance - lag({h}_neck_distance) OVER w) / nullif(frame_timestamp - lag(frame_timestamp) OVER w, 0)")))
    names = [f"{h}_{a}" for h in HANDS for a in ("x", "y", "radial")]
    before = ", ".join(f"last_value({n} IGNORE NULLS) OVER (PARTITION BY id, people_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b_{n}" for n in names)
    counts = ", ".join(f"CASE WHEN count({n}) >= 10 THEN (count(*) FILTER (WHERE {n} <> b_{n}))::DOUBLE END AS {n.replace('_', '_reversals_', 1)}" for n in names)
    per = ", ".join(f"CASE WHEN d > 0 AND coalesce({h}_reversals_x, {h}_reversals_y) IS NOT NULL THEN (coalesce({h}_reversals_x, 0) + coalesce({h}_reversals_y, 0)) / d END AS {h}_reversals_per_s" for h in HANDS)
    return f"""{FRAMES_SQL}, signs AS (SELECT id, people_id, frame, frame_timestamp, {signs} FROM frames WINDOW w AS (PARTITION BY id, people_id ORDER BY frame)),
befores AS (SELECT *, {before} FROM signs), counts AS (SELECT id, max(frame_timestamp) - min(frame_timestamp) AS d, {counts} FROM befores GROUP BY id, people_id), x AS (SELECT *, {per} FROM counts)"""


of_sequences("reversals", [f"{h}_reversals_{a}" for h in HANDS for a in ("x", "y", "radial", "per_s")], _reversals_sql())


def _area_sql() -> str:
    out = []
    for h in HANDS:
        x, y = f"{h}_nx_smooth", f"{h}_ny_smooth"
        out.append(f"CASE WHEN count({x}) >= 10 THEN 4 * pi() * sqrt(greatest(var_samp({x}) * var_samp({y}) - pow(covar_samp({x}, {y}), 2), 0)) END AS {h}_ellipse_area, CASE WHEN count({x}) >= 10 THEN (max({x}) - min({x})) * (max({y}) - min({y})) END AS {h}_bbox_area")
    return f"{FRAMES_SQL}, x AS (SELECT id, {', '.join(out)} FROM frames GROUP BY id, people_id)"


of_sequences("ellipse_bbox", [f"{h}_{a}_area" for h in HANDS for a in ("ellipse", "bbox")], _area_sql())

# The hull's edges: directed pairs that no point lies to the right of; of collinear ones only those that hold all others.
of_sequences(
    "hull", ["right_hull_area", "left_hull_area"],
    f"""{SMOOTH_SQL}, q AS ({" UNION ALL ".join(f"SELECT id, '{h}' AS hand, {h}_nx_smooth AS x, {h}_ny_smooth AS y FROM frames" for h in HANDS)}),
p AS (SELECT DISTINCT id, hand, x, y FROM q WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT id, hand, count(x) AS n FROM q GROUP BY id, hand),
e AS (SELECT a.id, a.hand, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.id = b.id AND a.hand = b.hand AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.id = a.id AND c.hand = a.hand AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0)))),
areas AS (SELECT k.id, k.hand, CASE WHEN any_value(n) >= 10 THEN coalesce(0.5 * abs(sum(ax * by_ - bx * ay)), 0) END AS area FROM k LEFT JOIN e USING (id, hand) GROUP BY k.id, k.hand),
x AS (SELECT id, max(area) FILTER (WHERE hand = 'right') AS right_hull_area, max(area) FILTER (WHERE hand = 'left') AS left_hull_area FROM areas GROUP BY id)""",
)


def _ratio_sql() -> str:
    out = []
    for h in HANDS:
        s = f"{h}_speed"
        moved = f"max({s}) > 0.5"
        many = f"count({s}) >= 10"
        m2, m3, m4 = (f"avg(pow({s} - {h}_mu, {k}))" for k in (2, 3, 4))
        out.append(f"""CASE WHEN {many} AND {moved} AND avg({s}) > 0 THEN stddev_samp({s}) / avg({s}) END AS {h}_cv_speed, CASE WHEN {many} AND max({s}) > 0 THEN avg({s}) / max({s}) END AS {h}_mean_over_max,
  CASE WHEN {many} AND {moved} AND {m2} > 0 THEN {m3} / pow({m2}, 1.5) END AS {h}_speed_skew, CASE WHEN {many} AND {moved} AND {m2} > 0 THEN {m4} / pow({m2}, 2) - 3 END AS {h}_speed_kurtosis,
  CASE WHEN {many} AND any_value(duration_s) > 0 THEN any_value({h}_time_to_peak_speed) / any_value(duration_s) END AS {h}_t_peak_rel,
  CASE WHEN {many} AND {moved} AND any_value({h}_late_speed_mean) > 0 THEN any_value({h}_early_speed_mean) / any_value({h}_late_speed_mean) END AS {h}_early_late_speed_ratio,
  CASE WHEN {many} THEN avg(({s} > 0.5)::INT) END AS {h}_frac_speed_gt_0p5, CASE WHEN {many} THEN avg(({s} > 1)::INT) END AS {h}_frac_speed_gt_1p0, CASE WHEN {many} THEN avg(({s} > 2)::INT) END AS {h}_frac_speed_gt_2p0,
  CASE WHEN {many} THEN avg({s} * {s}) END AS {h}_speed_sq_mean, CASE WHEN {many} THEN sum({s} * {s}) END AS {h}_speed_sq_sum, count({s})::DOUBLE AS {h}_n_speed""")
    return f"{SUMMARY_SQL}, both_ AS (SELECT f.*, s.* EXCLUDE (id, people_id), avg(right_speed) OVER q AS right_mu, avg(left_speed) OVER q AS left_mu FROM frames f JOIN summary s USING (id, people_id) WINDOW q AS (PARTITION BY f.id)), x AS (SELECT id, {', '.join(out)} FROM both_ GROUP BY id)"


of_sequences("ratios_moments", [c for c in S.EXTENDED_SEQUENCE_COLUMNS[len(S.SEQUENCE_COLUMNS) :] if f" AS {c}" in _ratio_sql()], _ratio_sql(), 3)


def _bouts(name: str, on: str) -> str:
    return f"""
{name}0 AS (SELECT id, people_id, frame, frame_timestamp, coalesce({on}, false) AND clock_known AND coalesce(lag(clock_known) OVER w AND clock_known, lag(frame) OVER w IS NULL) AS hit FROM frames WINDOW w AS (PARTITION BY id, people_id ORDER BY frame)),
{name}1 AS (SELECT *, frame - row_number() OVER (PARTITION BY id, people_id, hit ORDER BY frame) AS isle FROM {name}0),
{name}2 AS (SELECT id, people_id, max(frame_timestamp) - min(frame_timestamp) AS s FROM {name}1 WHERE hit GROUP BY id, people_id, isle),
{name} AS (SELECT id, people_id, count(*)::DOUBLE AS n, avg(s) AS mean_s, max(s) AS max_s FROM {name}2 GROUP BY id, people_id)"""


of_sequences(
    "run_durations", ["right_longest_moving_s", "left_longest_moving_s", "coactivity_bout_n", "coactivity_bout_mean_s", "coactivity_bout_max_s"],
    f"""{FRAMES_SQL}, {_bouts("rb", "right_speed > 0.5")}, {_bouts("lb", "left_speed > 0.5")}, {_bouts("bb", "right_speed > 0.5 AND left_speed > 0.5")},
x AS (SELECT f.id, CASE WHEN count(right_speed) >= 10 THEN any_value(rb.max_s) END AS right_longest_moving_s, CASE WHEN count(left_speed) >= 10 THEN any_value(lb.max_s) END AS left_longest_moving_s, coalesce(any_value(bb.n), 0) AS coactivity_bout_n,
  CASE WHEN count(right_speed + left_speed) >= 10 THEN any_value(bb.mean_s) END AS coactivity_bout_mean_s, CASE WHEN count(right_speed + left_speed) >= 10 THEN any_value(bb.max_s) END AS coactivity_bout_max_s
  FROM frames f LEFT JOIN rb USING (id, people_id) LEFT JOIN lb USING (id, people_id) LEFT JOIN bb USING (id, people_id) GROUP BY f.id)""",
)

_PHASE = [c for c in S.EXTENDED_SEQUENCE_COLUMNS[len(S.SEQUENCE_COLUMNS) :] if not c.startswith(("right_", "left_", "coactivity_bout"))]
of_sequences(
    "phase_coactivity", _PHASE,
    f"""{FRAMES_SQL}, c AS (SELECT *, CASE WHEN right_speed > 0.5 AND left_speed > 0.5 THEN (right_velocity_x * left_velocity_x + right_velocity_y * left_velocity_y) / (right_speed * left_speed) END AS c,
  CASE WHEN right_speed IS NOT NULL AND left_speed IS NOT NULL THEN least(right_speed, left_speed) END AS slow, both_hands_valid AND right_nx_smooth IS NOT NULL AND left_nx_smooth IS NOT NULL AS pp FROM frames),
x AS (SELECT id, CASE WHEN count(c) >= 10 THEN avg(c) END AS cos_phase_mean, CASE WHEN count(c) >= 10 THEN median(c) END AS cos_phase_median, CASE WHEN count(c) >= 10 THEN stddev_samp(c) END AS cos_phase_std,
  CASE WHEN count(c) >= 10 THEN quantile_cont(c, 0.05) END AS cos_phase_p05, CASE WHEN count(c) >= 10 THEN quantile_cont(c, 0.95) END AS cos_phase_p95,
  CASE WHEN count(c) >= 10 THEN avg((c > 0.8)::INT) END AS frac_cos_gt_0p8, CASE WHEN count(c) >= 10 THEN avg((c < -0.2)::INT) END AS frac_cos_lt_m0p2, count(c)::DOUBLE AS n_cos_phase,
  CASE WHEN count(slow) >= 10 THEN avg((slow > 0.5)::INT) END AS coactivity_frac_0p5, CASE WHEN count(slow) >= 10 THEN avg((slow > 1)::INT) END AS coactivity_frac_1p0,
  CASE WHEN count(mirror_error_x) >= 10 THEN stddev_samp(mirror_error_x) END AS mirror_error_x_std, CASE WHEN count(mirror_error_y) >= 10 THEN stddev_samp(mirror_error_y) END AS mirror_error_y_std,
  CASE WHEN count(*) FILTER (WHERE pp) >= 10 THEN avg(abs(right_ny_smooth + left_ny_smooth)) FILTER (WHERE pp) END AS abs_y_pair_sum_mean,
  CASE WHEN count(*) FILTER (WHERE pp) >= 10 THEN avg((right_ny_smooth + left_ny_smooth) / 2) FILTER (WHERE pp) END AS pair_elevation_mean,
  CASE WHEN count(*) FILTER (WHERE pp) >= 10 THEN avg(abs(right_nx_smooth - left_nx_smooth) * abs(right_ny_smooth - left_ny_smooth)) FILTER (WHERE pp) END AS bbox_area_wrists FROM c GROUP BY id)""",
)


@register("circular", f"WITH {SUMMARY_SQL} SELECT id, {rounded_sql('right_angle_mean right_angle_std left_angle_mean left_angle_std', 5)} FROM summary")
def circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.sequence_features(wide(spark, sf_dir)).select("id", *[f"{h}_angle_{k}" for h in HANDS for k in ("mean", "std")]), 5)


@register("wide_table", f"WITH {WIDE_SQL} SELECT id, frame, {rounded_sql('people_id frame_timestamp nx_4 ny_4 c_4 nx_7 ny_7 c_7')} FROM wide")
def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(guards.checked(wide(spark, sf_dir)))


_DISTURBED = f"""{WIDE_SQL}, d AS (SELECT id, CASE WHEN frame % 97 <> 0 THEN people_id END AS people_id, frame, CASE WHEN frame % 83 = 0 THEN 'inf'::DOUBLE WHEN frame % 29 = 0 THEN frame_timestamp - 100 ELSE frame_timestamp END AS frame_timestamp,
  nx_4, ny_4, CASE WHEN frame % 31 = 0 THEN 1.7 ELSE c_4 END AS c_4, nx_7, ny_7, c_7 FROM wide),
disturbed AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE frame % 50 IN (1, 2) UNION ALL SELECT * REPLACE (nx_4 + 1 AS nx_4) FROM d WHERE frame % 50 = 2),
broken AS (SELECT *, CASE WHEN people_id IS NULL THEN 'no key' WHEN isinf(frame_timestamp) THEN 'time' WHEN c_4 NOT BETWEEN 0 AND 1 OR c_7 NOT BETWEEN 0 AND 1 THEN 'confidence' END AS broken FROM disturbed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, people_id ORDER BY frame, nx_4) AS k, lag(frame) OVER (PARTITION BY id, people_id ORDER BY frame, nx_4) AS f0, lag(nx_4) OVER (PARTITION BY id, people_id ORDER BY frame, nx_4) AS n0 FROM broken),
marked AS (SELECT *, f0 IS NOT DISTINCT FROM frame AND n0 IS NOT DISTINCT FROM nx_4 AS repeat,
  last_value(CASE WHEN broken IS NULL THEN frame_timestamp END IGNORE NULLS) OVER (PARTITION BY id, people_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0 FROM ranked),
judged AS (SELECT *, CASE WHEN broken IS NOT NULL THEN broken WHEN f0 = frame AND NOT repeat THEN 'conflict'
  WHEN NOT repeat AND frame_timestamp <= c0 THEN 'clock' END AS problem FROM marked)"""


def disturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wide`` with every kind of fault: keys without a value, infinite and falling clocks, impossible confidences, repeats, conflicts."""
    f, t = F.col("frame"), F.col("frame_timestamp")
    d = wide(spark, sf_dir).withColumns({
        "people_id": F.when(f % 97 != 0, F.col("people_id")), "c_4": F.when(f % 31 == 0, 1.7).otherwise(F.col("c_4")),
        "frame_timestamp": F.when(f % 83 == 0, float("inf")).when(f % 29 == 0, t - 100).otherwise(t),
    })
    return d.union(d.where("frame % 50 IN (1, 2)")).union(d.where("frame % 50 = 2").withColumn("nx_4", F.col("nx_4") + 1))


@register("guard_keys", f"WITH {_DISTURBED} SELECT id, frame, problem FROM judged WHERE problem IN ('no key', 'time', 'confidence', 'conflict')")
def guard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stop a run for their keys, values or a conflicting row."""
    return guards.problems(disturbed(spark, sf_dir)).where("problem <> 'clock'").select("id", "frame", "problem")


@register("guard_clock", f"WITH {_DISTURBED} SELECT id, frame, round(frame_timestamp + 1e-9, 6) + 0.0 AS frame_timestamp FROM judged WHERE problem = 'clock'")
def guard_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stop a run because their clock does not go on."""
    return rounded(guards.problems(disturbed(spark, sf_dir)).where("problem = 'clock'").select("id", "frame", "frame_timestamp"))


@register("guard_repeats", f"WITH {_DISTURBED} SELECT id, count(*) FILTER (WHERE repeat) AS n_repeats, count(*) FILTER (WHERE NOT repeat) AS n_rows FROM judged WHERE problem IS NULL GROUP BY id")
def guard_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each clip collapse into equal ones."""
    return guards.flagged(disturbed(spark, sf_dir)).where("problem IS NULL").groupBy("id").agg(F.count_if("repeat").alias("n_repeats"), F.count_if(~F.col("repeat")).alias("n_rows"))
