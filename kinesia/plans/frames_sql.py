"""The frame features of ``adapters.wide`` as SQL, to hold the engine's result against."""

from __future__ import annotations

from kinesia.plans.adapters import WIDE_SQL

KEY = "id, people_id"
W = f"OVER (PARTITION BY {KEY} ORDER BY frame)"
BEFORE = f"OVER (PARTITION BY {KEY} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
AFTER = f"OVER (PARTITION BY {KEY} ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
RUN = "(PARTITION BY id, people_id, ok, run ORDER BY frame)"


def _derivative(v: str) -> str:
    lag = lambda c, k: f"lag({c}, {k}) OVER {RUN}"
    lead = lambda c, k: f"lead({c}, {k}) OVER {RUN}"
    v1, v2, w1, w2 = lag(v, 1), lag(v, 2), lead(v, 1), lead(v, 2)
    a, b = f"(t - {lag('t', 1)})", f"({lead('t', 1)} - t)"
    d, f = f"({lead('t', 2)} - {lead('t', 1)})", f"({lag('t', 1)} - {lag('t', 2)})"
    return f"""CASE WHEN NOT ok OR n < 2 THEN NULL WHEN n = 2 THEN CASE WHEN i = 0 THEN ({w1} - {v}) / {b} ELSE ({v} - {v1}) / {a} END
      WHEN i = 0 THEN -(2 * {b} + {d}) / ({b} * ({b} + {d})) * {v} + ({b} + {d}) / ({b} * {d}) * {w1} - {b} / ({d} * ({b} + {d})) * {w2}
      WHEN i = n - 1 THEN {a} / ({f} * ({a} + {f})) * {v2} - ({a} + {f}) / ({a} * {f}) * {v1} + (2 * {a} + {f}) / ({a} * ({a} + {f})) * {v}
      ELSE ({a} * {a} * {w1} + ({b} * {b} - {a} * {a}) * {v} - {b} * {b} * {v1}) / ({a} * {b} * ({a} + {b})) END"""


def _hand(h: str, p: int) -> dict[str, str]:
    """The statements for one hand: coordinates, smoothing, derivatives."""
    fit = lambda x: f"(y0{x} * (s2 * s4 - s3 * s3) - s1 * (y1{x} * s4 - y2{x} * s3) + s2 * (y1{x} * s3 - y2{x} * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
    sums = ", ".join(f"sum(pow(q.t - r.t, {k})) AS s{k}" for k in range(5)) + ", " + ", ".join(f"sum(q.{x} * pow(q.t - r.t, {k})) AS y{k}{x}" for x in "xy" for k in range(3))
    base = f"""c_{p} AS {h}_confidence, x AS {h}_nx, y AS {h}_ny, sx AS {h}_nx_smooth, sy AS {h}_ny_smooth, valid AS {h}_valid, use AS {h}_observed, interp AS {h}_interpolated,
  CASE WHEN ok THEN run END AS {h}_run, sqrt(sx * sx + sy * sy) AS {h}_neck_distance, CASE WHEN sqrt(sx * sx + sy * sy) > 0 THEN atan2(sy, sx) END AS {h}_neck_angle, sy > 0 AS {h}_above_neck,
  CASE WHEN valid AND lag(valid) {W} THEN sqrt(pow(sx - lag(sx) {W}, 2) + pow(sy - lag(sy) {W}, 2)) END AS {h}_step_distance"""
    found = f"""
{h}0 AS (SELECT *, coalesce(nx_{p} IS NOT NULL AND ny_{p} IS NOT NULL AND c_{p} > 0 AND c_{p} >= 0.2, false) AS use FROM clock),
{h}1 AS (SELECT *, last_value(CASE WHEN use THEN frame END IGNORE NULLS) {BEFORE} AS pf, first_value(CASE WHEN use THEN frame END IGNORE NULLS) {AFTER} AS nf FROM {h}0),
{h}2 AS (SELECT a.*, p.frame_timestamp AS pt, n.frame_timestamp AS nt, p.nx_{p} AS px, n.nx_{p} AS qx, p.ny_{p} AS py, n.ny_{p} AS qy FROM {h}1 a
  LEFT JOIN clock p ON a.id = p.id AND a.people_id = p.people_id AND a.pf = p.frame LEFT JOIN clock n ON a.id = n.id AND a.people_id = n.people_id AND a.nf = n.frame),
{h}3 AS (SELECT *, coalesce(NOT use AND nf - pf - 1 <= 3 AND nt - pt > 0, false) AS interp FROM {h}2),
{h}4 AS (SELECT *, use OR interp AS valid, frame_timestamp AS t, CASE WHEN use THEN nx_{p} WHEN interp THEN px + (frame_timestamp - pt) / (nt - pt) * (qx - px) END AS x,
  CASE WHEN use THEN ny_{p} WHEN interp THEN py + (frame_timestamp - pt) / (nt - pt) * (qy - py) END AS y FROM {h}3),
{h}_found AS (SELECT id, people_id, frame, c_{p} AS {h}_confidence, x AS {h}_nx, y AS {h}_ny, valid AS {h}_valid, use AS {h}_observed, interp AS {h}_interpolated FROM {h}4)"""
    smoothed = f"""
{h}5 AS (SELECT *, valid AND clock_known AS ok FROM {h}4),
{h}6 AS (SELECT *, ok AND NOT coalesce(lag(ok) {W}, false) AS begins FROM {h}5),
{h}7 AS (SELECT *, sum(begins::INT) OVER (PARTITION BY {KEY} ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM {h}6),
{h}8 AS (SELECT *, count(*) OVER (PARTITION BY {KEY}, ok, run) AS n, row_number() OVER {RUN} - 1 AS i FROM {h}7),
{h}9 AS (SELECT *, least(7, n - 1 + n % 2) AS w FROM {h}8),
{h}10 AS (SELECT *, least(greatest(i - w // 2, 0), n - w) AS lo FROM {h}9),
{h}w AS (SELECT id, people_id, run, frame, t, unnest(range(lo, lo + w)) AS j FROM {h}10 WHERE ok AND w > 3),
{h}f AS MATERIALIZED (SELECT r.id, r.people_id, r.frame, {sums} FROM {h}w r JOIN (SELECT * FROM {h}10 WHERE ok) q ON r.id = q.id AND r.people_id = q.people_id AND r.run = q.run AND r.j = q.i GROUP BY ALL),
{h}11 AS (SELECT a.*, CASE WHEN f.s0 IS NULL THEN x ELSE {fit("x")} END AS sx, CASE WHEN f.s0 IS NULL THEN y ELSE {fit("y")} END AS sy
  FROM {h}10 a LEFT JOIN {h}f f USING (id, people_id, frame)),
{h}_smooth AS (SELECT id, people_id, frame, {base} FROM {h}11)"""
    moved = f"""
{h}12 AS (SELECT *, {_derivative("sx")} AS vx, {_derivative("sy")} AS vy FROM {h}11),
{h}13 AS (SELECT *, {_derivative("vx")} AS ax0, {_derivative("vy")} AS ay0 FROM {h}12),
{h}14 AS (SELECT *, {_derivative("ax0")} AS jx0, {_derivative("ay0")} AS jy0 FROM {h}13),
{h}_moved AS (SELECT id, people_id, frame, {base},
  vx AS {h}_velocity_x, vy AS {h}_velocity_y, sqrt(vx * vx + vy * vy) AS {h}_speed,
  CASE WHEN n >= 3 THEN ax0 END AS {h}_accel_x, CASE WHEN n >= 3 THEN ay0 END AS {h}_accel_y, CASE WHEN n >= 3 THEN sqrt(ax0 * ax0 + ay0 * ay0) END AS {h}_accel_magnitude,
  CASE WHEN n >= 4 THEN jx0 END AS {h}_jerk_x, CASE WHEN n >= 4 THEN jy0 END AS {h}_jerk_y, CASE WHEN n >= 4 THEN sqrt(jx0 * jx0 + jy0 * jy0) END AS {h}_jerk_magnitude FROM {h}14)"""
    return {"found": found, "smooth": f"{found},{smoothed}", "moved": f"{found},{smoothed},{moved}"}


_CLOCK = f"""{WIDE_SQL},
grid AS (SELECT id, people_id, unnest(generate_series(a, b)) AS frame FROM (SELECT id, people_id, min(frame) AS a, max(frame) AS b FROM wide GROUP BY id, people_id)),
placed AS (SELECT g.*, w.* EXCLUDE (id, people_id, frame), w.id IS NOT NULL AS source_observed FROM grid g LEFT JOIN wide w USING (id, people_id, frame)),
marks AS (SELECT *, last_value(CASE WHEN frame_timestamp IS NOT NULL THEN frame END IGNORE NULLS) {BEFORE} AS cf, first_value(CASE WHEN frame_timestamp IS NOT NULL THEN frame END IGNORE NULLS) {AFTER} AS df,
  last_value(frame_timestamp IGNORE NULLS) {BEFORE} AS ct, first_value(frame_timestamp IGNORE NULLS) {AFTER} AS dt FROM placed),
guessed AS (SELECT *, coalesce(frame_timestamp IS NULL AND df - cf - 1 <= 3, false) AS timestamp_inferred FROM marks),
clock AS MATERIALIZED (SELECT * REPLACE (CASE WHEN timestamp_inferred THEN ct + (frame - cf) / (df - cf) * (dt - ct) ELSE frame_timestamp END AS frame_timestamp),
  (timestamp_inferred OR frame_timestamp IS NOT NULL) AS clock_known FROM guessed)"""
_HEAD = "id, people_id, frame, c.frame_timestamp, c.source_observed, NOT c.source_observed AS frame_inferred, c.clock_known, c.timestamp_inferred"


def _joined(part: str, suffix: str) -> str:
    hands = {h: _hand(h, p)[part] for h, p in (("right", 4), ("left", 7))}
    return f"""{_CLOCK},{hands["right"]},{hands["left"]},
joined AS (SELECT {_HEAD}, r.* EXCLUDE (id, people_id, frame), l.* EXCLUDE (id, people_id, frame), right_valid AND left_valid AS both_hands_valid
  FROM clock c JOIN right_{suffix} r USING (id, people_id, frame) JOIN left_{suffix} l USING (id, people_id, frame))"""


_PAIR = """paired AS (SELECT *, CASE WHEN both_hands_valid THEN sqrt(pow(right_nx_smooth - left_nx_smooth, 2) + pow(right_ny_smooth - left_ny_smooth, 2)) END AS pair_separation FROM joined),
frames AS MATERIALIZED (SELECT *, CASE WHEN pair_separation > 0 THEN atan2(right_ny_smooth - left_ny_smooth, right_nx_smooth - left_nx_smooth) END AS pair_angle,
  CASE WHEN both_hands_valid THEN (right_nx_smooth + left_nx_smooth) / 2 END AS centroid_x, CASE WHEN both_hands_valid THEN (right_ny_smooth + left_ny_smooth) / 2 END AS centroid_y,
  CASE WHEN both_hands_valid THEN abs(right_nx_smooth + left_nx_smooth) END AS mirror_error_x, CASE WHEN both_hands_valid THEN abs(right_ny_smooth - left_ny_smooth) END AS mirror_error_y FROM paired)"""

#: Statements that end in a table ``frames``, each with the columns that its queries need.
CLOCK_SQL = f"{_CLOCK}, frames AS (SELECT {_HEAD} FROM clock c)"
COORDINATES_SQL = f"{_joined('found', 'found')}, frames AS (SELECT * FROM joined)"
SMOOTH_SQL = f"{_joined('smooth', 'smooth')}, {_PAIR}"
FRAMES_SQL = f"{_joined('moved', 'moved')}, {_PAIR}"
