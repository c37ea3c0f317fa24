"""Queries of the checks, the visibility gate, the prescreen and the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.operators import qc
from kinesia.plans.adapters import POSE_SQL, pose_long, rounded, rounded_sql, table
from kinesia.plans.registry import register

BODY = "type_points = 'pose_keypoints' AND points IN (1, 4, 7)"
OK = "c > 0 AND c >= 0.2"


@register("coverage_pct", f"""WITH {POSE_SQL} SELECT id, count(DISTINCT frame) AS n_frames, round(100 * count(DISTINCT CASE WHEN points = 4 AND {OK} THEN frame END) / count(DISTINCT frame), 1) AS right_pct,
  round(100 * count(DISTINCT CASE WHEN points = 7 AND {OK} THEN frame END) / count(DISTINCT frame), 1) AS left_pct FROM pose_long WHERE {BODY} GROUP BY id""")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.wrist_coverage(pose_long(spark, sf_dir))


@register("frame_collapse", f"""WITH {POSE_SQL} SELECT id, people_id, frame, round(max(frame_timestamp) + 1e-9, 6) + 0.0 AS frame_timestamp, round(max(pitch) + 1e-9, 6) + 0.0 AS pitch, bool_or(vad) AS vad,
  NULL::BOOLEAN AS voice_present, min(program_name) AS program_name FROM pose_long GROUP BY id, people_id, frame""")
def frame_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.collapse_frames(pose_long(spark, sf_dir)))


@register("pitch_by_voice", f"""WITH {POSE_SQL}, f AS (SELECT id, frame, max(pitch) AS pitch, bool_or(vad) AS vad FROM pose_long GROUP BY id, frame)
SELECT id, round(avg(pitch) FILTER (WHERE vad) + 1e-9, 6) + 0.0 AS mean_pitch, count(*) FILTER (WHERE vad) AS n_voiced FROM f GROUP BY id""")
def pitch_by_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: rows to frames, then frames to clips."""
    f = qc.collapse_frames(pose_long(spark, sf_dir))
    return rounded(f.groupBy("id").agg(F.avg(F.when(F.col("vad"), F.col("pitch"))).alias("mean_pitch"), F.count_if("vad").alias("n_voiced")))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose_long(spark, sf_dir).withColumn("tag", F.when((F.col("points") == 7) & (F.col("frame") % 19 == 0), F.lit(None)).otherwise(F.lit("a"))).withColumn("mark", F.when((F.col("points") == 4) & (F.col("frame") % 23 == 0), 2).otherwise(1))


@register("guard_counts", f"""WITH {POSE_SQL}, t AS (SELECT *, CASE WHEN points = 7 AND frame % 19 = 0 THEN NULL ELSE 'a' END AS tag, CASE WHEN points = 4 AND frame % 23 = 0 THEN 2 ELSE 1 END AS mark FROM pose_long)
SELECT id, people_id, frame, count(DISTINCT coalesce(tag, '#')) > 1 AS tag_conflict, count(DISTINCT mark) > 1 AS mark_conflict FROM t GROUP BY ALL HAVING count(DISTINCT coalesce(tag, '#')) > 1 OR count(DISTINCT mark) > 1""")
def guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.conflicts(_tagged(spark, sf_dir), ("tag", "mark"))


@register("duplicate_policy", """SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT struct_pack(a := l_quantity, b := l_returnflag)) AS n_different FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.duplicate_rows(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), ("l_quantity", "l_returnflag"))


@register("clock_stats", f"""WITH {POSE_SQL} SELECT id, count(*) FILTER (WHERE frame_timestamp IS NULL) AS rows_untimed, count(DISTINCT frame) FILTER (WHERE frame_timestamp IS NULL) AS frames_untimed,
  count(*) FILTER (WHERE frame_timestamp IS NULL AND {OK}) AS trusted_untimed FROM pose_long WHERE {BODY} AND points <> 1 GROUP BY id""")
def clock_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.clock_stats(pose_long(spark, sf_dir))


@register("origin_check", f"""WITH {POSE_SQL}, p AS (SELECT id, people_id, points, ny, CASE WHEN points = 1 AND length(id) = 3 AND frame = 5 THEN 0.5 ELSE nx END AS nx, CASE WHEN id = 'u7' AND frame = 2 THEN 1.5 WHEN id = 'u9' AND points = 1 THEN NULL ELSE c END AS c FROM pose_long WHERE {BODY}),
s AS (SELECT id, people_id, count(*) FILTER (WHERE points = 1 AND {OK}) AS n_neck, count(*) FILTER (WHERE points = 1 AND {OK} AND (abs(nx) > 1e-6 OR abs(ny) > 1e-6)) AS n_off_origin, count(*) FILTER (WHERE c < 0 OR c > 1) AS n_bad_confidence, count(*) FILTER (WHERE points <> 1 AND nx IS NOT NULL AND ny IS NOT NULL AND c > 0) AS n_wrists FROM p GROUP BY ALL)
SELECT *, CASE WHEN n_bad_confidence > 0 THEN 'bad confidence' WHEN n_off_origin > 0 THEN 'off origin' WHEN n_neck = 0 THEN 'unverifiable' ELSE 'verified' END AS verdict FROM s""")
def origin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pose_long(spark, sf_dir)
    p = p.withColumn("nx", F.when((F.col("points") == 1) & (F.length("id") == 3) & (F.col("frame") == 5), 0.5).otherwise(F.col("nx")))
    p = p.withColumn("c", F.when((F.col("id") == "u7") & (F.col("frame") == 2), 1.5).when((F.col("id") == "u9") & (F.col("points") == 1), F.lit(None)).otherwise(F.col("c")))
    return qc.origin_check(p)


@register("visibility_gate", f"""WITH {POSE_SQL}, e AS (SELECT id, max(frame) * CASE WHEN length(id) = 2 THEN 2 WHEN id = 'u50' THEN 0 ELSE 1 END AS n_frames FROM pose_long GROUP BY id),
f AS (SELECT id, count(DISTINCT frame) AS n_seen, count(DISTINCT CASE WHEN points = 4 AND {OK} THEN frame END) AS visible_4, count(DISTINCT CASE WHEN points = 7 AND {OK} THEN frame END) AS visible_7 FROM pose_long WHERE {BODY} GROUP BY id)
SELECT id, n_frames::BIGINT AS n_frames, n_seen, visible_4, visible_7, 1::BIGINT AS most_people, CASE WHEN n_frames <= 0 OR n_seen > n_frames THEN 'data_error' WHEN visible_4 * 100 < n_frames * 40 OR visible_7 * 100 < n_frames * 40 THEN 'low_coverage' ELSE 'accepted' END AS decision FROM e JOIN f USING (id)""")
def visibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pose_long(spark, sf_dir)
    n = F.max("frame") * F.when(F.length("id") == 2, 2).when(F.col("id") == "u50", 0).otherwise(1)
    return qc.visibility_gate(p, p.groupBy("id").agg(n.alias("n_frames")))


@register("pivot_wide", f"""WITH {POSE_SQL} SELECT id, people_id, frame, round(frame_timestamp + 1e-9, 6) + 0.0 AS frame_timestamp, {", ".join(f"round(max({c}) FILTER (WHERE points = {p}) + 1e-9, 6) + 0.0 AS {c}_{p}" for p in (4, 7) for c in ("nx", "ny", "c"))}
FROM (SELECT * FROM pose_long WHERE {BODY} AND points <> 1 AND NOT (points = 7 AND frame % 10 = 0)) GROUP BY id, people_id, frame, pose_long.frame_timestamp""".replace("pose_long.frame_timestamp", "frame_timestamp"))
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.pivot_wide(pose_long(spark, sf_dir).where("NOT (points = 7 AND frame % 10 = 0)")))


@register("people_class", f"WITH {POSE_SQL} SELECT id, max(people_id)::BIGINT AS n_persons FROM pose_long GROUP BY id")
def people_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.people_class(pose_long(spark, sf_dir))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda i, k: F.abs(F.get("embedding", F.lit(i)).cast("double")) * k
    return e.select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video"), F.floor(F.col("vec_id") / 2).alias("frame"), "vec_id", v(0, 4).alias("nose"), v(1, 4).alias("left"), v(2, 4).alias("right"))


DETECTIONS_SQL = "detections AS (SELECT 'v' || label AS video, vec_id // 2 AS frame, vec_id, abs(embedding[1]::DOUBLE) * 4 AS nose, abs(embedding[2]::DOUBLE) * 4 AS \"left\", abs(embedding[3]::DOUBLE) * 4 AS \"right\" FROM embeddings)"
SCORES_SQL = f"""{DETECTIONS_SQL}, f AS (SELECT video, frame, count(*) AS people, arg_max(struct_pack(l := "left", r := "right"), nose) AS top FROM detections GROUP BY ALL),
scores AS (SELECT video, count(*) AS n_sampled, max(people) AS max_people, count(*) FILTER (WHERE people = 1 AND top.r >= 0.5) / count(*) AS "right", count(*) FILTER (WHERE people = 1 AND top.l >= 0.5) / count(*) AS "left",
  count(*) FILTER (WHERE people = 1 AND top.r >= 0.5 AND top.l >= 0.5) / count(*) AS "both", count(*) FILTER (WHERE top.r >= 0.5) / count(*) AS sp_right, count(*) FILTER (WHERE top.l >= 0.5) / count(*) AS sp_left,
  count(*) FILTER (WHERE top.r >= 0.5 AND top.l >= 0.5) / count(*) AS sp_both, count(*) FILTER (WHERE top.r >= 0.5 OR top.l >= 0.5) / count(*) AS sp_any FROM f GROUP BY video)"""
_SCORE_NAMES = '"right" "left" "both" sp_right sp_left sp_both sp_any'


@register("prescreen_rank", f"WITH {SCORES_SQL} SELECT video, n_sampled, max_people, {rounded_sql(_SCORE_NAMES)}, row_number() OVER (ORDER BY sp_any DESC, sp_both DESC, video) AS rank FROM scores")
def prescreen_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.rank_clips(qc.prescreen(detections(spark, sf_dir))))


def _missing(x: DataFrame) -> DataFrame:
    return x.withColumn("sp_any", F.when(F.col("video") == "v3", F.lit(None)).when(F.col("video") == "v4", F.lit(float("nan"))).otherwise(F.col("sp_any"))).withColumn("sp_right", F.when(F.col("video") != "v4", F.col("sp_right"))).withColumn("sp_left", F.when(F.col("video") != "v4", F.col("sp_left")))


@register("admission", f"WITH {SCORES_SQL}, s AS (SELECT video, CASE WHEN video = 'v4' THEN NULL WHEN video = 'v3' THEN greatest(sp_right, sp_left) ELSE sp_any END AS score FROM scores) SELECT video, round(score + 1e-9, 6) + 0.0 AS score, coalesce(score >= 0.6, false) AS admitted, coalesce(score < 0.6, false) AS rejected, NOT coalesce(score >= 0.6, false) AS audited FROM s")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.admit(_missing(qc.prescreen(detections(spark, sf_dir)))).select("video", "score", "admitted", "rejected", "audited"))


@register("audit_usable", f"WITH {SCORES_SQL}, s AS (SELECT CASE WHEN video = 'v4' THEN NULL WHEN video = 'v3' THEN greatest(sp_right, sp_left) ELSE sp_any END AS a, sp_both AS b FROM scores) SELECT 'sp_any' AS criterion, count(*) AS n, count(a) AS usable FROM s UNION ALL SELECT 'sp_both', count(*), count(b) FROM s")
def audit_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.usable(_missing(qc.prescreen(detections(spark, sf_dir))))


@register("systematic_sample", f"WITH {SCORES_SQL}, r AS (SELECT video, row_number() OVER (ORDER BY sp_any DESC, sp_both DESC, video) - 1 AS place, count(*) OVER () AS n FROM scores) SELECT video, place FROM r WHERE place IN (SELECT round_even(i * (n - 1) / 3.0, 0)::BIGINT FROM range(4) t(i))")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = qc.prescreen(detections(spark, sf_dir))
    return qc.systematic_sample(scores, 4, [F.desc("sp_any"), F.desc("sp_both"), F.col("video")], scores.count()).select("video", F.col("place").cast("long").alias("place"))


@register("audit_verdict", """WITH v AS (SELECT vec_id, [abs(embedding[i]::DOUBLE) * 3 FOR i IN range(1, 4)] AS a FROM embeddings)
SELECT vec_id, list_min(a) >= 0.1 AS all_pass, list_max(a) >= 0.1 AS max_pass, concat_ws(',', CASE WHEN list_min(a) >= 0.05 THEN '0.05' END, CASE WHEN list_min(a) >= 0.2 THEN '0.2' END) AS passed FROM v""".replace("[abs(embedding[i]::DOUBLE) * 3 FOR i IN range(1, 4)]", "[abs(embedding[1]::DOUBLE) * 3, abs(embedding[2]::DOUBLE) * 3, abs(embedding[3]::DOUBLE) * 3]"))
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*[F.abs(F.get("embedding", F.lit(i)).cast("double")) * 3 for i in range(3)], F.lit(None).cast("double"), F.lit(float("nan")))
    return table(spark, sf_dir, "embeddings").select("vec_id", qc.verdict(values, [0.05, 0.2], 0.1).alias("v")).select("vec_id", "v.*")


# Bisection of the binomial distribution, forty halvings, each limit from 0 to 1.
@register("audit_ci", """WITH RECURSIVE a AS (SELECT count(*) AS planned, count(*) FILTER (WHERE event_type <> 'error') AS measured, count(*) FILTER (WHERE event_type <> 'error' AND value > 40) AS missed FROM events),
w AS MATERIALIZED (SELECT i, lgamma(measured + 1) - lgamma(i + 1) - lgamma(measured - i + 1) AS ways FROM a, LATERAL (SELECT unnest(range(0, missed + 1)) AS i)),
s AS (SELECT side, missed - side AS j, measured AS n, CASE WHEN side = 1 THEN 0.975 ELSE 0.025 END AS goal FROM a, (VALUES (0), (1)) v(side)),
b AS (SELECT side, j, n, goal, 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM s
  UNION ALL SELECT side, any_value(j), any_value(n), any_value(goal), any_value(step) + 1, CASE WHEN sum(exp(ways + i * ln((low + high) / 2) + (n - i) * ln(1 - (low + high) / 2))) FILTER (WHERE i <= j) > any_value(goal) THEN any_value((low + high) / 2) ELSE any_value(low) END,
    CASE WHEN sum(exp(ways + i * ln((low + high) / 2) + (n - i) * ln(1 - (low + high) / 2))) FILTER (WHERE i <= j) > any_value(goal) THEN any_value(high) ELSE any_value((low + high) / 2) END FROM b, w WHERE step < 40 GROUP BY side)
SELECT planned, measured, missed, CASE WHEN missed = 0 THEN 0.0 ELSE (SELECT round((low + high) / 2 + 1e-9, 6) FROM b WHERE side = 1 AND step = 40) END::DOUBLE AS low,
  CASE WHEN missed = measured THEN 1.0 ELSE (SELECT round((low + high) / 2 + 1e-9, 6) FROM b WHERE side = 0 AND step = 40) END::DOUBLE AS high FROM a""")
def audit_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(qc.audit_summary(e.select(F.when(F.col("event_type") == "error", "failed").otherwise("measured").alias("state"), (F.col("value") > 40).alias("passes"))))


@register("repeated_failure", """WITH r AS (SELECT user_id AS run, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT run, count(*) = 3 AND count(DISTINCT state) = 1 AND max(state) <> 'measured' AS stop FROM r WHERE k <= 3 GROUP BY run""")
def repeated_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.repeated_failure(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("state")))


@register("ghost_cleanup", """WITH c AS (SELECT 'v' || label AS id, vec_id // 8 AS frame, vec_id AS person, floor(abs(embedding[1]::DOUBLE) * 60)::INT % 12 AS n_reliable, abs(embedding[2]::DOUBLE) AS nose, embedding[3]::DOUBLE > 0 AS shoulders, abs(embedding[4]::DOUBLE) * 5 AS black FROM embeddings),
d AS (SELECT *, (n_reliable < 6 AND NOT shoulders) OR black > 0.5 AS droppable, row_number() OVER (PARTITION BY id, frame ORDER BY n_reliable DESC, nose DESC, person) = 1 AS best, count(*) OVER (PARTITION BY id, frame) > 1 AS ambiguous FROM c),
s AS (SELECT id, count(DISTINCT CASE WHEN ambiguous THEN frame END) / count(DISTINCT frame) > 0.25 AS sustained FROM d GROUP BY id),
j AS (SELECT d.*, sustained, bool_and(best OR droppable) OVER (PARTITION BY d.id, frame) AS clear FROM d JOIN s USING (id))
SELECT id, frame, person, sustained, CASE WHEN NOT ambiguous OR best THEN true WHEN sustained THEN NOT clear ELSE false END AS kept FROM j""")
def ghost_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda i: F.get("embedding", F.lit(i)).cast("double")
    c = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("id"), F.floor(F.col("vec_id") / 8).alias("frame"), F.col("vec_id").alias("person"),
        (F.floor(F.abs(g(0)) * 60).cast("int") % 12).alias("n_reliable"), F.abs(g(1)).alias("nose"), (g(2) > 0).alias("shoulders"), (F.abs(g(3)) * 5).alias("black"),
    )
    return qc.prune_ghosts(c).select("id", "frame", "person", "sustained", "kept")
