"""Queries of the small views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.operators import explore as E
from kinesia.operators import qc, tab
from kinesia.plans.adapters import POSE_SQL, pose_long, rounded, table
from kinesia.plans.q_delivery import TAB_SQL, tab_lines
from kinesia.plans.q_quality import SCORES_SQL, detections
from kinesia.plans.registry import register


@register("rescale", "SELECT event_id, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) + 1e-9, 6) + 0.0 AS value_norm FROM events WINDOW w AS (PARTITION BY user_id)")
def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.rescaled(table(spark, sf_dir, "events"), "value", "user_id").select("event_id", "value_norm"))


@register("recode_points", f"WITH {POSE_SQL} SELECT replace(type_points, '_keypoints', '') AS kind, count(*) AS n FROM pose_long GROUP BY kind")
def recode_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose_long(spark, sf_dir).groupBy(E.point_kind(F.col("type_points")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("word_order", """WITH w AS (SELECT user_id AS id, event_id AS frame, CASE WHEN event_type = 'error' THEN '###' ELSE event_type END AS word FROM events), f AS (SELECT id, word, min(frame) AS f FROM w GROUP BY ALL)
SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY f, word) AS place FROM f""")
def word_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return E.word_order(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("frame"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("words")))


@register("person_filter", """WITH p AS (SELECT 'v' || label AS video, vec_id // 2 AS frame, embedding[1] > 0 AND embedding[2] > -0.1 AS seen FROM embeddings), f AS (SELECT video, frame, count(*) AS people, count(*) = 1 AND bool_and(seen) AS good FROM p GROUP BY ALL),
g AS (SELECT video, count(*) FILTER (WHERE good) AS n_good, max(people) AS max_people FROM f GROUP BY video) SELECT *, n_good > 5 AND max_people = 1 AS passes FROM g""")
def person_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda i: F.get("embedding", F.lit(i))
    found = F.when((g(0) > 0) & (g(1) > F.lit(-0.1)), 1.0).otherwise(0.0)
    point = F.struct(found.alias("x"), F.lit(0.0).alias("y"))
    body = F.array_repeat(point, 17)
    p = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video"), F.floor(F.col("vec_id") / 2).alias("frame"), body.alias("b"))
    frames = p.groupBy("video", "frame").agg(F.collect_list("b").alias("people"))
    return E.person_filter(frames.select("video", F.size("people").cast("long").alias("people"), E.good_person(F.col("people"), hands=True).alias("good")))


@register("planned_states", f"WITH {SCORES_SQL}, d AS (SELECT video, 'measured' AS state FROM scores WHERE sp_any >= 0.6) SELECT scores.video, coalesce(state, 'not tried') AS state FROM scores LEFT JOIN d USING (video)")
def planned_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = qc.prescreen(detections(spark, sf_dir))
    return E.planned_states(s.select("video"), s.where("sp_any >= 0.6").select("video", F.lit("measured").alias("state")))


@register("audit_states", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'reused' WHEN event_id % 3 = 0 THEN 'missing' WHEN event_type = 'error' THEN 'failed' WHEN value > 30 THEN 'data_error' ELSE 'measured' END AS state FROM events")
def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", E.audit_state(k % 5 == 0, k % 3 != 0, F.col("event_type") == "error", F.col("value") > 30).alias("state"))


@register("safe_names", r"SELECT p_partkey, regexp_replace(p_name || '.é/' || p_partkey, '[^\p{L}\p{N}_-]', '_', 'g') AS name FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", E.safe_name(F.concat("p_name", F.lit(".é/"), F.col("p_partkey").cast("string"))).alias("name"))


@register("windows_by_centre", f"""WITH {TAB_SQL} SELECT replace(program, '.txt', '') AS program, round(centre + 1e-9, 6) + 0.0 AS centre, count(*) AS n, round(sum(round(raw_end - raw_start, 6)) + 1e-9, 6) + 0.0 AS total, count(*) FILTER (WHERE raw_end <= raw_start) AS n_inverted
FROM windows WHERE raw_end IS NOT NULL GROUP BY program, windows.centre""")
def windows_by_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.windows_by_centre(tab.windows(tab_lines(spark, sf_dir)))
    return rounded(x.select("program", "centre", F.size("durations").cast("long").alias("n"), F.aggregate("durations", F.lit(0.0), lambda a, b: a + b).alias("total"), "n_inverted"))


@register("table_counts", f"WITH {POSE_SQL}, c AS (SELECT id, count(*) AS n, max(people_id)::BIGINT AS n_persons FROM pose_long GROUP BY id) SELECT n_persons, sum(n)::BIGINT AS n_rows, count(*) AS n_clips FROM c GROUP BY n_persons")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table_counts(pose_long(spark, sf_dir))


@register("coverage_top", f"WITH {POSE_SQL} SELECT id, count(DISTINCT frame) AS n_frames FROM pose_long WHERE type_points = 'pose_keypoints' GROUP BY id ORDER BY n_frames DESC, id LIMIT 8")
def coverage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top(qc.wrist_coverage(pose_long(spark, sf_dir)).select("id", "n_frames"), 8, F.desc("n_frames"), F.col("id"))
