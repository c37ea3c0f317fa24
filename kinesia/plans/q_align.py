"""Queries of the alignment of words, voice and tracks, and of the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia.operators import align
from kinesia.plans.adapters import micros, rounded, table
from kinesia.plans.registry import register

HOURS_SQL = "hours AS (SELECT *, 'u' || user_id AS id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS h FROM events)"
CLIPS_SQL = "clips AS (SELECT id, greatest(1, ceil(2 * max(h + value / 10)))::BIGINT AS n FROM hours GROUP BY id), frames AS (SELECT id, unnest(range(1, n + 1)) AS frame FROM clips)"


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("id", F.concat(F.lit("u"), F.col("user_id").cast("string"))).withColumn("h", (micros("ts") - F.min(micros("ts")).over(W.partitionBy("user_id"))) / 3.6e9)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames an hour, up to the end of the last event."""
    last = F.greatest(F.lit(1), F.ceil(F.max(F.col("h") + F.col("value") / 10) * 2))
    clips = hours(spark, sf_dir).groupBy("id").agg(last.alias("n_frames")).withColumn("fps", F.lit(2.0))
    return align.frame_intervals(clips)


@register("frame_intervals", f"WITH {HOURS_SQL}, {CLIPS_SQL} SELECT id, frame::BIGINT AS frame, round((frame - 1) / 2.0 + 1e-9, 6) AS start, round(frame / 2.0 + 1e-9, 6) AS \"end\" FROM frames")
def frame_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames(spark, sf_dir))


@register("words_to_frames", f"""WITH {HOURS_SQL}, {CLIPS_SQL}, words AS (SELECT id, event_type AS word, h AS start, h + value / 10 AS "end", value AS score FROM hours)
SELECT f.id, f.frame::BIGINT AS frame, string_agg(word, ', ' ORDER BY w.start, word, score) AS words, string_agg(score::VARCHAR, ', ' ORDER BY w.start, word, score) AS scores
FROM frames f JOIN words w ON f.id = w.id AND w.start <= f.frame / 2.0 AND w."end" >= (f.frame - 1) / 2.0 GROUP BY ALL""")
def words_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = hours(spark, sf_dir).select("id", F.col("event_type").alias("word"), F.col("h").alias("start"), (F.col("h") + F.col("value") / 10).alias("end"), F.col("value").alias("score"))
    return align.words_on_frames(frames(spark, sf_dir), words)


@register("vad", f"""WITH {HOURS_SQL}, {CLIPS_SQL}, s AS (SELECT id, h AS start, h + value / 50 AS "end" FROM hours WHERE event_type <> 'error'), m AS (SELECT DISTINCT id FROM hours WHERE user_id % 5 <> 0)
SELECT f.id, f.frame::BIGINT AS frame, CASE WHEN m.id IS NOT NULL THEN EXISTS (SELECT 1 FROM s WHERE s.id = f.id AND (f.frame - 1) / 2.0 BETWEEN s.start AND s."end") END AS vad FROM frames f LEFT JOIN m ON f.id = m.id""")
def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir)
    segments = h.where("event_type <> 'error'").select("id", F.col("h").alias("start"), (F.col("h") + F.col("value") / 50).alias("end"))
    return align.voice_activity(frames(spark, sf_dir).select("id", "frame", F.col("start").alias("t")), segments, h.where("user_id % 5 <> 0").select("id")).select("id", "frame", "vad")


@register("align_track", f"""WITH {HOURS_SQL}, {CLIPS_SQL}, s0 AS (SELECT id, round(h, 1) AS t, arg_min(value, event_id) AS v FROM hours WHERE event_id % 9 <> 0 GROUP BY ALL),
s1 AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY id ORDER BY t) > 8, true) THEN 1 ELSE 0 END AS n FROM s0),
s2 AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY t) AS run FROM s1), s3 AS (SELECT *, count(*) OVER (PARTITION BY id, run) AS k FROM s2), s AS (SELECT * FROM s3 WHERE k >= 2),
g AS (SELECT id, frame, (frame - 1) / 2.0 AS t FROM frames),
p AS (SELECT g.id, g.frame, g.t, s.t AS pt, s.v AS pv, s.run AS pr FROM g ASOF LEFT JOIN s ON g.id = s.id AND g.t >= s.t),
q AS (SELECT p.*, s.t AS qt, s.v AS qv, s.run AS qr FROM p ASOF LEFT JOIN s ON p.id = s.id AND p.t <= s.t)
SELECT id, frame::BIGINT AS frame, round(t + 1e-9, 6) AS t, round(CASE WHEN pr = qr THEN CASE WHEN qt = pt THEN pv ELSE pv + (t - pt) / (qt - pt) * (qv - pv) END END + 1e-9, 6) + 0.0 AS value FROM q""")
def align_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = hours(spark, sf_dir).select("id", F.col("event_id").alias("seq"), F.round("h", 1).alias("t"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"))
    return rounded(align.align_track(samples, frames(spark, sf_dir).select("id", "frame", F.col("start").alias("t")), largest_gap=8))


@register("voice_present", f"""WITH {HOURS_SQL} SELECT id, event_id, CASE WHEN user_id % 4 <> 0 THEN value > 10 END AS voice_present FROM hours""")
def voice_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir).withColumn("pitch", align.silence_to_null(F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(-1.0))))
    return align.voice_present(h, h.where("user_id % 4 <> 0").select("id")).select("id", "event_id", "voice_present")


@register("merge_outer", f"""WITH {HOURS_SQL}, pose AS (SELECT id, event_id % 50 AS frame, event_id FROM hours WHERE event_type = 'click'),
prosody AS (SELECT id, event_id % 50 AS frame, arg_min(value, event_id) AS pitch FROM hours WHERE event_type = 'view' GROUP BY ALL), words AS (SELECT id, event_id % 50 AS frame, min(event_type) AS words FROM hours WHERE event_type NOT IN ('click', 'view') GROUP BY ALL)
SELECT p.id, p.frame + 1 AS frame, p.event_id, pitch, words FROM pose p LEFT JOIN prosody r ON p.id = r.id AND p.frame + 1 = r.frame LEFT JOIN words w ON p.id = w.id AND p.frame + 1 = w.frame""")
def merge_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir).withColumn("frame", F.col("event_id") % 50)
    prosody = h.where("event_type = 'view'").select("id", "frame", F.col("event_id").alias("seq"), F.col("value").alias("pitch"))
    words = h.where("event_type NOT IN ('click', 'view')").groupBy("id", "frame").agg(F.min("event_type").alias("words"))
    return align.merge_clip(h.where("event_type = 'click'").select("id", "frame", "event_id"), prosody, words)


@register("discard_policy", """WITH c AS (SELECT c_mktsegment AS bucket, c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 0 ELSE 5 END AS n FROM customer),
t AS (SELECT bucket, count(*) AS n_clips, count(*) FILTER (WHERE n IS NULL OR n = 0) AS n_discarded, count(*) FILTER (WHERE n IS NULL) AS n_missing, count(*) FILTER (WHERE n = 0) AS n_empty FROM c GROUP BY bucket)
SELECT *, round(n_discarded * 100.0 / n_clips, 2)::DOUBLE AS pct, CASE WHEN n_discarded = n_clips THEN 'fail: all' WHEN n_discarded * 100.0 / n_clips > 5 THEN 'fail: threshold' ELSE 'pass' END AS decision FROM t""")
def discard_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("bucket"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 17 == 0, F.lit(None)).when(F.col("c_custkey") % 23 == 0, 0).otherwise(5).alias("prosody_rows"))
    return align.discard_policy(c)
