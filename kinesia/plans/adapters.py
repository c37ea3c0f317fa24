"""The driver's tables seen as sequences of keypoints, in Spark and as the same SQL text.

``events`` make one sequence for each user: the frame is the event's place, with
gaps of one and of five frames, and the clock counts hours since the first event.
Rules on the event's number take clocks and confidences away, so every rule on
nulls is met; every event is a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros; what lies halfway is moved up first."""
    return df.select(*[(F.round(F.col(c) + 1e-9, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rounded_sql(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n} + 1e-9, {digits}) + 0.0 AS {n}" for n in names.split())


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = W.partitionBy("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    place = F.row_number().over(user.orderBy("ts", "event_id")).cast("long")
    e = e.withColumn("frame", place + F.floor(place / 16) + F.floor(place / 60) * 4).withColumn("_h", (micros("ts") - F.min(micros("ts")).over(user)) / 3.6e9)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.lit(1.0).alias("people_id"), "frame",
        F.when(F.col("event_id") % 13 != 0, F.col("_h")).alias("frame_timestamp"),
        (F.col("value") / 10).alias("nx_4"), (k / 10).alias("ny_4"), F.when(F.col("event_id") % 7 == 0, 0.1).otherwise(0.9).alias("c_4"),
        ((F.lit(30) - F.col("value")) / 10).alias("nx_7"), ((F.lit(100) - k) / 10).alias("ny_7"), F.when(F.col("event_id") % 11 != 0, 0.8).alias("c_7"),
    )


WIDE_SQL = """
placed_events AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
numbered AS (SELECT *, place + place // 16 + (place // 60) * 4 AS frame, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS h, json_extract(props, '$.k')::INT AS k FROM placed_events),
wide AS (SELECT 'u' || user_id AS id, 1.0::DOUBLE AS people_id, frame, CASE WHEN event_id % 13 <> 0 THEN h END AS frame_timestamp,
  value / 10 AS nx_4, k / 10 AS ny_4, CASE WHEN event_id % 7 = 0 THEN 0.1 ELSE 0.9 END::DOUBLE AS c_4,
  (30 - value) / 10 AS nx_7, (100 - k) / 10 AS ny_7, CASE WHEN event_id % 11 <> 0 THEN 0.8 END::DOUBLE AS c_7
  FROM numbered)"""


def pose_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``multi_data``: three body points for each frame of ``wide`` (1 is the neck, at the origin) and a face point as a decoy."""
    w = wide(spark, sf_dir)
    point = lambda kind, p, x, y, c: F.struct(F.lit(kind).alias("type_points"), F.lit(p).cast("double").alias("points"), F.lit(x).cast("double").alias("nx") if not isinstance(x, str) else F.col(x).alias("nx"), F.lit(y).cast("double").alias("ny") if not isinstance(y, str) else F.col(y).alias("ny"), F.lit(c).cast("double").alias("c") if not isinstance(c, str) else F.col(c).alias("c"))
    body = "pose_keypoints"
    points = F.array(point(body, 1, 0, 0, 0.9), point(body, 4, "nx_4", "ny_4", "c_4"), point(body, 7, "nx_7", "ny_7", "c_7"), point("face_keypoints", 4, 9, 9, 0.9))
    vad = F.when(F.col("frame") % 5 != 0, F.col("frame") % 3 != 0)
    return w.select("id", "people_id", "frame", "frame_timestamp", F.when(F.col("nx_4") > 1, F.col("nx_4") * 10).alias("pitch"), vad.alias("vad"), F.concat(F.lit("p"), (F.length("id") % 3).cast("string")).alias("program_name"), F.explode(points).alias("k")).select(
        "id", "people_id", "frame", "frame_timestamp", "k.*", "pitch", "vad", "program_name"
    )


POSE_SQL = f"""{WIDE_SQL},
spread AS (SELECT *, CASE WHEN nx_4 > 1 THEN nx_4 * 10 END AS pitch, CASE WHEN frame % 5 <> 0 THEN frame % 3 <> 0 END AS vad, 'p' || (length(id) % 3) AS program_name FROM wide),
pose_long AS (
  SELECT id, people_id, frame, frame_timestamp, 'pose_keypoints' AS type_points, 1.0::DOUBLE AS points, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 0.9::DOUBLE AS c, pitch, vad, program_name FROM spread
  UNION ALL SELECT id, people_id, frame, frame_timestamp, 'pose_keypoints', 4.0, nx_4, ny_4, c_4, pitch, vad, program_name FROM spread
  UNION ALL SELECT id, people_id, frame, frame_timestamp, 'pose_keypoints', 7.0, nx_7, ny_7, c_7, pitch, vad, program_name FROM spread
  UNION ALL SELECT id, people_id, frame, frame_timestamp, 'face_keypoints', 4.0, 9.0, 9.0, 0.9, pitch, vad, program_name FROM spread)"""
