"""Small views of the tables: plots' scales, recoded points, person filter, states of a plan, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rescaled(df: DataFrame, column: str, by: str = "id") -> DataFrame:
    """Add ``{column}_norm``: the value between its clip's least and greatest; null where these are equal."""
    w = W.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(f"{column}_norm", (F.col(column) - low) / F.nullif(high - low, F.lit(0.0)))


def point_kind(type_points: Column) -> Column:
    """Without its suffix; a hand that names no side is the left one."""
    kind = F.regexp_replace(type_points, "_keypoints$", "")
    return F.when(kind == "hand", "hand_left").otherwise(kind)


def shown_words(words: Column) -> Column:
    return F.when(words.isNull() | (words == ""), "###").otherwise(words)


def word_order(df: DataFrame) -> DataFrame:
    """(id, word, place): each clip's shown words by their first frame; of one frame's words the first in the alphabet."""
    first = df.select("id", "frame", shown_words(F.col("words")).alias("word")).groupBy("id", "word").agg(F.min("frame").alias("_f"))
    return first.select("id", "word", F.row_number().over(W.partitionBy("id").orderBy("_f", "word")).cast("long").alias("place"))


def good_person(people: Column, hands: bool = False) -> Column:
    """Whether a frame shows exactly one person, whose nose (0), shoulders (5, 6) and, if asked for, wrists (9, 10) are found.

    people: an array of arrays of (x, y); a point at the origin was not found.
    """
    wanted = (0, 5, 6, 9, 10) if hands else (0, 5, 6)
    seen = lambda i: (F.get(people[0], F.lit(i))["x"] != 0) | (F.get(people[0], F.lit(i))["y"] != 0)
    ok = seen(wanted[0])
    for i in wanted[1:]:
        ok = ok & seen(i)
    return (F.size(people) == 1) & F.coalesce(F.when(F.size(people) == 1, ok), F.lit(False))


def person_filter(frames: DataFrame, more_than: int = 5) -> DataFrame:
    """Of frames(video, people, good): clips with more good frames than that and never a second person pass."""
    x = frames.groupBy("video").agg(F.count_if("good").alias("n_good"), F.max("people").alias("max_people"))
    return x.withColumn("passes", (F.col("n_good") > more_than) & (F.col("max_people") == 1))


def planned_states(plan: DataFrame, measured: DataFrame) -> DataFrame:
    """Each planned clip with its state; those that were not tried yet say so."""
    return plan.join(measured, "video", "left").withColumn("state", F.coalesce("state", F.lit("not tried")))


def audit_state(known: Column, file: Column, failed: Column, bad: Column) -> Column:
    """A clip's state in an audit, by what is known of it, the first that holds: reused, missing, failed, data_error, measured."""
    return F.when(known, "reused").when(~file, "missing").when(failed, "failed").when(bad, "data_error").otherwise("measured")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def windows_by_centre(windows: DataFrame) -> DataFrame:
    """The raw durations that share a program and a centre; inverted windows count like others, and are tallied."""
    x = windows.where("raw_start IS NOT NULL AND raw_end IS NOT NULL")
    inverted = F.count_if(F.col("raw_end") <= F.col("raw_start"))
    lengths = F.sort_array(F.collect_list(F.round(F.col("raw_end") - F.col("raw_start"), 6)))
    return x.groupBy(F.regexp_replace("program", r"\.txt$", "").alias("program"), "centre").agg(lengths.alias("durations"), inverted.alias("n_inverted"))


def table_counts(long: DataFrame) -> DataFrame:
    """Rows and clips of each bucket of persons."""
    clips = long.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("people_id").cast("long").alias("n_persons"))
    return clips.groupBy("n_persons").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_clips"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cost(frames: Column, body: float = 0.0, face_and_hands: float = 0.0) -> Column:
    """Seconds that pose estimation will take, at seconds for each frame of either kind."""
    return frames * (body + face_and_hands)
