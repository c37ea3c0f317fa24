"""Words, voice activity and voice tracks laid on the frames of a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LARGEST_GAP = 0.1


def frame_intervals(clips: DataFrame) -> DataFrame:
    """For clips(id, n_frames, fps): frame k covers (k - 1) / fps to k / fps, from 1."""
    x = clips.select("id", "fps", F.explode(F.sequence(F.lit(1), F.col("n_frames").cast("int"))).alias("frame"))
    return x.select("id", F.col("frame").cast("long").alias("frame"), ((F.col("frame") - 1) / F.col("fps")).alias("start"), (F.col("frame") / F.col("fps")).alias("end"))


def bins(first: Column, last: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))


def overlap_join(left: DataFrame, right: DataFrame, width: float = 1.0) -> DataFrame:
    """Pairs of left(id, start, end, ...) and right(id, start, end, ...) that overlap, ends included.

    Intervals meet in bins of ``width``, so the join is on equal keys; each pair counts in the first bin they share.  The right
    side's columns other than id get the prefix r_.  The join is a sort-merge join whatever the sizes look like: Spark takes a
    table of clips for small before its frames are made, and would broadcast all frames.
    """
    l = left.withColumn("_bin", bins(F.col("start"), F.col("end"), width))  # noqa: E741
    r = right.select("id", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "id"])
    r = r.withColumn("_bin", bins(F.col("r_start"), F.col("r_end"), width))
    first = F.floor(F.greatest("start", "r_start") / width)
    return l.join(r.hint("merge"), ["id", "_bin"]).where((F.col("r_start") <= F.col("end")) & (F.col("r_end") >= F.col("start")) & (F.col("_bin") == first)).drop("_bin")


def words_on_frames(frames: DataFrame, words: DataFrame, width: float = 1.0) -> DataFrame:
    """(id, frame, words, scores): the words that sound during each frame, in order of time; frames without words are left out."""
    x = overlap_join(frames, words, width)
    ordered = F.sort_array(F.collect_list(F.struct("r_start", "r_word", "r_score")))
    return x.groupBy("id", "frame").agg(ordered.alias("w")).select("id", "frame", F.concat_ws(", ", "w.r_word").alias("words"), F.concat_ws(", ", F.transform("w.r_score", lambda s: s.cast("string"))).alias("scores"))


def voice_activity(frames: DataFrame, segments: DataFrame, measured: DataFrame, width: float = 600.0) -> DataFrame:
    """frames(id, frame, t, ...) with vad: whether a segment(id, start, end) holds t; null for clips that are not in measured(id).

    Frames and starts of segments lie in one order of time, with the greatest end so far: it is at t or later just if a segment
    holds t.  The order is cut into slices of ``width`` seconds, and a slice begins with the greatest end of those before it, so
    a segment is one row however long it is, and a long clip spreads over tasks.  A frame without a time is in no segment.
    """
    slice_of = lambda t: F.floor(F.col(t) / width)
    s = segments.where("start IS NOT NULL AND end IS NOT NULL").select("id", slice_of("start").alias("_slice"), F.col("start").alias("_t"), F.col("end").alias("_end"))
    points = frames.select(F.col("id"), slice_of("t").alias("_slice"), F.col("t").alias("_t"), F.struct(*frames.columns).alias("_row"))
    each = points.select("id", "_slice", F.lit(None).cast("double").alias("_end")).union(s.select("id", "_slice", "_end")).groupBy("id", "_slice").agg(F.max("_end").alias("_end"))
    before = F.max("_end").over(W.partitionBy("id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    begun = each.select("id", "_slice", F.lit(float("-inf")).alias("_t"), before.alias("_end")).where("_end IS NOT NULL")
    events = points.unionByName(s, allowMissingColumns=True).unionByName(begun, allowMissingColumns=True)
    # A RANGE frame takes in the segments that start at the very time of a frame.
    reach = F.max("_end").over(W.partitionBy("id", "_slice").orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow))
    x = events.withColumn("_hit", F.coalesce(reach >= F.col("_t"), F.lit(False))).where("_row IS NOT NULL").select("id", "_row", "_hit")
    x = x.join(measured.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    return x.select("_row.*", F.when(F.col("_known"), F.col("_hit")).alias("vad"))


def silence_to_null(pitch: Column) -> Column:
    return F.when(pitch > 0, pitch)


def align_track(samples: DataFrame, grid: DataFrame, largest_gap: float = LARGEST_GAP) -> DataFrame:
    """grid(id, frame, t) with ``value``: samples(id, seq, t, v) interpolated linearly within runs, never beyond them.

    Samples without a value or a time are dropped; of equal times the first by seq counts; a gap of more than ``largest_gap`` ends
    a run, and a run needs two samples.  Both ends of a run are inside it.
    """
    s = samples.where("v IS NOT NULL AND t IS NOT NULL").groupBy("id", "t").agg(F.min(F.struct("seq", "v")).alias("s")).select("id", "t", F.col("s.v").alias("v"))
    order = W.partitionBy("id").orderBy("t")
    s = s.withColumn("_new", (F.coalesce(F.col("t") - F.lag("t").over(order) > largest_gap, F.lit(True))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    s = s.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id", "_run"))).where("_n >= 2")
    mark = F.struct("t", "v", "_run")
    both = s.select("id", "t", F.lit(None).cast("long").alias("frame"), mark.alias("m")).unionByName(grid.select("id", "t", "frame", F.lit(None).alias("m")), allowMissingColumns=True)
    # Both look back, one from each side, so a row costs the same however long the clip is.  RANGE frames take in the samples at the
    # very time of a frame.
    near = lambda order: F.last("m", ignorenulls=True).over(W.partitionBy("id").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumn("_p", near(F.asc("t"))).withColumn("_q", near(F.desc("t")))
    inside = F.col("_p._run") == F.col("_q._run")
    span = F.col("_q.t") - F.col("_p.t")
    value = F.when(inside & (span == 0), F.col("_p.v")).when(inside, F.col("_p.v") + (F.col("t") - F.col("_p.t")) / F.nullif(span, F.lit(0.0)) * (F.col("_q.v") - F.col("_p.v")))
    return both.where("frame IS NOT NULL").select("id", "frame", "t", value.alias("value"))


def voice_present(frames: DataFrame, tracked: DataFrame, pitch: str = "pitch") -> DataFrame:
    """Whether a frame has pitch; null for clips without any pitch track (tracked: id)."""
    x = frames.join(tracked.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    return x.withColumn("voice_present", F.when(F.col("_t"), F.col(pitch).isNotNull())).drop("_t")


def merge_clip(pose: DataFrame, prosody: DataFrame, words: DataFrame, pose_base: int = 0) -> DataFrame:
    """Pose rows with the prosody and the words of their frame; frames that only these have are dropped, as they have no id.

    Pose counts frames from ``pose_base``; prosody, of which the first row of a frame by ``seq`` counts, and words count from 1.
    """
    first = prosody.groupBy("id", "frame").agg(F.min_by(F.struct(*[c for c in prosody.columns if c not in ("id", "frame", "seq")]), "seq").alias("p")).select("id", "frame", "p.*")
    return pose.withColumn("frame", F.col("frame") + (1 - pose_base)).join(first, ["id", "frame"], "left").join(words, ["id", "frame"], "left")


def discard_policy(clips: DataFrame, percent: float = 5.0, strict: bool = False) -> DataFrame:
    """Of clips(bucket, id, prosody_rows) (null: no file): tally, share and decision for each bucket.

    fail: all were discarded, or any under ``strict``, or more than ``percent`` (0 switches that off).
    """
    reason = F.when(F.col("prosody_rows").isNull(), "missing prosody").when(F.col("prosody_rows") == 0, "empty prosody")
    x = clips.withColumn("reason", reason).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_clips"), F.count("reason").alias("n_discarded"), F.count_if(F.col("reason") == "missing prosody").alias("n_missing"), F.count_if(F.col("reason") == "empty prosody").alias("n_empty")
    )
    share = F.col("n_discarded") * 100.0 / F.col("n_clips")
    over = (F.lit(percent) > 0) & (share > percent)
    return x.withColumn("pct", F.round(share, 2)).withColumn("decision", F.when(F.col("n_discarded") == F.col("n_clips"), "fail: all").when(F.lit(strict) & (F.col("n_discarded") > 0), "fail: strict").when(over, "fail: threshold").otherwise("pass"))
