"""Checks and collapses of the long keypoint table, visibility gate, prescreen and audit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinesia.config import VisibilityConfig
from kinesia.functions.ranks import with_place
from kinesia.operators.guards import DataError, require_columns
from kinesia.schema import KEYS, NECK_TOLERANCE

FRAME = (*KEYS, "frame")


def body(long: DataFrame, points: tuple[int, ...] = (1, 4, 7)) -> DataFrame:
    """The body keypoints; face and hand models number their points from 0 too."""
    return long.where((F.col("type_points") == "pose_keypoints") & F.col("points").isin(list(points)))


def trusted(least: float = 0.2) -> Column:
    return (F.col("c") > 0) & (F.col("c") >= least)


def wrist_coverage(long: DataFrame, least: float = 0.2) -> DataFrame:
    """Share of a clip's frames in which each wrist is trusted, in per cent."""
    b = body(long)
    seen = lambda p: F.count_distinct(F.when((F.col("points") == p) & trusted(least), F.struct("people_id", "frame")))
    n = F.count_distinct("people_id", "frame")
    return b.groupBy("id").agg(n.alias("n_frames"), F.round(100 * seen(4) / n, 1).alias("right_pct"), F.round(100 * seen(7) / n, 1).alias("left_pct"))


def collapse_frames(long: DataFrame) -> DataFrame:
    """One row for each frame of the denormalised table: what is repeated on each of its rows, and flags as three-state booleans."""
    columns = set(long.columns)
    flag = lambda c, f: (f(F.expr(f"try_cast({c} AS boolean)")) if c in columns else F.lit(None).cast("boolean")).alias(c)
    constant = [F.min(c).alias(c) for c in ("words", "program_name", "time_range") if c in columns]
    number = [F.max(c).alias(c) for c in ("frame_timestamp", "pitch", "intensity", "harmonicity") if c in columns]
    return long.groupBy(*FRAME).agg(*number, flag("vad", F.bool_or), flag("voice_present", F.bool_or), *constant)


def conflicts(long: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Frames whose rows disagree on a column that each frame has once; a null is a value of its own."""
    differ = [F.count_distinct(F.struct(c)) > 1 for c in columns]
    out = long.groupBy(*FRAME).agg(*[d.alias(f"{c}_conflict") for c, d in zip(columns, differ, strict=True)])
    any_of = F.lit(False)
    for c in columns:
        any_of = any_of | F.col(f"{c}_conflict")
    return out.where(any_of)


def duplicate_rows(long: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """For each key with several rows: how many, and how many different ones; more than one different row is a conflict."""
    # Nearly every key is its own, so hash tables would hold the whole input, three times over for a distinct count; one sort spills
    # instead, and a key's last row has its numbers.
    w = W.partitionBy(*keys).orderBy(*values)
    x = long.withColumns({"n_rows": F.row_number().over(w).cast("long"), "n_different": F.dense_rank().over(w).cast("long"), "_last": F.lead(F.lit(1)).over(w).isNull()})
    return x.where("_last AND n_rows > 1").select(*keys, "n_rows", "n_different")


def require_none(bad: DataFrame, message: str) -> None:
    """Raise if ``bad`` has a row; one job, one row to the driver."""
    row = bad.limit(1).collect()
    if row:
        raise DataError(f"{message}: {row[0].asDict()}")


def clock_stats(long: DataFrame, least: float = 0.2) -> DataFrame:
    """Rows, frames and trusted wrists without a clock, for each clip."""
    untimed = F.col("frame_timestamp").isNull()
    frame = F.struct("people_id", "frame")
    return body(long, (4, 7)).groupBy("id").agg(
        F.count_if(untimed).alias("rows_untimed"), F.count_distinct(F.when(untimed, frame)).alias("frames_untimed"), F.count_if(untimed & trusted(least)).alias("trusted_untimed")
    )


def origin_check(long: DataFrame, least: float = 0.2, tolerance: float = NECK_TOLERANCE) -> DataFrame:
    """How many trusted necks of each sequence lie off the origin, how many there are, and impossible confidences."""
    neck = (F.col("points") == 1) & trusted(least)
    off = neck & ((F.abs("nx") > tolerance) | (F.abs("ny") > tolerance))
    bad = F.col("c").isNotNull() & ~F.col("c").between(0, 1)
    wrist = F.col("points").isin(4, 7) & F.col("nx").isNotNull() & F.col("ny").isNotNull() & (F.col("c") > 0)
    x = body(long).groupBy(*KEYS).agg(F.count_if(neck).alias("n_neck"), F.count_if(off).alias("n_off_origin"), F.count_if(bad).alias("n_bad_confidence"), F.count_if(wrist).alias("n_wrists"))
    return x.withColumn("verdict", F.when(F.col("n_bad_confidence") > 0, "bad confidence").when(F.col("n_off_origin") > 0, "off origin").when(F.col("n_neck") == 0, "unverifiable").otherwise("verified"))


def require_origin(long: DataFrame) -> None:
    """Raise for a sequence with wrists whose origin is not verified to be the neck."""
    require_none(origin_check(long).where("verdict <> 'verified' AND (n_wrists > 0 OR verdict <> 'unverifiable')"), "the coordinates are not those from the neck")


LONG = ("id", "people_id", "frame", "frame_timestamp", "type_points", "points", "nx", "ny", "c")


def pivot_wide(long: DataFrame) -> DataFrame:
    """Long rows to one row a frame; a point that is missing gives nulls, a null clock stays one.

    Equal rows count once.  Rows of one point that differ, and a frame with two clocks or with and without one, raise when reached.
    """
    require_columns(long, LONG, "the keypoint table")
    value, clock = F.struct("nx", "ny", "c"), F.struct("frame_timestamp")
    low, high = ({p: f(F.when(F.col("points") == p, value)) for p in (4, 7)} for f in (F.min, F.max))
    differ = (low[4] != high[4]) | (low[7] != high[7]) | (F.min(clock) != F.max(clock))
    x = body(long).groupBy(*FRAME).agg(F.min(clock)["frame_timestamp"].alias("frame_timestamp"), *[low[p][c].alias(f"{c}_{p}") for p in (4, 7) for c in ("nx", "ny", "c")], F.coalesce(differ, F.lit(False)).alias("_differ"))
    stop = F.raise_error(F.concat(F.lit("conflicting rows for one frame: "), F.concat_ws(" / ", "id", F.col("people_id").cast("string"), F.col("frame").cast("string")))).cast("boolean")
    return x.where(F.when(F.col("_differ"), stop).otherwise(F.lit(True))).drop("_differ")


def visibility_gate(long: DataFrame, expected: DataFrame, config: VisibilityConfig = VisibilityConfig()) -> DataFrame:
    """Decision for each clip of expected(id, n_frames): visible frames of each point against all expected frames.

    data_error (no or more frames than expected) goes before multi_person (two bodies in a frame), and that before coverage; the
    limit is inclusive and compared in whole numbers.
    """
    points = config.points
    b = body(long, points)
    ok = trusted(config.min_confidence) & F.col("nx").isNotNull() & F.col("ny").isNotNull()
    people = b.groupBy("id", "frame").agg(F.count_distinct("people_id").alias("p"))
    found = b.groupBy("id").agg(F.count_distinct("frame").alias("n_seen"), *[F.count_distinct(F.when((F.col("points") == p) & ok, F.col("frame"))).alias(f"visible_{p}") for p in points])
    x = expected.join(found, "id", "left").join(people.groupBy("id").agg(F.max("p").alias("most_people")), "id", "left")
    x = x.fillna(0, ["n_seen", "most_people", *[f"visible_{p}" for p in points]])
    low = F.lit(False)
    for p in points:
        low = low | (F.col(f"visible_{p}") * 100 < F.col("n_frames") * config.percent)
    error = (F.col("n_frames") <= 0) | (F.col("n_seen") > F.col("n_frames"))
    return x.withColumn("decision", F.when(error, "data_error").when(F.col("most_people") > 1, "multi_person").when(low, "low_coverage").otherwise("accepted"))


def people_class(long: DataFrame) -> DataFrame:
    """The bucket of each clip: its highest person number."""
    return long.groupBy("id").agg(F.max("people_id").cast("long").alias("n_persons"))


def prescreen(detections: DataFrame, least: float = 0.5) -> DataFrame:
    """Scores of each clip from detections(video, frame, nose, left, right): a row for each person found in a sampled frame.

    strict counts frames with exactly one person; speaker takes each frame's most certain nose.  Hits are shares of all frames; a
    frame without a person has one row of nulls.  A clip without frames has no row.
    """
    person = F.when(F.col("nose").isNotNull() | F.col("left").isNotNull() | F.col("right").isNotNull(), F.struct(F.coalesce("nose", F.lit(-1.0)).alias("nose"), "left", "right"))
    f = detections.groupBy("video", "frame").agg(F.count(person).alias("people"), F.max(person).alias("top"))
    right, left = F.coalesce(F.col("top.right") >= least, F.lit(False)), F.coalesce(F.col("top.left") >= least, F.lit(False))
    one = F.col("people") == 1
    n = F.count(F.lit(1))
    share = lambda c: F.count_if(c) / n
    return f.groupBy("video").agg(
        n.alias("n_sampled"), F.max("people").alias("max_people"), share(one & right).alias("right"), share(one & left).alias("left"), share(one & right & left).alias("both"),
        share(right).alias("sp_right"), share(left).alias("sp_left"), share(right & left).alias("sp_both"), share(right | left).alias("sp_any"),
    )


def rank_clips(scores: DataFrame) -> DataFrame:
    """Best first: sp_any, sp_both, name; a missing score comes after 0."""
    key = lambda c: -F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(-1.0))
    x = with_place(scores, "rank", key("sp_any"), key("sp_both"), F.col("video"))
    return x.withColumn("rank", F.col("rank") + 1)


def admit(scores: DataFrame, any_least: float = 0.6) -> DataFrame:
    """admitted: sp_any reaches the limit (a missing score is derived from the sides if it can be); rejected: it is known and below.

    A clip without any score is neither; ``audited`` counts it as rejected.
    """
    derived = F.coalesce("sp_any", F.greatest("sp_right", "sp_left"))
    x = scores.withColumn("score", F.when(~F.isnan(derived), derived))
    return x.withColumns({"admitted": F.coalesce(F.col("score") >= any_least, F.lit(False)), "rejected": F.coalesce(F.col("score") < any_least, F.lit(False)), "audited": ~F.coalesce(F.col("score") >= any_least, F.lit(False))})


#: The limit with which each criterion admitted clips.
LIMITS = {"sp_any": 0.6, "sp_both": 0.8}


def resolve_rule(criterion: str | None = None, limit: float | None = None, least_both: float | None = None) -> tuple[str, float]:
    """(criterion, limit) of the rule that a delivery was made by; ``least_both`` alone names the stricter criterion, so nothing may contradict it."""
    if least_both is not None:
        if limit is not None or criterion not in (None, "sp_both"):
            raise ValueError("least_both stands for sp_both and its own limit")
        return "sp_both", float(least_both)
    name = criterion or "sp_any"
    if name not in LIMITS:
        raise ValueError(f"unknown criterion {name}")
    return name, LIMITS[name] if limit is None else float(limit)


def usable(scores: DataFrame) -> DataFrame:
    """(criterion, n, usable): clips, and those with a number for the criterion; sp_any may come from the sides."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    value = {"sp_any": F.coalesce(known("sp_any"), F.greatest(known("sp_right"), known("sp_left"))), "sp_both": known("sp_both")}
    counts = scores.agg(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(c) for c, v in value.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), "n", F.col(c).alias("usable")) for c in value])).alias("r")).select("r.*")


def require_usable(scores: DataFrame, criterion: str) -> DataFrame:
    """``scores``, unless no clip has a number for the criterion: then all would count as rejected."""
    require_none(usable(scores).where((F.col("criterion") == criterion) & (F.col("usable") == 0)), "no clip has a score for the criterion")
    return scores


def systematic_sample(ranked: DataFrame, n: int, order: list[Column], total: int) -> DataFrame:
    """``n`` evenly spaced rows of the ranked list of ``total`` rows, both ends included; all of them if there are no more.

    Places are i * (total - 1) / (n - 1), rounded half to even; with n <= total no two places are equal.
    """
    x = with_place(ranked, "place", *order)
    if n >= total:
        return x
    if n == 1:
        return x.where("place = 0")
    places = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)})
    return x.where(F.col("place").isin(places))


def verdict(values: Column, limits: list[float], percent: float) -> Column:
    """struct(all_pass, max_pass, passed): of an array of shares, whether all and the greatest reach ``percent``, and which limits
    the least reaches; nulls and NaN don't count, and no value passes nothing."""
    known = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    some = F.size(known) > 0
    low = F.array_min(known)
    passed = F.concat_ws(",", *[F.when(some & (low >= x), F.lit(f"{x:g}")) for x in limits])
    return F.struct((some & F.forall(known, lambda v: v >= percent)).alias("all_pass"), F.coalesce(some & (F.array_max(known) >= percent), F.lit(False)).alias("max_pass"), passed.alias("passed"))


def exact_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper-Pearson limits of a share, by bisection of the binomial distribution."""
    i = np.arange(n + 1)
    ways = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])

    def up_to(j: int, p: float) -> float:
        return float(np.exp(ways[: j + 1] + i[: j + 1] * math.log(p) + (n - i[: j + 1]) * math.log1p(-p)).sum())

    def solve(goal: float, j: int) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            if mid in (low, high) or mid >= 1:
                break
            low, high = (mid, high) if up_to(j, mid) > goal else (low, mid)
        return (low + high) / 2

    return (0.0 if k == 0 else solve(1 - alpha / 2, k - 1)), (1.0 if k == n else solve(alpha / 2, k))


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def exact_interval_udf(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exact_interval(int(a), int(b)) if b > 0 else (None, None) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


def audit_summary(audit: DataFrame) -> DataFrame:
    """Of audit(state, passes): clips measured, false negatives among them, and the exact interval of their share."""
    x = audit.agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("state") == "measured").alias("measured"), F.count_if((F.col("state") == "measured") & F.col("passes")).alias("missed"))
    return x.withColumn("i", exact_interval_udf("missed", "measured")).select("planned", "measured", "missed", F.col("i.low").alias("low"), F.col("i.high").alias("high"))


def repeated_failure(states: DataFrame, n: int = 3) -> DataFrame:
    """Whether a run's last ``n`` states(run, at, state) are equal and not measured."""
    last = states.withColumn("_k", F.row_number().over(W.partitionBy("run").orderBy(F.desc("at")))).where(F.col("_k") <= n)
    return last.groupBy("run").agg((F.count(F.lit(1)) == n).alias("full"), (F.count_distinct("state") == 1).alias("same"), F.max("state").alias("state")).select("run", (F.col("full") & F.col("same") & (F.col("state") != "measured")).alias("stop"))


def prune_ghosts(candidates: DataFrame, criterion: str = "todo", persistence: float = 0.25, least: float = 0.2) -> DataFrame:
    """Which candidates(id, frame, person, n_reliable, nose, shoulders, black) of a frame to drop.

    The best candidate of a frame has the most reliable points, then the most certain nose, then comes first.  In clips where more
    than ``persistence`` of the frames have several candidates the doubt is sustained, and a frame is pruned to its best only if
    each other one may be dropped by the criterion; else all others are pruned.  torso: under 6 reliable points and no shoulder;
    black: more than half of its points on black.
    """
    thin = (F.col("n_reliable") < 6) & ~F.col("shoulders")
    dark = F.coalesce(F.col("black") > 0.5, F.lit(False))
    # The names of the criteria.
    droppable = {"todo": thin | dark, "torso": thin, "negro": dark, "nada": F.lit(False)}[criterion]
    frame = W.partitionBy("id", "frame")
    x = candidates.withColumn("droppable", droppable)
    x = x.withColumn("best", F.row_number().over(frame.orderBy(F.desc("n_reliable"), F.desc(F.coalesce("nose", F.lit(-1.0))), "person")) == 1)
    x = x.withColumn("ambiguous", F.count(F.lit(1)).over(frame) > 1)
    clip = x.groupBy("id").agg((F.count_distinct(F.when(F.col("ambiguous"), F.col("frame"))) / F.count_distinct("frame")).alias("share"))
    x = x.join(clip, "id").withColumn("sustained", F.col("share") > persistence)
    clear = F.min(F.col("best") | F.col("droppable")).over(frame)
    return x.withColumn("kept", F.when(~F.col("ambiguous") | F.col("best"), True).when(F.col("sustained"), ~clear).otherwise(False))
