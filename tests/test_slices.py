"""Long sequences in slices: results equal those of whole sequences, and no task holds one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinesia.config import GestureConfig
from kinesia.functions.ranks import group_quantiles
from kinesia.operators import gestures as G
from kinesia.operators import guards
from kinesia.operators import sequence as Q

WIDE = "id string, people_id double, frame long, frame_timestamp double, nx_4 double, ny_4 double, c_4 double, nx_7 double, ny_7 double, c_7 double"


def walk(name, frames, seed, lost=0.15):
    """A restless pair of wrists with missing frames, clocks and confidences."""
    r = random.Random(seed)
    t, out = 0.0, []
    for k in frames:
        t += r.choice([0.03, 0.04, 0.05])
        x, y = math.sin(k / 7) * (1 + r.random() / 9), math.cos(k / 5) + r.random() / 9
        out.append((name, 1.0, k, t if r.random() > lost else None, x, y, 0.1 if r.random() < lost else 0.9, -x + r.random() / 5, y + r.random() / 5, None if r.random() < lost else 0.8))
    return out


def table(spark):
    r = random.Random(8)
    rows = walk("dense", range(1, 900), 1)
    rows += walk("holes", sorted(r.sample(range(-700, 900), 700)), 2, 0.3)
    # Gaps beyond the reach, slices without a row, runs of every length at the edges.
    rows += walk("far", [*range(60, 70), *range(120, 131), *range(600, 606), 1500, *range(1530, 1545)], 3, 0.0)
    rows += walk("smooth", range(100, 700), 4, 0.0)
    rows += walk("short", range(1, 40), 5)
    # Still, then moving over an edge, and a clock that is unknown beside one.
    rows += [("still", 1.0, k, None if k in (191, 192, 320) else k / 30, 0.5 if k < 150 or k > 500 else k / 20 % 3, 0.1, 0.9, 0.2 if k < 180 else k / 25 % 2, 0.3, 0.9) for k in range(0, 700)]
    return spark.createDataFrame(rows, WIDE).repartition(5)


def close(a, b, tolerance=1e-7):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    return a == b


def same(one, other, *keys):
    one, other = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (one, other))
    assert one.keys() == other.keys()
    wrong = [(k, c, one[k][c], other[k][c]) for k in one for c in one[k].asDict() if not close(one[k][c], other[k][c])]
    assert not wrong, wrong[:5]


def test_frames_in_slices_equal_whole_sequences(spark):
    wide, config = table(spark), GestureConfig(window=5, order=1, max_gap=2)
    small, whole = (G.gesture_frames(wide, config, True, slice_bits=b) for b in (1, 40))
    same(small, whole, "id", "frame")
    slices = G.frames_in_slices(wide, config, True, slice_bits=1).where("_own").groupBy("id").agg(F.countDistinct("_slice").alias("n"))
    assert {r.id: r.n > 3 for r in slices.collect()} == {"dense": True, "holes": True, "far": True, "smooth": True, "short": False, "still": True}


def test_sequences_in_slices_equal_whole_sequences(spark):
    wide = table(spark)
    small = G.sequence_features(wide, extended=True, slice_bits=1)
    whole = G.gesture_sequences(G.gesture_frames(wide, extended=True), extended=True)
    assert small.columns == whole.columns
    same(small, whole, "id", "people_id")


def test_guards_see_across_the_edges_of_slices(spark):
    def raised(rows):
        with pytest.raises(Exception) as e:
            G.gesture_frames(spark.createDataFrame(rows, WIDE), slice_bits=1).collect()
        return str(e.value)

    rows = walk("a", range(1, 600), 1, 0.0)
    late = [(*r[:3], 0.5, *r[4:]) if r[2] == 400 else r for r in rows]
    assert "clock" in raised(late) and "400" in raised(late)
    # The clock of the slices between is unknown.
    unknown = [(*r[:3], None if 100 < r[2] < 500 else 0.5 if r[2] == 500 else r[3], *r[4:]) for r in rows]
    assert "clock" in raised(unknown)
    assert "conflict" in raised([*rows, (*rows[128][:4], 9.0, *rows[128][5:])])
    assert G.gesture_frames(spark.createDataFrame([*rows, *rows], WIDE), slice_bits=1).count() == 599
    assert "span" in raised([*rows, ("a", 1.0, 2**62, None, 0.0, 0.0, 0.9, 0.0, 0.0, 0.9)])
    assert "no key" in raised([*rows, ("a", 1.0, None, 99.0, 0.0, 0.0, 0.9, 0.0, 0.0, 0.9)])


def test_frames_at_the_ends_of_their_range(spark):
    rows = walk("low", range(-(2**63), -(2**63) + 40), 1, 0.0) + walk("high", range(2**63 - 40, 2**63), 2, 0.0)
    out = G.gesture_frames(spark.createDataFrame(rows, WIDE))
    assert {r.id: r["count"] for r in out.groupBy("id").count().collect()} == {"low": 40, "high": 40}


def test_a_long_sequence_spreads_over_all_tasks(spark):
    wide = spark.range(40_000).select(F.lit("hot").alias("id"), F.lit(1.0).alias("people_id"), (F.col("id") + 1).alias("frame"), (F.col("id") / 30).alias("frame_timestamp"), *[(F.sin(F.col("id") / (k + 3)) / 2 + 0.5).alias(c) for k, c in enumerate(("nx_4", "ny_4", "c_4", "nx_7", "ny_7", "c_7"))])
    d = G.frames_in_slices(wide.repartition(4), slice_bits=8)
    exchanged = d.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(exchanged) == 2 and min(r["count"] for r in exchanged) > 15_000, "the tests' session has two shuffle partitions"


def test_slices_must_be_longer_than_what_rows_depend_on(spark):
    with pytest.raises(ValueError):
        Q.with_slices(spark.createDataFrame([], WIDE), 4, 8)
    assert guards.checked_slices(spark.createDataFrame([], WIDE), 8, 8).count() == 0


@pytest.mark.parametrize("accuracy", [10, 1000])
def test_group_quantiles_equal_exact_ones(spark, accuracy):
    r = random.Random(2)
    rows = [(k, r.choice([r.gauss(0, 1), 1.0, float(r.randrange(5))]), None if r.random() < 0.5 else r.random()) for k in "aaaaaaab" for _ in range(400)] + [("c", None, 2.0), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, `y.z` double").repartition(4)
    shares = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = {(q.g, q.column, q.k): (q.n, q.value) for q in group_quantiles(df.where("g IS NOT NULL"), ["g"], ["x", "y.z"], shares, accuracy).collect()}
    for column in ("x", "y.z"):
        for q in df.where("g IS NOT NULL").groupBy("g").agg(F.count(f"`{column}`").alias("n"), F.percentile(f"`{column}`", F.array(*[F.lit(s) for s in shares])).alias("p")).collect():
            for k in range(len(shares)):
                assert (q.n == 0 and (q.g, column, k) not in got) or (got[q.g, column, k][0] == q.n and close(got[q.g, column, k][1], q.p[k]))
