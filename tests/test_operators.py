"""Checks, alignment, labels and delivery on small cases; every query against its SQL is the driver's own test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesia.operators import align, delivery, labels, legacy, qc
from kinesia.plans.registry import ORACLES, QUERIES


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_every_query_has_sql():
    from kinesia.plans import catalog

    assert catalog.FLAGSHIP in QUERIES and set(QUERIES) == set(ORACLES)


def test_exact_interval():
    low, high = qc.exact_interval(1, 16)
    assert low == pytest.approx(0.00158, abs=1e-4) and high == pytest.approx(0.3023, abs=1e-3)
    assert qc.exact_interval(0, 10)[0] == 0 and qc.exact_interval(10, 10)[1] == 1
    assert qc.exact_interval(0, 10)[1] == pytest.approx(1 - 0.025 ** 0.1)
    low, high = qc.exact_interval(3000, 100_000)
    assert low < 0.03 < high and high - low < 0.003


def test_frame_collapse_states(spark):
    long = frame(spark, "id string, people_id int, frame int, vad int, pitch double, voice_present boolean", ("a", 0, 1, 1, 2.0, True), ("a", 0, 1, 1, 2.0, True), ("a", 0, 2, 0, None, False), ("a", 0, 3, None, None, None))
    rows = {r.frame: r for r in qc.collapse_frames(long).collect()}
    assert [rows[k].vad for k in (1, 2, 3)] == [True, False, None] == [rows[k].voice_present for k in (1, 2, 3)]
    assert qc.collapse_frames(long.drop("voice_present")).first().voice_present is None


def test_guards(spark):
    ok = frame(spark, "id string", ("a",))
    qc.require_none(ok.limit(0), "none")
    with pytest.raises(qc.DataError, match="a clip"):
        qc.require_none(ok, "a clip")
    with pytest.raises(Exception, match="id is not unique"):
        delivery.one_to_one(ok.union(ok), "id").collect()


def test_visibility_limit_is_inclusive(spark):
    rows = [("a", 0.0, f, "pose_keypoints", p, 0.1, 0.1, 0.9) for f in range(4) for p in (4.0, 7.0)]
    long = frame(spark, "id string, people_id double, frame int, type_points string, points double, nx double, ny double, c double", *rows)
    n = lambda k: qc.visibility_gate(long, frame(spark, "id string, n_frames int", ("a", k), ("b", 5))).orderBy("id").collect()
    assert [r.decision for r in n(10)] == ["accepted", "low_coverage"] and n(11)[0].decision == "low_coverage" and n(3)[0].decision == "data_error"
    two = long.union(long.withColumn("people_id", F.lit(1.0)).where("frame = 0"))
    assert qc.visibility_gate(two, frame(spark, "id string, n_frames int", ("a", 4))).first().decision == "multi_person"


def test_prescreen_mixed_batch(spark):
    d = frame(spark, "video string, frame int, nose double, left double, right double", ("v", 0, 0.9, 0.8, 0.8), ("v", 1, 0.9, 0.8, 0.8), ("v", 1, 0.3, 0.1, 0.1), ("v", 2, None, None, None))
    r = qc.prescreen(d).first()
    assert [round(x * 3) for x in (r.right, r.left, r.both, r.sp_right, r.sp_left, r.sp_both)] == [1, 1, 1, 2, 2, 2] and r.max_people == 2 and r.n_sampled == 3


def test_ranks_put_missing_scores_after_zero(spark):
    s = frame(spark, "video string, sp_any double, sp_both double", ("kabc", 1.0, 1.0), ("kimmel", 0.5, 0.2), ("empataB", 0.0, 0.0), ("empataA", 0.0, 0.0), ("corrupto", None, None), ("z", float("nan"), None))
    assert [r.video for r in qc.rank_clips(s).orderBy("rank").collect()] == ["kabc", "kimmel", "empataA", "empataB", "corrupto", "z"]


def test_systematic_sample(spark):
    s = spark.range(10).withColumnRenamed("id", "k")
    pick = lambda n: sorted(r.k for r in qc.systematic_sample(s, n, [F.col("k")], 10).collect())
    assert pick(4) == [0, 3, 6, 9] and pick(3) == [0, 4, 9] and pick(20) == list(range(10)) and pick(1) == [0]


def ghosts(spark, ambiguous, of, thin=True):
    rows = [("c", f, 0, 12, 0.9, True, 0.0) for f in range(of)] + [("c", f, 1, 3 if thin else 9, 0.5, False, 0.0) for f in range(ambiguous)]
    return frame(spark, "id string, frame int, person int, n_reliable int, nose double, shoulders boolean, black double", *rows)


def test_ghosts(spark):
    kept = lambda d, c="todo": qc.prune_ghosts(d, c).where("kept").count()
    assert kept(ghosts(spark, 2, 20)) == 20 and kept(ghosts(spark, 2, 20, False), "nada") == 20
    assert kept(ghosts(spark, 8, 10)) == 10 and kept(ghosts(spark, 8, 10, False)) == 18 and kept(ghosts(spark, 8, 10), "nada") == 18


def test_align_track(spark):
    t = [i * 0.005 for i in range(100)] + [1.0 + i * 0.005 for i in range(100)]
    samples = frame(spark, "id string, seq long, t double, v double", *[("a", i, x, 100.0 + x) for i, x in enumerate(t)], ("a", 900, 0.25, 999.0), ("a", 901, 2.0, 5.0), ("a", 902, None, 1.0), ("a", 903, 0.2601, None))
    grid = frame(spark, "id string, frame long, t double", *[("a", i, i * 0.01) for i in range(230)], ("b", 0, 0.1))
    got = {(r.id, r.frame): r.value for r in align.align_track(samples, grid).collect()}
    for i in range(230):
        inside = 0 <= i * 0.01 <= 0.495 + 1e-12 or 1.0 - 1e-12 <= i * 0.01 <= 1.495 + 1e-12
        assert (got["a", i] is not None) == inside, i
        if inside:
            assert got["a", i] == pytest.approx(100 + i * 0.01)
    assert got["b", 0] is None and len(got) == 231


def test_voice_activity_is_three_state(spark):
    frames = frame(spark, "id string, frame long, t double", ("a", 1, 0.1), ("a", 2, 1.5), ("b", 1, 0.1), ("c", 1, 0.1))
    got = align.voice_activity(frames, frame(spark, "id string, start double, end double", ("a", 0.1, 1.0)), frame(spark, "id string", ("a",), ("b",)))
    assert {(r.id, r.frame): r.vad for r in got.collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): False, ("c", 1): None}


def test_overlaps_count_once(spark):
    left = frame(spark, "id string, frame long, start double, end double", ("a", 1, 0.0, 5.0), ("a", 2, 5.0, 6.0))
    right = frame(spark, "id string, word string, score double, start double, end double", ("a", "x", 1.0, 0.5, 4.5), ("a", "y", 1.0, 5.0, 5.0), ("a", "z", 1.0, 7.0, 8.0))
    assert {(r.frame, r.words) for r in align.words_on_frames(left, right).collect()} == {(1, "x, y"), (2, "y")}


def test_discard_policy(spark):
    clips = lambda *n: frame(spark, "bucket string, id int, prosody_rows int", *[("b", i, x) for i, x in enumerate(n)])
    decide = lambda df, **k: align.discard_policy(df, **k).first().decision
    two_of_ten = clips(None, 0, *[5] * 8)
    assert decide(clips(1, 2)) == "pass" and decide(two_of_ten) == "fail: threshold" and decide(two_of_ten, percent=0) == "pass"
    assert decide(two_of_ten, percent=0, strict=True) == "fail: strict" and decide(clips(None, 0), percent=0) == "fail: all"


def test_labels(spark):
    good = '{"indoor_outdoor": "Indoor ", "show_type": "interview", "hands_free": %s, "sitting_standing": null, "screen_interaction": "no", "sex": "unknown", "age": %s}'
    texts = [good % ("true", "41"), good % ("0", '"7"'), good % ("2", "1"), good % ("true", "130"), good % ("true", "4.5"), '{"age": 1}', "x", good % ("true", "true"), None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    v = {r.k: r.v for r in df.select("k", labels.validated(labels.json_in(F.col("t"))).alias("v")).collect()}
    assert (v[0].indoor_outdoor, v[0].hands_free, v[0].screen_interaction, v[0].sex, v[0].age, v[0].error) == ("indoor", True, False, None, 41, None)
    assert v[1].hands_free is False and v[1].age == 7
    assert [v[k].error is None for k in range(2, 9)] == [False] * 7 and v[3].indoor_outdoor is None
    n = spark.createDataFrame([(600,), (3,), (0,)], "n int").select(labels.frame_picks(F.col("n")).alias("p")).collect()
    assert [r.p for r in n] == [[0, 149, 299, 449, 599], [0, 1, 2], []]
    counts = labels.annotation_counts(frame(spark, "id string, error string", ("a", ""), ("b", None), ("c", "429 x"))).first()
    assert tuple(counts) == (2, 1, 3)


def test_delivery(spark):
    p = {r.column: r for r in delivery.profile(frame(spark, "a double, b string", (1.0, "x"), (None, None))).collect()}
    assert (p["a"].non_null, p["a"].pct, p["a"].middle) == (1, 50.0, 1.0) and p["b"].low is None
    schema = "pitch double, intensity double, right_speed double, harmonicity double, formant1 double, voice_present boolean"
    v = frame(spark, schema, (100.0, 1.0, 2.0, 5.0, 500.0, True), (None, 2.0, 1.0, -200.0, 5500.0, False), (600.0, 4.0, 5.0, None, 0.0, None), (60.0, 3.0, None, 1.0, None, True))
    r = delivery.voice_sanity(v).first()
    assert (r.regime, r.gate, r.n_harmonicity_low, r.n_formant_outside, r.n_pairs, r.n_pairs_voiced, r.r_voiced, r.n_untracked) == ("segments", "voice_present", 0, 0, 3, 1, None, 1)
    assert (r.intensity_low, r.intensity_high) == (1.0, 4.0) and abs(r.r_all - 0.838628) < 1e-6
    assert delivery.voice_sanity(v.withColumn("pitch", F.lit(30.0))).first().regime == "segments with leftovers"
    assert delivery.voice_sanity(v.withColumn("harmonicity", F.lit(-300.0))).first().regime == "segments with leftovers"
    old = delivery.voice_sanity(v.drop("voice_present")).first()
    assert (old.regime, old.gate, old.n_voiced) == ("spline", "60-600 Hz", 3)
    none = delivery.voice_sanity(v.drop("pitch")).first()
    assert (none.regime, none.gate, none.n_voiced, none.intensity_low) == ("no voice", "n/a", 0, None)
    assert delivery.voice_sanity(v.drop("right_speed")).first().r_all is None and delivery.voice_sanity(v.limit(0)).first().regime == "segments"


def test_legacy_gradient_and_scores(spark):
    x = np.array([0.0, 1.0, 4.0, 9.0, 7.0])
    df = frame(spark, "id string, frame long, right_x double, right_y double, left_x double, left_y double", *[("a", i, float(v), 0.0, 1.0, 2.0) for i, v in enumerate(x)])
    got = [r.right_vx for r in legacy.frame_features(df, 1.0).orderBy("frame").collect()]
    assert np.allclose(got, np.gradient(x))
    s = legacy.sequence_features(legacy.centre_of_gravity(legacy.frame_features(df, 1.0))).first()
    assert s.right_step_sum == pytest.approx(np.abs(np.diff(x)).sum()) and s.distance_max == pytest.approx(math.hypot(8, 2))
    assert [r.v_norm for r in legacy.minmax(frame(spark, "v double", (1.0,), (3.0,), (2.0,)), ["v"]).collect()] == pytest.approx([0.0, 1.0, 0.5])
    q = legacy.rank_quartiles(frame(spark, "id int, v double, label string", *[(i, float(i), "a") for i in range(8)], (9, 1.0, "b")), "v", "label")
    assert [r.quartile for r in q.orderBy("label", "id").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 1]


def test_legacy_smoothing_is_a_fit_in_each_window(spark):
    rng = np.random.default_rng(5)
    clips = {n: rng.normal(size=n) for n in (1, 2, 3, 4, 6, 7, 20)}
    rows = [(f"c{n}", 3 * i, float(v), 0.0, 1.0, float(i)) for n, vs in clips.items() for i, v in enumerate(vs)]
    df = frame(spark, "id string, frame long, right_x double, right_y double, left_x double, left_y double", *rows)
    got = {(r.id, r.frame): r for r in legacy.smooth(df).collect()}
    assert len(got) == len(rows) and legacy.smooth(df).columns == df.columns
    for n, vs in clips.items():
        size = min(7, n - (n % 2 == 0))
        for i in range(n):
            a = max(0, min(i - (size - 1) // 2, n - size))
            want = vs[i] if n < 3 else np.polyval(np.polyfit(np.arange(a, a + size), vs[a : a + size], 2), i)
            assert got[f"c{n}", 3 * i].right_x == pytest.approx(want, abs=1e-9) and got[f"c{n}", 3 * i].left_y == pytest.approx(i)
    hole = frame(spark, "id string, frame long, right_x double, right_y double, left_x double, left_y double", *[("a", i, None if i == 0 else 1.0, 0.0, 0.0, 0.0) for i in range(12)])
    assert [r.right_x is None for r in legacy.smooth(hole).orderBy("frame").collect()] == [True] * 4 + [False] * 8
    assert legacy.smooth(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="odd"):
        legacy.smooth(df, window=6)
    assert legacy.rounded(frame(spark, "v double, k int", (0.1234567, 3))).first() == (0.123457, 3)


def test_legacy_extra_and_scores(spark):
    n = 3 * legacy.SLICE + 5
    around = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("frame"), F.cos("id").alias("right_x"), F.sin("id").alias("right_y"), F.lit(5.0).alias("left_x"), F.lit(0.0).alias("left_y"))
    still = frame(spark, "id string, frame long, right_x double, right_y double, left_x double, left_y double", *[("b", i, 1.0, 0.0, 1.0, 0.0) for i in range(3)], ("c", 0, 1.0, 2.0, 3.0, 4.0))
    frames = legacy.centre_of_gravity(legacy.frame_features(around.unionByName(still), 1.0))
    x = {r.id: r for r in legacy.extra_features(frames).collect()}
    assert x["a"].right_hull_area == pytest.approx(math.pi, abs=1e-4) and x["a"].left_hull_area == 0.0
    assert (x["a"].left_n_radius_over_3p5, x["a"].left_frac_radius_over_4p0, x["a"].frac_near_centre) == (n, 1.0, 0.5)
    assert (x["b"].right_path_ratio, x["b"].right_speed_early, x["b"].right_hull_area, x["b"].right_theta_std) == (0.0, 0.0, 0.0, 0.0)
    assert (x["c"].right_path_ratio, x["c"].right_speed_late, x["c"].right_span) == (None, None, 0.0)
    s = {r.id: r for r in legacy.composite_scores(frames).collect()}
    assert s["a"].separation_extremity_score == pytest.approx(1.0) and s["b"].separation_extremity_score == 0.0
    assert s["a"].time_to_extreme_score is None and s["c"].velocity_trend_score is None
    assert s["b"].movement_score == 0.0 and 0 < s["a"].movement_score <= 1
    names = [*legacy.SCORES, *legacy.GLOBAL_SCORES]
    assert all(s[k][c] is None or -1e-9 <= s[k][c] <= 1 + 1e-9 for k in s for c in names)
    assert legacy.composite_scores(frames.limit(0)).count() == 0


def test_align_track_is_linear_in_a_clip(spark):
    n = 200_000
    samples = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("seq"), (F.col("id") * 0.01).alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    grid = spark.range(1000).select(F.lit("a").alias("id"), F.col("id").alias("frame"), (F.col("id") * 2.005).alias("t"))
    assert align.align_track(samples, grid).where("value IS NOT NULL").count() == 998


def test_pivot_refuses_conflicts(spark):
    schema = "id string, people_id double, frame long, frame_timestamp double, type_points string, points double, nx double, ny double, c double"
    row = lambda p, nx, t=0.5: ("a", 0.0, 1, t, "pose_keypoints", float(p), nx, 0.0, 0.9)
    assert tuple(qc.pivot_wide(frame(spark, schema, row(4, 1.0), row(4, 1.0), row(7, 2.0))).first()) == ("a", 0.0, 1, 0.5, 1.0, 0.0, 0.9, 2.0, 0.0, 0.9)
    for bad in ((row(4, 1.0), row(4, 1.5)), (row(4, 1.0), row(7, 1.0, None)), (row(4, 1.0), row(7, 1.0, 0.6))):
        with pytest.raises(Exception, match="conflicting rows"):
            qc.pivot_wide(frame(spark, schema, *bad)).collect()
    with pytest.raises(qc.DataError, match="points"):
        qc.pivot_wide(frame(spark, "id string", ("a",)))
    off = ("b", 0.0, 1, 0.5, "pose_keypoints", 1.0, 0.3, 0.0, 0.9)
    qc.require_origin(frame(spark, schema, ("a", 0.0, 1, 0.5, "pose_keypoints", 1.0, 0.0, 0.0, 0.9), row(4, 1.0)))
    for bad in ((row(4, 1.0),), (off, row(4, 1.0))):
        with pytest.raises(qc.DataError, match="neck"):
            qc.require_origin(frame(spark, schema, *bad))


def test_delivered_videos_refuse_what_is_not_unique(spark):
    sequences = frame(spark, "id string, people_id double, v int", ("a", 1.0, 1), ("b", 1.0, 2), ("b", 2.0, 3), ("c", 1.0, 4))
    notes = lambda *ids: frame(spark, "id string, label string", *[(i, "x") for i in ids])
    clips = frame(spark, "id string, programme string", ("a", "p"), ("b", "q"))
    got = delivery.final_videos(sequences, notes("a", "c"), clips).collect()
    assert sorted((r.id, r.people_id, r.v, r.label, r.programme) for r in got) == [("a", 1, 1, "x", "p"), ("b", 1, 2, None, "q"), ("b", 2, 3, None, "q")]
    for labels_, clips_, message in ((notes("b"), clips, "several persons: b"), (notes("a", "a"), clips, "id is not unique: a"), (notes("a"), clips.union(clips), "id is not unique")):
        with pytest.raises(Exception, match=message):
            delivery.final_videos(sequences, labels_, clips_).collect()


def test_delivered_frames_refuse_what_is_not_unique(spark):
    frames = frame(spark, "id string, people_id double, frame long", ("a", 1.0, 1), ("a", 1.0, 2), ("z", 1.0, 1))
    metadata = frame(spark, "id string, people_id double, frame long, pitch double", ("a", 1.0, 1, 5.0))
    clips = frame(spark, "id string, programme string", ("a", "p"))
    assert sorted((r.frame, r.pitch, r.programme) for r in delivery.final_frames(frames, metadata, clips).collect()) == [(1, 5.0, "p"), (2, None, "p")]
    with pytest.raises(Exception, match="frame is not unique"):
        delivery.final_frames(frames, metadata.union(metadata), clips).collect()


def test_intervals_of_all_lengths(spark):
    """A segment of a day among frames and words of any length: the pairs and flags of brute force."""
    import random

    r = random.Random(5)
    span = lambda n, longest: [(r.choice("ab"), i, s, s + r.choice([0.0, 0.25, 1.0, r.random() * longest])) for i in range(n) for s in [r.choice([r.random() * 5000, float(r.randrange(40))])]]
    kind = "id string, k long, start double, end double"
    left = [*span(150, 3), ("a", 900, 0.0, 86400.0), ("a", 901, 5.0, None)]
    right = [*span(120, 700), ("a", 900, 0.0, 86400.0), ("b", 901, None, 4.0), ("c", 902, 0.0, 1.0)]
    l, rr = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)  # noqa: E741
    fine = lambda rows: [x for x in rows if None not in x]
    expect = sorted((a[0], a[1], b[1]) for a in fine(left) for b in fine(right) if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((x.id, x.k, x.r_k) for x in align.overlap_join(l, rr).collect()) == expect

    times = [(i, f, t) for i in "abc" for f, t in enumerate([None, 0.0, 5.0, 599.999, 600.0, 4000.0, 86400.0, 86400.5, *(r.random() * 5000 for _ in range(60))])]
    got = align.voice_activity(spark.createDataFrame(times, "id string, frame long, t double"), rr.select("id", "start", "end"), spark.createDataFrame([("a",), ("b",), ("b",)], "id string"))
    assert got.columns == ["id", "frame", "t", "vad"]
    held = lambda i, t: None if i == "c" else t is not None and any(x[0] == i and x[2] is not None and x[3] is not None and x[2] <= t <= x[3] for x in right)
    assert {(x.id, x.frame): x.vad for x in got.collect()} == {(i, f): held(i, t) for i, f, t in times}


def test_frames_are_not_broadcast_to_their_words(spark):
    clips = spark.range(8).withColumn("k", F.col("id") % 2).groupBy("k").agg(F.lit(50).alias("n_frames"), F.lit(2.0).alias("fps")).withColumnRenamed("k", "id")
    words = spark.range(300).select((F.col("id") % 2).alias("id"), F.lit("w").alias("word"), (F.col("id") / 100).alias("start"), (F.col("id") / 100 + 1).alias("end"), F.lit(1.0).alias("score"))
    got = align.words_on_frames(align.frame_intervals(clips), words.repartition(2))
    # The plan that ran: adaptive execution changes joins by what it measured.
    query = got._jdf.queryExecution()
    query.executedPlan().execute().count()
    plan = query.executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_duplicate_rows_need_no_hash_table(spark):
    rows = [(1, 1, 2.0, "a"), (1, 1, 2.0, "a"), (1, 1, 3.0, "a"), (1, 2, 2.0, "a"), (2, 1, None, None), (2, 1, None, None), (2, 1, 0.0, None), (2, 1, -0.0, None), (None, 1, 1.0, "b"), (None, 1, 1.0, "c")]
    got = qc.duplicate_rows(frame(spark, "k int, l int, v double, f string", *rows), ("k", "l"), ("v", "f"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 3, 2), (2, 1, 4, 2), (None, 1, 2, 2)}
    assert got.dtypes == [("k", "int"), ("l", "int"), ("n_rows", "bigint"), ("n_different", "bigint")]
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_measures_have_the_last_bit_that_sql_gives(spark):
    x, y = 0.20800000000000018, -1.3999999999999995
    assert math.hypot(x, y) != math.sqrt(x * x + y * y)
    df = frame(spark, "id string, frame long, right_x double, right_y double, left_x double, left_y double", ("a", 0, x, y, 0.0, 0.0))
    r = legacy.frame_features(df).first()
    assert r.distance == r.right_radius == math.sqrt(x * x + y * y)
