"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from kinesia.operators import tab
from kinesia.operators.qc import DataError
from kinesia.sources import readers as R
from kinesia.sources import sinks


def body(score=0.9, x=1.0):
    return [v for _ in range(25) for v in (x, 2, score)]


def test_pose_frames(spark, tmp_path):
    cases = [
        ({"people": [{"pose_keypoints_2d": body()}]}, None),
        ({"people": []}, None),
        ({"persons": []}, "no list of people"),
        ({"people": [{"pose_keypoints_2d": body()[:-1]}]}, "not 75 numbers"),
        ({"people": [{"pose_keypoints_2d": [True, *body()[1:]]}]}, "not a number"),
        ({"people": [{"pose_keypoints_2d": ["0.5", *body()[1:]]}]}, "not a number"),
        ({"people": [{"pose_keypoints_2d": body(score=1.5)}]}, "score outside 0..1"),
    ]
    for i, (payload, _) in enumerate(cases):
        (tmp_path / f"clip_{i:012d}_keypoints.json").write_text(json.dumps(payload))
    (tmp_path / "other.json").write_text("{}")
    rows = {r.file: r for r in R.pose_frames(spark, str(tmp_path)).collect()}
    for i, (payload, error) in enumerate(cases):
        r = rows[f"clip_{i:012d}_keypoints.json"]
        assert (r.error, r.clip, r.frame) == (error, "clip", i)
        assert (r.people is None) == (error is not None)
    assert rows["clip_000000000000_keypoints.json"].people[0] == body() and rows["other.json"].error == "unexpected name"
    good = R.pose_frames(spark, str(tmp_path)).where("error IS NULL")
    assert good.select(R.points(F.col("people")).alias("p")).where("size(p) = 1").first().p[0][3].asDict() == {"x": 1.0, "y": 2.0, "c": 0.9}
    assert R.inventory(good, spark.createDataFrame([("clip", 2)], "clip string, n_frames long")).first().n_frames_found == 2
    assert R.inventory(good, spark.createDataFrame([("clip", 1)], "clip string, n_frames long")).first().fault == "a frame beyond the video"


def test_praat(spark, tmp_path):
    (tmp_path / "a.Pitch").write_text(
        "x1 = 0.5\ndx = 0.1\nframes []:\n    frames [1]:\n        intensity = 0.3\n        nCandidates = 2\n        candidates []:\n            candidates [1]:\n                frequency = 120\n"
        "                strength = 0.9\n            candidates [2]:\n                frequency = 60\n                strength = 0.2\n    frames [2]:\n        intensity = 0\n        nCandidates = 0\n"
    )
    (tmp_path / "a.Intensity").write_text("x1 = 1\ndx = 0.5\nz [] []:\n    z [1]:\n        z [1] [1] = 60\n        z [1] [2] = -200\n")
    (tmp_path / "a.Formant").write_text("x1 = 0\ndx = 1\n    frames [1]:\n        intensity = 1\n        formant []:\n            formant [1]:\n                frequency = 500\n                bandwidth = 50\n")
    (tmp_path / "a.PointProcess").write_text("t []:\n    t [1] = 0.25\n    t [2] = 0.5\n")
    assert [tuple(r) for r in R.praat_pitch(spark, str(tmp_path / "a.Pitch")).orderBy("t").collect()] == [("a", 0.5, 120.0, 0.9), ("a", 0.6, None, None)]
    assert [tuple(r) for r in R.praat_track(spark, str(tmp_path / "a.Intensity"), "intensity").orderBy("t").collect()] == [("a", 1.0, 60.0), ("a", 1.5, -200.0)]
    f = R.praat_formants(spark, str(tmp_path / "a.Formant")).first()
    assert (f.formant1, f.bandwidth1, f.formant2) == (500.0, 50.0, None)
    assert [r.t for r in R.praat_points(spark, str(tmp_path / "a.PointProcess")).orderBy("t").collect()] == [0.25, 0.5]


def test_prosody_takes_the_first_row_of_a_frame(spark, tmp_path):
    rows = [(i // 6, float(i)) for i in range(60)]
    spark.createDataFrame(rows, "Frame int, pitch double").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = R.prosody(spark, str(tmp_path / "p")).orderBy("frame").collect()
    assert [(r.frame, r.pitch) for r in got] == [(f, f * 6.0) for f in range(10)]


def test_words_and_segments(spark, tmp_path):
    (tmp_path / "c1.json").write_text(json.dumps([{"frame_number": 3, "words": ["a", "b"], "scores": [0.5, 1.0]}]))
    (tmp_path / "c2.json").write_text("broken")
    assert [tuple(r) for r in R.frame_words(spark, str(tmp_path)).collect()] == [("c1", 3, "a, b", "0.5, 1.0")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "c.json").write_text(json.dumps({"word_segments": [{"word": "x", "start": 0.1, "end": 0.4, "score": 0.9}, {"word": "y"}]}))
    assert [tuple(r) for r in R.word_segments(spark, str(tmp_path / "s")).collect()] == [("c", "x", 0.1, 0.4, 0.9)]
    (tmp_path / "v.csv").write_text("start,end\n0.1,1.0\n")
    assert [tuple(r) for r in R.voice_segments(spark, str(tmp_path / "v.csv")).collect()] == [("v", 0.1, 1.0)]


def test_media(spark, tmp_path):
    for name, data in (("a.mp4", b""), ("b.mp4", b"<html>no</html>"), ("c.mp4", b"\0\0\0\x20ftyp")):
        (tmp_path / name).write_bytes(data)
    status = lambda df: {r.path[-5]: r.status for r in df.collect()}
    assert status(R.media(spark, str(tmp_path))) == {"b": "NOTMP4", "c": "OK"}
    probes = spark.createDataFrame([(f"file:{tmp_path}/{x}.mp4", None, 0) for x in "ac"], "path string, error string, n_frames int")
    assert status(R.media(spark, str(tmp_path), probes)) == {"a": "EMPTY", "b": "NOTMP4", "c": "NOVIDEO"}


def test_tab(spark, tmp_path):
    (tmp_path / "tab.tsv").write_text("2017-a.txt\tc\t900\t0\t900\t320\n\n2016-b.txt\td\t10\t50\t12\t25\tcontext\n")
    rows = {r.program: r for r in tab.requests(tab.read_tab(spark, str(tmp_path / "tab.tsv")), "term").collect()}
    assert rows["2017-a.txt"].id == "2017-a_898.0_902.32_term" and rows["2016-b.txt"].id == "2016-b_8.5_14.25_term"
    for text in ("", "a\tb\t1\t2\n", "2016-b.txt\td\t20\t0\t12\t0\n", "2016-b.txt\td\t1\t0\t2\t0\n" * 2, "2016-b.txt\td\tx\t0\t2\t0\n"):
        (tmp_path / "bad.tsv").write_text(text)
        with pytest.raises(DataError):
            tab.requests(tab.read_tab(spark, str(tmp_path / "bad.tsv")), "term")


def test_publish_never_overwrites(spark, tmp_path):
    target, df = str(tmp_path / "out"), spark.createDataFrame([(1, None), (2, 0.5)], "id long, v double")
    sinks.publish(spark, target, {"t": df}, {"window": 7}, csv=True)
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["rows"] == {"t": 2} and len(manifest["files"]["t.parquet"][0]["sha256"]) == 64
    with pytest.raises(FileExistsError):
        sinks.publish(spark, target, {"t": df}, {})
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.report(df, str(tmp_path / "report"))
    assert {(r.id, r.v) for r in spark.read.csv(str(tmp_path / "report"), sep="\t", header=True).collect()} == {("1", None), ("2", "0.5000")}


def test_tolerant_csv_and_counts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("video,sp_any\na,0.5\nb,\nc,junk\n")
    assert [r.sp_any for r in R.tolerant_csv(spark, str(tmp_path / "m.csv"), ["sp_any"]).orderBy("video").collect()] == [0.5, None, None]
    c = lambda *rows: spark.createDataFrame(list(rows), "stage string, metric string, value long, at long")
    got = sinks.append_counts(c(("a", "n", 1, 1), ("b", "n", 5, 1)), c(("a", "n", 2, 2))).collect()
    assert {(r.stage, r.value) for r in got} == {("a", 2), ("b", 5)}


def test_streams(spark, tmp_path):
    """A sequence's summary grows, ends when nothing comes any more, and then leaves no state."""
    import time

    from kinesia.streaming.sequences import PROVIDER, running_summary, voice_sessions

    schema = "id string, people_id double, frame long, nx_4 double, ny_4 double, c_4 double"
    frame = lambda i: ("c", 0.0, i, 0.1 * i, 0.0, 0.9 if i != 5 else 0.1)
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    write([frame(i) for i in range(8)])
    time.sleep(1)  # files are taken in the order of their times
    write([frame(9), frame(8), frame(3)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    seen = lambda: [(r.id, r.n_frames, r.n_trusted, r.last_frame, round(r.path_length, 6), r.finished) for r in spark.table("summary").collect()]
    try:
        q = running_summary(stream, idle_seconds=12).writeStream.outputMode("update").format("memory").queryName("summary").option("checkpointLocation", str(tmp_path / "k1")).trigger(processingTime="1 second").start()

        def await_rows(n):
            end = time.time() + 60
            while len(seen()) < n and time.time() < end and q.isActive:
                time.sleep(0.2)
            assert q.exception() is None
            return seen()

        assert await_rows(3) == [("c", 8, 7, 7, 0.5, False), ("c", 11, 10, 9, 0.7, False), ("c", 11, 10, 9, 0.7, True)]
        write([("d", 0.0, 0, 0.0, 0.0, 0.9)])
        assert await_rows(4)[3] == ("d", 1, 1, 0, 0.0, False)
        q.stop()
        left = spark.read.format("statestore").option("stateVarName", "sums").load(str(tmp_path / "k1"))
        assert [r.key.id for r in left.collect()] == ["d"]
    finally:
        spark.conf.set(key, before)
    s = spark.range(8).select(F.lit("c").alias("id"), F.timestamp_millis(F.col("id") * 50 + F.when(F.col("id") > 4, 1000).otherwise(0)).alias("at"), F.lit(100.0).alias("pitch"))
    assert [r.n for r in voice_sessions(s).orderBy("start").collect()] == [5, 3]


def test_large_files_are_read_in_blocks(spark, tmp_path, monkeypatch):
    """A sparse file of 3 GB, more than a row can hold: its head and its digest, in bounded memory of the worker that reads it."""
    import hashlib
    import resource

    from kinesia.sources import blocks

    each = blocks._each

    def measured(listed, name, kind, of):
        def value(opened):
            before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
            result = of(opened)
            assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
            return result

        return each(listed, name, kind, value)

    monkeypatch.setattr(blocks, "_each", measured)

    big = tmp_path / "big one.mp4"
    with open(big, "wb") as out:
        out.write(b"<html>")
        out.truncate(3 << 30)
    (tmp_path / "small.mp4").write_bytes(b"\0\0\0 ftyp")
    expect = hashlib.sha256(b"<html>")
    zeros = bytes(1 << 20)
    for _ in range((3 << 10) - 1):
        expect.update(zeros)
    expect.update(bytes((1 << 20) - 6))
    assert {(r.length, r.status) for r in R.media(spark, str(tmp_path)).collect()} == {(3 << 30, "NOTMP4"), (8, "OK")}
    got = {r.name: (r.bytes, r.sha256) for r in sinks.digests(spark, str(tmp_path)).collect()}
    assert got == {"big one.mp4": (3 << 30, expect.hexdigest()), "small.mp4": (8, hashlib.sha256(b"\0\0\0 ftyp").hexdigest())}


def test_of_many_publishers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def race(publisher, n=6):
        def one(k):
            try:
                publisher(k)
            except FileExistsError:
                return None
            return k

        with ThreadPoolExecutor(n) as pool:
            won = [k for k in pool.map(one, range(n)) if k is not None]
        assert len(won) == 1
        return won[0]

    folder, file = tmp_path / "out", tmp_path / "report.json"
    df = spark.createDataFrame([(1,)], "id long")
    k = race(lambda k: sinks.publish(spark, str(folder), {"t": df}, {"k": k}))
    assert json.loads((folder / "manifest.json").read_text())["settings"] == {"k": k}
    k = race(lambda k: sinks.publish_text(spark, str(file), str(k)))
    assert file.read_text() == str(k)
    sinks.publish_text(spark, str(file), "new", replace=True)
    assert file.read_text() == "new"
    broken = df.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish(spark, str(tmp_path / "other"), {"t": broken}, {})
    with pytest.raises(FileExistsError):
        sinks.publish_text(spark, str(folder), "x")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "report.json"]
