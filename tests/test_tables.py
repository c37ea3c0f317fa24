"""Tables in buckets and parts, and text files read line by line."""

import resource
from collections import Counter

from pyspark.sql import functions as F

from kinesia.operators import gestures as G
from kinesia.operators import labels
from kinesia.sources import readers as R
from kinesia.sources import blocks, tables


def test_only_changed_parts_are_written_again(spark, tmp_path):
    path = str(tmp_path / "labels")
    base = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("sex"))
    tables.save_by_id(spark, base, path, 16)
    files = lambda: {(r.part, r.sha256) for r in blocks.hashed(blocks.files(spark, path, True)).where("path LIKE '%.parquet'").select(F.regexp_extract("path", "_part=([0-9]+)", 1).alias("part"), "sha256").collect()}
    before = files()
    news = spark.createDataFrame([("7", 1, "x", 30), ("7", 2, "y", 40), ("8", 1, "z", None), ("none", 1, "w", 1)], "id string, at int, sex string, age int")
    expect = Counter(tuple(r) for r in labels.upsert(base, news, "at", ("sex", "age")).collect())
    n = tables.upsert_by_id(spark, path, news, "at", ("sex", "age"))
    after = files()
    assert n in (1, 2) and len(before - after) == n == len(after - before) and len(before & after) == len(before) - n
    assert Counter(tuple(r) for r in tables.read_by_id(spark, path).select("id", "sex", "age").collect()) == expect
    # Once more gives the same rows; news of no known id writes nothing.
    tables.upsert_by_id(spark, path, news, "at", ("sex", "age"))
    assert Counter(tuple(r) for r in tables.read_by_id(spark, path).select("id", "sex", "age").collect()) == expect
    assert tables.upsert_by_id(spark, path, news.where("id = 'none'"), "at", ("sex",)) == 0


def test_buckets_spare_the_shuffle(spark):
    """Nothing of a table in buckets moves before or between the windows of its sequences."""
    rows = spark.range(60).select(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("id"), F.lit(0.0).alias("people_id"), F.floor(F.col("id") / 3).alias("frame"),
        (F.floor(F.col("id") / 3) * 40.0).alias("frame_timestamp"), *[(F.col("id") * (0.01 * i + 0.01)).alias(f"n{a}_{p}") for i, (a, p) in enumerate((a, p) for p in (1, 4, 7) for a in "xy")],
        *[F.lit(0.9).alias(f"c_{p}") for p in (1, 4, 7)],
    )
    spark.sql("DROP TABLE IF EXISTS kinesia_frames")
    tables.save_sequences(rows, "kinesia_frames", 4)
    stored = G.gesture_frames(spark.table("kinesia_frames"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    assert Counter(map(str, stored.collect())) == Counter(map(str, G.gesture_frames(rows).collect()))


def test_a_long_formant_file_is_read_line_by_line(spark, tmp_path, monkeypatch):
    """The memory is that of the worker that reads the file."""
    parsed = blocks.parsed

    def measured(listed, rows_of, schema):
        def rows(lines):
            before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
            yield from rows_of(lines)
            assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10

        return parsed(listed, rows, schema)

    monkeypatch.setattr(blocks, "parsed", measured)
    n = 400_000
    frame = "    frames [{}]:\n        intensity = 0.01\n        numberOfFormants = 2\n        formant []:\n" + "".join(
        f"            formant [{k}]:\n                frequency = {500 * k}.123456789\n                bandwidth = {50 * k}.987654321\n" for k in (1, 2)
    )
    with open(tmp_path / "long one.Formant", "w") as out:
        out.write("File type = \"ooTextFile\"\nObject class = \"Formant 2\"\n\nxmin = 0\nxmax = 4000\nnx = 400000\ndx = 0.01\nx1 = 0.5\nmaxnFormants = 5\nframes []:\n")
        for i in range(n):
            out.write(frame.format(i + 1))
    assert (tmp_path / "long one.Formant").stat().st_size > 100 << 20
    got = R.praat_formants(spark, str(tmp_path), 3).agg(F.count(F.lit(1)), F.min("t"), F.max("t"), F.sum("formant2"), F.count("formant3"), F.max("bandwidth1"), F.max("id")).first()
    assert got[0] == n and got[1] == 0.5 and abs(got[2] - (0.5 + 0.01 * (n - 1))) < 1e-6 and abs(got[3] / n - 1000.123456789) < 1e-6
    assert got[4:] == (0, 50.987654321, "long one")


def test_undefined_values_and_other_encodings(spark, tmp_path):
    text = "x1 = 1\ndx = 0.5\nz [] []:\n    z [1]:\n        z [1] [1] = --undefined--\n        z [1] [2] = -200\n"
    (tmp_path / "a.Intensity").write_bytes(text.encode("utf-16"))
    (tmp_path / "b.Intensity").write_text("z [1] [1] = 3\r\n", newline="")
    (tmp_path / "c.Intensity").write_bytes(b"\xff junk without a header")
    got = sorted(map(tuple, R.praat_track(spark, str(tmp_path), "intensity").collect()), key=str)
    assert got == [("a", 1.0, None), ("a", 1.5, -200.0), ("b", None, 3.0)]
