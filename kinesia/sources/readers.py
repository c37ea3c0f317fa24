"""Readers of what the external producers write.  A clip's id comes from the file's name; every schema is stated."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia.sources import blocks

POINTS = 25
FRAME_NAMES = ("frame", "Frame", "frame_id")
POSE = "struct<people:array<struct<pose_keypoints_2d:array<variant>>>>"
WORDS = "struct<frame_number:long,words:array<string>,scores:array<double>>"
SEGMENT = "struct<word:string,start:double,end:double,score:double>"


def file_stem(suffix: str = r"\.[^.]*$") -> Column:
    """The name of a row's file without folder and suffix."""
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), suffix, "")


def long_pose(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """Keypoint Parquet; frames count from 1 in the result."""
    return spark.read.parquet(path).withColumn("frame", F.col("frame").cast("long") + (1 - base))


def prosody(spark: SparkSession, path: str) -> DataFrame:
    """Prosody Parquet of clips: the frame column under any of its names, times as UTC, and of each frame the first row of its file."""
    raw = spark.read.parquet(path)
    names = [c for c in FRAME_NAMES if c in raw.columns]
    if not names:
        raise ValueError("no frame column")
    rest = [c for c in raw.columns if c not in FRAME_NAMES]
    x = raw.select(file_stem(r"(_prosody)?\.parquet$").alias("id"), F.coalesce(*[F.col(c).cast("long") for c in names]).alias("frame"), *rest, F.col("_metadata.row_index").alias("_seq"))
    first = F.row_number().over(W.partitionBy("id", "frame").orderBy("_seq"))
    return x.withColumn("_k", first).where("_k = 1").drop("_k", "_seq")


def frame_words(spark: SparkSession, path: str) -> DataFrame:
    """(id, frame, words, scores) from lists of {frame_number, words, scores}; a broken file gives no row."""
    x = spark.read.text(path, wholetext=True).select(file_stem().alias("id"), F.explode(F.from_json("value", f"array<{WORDS}>")).alias("w"))
    return x.select("id", F.col("w.frame_number").alias("frame"), F.concat_ws(", ", "w.words").alias("words"), F.concat_ws(", ", F.transform("w.scores", lambda s: s.cast("string"))).alias("scores"))


def word_segments(spark: SparkSession, path: str) -> DataFrame:
    """(id, word, start, end, score) from {word_segments: [...]}; words without times are left out."""
    x = spark.read.text(path, wholetext=True).select(file_stem().alias("id"), F.explode(F.from_json("value", f"struct<word_segments:array<{SEGMENT}>>")["word_segments"]).alias("s"))
    return x.select("id", "s.*").where("start IS NOT NULL AND end IS NOT NULL")


def voice_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="start double, end double").select(file_stem().alias("id"), "start", "end")


def pose_frames(spark: SparkSession, path: str, name: str = r"^(.*)_([0-9]{12})_keypoints\.json$") -> DataFrame:
    """One row for each keypoint JSON: clip, frame, the bodies as arrays of 75 numbers, and why the file is refused, if it is.

    A body must be a list of exactly 75 JSON numbers (no booleans, no strings), finite, with every score in 0..1.
    """
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    x = spark.read.text(path, wholetext=True).select(file.alias("file"), "value")
    x = x.withColumns({"clip": F.regexp_extract("file", name, 1), "frame": F.regexp_extract("file", name, 2).try_cast("long"), "p": F.from_json("value", POSE)["people"]})
    number = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
    plain = lambda v: F.try_variant_get(v, "$", "double")
    raw = lambda body: body["pose_keypoints_2d"]
    shaped = F.forall("p", lambda b: F.coalesce(F.size(raw(b)) == 3 * POINTS, F.lit(False)))
    numeric = F.forall("p", lambda b: F.forall(raw(b), lambda v: F.coalesce(number(v) & plain(v).isNotNull() & (F.abs(plain(v)) < float("inf")), F.lit(False))))
    scored = F.forall("p", lambda b: F.forall(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: plain(F.get(raw(b), i * 3 + 2)).between(0, 1)))
    error = F.when(F.col("frame").isNull(), "unexpected name").when(F.col("p").isNull(), "no list of people").when(~shaped, "not 75 numbers").when(~numeric, "not a number").when(~scored, "score outside 0..1")
    bodies = F.transform("p", lambda b: F.transform(raw(b), plain))
    x = x.withColumn("error", error)
    return x.select("clip", "frame", "file", F.when(F.col("error").isNull(), bodies).alias("people"), "error")


def inventory(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """Of pose_frames and expected(clip, n_frames): frames found, and the first fault: refused file, double or late frame."""
    x = frames.join(expected, "clip", "left")
    found = x.groupBy("clip").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct("frame").alias("n_distinct"), F.min(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "file", "error"))).alias("refused"),
        F.count_if(F.col("frame") >= F.col("n_frames")).alias("late"),
    )
    fault = F.coalesce("refused", F.when(F.col("n_files") > F.col("n_distinct"), "a frame comes twice"), F.when(F.col("late") > 0, "a frame beyond the video"))
    return found.select("clip", F.when(fault.isNull(), F.col("n_files")).alias("n_frames_found"), fault.alias("fault"))


def points(people: Column) -> Column:
    """Bodies as arrays of 25 structs (x, y, c)."""
    return F.transform(people, lambda b: F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(F.get(b, i * 3).alias("x"), F.get(b, i * 3 + 1).alias("y"), F.get(b, i * 3 + 2).alias("c"))))


def _number(text: str) -> float | None:
    """A decimal number, or null for what is none (a text format's mark of an undefined value)."""
    try:
        return float(text)
    except ValueError:
        return None


def _entries(lines: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(key, value) of the lines ``key = value`` and (heading, None) of the lines ``heading:``."""
    for line in lines:
        key, sign, value = line.partition(" = ")
        if sign:
            yield key.strip(), value.strip()
        elif (key := key.strip()).endswith(":"):
            yield key[:-1], None


def _frames(lines: Iterator[str]) -> Iterator[tuple[float | None, dict[str, str]]]:
    """(time, entries) of each block ``frames [k]:``; an entry's key names its heading, as in ``candidates [1] frequency``."""
    start = step = time = found = None
    heading, i = "", 0
    for key, value in _entries(lines):
        if value is None and key.startswith("frames [") and key != "frames []":
            if found is not None:
                yield time, found
            time = None if start is None or step is None else start + i * step
            found, heading, i = {}, "", i + 1
        elif value is None:
            heading = key
        elif found is not None:
            found.setdefault(f"{heading} {key}", value)
        elif key == "x1":
            start = _number(value)
        elif key == "dx":
            step = _number(value)
    if found is not None:
        yield time, found


def praat_pitch(spark: SparkSession, path: str) -> DataFrame:
    """(id, t, pitch, strength): each frame's first candidate.  Here and below a file is read line by line, whatever its length."""

    def rows(lines: Iterator[str]) -> Iterator[tuple]:
        for time, found in _frames(lines):
            first = lambda k: next((_number(found[n]) for n in (f"candidates [1] {k}", f"candidate [1] {k}") if n in found), None)
            yield time, first("frequency"), first("strength")

    return blocks.parsed(blocks.files(spark, path), rows, "t double, pitch double, strength double")


def praat_track(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(id, t, name): an intensity or harmonicity track, one value for each step."""

    def rows(lines: Iterator[str]) -> Iterator[tuple]:
        start = step = None
        i = 0
        for key, value in _entries(lines):
            if value is None:
                continue
            if key.startswith("z [1] ["):
                yield None if start is None or step is None else start + i * step, _number(value)
                i += 1
            elif key == "x1":
                start = _number(value)
            elif key == "dx":
                step = _number(value)

    return blocks.parsed(blocks.files(spark, path), rows, f"t double, `{name}` double")


def praat_formants(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """(id, t, formant1, bandwidth1, ...)."""
    places = [f"formant [{k}] {c}" for k in range(1, n + 1) for c in ("frequency", "bandwidth")]

    def rows(lines: Iterator[str]) -> Iterator[tuple]:
        for time, found in _frames(lines):
            yield time, *(_number(found[p]) if p in found else None for p in places)

    return blocks.parsed(blocks.files(spark, path), rows, "t double, " + ", ".join(f"{c}{k} double" for k in range(1, n + 1) for c in ("formant", "bandwidth")))


def praat_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, t): the times of a point process."""

    def rows(lines: Iterator[str]) -> Iterator[tuple]:
        for key, value in _entries(lines):
            if value is not None and key.startswith("t ["):
                yield (_number(value),)

    return blocks.parsed(blocks.files(spark, path), rows, "t double")


def media(spark: SparkSession, path: str, probes: DataFrame | None = None) -> DataFrame:
    """(path, length, status): EMPTY, NOTMP4 (an error page), BAD or NOVIDEO by probes(path, error, n_frames), else OK.

    Spark passes over files without a byte; those are the ones that only the probes name.
    """
    x = blocks.heads(blocks.files(spark, path), 5).withColumn("head", F.col("head").cast("string"))
    if probes is not None:
        x = x.join(probes, "path", "full").fillna(0, ["length"])
    else:
        x = x.withColumns({"error": F.lit(None).cast("string"), "n_frames": F.lit(1)})
    status = F.when(F.col("length") == 0, "EMPTY").when(F.col("head").isin("<!DOC", "<html", "<?xml"), "NOTMP4").when(F.col("error").isNotNull(), "BAD").when(F.coalesce("n_frames", F.lit(0)) == 0, "NOVIDEO").otherwise("OK")
    return x.select("path", "length", status.alias("status"))


def media_totals(files: DataFrame) -> DataFrame:
    """(status, n, n_files, all_ok): files(status) by status, and whether all of them are OK; no row for no file."""
    x = files.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))
    return x.select("status", "n", F.sum("n").over(every).alias("n_files"), (F.sum(F.when(F.col("status") == "OK", 0).otherwise(F.col("n"))).over(every) == 0).alias("all_ok"))


def prosody_layout(files: DataFrame) -> DataFrame:
    """(id, path) of the prosody files among files(path, folder), folder being null for files at the top.

    A file at the top is a clip of its own name.  In a clip's folder the files that end in _prosody.parquet count, or all if none does.
    """
    x = files.where(F.col("path").endswith(".parquet")).withColumn("_named", F.col("path").endswith("_prosody.parquet"))
    some = F.max("_named").over(W.partitionBy("folder"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.parquet$", "")
    return x.withColumn("_some", some).where(F.col("folder").isNull() | ~F.col("_some") | F.col("_named")).select(F.coalesce("folder", name).alias("id"), "path")


def prosody_files(spark: SparkSession, root: str) -> DataFrame:
    """``prosody_layout`` of the files in a folder and in its folders."""
    top = root.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    parent = F.element_at(F.split("path", "/"), -2)
    return prosody_layout(files.withColumn("folder", F.when(parent != top, parent)))


def tolerant_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """All columns as text but ``numbers``, of which blanks and garbage are null."""
    x = spark.read.csv(path, header=True)
    return x.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in x.columns])
