"""Clip requests: reading, checking, padding, and matching with the clips that were cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.functions.ranks import with_place
from kinesia.operators.qc import DataError, require_none

FIELDS = ("program", "clip", "start_sec", "start_frac", "end_sec", "end_frac", "context")


def read_tab(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a headerless file of six or seven fields, as strings; blank lines are skipped, shorter lines have nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t")
    return lines.select(F.size(parts).alias("n_fields"), *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(FIELDS)])


def divisor(program: Column) -> Column:
    """Fractions count thousandths in programs of 2017, and hundredths in all others."""
    return F.when(F.element_at(F.split(program, "/"), -1).startswith("2017"), 1000).otherwise(100)


def windows(tab: DataFrame, padding: float = 2.0) -> DataFrame:
    """Add raw_start, raw_end, start and end (padded, rounded to thousandths) and centre; a field that is no number gives nulls."""
    whole = lambda c: F.expr(f"try_cast({c} AS long)")
    d = divisor(F.col("program"))
    raw = tab.withColumns({"raw_start": whole("start_sec") + whole("start_frac") / d, "raw_end": whole("end_sec") + whole("end_frac") / d})
    return raw.withColumns({"start": F.round(F.col("raw_start") - padding, 3), "end": F.round(F.col("raw_end") + padding, 3), "centre": F.round((F.col("raw_start") + F.col("raw_end")) / 2, 6)})


def clip_name(program: Column, start: Column, end: Column, term: str) -> Column:
    return F.concat_ws("_", F.regexp_replace(program, r"\.txt$", ""), start.cast("string"), end.cast("string"), F.lit(term))


def requests(tab: DataFrame, term: str, padding: float = 2.0) -> DataFrame:
    """The windows with their clip ids; raises if there is none, if one cannot be read or ends before it starts, or if two make one id."""
    x = windows(tab, padding).withColumn("id", clip_name(F.col("program"), F.col("start"), F.col("end"), term))
    if x.limit(1).count() == 0:
        raise DataError("the tab has no line")
    if "n_fields" in tab.columns:
        require_none(x.where("n_fields < 6"), "a line has fewer than six fields")
    require_none(x.where("start IS NULL OR end IS NULL"), "a line's times are no numbers")
    require_none(x.where("start >= end"), "a window ends before it starts")
    require_none(x.groupBy("id").count().where("count > 1"), "two lines make one clip")
    return x


def parse_name(name: Column, term: str) -> Column:
    """struct(program, start, end) of a clip id, or null."""
    pattern = rf"^(.*)_([^_]+)_([^_]+)_{term}$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    number = lambda k: part(k).try_cast("double")
    return F.when(number(2).isNotNull() & number(3).isNotNull(), F.struct(part(1).alias("program"), number(2).alias("start"), number(3).alias("end")))


def named_range(name: Column) -> Column:
    """struct(start, end, tolerance) that a clip's name states: _a.b_c.d with an optional word, or _a-b; null if neither."""
    exact, loose = r"_([0-9]+\.[0-9]+)_([0-9]+\.[0-9]+)(?:_[A-Za-z]+)?$", r"_([0-9]+)-([0-9]+)(?:_[A-Za-z]+)?$"
    pick = lambda pattern, tolerance: F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).cast("double").alias("start"), F.regexp_extract(name, pattern, 2).cast("double").alias("end"), F.lit(tolerance).alias("tolerance")))
    return F.coalesce(pick(exact, 0.01), pick(loose, 1.0))


def check(tab: DataFrame) -> DataFrame:
    """Flags for each line: short, inverted, and whether its window differs from the range in the clip's name."""
    x = windows(tab, 0.0).withColumn("_r", named_range(F.col("clip")))
    apart = F.greatest(F.abs(F.col("raw_start") - F.col("_r.start")), F.abs(F.col("raw_end") - F.col("_r.end")))
    return x.withColumns({"short": F.col("n_fields") < 6, "inverted": F.coalesce(F.col("raw_start") >= F.col("raw_end"), F.lit(False)), "mismatch": F.coalesce(apart > F.col("_r.tolerance"), F.lit(False))}).drop("_r")


def match(asked: DataFrame, clips: DataFrame) -> DataFrame:
    """clips(id, program, start, end) with their request: by id, else by program and centre if exactly one request has it.

    match: exact, window_center, none or ambiguous; padding: what lies before the raw window.
    """
    a = asked.select(F.col("id").alias("request"), "program", "centre", "raw_start")
    exact = clips.join(a.select(F.col("request").alias("id"), "request", F.col("raw_start").alias("_x")), "id", "left")
    by_centre = a.groupBy("program", "centre").agg(F.count(F.lit(1)).alias("_n"), F.min("request").alias("_c"), F.min("raw_start").alias("_s"))
    x = exact.withColumn("centre", F.round((F.col("start") + F.col("end")) / 2, 6)).join(by_centre, ["program", "centre"], "left")
    hit = F.when(F.col("request").isNotNull(), "exact").when(F.col("_n") == 1, "window_center").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    x = x.withColumn("match", hit)
    found = F.when(F.col("match") == "window_center", F.col("_c")).otherwise(F.col("request"))
    base = F.when(F.col("match") == "window_center", F.col("_s")).otherwise(F.col("_x"))
    return x.select("id", "program", "start", "end", "match", found.alias("request"), F.round(base - F.col("start"), 3).alias("padding"))


def padding_report(clips: DataFrame, announced: float = 2.0, tolerance: float = 0.15) -> DataFrame:
    """Of clips(duration, raw_duration): paddings' least, median and greatest, how many are off, and the median to a quarter second."""
    p = (F.col("duration") - F.col("raw_duration")) / 2
    x = clips.select(p.alias("p")).agg(F.count("p").alias("n"), F.min("p").alias("low"), F.median("p").alias("middle"), F.max("p").alias("high"), F.count_if(F.abs(F.col("p") - announced) > tolerance).alias("n_off"))
    return x.withColumn("suggestion", F.round(F.col("middle") * 4) / 4)


def paddings(matched: DataFrame) -> DataFrame:
    """The different paddings, to thousandths; more than one forbids publishing."""
    return matched.where("padding IS NOT NULL").groupBy(F.round("padding", 3).alias("padding")).agg(F.count(F.lit(1)).alias("n_clips"))


def first_by_name(files: DataFrame, n: int, total: int) -> DataFrame:
    """``n`` files, evenly spaced in the order of their names."""
    x = with_place(files, "place", F.col("name"))
    if n >= total:
        return x
    return x.where(F.col("place").isin([i * total // n for i in range(n)]))
