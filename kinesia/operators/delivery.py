"""The delivered tables, their profile and the checks on their voice columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia.functions.ranks import exact_quantiles

PITCH_LOW, PITCH_HIGH, FORMANT_HIGH, HARMONICITY_LOW = 60.0, 600.0, 5500.0, -200.0


def one_to_one(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` whose rows raise when they are reached if their keys are not unique; the check shares the shuffle of a join on these keys."""
    held = max(["_n", *df.columns], key=len) + "_"
    named = F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys])
    stop = F.raise_error(F.concat(F.lit(f"{', '.join(keys)} is not unique: "), named)).cast("boolean")
    return df.withColumn(held, F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.when(F.col(held) > 1, stop).otherwise(True)).drop(held)


def final_frames(frames: DataFrame, metadata: DataFrame, clips: DataFrame) -> DataFrame:
    """Frame features with the frame's metadata (one row each) and the clip's fields (one row a clip), for matched clips only."""
    keys = ["id", "people_id", "frame"]
    return frames.join(one_to_one(metadata, *keys), keys, "left").join(one_to_one(clips, "id"), "id")


def final_videos(sequences: DataFrame, annotations: DataFrame, clips: DataFrame) -> DataFrame:
    """Sequence features with labels and clip fields; a clip with labels may have one person only, else its rows raise."""
    stop = F.raise_error(F.concat(F.lit("labels are by clip, but a clip has several persons: "), F.col("id"))).cast("boolean")
    several = F.count(F.lit(1)).over(W.partitionBy("id")) > 1
    s = sequences.withColumn("_several", several).join(one_to_one(annotations, "id").withColumn("_labelled", F.lit(True)), "id", "left")
    s = s.join(one_to_one(clips, "id"), "id").where(F.when(F.col("_several") & F.col("_labelled"), stop).otherwise(True))
    return s.drop("_several", "_labelled").withColumn("people_id", F.col("people_id").cast("long"))


def clock_disagreements(frames: DataFrame, metadata: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Observed frames whose two clocks differ by more than the tolerance, or of which only one is known."""
    keys = ["id", "people_id", "frame"]
    x = frames.where("source_observed").select(*keys, F.col("frame_timestamp").alias("t")).join(metadata.select(*keys, F.col("frame_timestamp").alias("u")), keys)
    return x.where((F.col("t").isNull() != F.col("u").isNull()) | (F.abs(F.col("t") - F.col("u")) > tolerance))


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, pct, low, middle, high): one wide aggregate, then a row for each column; the medians are exact."""
    aggs, rows, numbers = [F.count(F.lit(1)).alias("_n")], [], []
    for i, (c, kind) in enumerate(df.dtypes):
        number = kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")
        v = F.col(f"`{c}`").cast("double") if number else F.lit(None).cast("double")
        numbers += [c] if number else []
        aggs += [F.count(F.col(f"`{c}`")).alias(f"_k{i}"), F.min(v).alias(f"_a{i}"), F.max(v).alias(f"_c{i}")]
        pct = F.round(100 * F.col(f"_k{i}") / F.nullif(F.col("_n"), F.lit(0)), 1)
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), F.col(f"_k{i}").alias("non_null"), pct.alias("pct"), F.round(f"_a{i}", 4).alias("low"), F.round(f"_c{i}", 4).alias("high")))
    x = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    middle = F.lit(None).cast("double")
    if numbers:
        x = x.join(exact_quantiles(df, numbers, (0.5,)).select("column", F.round("value", 4).alias("middle")), "column", "left")
        middle = F.col("middle")
    return x.select("column", "dtype", "non_null", "pct", "low", middle.alias("middle"), "high")


def voice_sanity(frames: DataFrame) -> DataFrame:
    """One row: impossible values in the voice columns, the regime that they show, and intensity against right_speed.

    segments: the table has ``voice_present``; segments with leftovers: it has, but values out of bounds are left (pitch outside
    60 to 600, harmonicity below -200, formants outside 0 to 5500); spline: it has not; no voice: it has no ``pitch``, and then
    nothing is counted.  The voiced frames are those with ``voice_present``, or without that column those whose pitch is in
    bounds.  A correlation is null for fewer than three pairs, without spread, or where one of its columns is missing.
    """
    have = set(frames.columns)
    col = lambda c, kind="double": F.col(c) if c in have else F.lit(None).cast(kind)
    pitch, harmonicity, intensity, speed, flag = col("pitch"), col("harmonicity"), col("intensity"), col("right_speed"), col("voice_present", "boolean")
    voiced = F.coalesce(flag if "voice_present" in have else pitch.between(PITCH_LOW, PITCH_HIGH), F.lit(False))

    def corr(on: Column) -> tuple[Column, Column]:
        both = on & intensity.isNotNull() & speed.isNotNull()
        p, q = F.when(both, intensity), F.when(both, speed)
        # corr() itself fails where there is no spread.
        return F.count_if(both), F.when(F.count_if(both) > 2, F.covar_pop(p, q) / F.nullif(F.stddev_pop(p) * F.stddev_pop(q), F.lit(0.0)))

    formants = [F.count_if(~F.col(f"`{c}`").between(0, FORMANT_HIGH)) for c in frames.columns if c.startswith("formant")]
    measured = "pitch" in have
    (n_all, r_all), (n_voiced, r_voiced) = corr(F.lit(True)), corr(voiced)
    counts = {
        "n_zero": F.count_if(pitch == 0), "n_pitch_outside": F.count_if(~pitch.between(PITCH_LOW, PITCH_HIGH)), "n_harmonicity_low": F.count_if(harmonicity < HARMONICITY_LOW),
        "n_formant_outside": reduce(lambda x, y: x + y, formants, F.lit(0)).cast("long"), "n_voiced": F.count_if(voiced), "n_untracked": F.count_if(flag.isNull()),
        "n_pairs": n_all, "n_pairs_voiced": n_voiced,
    }
    counts = {k: v if measured else F.lit(0).cast("long") for k, v in counts.items()}
    values = {"intensity_low": F.min(intensity), "intensity_high": F.max(intensity), "r_all": r_all, "r_voiced": r_voiced}
    values = {k: v if measured else F.lit(None).cast("double") for k, v in values.items()}
    impossible = counts["n_pitch_outside"] + counts["n_harmonicity_low"] + counts["n_formant_outside"]
    if not measured:
        regime, gate = F.lit("no voice"), "n/a"
    elif "voice_present" in have:
        regime, gate = F.when(impossible > 0, "segments with leftovers").otherwise("segments"), "voice_present"
    else:
        regime, gate = F.lit("spline"), f"{PITCH_LOW:.0f}-{PITCH_HIGH:.0f} Hz"
    return frames.agg(F.count(F.lit(1)).alias("n_frames"), regime.alias("regime"), F.lit(gate).alias("gate"), *[v.alias(k) for k, v in (counts | values).items()])


def sample_facts(sequences: DataFrame, least: int = 30) -> DataFrame:
    """Clips in which both hands have enough speeds, and the fastest clip."""
    s = F.greatest("right_max_speed", "left_max_speed")
    return sequences.agg(F.count_if((F.col("right_n_speed") >= least) & (F.col("left_n_speed") >= least)).alias("n_both"), F.max(F.when(s.isNotNull(), F.struct(s.alias("speed"), "id"))).alias("top")).select("n_both", F.col("top.id").alias("fastest"), F.col("top.speed").alias("fastest_speed"))


def null_rates(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null") for c in columns])


def outliers(df: DataFrame, limit: float = 5.0) -> DataFrame:
    """How many rows of each kind of point lie implausibly far out."""
    return df.where((F.abs("nx") > limit) | (F.abs("ny") > limit)).groupBy("type_points").agg(F.count(F.lit(1)).alias("n"))


def documented(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """columns(column) with the text of the rule that explains it: exact name, else the longest prefix (x_*), else suffix (*_x).

    A hand's prefix is taken off first.  Columns without a rule have a null text; ``require_none`` on them stops a delivery.
    """
    bare = F.regexp_replace("column", "^(right|left)_", "")
    x = columns.select("column", bare.alias("_bare"))
    # Every pattern that a column could meet, so that the rules are looked up by equality.
    option = lambda k, p: F.struct(F.lit(k).alias("k"), p.alias("pattern"))
    places = F.sequence(F.lit(0), F.length("_bare"))
    prefixes = F.transform(places, lambda i: option(2, F.concat(F.substr("_bare", F.lit(1), i), F.lit("*"))))
    suffixes = F.transform(places, lambda i: option(1, F.concat(F.lit("*"), F.substr("_bare", i + 1))))
    options = F.concat(F.array(option(3, F.col("column")), option(3, F.col("_bare"))), prefixes, suffixes)
    hits = x.select("column", F.explode(options).alias("o")).select("column", "o.*").join(rules.select("pattern", "text"), "pattern", "left")
    found = F.col("text").isNotNull()
    hits = hits.select("column", F.struct(F.when(found, F.col("k")).otherwise(0).alias("k"), F.when(found, F.length("pattern")).otherwise(0).alias("n"), F.when(found, F.col("pattern")).alias("pattern"), "text").alias("_r"))
    return hits.groupBy("column").agg(F.max("_r").alias("m")).select("column", F.col("m.pattern").alias("pattern"), F.col("m.text").alias("text"))


def dictionary(tables: dict[str, DataFrame], rules: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """(table, column, place, family, text, and what ``profile`` measures): the documentation of delivered tables.

    rules(pattern, text, family) explain columns as in ``documented``.  Columns stand by family, in the order of ``families`` (a
    family belongs to the first name that it begins with; others come last), then as in their table.  A column that no rule
    explains has a null text; ``require_none`` on those stops a delivery.
    """
    known = rules.groupBy("pattern").agg(F.min("family").alias("family"))
    parts = []
    for name, df in tables.items():
        order = F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("_at", "column")
        columns = df.sparkSession.range(1).select(order)
        texts = documented(columns, rules).join(known, "pattern", "left")
        x = columns.join(profile(df), "column").join(texts, "column")
        parts.append(x.select(F.lit(name).alias("table"), "column", "_at", "dtype", "family", "non_null", "pct", "low", "middle", "high", "text"))
    begins = [F.when(F.startswith("family", F.lit(f)), k) for k, f in enumerate(families)]
    rank = F.coalesce(*begins, F.lit(len(families)))
    # A row for each column of a table: few, whatever the tables hold.
    place = F.row_number().over(W.partitionBy("table").orderBy(rank, "_at"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).drop("_at")


def cover(documentation: DataFrame, rows: dict[str, int], settings: dict[str, str]) -> DataFrame:
    """(place, item, value): the head of a delivery's documentation, sizes by table and the settings that are known."""
    spark = documentation.sparkSession
    sizes = documentation.groupBy("table").agg(F.count(F.lit(1)).alias("k"))
    counted = spark.createDataFrame(list(rows.items()), "table string, n long")
    value = F.concat(F.col("n").cast("string"), F.lit(" rows x "), F.col("k").cast("string"), F.lit(" columns"))
    first = counted.join(sizes, "table").select(F.lit(0).alias("_g"), F.col("table").alias("item"), value.alias("value"))
    known = [(1, k, str(v)) for k, v in settings.items() if v is not None]
    both = first.unionByName(spark.createDataFrame(known, "_g int, item string, value string")) if known else first
    return both.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_g", "item")).alias("place"), "item", "value")


#: What a reader may do with the voice columns, by the regime that was measured.
VOICE_ADVICE = {
    "no voice": ("The delivery has no voice columns; nothing about voice was measured.",),
    "segments": (
        "Use voice_present before any statistic of voice.",
        "intensity is measured in silence too and tells nothing about voice.",
        "Set values out of bounds aside, and say so; never replace them.",
    ),
    "spline": (
        "A value is the curve of the whole clip at that frame, not a measurement of the frame.",
        "Keep pitch within its bounds before computing anything: zeros are no silence.",
    ),
}


def voice_section(sanity: DataFrame) -> DataFrame:
    """(place, line): the part on voice of a delivery's documentation, by the regime and counts of ``voice_sanity``'s one row.

    Counts are left out where there is no voice: a 0 there would look like a measurement.
    """
    counts = [("n_zero", "frames with pitch 0"), ("n_pitch_outside", "frames with pitch out of bounds"), ("n_harmonicity_low", "frames with harmonicity below its floor"), ("n_formant_outside", "formants out of bounds"), ("n_voiced", "frames with voice")]
    number = lambda c, digits: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise("not computable")
    span = F.concat(F.lit("intensity: "), number("intensity_low", 1), F.lit(" to "), number("intensity_high", 1), F.lit(" dB"))
    pairs = F.concat(F.lit("intensity with right_speed: "), number("r_all", 3), F.lit(", with voice: "), number("r_voiced", 3))
    measured = F.array(F.concat(F.lit("regime: "), "regime"), F.concat(F.lit("gate: "), "gate"), *[F.concat(F.lit(f"{text}: "), F.col(c).cast("string")) for c, text in counts], span, pairs)
    advice = lambda name: F.array(*[F.lit(x) for x in VOICE_ADVICE[name]])
    lines = F.when(F.col("regime") == "no voice", advice("no voice")).otherwise(F.concat(measured, F.when(F.col("regime") == "segments", advice("segments")).otherwise(advice("spline"))))
    return sanity.select(F.posexplode(lines).alias("place", "line"))
