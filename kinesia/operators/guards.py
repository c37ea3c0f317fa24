"""Checks of the table of wrists before anything is measured: what cannot be trusted stops the run.

The checks are part of the plan and share its one shuffle and sort, so they cost no job of their own: a row with a problem raises
when it is reached.  ``problems`` lists such rows instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia import schema as S
from kinesia.operators import sequence as Q

#: Frames from the first to the last of a sequence; a stray frame number must not make billions of rows.
LARGEST_SPAN = 10_000_000
NUMBERS = ("double", "float")


class DataError(ValueError):
    """Input that cannot be trusted."""


def require_columns(df: DataFrame, names: tuple[str, ...], what: str) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise DataError(f"{what} lacks the columns {', '.join(missing)}")


def not_nan(df: DataFrame) -> DataFrame:
    """NaN stands for null in some sources; Spark would count it as the largest number."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in NUMBERS else F.col(c) for c in df.columns])


def infinite(c: Column) -> Column:
    return F.abs(c.cast("double")) == float("inf")


def prepared(wide: DataFrame) -> DataFrame:
    """The columns of ``schema.WIDE`` in their types, a wrist that the source lacks as nulls, with ``_broken``: what is wrong with the row by itself."""
    require_columns(wide, (*S.KEYS, "frame"), "the table of wrists")
    d = not_nan(wide.select(*[(F.col(c) if c in wide.columns else F.lit(None).cast("double")).alias(c) for c in S.WIDE]))
    whole = F.col("frame").cast("double")
    fraction = F.lit(False) if dict(d.dtypes)["frame"] in ("tinyint", "smallint", "int", "bigint") else (whole != F.floor(whole)) | (whole < -(2.0**63)) | (whole >= 2.0**63)
    broken = (
        F.when(F.col("id").isNull() | F.col("people_id").isNull() | F.col("frame").isNull(), "no key")
        .when(infinite(F.col("people_id")), "person")
        .when(fraction, "frame")
        .when(infinite(F.col("frame_timestamp")), "time")
    )
    for c in ("c_4", "c_7"):
        broken = broken.when(~F.col(c).between(0, 1), "confidence")
    # A frame of another type that is no whole number would be rounded by the cast; such rows raise and have none.
    kinds = {"id": "string", "frame": "long"}
    values = {c: F.when(~fraction, F.col(c)) if c == "frame" else F.when(~infinite(F.col(c)), F.col(c)) if c[:2] in ("nx", "ny") else F.col(c) for c in S.WIDE}
    return d.select(*[values[c].cast(kinds.get(c, "double")).alias(c) for c in S.WIDE], broken.alias("_broken"))


def flagged(wide: DataFrame) -> DataFrame:
    """The columns of ``schema.WIDE``, a wrist that the source lacks as nulls, with ``problem`` and ``repeat``.

    problem, the first that holds: "no key" (id, person or frame is null), "person" (not finite), "frame" (not a whole number of 64
    bits), "time" (infinite), "confidence" (known and not in 0..1), "conflict" (its frame has another row with other values),
    "clock" (not later than the last known time), "span" (more than ``LARGEST_SPAN`` frames after the sequence's first).
    repeat: an equal row came before.  Infinite coordinates count as not measured.
    """
    return _compared(prepared(wide)).select(*S.WIDE, "problem", "repeat")


def _compared(d: DataFrame) -> DataFrame:
    """``prepared`` rows with ``problem`` and ``repeat``; in slices, the ends of a slice say what came before it."""
    measured = S.WIDE[len(S.KEYS) :]
    ends = "_end" in d.columns
    parted = Q.parted()
    order = W.partitionBy(*parted).orderBy("frame", *([F.desc("_end")] if ends else []), *measured[1:])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    row, t = F.struct(*measured), F.when(F.col("_broken").isNull(), F.col("frame_timestamp"))
    clock, first = F.last(t, ignorenulls=True).over(before), F.first("frame", ignorenulls=True).over(before)
    same, repeat = F.lag("frame").over(order) == F.col("frame"), F.coalesce(F.lag(row).over(order) == row, F.lit(False))
    if ends:
        # The slice's grid begins with an end, and rows that stand beyond its edge take no part in the scan over slices.
        inside = F.col("_own")
        clock = F.greatest(F.last(F.when(inside, t), ignorenulls=True).over(before), F.first("_clock", ignorenulls=True).over(before))
        first = F.coalesce(F.first("_first", ignorenulls=True).over(before), first)
        twin = F.coalesce(F.lag("_end").over(order), F.lit(False))
        same, repeat = same & ~twin, repeat & ~twin
    d = d.withColumns({"_same": same, "repeat": repeat, "_before": clock, "_start": first})
    span = F.col("frame").cast("double") - F.col("_start").cast("double") > LARGEST_SPAN
    late = F.when(F.col("_same") & ~F.col("repeat"), "conflict").when(~F.col("repeat") & (F.col("frame_timestamp") <= F.col("_before")), "clock").when(span, "span")
    return d.withColumn("problem", F.coalesce("_broken", late))


def problems(wide: DataFrame) -> DataFrame:
    """The rows that ``checked`` would raise for."""
    return flagged(wide).where("problem IS NOT NULL")


def checked(wide: DataFrame) -> DataFrame:
    """The rows without repeats; the first row with a problem that is reached raises."""
    return flagged(wide).where(_passes()).select(*S.WIDE)


def _passes() -> Column:
    key = F.concat_ws(" / ", "id", F.col("people_id").cast("string"), F.col("frame").cast("string"))
    stop = F.raise_error(F.concat(F.lit("the table of wrists cannot be trusted: "), F.col("problem"), F.lit(" at "), key)).cast("boolean")
    return F.when(F.col("problem").isNull(), ~F.col("repeat")).otherwise(stop)


def extent(wide: DataFrame, bits: int) -> tuple[bool, int]:
    """Whether any sequence has several slices, and how many frames the grids have; one row comes to the driver."""
    frame = F.col("frame")
    spans = prepared(wide).where("_broken IS NULL").groupBy(*S.KEYS).agg(F.min(frame).alias("a"), F.max(frame).alias("b"))
    frames = F.least(F.col("b").cast("double") - F.col("a").cast("double") + 1, F.lit(float(LARGEST_SPAN)))
    row = spans.agg(F.max(Q.slice_of(F.col("a"), bits) < Q.slice_of(F.col("b"), bits)).alias("long"), F.sum(frames).alias("n")).first()
    return bool(row["long"]), int(row["n"] or 0)


def checked_slices(wide: DataFrame, bits: int, reach: int, parts: int | None = None) -> DataFrame:
    """``checked``'s rows in their slices (``_slice``), with the rows beyond the edges and the ends of the slices' grids (``_end``).

    An end where the source has a row of its own is left out.  Only sequences of several slices (``_long``) have ends, so others cost
    no more rows.  ``_start_t`` and ``_end_t``: the first and last known time of the whole sequence.
    ``parts`` deals the slices into so many tasks.
    """
    d = prepared(wide)
    # Rows without a usable key have no slice; they raise below.
    rows = Q.with_slices(d.where("frame IS NOT NULL"), bits, reach).withColumn("_own", F.col("_slice") == Q.slice_of(F.col("frame"), bits))
    lost = d.where("frame IS NULL").withColumns({"_slice": F.lit(0).cast("long"), "_own": F.lit(True)})
    ends = Q.slice_ends(d.where("_broken IS NULL"), bits, reach, LARGEST_SPAN).withColumns({"_end": F.lit(True), "_own": F.lit(False)})
    both = rows.unionByName(lost).withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    with Q.sliced():
        if parts:
            # Not by the person: windows compare numbers made regular, which a plain number's shuffle does not serve.
            both = both.repartition(parts, "id", "_slice")
        out = _compared(both)
        whole = W.partitionBy(*Q.parted())
        order = whole.orderBy("frame", F.desc("_end"))
        # Two ends may stand on one frame, and an end on a row's.
        spare = F.col("_end") & F.coalesce(F.lead("frame").over(order) == F.col("frame"), F.lit(False))
        t = F.col("frame_timestamp")
        out = out.withColumns({
            "_spare": spare, "_long": F.max("_end").over(whole),
            "_start_t": F.coalesce(F.max("_start_t").over(whole), F.min(t).over(whole)), "_end_t": F.coalesce(F.max("_end_t").over(whole), F.max(t).over(whole)),
        })
        out = out.where(F.when(F.col("_end"), ~F.col("_spare")).when(F.col("_own"), _passes()).otherwise(~F.col("repeat")))
    return out.select(*S.WIDE, "_slice", "_end", "_long", "_start_t", "_end_t")
