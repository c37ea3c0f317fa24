"""Kernels over frame sequences: grid, clock, gap filling, runs, smoothing, derivatives.

Each sequence is one (id, people_id), ordered by frame.  All windows are
partitioned by those keys (and, within them, by run), so the whole stage needs
one shuffle.

A long sequence is dealt into slices of frames (``in_slices``): each slice gets the
rows just beyond its edges that its own rows depend on, and ends that say how far the
sequence goes on.  Within ``sliced()`` every window is one of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia.schema import KEYS


#: A slice has 2^SLICE_BITS frames; one lies around frame 0, so that usual sequences meet no edge.
SLICE_BITS = 16
_PARTED: ContextVar[tuple[str, ...]] = ContextVar("parted", default=KEYS)


@contextmanager
def sliced() -> Iterator[None]:
    """Windows that are made in this block are those of a slice (column ``_slice``), not of a whole sequence."""
    before = _PARTED.set((*KEYS, "_slice"))
    try:
        yield
    finally:
        _PARTED.reset(before)


def parted() -> tuple[str, ...]:
    return _PARTED.get()


def slice_of(frame: Column, bits: int) -> Column:
    """floor(frame / 2^bits + 1/2), for every 64-bit frame."""
    return F.shiftright(F.shiftright(frame, bits - 1) + 1, 1)


def first_of(part: Column, bits: int) -> Column:
    """The first frame of a slice."""
    return F.try_subtract(F.shiftleft(part, bits), F.lit(1 << (bits - 1)))


def norm(x: Column, y: Column) -> Column:
    """The root of the sum of squares as SQL has it; ``hypot`` can differ in the last bit, which shows where values meet an edge."""
    return F.sqrt(x * x + y * y)


def reach_of(max_gap: int, window: int, extended: bool = False) -> int:
    """How many frames before and after it a frame's features depend on.

    Two rounds of gap filling (clocks, then coordinates between filled clocks), two windows of smoothing, which also tell how long a
    run is as far as that matters, and two rows for each derivative at a run's end.
    """
    return 2 * (max_gap + 1) + 2 * window + 2 * (3 if extended else 2) + 2


def with_slices(rows: DataFrame, bits: int, reach: int) -> DataFrame:
    """Each row in its slice (``_slice``), and once more in a neighbouring one if it lies within ``reach`` frames of the edge."""
    if 2 * reach >= 1 << bits:
        raise ValueError("a slice must be longer than what its rows depend on")
    own = slice_of(F.col("frame"), bits)
    place = (F.col("frame").bitwiseAND((1 << bits) - 1) + (1 << (bits - 1))) % (1 << bits)
    parts = F.when(place < reach, F.array(own - 1, own)).when(place >= (1 << bits) - reach, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_slice", F.explode(parts))


def slice_ends(rows: DataFrame, bits: int, reach: int, largest_span: int) -> DataFrame:
    """For each slice of a sequence that has several: (keys, _slice, frame, _clock, _first, _start_t, _end_t), two rows.

    Their frames are the first and the last that the slice's grid has, with what lies beyond its edges; slices without any row of
    the source are among them.  _clock: the latest known time of earlier slices; _first: the sequence's first frame; _start_t and
    _end_t: its first and last known time.  It is a scan over one row for each slice.  A sequence of more than ``largest_span``
    frames gets no empty slices, as its rows will be refused.
    """
    t = F.col("frame_timestamp")
    sums = rows.groupBy(*KEYS, slice_of(F.col("frame"), bits).alias("_slice")).agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"), F.min(t).alias("_u"), F.max(t).alias("_t"))
    whole = W.partitionBy(*KEYS)
    order = whole.orderBy("_slice")
    x = sums.withColumns({
        "_first": F.min("_a").over(whole), "_last": F.max("_b").over(whole), "_start_t": F.min("_u").over(whole), "_end_t": F.max("_t").over(whole),
        "_clock": F.max("_t").over(order.rowsBetween(W.unboundedPreceding, -1)), "_next": F.lead("_slice").over(order),
    })
    x = x.where(slice_of(F.col("_first"), bits) < slice_of(F.col("_last"), bits))
    over = F.col("_last").cast("double") - F.col("_first").cast("double") > largest_span
    # A slice without rows follows one with rows.
    x = x.withColumn("_s", F.explode(F.sequence("_slice", F.coalesce(F.when(~over, F.col("_next") - 1), F.col("_slice")))))
    clock = F.when(F.col("_s") == F.col("_slice"), F.col("_clock")).otherwise(F.greatest("_clock", "_t"))
    low = F.when(over, F.col("_a")).otherwise(F.greatest("_first", F.try_subtract(first_of(F.col("_s"), bits), F.lit(reach))))
    high = F.when(over, F.col("_a")).otherwise(F.least("_last", F.try_add(first_of(F.col("_s") + 1, bits), F.lit(reach - 1))))
    return x.select(*KEYS, F.col("_s").alias("_slice"), F.explode(F.array(low, high)).alias("frame"), clock.alias("_clock"), "_first", "_start_t", "_end_t")


def by_frame():
    return W.partitionBy(*parted()).orderBy("frame")


def known_before(ok: Column, value: Column, reach: int) -> Column:
    """The value of the nearest of the ``reach`` rows before where ``ok`` holds.

    Frames are dense and gaps bounded, so a bounded window finds all that matters, in time linear in the rows.
    """
    return F.last(F.when(ok, value), ignorenulls=True).over(by_frame().rowsBetween(-reach, -1))


def known_after(ok: Column, value: Column, reach: int) -> Column:
    return F.first(F.when(ok, value), ignorenulls=True).over(by_frame().rowsBetween(1, reach))


def expand_grid(wide: DataFrame) -> DataFrame:
    """A row for each frame between a sequence's first and last; values are null where no row was observed.

    A row makes the missing frames that follow it, so no join is needed.  A frame has one row at most (``guards.checked``).
    """
    last = wide.withColumn("_to", F.coalesce(F.lead("frame").over(by_frame()) - 1, F.col("frame")))
    seen = F.col("_f") == F.col("frame")
    # The end of a slice's grid is a frame like those without a row.
    rows = last.withColumn("_f", F.explode(F.sequence("frame", "_to"))).withColumn("source_observed", seen & ~F.col("_end") if "_end" in wide.columns else seen)
    whole = [c for c in ("_long", "_start_t", "_end_t") if c in wide.columns]
    values = [c for c in wide.columns if c not in (*parted(), *whole, "frame", "_end")]
    return rows.select(*parted(), *whole, F.col("_f").alias("frame"), *[F.when(F.col("source_observed"), F.col(c)).alias(c) for c in values], "source_observed", (~F.col("source_observed")).alias("frame_inferred"))


def infer_clock(frames: DataFrame, max_gap: int) -> DataFrame:
    """Fill interior clock gaps of at most ``max_gap`` frames, linearly in the frame number."""
    t = F.col("frame_timestamp")
    mark = F.struct("frame", t.alias("t"))
    x = frames.withColumns({"_p": known_before(t.isNotNull(), mark, max_gap + 1), "_n": known_after(t.isNotNull(), mark, max_gap + 1)})
    inferred = F.coalesce(t.isNull() & (F.col("_n.frame") - F.col("_p.frame") - 1 <= max_gap), F.lit(False))
    share = (F.col("frame") - F.col("_p.frame")) / (F.col("_n.frame") - F.col("_p.frame"))
    value = F.when(inferred, F.col("_p.t") + share * (F.col("_n.t") - F.col("_p.t"))).otherwise(t)
    rest = [c for c in frames.columns if c != "frame_timestamp"]
    return x.select(*rest, inferred.alias("timestamp_inferred"), value.alias("frame_timestamp"), value.isNotNull().alias("clock_known"))


def trusted(x: Column, y: Column, c: Column, least: float) -> Column:
    """A keypoint counts if x, y and its confidence are known and the confidence is above 0 and at least ``least``."""
    return F.coalesce(x.isNotNull() & y.isNotNull() & (c > 0) & (c >= least), F.lit(False))


def fill_coordinates(frames: DataFrame, hands: dict[str, tuple[str, str, str]], max_gap: int) -> DataFrame:
    """For each hand (x, y and usable columns) add ``{hand}_nx``, ``_ny``, ``_interpolated`` and ``_valid``.

    Gaps of usable frames are filled linearly in elapsed time: only interior ones of at most ``max_gap`` frames whose ends are timed
    and apart.  A filled frame without a clock is valid but has no coordinate.
    """
    near, out = {}, {}
    for hand, (x, y, ok) in hands.items():
        mark = F.struct("frame", F.col("frame_timestamp").alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
        near |= {f"_{hand}_p": known_before(F.col(ok), mark, max_gap + 1), f"_{hand}_n": known_after(F.col(ok), mark, max_gap + 1)}
        p, n = (lambda f, h=hand: F.col(f"_{h}_p.{f}")), (lambda f, h=hand: F.col(f"_{h}_n.{f}"))
        filled = F.coalesce(~F.col(ok) & (n("frame") - p("frame") - 1 <= max_gap) & (n("t") - p("t") > 0), F.lit(False))
        share = (F.col("frame_timestamp") - p("t")) / (n("t") - p("t"))
        for name, c, axis in ((f"{hand}_nx", x, "x"), (f"{hand}_ny", y, "y")):
            out[name] = F.when(F.col(ok), F.col(c)).when(filled, p(axis) + share * (n(axis) - p(axis)))
        out |= {f"{hand}_interpolated": filled, f"{hand}_valid": F.col(ok) | filled}
    return frames.withColumns(near).withColumns(out).drop(*near)


def with_runs(frames: DataFrame, runs: dict[str, str]) -> DataFrame:
    """Number the maximal stretches of rows where each flag (key) holds, as a column (value); the frames must be dense."""
    w = by_frame()
    begins = {f"_b_{run}": (F.col(ok) & ~F.coalesce(F.lag(ok).over(w), F.lit(False))).cast("int") for ok, run in runs.items()}
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumns(begins).withColumns({run: F.sum(f"_b_{run}").over(upto) for run in runs.values()}).drop(*begins)


def with_run(frames: DataFrame, ok: str, run: str) -> DataFrame:
    return with_runs(frames, {ok: run})


def in_run(ok: str, run: str):
    return W.partitionBy(*parted(), ok, run)


def smooth(frames: DataFrame, xs: list[str], ok: str, run: str, window: int, order: int) -> DataFrame:
    """Replace ``xs``, in each run, by a local least-squares polynomial's value at the row's own time.

    A run shorter than the window uses its largest odd length, and an order below that.  Near a run's ends the first or last full
    window serves.  Orders 1 and 2 are closed forms over window sums; higher ones go through a grouped kernel.
    """
    if order > 2:
        return _smooth_grouped(frames, xs, ok, run, window, order)
    part = in_run(ok, run).orderBy("frame")
    around = part.rowsBetween(-(window - 1), window - 1)
    place = {} if "_n" in frames.columns else run_places(ok, run)
    d = frames.withColumns(place | {"_i": F.row_number().over(part) - 1, "_near": F.collect_list(F.struct(F.col("frame_timestamp").alias("t"), *xs)).over(around)})
    w = F.least(F.lit(window), F.when(F.col("_n") % 2 == 1, F.col("_n")).otherwise(F.col("_n") - 1)).cast("int")
    low = F.least(F.greatest(F.col("_i") - F.floor(w / 2), F.lit(0)), F.col("_n") - w)
    first = (low - F.col("_i") + F.least(F.col("_i"), F.lit(window - 1)) + 1).cast("int")
    fits = F.col(ok) & (w >= 3) & (F.lit(order + 1) < w)
    d = d.withColumn("_near", F.when(fits, F.slice("_near", first, w)))
    return d.withColumns({x: F.when(F.col("_near").isNotNull(), _fit(F.col("_near"), F.col("frame_timestamp"), x, order)).otherwise(F.col(x)) for x in xs}).drop("_i", "_near", *place)


def _fit(points: Column, at: Column, x: str, order: int) -> Column:
    """The fitted polynomial's constant term, time being counted from ``at``."""
    names = ["s1", "s2", "s3", "s4", "y0", "y1", "y2"]
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def add(s: Column, p: Column) -> Column:
        h = p["t"] - at
        v = p[x]
        # Powers of one rounding: near-equal times make the system so ill-conditioned that another order of products shows in the jerk.
        terms = (h, h * h, F.pow(h, F.lit(3.0)), F.pow(h, F.lit(4.0)), v, v * h, v * (h * h))
        return F.struct(*[(s[k] + t).alias(k) for k, t in zip(names, terms, strict=True)])

    def solve(s: Column) -> Column:
        s0 = F.size(points).cast("double")
        s1, s2, s3, s4, y0, y1, y2 = (s[k] for k in names)
        if order == 1:
            return (y0 * s2 - y1 * s1) / (s0 * s2 - s1 * s1)
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        return (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / det

    return F.aggregate(points, zero, add, solve)


def _smooth_grouped(frames: DataFrame, xs: list[str], ok: str, run: str, window: int, order: int) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        for _, g in pdf[pdf[ok]].groupby(run):
            n = len(g)
            w = min(window, n if n % 2 else n - 1)
            k = min(order, w - 1)
            if w < 3 or k < 1:
                continue
            t = g["frame_timestamp"].to_numpy()
            low = np.clip(np.arange(n) - w // 2, 0, n - w)
            at = low[:, None] + np.arange(w)
            design = (t[at] - t[:, None])[:, :, None] ** np.arange(k + 1)
            weights = np.linalg.pinv(design)[:, 0, :]
            for x in xs:
                pdf.loc[g.index, x] = (weights * g[x].to_numpy()[at]).sum(1)
        return pdf

    return frames.groupBy(*parted()).applyInPandas(kernel, frames.schema)


def run_places(ok: str, run: str) -> dict[str, Column]:
    """``_n``, the run's length, and the times of the two rows before (``_t1``, ``_t2``) and after (``_u1``, ``_u2``) in it."""
    part = in_run(ok, run).orderBy("frame")
    t = F.col("frame_timestamp")
    return {"_n": F.count(F.lit(1)).over(in_run(ok, run)), "_t1": F.lag(t, 1).over(part), "_t2": F.lag(t, 2).over(part), "_u1": F.lead(t, 1).over(part), "_u2": F.lead(t, 2).over(part)}


def derivative(x: str, ok: str, run: str) -> Column:
    """d/dt within a run by second-order differences on uneven times; needs ``run_places``' columns.

    Two rows give the plain slope; at the ends of longer runs the one-sided second-order form serves.  A single row has none.
    """
    part = in_run(ok, run).orderBy("frame")
    v, t = F.col(x), F.col("frame_timestamp")
    n, t1, t2, u1, u2 = (F.col(c) for c in ("_n", "_t1", "_t2", "_u1", "_u2"))
    v1, v2, w1, w2 = F.lag(v, 1).over(part), F.lag(v, 2).over(part), F.lead(v, 1).over(part), F.lead(v, 2).over(part)
    a, b = t - t1, u1 - t
    middle = (a * a * w1 + (b * b - a * a) * v - b * b * v1) / (a * b * (a + b))
    d, f = u2 - u1, t1 - t2
    first = -(b * 2 + d) / (b * (b + d)) * v + (b + d) / (b * d) * w1 - b / (d * (b + d)) * w2
    last = a / (f * (a + f)) * v2 - (a + f) / (a * f) * v1 + (a * 2 + f) / (a * (a + f)) * v
    slope = F.when(t1.isNotNull(), (v - v1) / a).otherwise((w1 - v) / b)
    value = F.when(n == 2, slope).when(t1.isNull(), first).when(u1.isNull(), last).otherwise(middle)
    return F.when(F.col(ok) & (n >= 2), value)
