"""Streams of keypoint frames and voice samples (beyond the batch engine, which has no streams)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "id string, people_id double, n_frames long, n_trusted long, last_frame long, path_length double, finished boolean"
STATE = "n_frames long, n_trusted long, last_frame long, path_length double, x double, y double"
#: Where ``running_summary`` keeps its state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def voice_sessions(samples: DataFrame, gap: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Stretches of samples(id, at, pitch) without a gap: the streaming form of a track's runs."""
    x = samples.where("pitch IS NOT NULL").withWatermark("at", late)
    out = x.groupBy("id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("pitch").alias("mean_pitch"))
    return out.where("n >= 2").select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_pitch")


class _Summary(StatefulProcessor):
    """One row of state for each sequence, and a timer that ends it."""

    def __init__(self, least: float, idle_ms: int):
        self._least, self._idle = least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("sums", STATE)

    def _row(self, key, sums: tuple, finished: bool) -> pd.DataFrame:
        return pd.DataFrame([[*key, *sums[:4], finished]], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = self._state.get() if self._state.exists() else (0, 0, None, 0.0, None, None)
        for batch in rows:
            sums = _advance(tuple(sums), batch, self._least)
        self._state.update(sums)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        yield self._row(key, sums, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._state.exists():
            sums = self._state.get()
            self._state.clear()
            yield self._row(key, sums, True)

    def close(self) -> None:
        pass


def _advance(sums: tuple, batch: pd.DataFrame, least: float) -> tuple:
    n, ok, last, path, x, y = sums
    # Of a frame that comes twice the first row counts for the path.
    batch = batch.sort_values("frame", kind="stable")
    c = batch["c_4"].to_numpy(float)
    px, py = batch["nx_4"].to_numpy(float), batch["ny_4"].to_numpy(float)
    frame = batch["frame"].to_numpy("int64")
    trusted = ~np.isnan(px) & ~np.isnan(py) & (c > 0) & (c >= least)
    n, ok = n + len(frame), ok + int(trusted.sum())
    new = np.concatenate([[True], frame[1:] != frame[:-1]]) if len(frame) else np.zeros(0, bool)
    if last is not None:
        new &= frame > last
    frame, px, py = frame[new], np.where(trusted, px, np.nan)[new], np.where(trusted, py, np.nan)[new]
    if not len(frame):
        return n, ok, last, path, x, y
    before = [last, x, y] if last is not None and x is not None else [frame[0] - 2, np.nan, np.nan]
    f, qx, qy = (np.concatenate([[b], v]) for b, v in zip(before, (frame, px, py), strict=True))
    steps = np.hypot(np.diff(qx), np.diff(qy))[np.diff(f) == 1]
    path += float(steps[~np.isnan(steps)].sum())
    known = not np.isnan(px[-1])
    return n, ok, int(frame[-1]), path, float(px[-1]) if known else None, float(py[-1]) if known else None


def running_summary(frames: DataFrame, least: float = 0.2, idle_seconds: float = 600.0, mode: str = "update") -> DataFrame:
    """A summary of each sequence that grows with frames(id, people_id, frame, nx_4, ny_4, c_4); late frames are counted, not joined.

    The path joins frames whose numbers follow each other.  A sequence without a new frame for ``idle_seconds`` gets a last row,
    ``finished``, and its state goes; frames that come later begin a new one.  So the state holds only clips that are under way.
    The session's ``spark.sql.streaming.stateStore.providerClass`` must be ``PROVIDER``.  Frames without a number are left out.
    """
    rows = frames.where("frame IS NOT NULL").groupBy("id", "people_id")
    return rows.transformWithStateInPandas(statefulProcessor=_Summary(least, int(idle_seconds * 1000)), outputStructType=OUTPUT, outputMode=mode, timeMode="ProcessingTime")
