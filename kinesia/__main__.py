"""Operators on files: ``python -m kinesia COMMAND INPUT... OUTPUT``; inputs and output are folders or files that Spark can reach.

Nothing is overwritten, and an output is there whole or not at all.  A command that checks ends with 1 if something is wrong.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinesia.operators import align, delivery, gestures, labels, qc, tab
from kinesia.sources import readers, sinks

#: name: (help, number of inputs, rows of the output, and when the output shows a fault).
Command = tuple[str, int, Callable[..., DataFrame], Callable[[DataFrame], DataFrame] | None]


def _pq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


COMMANDS: dict[str, Command] = {
    "check-tab": ("lines of a request table with their faults", 1, lambda s, p: tab.check(tab.read_tab(s, p)), lambda x: x.where("short OR inverted OR mismatch")),
    "padding": ("paddings of clips(duration, raw_duration)", 1, lambda s, p: tab.padding_report(_pq(s, p)), None),
    "prescreen": ("scores and ranks of detections", 1, lambda s, p: qc.rank_clips(qc.prescreen(_pq(s, p))), None),
    "coverage": ("wrist coverage of a long keypoint table", 1, lambda s, p: qc.wrist_coverage(_pq(s, p)), None),
    "clocks": ("rows, frames and wrists without a clock", 1, lambda s, p: qc.clock_stats(_pq(s, p)), None),
    "gate": ("decision on each clip of a long keypoint table by expected(id, n_frames)", 2, lambda s, a, b: qc.visibility_gate(_pq(s, a), _pq(s, b)), lambda x: x.where("decision = 'data_error'")),
    "clean": ("those of candidates(id, frame, person, n_reliable, nose, shoulders, black) that stay", 1, lambda s, p: qc.prune_ghosts(_pq(s, p)).where("kept"), None),
    "align": ("samples(id, seq, t, v) on the times of grid(id, frame, t)", 2, lambda s, a, b: align.align_track(_pq(s, a), _pq(s, b)), None),
    "merge": ("keypoints with prosody and words by frame", 3, lambda s, a, b, c: align.merge_clip(_pq(s, a), _pq(s, b), _pq(s, c)), None),
    "annotations": ("how many of annotations(error) are good", 1, lambda s, p: labels.gate(labels.annotation_counts(_pq(s, p))), lambda x: x.where("NOT passes")),
    "media": ("status of media files", 1, lambda s, p: readers.media(s, p), lambda x: x.where("status <> 'OK'")),
    "frames": ("movement of each frame of a table of wrists", 1, lambda s, p: gestures.gesture_frames(_pq(s, p)), None),
    "sequences": ("movement of each sequence of a table of wrists", 1, lambda s, p: gestures.sequence_features(_pq(s, p)), None),
    "dictionary": ("documentation of a table by rules(pattern, text, family)", 2, lambda s, t, r: delivery.dictionary({t.rstrip("/").rsplit("/", 1)[-1]: _pq(s, t)}, s.read.csv(r, header=True), ()), lambda x: x.where("text IS NULL")),
    "profile": ("type, coverage and range of each column", 1, lambda s, p: delivery.profile(_pq(s, p)), None),
    "digests": ("sizes and SHA-256 of the files below a folder", 1, sinks.digests, None),
    "audit": ("interval of the share of wrongly rejected clips of audit(state, passes)", 1, lambda s, p: qc.audit_summary(_pq(s, p)), None),
}


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinesia", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (text, n, _, _) in COMMANDS.items():
        one = commands.add_parser(name, help=text)
        one.add_argument("inputs", nargs=n)
        one.add_argument("output")
    asked = parser.parse_args(words)
    spark = spark or SparkSession.builder.appName("kinesia").getOrCreate()
    _, _, build, faults = COMMANDS[asked.command]
    with sinks.staged(spark, asked.output) as staging:
        build(spark, *asked.inputs).write.parquet(staging)
    return int(faults is not None and faults(spark.read.parquet(asked.output)).limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
