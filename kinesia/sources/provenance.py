"""What made a delivery, as far as it can be known afterwards.  Nothing here stops one: what is unknown is said with its reason."""

from __future__ import annotations

import json
import platform
import subprocess

import pyspark
from pyspark.sql import SparkSession

from kinesia.sources.sinks import _hadoop


def recorded(spark: SparkSession, path: str | None) -> dict:
    """{path, recorded_at, tools, reason}: the JSON object that an earlier step wrote, or why there is none."""
    out = {"path": path, "recorded_at": None, "tools": None, "reason": None}
    if not path:
        return out | {"reason": "no file was named"}
    fs, place = _hadoop(spark, path)
    if not fs.exists(place):
        return out | {"reason": "the file does not exist"}
    try:
        tools = json.loads(spark.read.text(path, wholetext=True).first().value)
    except (AttributeError, ValueError) as problem:
        return out | {"reason": f"the file cannot be read ({type(problem).__name__})"}
    if not isinstance(tools, dict):
        return out | {"reason": "the file is not an object"}
    return out | {"tools": tools, "recorded_at": tools.get("recorded_at")}


def _git(root: str, *words: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=20, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip()


def code(root: str) -> dict:
    """The commit of the code in ``root``, how many files differ from it or are unknown to it, and the versions it runs on."""
    commit, changes = _git(root, "rev-parse", "HEAD"), _git(root, "status", "--porcelain")
    lines = None if changes is None else changes.splitlines()
    return {
        "commit": commit, "changed": None if lines is None else sum(not x.startswith("??") for x in lines), "unknown": None if lines is None else sum(x.startswith("??") for x in lines),
        "reason": None if commit else "not a repository, or git cannot be run", "python": platform.python_version(), "pyspark": pyspark.__version__,
    }
