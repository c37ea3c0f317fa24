"""Writers: results go to a new folder beside the target, which then gets its name; nothing is overwritten."""

from __future__ import annotations

import errno
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.sources import blocks


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _hadoop(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _moved(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """Give a file or folder its final name in one step; FileExistsError if that is taken and ``replace`` doesn't allow it.

    On this machine's own disk a folder is renamed, which the system refuses where a folder with files is, and a file is linked,
    which it refuses where anything is.  Elsewhere the file system's rename without replacing decides: a single step on HDFS; on
    an object store only as far as its connector makes it one.
    """
    (fs, p), (_, q) = _hadoop(spark, source), _hadoop(spark, target)
    if fs.getScheme() == "file":
        old, new = p.toUri().getPath(), q.toUri().getPath()
        if replace:
            for name in (old, new):  # a checksum beside it would be that of other content
                with suppress(FileNotFoundError):
                    os.unlink(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
            os.replace(old, new)
        elif os.path.isdir(old):
            if os.path.lexists(new):
                raise FileExistsError(target)
            try:
                os.rename(old, new)
            except OSError as problem:
                if problem.errno not in (errno.ENOTEMPTY, errno.EEXIST, errno.ENOTDIR):
                    raise
                raise FileExistsError(target) from problem
        else:
            os.link(old, new)
            fs.delete(p, False)
        return
    jvm = spark._jvm
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if replace else kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(p, q, how)
    except Py4JJavaError as problem:
        if "FileAlreadyExists" not in problem.java_exception.getClass().getName():
            raise
        raise FileExistsError(target) from problem


@contextmanager
def staged(spark: SparkSession, target: str, replace: bool = False) -> Iterator[str]:
    """A name beside ``target`` to write to; what is there at the end gets the name ``target``, and after an error it goes."""
    if not replace and exists(spark, target):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        yield staging
        _moved(spark, staging, target.rstrip("/"), replace)
    except BaseException:
        fs, p = _hadoop(spark, staging)
        fs.delete(p, True)
        raise


def publish_text(spark: SparkSession, target: str, text: str, replace: bool = False) -> None:
    """A report of one file: readers see all of it or nothing (with ``replace``: the old one until then)."""
    with staged(spark, target, replace) as staging:
        write_text(spark, staging, text)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files below a folder, read in blocks."""
    found = blocks.hashed(blocks.files(spark, path, recursive=True))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "sha256")


def publish(spark: SparkSession, target: str, tables: dict[str, DataFrame], settings: dict, csv: bool = False, inputs: dict[str, str] | None = None, origin: dict | None = None) -> None:
    """Each table as Parquet (and CSV, nulls empty), and manifest.json with settings, rows and digests of the files, those of ``inputs`` (name: path) too.

    ``origin`` is the provenance block (``sources.provenance``).  Of several publishers of one target one wins; the others raise
    FileExistsError and leave nothing.
    """
    with staged(spark, target) as staging:
        rows = {}
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}.parquet")
            if csv:
                df.write.option("header", True).option("nullValue", "").csv(f"{staging}/{name}.csv")
            rows[name] = spark.read.parquet(f"{staging}/{name}.parquet").count()
        listed = lambda path: [r.asDict() for r in digests(spark, path).where("name NOT RLIKE '^[._]'").orderBy("name").collect()]
        files = {f"{name}.parquet": listed(f"{staging}/{name}.parquet") for name in tables}
        manifest = {"settings": settings, "rows": rows, "files": files, "inputs": {name: listed(path) for name, path in (inputs or {}).items()}, "origin": origin}
        write_text(spark, f"{staging}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))


def report(df: DataFrame, path: str) -> None:
    """A report as tab-separated text with a header, numbers to four places, nulls empty."""
    shown = [F.printf(F.lit("%.4f"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    guarded = [F.when(F.col(c).isNotNull(), s).alias(c) for c, s in zip(df.columns, shown, strict=True)]
    df.select(*guarded).write.option("sep", "\t").option("header", True).option("nullValue", "").mode("errorifexists").csv(path)


def append_counts(old: DataFrame, news: DataFrame) -> DataFrame:
    """Stage counters(stage, metric, value, at): the newest of each stage and metric."""
    return old.unionByName(news).groupBy("stage", "metric").agg(F.max(F.struct("at", "value")).alias("m")).select("stage", "metric", F.col("m.value").alias("value"), F.col("m.at").alias("at"))
