"""Tables, intermediate results and sizes that operators of this package share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(context, "_kinesia_folder", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context._kinesia_folder = folder
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STORED:
        atexit.register(_clear)
    _STORED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._kinesia_stored = path
    return out


#: Tables of this process that are still there.
_STORED: dict[str, SparkSession] = {}


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` made and that no later step reads."""
    for df in tables:
        _remove(df._kinesia_stored)


def _remove(path: str) -> None:
    spark = _STORED.pop(path, None)
    if spark is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _clear() -> None:
    """At the end of the process, if its session is still alive."""
    for path, spark in list(_STORED.items()):
        if spark.sparkContext._jsc is not None:
            _remove(path)


def plain(name: str) -> str:
    """A column name quoted for expressions."""
    return "`" + name.replace("`", "``") + "`"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_kinesia_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "kinesia.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._kinesia_shipped = True
