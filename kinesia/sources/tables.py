"""Stored tables whose layout spares later work: buckets by sequence, and parts by id of which only the changed are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.operators import labels
from kinesia.schema import KEYS
from kinesia.sources import sinks

PART = "_part"


def save_sequences(frames: DataFrame, name: str, buckets: int) -> None:
    """Frames as a table in buckets of whole clips, in order: what comes next of a clip's frames needs no shuffle of them.

    The buckets go by the id alone, as the number of a person may be a NaN, which is read as null.  A bucket should hold some 100 MB
    to 1 GB.  A clip lies in one bucket, so clips that are longer than that should be read from plain files, where a shuffle deals
    them by slices.  A table of that name is an error.
    """
    by_clip = frames.repartition(buckets, "id")
    by_clip.write.bucketBy(buckets, "id").sortBy(*KEYS, "frame").mode("errorifexists").saveAsTable(name)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def save_by_id(spark: SparkSession, rows: DataFrame, path: str, parts: int) -> None:
    """Rows in ``parts`` folders by the hash of their id; nothing is overwritten, and the table is there whole or not at all."""
    with sinks.staged(spark, path) as staging:
        rows.withColumn(PART, part_of(F.col("id"), parts)).repartition(PART).write.partitionBy(PART).parquet(staging)
        sinks.write_text(spark, f"{staging}/_parts", str(parts))


def read_by_id(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``save_by_id``; a column that only newer parts have is null in the others."""
    return spark.read.option("mergeSchema", True).parquet(path).drop(PART)


def upsert_by_id(spark: SparkSession, path: str, news: DataFrame, order: str, fields: tuple[str, ...]) -> int:
    """``labels.upsert`` in place: only parts with a row whose id has news are read and written again; their number is returned.

    ``fields`` that the table lacks are added.  Only the numbers of parts come to the driver.  Readers should wait: a part's old files
    go right before its new ones get their place.  A run that was stopped before that changes nothing, and one that is repeated
    gives the same rows, so ``news`` must not be read from this table.
    """
    parts = int(sinks.read_text(spark, f"{path}/_parts"))
    base = spark.read.option("mergeSchema", True).parquet(path)
    known = base.select("id", PART).join(news.select("id").distinct().withColumn("_p", part_of(F.col("id"), parts)).withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col(PART) == F.col("_p")), "left_semi")
    touched = [r[0] for r in known.select(PART).distinct().collect()]
    if touched:
        here = news.where(part_of(F.col("id"), parts).isin(touched))
        new = labels.upsert(base.where(F.col(PART).isin(touched)), here, order, fields)
        new = new.select(*[c for c in new.columns if c != PART], PART).repartition(PART)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return len(touched)
