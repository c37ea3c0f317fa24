"""From raw documents to shuffled shards of training data, in five stages.

Each stage takes (spark, docs, sf_dir) and gives the documents that stay, with
their columns; the last one adds each document's place.  ``run`` writes each
stage's result to the shared folder and reads it again for the next one.

An empty table passes through as an empty one.  Rows with a null text fail the
quality rules.  A row without an id is never anyone's copy and never contaminated.
Ties and repeated rows are settled as the operators' docstrings say; texts of any
length are read whole; columns beside those of ``documents`` pass through, whatever
their names (those that sharding adds replace columns of their name).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.llm import decontam, mixing, neardup, quality, sharding
from kinesia.llm._shared import dropped, plain, ship, stored, table

#: The mixture takes nine tenths of the tokens that are left, and no document twice.
BUDGET_SHARE = (9, 10)
SHARDS = 40
#: Columns that stages read.
READ = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_names(stage: Stage) -> Stage:
    """The stage on columns with made-up names beside those in ``READ``; the result has the real ones again."""

    @wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        out = stage(spark, docs.toDF(*[c if c in READ else f"other{i}" for i, c in enumerate(names)]), sf_dir)
        return out.toDF(*names, *out.columns[len(names) :])

    return run_


@any_names
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@any_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    If an id has several rows, the one whose text has the smallest hash stays, of equal texts the one whose columns sort first.
    """
    ship(spark)
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = F.struct(*[F.col(plain(c)) for c in out.columns])
        first = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), rows.alias("r"))).alias("m"))
        out = first.select("m.r.*").unionByName(out.where("doc_id IS NULL"))
    return out


@any_names
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    ship(spark)
    gone = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


@any_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond their source's share of the budget go."""
    ship(spark)
    mixed = mixing.mix(docs, budget_share=BUDGET_SHARE, max_epochs=1)
    return mixed.where("_mix.copies > 0").select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and its slot there."""
    ship(spark)
    return any_names(lambda _, rows, __: sharding.external_shuffle(rows, SHARDS))(spark, docs.drop(*sharding.RESULT), sf_dir)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A conditional random field decides in the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
