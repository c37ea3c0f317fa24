"""Connected components by smallest labels, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesia.llm._shared import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for each end of an edge: comp is the smallest id that can be reached.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so long chains halve in a
    round.  Labels are written to the shared folder in each round; only the number of changes comes to the driver.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).select(F.col("u").alias("id"), "comp"))
    last = None
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.id == near.u).select("id", "comp", F.least("comp", "near").alias("low"))
        # A label is a node too; the label that it has itself is at most as large.
        up = labels.select(F.col("id").alias("low"), F.col("comp").alias("up"))
        new = stored(lower.join(up, "low", "left").select("id", "comp", F.least("low", F.coalesce("up", "low")).alias("next")))
        settled = new.where("next < comp").limit(1).count() == 0
        if settled:
            dropped(both, new)
            return labels
        dropped(labels if last is None else last)
        last, labels = new, new.select("id", F.col("next").alias("comp"))
