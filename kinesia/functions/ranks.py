"""Places and exact quantiles in the order of a whole table, without a task that sees all of it."""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_place(df: DataFrame, name: str, *order: Column, partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0 for the first row in the order, and so on; ``order`` should tell all rows apart.

    The rows are range-partitioned into a fixed number of parts and sorted there; a row's place is its place in its part plus the
    rows of the parts before, of which there is one count each.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parted = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = parted.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    out = parted.withColumn("_part", part).join(F.broadcast(first), "_part")
    return out.withColumn(name, F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_part", "_first")


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(column, k, n, value): of each column's known values the exact quantile at ``shares[k]``, between two ranks the straight line.

    A first pass takes approximate quantiles a little below and above each share.  They hold its rank between them, because the
    slack is twice the error, so the second pass counts what lies below and looks only at the few values within.  Tables that are
    small against the accuracy are looked at whole.  A column without a value has a null.
    """
    slack = 2 / accuracy
    probes = F.array(*[F.lit(p) for q in shares for p in (max(0.0, q - slack), min(1.0, q + slack))])
    number = lambda c: F.col(f"`{c}`").cast("double")
    near = df.agg(*[F.struct(F.count(number(c)).alias("n"), F.percentile_approx(number(c), probes, accuracy).alias("e")).alias(f"_{i}") for i, c in enumerate(columns)])
    wide = lambda c: F.coalesce(F.col(f"{c}.n") < 2 * accuracy, F.lit(True))

    def bracket(i: int, k: int, q: float) -> Column:
        low = F.when(wide(f"_{i}") | F.lit(q - slack <= 0), -inf).otherwise(F.get(f"_{i}.e", F.lit(2 * k)))
        high = F.when(wide(f"_{i}") | F.lit(q + slack >= 1), None).otherwise(F.get(f"_{i}.e", F.lit(2 * k + 1)))
        return F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(q).alias("q"), F.col(f"_{i}.n").alias("n"), low.alias("low"), high.alias("high"))

    brackets = near.select(F.explode(F.array(*[bracket(i, k, q) for i in range(len(columns)) for k, q in enumerate(shares)])).alias("b")).select("b.*")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), number(c).alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*").where("v IS NOT NULL")
    met = values.join(F.broadcast(brackets.select("i", "k", "low", "high")), "i").where("high IS NULL OR v <= high")
    counts = met.groupBy("i", "k", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("i", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0))
    place = F.col("q") * (F.col("n") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    x = counts.withColumn("upto", upto).join(F.broadcast(brackets.select("i", "k", "q", "n")), ["i", "k"])
    found = x.groupBy("i", "k", "n", place.alias("p")).agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"))
    lower, upper = F.floor("p"), F.ceil("p")
    value = F.when(lower == upper, F.col("a")).otherwise((upper - F.col("p")) * F.col("a") + (F.col("p") - lower) * F.col("b"))
    out = brackets.select("i", "k", "n").join(found.select("i", "k", value.alias("value")), ["i", "k"], "left")
    return out.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("i")).alias("column"), "k", "n", "value")


def group_quantiles(df: DataFrame, keys: list[str], columns: list[str], shares: tuple[float, ...], accuracy: int = 1_000) -> DataFrame:
    """(keys, column, k, n, value): ``exact_quantiles`` within each group; a group without known values of a column has no row.

    Approximate quantiles of a group are partial sums of fixed size, so its rows may lie in any number of tasks, and the second pass
    counts them there before anything of them meets.  Only the values between two brackets meet: a few in ``accuracy`` of a group, or
    all of a group that is small against it.
    """
    slack = 2 / accuracy
    probes = F.array(*[F.lit(p) for q in shares for p in (max(0.0, q - slack), min(1.0, q + slack))])
    values = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")).select(*keys, "x.*").where("v IS NOT NULL")
    near = values.groupBy(*keys, "i").agg(F.count("v").alias("n"), F.percentile_approx("v", probes, accuracy).alias("e"))
    small = F.col("n") < 2 * accuracy

    def bracket(k: int, q: float) -> Column:
        low = F.when(small | F.lit(q - slack <= 0), -inf).otherwise(F.get("e", F.lit(2 * k)))
        high = F.when(small | F.lit(q + slack >= 1), inf).otherwise(F.get("e", F.lit(2 * k + 1)))
        return F.struct(F.lit(k).alias("k"), F.lit(q).alias("q"), low.alias("low"), high.alias("high"))

    brackets = near.select(*keys, "i", "n", F.array(*[bracket(k, q) for k, q in enumerate(shares)]).alias("b"))
    # A group's brackets are one row; a hot group's values stay where they are if Spark broadcasts these or splits the join.
    met = values.join(brackets, [*keys, "i"]).select(*keys, "i", "n", "v", F.explode("b").alias("b")).select(*keys, "i", "n", "v", "b.*").where("v <= high")
    counts = met.groupBy(*keys, "i", "k", "q", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys, "i", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0))
    place = F.col("q") * (F.col("n") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = counts.withColumn("upto", upto).groupBy(*keys, "i", "k", "n", place.alias("p")).agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"))
    lower, upper = F.floor("p"), F.ceil("p")
    value = F.when(lower == upper, F.col("a")).otherwise((upper - F.col("p")) * F.col("a") + (F.col("p") - lower) * F.col("b"))
    return found.select(*keys, F.get(F.array(*[F.lit(c) for c in columns]), F.col("i")).alias("column"), "k", "n", value.alias("value"))
