"""Audit of how filters interact, by inclusion and exclusion.

For each part one aggregate counts the joint failures of all 32 sets of the five
filters, as sums of products of flags.  All figures come from these counts alone:

* survivors of a set T: the sum over its subsets S of (-1)^|S| J(S);
* failing one filter only: the same inversion over the sets that hold it;
* redundancy at a step: the filter's failures less what it removes there;
* the game "removed by T" has the Harsanyi dividends (-1)^(|S|+1) J(S), and a filter's
  Shapley value is the sum of its sets' dividends, each shared equally.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesia.llm._shared import plain

FILTERS = "ABCDE"
#: A set of filters is a number; the first filter is bit 0.
SETS = range(1 << len(FILTERS))
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: Fixed by the contract.
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails A, B, C and D, as 0 or 1."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT_PCT * n.cast("long"),
        "C": 100 * capitals > MOST_CAPITALS_PCT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    return {k: v.cast("int") for k, v in fails.items()}


def joint_failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filters (a set of them, as a number), and how many documents fail all of these: n, n_good and n_toxic; 32 rows a part.

    Null texts are empty and a null part is the empty string.  E: a row fails if any smaller id has the same text; a null id is
    larger than any other.  Repeated rows of an id count each.  If an id has several labels, one that is 1 suffices.
    """
    text = F.coalesce(F.col(plain(text_col)), F.lit(""))
    flags = text_flags(F.col("text"))
    rows = docs.select(F.col(plain(id_col)).alias("id"), F.coalesce(F.col(plain(part_col)).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *[c.alias(k) for k, c in flags.items()])
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    keys = ["sha", "part", "A", "B", "C", "D", "good", "toxic"]
    # Rows without an id have no label; beside the join they can't meet in one task.
    rows = rows.where("id IS NOT NULL").join(marks, "id", "left").unionByName(rows.where("id IS NULL"), allowMissingColumns=True)
    marked = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # A text's rows meet as a few sums, one for each part and label, however many copies it has.
    same = marked.groupBy("id", *keys).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), (-F.col("n")).alias("minus")))
    kinds = same.groupBy(*keys).agg(F.sum("n").alias("n"), first.alias("first"))
    every = kinds.groupBy("sha").agg(F.min("first").alias("least")).withColumnRenamed("sha", "_sha")
    joined = kinds.join(every, F.col("sha") == F.col("_sha"))
    # Of the rows of a kind those of the text's least id pass E.
    free = F.when(F.col("first.id").eqNullSafe(F.col("least.id")), -F.col("first.minus")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(0).alias("E"), free.alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - free).alias("n"))))
    counted = joined.select("part", *FILTERS[:4], "good", "toxic", split.alias("e")).select("part", *FILTERS[:4], "e.*", "good", "toxic")
    patterns = counted.groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))
    product = F.lit(1)
    for i, f in enumerate(FILTERS):
        product = product * F.when(F.col("filters").bitwiseAND(1 << i) != 0, F.col(f)).otherwise(1)
    each = patterns.withColumn("filters", F.explode(F.lit(list(SETS)))).withColumn("n", F.col("n") * product)
    return each.groupBy("part", "filters").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def _sign(s: int) -> int:
    return -1 if s.bit_count() % 2 else 1


def coefficients() -> list[tuple[int, int, int, int, int, int, int, int]]:
    """What each joint count adds to each figure of the 80 steps (filters before, next filter): a row for each step and set that matters.

    before, filter, filters; then the factors of survivors after the step, of documents removed by it, of the filter's own
    failures, of those that fail it only, and of its Shapley value times the number of orders.
    """
    out = []
    for before in SETS:
        for i in range(len(FILTERS)):
            f = 1 << i
            if before & f:
                continue
            after = before | f
            for s in SETS:
                kept = _sign(s) if s & after == s else 0
                removed = (_sign(s) if s & before == s else 0) - kept
                unique = -_sign(s) if s & f else 0
                # The set's dividend, shared by its filters.
                share = -_sign(s) * factorial(len(FILTERS)) // s.bit_count() if s & f else 0
                row = (kept, removed, int(s == f), unique, share)
                if any(row):
                    out.append((before, f, s, *row))
    return out


def interactions(joint: DataFrame) -> DataFrame:
    """part, filter_order, step and ``FIGURES`` for every part, order and step, zeros included.

    Every figure is a linear form in a part's 32 counts, so it is one join with a fixed table of factors and one sum.
    """
    spark = joint.sparkSession
    factors = spark.createDataFrame(coefficients(), "before int, filter int, filters int, kept int, removed int, alone int, only int, share int")
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, i in enumerate(order):
            steps.append(("".join(FILTERS[j] for j in order), k + 1, before, 1 << i))
            before |= 1 << i
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, filter int")

    def total(factor: str, count: str = "n") -> Column:
        return F.sum(F.col(factor) * F.col(count)).cast("long")

    # Both tables are fixed: 2,560 and 600 rows at most.
    moves = (
        joint.join(F.broadcast(factors), "filters")
        .groupBy("part", "before", "filter")
        .agg(
            total("kept").alias("kept"), total("removed").alias("removed"), (total("alone") - total("removed")).alias("redundant"), total("only").alias("unique_fails"),
            total("removed", "n_good").alias("good_lost"), total("removed", "n_toxic").alias("toxic_lost"), total("share").alias("shapley"),
        )
    )
    return moves.join(F.broadcast(orders), ["before", "filter"]).select("part", "filter_order", "step", *FIGURES)
