"""Mixing sources to target weights by hierarchical budgets.

Weights run down a tree of domain, language and source.  At each node the
budget is dealt to the children in proportion to their weights, and what a child
cannot use goes to its siblings; an ancestor's other branches get only what the
whole node cannot use, since a node's capacity is that of all leaves below it.
A leaf then takes whole epochs and a prefix, by tokens, of one more epoch in
that epoch's seeded order.

The documents are not shuffled: the cut of each leaf is found from sums over
slices of the order, then over slices of the slice that holds it, and so on, so a
leaf with a third of all rows is no task's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinesia.llm._shared import plain, stored

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order that name a slice.  Each level cuts the slice found by the one before into 256 at most.
SLICES = (2, 4, 6)
MAX_BROADCAST_LEAVES = 100_000

DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}


def domain_of(source: Column) -> Column:
    """The tables name no domain: sources are dealt to four by the number in their name, others go to domain_other."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.when(number == "", "domain_other").otherwise(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        if value < 1:
            raise ValueError("weights must be 1 or more")
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("long")


def big(column: Column, digits: int = 20) -> Column:
    return column.cast(f"decimal({digits},0)")


def deal(children: DataFrame, parents: list[str]) -> DataFrame:
    """Add ``budget`` to children that have cap, w and their parent's budget as ``_b``; all whole numbers."""
    group = W.partitionBy(*parents)
    order = group.orderBy(big(F.col("cap")) / big(F.col("w"), 17), *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    x = children.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    x = x.withColumn("_w", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    x = x.withColumn("_full", big(F.col("cap")) * big(F.col("_w"), 17) <= big(F.col("_b") - F.col("_c")) * big(F.col("w"), 17))
    x = x.withColumn("_rest", F.col("_b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), F.lit(0)))
    x = x.withColumn("_wr", F.sum(F.when(~F.col("_full"), F.col("w"))).over(group))
    x = x.withColumn("_part", F.expr("(cast(_rest as decimal(20,0)) * cast(w as decimal(17,0))) div cast(_wr as decimal(20,0))"))
    x = x.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_part")).cast("long"))
    return x.drop("_c", "_w", "_full", "_rest", "_wr", "_part", "_b")


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    budget_share: tuple[int, int] = (3, 4),
    max_epochs: int = 2,
    domain_weights: dict[str, int] | None = None,
    lang_weights: dict[str, int] | None = None,
    seed: int = 7,
) -> DataFrame:
    """``df`` with struct ``_mix``: domain, lang, source, tokens, leaf_budget, copies; copies is how often to take the row.

    The budget is ``budget_share`` of all tokens (words).  A null language or source is the leaf "".  A null or empty text has
    no tokens and takes no budget.  Rows of one id lie together in each epoch's order and are taken together, repeated ones too.
    Ties between children are broken by their names.  An empty table gives an empty table.  A text of any length is counted whole.
    ``df`` may have any further columns but ``_mix``.
    """
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    leaf = [domain_of(F.col(source_col)).alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")]
    narrow = stored(df.select(F.col(id_col).cast("string").alias("_id"), *leaf, tokens.alias("tokens")))

    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("have")).withColumn("cap", F.col("have") * max_epochs)
    leaves = stored(leaves)
    total = leaves.agg(F.sum("have").alias("_t"), F.sum("cap").alias("_c")).select(F.least((F.col("_t") * budget_share[0]).cast("decimal(38,0)") / budget_share[1], F.col("_c")).cast("decimal(38,6)").alias("_b")).select(F.floor("_b").cast("long").alias("_b"))
    by_domain = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(F.col("domain"), DOMAIN_WEIGHTS if domain_weights is None else domain_weights))
    by_domain = deal(by_domain.join(F.broadcast(total)).withColumn("_root", F.lit(0)), ["_root"]).select("domain", F.col("budget").alias("_b"))
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(F.col("lang"), LANG_WEIGHTS if lang_weights is None else lang_weights))
    by_lang = deal(by_lang.join(by_domain, "domain"), ["domain"]).select("domain", "lang", F.col("budget").alias("_b"))
    budgets = deal(leaves.withColumn("w", F.lit(1).cast("long")).join(by_lang, ["domain", "lang"]), ["domain", "lang"])
    budgets = stored(
        budgets.select(*LEVELS, F.col("budget").alias("leaf_budget"), F.when(F.col("have") > 0, F.expr("budget div have")).otherwise(0).cast("long").alias("full"))
        .join(leaves.select(*LEVELS, "have"), list(LEVELS))
        .select(*LEVELS, "leaf_budget", "full", (F.col("leaf_budget") - F.col("full") * F.col("have")).alias("need"))
    )
    small = budgets.count() <= MAX_BROADCAST_LEAVES
    bound = F.broadcast if small else lambda x: x

    keyed = narrow.join(bound(budgets.where("need > 0")), list(LEVELS)).select(*LEVELS, "need", "tokens", order_key(seed, F.col("full"), F.col("_id")).alias("_key"))
    upto = W.partitionBy(*LEVELS).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)
    edge, inside = None, keyed.withColumn("_left", F.col("need"))
    for digits in SLICES:
        slices = inside.groupBy(*LEVELS, "_left", F.substring("_key", 1, digits).alias("_slice")).agg(F.sum("tokens").alias("_t"))
        found = slices.withColumn("_upto", F.sum("_t").over(upto)).where("_upto > _left and _upto - _t <= _left")
        edge = stored(found.select(*LEVELS, "_slice", (F.col("_left") - F.col("_upto") + F.col("_t")).alias("_left")))
        inside = keyed.withColumn("_slice", F.substring("_key", 1, digits)).join(bound(edge), [*LEVELS, "_slice"])
    last = inside.withColumn("_sum", F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("_key"))).where("_sum <= _left").groupBy(*LEVELS).agg(F.max("_key").alias("_last"))
    cut = edge.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("_last", "_slice").alias("_cut"))
    cuts = stored(budgets.join(cut, list(LEVELS), "left").select(F.struct(*LEVELS).alias("leaf"), "leaf_budget", "full", "need", F.col("_cut").alias("cut")))

    # The rows travel as one struct, so no column of theirs meets one of these.
    x = df.select(F.struct(*[F.col(plain(c)) for c in df.columns]).alias("row"), F.struct(*leaf).alias("leaf"), tokens.alias("tokens"), F.col(id_col).cast("string").alias("key"))
    x = x.join(bound(cuts), "leaf")
    copies = F.col("full") + F.when((F.col("need") > 0) & (F.col("cut").isNull() | (order_key(seed, F.col("full"), F.col("key")) <= F.col("cut"))), 1).otherwise(0)
    taken = F.struct("leaf.domain", "leaf.lang", "leaf.source", "tokens", "leaf_budget", copies.cast("long").alias("copies"))
    return x.select(*[F.col(f"row.{plain(c)}").alias(c) for c in df.columns], taken.alias("_mix"))


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """Where a row comes in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key, F.lit("null"))))
