"""Benchmark decontamination by spaced seeds (native: DataFrame functions only).

A seed is a window of ``SPAN`` words of which a fixed mask ignores some, so a
substituted word spoils only the windows in which the mask reads it.  Seeds of
the documents are joined with those of the benchmark; around each hit the item is
laid along the document, and the best stretch of words, where a match counts 1
and a substitution -2, decides, or the share of the item's words that match there.

Words are runs of letters and digits, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks; 1: the word counts.  Their ignored words lie 4, 5, 6, 7 or more apart too, so a passage of 15 words or more in which
#: every fourth or later word was substituted keeps a seed at some position; one of 12 to 14 words may have none.
MASKS = ("110110101101", "111000110111", "110101110111", "010111011011", "111011101110")
SPAN = len(MASKS[0])
SUBSTITUTION = 2
LEAST_SCORE = 12
#: Percent of an item's words that match where it is laid; so many are a copy of the whole item, however short it is.
LEAST_SHARE = 75
MAX_BROADCAST_SEEDS = 2_000_000
SEPARATOR = r"[^\p{L}\p{N}]+"


def no_word() -> Column:
    return F.xxhash64(F.lit(None).cast("string"), F.lit(0))


def word_hashes(text: Column) -> Column:
    """A leading or trailing separator leaves an empty word at that edge, which shifts positions and matches nothing."""
    return F.transform(F.split(F.lower(text), SEPARATOR), lambda w: F.when(w == "", no_word()).otherwise(F.xxhash64(w)))


def real_words(h: str) -> Column:
    return F.filter(h, lambda w: w != no_word())


def seed_hash(words: Column, at: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, at + p) for p, c in enumerate(MASKS[mask]) if c == "1"])


def seeds(df: DataFrame) -> DataFrame:
    """df(h, ...) with a row for each window and mask: _at, the window's first word, and _seed."""
    windows = df.where(F.size("h") >= SPAN).withColumn("_i", F.explode(F.sequence(F.lit(0), (F.size("h") - SPAN + 1) * len(MASKS) - 1)))
    windows = windows.withColumn("_at", F.floor(F.col("_i") / len(MASKS)).cast("int"))
    seed = seed_hash(F.col("h"), F.col("_at"), 0)
    for m in range(1, len(MASKS)):
        seed = F.when(F.col("_i") % len(MASKS) == m, seed_hash(F.col("h"), F.col("_at"), m)).otherwise(seed)
    return windows.withColumn("_seed", seed)


def best_stretch(flags: Column) -> Column:
    """struct(score, words): of the stretch with the greatest score, the score and the number of its matches; the first of equals."""
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("hit"), F.lit(0).alias("score"), F.lit(0).alias("words"))

    def step(s: Column, ok: Column) -> Column:
        cur = F.when(ok, s["cur"] + 1).otherwise(F.greatest(s["cur"] - SUBSTITUTION, F.lit(0)))
        hit = F.when(ok, s["hit"] + 1).when(s["cur"] > SUBSTITUTION, s["hit"]).otherwise(F.lit(0))
        better = ok & (s["cur"] + 1 > s["score"])
        return F.struct(cur.alias("cur"), hit.alias("hit"), F.when(better, cur).otherwise(s["score"]).alias("score"), F.when(better, hit).otherwise(s["words"]).alias("words"))

    return F.aggregate(flags, start, step, lambda s: F.struct(s["score"].alias("score"), s["words"].alias("words")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least_score: int = LEAST_SCORE, short_items: bool = False) -> DataFrame:
    """(doc_id, item_id, score, matched_words, item_words, at_word): a row for each document and item that overlap.

    A pair overlaps if the best stretch scores ``least_score``, or if ``LEAST_SHARE`` percent of the item's words match where it is
    laid; then all of these are the matched words.  at_word is where in the document the item would begin, for the best alignment
    (the smallest of equals).  Null or empty texts overlap with nothing.  Items of fewer than ``SPAN`` words, down to a single one,
    overlap under ``short_items`` with documents that hold all their words in a row, and otherwise with nothing.  Rows of one id are one document; a null id is reported as
    such.  Items of one id are one item.  Repeated rows count once; a text of any length is read whole; an empty table on either
    side gives an empty one; other columns, whatever their names, are not read.  The benchmark's seeds are broadcast if they are ``MAX_BROADCAST_SEEDS`` or fewer;
    beyond that they are joined by a shuffle of positions, without the texts.
    """
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item_id"), word_hashes(F.col(text_col)).alias("h"))
    items = items.withColumn("item", F.xxhash64("item_id", "h")).dropDuplicates(["item"])
    theirs = seeds(items).select("_seed", "item", F.col("_at").alias("_there"), F.size("h").alias("_long"))
    mine = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), word_hashes(F.col(text_col)).alias("h"))

    offset = (F.col("_at") - F.col("_there")).alias("offset")
    if theirs.count() <= MAX_BROADCAST_SEEDS:
        hits = seeds(mine).join(F.broadcast(theirs), "_seed").select("doc_id", "item", offset, "_long", "h")
    else:
        # Id and 128 bits of the words name a row, so ids that repeat, or are null, meet only their own hits.
        mine = mine.withColumns({"_k1": F.xxhash64("h"), "_k2": F.xxhash64(F.lit(1), "h")})
        hits = seeds(mine).select("doc_id", "_k1", "_k2", "_at", "_seed").join(theirs, "_seed").select(F.col("doc_id").alias("_d"), "_k1", "_k2", "item", offset, "_long").distinct()
        hits = hits.join(mine, (F.col("_d").eqNullSafe(F.col("doc_id"))) & (hits._k1 == mine._k1) & (hits._k2 == mine._k2)).select("doc_id", "item", "offset", "_long", "h")
    first = F.greatest(F.col("offset"), F.lit(0))
    part = hits.select("doc_id", "item", "offset", F.slice("h", first + 1, F.col("_long")).alias("part"))
    part = part.dropDuplicates(["doc_id", "item", "offset", "part"])
    lead = F.least(F.col("offset"), F.lit(0))
    flags = F.transform(F.col("h"), lambda w, j: F.coalesce(F.when(j + F.col("lead") >= 0, F.get(F.col("part"), (j + F.col("lead")).cast("int")) == w), F.lit(False)))
    laid = part.withColumn("lead", lead).join(items.select("item", "item_id", "h"), "item")
    laid = laid.withColumn("_ok", flags).withColumn("_all", F.size(F.filter("_ok", lambda x: x)))
    whole = F.col("_all") * 100 >= F.size(real_words("h")) * LEAST_SHARE
    scored = laid.select("doc_id", "item_id", "offset", F.size("h").alias("item_words"), "_all", whole.alias("_whole"), best_stretch(F.col("_ok")).alias("s"))
    scored = scored.where(F.col("_whole") | (F.col("s.score") >= least_score))
    scored = scored.withColumn("s", F.struct("s.score", F.when(F.col("s.score") >= least_score, F.col("s.words")).otherwise(F.col("_all")).alias("words")))
    scored = scored.select("doc_id", "item_id", "offset", "item_words", "s")
    if short_items:
        scored = scored.unionByName(whole_items(mine, items))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("s.score", "s.words", (-F.col("offset")).alias("_o"), "item_words")).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.score").cast("long").alias("score"), F.col("b.words").cast("long").alias("matched_words"),
        F.col("b.item_words").cast("long").alias("item_words"), (-F.col("b._o")).cast("long").alias("at_word"),
    )


def whole_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, offset, item_words, s): where items(item_id, h) of fewer than ``SPAN`` words lie word by word in docs(doc_id, h)."""
    short = items.select("item_id", F.size("h").alias("item_words"), (F.get("h", F.lit(0)) == no_word()).cast("int").alias("_lead"), real_words("h").alias("_b"))
    short = short.where((F.size("_b") > 0) & (F.size("_b") < SPAN)).withColumn("_key", F.xxhash64("_b"))
    lengths = [r[0] for r in short.groupBy(F.size("_b").alias("n")).count().collect()]
    if lengths and short.count() <= MAX_BROADCAST_SEEDS:
        short = F.broadcast(short)
    rows = docs.select("doc_id", "h", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("_n")).where(F.size("h") >= F.col("_n"))
    rows = rows.select("doc_id", F.col("_n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("h") - F.col("_n") + 1), lambda i: F.slice("h", i, F.col("_n")))).alias("_at", "_a"))
    met = rows.withColumn("_key", F.xxhash64("_a")).join(short, "_key").where(F.col("_a") == F.col("_b"))
    return met.select("doc_id", "item_id", (F.col("_at") - F.col("_lead")).alias("offset"), "item_words", F.struct(F.col("_n").alias("score"), F.col("_n").alias("words")).alias("s"))
