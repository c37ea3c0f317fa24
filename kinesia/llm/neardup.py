"""Near-duplicate documents by circulant MinHash.

Two permutations give all coordinates of a signature: the first places the
shingles, the second is shifted by one place for each further coordinate, and a
coordinate is the smallest value of a document's shingles.  Bands of coordinates
propose pairs, and full sets of shingles confirm them.

What keeps large groups linear:

- documents with equal sets are one node from the start;
- shingles that no other candidate has bound a node's overlap with any other, so
  pairs that cannot link are not compared (the bound loses nothing);
- each bucket is first compared with its most central member only.  Pairs of a
  bucket that are in one component by then need no comparison;
- of all others, those that share a shingle of fewer than ``RARE`` members are
  compared.  A pair that shares none overlaps in common shingles only, so members
  whose common shingles cannot make a link with any of their bucket leave it;
- what is left of a bucket of up to ``SMALL`` members is compared within it.  In a
  larger one the members of its smallest components, ``SMALL`` at most, are compared
  with all others and leave it.  The members of those that are mixed still get a longer signature, cut into more and longer bands,
  in which texts that merely share much of their wording no longer meet; and so
  on by ``LEVELS``.  What still shares a large bucket in the last level is compared
  in full, so no pair that met is given up;
- full sets are fetched only for pairs whose sketches allow the similarity.  A sketch
  holds for each of ``SKETCH`` parts of the hash space whether the set has an odd number of
  shingles there, so two sketches differ in no more bits than there are shingles in one of
  the sets only, and the test loses nothing.  It excludes little where sets are many times
  as large as a sketch has bits.

At each level a pair at the threshold, 0.85, shares no bucket with a probability
of 1e-6 or less.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia.llm import _text
from kinesia.llm._graph import components
from kinesia.llm._shared import dropped, stored

SHINGLE = 5
BANDS, ROWS = 24, 5
#: A shingle of fewer members than this is compared within all of them.
RARE = 8
#: A bucket of up to so many members is compared within; larger ones go to the next level.
SMALL = 16
#: Bands and rows of the longer signatures.
LEVELS = ((64, 10), (350, 20))
PERCENT = 85
#: Bits of a set's sketch.
SKETCH = 1024
#: Values of a signature's matrix that are held at once.
_CELLS = 1 << 18
_U32 = np.uint32


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """For each text, the sorted hashes of its distinct shingles; a text of fewer words has its whole sequence as one."""
    a, b = _text.spans(~_text.IS_SPACE[data], offs)
    own = _text.owner(a, offs)
    h = _text.span_hash(data, a, b, True)
    g, at = _text.grams(h, own, n)
    bounds = np.searchsorted(own[at], np.arange(len(offs)))
    words = np.searchsorted(own, np.arange(len(offs)))
    out = []
    for i in range(len(offs) - 1):
        w = words[i + 1] - words[i]
        if 0 < w < n:
            out.append(_text.grams(h[words[i] : words[i + 1]], own[words[i] : words[i + 1]], w)[0] + np.uint64(w))
        else:
            x = np.sort(g[bounds[i] : bounds[i + 1]])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` coordinates: min over shingles of p((s(shingle) - k) mod 2^32)."""
    place = (_text.mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(_U32)
    shifts = np.arange(size, dtype=_U32)[:, None]
    best = np.full(size, 0xFFFFFFFF, _U32)
    block = max(1, _CELLS // size)
    for k in range(0, len(place), block):
        x = place[None, k : k + block] - shifts
        x ^= x >> _U32(16)
        x *= _U32(0x85EBCA6B)
        x ^= x >> _U32(13)
        x *= _U32(0xC2B2AE35)
        x ^= x >> _U32(16)
        np.minimum(best, x.min(1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = _text.mix(key ^ part[:, r])
    return key


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one = int(_text.mix(shingles).sum(dtype=np.uint64)) if len(shingles) else 0
    two = int(_text.mix(shingles ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64)) if len(shingles) else 0
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)


def signatures(df: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, f1, f2, keys) of each row of df(id, text)."""

    @_text.batches("text")
    def kernel(batch, data, offs):
        sets = shingle_sets(data, offs)
        prints = [fingerprint(s) for s in sets]
        keys = np.stack([band_keys(signature(s, bands * rows), bands, rows) for s in sets]) if sets else np.zeros((0, bands), np.uint64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), flat],
            ["id", "n", "f1", "f2", "keys"],
        )

    return df.mapInArrow(kernel, "id long, n long, f1 long, f2 long, keys array<long>")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of ``SKETCH`` parts, as 64-bit words."""
    part = _text.mix(shingles ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(SKETCH)
    odd = np.bincount(part.astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def full_sets(df: DataFrame) -> DataFrame:
    """(id, n, set, bits) of each row of df(id, text, f1) whose set has that fingerprint: its size, itself and its sketch."""

    @_text.batches("text")
    def kernel(batch, data, offs):
        sets = shingle_sets(data, offs)
        wanted = batch.column(2).to_pylist()
        keep = [i for i, s in enumerate(sets) if fingerprint(s)[0] == wanted[i]]
        values = np.concatenate([sets[i] for i in keep]) if keep else np.zeros(0, np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in keep])])
        flat = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
        words = np.concatenate([sketch(sets[i]) for i in keep]) if keep else np.zeros(0, np.int64)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * (SKETCH // 64), pa.int32()), pa.array(words))
        ids = batch.column(0).take(pa.array(keep, pa.int32()))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds), pa.int64()), flat, bits], ["id", "n", "set", "bits"])

    return df.select("id", "text", "f1").mapInArrow(kernel, "id long, n long, set array<long>, bits array<long>")


def longer_keys(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(rep, key) for each band of each row of sets(id, set)."""

    def kernel(source):
        for batch in source:
            values, width = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(width)
            for i in range(batch.num_rows):
                key = band_keys(signature(values[ends[i] - width[i] : ends[i]], bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], bands), pa.array(key.view(np.int64))], ["rep", "key"])

    return sets.select("id", "set").mapInArrow(kernel, "rep long, key long")


def can_link(n1: Column, c1: Column, n2: Column, c2: Column, percent: int) -> Column:
    """Whether the sizes n and the numbers c of shingles that others have too allow the similarity."""
    return (F.least(c1, c2) * (100 + percent) >= (n1 + n2) * percent) & (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)


def pairs_within(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs (a, b) of rows(key, rep, n, c, comp) that share a key, lie in two components and may link."""
    left, right = rows.alias("l"), rows.alias("r")
    apart = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.rep") < F.col("r.rep")) & (F.col("l.comp") != F.col("r.comp"))
    bound = can_link(F.col("l.n"), F.col("l.c"), F.col("r.n"), F.col("r.c"), percent)
    return left.join(right, apart & bound).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))


def pairs_between(few: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a row of few and a row of rows, both (key, rep, n, c, comp), that share a key, lie in two components and may link."""
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")) & can_link(F.col("l.n"), F.col("l.c"), F.col("r.n"), F.col("r.c"), percent)
    return few.alias("l").join(rows.alias("r"), met).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))


def smallest_components(rows: DataFrame) -> DataFrame:
    """(key, comp) of each bucket's smallest components, of ``SMALL`` members together at most; never all of a larger bucket's."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    order = W.partitionBy("key").orderBy("k", "comp")
    first = sizes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SMALL)
    return first.withColumn("total", F.sum("k").over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("total") <= SMALL).select("key", "comp")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = reduce(Column.__add__, [F.bit_count(F.get("sa", i).bitwiseXOR(F.get("sb", i))) for i in range(SKETCH // 64)])
    return x.where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return x.where(same * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b").distinct()


def apart(cand: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, rep, n, c, comp) of the buckets of cand(key, rep, n, c) whose members aren't all in one component."""
    placed = cand.drop("comp").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).select("key", "rep", "n", "c", "comp")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return placed.join(mixed, "key", "left_semi")


def linkable(cand: DataFrame, percent: int) -> DataFrame:
    """cand(key, rep, n, c) without the rows whose c shingles don't suffice even with the smallest set of the bucket that they may link with."""
    least = cand.groupBy("key").agg(F.min("n").alias("_least"))
    fits = F.col("c") * (100 + percent) >= (F.col("n") + F.greatest(F.col("_least"), F.ceil(F.col("n") * percent / 100))) * percent
    return cand.join(least, "key").where(fits).drop("_least")


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, levels: tuple[tuple[int, int], ...] = LEVELS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A null text or one without words has no
    shingle and is linked with nothing.  Rows of one id are one document; if their texts differ, the one with the smallest
    fingerprint decides.  A row without an id is a component of its own, with a null id, and is kept.  Repeated rows each have a
    row.  Texts of any length are read whole; an empty table gives an empty one; other columns, whatever their names, are not read.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = stored(signatures(source, bands, rows))
    one = sig.where("id IS NOT NULL AND n > 0").groupBy("id").agg(F.min(F.struct("f1", "f2", "n", "keys")).alias("s")).select("id", "s.*")
    one = stored(one)
    groups = stored(one.groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "keys")).alias("s")).select("f1", "f2", F.col("s.id").alias("rep"), "s.n", "s.keys"))

    keyed = groups.select("rep", "n", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    cand = stored(keyed.join(shared, "key"))
    nodes = groups.select("rep", "f1").join(cand.select("rep").distinct(), "rep", "left_semi")
    sets = stored(full_sets(source.join(nodes, source.id == nodes.rep)))
    alone = sets.select("id", F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    cand = cand.join(alone.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.col("n") - F.coalesce("u", F.lit(0)))
    cand = stored(cand.where(F.col("c") * 100 >= F.col("n") * percent).select("key", "rep", "n", "c"))

    center = cand.groupBy("key").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("rep")).alias("_r"), F.col("n"), F.col("c"))).alias("t"))
    center = stored(center.select("key", (-F.col("t._r")).alias("top"), F.col("t.n").alias("tn"), F.col("t.c").alias("tc")))
    stars = cand.join(center, "key").where((F.col("rep") != F.col("top")) & can_link(F.col("n"), F.col("c"), F.col("tn"), F.col("tc"), percent))
    stars = stored(stars.select(F.least("rep", "top").alias("a"), F.greatest("rep", "top").alias("b")).distinct())
    links = stored(confirmed(possible(stars, sets, percent), sets, percent))
    comps = components(links)

    mixed = stored(apart(cand, comps))
    members = stored(mixed.select("rep", "n", "c", "comp").distinct())
    items = members.join(sets.select(F.col("id").alias("rep"), "set"), "rep").select("rep", "n", "c", "comp", F.explode("set").alias("s"))
    held = items.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    items = stored(items.join(held, "s"))
    pairs, k = [stored(pairs_within(items.where(F.col("k") < RARE), "s", percent).distinct())], 0
    # From here on c counts the common shingles only.
    common = items.where(F.col("k") >= RARE).groupBy("rep").agg(F.count(F.lit(1)).alias("common"))
    rest = stored(apart(linkable(mixed.join(common, "rep").drop("c", "comp").withColumnRenamed("common", "c"), percent), comps))
    dropped(cand, shared, center, mixed, members, items)
    while True:
        sizes = stored(rest.groupBy("key").agg(F.count(F.lit(1)).alias("m")))
        more = sizes.where(F.col("m") > SMALL).limit(1).count() > 0
        small = rest if not more or k == len(levels) else rest.join(sizes.where(F.col("m") <= SMALL), "key", "left_semi")
        pairs.append(stored(pairs_within(small, "key", percent).distinct()))
        if not more or k == len(levels):
            break
        large = stored(rest.join(sizes.where(F.col("m") > SMALL), "key", "left_semi"))
        few = stored(smallest_components(large))
        pairs.append(stored(pairs_between(large.join(few, ["key", "comp"], "left_semi"), large, percent).distinct()))
        members = stored(apart(large.join(few, ["key", "comp"], "left_anti"), comps).select("rep", "n", "c", "comp").distinct())
        keys = longer_keys(sets.join(members, sets.id == members.rep, "left_semi"), *levels[k])
        cand = stored(keys.join(members, "rep").select("key", "rep", "n", "c"))
        longer = stored(apart(linkable(cand, percent), comps))
        dropped(rest, sizes, large, few, members, cand)
        rest, k = longer, k + 1
    dropped(rest, sizes)
    tested = reduce(DataFrame.union, pairs).distinct().join(stars, ["a", "b"], "left_anti")
    more = stored(confirmed(possible(tested, sets, percent), sets, percent))
    if more.limit(1).count():
        comps = components(links.union(more))
    dropped(sets, stars, links, more, *pairs)

    member = one.select("id", "f1", "f2").join(groups.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "rep")
    placed = member.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("id").alias("_m"), F.coalesce("comp", "rep").alias("comp"))
    out = sig.select("id", "n").join(placed, F.col("id") == F.col("_m"), "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
