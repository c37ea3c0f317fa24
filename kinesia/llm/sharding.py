"""Two-pass external shuffle into shards (native: DataFrame functions only).

Pass one scatters the rows into buckets that fit in memory: the shard by the id,
the bucket in it by a seeded hash of id and text, so that one id may have any
number of rows; pass two gathers each bucket as an array, shuffles it by
Fisher-Yates (``shuffle`` with a seed) and writes it in that order.  A shard is made of whole
buckets, so it needs no task that holds all of it.

The law is ``key``: the id and the number of shards decide the shard, by highest
random weight, so that one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinesia.llm._shared import plain, stored

ROW_BYTES = 16
#: A bucket beyond so many times its size, its largest row aside, holds many equal rows.
OVERFULL = 4
#: Tasks of the second pass.  The buckets' number has no bound: beyond this many a task takes several buckets, one after the other.
MAX_TASKS = 20_000
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def weight(seed: int, shard: Column | int, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), shard if isinstance(shard, Column) else F.lit(shard), key)


def shard_of(key: Column, n: int, seed: int) -> Column:
    """struct(h, s): the highest weight and the shard that has it; a null key has a shard too."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(weight(seed, s, key).alias("h"), s.alias("s"))))


def external_shuffle(
    df: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    seed: int = 20240611,
    bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """``keep`` columns (all, if None) and the columns ``RESULT``, in the order in which they are to be written.

    size: UTF-8 bytes of the text plus 16 (null text: 16); text_crc32: unsigned, null for a null text; slot: from 0, without
    gaps, in each shard; grown_shard: the shard among ``n_shards + 1``.  A row with a null id goes to the shard of null.
    Repeated rows are kept, each with a slot of its own.  Input columns named like a result column are replaced; any others may have
    any name.  An empty table gives an empty one.  Rows with equal texts form no group here: each goes to its own id's shard, and
    their order in a bucket is as random as any.  A text beyond ``bucket_bytes`` is one row of its bucket, whole.
    A bucket holds ``bucket_bytes`` on average, by one sum over the sizes of each shard, however many rows an id has.  Only equal
    rows of an id share a bucket; if these overfill one, the table is written once with a number for each row that deals them too.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    names = [c for c in (df.columns if keep is None else keep) if c not in RESULT]
    size = F.coalesce(F.octet_length(F.col(plain(text_col))), F.lit(0)).cast("long") + F.lit(ROW_BYTES)
    key, crc = F.col(plain(id_col)), F.crc32(F.col(plain(text_col)).cast("binary"))
    best = shard_of(key, n_shards, seed)
    shard = best["s"]
    sums = dict(df.select(shard.alias("_shard"), size.alias("_size")).groupBy("_shard").agg(F.sum("_size")).collect())
    n_buckets = [-(-sums.get(s, 1) // bucket_bytes) for s in range(n_shards)]
    of_shard = F.get(F.array(*[F.lit(n) for n in n_buckets]), shard)

    def placed(*salt: Column) -> tuple[list[Column], DataFrame]:
        """The columns _shard and _bucket, and the rows and bytes in each."""
        place = [shard.alias("_shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), key, crc, *salt), of_shard).cast("int").alias("_bucket")]
        n = df.select(*place, size.alias("_size")).groupBy("_shard", "_bucket")
        return place, stored(n.agg(F.count(F.lit(1)).alias("_n"), (F.sum("_size") - F.max("_size")).alias("_rest")))

    place, counts = placed()
    if counts.where(F.col("_rest") > OVERFULL * bucket_bytes).limit(1).count():
        salt = max(["_salt", *df.columns], key=len) + "_"
        df = stored(df.withColumn(salt, F.monotonically_increasing_id()))
        place, counts = placed(F.col(plain(salt)))
    before = W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))

    grown = F.when(weight(seed, n_shards, key) >= best["h"], F.lit(n_shards)).otherwise(best["s"]).cast("int")
    rows = df.select(
        *place,
        F.struct(
            key.alias("_id"), size.alias("size"), crc.alias("text_crc32"), grown.alias("grown_shard"),
            F.struct(*[F.col(plain(c)).alias(c) for c in names]).alias("row"),
        ).alias("_row"),
    )
    partitions = min(MAX_TASKS, sum(n_buckets))
    buckets = (
        rows.repartition(partitions, "_shard", "_bucket")
        .groupBy("_shard", "_bucket")
        .agg(F.collect_list("_row").alias("_rows"))
        # The order before the shuffle is fixed, so a task that runs again gives the same result.
        .select("_shard", "_bucket", in_order("_rows", df.schema, names).alias("_rows"))
        .sortWithinPartitions("_shard", "_bucket")
        .select("_shard", "_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    )
    dealt = buckets.join(first, ["_shard", "_bucket"]).select("_shard", "_first", F.posexplode("_rows").alias("_at", "_row"))
    return dealt.select(
        *[F.col(f"_row.row.{plain(c)}").alias(c) for c in names],
        F.col("_row.size").alias("size"),
        F.col("_row.text_crc32").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_at")).cast("long").alias("slot"),
        F.col("_row.grown_shard").alias("grown_shard"),
    )


def in_order(rows: str, schema: T.StructType, names: list[str]) -> Column:
    """The array in the order of its rows' values; rows that hold a type without an order go by id, size and checksum."""
    if any(isinstance(schema[c].dataType, (T.MapType, T.VariantType)) for c in names):
        keyed = F.transform(rows, lambda r: F.struct(r["_id"], r["size"], r["text_crc32"]))
        pairs = F.arrays_zip(keyed.alias("k"), F.transform(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: i).alias("i"))
        return F.transform(F.sort_array(pairs), lambda p: F.element_at(rows, p["i"] + 1))
    return F.sort_array(rows)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; the rows of each of its files are in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
