"""Exact duplicates by an extendible-hash index on shared files.

A text's key is the head of the SHA-256 of its normal form (the text without white
space).  The directory maps the first bits of a key to a bucket: it starts at the
depth at which an average bucket is half full; a bucket that overflows is split by
one more bit, and where its depth was the directory's, the directory doubles.

Texts move once.  A map task hands each of its texts on once, with the number of
its rows and the best of them, so a group of any size reaches its owner as one
entry for each task.  An owner task has a bucket's range of keys.  It goes through
its entries in the order of their keys, chains different texts of one key, compares
bytes along the chain, and writes one record for each text.  These records and the
directory are the index; both lie on the shared files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesia.llm._shared import dropped, plain, stored

KEY_BITS = 60
#: Texts that a bucket holds, in bytes.
BUCKET_BYTES = 16 << 20
#: A map task hands on what it has once its different texts have so many bytes.
HELD_BYTES = 32 << 20
#: Groups of more rows than this share of all go to every task with the rows; so there are at most as many.
HOT_GROUPS = 1000
#: Buckets that were split get owner tasks of their own up to this number; beyond it they stay with their first range, one after the other.
MAX_SPLIT = 10_000
#: Characters that don't count: fixed by the contract.
WHITE = " \t\n\x0b\x0c\r"

RESULT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
ENTRY = "key long, sha string, norm string, rows long, chars long, id {id}"
RECORD = "key long, chain int, sha string, norm string, group_size long, chars long, keep_id {id}"


@dataclass
class Index:
    """records: one row for each different text; buckets: the directory (prefix, depth, bytes); rows: one for each document."""

    records: DataFrame
    buckets: DataFrame
    rows: DataFrame


def _key(sha: Column, bits: int) -> Column:
    """The first ``bits`` of 60 bits of the digest, as a number below 2^60."""
    key = F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")
    return key if bits == KEY_BITS else F.shiftleft(F.shiftright(key, KEY_BITS - bits), KEY_BITS - bits)


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, KEY_BITS - depth)


def directory(sizes: DataFrame, first: int, bucket_bytes: int) -> DataFrame:
    """Buckets (prefix, depth, bytes) of the keys in ``sizes`` (key, bytes): none overflows unless it holds one key only.

    Each round counts what the overfull buckets of the last one hold, one bit deeper; the rest is settled.
    """
    depth, left, settled = first, sizes, None
    while True:
        cells = left.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), (F.min("key") < F.max("key")).alias("many"))
        cells = stored(cells.withColumn("depth", F.lit(depth)))
        over = (F.col("bytes") > bucket_bytes) & F.col("many") & (F.lit(depth) < KEY_BITS)
        fits = cells.where(~over).select("prefix", "depth", "bytes")
        settled = fits if settled is None else settled.unionByName(fits)
        if not cells.where(over).limit(1).count():
            return settled
        split = cells.where(over).select(F.col("prefix").alias("_p"))
        left = left.join(split, _prefix(F.col("key"), depth) == F.col("_p"), "left_semi")
        depth += 1


def _batch(rows: list, id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = {"sha": pa.string(), "chain": pa.int32(), "id": id_type, "keep_id": id_type}
    columns = [pa.array(c, pa.binary()).cast(pa.string()) if name == "norm" else pa.array(c, kinds.get(name, pa.int64())) for name, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _collapse(held_bytes: int):
    """Each text of a task once: rows are added up, and the best of them is kept."""

    def rank(chars: int, doc) -> tuple:
        """Most code points, then the smallest id; none comes last."""
        return -chars, doc is None, doc

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, schema = 0, None

        def entries() -> Iterator[pa.RecordBatch]:
            # Arrow's strings have 32-bit offsets, so long texts leave in several batches.
            part, n = [], 0
            for norm, (key, sha, rows, (minus, _, doc)) in held.items():
                part.append((key, sha, norm, rows, -minus, doc))
                n += len(norm)
                if n > held_bytes:
                    yield batch(part)
                    part, n = [], 0
            if part:
                yield batch(part)
            held.clear()

        def batch(part: list[tuple]) -> pa.RecordBatch:
            return _batch(part, schema.field("id").type, ["key", "sha", "norm", "rows", "chars", "id"])

        for b in source:
            schema = b.schema
            keys, shas, chars, ids = (b.column(c).to_pylist() for c in ("key", "sha", "chars", "id"))
            norms = b.column("norm").cast(pa.large_binary())
            for i in range(b.num_rows):
                norm, own = norms[i].as_py(), rank(chars[i], ids[i])
                seen = held.get(norm)
                if seen is None:
                    held[norm] = [keys[i], shas[i], 1, own]
                    size += len(norm) + 200
                else:
                    seen[2] += 1
                    seen[3] = min(own, seen[3])
            if size > held_bytes:
                yield from entries()
                size = 0
        if held:
            yield from entries()

    return run


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, held_bytes: int = HELD_BYTES, key_bits: int = KEY_BITS) -> Index:
    """The index of all rows.  ``key_bits`` below 60 makes keys collide, as tests do.

    A null text counts as empty.  The best row of a text has the most code points, then the smallest id; a null id comes last.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(plain(text_col)), F.lit(""))
    norm = F.translate(text, WHITE, "")
    base = docs.select(F.col(plain(id_col)).alias("id"), F.length(text).cast("long").alias("chars"), norm.alias("norm"))
    keyed = base.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).withColumn("key", _key(F.col("sha"), key_bits))
    rows = stored(keyed.select("id", "chars", "sha", "key", F.octet_length("norm").cast("long").alias("bytes")))

    texts = rows.groupBy("sha", "key").agg(F.max("bytes").alias("bytes"))
    sizes = stored(texts.groupBy("key").agg(F.sum("bytes").alias("bytes")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    first = min(key_bits, max(0, (2 * total // bucket_bytes).bit_length()))
    buckets = stored(directory(sizes, first, bucket_bytes))
    dropped(sizes)

    entries = keyed.select("id", "chars", "sha", "key", "norm").mapInArrow(_collapse(held_bytes), ENTRY.format(id=id_type))
    owned, n_owners = _owned(entries, buckets, first)
    dealt = owned.repartitionById(n_owners, F.col("owner")).drop("owner").sortWithinPartitions("key", "sha", "norm")
    return Index(stored(dealt.mapInArrow(_chain, RECORD.format(id=id_type))), buckets, rows)


def _owned(entries: DataFrame, buckets: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Entries with the number of their bucket's owner, and the number of owners.

    A range of the first depth has an owner; so has each bucket that was split off, as long as these are few enough to go to every task.
    """
    owner, n = _prefix(F.col("key"), first).cast("int"), 1 << first
    deep = buckets.where(F.col("depth") > first).select("prefix", "depth").orderBy("depth", "prefix").limit(MAX_SPLIT + 1).collect()
    if not deep or len(deep) > MAX_SPLIT:
        return entries.withColumn("owner", owner), n
    out = entries.withColumn("owner", owner)
    for depth in sorted({d.depth for d in deep}):
        own = [(d.prefix, n + i) for i, d in enumerate(deep) if d.depth == depth]
        small = F.broadcast(entries.sparkSession.createDataFrame(own, "_prefix long, _owner int"))
        out = out.join(small, _prefix(F.col("key"), depth) == F.col("_prefix"), "left").withColumn("owner", F.coalesce("_owner", "owner")).drop("_prefix", "_owner")
    return out, n + len(deep)


def _chain(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of (key, digest, text): one record for each different text of a key, numbered along its chain."""
    open_: list | None = None

    names = ["key", "chain", "sha", "norm", "group_size", "chars", "keep_id"]
    schema = None
    for b in source:
        schema, done, size = b.schema, [], 0
        keys, shas, rows, chars, ids = (b.column(c).to_pylist() for c in ("key", "sha", "rows", "chars", "id"))
        norms = b.column("norm").cast(pa.large_binary())
        for i in range(b.num_rows):
            norm = norms[i].as_py()
            if open_ is not None and open_[0] == keys[i] and open_[3] == norm:
                open_[4] += rows[i]
                if chars[i] > open_[5] or chars[i] == open_[5] and ids[i] is not None and (open_[6] is None or ids[i] < open_[6]):
                    open_[5:] = [chars[i], ids[i]]
                continue
            if open_ is not None:
                if open_[0] == keys[i] and open_[2] == shas[i]:
                    raise ValueError(f"two texts have the digest {shas[i]}")
                done.append(open_)
                size += len(open_[3])
            chain = open_[1] + 1 if open_ is not None and open_[0] == keys[i] else 0
            open_ = [keys[i], chain, shas[i], norm, rows[i], chars[i], ids[i]]
            if size > HELD_BYTES:
                yield _batch(done, schema.field("id").type, names)
                done, size = [], 0
        if done:
            yield _batch(done, schema.field("id").type, names)
    if open_ is not None:
        yield _batch([open_], schema.field("id").type, names)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``RESULT`` for each row of ``docs``, dropped ones too.

    A text's rows are equal if they are so without the characters of ``WHITE``; null, empty and white texts are one group.  Of a
    group the row with the most code points stays, of such rows the one with the smallest id (a null id comes last).  ``kept``
    marks it; rows that repeat its id at the same length are it as well.  Texts of any length are compared whole.  Input columns beside
    these two play no part, whatever their names.  An empty table gives an empty one.
    """
    found = index(docs, id_col=id_col, text_col=text_col, **options)
    groups = found.records.select("sha", "group_size", F.col("chars").alias("_most"), "keep_id")
    n = found.rows.count()
    hot = F.col("group_size") > max(1, n // HOT_GROUPS)
    rows = found.rows.select(F.col("id").alias("doc_id"), "chars", "sha")
    # At most HOT_GROUPS groups are hot, and only their rows could make one task large.
    large = F.broadcast(groups.where(hot))
    both = rows.join(large, "sha").unionByName(rows.join(large, "sha", "left_anti").join(groups.where(~hot), "sha"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("_most"))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
