"""Repeated passages by sparse suffix arrays.

Only suffixes that begin at content-selected positions are kept: those whose
8-word gram has the smallest hash in some window of 24 grams (minimisers).  Two
occurrences of a passage of ``LEAST`` words select the same positions, the first
within its first 24 words, so at least ``HEAD`` words follow it in the passage.

Suffixes whose first ``HEAD`` words occur in one document only are dropped.  The
rest are sorted by their words (a range partitioning whose key ends in the id, so
a common passage spreads over many tasks), neighbours are compared, and matches
are extended left and right.  A suffix carries as many words on either side as
can decide whether a match reaches ``LEAST`` words; longer passages are the union
of the matches of the positions in them.  An exact check of the windows around a
position that neighbours leave open follows, so no passage is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinesia.llm import _text
from kinesia.llm._shared import dropped, stored

LEAST = 50
GRAM = 8
WINDOW = 24
HEAD = 24
#: How many rows on either side a suffix is compared with; rows of its own document don't help.
NEIGHBOURS = 3
#: Rows of a partition that are compared at once: whole heads, or a part of one head that has more.
PIECE = 50_000
SIDE = LEAST - HEAD
_U64 = np.uint64


def minimisers(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Indices of words at which a suffix is kept: minimisers that at least ``HEAD`` words of the text follow from."""
    g, at = _text.grams(h, own, GRAM)
    if len(g) < WINDOW or len(h) < HEAD:
        return np.zeros(0, np.int64)
    low, span = g, 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    m = len(g) - WINDOW + 1
    low = np.minimum(low[:m], low[WINDOW - span : WINDOW - span + m])
    low[at[WINDOW - 1 :] - at[:m] != WINDOW - 1] = 0  # a window that lies in two texts
    # A gram is selected if the greatest minimum of the windows that hold it is its own.
    high = np.concatenate([np.zeros(WINDOW - 1, _U64), low, np.zeros(WINDOW - 1, _U64)])
    span = 1
    while span * 2 <= WINDOW:
        high = np.maximum(high[: len(high) - span], high[span:])
        span *= 2
    n = len(g)
    high = np.maximum(high[:n], high[WINDOW - span : WINDOW - span + n])
    p = at[(high == g) & (high > 0)]
    p = p[p + HEAD <= len(h)]
    return p[own[p] == own[p + HEAD - 1]]


def heads(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hashes of the ``HEAD`` words from each position."""
    total = np.zeros(len(p), _U64)
    for k in range(HEAD):
        total = _text.mix(total * _U64(0x9E3779B97F4A7C15) + h[p + k])
    return total


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = _text.spans(~_text.IS_SPACE[data], offs)
    return _text.span_hash(data, a, b), _text.owner(a, offs)


def suffix_heads(df: DataFrame) -> DataFrame:
    """(id, t, head) for each distinct head of each row of df(id, t, text)."""

    @_text.batches("text")
    def kernel(batch, data, offs):
        h, own = _words(data, offs)
        p = minimisers(h, own)
        head, text = heads(h, p), own[p]
        order = np.lexsort((head, text))
        head, text = head[order], text[order]
        first = np.ones(len(head), bool)
        first[1:] = (head[1:] != head[:-1]) | (text[1:] != text[:-1])
        rows = pa.array(text[first])
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(head[first].view(np.int64))], ["id", "t", "head"])

    return df.select("id", "t", "text").mapInArrow(kernel, "id long, t binary, head long")


def _flat(rows: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as bytes that sort as the numbers do."""
    n, w = rows.shape
    data = rows.astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 4 * w).astype(np.int32)), pa.py_buffer(data)])


def suffix_rows(df: DataFrame) -> DataFrame:
    """(head, after, before, id, at, words, t) for the suffixes of df(id, t, text, heads) whose head is listed.

    after and before hold ``SIDE`` words beyond the head and to the left, nearest first, 0 beyond the text's edge.  Suffixes of a
    document that agree in all three are one row; ``at`` has their positions.
    """

    @_text.batches("text")
    def kernel(batch, data, offs):
        h, own = _words(data, offs)
        p = minimisers(h, own)
        head, text = heads(h, p).view(np.int64), own[p]
        wanted = batch.column(3)
        listed, owner = wanted.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        salt = _text.mix(np.arange(batch.num_rows, dtype=_U64) + _U64(1)).view(np.int64)
        keep = np.isin(head ^ salt[text], listed ^ salt[owner])
        p, head, text = p[keep], head[keep], text[keep]
        short = np.maximum((h >> _U64(32)).astype(np.uint32), 1)

        def side(first: np.ndarray, step: int) -> np.ndarray:
            at = first[:, None] + step * np.arange(SIDE)
            ok = (at >= 0) & (at < len(h))
            at = np.where(ok, at, 0)
            return np.where(ok & (own[at] == text[:, None]), short[at], 0) if len(p) else np.zeros((0, SIDE), np.uint32)

        after, before = side(p + HEAD, 1), side(p - 1, -1)
        start = np.searchsorted(own, np.arange(batch.num_rows + 1))
        all_of = np.zeros(len(p), _U64)
        for column in (after, before):
            for k in range(SIDE):
                all_of = _text.mix(all_of * _U64(0x9E3779B97F4A7C15) + column[:, k].astype(_U64))
        order = np.lexsort((p, all_of, head, text))
        new = np.ones(len(order), bool)
        o = order
        new[1:] = (text[o[1:]] != text[o[:-1]]) | (head[o[1:]] != head[o[:-1]]) | (all_of[o[1:]] != all_of[o[:-1]])
        one, bounds = o[new], np.append(np.flatnonzero(new), len(o)).astype(np.int32)
        at = pa.ListArray.from_arrays(pa.array(bounds if len(o) else np.zeros(1, np.int32)), pa.array((p - start[text])[o].astype(np.int32)))
        ids, texts = batch.column(0).take(pa.array(text[one])), batch.column(1).take(pa.array(text[one]))
        count = np.diff(start)[text[one]].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(head[one]), _flat(after[one]), _flat(before[one]), ids, at, pa.array(count), texts], ["head", "after", "before", "id", "at", "words", "t"])

    return df.select("id", "t", "text", "heads").mapInArrow(kernel, ROW)


ROW = "head long, after binary, before binary, id long, at array<int>, words long, t binary"


def _sides(column: pa.Array) -> np.ndarray:
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros((0, SIDE), ">u4")
    first = np.frombuffer(offs, np.int32)[column.offset]
    return np.frombuffer(data, ">u4", n * SIDE, int(first)).reshape(n, SIDE)


BOTH = "id long, t binary, words long, s int, e int, key long, o int, at array<int>"


def _ids(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return part.column(0).to_numpy(), part.column(3).to_numpy()


def extended(head: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and how far they match a neighbour of another document to the left and to the right, if that makes ``LEAST`` words."""
    n = len(head)
    run = lambda x, y: np.where((x == y).all(1) & (x != 0).all(1), SIDE, ((x != y) | (x == 0)).argmax(1))
    who, left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, NEIGHBOURS + 1):
        i = np.flatnonzero((head[: n - s] == head[s:]) & (ids[: n - s] != ids[s:])) if n > s else np.zeros(0, np.int64)
        r, m = run(after[i], after[i + s]) + HEAD, run(before[i], before[i + s])
        ok = r + m >= LEAST
        for shift in (0, s):
            who.append(i[ok] + shift)
            left.append(m[ok])
            right.append(r[ok])
    return np.concatenate(who), np.concatenate(left), np.concatenate(right)


def window_keys(head: np.ndarray, after: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each o, a key of the ``LEAST`` words that begin o words left of each row's position, and whether the text has them all."""
    step = lambda total, column: _text.mix(total * _U64(0x9E3779B97F4A7C15) + column.astype(_U64) + _U64(1))
    tails = [np.zeros(len(head), _U64)]
    for k in range(SIDE):
        tails.append(step(tails[-1], after[:, k]))
    front = head.view(_U64).copy()
    for o in range(SIDE + 1):
        if o:
            front = step(front, before[:, o - 1])
        inside = (before[:, :o] != 0).all(1) & (after[:, : SIDE - o] != 0).all(1)
        yield o, _text.mix(front ^ _text.mix(tails[SIDE - o] + _U64(o))), inside


def _spread(part: pa.Table, who: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """A match for each position of each row of ``who``."""
    at = part.column(4).combine_chunks().take(pa.array(who))
    count = at.value_lengths().to_numpy(zero_copy_only=False)
    p, row = at.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(who)), count)
    ids, words = part.column(3).to_numpy()[who][row], part.column(5).to_numpy()[who][row]
    texts = part.column(6).combine_chunks().take(pa.array(who[row]))
    null = lambda t: pa.nulls(len(row), t)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), texts, pa.array(words, pa.int64()), pa.array((p - left[row]).astype(np.int32)), pa.array((p + right[row]).astype(np.int32)), null(pa.int64()), null(pa.int32()), null(pa.list_(pa.int32()))],
        [c.split()[0] for c in BOTH.split(", ")],
    )


def _keyed(part: pa.Table, rows: np.ndarray, o: int, keys: np.ndarray, with_places: bool) -> pa.RecordBatch:
    take = lambda c: part.column(c).combine_chunks().take(pa.array(rows))
    null, kind = pa.nulls(len(rows), pa.int32()), pa.list_(pa.int32())
    at = take(4).cast(kind) if with_places else pa.nulls(len(rows), kind)
    return pa.RecordBatch.from_arrays([take(3), take(6), take(5), null, null, pa.array(keys[rows].view(np.int64)), pa.array(np.full(len(rows), o, np.int32)), at], [c.split()[0] for c in BOTH.split(", ")])


def _compared(source: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Matches within a sorted partition, taken in pieces of about ``size`` rows.

    Neighbours are compared and extended first.  A row's best partner to the right need not be its best one to the left, so
    windows of ``LEAST`` words around a position that this leaves open are compared among all rows of the head.  The first and the
    last head of a partition may go on in another one, and a head of more than ``size`` rows goes on in the next piece: their
    windows' keys are returned, to be met across pieces and partitions.
    """
    held: list[pa.RecordBatch] = []
    n, first, torn = 0, None, None

    def piece(part: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal first
        head, ids = _ids(part)
        after, before = _sides(part.column(1).combine_chunks()), _sides(part.column(2).combine_chunks())
        if first is None:
            first = head[0]
        who, left, right = extended(head, ids, after, before)
        yield _spread(part, who, left, right)
        known = np.zeros((len(head), SIDE + 1), bool)
        for o in range(SIDE + 1):
            known[who[(left >= o) & (right >= LEAST - o)], o] = True
        edge = (head == first) | (head == head[-1] if last else np.zeros(len(head), bool))
        if torn is not None:
            edge |= head == torn
        group = np.concatenate([[0], np.cumsum(head[1:] != head[:-1])])
        for o, keys, inside in window_keys(head, after, before):
            # Heads that have an open row, or that may go on elsewhere; a head's rows lie together.
            unsure = np.bincount(group, inside & ~known[:, o]) > 0
            rows = np.flatnonzero(inside & (unsure[group] | edge))
            rows = rows[np.lexsort((ids[rows], keys[rows]))]
            if len(rows) == 0:
                continue
            k, d = keys[rows], ids[rows]
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            stop = np.append(start[1:], len(k))
            several = d[start] != d[stop - 1]
            shared = np.repeat(several, stop - start)
            hit = rows[shared & ~known[rows, o]]
            if len(hit):
                yield _spread(part, hit, np.full(len(hit), o), np.full(len(hit), LEAST - o))
            # What is shared here already needs one row to speak for it elsewhere.
            yield _keyed(part, rows[~shared & edge[rows]], o, keys, True)
            yield _keyed(part, rows[start[several & edge[rows[start]]]], o, keys, False)

    for batch in source:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            part = pa.Table.from_batches(held).combine_chunks()
            head = part.column(0).to_numpy()
            cut = int(np.searchsorted(head, head[-1]))
            if not cut:
                cut, torn = len(head), head[-1]
            yield from piece(part.slice(0, cut).combine_chunks(), False)
            held, n = part.slice(cut).to_batches(), len(head) - cut
    if held:
        yield from piece(pa.Table.from_batches(held).combine_chunks(), True)


def repeated_passages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_repeat_words, n_passages, passages, text_md5): a row for each document that shares a passage of ``LEAST`` words or more.

    passages: start:end of each, in words (runs of other characters than space and 0x09-0x0D), comma-joined.  A passage counts
    only if another id has it too; what repeats within one document, or in several texts of one id, does not.  Rows of one id and
    one text are one document; each other text of an id has a row of its own, told apart by text_md5.  Null and short texts have
    no passage; rows without an id are left out.  Rows that tie in their words are sorted by id and text.  Texts of any length are
    read whole; an empty table gives an empty one; other columns, whatever their names, are not read.
    """
    text_of = F.col(text_col)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text_of)).alias("t"), text_of.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    found = stored(suffix_heads(docs))
    shared = stored(found.groupBy("head").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("head"))
    listed = found.join(shared, "head").groupBy("id", "t").agg(F.collect_set("head").alias("heads"))
    rows = stored(suffix_rows(docs.join(listed, ["id", "t"])))
    dropped(found, shared)
    order = ["head", "after", "before", "id", "t"]
    compared = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_compared, size=piece), BOTH))
    dropped(rows)
    inner = compared.where("s IS NOT NULL").select("id", "t", "words", "s", "e")
    keyed = compared.where("key IS NOT NULL")
    over = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    edges = keyed.where("at IS NOT NULL").join(over, "key").select("id", "t", "words", "o", F.explode("at").alias("p")).select("id", "t", "words", (F.col("p") - F.col("o")).alias("s"), (F.col("p") - F.col("o") + LEAST).alias("e"))
    spans = inner.union(edges)

    in_doc = W.partitionBy("id", "t").orderBy("s", "e")
    reach = F.max("e").over(in_doc.rowsBetween(W.unboundedPreceding, -1))
    isles = spans.distinct().withColumn("new", F.when(reach >= F.col("s"), 0).otherwise(1)).withColumn("k", F.sum("new").over(in_doc))
    passages = isles.groupBy("id", "t", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("words").alias("words"))
    out = passages.groupBy("id", "t").agg(F.max("words").alias("n_words"), F.sum(F.col("e") - F.col("s")).alias("n_repeat_words"), F.count(F.lit(1)).alias("n_passages"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("p"))
    text = F.concat_ws(",", F.transform("p", lambda x: F.concat(x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_repeat_words", "n_passages", text.alias("passages"), F.lower(F.hex("t")).alias("text_md5"))
