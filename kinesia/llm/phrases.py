"""Collocated phrases, mined with suffix automata of bounded depth.

A task cuts its texts into shards of bounded size and builds for each shard one
generalised suffix automaton over its pieces, to the depth of the longest phrase.
The automaton is held in arrays, level by level: a gram's number at depth d is the
number of the pair (gram of depth d - 1 that ends one word earlier, word), so the
tables of pairs are its transitions; counting a level's numbers counts end
positions; a gram's suffix link leads to the gram of depth d - 1 that ends at the
same place.  Grams of one end set (a gram and its link with equal counts) are one
state, and a walk over the levels gives every substring of bounded depth with its
count.

Counts are reduced twice.  First under 64-bit keys, up to depth 3: a key is never
below its phrases' counts, so keys under the threshold exclude no phrase that
reaches it.  A Bloom filter of the other keys goes to all tasks; its size is fixed
by a limit, and what it lets through too much is counted and dropped later.  Then
phrases that pass (a phrase of four words through both its parts of three) are
counted by their words, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinesia.llm import _text as tx
from kinesia.llm._shared import dropped, plain, stored

#: Fixed by the contract.
LONGEST, LEAST_COUNT, SCALE, SUBSUMED_PCT, TOP = 4, 30, 2_000_000, 80, 2000
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = np.zeros(256, bool)
GAPS[[0x20, 0x09]] = True

#: Bytes of text in a shard; a longer text makes a shard of its own, or several cut between pieces.
SHARD_BYTES = 1_000_000
#: Rows of a batch that goes to Spark, and bytes that are compared at a time.
PART_ROWS, PART_BYTES = 20_000, 1 << 18
#: Bits of the filter for each key, and at most (a fuller filter only lets more through).
BLOOM_BITS_A_KEY, MAX_BLOOM_BITS = 16, 1 << 27
RESULT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
U64 = np.uint64


class Automaton:
    """The bounded suffix automaton of one shard.

    words: bytes and spans of the words; letter: each word's number, by first occurrence; gram[d]: the gram of depth d + 1 that ends
    at each word, or -1 across an edge of a piece or a text; count[d]: size of each gram's end set; last[d]: one place where it ends;
    link(d): its suffix link.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray, lang: np.ndarray, depth: int = LONGEST) -> None:
        self.data, self.starts, self.ends = data, starts, ends
        n = len(starts)
        letter = self._letters()
        # A word of another language is another letter.
        pair = lang.astype(np.int64) * (int(letter.max(initial=0)) + 1) + letter
        self.gram, self.count, self.last = [], [], []
        inside = np.ones(n, bool)
        for d in range(depth):
            if d:
                # The place before holds a gram of depth d, and no edge lies between.
                inside = np.zeros(n, bool)
                inside[1:] = (self.gram[d - 1][:-1] >= 0) & (piece[1:] == piece[:-1])
                at = np.flatnonzero(inside)
                pair = self.gram[d - 1][at - 1] * (len(self.count[0]) + 1) + self.gram[0][at]
            else:
                at = np.arange(n)
            values, first, number, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            gram = np.full(n, -1, np.int64)
            gram[at] = number
            self.gram.append(gram)
            self.count.append(count)
            self.last.append(at[first])

    def _letters(self) -> np.ndarray:
        """Numbers of the different words, told apart by hashes and confirmed byte by byte."""
        if len(self.starts) == 0:
            return np.zeros(0, np.int64)
        hashes = tx.span_hash(self.data, self.starts, self.ends)
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        at = first[number]
        size = self.ends - self.starts
        if np.array_equal(size, size[at]) and all(self._same(i, j, at) for i, j in self._blocks(size)):
            return number
        words: dict[bytes, int] = {}
        raw = self.data.tobytes()
        return np.array([words.setdefault(raw[i:j], len(words)) for i, j in zip(self.starts, self.ends, strict=True)], np.int64)

    @staticmethod
    def _blocks(size: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words of about PART_BYTES bytes."""
        edges = np.unique(np.concatenate((np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), PART_BYTES)), [0, len(size)])))
        yield from zip(edges[:-1], edges[1:], strict=True)

    def _same(self, i: int, j: int, at: np.ndarray) -> bool:
        """Whether words i to j have the bytes of the words at ``at``."""
        size = (self.ends - self.starts)[i:j]
        own = np.repeat(self.starts[i:j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.array_equal(self.data[own], self.data[own + np.repeat(self.starts[at[i:j]] - self.starts[i:j], size)])

    def link(self, d: int) -> np.ndarray:
        """For each gram of depth d + 1, the gram of depth d that its suffix is."""
        return self.gram[d - 1][self.last[d]]

    def prefix(self, d: int) -> np.ndarray:
        """For each gram of depth d + 1, the gram of depth d without its last word."""
        return self.gram[d - 1][self.last[d] - 1]

    def keys(self, seeds: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
        """A 64-bit key of each gram of each depth; the same in all shards."""
        own = tx.mix(tx.span_hash(self.data, self.starts[self.last[0]], self.ends[self.last[0]]) ^ seeds[lang[self.last[0]]])
        out = [own]
        for d in range(1, len(self.gram)):
            word = own[self.gram[0][self.last[d]]]
            out.append(tx.mix(out[d - 1][self.prefix(d)] * U64(0xD6E8FEB86659FD93) + word + U64(d)))
        return out

    def phrases(self, d: int, grams: np.ndarray) -> pa.Array:
        """The words of grams of depth d + 1, joined by single spaces."""
        last = self.last[d][grams]
        place = last[:, None] - np.arange(d, -1, -1)[None, :]
        starts, size = self.starts[place], self.ends[place] - self.starts[place]
        # One space follows each word but a phrase's last one.
        wide = size + 1
        wide[:, -1] -= 1
        to = np.concatenate(([0], np.cumsum(wide.ravel())))
        out = np.full(int(to[-1]), 32, np.uint8)
        flat, flat_to = size.ravel(), to[:-1]
        shift = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
        out[np.repeat(flat_to, flat) + shift] = self.data[np.repeat(starts.ravel(), flat) + shift]
        offsets = to[:: d + 1].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(grams), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each its piece and its text."""
    breaks = BREAKS[data]
    starts, ends = tx.spans(~(breaks | GAPS[data]), offs)
    text = tx.owner(starts, offs)
    return starts, ends, np.cumsum(breaks)[starts] + text if len(starts) else starts, text


def _shards(source: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[Automaton, np.ndarray, list]]:
    """An automaton for each shard of a task, its words' languages as numbers, and the languages' names."""
    names: dict[str | None, int] = {}

    def built(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        data = tx.LOWER[np.concatenate([p[0] for p in parts])]
        size = np.concatenate([np.diff(p[1]) for p in parts])
        offs = np.concatenate(([0], np.cumsum(size)))
        lang = np.concatenate([p[2] for p in parts])
        starts, ends, piece, text = _pieces(data, offs)
        own = lang[text]
        return Automaton(data, starts, ends, piece, own), own, list(names)

    held, n = [], 0
    for batch in source:
        data, offs = tx.texts(batch.column(0))
        lang = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
        for i, j in tx.chunks(offs, limit):
            part = data[offs[i] : offs[j]]
            if n and n + len(part) > limit:
                yield built(held)
                held, n = [], 0
            if len(part) > limit:
                # One long text: cut after a break, so no piece is torn; a piece beyond the limit stays whole.
                cuts, at = [0], 0
                edges = np.flatnonzero(BREAKS[part]) + 1
                while len(part) - at > limit:
                    k = np.searchsorted(edges, at + limit, side="right") - 1
                    at = int(edges[k]) if k >= 0 and edges[k] > at else int(edges[k + 1]) if k + 1 < len(edges) else len(part)
                    cuts.append(at)
                for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
                    if b > a:
                        yield built([(part[a:b], np.array([0, b - a]), lang[i : i + 1])])
                continue
            # A copy, so that a batch is free once its texts are dealt.
            held.append((part.copy(), offs[i : j + 1] - offs[i], lang[i:j]))
            n += len(part)
        del batch, data, offs
    if held:
        yield built(held)


def _seeds(names: list) -> np.ndarray:
    """A 64-bit number for each language's name."""
    raw = [str(x).encode() for x in names]
    data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return tx.span_hash(data, ends - np.array([len(x) for x in raw], np.int64), ends)


def _count_keys(limit: int, depth: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for auto, lang, names in _shards(source, limit):
            keys = auto.keys(_seeds(names), lang)
            for d in range(depth):
                for i in range(0, len(keys[d]), PART_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[d][i : i + PART_ROWS].view(np.int64)), pa.array(auto.count[d][i : i + PART_ROWS])], ["key", "n"])

    return run


class Bloom:
    """Bits for 64-bit keys, two for each; ``words`` holds them 64 by 64."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.bits = words, len(words) * 64

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in (keys, tx.mix(keys)):
            place = place & U64(self.bits - 1)
            out &= (self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1
        return out


def _bloom(frequent: DataFrame) -> Bloom:
    """The filter of ``frequent`` (key): its bits are set on the executors, and words of 64 bits come to the driver, MAX_BLOOM_BITS at most."""
    n = frequent.count()
    bits = min(MAX_BLOOM_BITS, 1 << max(16, (BLOOM_BITS_A_KEY * n).bit_length()))

    def places(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            keys = b.column(0).to_numpy().view(U64)
            at = np.concatenate([keys, tx.mix(keys)]) & U64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], ["word", "bit"])

    found = frequent.select("key").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return Bloom(words)


def _count_phrases(limit: int, shared):
    """(lang, phrase, depth, n) of the grams that may reach the threshold."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for auto, lang, names in _shards(source, limit):
            keys = auto.keys(_seeds(names), lang)
            passes: list[np.ndarray] = []
            for d in range(len(keys)):
                ok = bloom.holds(keys[d]) if d < LONGEST - 1 else passes[d - 1][auto.link(d)]
                if d:
                    ok = ok & passes[d - 1][auto.prefix(d)] & passes[d - 1][auto.link(d)]
                passes.append(ok)
                grams = np.flatnonzero(ok)
                for i in range(0, len(grams), PART_ROWS):
                    part = grams[i : i + PART_ROWS]
                    which = pa.array(lang[auto.last[d][part]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()).take(which), auto.phrases(d, part), pa.array(np.full(len(part), d + 1, np.int32)), pa.array(auto.count[d][part])],
                        ["lang", "phrase", "depth", "n"],
                    )
            # The number of all words of a language, as a phrase of none.
            total = np.bincount(lang, minlength=len(names))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(seen)), pa.array([""] * len(seen), pa.string()), pa.array(np.zeros(len(seen), np.int32)), pa.array(total[seen])], ["lang", "phrase", "depth", "n"])

    return run


def counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, phrase, depth (words in it), n of every phrase of 1 to 4 words that occurs ``least`` times; depth 0: all words of the language."""
    source = docs.select(F.col(plain(text_col)).cast("string").alias("text"), F.coalesce(F.col(plain(lang_col)).cast("string"), F.lit("und")).alias("lang"))
    keyed = source.mapInArrow(_count_keys(shard_bytes, LONGEST - 1), "key long, n long")
    frequent = stored(keyed.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(frequent))
    dropped(frequent)
    found = source.mapInArrow(_count_phrases(shard_bytes, shared), "lang string, phrase string, depth int, n long")
    return found.groupBy("lang", "phrase", "depth").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("depth") == 0))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``RESULT``: each language's ``top`` phrases by score, count and words.

    Null texts are empty, a null language is ``und``.  Repeated rows count each; input columns beside these two play no part, whatever
    their names.  Texts of any length count whole.  An empty table gives an empty one; so does a language whose phrases are too rare.
    """
    table = stored(counts(docs, text_col=text_col, lang_col=lang_col, least=least, shard_bytes=shard_bytes))
    words = F.split(F.col("phrase"), " ")
    candidates = table.where("depth >= 2").select("lang", "phrase", "depth", F.col("n").alias("a"))

    # A phrase inside a longer one lies inside one that is one word longer and at least as frequent: the ends of a suffix link, and the prefix.
    def part(first, length) -> Column:
        return F.array_join(F.slice(words, first, length), " ")

    longer = candidates.where("depth >= 3").select("lang", F.explode(F.array(part(F.lit(1), F.col("depth") - 1), part(F.lit(2), F.col("depth") - 1))).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(most, ["lang", "phrase"], "left").where("longer IS NULL OR CAST(100 AS DECIMAL(20,0)) * longer < CAST(80 AS DECIMAL(20,0)) * a".replace("80", str(SUBSUMED_PCT)))
    cuts = left.select("lang", "phrase", "a", "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("depth") - F.col("k")).alias("tail"))
    known = table.where("depth BETWEEN 1 AND 3")
    heads, tails = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCALE} div (CAST(l AS DECIMAL(20,0)) + r)")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    totals = table.where("depth = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(*RESULT)
