"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent 1- to 3-grams of letters
(words bounded by a mark).  A document's own list is compared with each profile
by the out-of-place distance: the sum over its n-grams of how far apart the two
ranks are, and the profile's length where the profile lacks the n-gram.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinesia.llm import _text

PROFILE = 300
#: Documents of each language, about, from which its profile is counted.
SAMPLE = 2000
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_MARK = 1


@functools.cache
def _letters() -> np.ndarray:
    flags = np.zeros(0x110000, bool)
    for c in range(0x110000):
        flags[c] = chr(c).isalpha()
    return flags


def ngrams(text: str) -> np.ndarray:
    """All 1- to 3-grams of the lower-cased text's words, as numbers; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    kept = np.flatnonzero(letter)
    if len(kept) == 0:
        return np.zeros(0, np.int64)
    word = np.cumsum(np.concatenate([[True], np.diff(kept) > 1]))
    line = np.full(len(kept) + int(word[-1]) + 1, _MARK, np.int64)
    line[np.arange(len(kept)) + word] = codes[kept]
    two = (line[:-1] << 21) | line[1:]
    three = ((line[:-2] << 42) | (line[1:-1] << 21) | line[2:])[line[1:-1] != _MARK]
    return np.concatenate([codes[kept].astype(np.int64), two, three])


def ranked(grams: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The ``k`` most frequent n-grams, ties by number."""
    grams = np.sort(grams)
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(np.append(at, len(grams)))
    return grams[at[np.argsort(-counts, kind="stable")[:k]]]


def profiles(df: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, k: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language of ``df``; about ``sample`` documents of each count, chosen by a hash of the id.

    Rows with a null language or text don't count.  Counting and ranking run on the executors; ``k`` numbers for each language
    come to the driver.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("_id")).where("lang IS NOT NULL AND text IS NOT NULL")
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("_share"))
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(1_000_000)) < F.col("_share") * 1_000_000)

    @_text.batches("text")
    def count(batch, data, offs):
        langs, grams, counts = [], [], []
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(ngrams(text))
        for lang, parts in by_lang.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            langs += [lang] * len(g)
            grams.append(g)
            counts.append(n)
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), flat(grams), flat(counts)], ["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= k)
    out: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "r", "gram").collect()):
        out.setdefault(row.lang, []).append(row.gram)
    return out


def held_out(id_col: str = "doc_id"):
    """Documents that no profile is learned from: crc32 of the id as text, modulo 3, is 1; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, learned: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT`` for each row; score is 1 less the distance as a share of the greatest possible one.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.  Of equal distances the language
    that sorts first wins.
    """
    langs = sorted(learned)
    known = np.unique(np.concatenate([np.array(learned[x], np.int64) for x in langs])) if langs else np.zeros(0, np.int64)
    k = max([len(v) for v in learned.values()], default=1)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int32)
    for i, x in enumerate(langs):
        ranks[i, np.searchsorted(known, np.array(learned[x], np.int64))] = np.arange(len(learned[x]))

    @_text.batches("text")
    def kernel(batch, data, offs):
        pred, score = [], np.zeros(batch.num_rows)
        for i, text in enumerate(batch.column(2).to_pylist()):
            grams = ngrams(text) if text and langs else np.zeros(0, np.int64)
            if len(grams) == 0:
                pred.append("und")
                continue
            top = ranked(grams, k)
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            mine = ranks[:, np.where(known[at] == top, at, len(known))]
            apart = np.where(mine < 0, k, np.abs(mine - np.arange(len(top)))).sum(1)
            best = int(apart.argmin())
            pred.append(langs[best])
            score[i] = 1 - apart[best] / (k * len(top))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(kernel, RESULT)
