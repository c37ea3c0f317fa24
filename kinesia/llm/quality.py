"""Quality rules by line sequence labelling.

Fixed rules come first (too few words, too many repeated 8-word windows).  For
the rest a linear-chain conditional random field marks each line as content (0)
or boilerplate (1), decoded by Viterbi, and a document stays if at least half of
its words lie in content lines.

The field is fitted on a bounded sample of labelled documents (``sample``): the
lines of documents of good quality count as content, those of others as
boilerplate.  Only the sample's feature rows come to the driver, of a document
those of ``TRAIN_STRETCHES`` stretches of ``TRAIN_LINES`` lines at most, spread over
all of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesia.llm import _text
from kinesia.llm._crf import Crf, train

SAMPLE = 2000
CONTENT_SHARE = 0.5
#: In training only, longer documents are cut into sequences of so many lines, and so many of these are used.
TRAIN_LINES = 64
TRAIN_STRETCHES = 16
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"

_B = np.arange(256)
_isin = lambda s: np.isin(_B, np.frombuffer(s, np.uint8))
_SYMBOL, _UPPER, _LOWER, _DIGIT = _isin(b"#*$%&|<>"), (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
_SHOUT, _PIPE = _B == 33, _B == 124
_WORD = ~_text.IS_SPACE

_CUTS = {
    "length": [20, 40, 80, 160, 320, 640, 1280],
    "words": [2, 4, 8, 16, 32, 64],
    "word_length": [2.5, 3.5, 5, 7, 10],
    "symbols": [0.001, 0.02, 0.08, 0.2],
    "upper": [0.02, 0.15, 0.5, 0.9],
    "shout": [0.001, 0.02, 0.06],
    "pipe": [0.001, 0.02, 0.06],
    "digit": [0.001, 0.05, 0.2],
    "stutter": [0.001, 0.05, 0.3],
    "repeats": [0.001, 0.1, 0.3],
    "doc_repeats": [0.001, 0.1, 0.3],
}
_SIZES = [len(v) + 1 for v in _CUTS.values()] + [3, 3]
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_FIRST[-1])


def measures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text, and for each line that has a word: its text, words and feature rows."""
    n = len(offs) - 1
    a, b = _text.spans(_WORD[data], offs)
    own = _text.owner(a, offs)
    n_words = np.bincount(own, minlength=n)
    h = _text.span_hash(data, a, b)
    g, at = _text.grams(h, own, 8)
    again, _ = _text.repeated(g, own[at])
    covered = np.zeros(len(a) + 1, np.int64)
    np.add.at(covered, at[again], 1)
    np.add.at(covered, at[again] + 8, -1)
    in_repeat = np.cumsum(covered[:-1]) > 0
    n_repeat = np.bincount(own[in_repeat], minlength=n)

    # Lines: between texts' edges and newlines; only those with a word.
    edges = np.union1d(np.flatnonzero(data == 10) + 1, offs[:-1][np.diff(offs) > 0]).astype(np.int64)
    edges = edges[edges < len(data)]
    stop = np.append(edges[1:], len(data))
    newline = data[np.maximum(stop - 1, 0)] == 10 if len(edges) else np.zeros(0, bool)
    ends = stop - newline
    line_of_word = np.searchsorted(edges, a, side="right") - 1
    words = np.bincount(line_of_word, minlength=len(edges))
    live = words > 0
    s, e, words = edges[live], ends[live], words[live]
    text_of = _text.owner(s, offs)
    line_hash = _text.span_hash(data, s, e)
    dup, later = _text.repeated(line_hash, text_of)
    n_dup = np.bincount(text_of[later], minlength=n)

    def share(flags: np.ndarray, total: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags[data], out=sums[1:])
        return (sums[e] - sums[s]) / np.maximum(total, 1)

    length = e - s
    letters = share(_UPPER | _LOWER, 1)
    place = np.cumsum(live) - 1
    line = place[line_of_word]
    stutter = np.zeros(len(a), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    per_line = lambda flag: np.bincount(line[flag], minlength=len(s)) / words
    word_bytes = np.bincount(line, b - a, minlength=len(s))
    last = data[np.maximum(e - 1, 0)]
    values = (length, words, word_bytes / words, share(_SYMBOL, length), share(_UPPER, letters), share(_SHOUT, length), share(_PIPE, length), share(_DIGIT, length), per_line(stutter), per_line(in_repeat), (n_repeat / np.maximum(n_words, 1))[text_of])
    ids = [np.searchsorted(np.array(c), v, side="right") for c, v in zip(_CUTS.values(), values, strict=True)]
    ids += [dup.astype(np.int64) + later, np.where(np.isin(last, (46, 63)), 0, np.where(np.isin(last, (33, 124, 44, 58, 59)), 1, 2))]
    ids = np.stack([x + f for x, f in zip(ids, _FIRST[:-1], strict=True)], 1).astype(np.int64)
    return {
        "n_words": n_words,
        "word_chars": _text.count_in(_WORD[data] & _text.IS_LEAD[data], offs),
        "n_symbols": _text.count_in(_SYMBOL[data], offs),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "line_text": text_of,
        "line_words": words,
        "ids": ids,
    }


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Crf | None:
    """The field, from at most ``sample`` labelled documents, those with the smallest hashes of their ids; None without any line.

    Rows without an id or a label don't count; of several labels for an id the largest does, and of several texts of an id the one
    that sorts first.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    @_text.batches("text")
    def kernel(batch, data, offs):
        m = measures(data, offs)
        ends = np.cumsum(np.bincount(m["line_text"], minlength=batch.num_rows))
        kept = []
        for start, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            firsts = np.arange(start, end, TRAIN_LINES)
            if len(firsts) > TRAIN_STRETCHES:
                firsts = firsts[np.arange(TRAIN_STRETCHES) * len(firsts) // TRAIN_STRETCHES]
            kept.append(np.concatenate([np.arange(f, min(f + TRAIN_LINES, end)) for f in firsts]) if len(firsts) else np.zeros(0, np.int64))
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in kept])]) * len(_SIZES)
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(m["ids"][np.concatenate(kept)].ravel(), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["id", "y", "ids"])

    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    rows = found.groupBy(F.col("_id").cast("long").alias("id")).agg(F.max("_y").alias("y"), F.min("text").alias("text")).mapInArrow(kernel, "id long, y int, ids array<int>")
    got = sorted(rows.collect(), key=lambda r: r.id)
    parts, ys, lens = [], [], []
    for r in got:
        if r.ids:
            x = np.array(r.ids, np.int64).reshape(-1, len(_SIZES))
            parts.append(x)
            ys.append(np.full(len(x), 0 if r.y > 0 else 1))
            lens += [min(TRAIN_LINES, len(x) - k) for k in range(0, len(x), TRAIN_LINES)]
    if not parts:
        return None
    return train(np.concatenate(parts), np.concatenate(ys), np.concatenate([[0], np.cumsum(lens)]), N_FEATURES, 2, rounds=100, l2=1e-3)


def rate(df: DataFrame, crf: Crf | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT`` for each row.

    Null text counts as empty and fails; without a field every line is content; half of the words in content lines are enough.
    Repeated rows each have a row; texts of any length are read whole; an empty table gives an empty one; other columns, whatever
    their names, are not read.
    """

    @_text.batches("text")
    def kernel(batch, data, offs):
        return pa.RecordBatch.from_arrays([batch.column(0), *verdict(crf, data, offs)], [x.split()[0] for x in RESULT.split(", ")])

    return df.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(kernel, RESULT)


def verdict(crf: Crf | None, data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    """The columns of ``RESULT`` after the id."""
    n = len(offs) - 1
    m = measures(data, offs)
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    labels = np.zeros(len(m["ids"]), np.int8)
    if crf is not None and len(labels):
        labels = crf.viterbi(crf.emissions(m["ids"]), np.concatenate([[0], np.cumsum(np.bincount(m["line_text"], minlength=n))]))
    content = np.bincount(m["line_text"], m["line_words"] * (labels == 0), minlength=n)
    share = content / np.maximum(m["n_words"], 1)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return [*(pa.array(m[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE)), pa.array(share)]


def keep_good(df: DataFrame, crf: Crf | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, whatever their names."""

    # Made-up names on the way, so that no name of the rows needs quoting.
    names = [f"c{i}" for i in range(len(df.columns))]
    safe = df.toDF(*names)

    @_text.batches(names[df.columns.index(text_col)])
    def kernel(batch, data, offs):
        return batch.filter(verdict(crf, data, offs)[6])

    return safe.mapInArrow(kernel, safe.schema).toDF(*df.columns)
