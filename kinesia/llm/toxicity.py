"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each later model
also gets the earlier categories' probabilities, and is trained with
out-of-fold ones, so it sees them as wrong as they will be.

The categories rest on the table of labels: toxic; toxic_junk, toxic in a text of
bad quality; and severe, toxic in at least ``SEVERE`` of its sentences.  A toxic
sentence has a term of a lexicon learned from the other folds, so no document
says itself what it is.  Where a later category holds, toxic holds.

The features are words' presence, ``FEATURES`` of them selected by chi-square on
the executors, for each fold from the other folds only, and the text's shape.
The models are fitted on a bounded sample of labelled documents (``SAMPLE``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesia.llm import _text
from kinesia.llm._shared import dropped, stored

SAMPLE = 4000
FEATURES = 400
LEAST_DOCUMENTS = 5
FOLDS = 4
SEVERE = 0.5
#: A lexicon's term raises the odds of toxic by so many times.
LEXICON_ODDS = 4
CATEGORIES = ("toxic", "toxic_junk", "severe")
RESULT = "doc_id long, p_toxic double, p_toxic_junk double, p_severe double, toxic boolean, toxic_junk boolean, severe boolean"

_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)


@dataclass(frozen=True)
class Chain:
    words: np.ndarray  # sorted hashes of the selected words
    weights: list[np.ndarray]  # of each category: words, shape, earlier probabilities, constant
    cuts: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, those of later categories at most that of the first."""
        out = np.zeros((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(x @ w[: x.shape[1]] + out[:, :k] @ w[x.shape[1] : -1] + w[-1])
        out[:, 1:] = np.minimum(out[:, 1:], out[:, :1])
        return out

    def verdicts(self, p: np.ndarray) -> np.ndarray:
        """Which categories hold; without the first none does."""
        found = p >= np.array(self.cuts)
        return found & found[:, :1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters, and their texts."""
    a, b = _text.spans(_LETTER[data], offs)
    return _text.span_hash(data, a, b, True), _text.owner(a, offs)


def presence(words: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts by words: whether the text has the word."""
    x = np.zeros((len(offs) - 1, len(words)))
    if len(words):
        h, own = words_of(data, offs)
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        x[own[hit], at[hit]] = 1
    return x


_SYMBOL, _PIPE = np.isin(_B, np.frombuffer(b"#*$%&|<>", np.uint8)), _B == 124
#: Limits of the shape's shares: symbols, bars, digits, words equal to the one before.
_LIMITS = (0.001, 0.02, 0.08, 0.2)
SHAPES = 4 * len(_LIMITS)


def shape(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts by limits: whether the text's share lies above."""
    size = np.maximum(np.diff(offs), 1)
    h, own = words_of(data, offs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    n = len(offs) - 1
    stutter = np.bincount(own[again], minlength=n) / np.maximum(np.bincount(own, minlength=n), 1)
    shares = [_text.count_in(f[data], offs) / size for f in (_SYMBOL, _PIPE, (_B >= 48) & (_B <= 57))] + [stutter]
    return np.stack([v > limit for v in shares for limit in _LIMITS], 1).astype(float)


def sentences_with(terms: np.ndarray, data: np.ndarray, offs: np.ndarray) -> float:
    """The share of one text's sentences (that have a word) in which a term occurs."""
    a, b = _text.spans(_LETTER[data], offs)
    if not len(a) or not len(terms):
        return 0.0
    place = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?\n", np.uint8)))])[a]
    hit = np.isin(_text.span_hash(data, a, b, True), terms)
    return len(np.unique(place[hit])) / len(np.unique(place))


def logistic(x: np.ndarray, y: np.ndarray, *, l2: float = 2e-3, rounds: int = 120, rate: float = 0.1) -> np.ndarray:
    """Weights and constant of a logistic regression with an L2 penalty, by Adam."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w, m1, m2 = (np.zeros(x1.shape[1], np.float32) for _ in range(3))
    y = y.astype(np.float32)
    penalty = np.full(len(w), l2, np.float32)
    penalty[-1] = 0
    for t in range(1, rounds + 1):
        g = x1.T @ (_sigmoid(x1 @ w) - y) / len(y) + penalty * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-6)
    return w.astype(float)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, in the middle of the gap below the last positive that it takes; 1 + e if there is no positive."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """The chain, from at most ``sample`` labelled documents, those with the smallest hashes of their ids.

    labels(id, toxic) may have quality (0: bad).  Rows without an id or a toxic label don't count; of several labels for an id the
    largest toxic and the smallest quality do, and of several texts of an id the one that sorts first.  Without both kinds of
    documents nothing is ever found toxic.
    """
    quality = F.col("quality").cast("int") if "quality" in labels.columns else F.lit(1)
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_y"), F.coalesce(quality, F.lit(1)).alias("_q")).dropna()
    chosen = known.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_q").alias("_q")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    rows = found.groupBy(F.col("_id").cast("long").alias("id")).agg((F.max("_y") > 0).alias("y"), (F.min("_q") <= 0).alias("junk"), F.min("text").alias("text"))
    rows = stored(rows.select("id", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(folds)).cast("int").alias("fold"), "y", "junk", "text"))
    none = Chain(np.zeros(0, np.uint64), [np.zeros(SHAPES + k + 1) for k in range(3)], [1.1] * 3)

    @_text.batches("text")
    def terms(batch, data, offs):
        h, own = words_of(data, offs)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        y, fold = np.array(batch.column(2).to_pylist(), bool), batch.column(1).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(fold[own[first]]), pa.array(y[own[first]], pa.bool_())], ["word", "fold", "y"])

    total = {r.fold: (r.n, r.p) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("p")).collect()}
    by_fold = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(folds)] + [F.count_if((F.col("fold") == f) & F.col("y")).alias(f"p{f}") for f in range(folds)]
    counts = stored(rows.mapInArrow(terms, "word long, fold int, y boolean").groupBy("word").agg(F.count(F.lit(1)).alias("n"), *by_fold).where(F.col("n") >= LEAST_DOCUMENTS))

    def selected(without: int | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Sorted words, and the terms of the lexicon, as the folds but one have them; None if these lack one kind of documents."""
        use = [f for f in range(folds) if f != without]
        n, p = (sum(total.get(f, (0, 0))[k] for f in use) for k in (0, 1))
        if not p or p == n:
            return None
        d, q = (sum((F.col(f"{c}{f}") for f in use), F.lit(0)).cast("double") for c in "np")
        gap = q * float(n) - d * float(p)
        chi = gap * gap / (d * (float(n) - d) * float(p) * float(n - p))
        top = counts.where((d >= LEAST_DOCUMENTS) & (d < n)).orderBy(F.desc(F.round(chi, 12)), "word").limit(features).select("word", ((q + 0.5) / (d - q + 0.5)).alias("odds")).collect()
        words = np.array([r.word for r in top], np.int64).view(np.uint64)
        return np.sort(words), np.sort(words[np.array([r.odds for r in top]) > LEXICON_ODDS * p / (n - p)]) if top else words

    choices = {f: selected(f) for f in [*range(folds), None]}
    if any(c is None for c in choices.values()):
        dropped(rows, counts)
        return none
    every = np.unique(np.concatenate([c[0] for c in choices.values()]))
    lexicons = {f: choices[f][1] for f in range(folds)}

    @_text.batches("text")
    def described(batch, data, offs):
        x, form = presence(every, data, offs), shape(data, offs)
        at = [np.flatnonzero(r).astype(np.int32) for r in np.hstack([x, form])]
        share = [sentences_with(lexicons[f], data[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i]) for i, f in enumerate(batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(share, pa.float64()), pa.array(at, pa.list_(pa.int32()))], ["id", "fold", "y", "junk", "share", "at"])

    got = sorted(rows.mapInArrow(described, "id long, fold int, y boolean, junk boolean, share double, at array<int>").collect(), key=lambda r: r.id)
    dropped(rows, counts)
    x = np.zeros((len(got), len(every) + SHAPES))
    for i, r in enumerate(got):
        x[i, r.at] = 1
    fold = np.array([r.fold for r in got])
    toxic = np.array([r.y for r in got], float)
    ys = [toxic, toxic * np.array([r.junk for r in got]), toxic * (np.array([r.share for r in got]) >= SEVERE)]
    form = np.arange(len(every), len(every) + SHAPES)
    columns = {f: np.concatenate([np.searchsorted(every, c[0]), form]) for f, c in choices.items()}
    before, weights, cuts = np.zeros((len(got), 0)), [], []
    for y in ys:
        out_of_fold = np.zeros(len(y))
        for f in range(folds):
            mine = np.hstack([x[:, columns[f]], before])
            w = logistic(mine[fold != f], y[fold != f])
            out_of_fold[fold == f] = _sigmoid(mine[fold == f] @ w[:-1] + w[-1])
        if before.shape[1]:
            out_of_fold = np.minimum(out_of_fold, before[:, 0])
        weights.append(logistic(np.hstack([x[:, columns[None]], before]), y))
        cuts.append(best_cut(out_of_fold, y))
        before = np.hstack([before, out_of_fold[:, None]])
    return Chain(choices[None][0], weights, cuts)


def score(df: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT`` for each row.

    Null text counts as empty; repeated rows each have a row; a probability equal to a threshold reaches it; texts of any length are
    read whole; an empty table gives an empty one; other columns, whatever their names, are not read.
    """

    @_text.batches("text")
    def kernel(batch, data, offs):
        p = chain.predict(np.hstack([presence(chain.words, data, offs), shape(data, offs)]))
        holds = chain.verdicts(p)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3)), *(pa.array(holds[:, k]) for k in range(3))], [c.split()[0] for c in RESULT.split(", ")])

    return df.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(kernel, RESULT)
