"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as O, B (secret begins) or I (inside) from their shape,
the neighbouring words and features of the whole text, and is decoded by
Viterbi.  It is trained on the driver on made lines (``training_texts``), whose
number is a parameter; no corpus row takes part.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinesia.llm import _text
from kinesia.llm._crf import Crf, train

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same as runs of [0-9a-f] with 32 or more: a run's start is never skipped
KINDS = ("assign", "access", "hex", "crf")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, n_crf_on_fixed long, crf_on_fixed string"

_B = np.arange(256)


def _chars(s: str) -> np.ndarray:
    return np.isin(_B, np.frombuffer(s.encode(), np.uint8))


_DIGIT, _LOW, _UP = _chars(string.digits), _chars(string.ascii_lowercase), _chars(string.ascii_uppercase)
_WIDE = _B >= 128
_SIGN = _chars("_+/-")
_TOKEN = _DIGIT | _LOW | _UP | _WIDE | _SIGN
_HEXLOW, _HEXUP = _DIGIT | _chars("abcdef"), _DIGIT | _chars("ABCDEF")
_CODE = _chars("={}();:\"'<>[]$")

#: Words that often stand before a secret, and those that stand there less often.
STRONG = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "secret_key", "access_key", "private_key", "client_secret", "auth_token", "access_token", "bearer", "credential", "credentials", "aws_secret_access_key", "pass")
WEAK = ("key", "auth", "authorization", "login", "access", "private", "api", "signature", "cookie", "session", "aws", "user", "username")
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"sk_live_", b"sk-", b"xox", b"eyJ", b"AIza", b"glpat-", b"npm_")

_SIZES = (128, 12, 3, 3, 6, 4, 4, 2, 8)
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_FIRST[-1])


@functools.cache
def _cues() -> tuple[np.ndarray, np.ndarray]:
    def hashes(words):
        data = np.frombuffer(b" ".join(w.encode() for w in words), np.uint8)
        a, b = _text.spans(data != 32, np.array([0, len(data)]))
        return np.sort(_text.span_hash(data, a, b, True))

    return hashes(STRONG), hashes(WEAK)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' starts, ends and texts, and their feature rows."""
    a, b = _text.spans(_TOKEN[data], offs)
    own = _text.owner(a, offs)
    n = len(a)
    if n == 0:
        return a, b, own, np.zeros((0, len(_SIZES)), np.int64)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums

    digit = _DIGIT[data]
    d, u, low, sign = count(digit), count(_UP[data]), count(_LOW[data]), count(_SIGN[data])
    length = b - a
    has = [(s[b] - s[a]) > 0 for s in (low, u, d, sign)]
    size = np.searchsorted(np.array([4, 8, 12, 16, 20, 32, 40]), length, side="right")
    shape = size * 16 + has[0] + 2 * has[1] + 4 * has[2] + 8 * has[3]
    change = np.zeros(len(data), bool)
    change[1:] = digit[1:] != digit[:-1]
    c = count(change)
    turns = np.searchsorted(np.array([1, 2, 4, 8, 12]), c[b] - c[a + 1], side="right")
    long = np.flatnonzero(length >= 16)
    hexa = np.zeros(n, np.int64)
    if len(long):
        h1, h2 = count(_HEXLOW[data]), count(_HEXUP[data])
        hexa[long] = ((h1[b] - h1[a])[long] == length[long]) | ((h2[b] - h2[a])[long] == length[long])
    h = _text.span_hash(data, a, b, True)
    strong, weak = _cues()
    cue = np.where(_among(strong, h), 2, np.where(_among(weak, h), 1, 0))
    first = np.ones(n, bool)
    first[1:] = own[1:] != own[:-1]
    prev1, prev2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
    prev1[1:] = cue[:-1]
    prev1[first] = 0
    prev2[2:] = cue[:-2]
    prev2[1:][first[:-1]] = 0
    prev2[first] = 0
    # What lies between a token and the one before: at most three bytes on each side count.
    last = len(data) - 1
    one, two = data[np.maximum(a - 1, 0)], data[np.maximum(a - 2, 0)]
    three = data[np.maximum(a - 3, 0)]
    gap = a.copy()
    gap[1:] = np.where(first[1:], a[1:] - offs[own[1:]], a[1:] - b[:-1])
    gap[0] = a[0] - offs[own[0]]
    equals = ((one == 61) & (gap > 0)) | ((two == 61) & (gap > 1)) | ((three == 61) & (gap > 2))
    colon = ((one == 58) & (gap > 0)) | ((two == 58) & (gap > 1)) | ((three == 58) & (gap > 2))
    line = first | ((one == 10) & (gap > 0))
    between = np.where(equals, 1, np.where(colon, 2, np.where(line, 4, np.where((gap == 1) & (one == 46), 5, np.where(gap > 1, 3, 0)))))
    end = np.minimum(b, last)
    quote = np.isin(one, (34, 39, 96)) & (gap > 0)
    closed = np.isin(data[end], (34, 39, 96)) & (b < offs[own + 1])
    nxt = np.zeros(n, np.int64)
    nxt[:-1] = np.where(has[2][1:], 2, np.where(cue[1:] > 0, 3, 1))
    nxt[:-1][own[1:] != own[:-1]] = 0
    known = np.zeros(n, np.int64)
    for p in PREFIXES:
        ok = length > len(p) + 8
        for k, ch in enumerate(p):
            ok &= data[np.minimum(a + k, last)] == ch
        known |= ok
    share = _text.count_in(_CODE[data], offs) / np.maximum(np.diff(offs), 1)
    file = np.searchsorted(np.array([0.001, 0.01, 0.04]), share, side="right")
    cued = np.zeros(len(offs) - 1, np.int64)
    cued[own[cue == 2]] = 1
    columns = (shape, turns * 2 + hexa, prev1, prev2, between, quote + 2 * closed, nxt, known, (file * 2 + cued)[own])
    return a, b, own, np.stack([x + f for x, f in zip(columns, _FIRST[:-1], strict=True)], 1).astype(np.int64)


def training_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made texts with the spans of their secrets; about half of the texts have none."""
    r = random.Random(seed)
    letters = string.ascii_letters + string.digits
    syllables = ["th", "er", "on", "an", "re", "ing", "ed", "ou", "ha", "st", "ment", "que", "ción", "ung", "eau", "lich", "tion", "der", "la", "é", "ü"]
    word = lambda: "".join(r.choices(syllables, k=r.choice([1, 2, 2, 3, 4, 6]))).capitalize() if r.random() < 0.1 else "".join(r.choices(syllables, k=r.choice([1, 2, 2, 3, 4, 6])))

    def secret() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return "".join(r.choices("0123456789abcdef", k=r.choice([24, 32, 40, 48, 64])))
        if kind == 1:
            return "AKIA" + "".join(r.choices(string.ascii_uppercase + string.digits, k=16))
        if kind == 2:
            return r.choice(["ghp_", "gho_", "sk_live_", "glpat-", "npm_", "xoxb-", "sk-"]) + "".join(r.choices(letters, k=r.choice([20, 24, 36])))
        if kind == 3:
            return "AIza" + "".join(r.choices(letters + "_-", k=35))
        if kind == 4:
            return "eyJ" + ".".join("".join(r.choices(letters + "_-", k=k)) for k in (22, 40, 40))
        if kind == 5:
            return "".join(r.choices(letters + "+/", k=r.choice([30, 40, 44])))
        return "".join(r.choices(letters, k=r.choice([10, 12, 16, 20, 28])))

    def harmless() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
        if kind == 1:
            return "".join(r.choices(string.digits, k=r.choice([2, 4, 6, 9, 10, 13, 16])))
        if kind == 2:
            return f"{word()}_{word()}{r.randrange(100)}"
        if kind == 3:
            return f"/{word()}/{word()}/{word()}-{r.randrange(1000)}"
        if kind == 4:
            return f"{word()}@{word()}{r.randrange(9)}.com"
        if kind == 5:
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if kind == 6:
            return word().upper() + r.choice(["!!", "###", "$$$", "%%%", "&&&", "***", " |"])
        if kind == 7:
            return f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(99)}"
        return word() * 3

    names = [*STRONG, *(w.upper() for w in STRONG), "Key", "auth", "api"]
    out = []
    for k in range(n):
        text, found = "", []

        def add(s: str, secret_from: int | None = None) -> None:
            nonlocal text
            if secret_from is not None:
                found.append((len(text) + secret_from, len(text) + len(s)))
            text += s

        for _ in range(r.randrange(1, 5)):
            for _ in range(r.randrange(0, 12)):
                add((harmless() if r.random() < 0.12 else word()) + r.choice([" "] * 8 + [", ", ".\n"]))
            if k % 2:
                quote = r.choice(['"', "'", "", ""])
                if r.random() < 0.75:
                    add(r.choice(names) + r.choice([" = ", "=", ": ", ":", '": ', " "]) + quote)
                add(s := secret(), 0)
                add(quote + r.choice(["\n", " ", ";\n", ",\n"]))
                assert s
            elif r.random() < 0.3:
                add(r.choice(names) + r.choice([" ", ": ", " = ", " is "]) + r.choice([word(), word(), "true", "null", "None", harmless()]) + " ")
        out.append((text, found))
    return out


@functools.lru_cache(maxsize=2)
def model(n_texts: int = 1500, seed: int = 5) -> Crf:
    """The field, trained on ``n_texts`` made texts."""
    made = training_texts(n_texts, seed)
    data, offs = _text.texts(pa.array([t for t, _ in made]))
    a, b, own, ids = features(data, offs)
    labels = np.zeros(len(a), np.int64)
    for i, (t, found) in enumerate(made):
        for s, e in found:
            s, e = (len(t[:x].encode()) + offs[i] for x in (s, e))
            inside = np.flatnonzero((a >= s) & (b <= e))
            labels[inside] = 2
            labels[inside[:1]] = 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(made)))])
    return train(ids, labels, bounds, N_FEATURES, 3, rounds=120)


def tagged(crf: Crf, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans that the field tags as secrets, and their texts.

    Tokens that are O in every best sequence (``cut_margin``) part the chain, so Viterbi runs over what lies between them;
    the labels are those of the whole chain.
    """
    a, b, own, ids = features(data, offs)
    none = np.zeros(0, np.int64)
    if len(a) == 0:
        return none, none, none
    scores = crf.emissions(ids)
    open_ = scores[:, 0] - scores[:, 1:].max(1) <= crf.cut_margin()
    near = open_.copy()
    near[1:] |= open_[:-1]
    near[:-1] |= open_[1:]
    at = np.flatnonzero(near)
    if len(at) == 0:
        return none, none, none
    parts = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(own[at]) > 0)]))
    bounds = np.concatenate([parts, [len(at)]])
    # A part that doesn't begin its text begins with a sure O, for which the start scores make no odds.
    labels = crf.viterbi(scores[at], bounds)
    begin = np.flatnonzero((labels == 1) | ((labels == 2) & np.concatenate([[True], (labels[:-1] == 0) | (np.diff(at) > 1) | (np.diff(own[at]) > 0)])))
    ends = []
    for x in begin:
        y = x
        while y + 1 < len(at) and labels[y + 1] == 2 and at[y + 1] == at[y] + 1 and own[at[y + 1]] == own[at[y]]:
            y += 1
        ends.append(y)
    return a[at[begin]], b[at[np.array(ends, np.int64)]] if len(begin) else none, own[at[begin]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def _suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts in which a fixed pattern can match: cheap tests that no match fails."""
    low = _text.LOWER[data].tobytes()
    hit = np.zeros(len(offs) - 1, bool)
    for word in (b"passw", b"secret", b"token", b"apikey", b"api_key"):
        p = low.find(word)
        while p >= 0:
            i = int(np.searchsorted(offs, p, side="right")) - 1
            hit[i] = True
            p = low.find(word, int(offs[i + 1]) if p < offs[i + 1] else p + 1)
    raw = data.tobytes()
    p = raw.find(b"AKIA")
    while p >= 0:
        hit[int(np.searchsorted(offs, p, side="right")) - 1] = True
        p = raw.find(b"AKIA", p + 1)
    # A run of 32 holds three whole groups of eight that begin at multiples of eight.
    flags = _HEXLOW[data[: len(data) // 8 * 8]].view(np.uint64) == np.uint64(0x0101010101010101)
    if len(flags) > 2:
        at = np.flatnonzero(flags[:-2] & flags[1:-1] & flags[2:]) * 8
        hit[np.searchsorted(offs, at, side="right") - 1] = True
    return hit


def digest(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in spans)


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """One row for each document: counts of the fixed patterns, a digest of their spans, all spans, and how many the field added.

    Spans are in code points, end exclusive.  A span of the field that overlaps a fixed one is not added; it is counted in
    n_crf_on_fixed and listed in crf_on_fixed.  Of labellings with equal scores the field takes the one whose labels come first.
    Null text counts as empty and has no spans; the id may be null; repeated rows each have a row.  Texts of any length are read
    whole; an empty table gives an empty one; other columns, whatever their names, are not read.
    """
    crf = model() if crf is None else crf
    empty = hashlib.sha256(b"").hexdigest()

    @_text.batches("text")
    def kernel(batch, data, offs):
        n = batch.num_rows
        counts = np.zeros((4, n), np.int64)
        shas, spans, on_fixed, again = [empty] * n, [""] * n, [""] * n, np.zeros(n, np.int64)
        hit = _suspects(data, offs)
        s, e, own = tagged(crf, data, offs)
        added: dict[int, list[tuple[int, int]]] = {}
        for x, y, i in zip(s.tolist(), e.tolist(), own.tolist(), strict=True):
            added.setdefault(i, []).append((x, y))
        for i in sorted({*np.flatnonzero(hit).tolist(), *added}):
            raw = data[offs[i] : offs[i + 1]]
            text = raw.tobytes().decode()
            base = base_spans(text) if hit[i] else []
            lead = np.cumsum(_text.IS_LEAD[raw]) if i in added else None
            more, known = [], []
            for x, y in added.get(i, ()):
                p, q = int(lead[x - offs[i]]) - 1, int(lead[y - offs[i] - 1])
                (more if all(q <= bs or p >= be for bs, be, _ in base) else known).append((p, q, 3))
            on_fixed[i], again[i] = digest(known, KINDS), len(known)
            for _, _, k in [*base, *more]:
                counts[k, i] += 1
            if base:
                shas[i] = hashlib.sha256(digest(base, KINDS).encode()).hexdigest()
            spans[i] = digest(sorted([*base, *more], key=lambda v: (v[0], v[2], v[1])), KINDS)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts[:3]), pa.array(shas), pa.array(spans), pa.array(counts[3]), pa.array(again), pa.array(on_fixed)], [c.split()[0] for c in RESULT.split(", ")])

    return df.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(kernel, RESULT)
