"""Personal data, with disguises undone.

Fixed patterns find e-mail and IP addresses, card and phone numbers.  Texts that
may hold a disguise then pass transducers that keep, for every character they
write, the source characters it stands for: look-alike letters become ASCII,
invisible characters go, spelled digits become digits, and spelled "at" and
"dot" become their signs.  The same patterns run over the result, and what they
find is mapped back to the source.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinesia.llm import _text

KINDS = ("email", "ip", "card", "phone")
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The run of digits is taken whole: within it no later start can match where its start does not.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like the ASCII letter or sign before them (fixed values).
LOOKALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ",
    "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    ".": "․。", "-": "‐‑‒–—−", "@": "＠﹫",
}
#: Words of the four languages of the corpus for digits and signs (fixed values); also as they are written without accents.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "ät", "klammeraffe", "arobase", "arrobase", "arroba")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus", "más", "mas")
#: English words that stand before "at" in prose (fixed values), beside those with an ending of ``_PROSE_END``; "look at site.com" is no address.
BEFORE_AT = frozenset("""
a all am an and any are arrive arrives as aim aims be been being best better but buy can chat check come comes data day days deal deals else
even ever everyone find fine first five for free friend from get gets glance go goes good got great guess had happen happens has have he her here
him his home host hosts i in information is it item items its join just keep last laugh left live lives located look looks made make makes
me meet meets met mine more most much my new news next no not now of off on one online only open or order other our out over page pages people
point points post posts price prices read rest sale same sat save see seen sell sells she shop shout shown sign sit sits site sites sold
some someone soon spent stand start starts stay stays still stop store stories stuff that the their them then there they thing things this
time times to today tomorrow tonight up us use user users visit was watch we website well went were what when where which while who will win
with work works worth year yet you your
""".split())  # fmt: skip
_PROSE_END = re.compile(r"(?:ed|ing|ly|able|ible|ness|tion|ment)\Z")
#: Spelled digits that a run needs in the second reading; the first one undoes all of them.
LEAST_SPELLED = 4
_INVISIBLE = "­​‌‍⁠﻿"


@functools.cache
def _one_to_one() -> dict[int, str]:
    """Characters that stand for one ASCII character: the look-alikes, and the compatibility forms that Unicode names."""
    out = {}
    for first, last in ((0x2100, 0x2150), (0x2460, 0x2500), (0xFF01, 0xFF60), (0x1D400, 0x1D800), (0x1FBF0, 0x1FBFA)):
        for c in range(first, last):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1 and "!" <= plain <= "~":
                out[c] = plain
    for plain, others in LOOKALIKES.items():
        out |= {ord(c): plain for c in others}
    return out


def _any_of(words) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


_WORD, _AT, _DOT_WORD, _PLUS = map(_any_of, (DIGIT_WORDS, AT_WORDS, DOT_WORDS, PLUS_WORDS))
#: Whitespace is matched from its first character only and never given back, so a long run of it costs its length once.
_GAP = r"(?<!\s)\s*+"
_OPEN, _CLOSE = r"[\[({<]\s*+", r"\s*+[\])}>]"
_LABEL = "[A-Za-z0-9-]++"
_DOT = rf"(?:\s++{_DOT_WORD}\s++|\s*+{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}\s*+)"
# The separators of a domain may be plain, spelled or bracketed.  Of "x at y.com at z.com" the last "at" counts.
_RULES = re.compile(
    rf"(?P<gone>[{_INVISIBLE}]+)"
    rf"|(?P<at>{_GAP}{_OPEN}(?:{_AT}|@){_CLOSE}\s*+|&#(?:0*64|x0*40);|(?<=[A-Za-z0-9_])\s++(?P<word>{_AT}|@)\s++(?=(?P<domain>{_LABEL}(?:(?:\.|{_DOT}){_LABEL})++)(?!\s++(?:{_AT}|@)\s++{_LABEL}(?:{_DOT}[A-Za-z0-9]|(?:\.{_LABEL})*\.[A-Za-z]{{2,}}\b))))"
    rf"|(?P<dot>{_GAP}{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}\s*+|(?<=[A-Za-z0-9])\s++{_DOT_WORD}\s++(?=[A-Za-z0-9]))"
    rf"|(?P<digits>(?:\b{_PLUS}[\s-]++)?\b(?:{_WORD}|[0-9]++)(?:[\s,-]*+(?:{_WORD}|[0-9]++))*\b)",
    re.IGNORECASE,
)
#: A domain without any disguise; it ends in letters, so that "at 10.30" is a time.
_PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9.-]+")
_PLAIN_END = re.compile(r"\.[A-Za-z]{2,}\Z")
_PIECE_WORD = re.compile(_WORD, re.IGNORECASE)
_PIECE = re.compile(rf"{_WORD}|{_PLUS}|[0-9]", re.IGNORECASE)


def prose_before(text: str, end: int) -> bool:
    """Whether what ends before ``end`` is a word of prose rather than the local part of an address."""
    start = end
    while start and text[start - 1] in _LOCAL:
        start -= 1
    word = text[start:end].lower()
    return word in BEFORE_AT or _PROSE_END.search(word) is not None


def undisguised(text: str, least: int = LEAST_SPELLED) -> tuple[str, np.ndarray, np.ndarray]:
    """The normalised text, and for each of its characters the source range (start, end) that it stands for.

    Runs of fewer than ``least`` spelled digits stay as they are.
    """
    flat = text.translate(_one_to_one())
    parts: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []

    def copy(i: int, j: int) -> None:
        if j > i:
            parts.append(flat[i:j])
            starts.append(np.arange(i, j))
            ends.append(np.arange(i + 1, j + 1))

    def write(char: str, i: int, j: int) -> None:
        parts.append(char)
        starts.append(np.array([i]))
        ends.append(np.array([j]))

    at = 0
    for m in _RULES.finditer(flat):
        kind = m.lastgroup
        if kind == "digits":
            pieces = list(_PIECE.finditer(m[0]))
            if sum(p[0].lower() in DIGIT_WORDS for p in pieces) < least:
                continue
            copy(at, m.start())
            for p in pieces:
                write(DIGIT_WORDS.get(p[0].lower(), "+" if p[0].lower() in PLUS_WORDS else p[0]), m.start() + p.start(), m.start() + p.end())
        else:
            if m["domain"] and _PLAIN_DOMAIN.fullmatch(m["domain"]) and (not _PLAIN_END.search(m["domain"]) or prose_before(flat, m.start())):
                continue
            copy(at, m.start())
            if kind != "gone":
                write("@" if kind == "at" else ".", m.start(), m.end())
        at = m.end()
    copy(at, len(flat))
    if not parts:
        return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap; each @ is tried once, from the start of the run before it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        # Beyond a failed @ no match can begin before it.
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, *x) for x in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _longer(text: str, kind: int, p: int, q: int, fixed: tuple[int, int, int]) -> bool:
    """Whether an address goes beyond a fixed one without any white space."""
    k, s, e = fixed
    return k == kind == 0 and p <= s and e <= q and (p, q) != (s, e) and not re.search(r"\s", text[p:s] + text[e:q])


def _half_spelled(text: str, starts: np.ndarray, ends: np.ndarray, s: int, plain: str) -> bool:
    """Whether some dots of an IP address are words and others plain, as in "version 1.2.3 dot four"."""
    dots = [text[starts[s + i] : ends[s + i]].strip() for i, c in enumerate(plain) if c == "."]
    return any(d == "." for d in dots) and any(d[:1].isalpha() for d in dots)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What is found only after the disguises are undone, in source positions.

    A fixed address inside a longer one is part of it, as where a look-alike cuts it short, and the longer one is added; words never
    make a fixed match longer.  What overlaps fixed matches in any other way is not added.  All spelled digits are undone first, and the patterns decide.  A number word beside an identifier may spoil it then, so what
    is found while short runs of them stay as they are is added where nothing else was.
    """
    first = undisguised(text, 1)
    readings = [first]
    if _PIECE_WORD.search(text):
        second = undisguised(text)
        if second[0] != first[0]:
            readings.append(second)
    out, taken = [], []
    for plain, starts, ends in readings:
        if plain == text:
            continue
        new = []
        for kind, s, e in base_spans(plain):
            p, q = int(starts[s]), int(ends[e - 1])
            clear = all(q <= bs or p >= be for bs, be in taken) and all(q <= b[1] or p >= b[2] or _longer(text, kind, p, q, b) for b in base)
            if kind == 1 and _half_spelled(text, starts, ends, s, plain[s:e]):
                continue
            if text[p:q] != plain[s:e] and clear:
                new.append((kind, p, q))
        out += new
        taken += [(p, q) for _, p, q in new]
    return out


_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
#: Lead bytes of the characters that have an ASCII look-alike or are invisible; the Latin letters with accents are not among them.
_STRANGE = ((_B >= 0xC9) & (_B < 0xF8)) | (_B == 0xC4)


@functools.cache
def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    """Hashes of words; letters that are not ASCII count in both cases."""
    out = []
    for word in {w for x in words for w in (x, x.upper(), x.capitalize())}:
        data = np.frombuffer(word.encode(), np.uint8)
        out.append(_text.span_hash(data, np.array([0]), np.array([len(data)]), True)[0])
    return np.unique(np.array(out))


def spelled_numbers(data: np.ndarray, offs: np.ndarray, a: np.ndarray, own: np.ndarray, h: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """Which texts hold a stretch, without words other than those of numbers, that has spelled digits and enough digits for an identifier.

    a, own, h: start, text and hash of each run of letters.  An IP address has 4 digits and 3 dots at least, a number 9 digits.
    """
    dot = np.isin(h, _hashes_of(DOT_WORDS))
    ends = np.cumsum(~(spelled | dot | np.isin(h, _hashes_of(PLUS_WORDS))))
    of_words = ends + own
    # A stretch ends at each other word and at the end of a text; both numbers only grow, so their sum names it.
    def of(at):
        return np.concatenate([[0], ends])[np.searchsorted(a, at)] + _text.owner(at, offs)

    n = int(ends[-1]) + len(offs)
    count = lambda x: np.bincount(x, minlength=n)
    words = count(of_words[spelled])
    digits = words + count(of(np.flatnonzero(_DIGIT[data])))
    dots = count(of_words[dot]) + count(of(np.flatnonzero(data == 46)))
    found = (words > 0) & ((digits >= 9) | ((digits >= 4) & (dots >= 3)))
    return np.bincount(own[spelled & found[of_words]], minlength=len(offs) - 1) > 0


def plain_domains(data: np.ndarray, offs: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which texts hold a word "at" before a word with a dot inside, or before any word if a dot stands behind a bracket or whitespace.

    wide: where whitespace of two bytes begins.
    """
    blank = _text.IS_SPACE[data] | ((data >= 0x1C) & (data <= 0x1F))
    blank[wide] = blank[wide + 1] = True
    a, b = _text.spans(~blank, offs)
    own = _text.owner(a, offs)
    dot = np.flatnonzero(data == 46)
    apart = blank[np.maximum(dot - 1, 0)] | np.isin(data[np.maximum(dot - 1, 0)], np.frombuffer(b"[({<", np.uint8))
    loose = np.bincount(_text.owner(dot[apart], offs), minlength=len(offs) - 1) > 0
    inner = np.searchsorted(dot, b - 1) > np.searchsorted(dot, a, side="right")
    short = np.flatnonzero(b - a <= max(len(w.encode()) for w in AT_WORDS))
    at = short[np.isin(_text.span_hash(data, a[short], b[short], True), _hashes_of(AT_WORDS))]
    at = at[at + 1 < len(a)]
    at = at[(own[at + 1] == own[at]) & (inner[at + 1] | loose[own[at]])]
    return np.bincount(own[at], minlength=len(offs) - 1) > 0


def suspects(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts can hold a fixed match, and which can hold a disguise; neither test misses a text."""
    has = lambda flags: _text.count_in(flags[data], offs)
    base = (has(_DIGIT) >= 4) | (has(_B == 64) > 0)
    odd = has(_STRANGE) > 0
    soft = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xAD))
    odd[_text.owner(soft, offs)] = True
    odd |= (has(np.isin(_B, (40, 60, 91, 123))) > 0) & (has(_DIGIT) > 0)
    # Whitespace of two bytes: U+0085 and U+00A0.
    wide = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], (0x85, 0xA0)))
    letter = _LETTER[data]
    letter[wide] = letter[wide + 1] = False
    a, b = _text.spans(letter, offs)
    if len(a):
        own, h = _text.owner(a, offs), _text.span_hash(data, a, b, True)
        spelled, is_at = np.isin(h, _hashes_of(tuple(DIGIT_WORDS))), np.isin(h, _hashes_of(AT_WORDS))
        few = spelled_numbers(data, offs, a, own, h, spelled) if spelled.any() else False
        at = np.bincount(own[is_at], minlength=len(offs) - 1) > 0
        # A plain or bracketed dot, or a spelled one; a bracketed "at" needs none.
        opened = np.isin(data[np.maximum(a - 1, 0)], np.frombuffer(b"[({< \n\t", np.uint8))
        bracket = np.isin(data[np.maximum(a - 1, 0)], np.frombuffer(b"[({<", np.uint8)) | ((data[np.maximum(a - 1, 0)] == 32) & np.isin(data[np.maximum(a - 2, 0)], np.frombuffer(b"[({<", np.uint8)))
        closed_at = np.bincount(own[is_at & opened & bracket], minlength=len(offs) - 1) > 0
        at_domain = plain_domains(data, offs, wide) if at.any() else False
        dots = np.bincount(own[np.isin(h, _hashes_of(DOT_WORDS))], minlength=len(offs) - 1) > 0
        signs = (has(_B == 64) > 0) & (has(np.isin(_B, (40, 60, 91, 123))) > 0)
        # A sign between spaces, and one written as a character reference.
        sign = np.flatnonzero(data == 64)
        signs |= np.bincount(_text.owner(sign[(sign > 0) & ((_text.IS_SPACE[data[sign - 1]]) | (data[sign - 1] >= 128) | ((data[sign - 1] >= 0x1C) & (data[sign - 1] <= 0x1F)))], offs), minlength=len(offs) - 1) > 0
        mark = np.flatnonzero((data[:-1] == 38) & (data[1:] == 35))
        signs |= np.bincount(_text.owner(mark, offs), minlength=len(offs) - 1) > 0
        digits = has(_DIGIT) > 0
        odd |= few | closed_at | at_domain | (at & dots) | (dots & ((has(_B == 64) > 0) | digits)) | signs
    return base, odd


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts and a digest of the fixed matches, all spans, and how many the transducers added.

    Spans are in code points of the source, end exclusive.  Null text counts as empty; the id may be null; repeated rows each
    have a row.  Spans of one kind and start are listed by their end.  Texts of any length are read whole, in time linear in it; an
    empty table gives an empty one; other columns, whatever their names, are not read.
    """
    empty = hashlib.sha256(b"").hexdigest()

    @_text.batches("text")
    def kernel(batch, data, offs):
        n = batch.num_rows
        counts = np.zeros((5, n), np.int64)
        shas, spans = [empty] * n, [""] * n
        base_of, odd = suspects(data, offs)
        for i in np.flatnonzero(base_of | odd).tolist():
            text = data[offs[i] : offs[i + 1]].tobytes().decode()
            base = base_spans(text) if base_of[i] else []
            more = added_spans(text, base) if odd[i] else []
            for k, _, _ in base:
                counts[k, i] += 1
            counts[4, i] = len(more)
            if base:
                shas[i] = hashlib.sha256(digest(base).encode()).hexdigest()
            spans[i] = digest(sorted([*base, *more]))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts[:4]), pa.array(shas), pa.array(spans), pa.array(counts[4])], [c.split()[0] for c in RESULT.split(", ")])

    return df.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(kernel, RESULT)
