"""Array kernels over the bytes of a batch of texts.

A batch of texts is one byte array and the offsets of its texts, just as Arrow
holds it, so words, lines and their hashes are found for all texts of a batch
at once and no text becomes a Python string unless an operator needs one.

Words are runs of bytes other than space and 0x09-0x0D.  Hashes have 64 bits:
a polynomial over a fixed random table, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_ODD = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)

_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Bytes that start a code point.
IS_LEAD = (_BYTES & 0xC0) != 0x80
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix((np.arange(256, dtype=U64) + U64(1)) * _ODD)
_TABLE_LOWER = _TABLE[LOWER]


class _Powers:
    """Powers of the polynomial's base and of its inverse, as far as a chunk needs them."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 1 << max(16, int(n + 1).bit_length())
            base = np.full(size, _ODD)
            base[0] = U64(1)
            cls.up = np.multiply.accumulate(base)
            base[1:] = _INVERSE
            cls.down = np.multiply.accumulate(base)
        return cls.up, cls.down


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text makes a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``inside`` holds; a text's edge ends a run."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = offs[:-1][offs[:-1] < len(inside)]
    before[first] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def owner(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which text each start lies in."""
    return np.searchsorted(offs, starts, side="right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each span's bytes; with ``lower``, A-Z count as a-z."""
    up, down = _Powers.of(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def grams(hashes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` items in a row of one text, and the index of each first item."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total, step = hashes[:m].copy(), _STEP
    for k in range(1, n):
        total += hashes[k : k + m] * step
        step = U64(int(step) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
    at = np.flatnonzero(owners[:m] == owners[n - 1 :])
    return mix(total[at]), at


def count_in(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each byte) in each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def repeated(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur more than once in their text, and which equal an earlier one of it."""
    n = len(hashes)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return again, later
    own = hashes ^ mix(owners.astype(U64) + U64(1))
    kept = np.sort(own)
    twice = np.unique(kept[1:][kept[1:] == kept[:-1]])
    if len(twice) == 0:
        return again, later
    place = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    again = twice[place] == own
    at = np.flatnonzero(again)
    order = np.argsort(own[at], kind="stable")
    same = own[at][order][1:] == own[at][order][:-1]
    later[at[order[1:][same]]] = True
    return again, later


def batches(column: str = "text", limit: int = CHUNK_BYTES):
    """Decorator: a kernel on (record batch, bytes, offsets) of bounded size becomes a mapInArrow function."""

    def wrap(kernel):
        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                index = batch.schema.get_field_index(column)
                _, offs = texts(batch.column(index))
                for i, j in chunks(offs, limit):
                    part = batch.slice(i, j - i)
                    yield kernel(part, *texts(part.column(index)))

        return run

    return wrap
