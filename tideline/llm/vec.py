"""Byte-level numpy kernels over Arrow string columns.

A text column arrives as one UTF-8 buffer with offsets, so that words, lines
and n-grams of many documents are found and hashed by a few array operations
instead of a Python loop per document.  White space is ASCII only, as in
``[^\\x20\\x09-\\x0D]+``, which makes byte and code point scans agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Base of the polynomial hash: odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII capitals to small letters, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: A random 64-bit value for each byte; the seed is part of the format.
SYMBOL = np.random.Generator(np.random.PCG64(20_240_611)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

#: Spans of this many bytes are hashed a second time: polynomials modulo 2**64 agree for certain words of 1,024 letters, whatever the base.
LONG = 512

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        made = []
        for base in (_BASE, _INV):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            made.append(out)
        if size > 1 << 23:  # one huge document: not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on unsigned 64-bit values; makes a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    valid = np.asarray(array.is_valid()) if array.null_count else np.ones(len(array), bool)
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0], valid


def chunks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Spans:
    """Starts, ends (exclusive) and row numbers of runs in a buffer."""

    __slots__ = ("end", "row", "start")

    def __init__(self, start: np.ndarray, end: np.ndarray, row: np.ndarray):
        self.start, self.end, self.row = start, end, row

    def __len__(self) -> int:
        return len(self.start)

    def per_row(self, n: int) -> np.ndarray:
        return np.bincount(self.row, minlength=n)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """Maximal runs of marked bytes; a run ends where its text ends."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    firsts = firsts[firsts < n]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Spans(start, end, np.searchsorted(offsets, start, "right") - 1)


def words(buf: np.ndarray, offsets: np.ndarray) -> Spans:
    return runs(~IS_SPACE[buf], offsets)


def lines(buf: np.ndarray, offsets: np.ndarray) -> Spans:
    """Lines of every text, split at ``\\n``; an empty text has one empty line."""
    cuts = np.flatnonzero(buf == 0x0A)
    start = np.concatenate([offsets[:-1], cuts + 1])
    end = np.concatenate([cuts, offsets[1:]])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1])
    order = np.lexsort((start, row))
    end_order = np.lexsort((end, np.concatenate([np.searchsorted(offsets, cuts, "right") - 1, np.arange(len(offsets) - 1)])))
    return Spans(start[order], end[end_order], row[order])


class Hasher:
    """64-bit hashes of any spans of a buffer, from prefix sums of a polynomial; long spans by their bytes too."""

    def __init__(self, buf: np.ndarray):
        self._buf = np.ascontiguousarray(buf)
        power, self._inverse = _tables(len(buf) + 1)
        self._sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(SYMBOL[buf] * power[: len(buf)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = mix((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(np.uint64))
        long = np.flatnonzero(end - start >= LONG)
        if len(long):
            data = memoryview(self._buf)
            value[long] ^= np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], np.uint64)
        return value


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte offset, and at the end the total."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def ngrams(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive values of one row, and the index of the first of each."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(values) - n + 1
    out = values[:m].copy()
    for k in range(1, n):
        out = mix(out * U64(3) + values[k : m + k])
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return out[at], at


def keep_rows(docs: DataFrame, decide: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text ``decide(bytes, offsets)`` marks."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = column(batch.column(at))
            for i, j in chunks(off):
                mask = decide(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield batch.slice(i, j - i).filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
