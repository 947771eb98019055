"""Helpers the operators share: reading tables, vectorised word hashes, fixed-size filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEGMENT_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_schema(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table of this schema."""
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- text as numpy arrays


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str | int, rows: int = 2048, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``rows`` rows and ``size`` bytes of text in column ``name`` (or one row)."""
    _, offsets = text_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = max(at + 1, min(fits, at + rows, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2^64, and their inverses."""
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULTIPLIER)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return up, down


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


ASCII_SPACE = byte_class(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = ASCII_SPACE):
    """Hashes of the words of every text (A-Z lower-cased), in order, and each text's first word.

    ``between`` marks the bytes that separate words. Rolling (Karp-Rabin) prefix sums give every
    word's hash without a loop over words; the work runs in segments of bounded size that end
    between words.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty((0, 2), np.int64)
    inside = ~between[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    starts[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    del starts, ends
    out = np.empty(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + SEGMENT_BYTES)))
            lo, hi = start[at], end[to - 1] + 1
            up, down = _powers(SEGMENT_BYTES) if hi - lo <= SEGMENT_BYTES else _powers.__wrapped__(int(hi - lo))
            sums = np.cumsum((LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo])
            s, e = start[at:to] - lo, end[at:to] - lo
            before = np.where(s > 0, sums[s - 1], np.uint64(0))
            out[at:to] = mix((sums[e] - before) * down[s] + (e - s).astype(np.uint64))
            at = to
    return out, np.searchsorted(start, offsets), np.stack([start, end + 1], 1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5):
    """Hashes of ``size`` consecutive words for every text, and each text's first shingle.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    count = np.diff(first)
    per = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(per)])
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        factor = np.uint64(1)
        for k in range(size):
            rolled += words[k : len(words) - size + 1 + k] * factor
            factor = factor * _STEP
        where = np.repeat(first[:-1] - begin[:-1], per) + np.arange(begin[-1])
        out = np.empty(begin[-1], np.uint64)
        whole = np.repeat(count >= size, per)
        out[whole] = rolled[where[whole]]
        for d in np.flatnonzero((count > 0) & (count < size)):
            h, factor = np.uint64(count[d]), np.uint64(1)
            for w in words[first[d] : first[d + 1]]:
                h, factor = h + w * factor, factor * _STEP
            out[begin[d]] = h * _MULTIPLIER + np.uint64(count[d])
    return mix(out), begin


# ---------------------------------------------------------------- fixed-size filters

FILTER_BITS = 1 << 24


def _filter_positions(value: Column, bits: int) -> Column:
    return F.array(F.pmod(value, F.lit(bits)), F.pmod(F.shiftrightunsigned(value, 24), F.lit(bits)))


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A Bloom filter of a long column as a bit string; its size is fixed, whatever the input's."""
    rows = (
        keys.select(F.explode(_filter_positions(F.col(column), bits)).alias("p"))
        .groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("part"))
        .collect()
    )
    out = bytearray(bits // 8)
    for r in rows:  # at most bits / 32768 rows of 4 KB
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = r["part"]
    return bytes(out)


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the filter (no false negatives). ``bits``: from :func:`bit_filter`."""
    n = np.uint64(len(bits) * 8)
    values = values.view(np.uint64)
    a, b = values % n, (values >> np.uint64(24)) % n
    get = lambda p: (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (get(a) & get(b)).astype(bool)
