"""Token ids in Simple-8b blocks: 64-bit words of a 4-bit selector and 60 bits of equal-width ids.

A selector says how many ids a word holds and how wide they are (one packs a run of 240 zeros). An
id of more than 60 bits is an escape: its word points into the block's list of raw values, so that
no word has to be skipped and a block decodes with array operations only. Every block also lists the
number of ids before each 256th word, which lets a reader start inside it.

Blocks hold whole documents and are stored as rows of Parquet files: Spark's writer commits them,
whichever executor is lost, on any file system. Texts are dealt by ranges of doc_id and sorted within
a range, so blocks follow one another in ascending doc_id order; how many ids precede a range comes
from one total per task.

Defined results: a null text is empty (its document holds the end id alone); null ids sort first; rows
of one doc_id sort by text; an empty table gives no block. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import slices, table
from gridspark.llm.tokens import encoder, tokenizer_path
from gridspark.session import scratch_dir

END_ID = 2
BLOCK_IDS = 1 << 16
INDEX_WORDS = 256
SLICE_BYTES = 1 << 22
# Fixed values of the format: ids per word and bits per id, by selector; 15 is the escape.
COUNTS = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sqqqqq")


def _windows(width: np.ndarray) -> np.ndarray:
    """The selector that packs most ids from each position on."""
    n = len(width)
    best = np.full(n, 14, np.uint8)
    best[width > 60] = ESCAPE
    largest, span = {1: width}, 1
    while span * 2 <= 240 and span * 2 <= n:
        w = largest[span]
        largest[span * 2] = np.maximum(w[:-span], w[span:])
        span *= 2
    for s in range(13, -1, -1):
        k = int(COUNTS[s])
        if k > n:
            continue
        p = 1 << (k.bit_length() - 1)
        w = largest[p]
        m = np.maximum(w[: n - k + 1], w[k - p : k - p + n - k + 1])
        best[: n - k + 1][m <= BITS[s]] = s
    return best


def _bit_length(values: np.ndarray) -> np.ndarray:
    """Bits of every value: the exponent of a double, which holds 32 bits exactly."""
    out = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    high = values >> np.uint64(32)
    large = high > 0
    if large.any():
        out[large] = 32 + np.frexp(high[large].astype(np.float64))[1]
    return out


def _word_starts(step: np.ndarray, stride: int = 8) -> np.ndarray:
    """Positions reached from 0 when every position says how far the next one is.

    Jumps are doubled up to ``stride`` words; only every ``stride``-th word is walked to, the words
    between follow for all of them at once.
    """
    n = len(step)
    if not n:
        return np.empty(0, np.int64)
    jumps = [np.append(np.minimum(np.arange(n, dtype=np.int32) + step, n), np.int32(n))]
    while 1 << len(jumps) <= stride:
        jumps.append(jumps[-1][jumps[-1]])
    far, at, anchors = memoryview(jumps.pop()), 0, []  # few are read; a list of all takes longer
    while at < n:
        anchors.append(at)
        at = far[at]
    out = np.array(anchors, np.int32)[:, None]
    for jump in reversed(jumps):
        out = np.stack([out, jump[out]], 2).reshape(len(out), -1)
    out = out.ravel()
    return out[out < n].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids`` (uint64) and the raw values of its escapes."""
    ids = ids.astype(np.uint64)
    if not len(ids):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    width = _bit_length(ids)
    best = _windows(width)
    start = _word_starts(COUNTS[best].astype(np.int32))
    selector = best[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        mine = np.flatnonzero(selector == s)
        for k in range(COUNTS[s] if len(mine) else 0):
            words[mine] |= ids[start[mine] + k] << np.uint64(BITS[s] * k)
    escaped = np.flatnonzero(selector == ESCAPE)
    words[escaped] |= np.arange(len(escaped)).astype(np.uint64)
    return words, ids[start[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    end = np.cumsum(count)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    start = end - count
    for s in range(1, 16):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s] if len(mine) else 0):
            v = (words[mine] >> np.uint64(BITS[s] * k)) & mask
            out[start[mine] + k] = escapes[v] if s == ESCAPE else v
    return out


def encode_block(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, before: int) -> bytes:
    """One block; ``before``: ids in earlier blocks of its file; a null doc_id is the least long."""
    words, escapes = pack(ids)
    index = (np.cumsum(COUNTS[(words >> np.uint64(60)).astype(np.int64)])[INDEX_WORDS - 1 :: INDEX_WORDS]).astype("<i8")
    head = _HEAD.pack(MAGIC, before, len(lengths), len(words), len(escapes), len(index))
    parts = [doc_ids.astype("<i8"), lengths.astype("<i8"), escapes.astype("<u8"), index, words.astype("<u8")]
    return head + b"".join(p.tobytes() for p in parts)


def decode_block(block: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """ids before this block, doc ids, their lengths, and all ids."""
    magic, before, docs, words, escapes, index = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at, out = _HEAD.size, []
    for n, kind in ((docs, "<i8"), (docs, "<i8"), (escapes, "<u8"), (index, "<i8"), (words, "<u8")):
        out.append(np.frombuffer(block, kind, n, at))
        at += 8 * n
    doc_ids, lengths, raw, _, packed = out
    return before, doc_ids, lengths, unpack(packed, raw)


_NULL = -(1 << 63)


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, number = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in slices(batch, "text", 1024, SLICE_BYTES):
                ids, begin = encoder(path).encode(some.column("text"))
                lengths = np.diff(begin) + 1
                ends = np.cumsum(lengths)
                every = np.full(int(ends[-1]), end_id, np.uint64)
                inside = np.ones(len(every), bool)
                inside[ends - 1] = False
                every[inside] = ids
                keys = some.column("doc_id").fill_null(_NULL).to_numpy()
                rows, first = [], 0
                while first < len(ends):
                    start = int(ends[first] - lengths[first])
                    last = max(first + 1, int(np.searchsorted(ends, start + BLOCK_IDS, "right")))
                    block = encode_block(every[start : ends[last - 1]], lengths[first:last], keys[first:last], before)
                    n = int(ends[last - 1]) - start
                    rows.append({"part": part, "number": number, "n_ids": n, "block": block})
                    before, number, first = before + n, number + 1, last
                yield pa.RecordBatch.from_pylist(
                    rows, pa.schema([("part", pa.int32()), ("number", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])
                )

    return run


def write_blocks(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode all texts in ascending doc_id order into block files below ``path``."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = rows.mapInArrow(_write(tokenizer, end_id), "part int, number long, n_ids long, block binary")
    blocks.write.option("compression", "none").parquet(path)


def _read(offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block")):
                before, doc_ids, lengths, ids = decode_block(block.as_py())
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, mask=doc_ids == _NULL),
                        pa.array(offsets[part] + before + ends - lengths),
                        pa.array(lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and the crc32 of its decoded ids."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per task
    offsets, before = {}, 0
    for r in totals:
        offsets[r["part"]], before = before, before + r["n"]
    return blocks.select("part", "block").mapInArrow(
        _read(offsets), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as Simple-8b blocks and read back."""
    path = scratch_dir(spark, "simple8b")
    write_blocks(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return read_documents(spark, path)
