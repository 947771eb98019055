"""Packing token ids into windows by non-negative least squares on the length histogram.

Documents longer than the window fill whole windows; what remains of each has one of ``window`` - 1
lengths, so the corpus is one histogram. All pairs and triples of lengths that fill a window exactly
are enumerated, their repeat counts are the non-negative least-squares fit to the histogram, rounded
down within what there is. What the counts leave over is laid greedily into windows, longest first,
and cut where a window ends; the very last window is cut at powers of two. So no sequence is padded.

Only histograms meet: one row per task and length. Every document finds its own places from its
rank among its task's documents of the same length, the ranks of the tasks before, and the plan,
whose size depends on the window alone. Texts are encoded once, where they are read; their ids are
written to the shared folder and cut from there.

Defined results: a null text is empty (its document is the end id alone); repeated rows are packed
each; an empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridspark.llm.common import slices, table
from gridspark.llm.tokens import encoder, tokenizer_path
from gridspark.session import materialize

WINDOW = 1024
END_ID = 0
ROUNDS = 200
SLICE_BYTES = 1 << 21


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Pairs and triples (0 for none) of present lengths that fill the window, ascending."""
    out = []
    a = np.flatnonzero(present)
    a = a[a > 0]
    if len(a):
        pair = a[(a * 2 <= window)]
        pair = pair[present[window - pair]]
        out.append(np.stack([np.zeros_like(pair), pair, window - pair], 1))
        x, y = np.meshgrid(a, a, indexing="ij")
        z = window - x - y
        fine = (x <= y) & (y <= z)
        fine[fine] = present[z[fine]]
        out.append(np.stack([x[fine], y[fine], z[fine]], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def nnls(columns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of each combination that minimise |A x - counts|, by projected gradients.

    A's columns count the lengths of a combination; steps are scaled by each column's weight and
    accelerated.
    """
    n, size = len(columns), len(counts)
    used = columns > 0
    flat, rows = columns[used], np.nonzero(used)[0]
    target = counts.astype(float)
    x = previous = np.zeros(n)
    degree = np.maximum(np.bincount(flat, minlength=size), 1)
    step = 1 / np.maximum(np.bincount(rows, degree[flat], n), 1)  # a bound on the column sums of A'A
    momentum = 1.0
    for _ in range(rounds):
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = x + (momentum - 1) / following * (x - previous)
        error = np.bincount(flat, y[rows], size) - target
        error[0] = 0
        previous, x = x, np.maximum(0, y - step * np.bincount(rows, error[flat], n))
        momentum = following
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> dict:
    """Where the k-th remainder of every length goes.

    ``key``/``first``/``offset``: ranges of ranks (length << 44 | rank) that share a place in a
    combination; ``used``: ranks placed so, by length; ``rest``: where the others start in the
    stream that is cut into windows; ``sequences``: windows used by combinations.
    """
    columns = combinations(window, counts > 0)
    repeats = nnls(columns, counts) if len(columns) else np.empty(0)
    left = counts.astype(np.int64).copy()
    used = np.zeros(window, np.int64)
    key, first, offset, base = [], [], [], 0
    for c in np.argsort(-repeats, kind="stable"):
        lengths = [int(v) for v in columns[c] if v]
        need = defaultdict(int)
        for v in lengths:
            need[v] += 1
        n = min(int(repeats[c] + 1e-6), *(int(left[v]) // k for v, k in need.items()))
        if repeats[c] < 1 - 1e-6:
            break
        if n <= 0:
            continue
        at = 0
        for v in lengths:
            key.append(v << 44 | int(used[v]))
            first.append(base - int(used[v]))
            offset.append(at)
            used[v] += n
            left[v] -= n
            at += v
        base += n
    rest, total = np.zeros(window, np.int64), 0
    for v in range(window - 1, 0, -1):
        rest[v] = total
        total += v * int(left[v])
    order = np.argsort(key)
    return {
        "key": np.array(key, np.int64)[order],
        "first": np.array(first, np.int64)[order],
        "offset": np.array(offset, np.int64)[order],
        "used": used,
        "rest": rest,
        "total": total,
        "sequences": base,
    }


def stream_cuts(at: int, length: int, total: int, window: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the parts of a piece at ``at`` of a stream of ``total`` ids."""
    out = []
    whole = total // window
    while length:
        if at < whole * window:
            seq, begin, size = at // window, at // window * window, window
        else:  # the last, partial window: one sequence for each power of two in its length
            seq, begin, size = whole, whole * window, 1 << ((total % window).bit_length() - 1)
            while at >= begin + size:
                begin += size
                seq, size = seq + 1, 1 << ((total - begin).bit_length() - 1)
        n = min(length, begin + size - at)
        out.append((seq, at - begin, n))
        at, length = at + n, length - n
    return out


def _encode(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, windows = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in batches:
            for some in slices(batch, "text", 1024, SLICE_BYTES):
                ids, begin = encoder(path).encode(some.column("text"))
                n = np.diff(begin) + 1
                kind = np.uint16 if not len(ids) or ids.max() < 65536 > end_id else np.uint32
                tail = np.array([end_id], kind).tobytes()
                ids = ids.astype(kind)
                rest, full = n % window, np.cumsum(n // window)
                order = np.argsort(rest, kind="stable")
                sizes = np.bincount(rest, minlength=window)
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rank += ranks[rest]
                ranks += sizes
                before = windows + full - n // window
                windows += int(full[-1])
                data = ids.tobytes()
                at = (begin * ids.itemsize).tolist()
                packed = [data[a:b] + tail for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(n),
                        pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(before), pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "part", "n", "rest", "rank", "windows", "ids"],
                )

    return run


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _place(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield _pieces(batch.slice(at, 1024), p, window)

    return run


def _pieces(batch: pa.RecordBatch, p: dict, window: int) -> pa.RecordBatch:
    n, rest = batch.column("n").to_numpy(), batch.column("rest").to_numpy()
    rank = batch.column("rank").to_numpy() + batch.column("rank_base").to_numpy()
    windows = (batch.column("windows").to_numpy() + batch.column("window_base").to_numpy()).tolist()
    where = np.searchsorted(p["key"], rest.astype(np.int64) << 44 | rank, "right") - 1
    in_plan = rank < p["used"][rest]
    stream = p["rest"][rest] + (rank - p["used"][rest]) * rest
    patterns = p["windows"]
    stream_base = patterns + p["sequences"]
    rows, crcs = [], []
    docs = batch.column("doc_id").to_pylist()
    for i, (doc, size, data) in enumerate(zip(docs, n.tolist(), batch.column("ids"))):
        data = data.as_py()
        ids = memoryview(np.frombuffer(data, np.uint16 if len(data) == 2 * size else np.uint32).astype("<u4").tobytes())
        full, r = size // window, int(rest[i])
        parts = [(windows[i] + w, 0, window) for w in range(full)]
        if r and in_plan[i]:
            j = where[i]
            parts.append((patterns + int(p["first"][j] + rank[i]), int(p["offset"][j]), r))
        elif r:
            parts += [(stream_base + s, o, m) for s, o, m in stream_cuts(int(stream[i]), r, p["total"], window)]
        start = 0
        for seq, offset, m in parts:
            rows.append((doc, start, m, size, seq, offset))
            crcs.append(zlib.crc32(ids[4 * start : 4 * (start + m)]))
            start += m
    doc, start, length, size, seq, offset = zip(*rows)
    columns = (doc, start, length, crcs, size, seq, offset)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def pack(documents: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: where each run of a document's ids goes (see ``PIECES``)."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = materialize(
        rows.mapInArrow(
            _encode(tokenizer, end_id, window),
            "doc_id long, part int, n long, rest int, rank long, windows long, ids binary",
        ),
        "packing-ids",
    )
    per_task = materialize(
        encoded.groupBy("part", "rest").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n") / window)).alias("windows")
        ),
        "packing-histogram",
    )
    counts = np.zeros(window, np.int64)
    for r in per_task.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # one row per length
        counts[r["rest"]] = r["n"]
    counts[0] = 0
    p = plan(counts, window)
    p["windows"] = per_task.agg(F.sum("windows")).first()[0] or 0
    # Per task: windows and, for each length, documents in the tasks before it.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.groupBy("part").agg(F.sum("windows").alias("w"))
    bases = bases.select("part", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("window_base"))
    by_length = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.select("part", "rest", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("rank_base"))
    lookup = ranks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "rank_base"))).alias("ranks"))
    lookup = materialize(lookup.join(bases, "part"), "packing-ranks")
    placed = encoded.join(lookup, "part").select(
        "doc_id", "n", "rest", "rank", "windows", "ids", "window_base", F.col("ranks")[F.col("rest")].alias("rank_base")
    )
    return placed.mapInArrow(_place(spark.sparkContext.broadcast(p), window), PIECES)


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in windows of 1024."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
