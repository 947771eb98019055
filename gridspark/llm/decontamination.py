"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words (letters, digits, non-ASCII characters). Five shared words
are a seed. One scan of the documents keeps, for each, the words around seeds that a fixed-size filter
of the benchmark's seeds lets through (it has no false negatives); what passes is joined with the
benchmark's seeds in Spark, and pairs that share too few seeds to reach the threshold go. For every
other pair of document and item, running Karp-Rabin matching marks the longest non-overlapping common
runs again and again (reordered passages are found whole), and the share of the item's words that is
covered decides.

Defined results: null and empty texts, and items of fewer than five words, match nothing; repeated rows
give one result per key and text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import bit_filter, byte_class, in_filter, shingle_hashes, table, text_bytes, word_hashes
from gridspark.session import materialize

MIN_MATCH = 5
COVERAGE = 0.6
_BETWEEN = ~byte_class(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(column: pa.Array):
    words, first, _ = word_hashes(*text_bytes(column), between=_BETWEEN)
    # 0 marks a gap between kept runs
    return np.where(words == 0, np.uint64(1), words), first


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, first = _words(batch.column("text"))
        seeds, begin = shingle_hashes(words, first, MIN_MATCH)
        long_enough = np.diff(first) >= MIN_MATCH
        rows = [
            {"item_id": i, "words": words[first[k] : first[k + 1]].view(np.int64), "seeds": seeds[begin[k] : begin[k + 1]].view(np.int64)}
            for k, i in enumerate(batch.column("item_id").to_pylist())
            if long_enough[k]
        ]
        yield pa.RecordBatch.from_pylist(
            rows, pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))])
        )


def _seeded(bits: bytes):
    """Words around seeds that pass the filter, in order, runs kept apart by a 0; and those seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of_bits = np.frombuffer(bits, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                words, first = _words(some.column("text"))
                seeds, begin = shingle_hashes(words, first, MIN_MATCH)
                hit = in_filter(table_of_bits, seeds)
                short = np.repeat(np.diff(first) < MIN_MATCH, np.diff(begin))
                hit &= ~short
                where = np.flatnonzero(hit)
                rows = []
                doc_of = np.searchsorted(begin, where, "right") - 1
                for d in np.unique(doc_of):
                    mine = where[doc_of == d]
                    local = mine - begin[d]
                    breaks = np.flatnonzero(np.diff(local) > 1) + 1
                    runs = []
                    for r in np.split(local, breaks):
                        runs += [words[first[d] + r[0] : first[d] + r[-1] + MIN_MATCH], np.zeros(1, np.uint64)]
                    rows.append(
                        {
                            "doc_id": some.column("doc_id")[d].as_py(),
                            "h": some.column("h")[d].as_py(),
                            "words": np.concatenate(runs).view(np.int64),
                            "seeds": np.unique(seeds[mine]).view(np.int64),
                        }
                    )
                yield pa.RecordBatch.from_pylist(
                    rows,
                    pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))]),
                )

    return run


def _window_hashes(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and rolling hashes of the windows of ``size`` unmarked words."""
    if len(words) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(len(words) - size + 1, np.uint64)
    n, done, block, span = size, 0, words.copy(), 1
    step = _STEP
    while n:  # doubling: block[i] hashes the span of words from i on
        if n & 1:
            h = h * step + block[done : done + len(h)]
            done += span
        n >>= 1
        if n:
            block = block[:-span] * step + block[span:]
            step, span = step * step, span * 2
    marked = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(marked[size:] == marked[: len(marked) - size])
    return starts, h[starts]


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping common runs (item position, text position, length).

    Running Karp-Rabin (Wise): windows of a search length are matched by hash and extended; the
    longest matches are marked first; the search length falls to ``least``.
    """
    free_item, free_text = np.ones(len(item), bool), text != 0
    tiles: list[tuple[int, int, int]] = []
    with np.errstate(over="ignore"):
        size = max(least, min(len(item), len(text)) // 2)
        while True:
            found, longest = [], 0
            at_item, hash_item = _window_hashes(item, free_item, size)
            at_text, hash_text = _window_hashes(text, free_text, size)
            order = np.argsort(hash_item, kind="stable")
            lo = np.searchsorted(hash_item[order], hash_text, "left")
            hi = np.searchsorted(hash_item[order], hash_text, "right")
            for j in np.flatnonzero(hi > lo):
                t = int(at_text[j])
                for i in at_item[order[lo[j] : hi[j]]].tolist():
                    if i and t and free_item[i - 1] and free_text[t - 1] and item[i - 1] == text[t - 1]:
                        continue  # inside a match that began earlier
                    k = 0
                    while (
                        i + k < len(item) and t + k < len(text)
                        and free_item[i + k] and free_text[t + k] and item[i + k] == text[t + k]
                    ):
                        k += 1
                    if k >= size:
                        found.append((-k, i, t))
                        longest = max(longest, k)
            if longest > 2 * size:
                size = longest
                continue
            again = False
            for k, i, t in sorted(found):
                k = -k
                if free_item[i : i + k].all() and free_text[t : t + k].all():
                    free_item[i : i + k] = False
                    free_text[t : t + k] = False
                    tiles.append((i, t, k))
                else:
                    again = True  # partly covered: its rest is found by another search
            if again:
                continue
            if size > 2 * least:
                size //= 2
            elif size > least:
                size = least
            else:
                return tiles


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, covered, tiles = [], [], []
        for item, text in zip(batch.column("item_words"), batch.column("words")):
            a = np.asarray(item.values).view(np.uint64)
            found = tile(a, np.asarray(text.values).view(np.uint64))
            n.append(len(a))
            covered.append(sum(t[2] for t in found))
            tiles.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), batch.column("item_id"), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(tiles, pa.int64())],
            ["doc_id", "h", "item_id", "item_words", "covered_words", "tiles"],
        )


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of document and benchmark item whose words are covered to at least ``coverage``.

    Columns: doc_id, h (hash of the text), item_id, item_words, covered_words, tiles, coverage.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialize(
        items.mapInArrow(_item_words, "item_id long, words array<long>, seeds array<long>"), "tiling-items"
    )
    # An item's phrase may occur several times in it, and one in the document can cover them all in turn.
    seeds = items.select("item_id", F.size("words").alias("n"), F.explode("seeds").alias("seed"))
    seeds = seeds.groupBy("item_id", "n", "seed").agg(F.count(F.lit(1)).alias("times"))
    bits = bit_filter(seeds, "seed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    kept = materialize(
        rows.mapInArrow(_seeded(bits), "doc_id long, h long, words array<long>, seeds array<long>"), "tiling-documents"
    )
    shared = (
        kept.select("doc_id", "h", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("doc_id", "h", "item_id")
        .agg(F.sum("times").alias("shared"), F.first("n").alias("n"))
        .where(F.col("shared") * MIN_MATCH >= F.col("n") * coverage)
        .select("doc_id", "h", "item_id")
    )
    pairs = materialize(shared, "tiling-pairs")
    # Repeated rows would repeat their pairs.
    once = kept.select("doc_id", "h", "words").dropDuplicates(["doc_id", "h"])
    on = [pairs["doc_id"].eqNullSafe(once["doc_id"]), pairs["h"] == once["h"]]
    with_text = pairs.join(once, on).select(pairs["doc_id"], pairs["h"], pairs["item_id"], once["words"])
    with_text = with_text.join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
    tiled = with_text.select("doc_id", "h", "item_id", "item_words", "words").mapInArrow(
        _tile_pairs, "doc_id long, h long, item_id long, item_words long, covered_words long, tiles long"
    )
    out = tiled.withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    return out.where(F.col("coverage") >= coverage)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``documents`` without those that hold a benchmark item."""
    bad = materialize(
        contaminated(documents, benchmark, coverage).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct(),
        "tiling-leaks",
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = documents["doc_id"].cast("long").eqNullSafe(bad["_d"]) & (F.xxhash64(text) == bad["_h"])
    return documents.join(bad, on, "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least ``COVERAGE`` of a benchmark item's words, with the item."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "tiles", "coverage")
