"""Alignment of two tokenizers' tokens over the bytes of each text, by interval coalescing.

Tokens of both kinds are intervals of bytes. All intervals of a slice of texts (the texts laid end to end) are
sorted by start; where a start reaches the running maximum of the ends, a group begins, and inside a group
every token of one kind is linked to those of the other that overlap it. How many documents hold an id pair
linked is counted over all rows: a slice gives each of its distinct pairs once with a number of documents,
these are summed, and the sums come back to the slices, not to the documents, so that a common pair moves
once per slice.

A text that is null or empty, or whose tokens' bytes don't add up to a blank and the text, has no tokens: zeros
and an empty string. Rows are counted as documents of their own, also where ids repeat. Strings of special
tokens are plain text. Further columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import slices, table, text_bytes
from gridspark.llm.tokens import plain_encoder, tokenizer_path
from gridspark.session import materialize

SLICE_BYTES = 1 << 20
SLICE_ROWS = 8192


# ---------------------------------------------------------------- tokens as bytes


class ByteTable:
    """The bytes of every token id, end to end, and each one's length."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int32, len(tokens))
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int32)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
        where = np.repeat((self.begin[ids] - ends + length).astype(np.int32), length)
        where += np.arange(len(where), dtype=np.int32)
        return self.data[where]


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokens of a byte-level tokenizer file for a blank and the text."""

    def __init__(self, path: str):
        self.encoder = plain_encoder(path)
        names, byte = self.encoder.tokenizer.get_vocab(with_added_tokens=False), _byte_level()
        added = {t.content: i for i, t in self.encoder.tokenizer.get_added_tokens_decoder().items()}
        tokens = [b""] * (1 + max([*names.values(), *added.values()]))
        for name, i in names.items():
            tokens[i] = bytes(byte[c] for c in name) if name not in added else name.encode()
        self.table = ByteTable(tokens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(pa.array([" " + t for t in texts], pa.large_string()))


class Pieces:
    """Tokens of a sentencepiece model, which puts the blank before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.table = ByteTable(tokens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, count = [], [0]
        for at in range(0, len(texts), 256):
            for ids in self.model.encode(texts[at : at + 256], num_threads=1):
                parts.append(np.array(ids, np.int32))
                count.append(len(ids))
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.cumsum(count)


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


# ---------------------------------------------------------------- intervals


def coalesce(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and every B interval; a group begins where a start reaches all ends so far."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.zeros(len(start), np.int8)
    side[len(a_start) :] = 1
    order = np.lexsort((side, start))
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] >= end[:-1]
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[: len(a_start)], group[len(a_start) :]


def links(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping intervals; those of one kind are in order and don't overlap each other."""
    lo = np.searchsorted(b_end, a_start, "right")
    many = np.searchsorted(b_start, a_end, "left") - lo
    ends = np.cumsum(many)
    a = np.repeat(np.arange(len(many)), many)
    return a, np.arange(len(a)) + np.repeat(lo - ends + many, many)


@lru_cache(maxsize=4)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every number below ``n`` as characters, from the left, with room for a mark behind."""
    names = np.char.mod("%d", np.arange(n)).astype("S")
    width = names.dtype.itemsize + 1
    out = np.zeros((n, width), np.uint8)
    out[:, :-1] = names.view(np.uint8).reshape(n, width - 1)
    return out, (out > 0).sum(1).astype(np.int64)


def group_text(a_ids, a_group, b_ids, b_group, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of all groups and where each token's text ends; ``last`` marks texts' last tokens."""
    ids = np.concatenate([a_ids, b_ids]).astype(np.int64)
    group = np.concatenate([a_group, b_group])
    side = np.zeros(len(ids), np.int8)
    side[len(a_ids) :] = 1
    order = np.lexsort((side, group))
    ids, group, side = ids[order], group[order], side[order]
    characters, length = _digits(1 << 16 if ids.max(initial=0) < 1 << 16 else 1 << int(ids.max()).bit_length())
    rows, length = characters[ids], length[ids]
    mark = np.full(len(ids), ord(";"), np.uint8)
    same = group[1:] == group[:-1]
    mark[:-1][same] = np.where(side[1:] == side[:-1], ord(","), ord("|"))[same]
    rows[np.arange(len(ids)), length] = mark
    rows[last, length[last]] = 0
    kept = rows > 0
    return rows[kept].tobytes(), np.cumsum(kept.sum(1))


def align(texts: list[str], a, b) -> dict:
    """Tokens, groups and linked id pairs of a slice of texts.

    Arrays per text: ``n_a n_b n_groups n_links sha`` and ``first`` (its first entry in ``slot``); ``keys``:
    the distinct id pairs, ``docs``: texts that hold each; ``slot``, ``times``: a text's distinct pairs (their
    place in ``keys``) and its links of that pair.
    """
    n = len(texts)
    a_ids, a_begin = a.encode(texts)
    b_ids, b_begin = b.encode(texts)
    ends = []
    for ids, begin, tokens in ((a_ids, a_begin, a.table), (b_ids, b_begin, b.table)):
        length = tokens.length[ids].astype(np.int64)
        end = np.cumsum(length)
        bounds = np.concatenate([[0], end])[begin]
        ends.append((length, end, bounds, tokens.joined(ids, length, end).tobytes()))
    good = np.zeros(n, bool)
    for i, t in enumerate(texts):
        whole = b" " + t.encode()
        parts = [bytes_[bounds[i] : bounds[i + 1]] for _, _, bounds, bytes_ in ends]
        good[i] = bool(t) and parts[0] == whole and parts[1] == whole
    kept = []
    for ids, begin, (length, *_rest) in ((a_ids, a_begin, ends[0]), (b_ids, b_begin, ends[1])):
        count = np.diff(begin)
        mine = np.repeat(good, count)
        ids, length = ids[mine].astype(np.int64), length[mine]
        end = np.cumsum(length)  # both kinds cover the same bytes now
        kept.append((ids, end - length, end, np.where(good, count, 0), np.repeat(np.arange(n), count)[mine]))
    (a_ids, a_start, a_end, n_a, a_doc), (b_ids, b_start, b_end, n_b, _) = kept
    a_group, b_group = coalesce(a_start, a_end, b_start, b_end)
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    first_of = np.empty(groups, np.int64)
    first_of[a_group[::-1]] = a_doc[::-1]
    n_groups = np.bincount(first_of, minlength=n)
    last = np.cumsum(n_a + n_b)[good] - 1
    text, text_end = group_text(a_ids, a_group, b_ids, b_group, last)
    sha, at = [""] * n, 0
    for i, e in zip(np.flatnonzero(good).tolist(), text_end[last].tolist()):
        sha[i] = hashlib.sha256(text[at:e]).hexdigest()
        at = e
    of_a, of_b = links(a_start, a_end, b_start, b_end)
    doc = a_doc[of_a]
    keys, slot = np.unique((a_ids[of_a] << 32) | b_ids[of_b], return_inverse=True)
    held, times = np.unique(doc * max(1, len(keys)) + slot, return_counts=True)
    slot = held % max(1, len(keys))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=n), "sha": sha,
        "first": np.searchsorted(held, np.arange(n + 1) * max(1, len(keys))), "keys": keys,
        "docs": np.bincount(slot, minlength=len(keys)), "slot": slot, "times": times,
    }


# ---------------------------------------------------------------- Spark

_STORED = pa.schema(
    [
        ("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("slot", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
        ("keys", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())),
    ]
)
STORED = (
    "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "slot array<int>, times array<int>, keys array<long>, docs array<int>"
)


def _lists(values: np.ndarray, bounds, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _align(path_a: str, path_b: str, slice_bytes: int):
    """Rows of documents and, per slice, one row of its distinct pairs (without a document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, SLICE_ROWS, slice_bytes):
                texts = [t or "" for t in part.column(1).to_pylist()]
                r, n = align(texts, a, b), len(texts)
                numbers = [pa.array(r[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int64()), part.column(0), *numbers, pa.array(r["sha"], pa.string()),
                        _lists(r["slot"], r["first"], pa.int32()), _lists(r["times"], r["first"], pa.int32()),
                        pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
                    ],
                    schema=_STORED,
                )
                whole = [0, len(r["keys"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), *[pa.nulls(1, f.type) for f in list(_STORED)[1:9]],
                        _lists(r["keys"], whole, pa.int64()), _lists(r["docs"], whole, pa.int32()),
                    ],
                    schema=_STORED,
                )
                number += 1

    return run


_RESULT = pa.schema(
    [*list(_STORED)[1:6], pa.field("n_best", pa.int64()), pa.field("count_sum", pa.int64()), _STORED.field("groups_sha256")]
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _weigh(docs, pairs):
    """A slice's documents with the counts of its pairs summed over their links."""
    many = docs.num_rows
    n = pairs.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = pairs.column("place").to_numpy()
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    held = docs.column("slot").combine_chunks()
    slot = held.flatten().to_numpy()
    times = docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.diff(held.offsets.to_numpy()))]).astype(np.int64)
    sums = [np.concatenate([[0], np.cumsum(times * of[slot])])[bounds] for of in (best, count)]
    columns = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table(
        [*columns, *[pa.array(np.diff(s), pa.int64()) for s in sums], docs.column("groups_sha256")], schema=_RESULT
    ) if many else _RESULT.empty_table()


def aligned(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Stored rows of every document (tokens, groups, links) and every slice's distinct pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_align(path_a, path_b, slice_bytes), STORED), "align")


def pair_counts(stored: DataFrame) -> DataFrame:
    """Documents per linked id pair (key, a, b, count) and whether no pair of the same A id has more."""
    pairs = stored.where("keys IS NOT NULL").select(F.inline(F.arrays_zip("keys", "docs")))
    counts = pairs.groupBy(F.col("keys").alias("key")).agg(F.sum("docs").alias("count"))
    a, b = F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    counts = materialize(counts.select("key", a, b, "count"), "align-pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # at most one row per id of the vocabulary
    return counts.join(F.broadcast(most), "a").select("key", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def weighed(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with the corpus-wide counts of their links."""
    of = F.col("slice").alias("of")
    places = stored.where("keys IS NOT NULL").select(of, F.posexplode("keys").alias("place", "key"))
    pairs = places.join(counts, "key").select("of", "place", "count", F.col("best").cast("long").alias("best"))
    texts = stored.where("keys IS NULL").drop("keys", "docs")
    return texts.groupBy("slice").cogroup(pairs.groupBy("of")).applyInArrow(_weigh, RESULT)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and sentencepiece tokens of every whole text, aligned."""
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    stored = aligned(table(spark, sf_dir, "documents"), *paths)
    return weighed(stored, pair_counts(stored))
