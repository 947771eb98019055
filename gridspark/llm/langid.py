"""Language identification by prediction by partial matching (PPM, method C, with exclusion).

Per language, a variable-order byte context tree (orders 3 to 0 over a uniform order -1) is counted
on training texts and then frozen. A text's code length under a language is the exact sum of its
bytes' code lengths: at each byte the longest known context codes it, or escapes to the next
shorter one with the symbols already offered excluded. As the statistics are frozen, a byte's cost
depends on its last three bytes only, so the trees are compiled to one table (context state x byte
x language) and whole texts are scored by array look-ups.

The trees are fitted on a bounded sample: about ``TRAIN_ROWS`` texts per language, drawn by a hash of
the text, so the model's size doesn't grow with the corpus. Counting runs in Spark (partial counts
per task, then summed).

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if
nothing was learned; equal code lengths go to the language first in order; rows with a null lang
aren't learned from; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import table, text_bytes

ORDER = 3
TRAIN_ROWS = 1500
CHUNK = 1 << 20


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte: its last three predecessors and itself as one number (zeros before a text)."""
    out = data.astype(np.uint32)
    for back in (1, 2, 3):
        before = np.zeros(len(data), np.uint32)
        before[back:] = data[:-back] if back < len(data) else data[:0]
        for j in range(back):  # positions whose predecessor lies in another text
            at = offsets[:-1] + j
            at = at[at < offsets[1:]]
            before[at] = 0
        out |= before << np.uint32(8 * back)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            data, offsets = text_bytes(batch.column("text").filter(pa.array(langs == lang)))
            gram, n = np.unique(_codes(data, offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def fit(training: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Frozen statistics of ``training`` (text, lang): counts of four-byte grams by language."""
    known = training.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "text", "lang", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.lit(0)
    for lang, n in sorted(sizes.items()):
        limit = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, rows / n)))).otherwise(limit)
    sample = known.where(F.col("h") < limit).select("text", "lang")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # bounded: distinct four-byte grams of the bounded sample
    return {
        "langs": sorted(sizes),
        "lang": np.array(found["lang"].to_pylist(), object),
        "gram": found["gram"].to_numpy().astype(np.uint32),
        "n": found["n"].to_numpy(),
    }


def compile_trees(stats: dict) -> dict | None:
    """The code length in bits of every byte in every context state, for each language."""
    langs = stats["langs"]
    if not langs or not len(stats["gram"]):
        return None
    symbols = np.unique(stats["gram"] & 255)
    a = len(symbols) + 1  # the last stands for every byte never seen
    symbol = np.full(256, a - 1, np.int32)
    symbol[symbols] = np.arange(a - 1)
    contexts = [np.unique((stats["gram"] >> 8) & ((1 << 8 * k) - 1)) for k in range(ORDER + 1)]
    base = np.cumsum([0] + [len(c) for c in contexts])
    counts = {}
    for lang in langs:
        mine = stats["lang"] == lang
        gram, n = stats["gram"][mine], stats["n"][mine]
        for k in range(ORDER + 1):
            at = np.searchsorted(contexts[k], (gram >> 8) & ((1 << 8 * k) - 1))
            c = np.zeros((len(contexts[k]), a), np.float32)
            np.add.at(c, (at, symbol[gram & 255]), n)
            counts[lang, k] = c
    cost = np.empty((base[-1], a, len(langs)), np.float32)
    for k in range(ORDER + 1):
        shorter = [np.searchsorted(contexts[j], contexts[k] & ((1 << 8 * j) - 1)) for j in range(k + 1)]
        for at in range(0, len(contexts[k]), 4096):
            for i, lang in enumerate(langs):
                to = min(at + 4096, len(contexts[k]))
                cost[base[k] + at : base[k] + to, :, i] = _bits(
                    [counts[lang, j][shorter[j][at:to]] for j in range(k, -1, -1)], a
                )
    # The longest known context of each three bytes, of any language.
    state = np.zeros(1, np.int32)
    for k in range(1, ORDER + 1):
        longer = np.tile(state, 256)  # the byte further back has the higher place
        longer[contexts[k]] = base[k] + np.arange(len(contexts[k]))
        state = longer
    return {"langs": langs, "symbol": symbol, "a": a, "state": state, "cost": cost.reshape(-1, len(langs))}


def _bits(levels: list[np.ndarray], a: int) -> np.ndarray:
    """Code lengths from the counts of a context and its shorter ones, longest first."""
    rest = np.ones((len(levels[0]), 1))
    offered = np.zeros(levels[0].shape, bool)
    p = np.zeros(levels[0].shape)
    for n in levels:
        free = (n > 0) & ~offered
        total = np.where(free, n, 0).sum(1, keepdims=True)
        distinct = free.sum(1, keepdims=True)
        both = np.maximum(total + distinct, 1)
        p += np.where(free, rest * n / both, 0)
        rest = np.where(distinct > 0, rest * distinct / both, rest)
        offered |= free
    left = 256 - offered[:, : a - 1].sum(1, keepdims=True)
    p[:, : a - 1] += np.where(offered[:, : a - 1], 0, rest / np.maximum(left, 1))
    p[:, a - 1 :] = rest / np.maximum(left, 1)
    return -np.log2(np.maximum(p, 1e-300))


def code_lengths(column: pa.Array, model: dict) -> np.ndarray:
    """Bits of every text under every language: (texts, languages)."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(model["langs"])))
    if not len(data):
        return out
    step = max(1, CHUNK)
    for lo in range(0, len(data), step):
        hi = min(len(data), lo + step)
        first = int(np.searchsorted(offsets, lo, "right")) - 1
        last = int(np.searchsorted(offsets, hi, "left"))
        at = np.clip(offsets[first : last + 1], max(0, lo - 3), hi) - max(0, lo - 3)
        codes = _codes(data[max(0, lo - 3) : hi], at)[lo - max(0, lo - 3) :]
        rows = model["state"][codes >> np.uint32(8)] * model["a"] + model["symbol"][codes & np.uint32(255)]
        bits = model["cost"].take(rows, 0)
        starts = np.clip(offsets[first:last] - lo, 0, hi - lo)
        full = np.flatnonzero(np.diff(np.append(starts, hi - lo)))
        if len(full):
            out[first + full] += np.add.reduceat(bits, starts[full], 0, dtype=np.float64)
    return out


def predict(documents: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``documents`` with ``lang_pred`` and ``score``, from ``text`` alone."""
    spark = documents.sparkSession
    if model is None:
        return documents.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(*keep, "text", letter.alias("_letter"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            bits = code_lengths(batch.column("text"), m)
            best = bits.argmin(1)
            p = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            letters = np.array(batch.column("_letter").to_pylist(), bool)
            names = np.where(letters, np.array(m["langs"], object)[best], "und")
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep]
                + [pa.array(names, pa.string()), pa.array(np.where(letters, np.minimum(p, 1.0), 0.0))],
                [*keep, "lang_pred", "score"],
            )

    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's crc32 isn't 2 modulo 4."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    rows = documents.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = compile_trees(fit(rows.where("NOT held_out")))
    return predict(rows, model, ["doc_id", "held_out"])
