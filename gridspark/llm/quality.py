"""Document quality by co-training two views.

The text view sees which words occur and how they repeat; the metadata view sees source, language and
the size classes of a page (characters, lines, words, and their ratios). Each round both views are fitted and
calibrated on labelled rows kept out of the fits, and each hands the other those pool documents it is surest
of, good and bad ones in the classes' ratio. A pseudo-label is the giver's calibrated chance, so an unsure
view says little. At the end a logistic model over both views' log-odds, fitted on the kept-out rows, scores
every document.

A document is good if it is labelled of quality and not toxic. Fits use a bounded sample: at most
``LABELLED_ROWS`` labelled and ``POOL_ROWS`` unlabelled documents, drawn by a hash of their id; its
hashed features are gathered for the fits, whose weights have a fixed size. Features of the sample and
scores of all whole texts are made in Spark tasks.

Defined results: null text is empty, null metadata a value of its own; labels with a null quality aren't
used, a null toxic is 0, repeated labels take the worst; with labels of one kind only (or none) every
document has that kind's score (or 1.0) and the same threshold holds. Extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm.common import byte_class, mix, slices, table, text_bytes, word_hashes
from gridspark.session import materialize

LABELLED_ROWS = 12_000
POOL_ROWS = 6_000
ROUNDS = 2
EXCHANGED = 0.05  # share of the pool that a view hands over at most each round
SURER = 1.5  # log-odds that it must be above or below the usual odds for that
BUCKETS = 1 << 17
KEEP_SCORE = 0.5
EPOCHS = 30
SPARSITY = 0.3  # penalty on the absolute weight of a bucket
MIN_ROWS = 10  # sample rows that a bucket must occur in
SLICE_BYTES = 1 << 21
SHAPE = 4
WIDTH = 11  # buckets of a text's metadata
SCORES = ("text_score", "metadata_score", "score")

_BETWEEN = ~byte_class(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_MARKS = byte_class(b"#$%&*|<>{}[]=+~^_@\\/")


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets of all texts, where each text's begin, and its shape (repetition, marks)."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    words, first, _ = word_hashes(data, offsets, _BETWEEN)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    distinct = np.unique(doc.astype(np.uint64) << np.uint64(17) | (words % np.uint64(BUCKETS)))
    begin = np.searchsorted(distinct, np.arange(n + 1).astype(np.uint64) << np.uint64(17))
    marks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_MARKS[data], dtype=np.int32, out=marks[1:])
    size = np.maximum(np.diff(offsets), 1)
    share = np.diff(marks[offsets]) / size
    repeats = 1 - np.diff(begin) / np.maximum(count, 1)
    shape = np.stack([np.ones(n), repeats, 4 * share, np.log1p(count) / 10], 1)
    return (distinct % np.uint64(BUCKETS)).astype(np.int64), begin, shape


def _tags(documents: DataFrame) -> Column:
    """Buckets of the named metadata: language, source, and both."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("?"))
    parts = [F.concat(F.lit("l"), text("lang")), F.concat(F.lit("s"), text("source"))]
    parts.append(F.concat(F.lit("b"), text("source"), F.lit("\x00"), text("lang")))
    return F.array(*[F.pmod(F.xxhash64(p), F.lit(BUCKETS)) for p in parts])


def metadata_features(tags: pa.Array, column: pa.Array) -> np.ndarray:
    """Per text the buckets of its tags and of its size classes, these also with the language."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)

    def seen(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(marks, dtype=np.int32, out=sums[1:])
        return np.diff(sums[offsets])

    lines = 1 + seen(data == 10)
    words = 1 + seen((data == 32) | (data == 10) | (data == 9))
    named = tags.flatten().to_numpy(zero_copy_only=False).reshape(len(tags), -1).astype(np.uint64)
    ratios = ((size + 1, 2), (lines, 2), ((size + 1) / lines, 3), ((size + 1) / words, 8))
    classes = np.stack([4096 * k + np.floor(np.log2(v) * fine) for k, (v, fine) in enumerate(ratios)], 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        crossed = classes + ((named[:, :1] + np.uint64(1)) << np.uint64(16))
        hashed = mix(np.concatenate([classes, crossed], 1)) % np.uint64(BUCKETS)
    return np.concatenate([named, hashed], 1).astype(np.int64)


@dataclass
class Sparse:
    """Rows of bucket lists with a dense part."""

    buckets: np.ndarray
    begin: np.ndarray
    dense: np.ndarray

    def margins(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(weights[self.buckets])])
        return np.diff(sums[self.begin]) + self.dense @ weights[BUCKETS:]


def fit_logistic(x: Sparse, y: np.ndarray, epochs: int = EPOCHS, sparsity: float = SPARSITY) -> np.ndarray:
    """Weights of a sparse logistic model by adaptive proximal steps over small groups of rows.

    ``y``: targets from 0 to 1, NaN for rows that don't count.
    """
    width = x.dense.shape[1]
    frequent = np.bincount(x.buckets, minlength=BUCKETS)[x.buckets] >= MIN_ROWS
    begin, buckets = np.concatenate([[0], np.cumsum(frequent)])[x.begin], x.buckets[frequent]
    weights, seen = np.zeros(BUCKETS + width), np.full(BUCKETS + width, 1e-8)
    order = np.random.default_rng(7)
    rows = np.flatnonzero(~np.isnan(y))
    for _ in range(epochs):
        order.shuffle(rows)
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            spans = [buckets[begin[r] : begin[r + 1]] for r in some]
            flat = np.concatenate(spans)
            lengths = np.array([len(s) for s in spans])
            sums = np.concatenate([[0.0], np.cumsum(weights[flat])])[np.concatenate([[0], np.cumsum(lengths)])]
            margin = np.diff(sums) + x.dense[some] @ weights[BUCKETS:]
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]
            touched, where = np.unique(flat, return_inverse=True)
            slope = np.bincount(where, np.repeat(error, lengths), len(touched))
            both = np.concatenate([touched, BUCKETS + np.arange(width)])
            slope = np.concatenate([slope, x.dense[some].T @ error]) + 1e-4 * weights[both]
            seen[both] += slope * slope
            rate = 0.1 / np.sqrt(seen[both])
            moved = weights[both] - rate * slope
            k = len(touched)
            moved[:k] = np.sign(moved[:k]) * np.maximum(0, np.abs(moved[:k]) - rate[:k] * sparsity)
            weights[both] = moved
    return weights


def fit_joint(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two slopes and an intercept over both views' log-odds, by Newton steps."""
    x = np.stack([a, b, np.ones(len(a))], 1)
    start = np.array([1.0, 0.0, 0.0])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -np.where(y > 0, 1, -1) * (x @ w)).sum() + 0.5 * ((w - start) ** 2).sum())

    w = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), slope)
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
    return w


@dataclass
class CoTrained:
    """Weights of both views and of their calibration; ``constant`` if there was one class only."""

    constant: float | None
    text: np.ndarray | None = None
    metadata: np.ndarray | None = None
    joint: np.ndarray | None = None

    def score(self, documents: DataFrame, scores: tuple[str, str, str] = SCORES) -> DataFrame:
        """``documents`` with both views' scores and the joint one, the chance of being good.

        ``scores``: names for them that ``documents`` doesn't have.
        """
        if self.constant is not None:
            every = F.lit(float(self.constant))
            return documents.select("*", *[every.alias(name) for name in scores])
        shared = documents.sparkSession.sparkContext.broadcast(self)  # weights of fixed size
        names = documents.columns
        rows = documents.select("*", _tags(documents).alias("_".join(["", *names])))  # a name of no column
        schema = documents.select(names).schema
        for name in scores:
            schema = schema.add(name, "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            chance = lambda z: pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            for batch in batches:
                for some in slices(batch, names.index("text"), size=SLICE_BYTES):
                    texts = some.column(names.index("text")).cast(pa.string())
                    a = Sparse(*text_features(texts)).margins(m.text)
                    b = _rows(metadata_features(some.column(len(names)), texts)).margins(m.metadata)
                    joint = m.joint[0] * a + m.joint[1] * b + m.joint[2]
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns[: len(names)], chance(a), chance(b), chance(joint)],
                        [*names, *scores],
                    )

        return rows.mapInArrow(run, schema)


def _rows(buckets: np.ndarray) -> Sparse:
    """Rows of equally many buckets."""
    n, width = buckets.shape
    return Sparse(buckets.ravel(), np.arange(n + 1) * width, np.ones((n, 1)))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in (part for batch in batches for part in slices(batch, "text", size=SLICE_BYTES)):
        buckets, begin, shape = text_features(some.column("text"))
        metadata = metadata_features(some.column("tags"), some.column("text")).astype(np.int32)
        tags = pa.ListArray.from_arrays(pa.array(np.arange(len(metadata) + 1, dtype=np.int32) * WIDTH), pa.array(metadata.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(buckets.astype(np.int32)))
        dense = pa.ListArray.from_arrays(pa.array(np.arange(len(shape) + 1, dtype=np.int32) * SHAPE), pa.array(shape.ravel()))
        yield pa.RecordBatch.from_arrays(
            [some.column("doc_id"), some.column("y"), some.column("fold"), tags, lists, dense],
            ["doc_id", "y", "fold", "tags", "buckets", "shape"],
        )


def _hash(column: str) -> Column:
    return F.xxhash64(F.lit(7), F.col(column))


def co_train(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """Fit both views on a bounded sample of ``documents`` and their ``labels``."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    y = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")
    labelled = known.select("doc_id", y.alias("y")).orderBy(_hash("doc_id"), "doc_id").limit(LABELLED_ROWS)
    ids = documents.where("doc_id IS NOT NULL").select("doc_id").orderBy(_hash("doc_id"), "doc_id").limit(POOL_ROWS)
    pool = ids.distinct().join(known.select("doc_id"), "doc_id", "left_anti").withColumn("y", F.lit(None).cast("double"))
    # At most LABELLED_ROWS + POOL_ROWS rows of 16 bytes.
    wanted = F.broadcast(materialize(labelled.unionByName(pool), "quality-sample"))
    fold = F.pmod(F.shiftright(_hash("doc_id"), 20), F.lit(5)).cast("int")
    sample = documents.select("doc_id", "text", _tags(documents).alias("tags")).join(wanted, "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), "y", fold.alias("fold"), "tags", F.col("text").cast("string").alias("text")
    )
    # A document repeated under one id counts once.
    once = sample.mapInArrow(
        _sample_features, "doc_id long, y double, fold int, tags array<int>, buckets array<int>, shape array<double>"
    )
    rows = materialize(once, "quality-features").dropDuplicates(["doc_id"]).orderBy(_hash("doc_id"), "doc_id").toArrow()
    y = rows["y"].to_numpy(zero_copy_only=False).astype(float)
    if len(set(y[~np.isnan(y)])) < 2:
        return CoTrained(float(y[~np.isnan(y)][0]) if (~np.isnan(y)).any() else 1.0)
    lists = rows["buckets"].combine_chunks()
    begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    dense = rows["shape"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPE)
    text = Sparse(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), begin, dense)
    metadata = _rows(rows["tags"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, WIDTH))
    held = rows["fold"].to_numpy() == 0
    fit_on = np.where(held, np.nan, y)
    if len(set(fit_on[~np.isnan(fit_on)])) < 2 or len(set(y[held & ~np.isnan(y)])) < 2:
        fit_on, held = y, ~np.isnan(y)  # too few labels to keep any out
    return exchange(text, metadata, y, fit_on, held, rounds)[0]


def exchange(
    text: Sparse, metadata: Sparse, y: np.ndarray, fit_on: np.ndarray, held: np.ndarray, rounds: int
) -> tuple[CoTrained, list[tuple[int, int]]]:
    """Co-train on sample rows; the model, and how many rows text and metadata handed over each round.

    ``y``: labels (NaN: pool rows); ``fit_on``: those that fits may see; ``held``: rows for calibration.
    """
    use, pool = held & ~np.isnan(y), np.isnan(y)
    nothing = np.zeros(int(use.sum()))
    targets = [fit_on.copy(), fit_on.copy()]  # of the text and of the metadata view
    good = float(np.nanmean(fit_on))
    usual = np.log(good / (1 - good))
    many = int(np.ceil(EXCHANGED * pool.sum()))
    handed = []
    for last in [False] * rounds + [True]:
        w_text, w_metadata = fit_logistic(text, targets[0]), fit_logistic(metadata, targets[1])
        odds = [text.margins(w_text), metadata.margins(w_metadata)]
        if last:
            return CoTrained(None, w_text, w_metadata, fit_joint(odds[0][use], odds[1][use], y[use])), handed
        given = []
        for giver in (0, 1):
            slope, _, shift = fit_joint(odds[giver][use], nothing, y[use])
            sure = slope * odds[giver] + shift
            theirs = targets[1 - giver]
            free = np.flatnonzero(pool & np.isnan(theirs))
            free = free[np.argsort(sure[free], kind="stable")]
            bad, fine = free[: int(many * (1 - good))], free[len(free) - int(np.ceil(many * good)) :]
            some = np.union1d(bad[sure[bad] < usual - SURER], fine[sure[fine] > usual + SURER])
            given.append((some, 1 / (1 + np.exp(-np.clip(sure[some], -30, 30)))))
        for giver, (some, chance) in enumerate(given):
            targets[1 - giver][some] = chance
        handed.append((len(given[0][0]), len(given[1][0])))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents and whether they stay."""
    documents = table(spark, sf_dir, "documents")
    model = co_train(documents, table(spark, sf_dir, "labels"))
    rows = model.score(documents.select("doc_id", "text", "source", "lang"))
    return rows.select(
        "doc_id", "text_score", "metadata_score", "score", (F.col("score") >= KEEP_SCORE).alias("keep")
    )
