"""Exact top-k inner products by no-random-access aggregation (NRA) over sorted lists.

A block of vectors is a set of lists, one per component, sorted by how far their values spread. All queries read
the lists in that order; what has been read, and the norms of what has not (Cauchy-Schwarz around the
block's mean), bound every vector's score from below and above. A vector is out once its upper bound is under
the k-th best score or lower bound known so far; the components not read yet resolve the final scores of the
rest. A block whose best possible score is too low for a query is not read for it at all.

The vectors are dealt over tasks. A task orders each batch by nearest pivots, so that blocks are tight, visits
them best first, keeps k results per query and carries the k-th score from block to block as the bound to
beat; the k best of all tasks are kept by a window. A query set is sent in chunks of fixed size, each
chunk a pass over all vectors whose result is stored before the next. Bounds of many queries are computed
at once as matrix products.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part,
nor do rows without an id; of rows with one id the first vector in order stands; shorter vectors
count as zero beyond their end; ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridspark.llm.common import table, with_schema
from gridspark.session import materialize

SCALE = 64
K = 20
QUERY_CHUNK = 4096
BLOCK = 1024
PIVOTS = 16  # per batch
GROUP = 512  # queries whose bounds are in memory together
READ = (1 / 2, 3 / 4)  # shares of the lists after which outsiders are dropped
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components as ``floor(64 * x)``."""
    x = F.col("embedding")
    fine = (
        F.col("vec_id").isNotNull()
        & (F.size(x) > 0)
        & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    )
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.arange(width)[None, :] < lengths[:, None]
    out[at] = flat
    return out


def _keep_best(old: tuple, new: tuple, k: int) -> tuple:
    """The k best (query, id, score) per query of both."""
    q, i, s = (np.concatenate(x) for x in zip(old, new))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.empty(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return q[rank < k], i[rank < k], s[rank < k]


class Block:
    """Vectors with what does not depend on a query: list order, means, norms of the unread parts."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, width: float):
        self.order = np.argsort(-x.std(0), kind="stable")
        self.ids, self.whole = ids, x[:, self.order]
        self.exact = np.float32 if width < 2**23 else np.float64 if width < 2**52 else np.int64
        self.kind = np.float32 if width < 2**23 else np.float64
        self.x = self.whole.astype(self.exact)
        self.mean = self.whole.mean(0)
        apart = self.whole - self.mean
        self.cuts = sorted({max(1, int(x.shape[1] * r)) for r in READ} | {x.shape[1]})
        self.rest = [np.sqrt((apart[:, m:] ** 2).sum(1)).astype(self.kind) for m in self.cuts]
        self.radius = float(np.sqrt((apart**2).sum(1).max()))

    def best(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What no vector of the block exceeds, per query."""
        top = queries[:, self.order] @ self.mean + norms * self.radius
        return top + 1e-9 * np.abs(top) + 1


def nra_block(block: Block, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
    """Candidates of one block as (query position, id, score) with every true top-k row among them.

    ``floor``: a score per query that k rows outside this block already reach (-inf: none). Also returns how
    many pairs had to be resolved.
    """
    q = queries[:, block.order]
    weights = q.astype(block.exact)
    bound, begin = floor.copy(), 0
    score = np.zeros((len(q), len(block.ids)), block.exact)
    pairs = np.ones(score.shape, bool)
    pairs[query_ids[:, None] == block.ids[None, :]] = False
    for m, rest in zip(block.cuts, block.rest):
        score += weights[:, begin:m] @ block.x[:, begin:m].T  # the lists from begin to m are read
        begin = m
        if m == q.shape[1]:
            break
        middle = (q[:, m:] @ block.mean[m:]).astype(block.kind)
        reach = np.sqrt((q[:, m:].astype(float) ** 2).sum(1)).astype(block.kind)[:, None] * rest
        seen = score + middle[:, None]
        slack = 1 + 1e-5 * float(np.abs(seen).max(initial=0) + reach.max(initial=0))
        open_ = np.flatnonzero(~np.isfinite(bound))
        if len(open_) and len(block.ids) > k:
            # no k rows known yet: the k-th best lower bound; one more may be the query's own row
            lower = np.where(pairs[open_], seen[open_] - reach[open_], -np.inf)
            bound[open_] = np.partition(lower, lower.shape[1] - k, 1)[:, lower.shape[1] - k] - slack
        pairs &= seen + reach + slack >= bound[:, None]
        if not pairs.any():
            break
    resolved = int(pairs.sum())
    if len(block.ids) > k and resolved:
        # of one block the k best and their ties are enough
        low = np.iinfo(np.int64).min if block.exact is np.int64 else -np.inf
        final = np.where(pairs, score, low)
        pairs &= final >= np.partition(final, final.shape[1] - k, 1)[:, final.shape[1] - k][:, None]
    at, v = np.nonzero(pairs)
    return (at, block.ids[v], score[at, v].astype(np.int64)), resolved


def _blocks(x: np.ndarray, ids: np.ndarray, width: float) -> list[Block]:
    """A batch cut into blocks of near vectors: those nearest to one of a few of its own rows."""
    pivots = x[np.linspace(0, len(x) - 1, PIVOTS).astype(int)].astype(float)
    near = (x.astype(float) @ pivots.T - (pivots**2).sum(1) / 2).argmax(1)
    groups = [np.flatnonzero(near == p) for p in range(len(pivots))]
    return [Block(x[o], ids[o], width) for g in groups for o in (g[i : i + BLOCK] for i in range(0, len(g), BLOCK))]


def _pass(shared, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        norms = np.sqrt((queries.astype(float) ** 2).sum(1))
        largest = float(np.abs(queries).max(initial=0)) * width
        best = [(np.empty(0, np.int64),) * 3 for _ in range(0, len(queries), GROUP)]
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("v"), width)
            size = float(np.abs(matrix).max(initial=0)) * largest
            blocks = _blocks(matrix, batch.column("vec_id").to_numpy(), size)
            for g, some in enumerate(range(0, len(queries), GROUP)):
                part = slice(some, some + GROUP)
                tops = np.stack([b.best(queries[part], norms[part]) for b in blocks])
                for b in np.argsort(-tops.max(1), kind="stable").tolist():
                    floor = np.full(len(query_ids[part]), -np.inf)
                    n = np.bincount(best[g][0], minlength=len(floor))
                    full = np.flatnonzero(n >= k)
                    floor[full] = best[g][2][np.cumsum(n)[full] - 1]
                    alive = np.flatnonzero(tops[b] >= floor)
                    if not len(alive):
                        continue
                    (at, i, s), _ = nra_block(blocks[b], queries[part][alive], query_ids[part][alive], floor[alive], k)
                    best[g] = _keep_best(best[g], (alive[at], i, s), k)
        every = [np.concatenate([b[c] + (g * GROUP if c == 0 else 0) for g, b in enumerate(best)]) for c in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[every[0]]), pa.array(every[1]), pa.array(every[2])], ["query_id", "vec_id", "score"]
        )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, chunk: int = QUERY_CHUNK) -> DataFrame:
    """The k best rows of ``vectors`` (vec_id, v) by inner product for each row of ``queries``.

    Columns: query_id, rank (from 1), vec_id, score. A query's own id is no candidate.
    """
    spark = vectors.sparkSession
    facts = vectors.agg(F.max(F.size("v")).alias("width")).first()
    n = queries.count()
    if not n or facts["width"] is None:
        return with_schema(spark, "query_id long, rank int, vec_id long, score long")
    width = facts["width"]
    tasks = max(spark.sparkContext.defaultParallelism, vectors.rdd.getNumPartitions())
    dealt = materialize(vectors.repartition(tasks), "topk-vectors")
    # Chunks of queries by id range; their number, not their size, grows with the query set.
    chunks = max(1, -(-n // chunk))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(chunks))
    parts = []
    for c in range(chunks):
        rows = queries.where(place == c).orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        v = rows["v"].combine_chunks()
        shared = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), _matrix(v, width)))
        parts.append(materialize(dealt.mapInArrow(_pass(shared, k, width), RESULT), "topk-best"))
        shared.destroy()
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    vectors = materialize(integer_vectors(table(spark, sf_dir, "embeddings")), "topk-integers")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP4_SQL = """
WITH u AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), v AS (
  SELECT vec_id, d, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS c FROM u
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(sum(q.c * r.c) AS BIGINT) AS score
  FROM v q JOIN v r ON q.d = r.d AND q.vec_id <> r.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY 1, 2
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
