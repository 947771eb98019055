"""Multi-class boosted trees: one tree per class and round on the gradients of all classes together.

A fit sees all samples. Features are cut into bins at exact quantiles; trees grow level by level from histograms of
the bins, a leaf's value is a Newton step with L1 and L2 terms, and a split needs a least gain and a least weight
(second derivative) on both sides. Up to ``SHARD_ROWS`` samples are fitted in one task, and the fits of several folds
and configurations run side by side. More samples are dealt over shards that stay in the executors: every level is a
job in which each shard adds up its histograms and only the chosen splits come to the driver.

Gradients are rounded to multiples of one power of two, so fine that the rounding doesn't matter and so coarse that
all sums are exact. With draws by each sample's own hash, a model depends on the samples alone, not on shards.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridspark.operators.quantiles import quantile_values
from gridspark.session import materialize, release, side_by_side

BINS = 48
SHARD_ROWS = 400_000  # samples that one task holds, about 250 bytes each
SAVE_ROUNDS = 20  # after so many rounds the shards' state is stored, which cuts its lineage
NODES = 64  # open nodes whose histograms move as one value


def bounded(samples: DataFrame, columns: list[str], label: str, rows: int) -> DataFrame:
    """At most ``rows`` samples of every class, drawn by a hash, with the number each one stands for. No fit uses it.

    A window per class keeps its first rows on the map side already; equal samples are told apart by
    nothing, and any of them may stay.
    """
    order = Window.partitionBy(label).orderBy(F.xxhash64(*columns), *columns)
    kept = samples.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
    counts = samples.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    out = kept.join(F.broadcast(counts), F.col(label) == F.col("_class"))  # a row per class
    stands_for = F.col("_n") / F.least(F.col("_n"), F.lit(rows))
    return out.withColumn("stands_for", stands_for).drop("_rank", "_class", "_n")


@dataclass(frozen=True)
class Settings:
    """How trees are grown."""

    rounds: int
    depth: int
    rate: float
    subsample: float = 1.0
    columns: float = 1.0
    min_weight: float = 1.0
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    seed: int = 42


# ---------------------------------------------------------------- growing


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _score(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return np.maximum(np.abs(g) - s.l1, 0) ** 2 / (h + s.l2)


def _unit(weight: float) -> float:
    """A power of two; sums of its multiples up to the ``weight`` of all samples are exact."""
    return 2.0 ** (math.ceil(math.log2(max(weight, 1e-300))) - 50)


_PROBS = [i / BINS for i in range(1, BINS)]


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    """Between bins: interpolated quantiles, as :func:`quantile_values` has them."""
    at = np.array(_PROBS) * (len(sorted_values) - 1)
    low, high = sorted_values[np.floor(at).astype(int)], sorted_values[np.ceil(at).astype(int)]
    return np.unique(low + (high - low) * (at - np.floor(at)))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]).astype(np.uint8)


def _features(s: Settings, at: int, width: int) -> np.ndarray:
    """The features that the trees of round ``at`` may use."""
    draw = np.random.default_rng([s.seed, at])
    return np.sort(draw.permutation(width)[: max(1, round(s.columns * width))])


@dataclass
class Shard:
    """Samples of a fit by feature: ``binned`` (feature, sample), and their margins so far."""

    binned: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    key: np.ndarray  # a hash of every sample, for draws
    margin: np.ndarray

    def drawn(self, s: Settings, at: int) -> np.ndarray:
        """The samples that round ``at`` sees."""
        if s.subsample >= 1:
            return np.arange(len(self.y))
        salt = np.random.default_rng([s.seed, at, 1]).integers(1 << 63, dtype=np.uint64)
        h = (self.key ^ salt) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return np.flatnonzero(h ^ (h >> np.uint64(29)) < np.uint64(int(s.subsample * 2**64)))

    def gradients(self, rows: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives by class, of some samples."""
        p, w = _softmax(self.margin[rows]).T, self.weight[rows]
        truth = np.arange(len(p))[:, None] == self.y[rows]
        rounded = lambda v: np.round(v / unit) * unit
        return rounded((p - truth) * w), rounded(np.maximum(2 * p * (1 - p), 1e-16) * w)

    def leaves(self, tree: dict, rows: np.ndarray | None = None) -> np.ndarray:
        """The node of ``tree`` that each sample is in."""
        rows = np.arange(len(self.y)) if rows is None else rows
        at, left, n = np.zeros(len(rows), np.int64), rows, len(self.y)
        flat, place = self.binned.ravel(), np.arange(len(rows))
        while len(place):
            inner = tree["feature"][at[place]] >= 0
            place, left = place[inner], left[inner]
            node = at[place]
            at[place] = tree["left"][node] + (flat[tree["feature"][node].astype(np.int64) * n + left] > tree["cut"][node])
        return at

    def after(self, trees: list[dict]) -> Shard:
        """The same samples with the margins that one more round gives them."""
        step = np.stack([tree["value"][self.leaves(tree)] for tree in trees], 1)
        return Shard(self.binned, self.y, self.weight, self.key, self.margin + step)


def _histograms(binned: np.ndarray, features: np.ndarray, rows: np.ndarray, slot: np.ndarray, g, h, many: int) -> np.ndarray:
    """Sums of both derivatives by (node, feature, bin)."""
    out = np.empty((2, many, len(features), BINS))
    base = slot * BINS
    for i, f in enumerate(features):
        where = base + binned[f].take(rows)
        out[0, :, i] = np.bincount(where, g, many * BINS).reshape(many, BINS)
        out[1, :, i] = np.bincount(where, h, many * BINS).reshape(many, BINS)
    return out


def _choose(sums: np.ndarray, s: Settings) -> dict:
    """Per node: its derivatives, and the feature (of those in use), bin and gain of its best split."""
    g, h = sums[0, :, 0].sum(1), sums[1, :, 0].sum(1)
    left_g, left_h = sums[0].cumsum(2), sums[1].cumsum(2)
    right_g, right_h = g[:, None, None] - left_g, h[:, None, None] - left_h
    gain = _score(left_g, left_h, s) + _score(right_g, right_h, s) - _score(g, h, s)[:, None, None]
    gain[(left_h < s.min_weight) | (right_h < s.min_weight)] = -1
    gain = gain.reshape(len(g), -1)
    best = gain.argmax(1)
    every = np.arange(len(g))
    return {"g": g, "h": h, "feature": best // BINS, "cut": best % BINS, "gain": gain[every, best], "left_h": left_h.reshape(len(g), -1)[every, best]}


class Growth:
    """One class's tree while it grows; ``open`` are the nodes that may still be divided."""

    def __init__(self, features: np.ndarray, s: Settings):
        self.features, self.s, self.depth, self.gains = features, s, 0, []
        self.open = np.zeros(1, np.int64)
        self.tree = {"feature": np.full(1, -1), "cut": np.zeros(1, np.int64), "left": np.zeros(1, np.int64), "value": np.zeros(1)}

    def divide(self, found: dict) -> np.ndarray:
        """Take the open nodes' best splits; which of them were divided. Their children are the open nodes then."""
        s, tree = self.s, self.tree
        g, h = found["g"], found["h"]
        tree["value"][self.open] = -s.rate * np.sign(g) * np.maximum(np.abs(g) - s.l1, 0) / (h + s.l2)
        divided = found["gain"] > max(s.min_gain, 1e-9)
        if self.depth == s.depth:
            divided[:] = False
        self.depth += 1
        nodes, first = self.open[divided], len(tree["feature"])
        many = 2 * len(nodes)
        feature = self.features[found["feature"][divided]]
        self.gains.append((feature, found["gain"][divided]))
        tree["feature"][nodes], tree["cut"][nodes] = feature, found["cut"][divided]
        tree["left"][nodes] = first + np.arange(0, many, 2)
        self.open = first + np.arange(many)
        tree["feature"] = np.concatenate([tree["feature"], np.full(many, -1)])
        tree["cut"] = np.concatenate([tree["cut"], np.zeros(many, np.int64)])
        tree["left"] = np.concatenate([tree["left"], self.open])
        tree["value"] = np.concatenate([tree["value"], np.zeros(many)])
        return divided


def _grow(shard: Shard, rows: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, s: Settings) -> tuple[Growth, np.ndarray]:
    """A tree over some samples of one shard, and the node of each of them."""
    growth, at = Growth(features, s), np.zeros(len(rows), np.int64)
    slot, place, mine = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows
    sums = _histograms(shard.binned, features, rows, slot, g, h, 1)
    flat, n = shard.binned.ravel(), len(shard.y)
    while True:
        found = _choose(sums, s)
        nodes = growth.open
        divided = growth.divide(found)
        if not divided.any():
            return growth, at
        if not divided.all():
            stay = np.flatnonzero(divided.take(slot))
            slot, place, mine, g, h = (v.take(stay) for v in (slot, place, mine, g, h))
        parent = nodes[divided]
        pair = (np.cumsum(divided) - 1).take(slot)
        column, cut = growth.tree["feature"][parent] * n, growth.tree["cut"][parent].astype(np.uint8)
        right = flat.take(column.take(pair) + mine) > cut.take(pair)
        slot = 2 * pair + right
        at[place] = growth.open.take(slot)
        # the lighter child of each pair is added up, the other one is what is left of the parent
        light_right = 2 * found["left_h"][divided] > found["h"][divided]
        some = np.flatnonzero(right == light_right.take(pair))
        pairs = len(light_right)
        used = features if growth.depth < s.depth else features[:1]  # nodes of the last level are not divided
        light = _histograms(shard.binned, used, mine.take(some), pair.take(some), g.take(some), h.take(some), pairs)
        heavy = sums[:, divided, : len(used)] - light
        sums = np.empty((2, 2 * pairs, *light.shape[2:]))
        every = np.arange(pairs)
        sums[:, 2 * every + light_right] = light
        sums[:, 2 * every + ~light_right] = heavy


class Collected:
    """Trees of all rounds as flat arrays, and the gains of their splits."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.gain, self.splits = edges, np.zeros(len(edges)), np.zeros(len(edges), np.int64)
        self.parts: dict = {k: [] for k in ("feature", "split", "left", "value", "size")}
        self.values = np.full((len(edges), BINS), np.inf)
        for f, e in enumerate(edges):
            self.values[f, : len(e)] = e

    def add(self, growth: Growth) -> None:
        for feature, gain in growth.gains:
            np.add.at(self.gain, feature, gain)
            np.add.at(self.splits, feature, 1)
        t = growth.tree
        split = np.where(t["feature"] < 0, np.inf, self.values[t["feature"], t["cut"]])
        for k, v in (("feature", t["feature"]), ("split", split), ("left", t["left"]), ("value", t["value"]), ("size", [len(split)])):
            self.parts[k].append(v)

    def model(self, classes: int, s: Settings) -> dict:
        kinds = {"feature": np.int16, "split": np.float64, "left": np.int32, "value": np.float64, "size": np.int32}
        out = {k: np.concatenate(v).astype(kinds[k]) if v else np.empty(0, kinds[k]) for k, v in self.parts.items()}
        mean = self.gain / np.maximum(self.splits, 1)
        return out | {"gain": mean / max(mean.sum(), 1e-300), "classes": classes, "depth": s.depth}


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, s: Settings, key: np.ndarray | None = None) -> dict:
    """A model as flat arrays: ``classes`` trees per round, each node's feature, split, left child and value.

    ``key`` has a hash of every sample, by which rounds draw them.
    """
    if key is None:
        key = np.random.default_rng(s.seed).integers(1 << 64, size=len(x), dtype=np.uint64)
    edges = [_edges(np.sort(c)) for c in x.T]
    shard = Shard(_binned(x, edges), y, weight, key.view(np.uint64), np.zeros((len(x), classes)))
    out, unit = Collected(edges), _unit(math.fsum(weight))
    for at in range(s.rounds):
        rows, features = shard.drawn(s, at), _features(s, at, len(edges))
        others = np.setdiff1d(np.arange(len(y)), rows, assume_unique=True)
        g, h = shard.gradients(rows, unit)
        for k in range(classes):
            growth, leaf = _grow(shard, rows, g[k], h[k], features, s)
            out.add(growth)
            shard.margin[rows, k] += growth.tree["value"][leaf]
            if len(others):
                shard.margin[others, k] += growth.tree["value"][shard.leaves(growth.tree, others)]
    return out.model(classes, s)


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """The sums of all trees' values per row and class."""
    classes, trees = model["classes"], len(model["size"])
    begin = np.cumsum(model["size"]) - model["size"]
    out = np.zeros((len(x), classes))
    base = np.repeat(begin, model["size"])
    left = model["left"] + base
    left[model["feature"] < 0] = np.arange(len(left))[model["feature"] < 0]  # a leaf leads to itself
    feature = np.maximum(model["feature"], 0)
    split = np.where(model["feature"] < 0, np.inf, model["split"])
    for at in range(0, len(x), 256):
        some = x[at : at + 256]
        node = np.tile(begin, (len(some), 1))
        rows = np.arange(len(some))[:, None]
        for _ in range(model["depth"]):
            node = left[node] + (some[rows, feature[node]] > split[node])
        out[at : at + 256] = model["value"][node].reshape(len(some), trees // classes, classes).sum(1)
    return out


# ---------------------------------------------------------------- Spark


@dataclass
class BoostedModel:
    """A fitted model; predicts like an MLlib one, with the class chances as an array."""

    trees: dict
    features: tuple[str, ...]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability`` (array) and ``prediction`` (the class's number)."""
        shared = rows.sparkSession.sparkContext.broadcast(self)  # bounded by rounds and depth
        names = rows.columns
        schema = T.StructType(list(rows.schema)).add("probability", T.ArrayType(T.DoubleType())).add("prediction", "double")

        def run(batches):
            m = shared.value
            for batch in batches:
                x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in m.features], 1)
                p = _softmax(margins(m.trees, x)) if len(x) else np.empty((0, m.trees["classes"]))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m.trees["classes"])
                lists = pa.ListArray.from_arrays(ends, pa.array(p.ravel()))
                best = pa.array(p.argmax(1).astype(float) if len(x) else np.empty(0))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, best], [*names, "probability", "prediction"])

        return rows.mapInArrow(run, schema)

    @property
    def importances(self) -> list[float]:
        """Mean gain of every feature's splits, adding up to one."""
        return self.trees["gain"].tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        content = pickle.dumps((self.trees, self.features))
        spark.createDataFrame([(bytearray(content),)], "boosted binary").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> BoostedModel:
    """A model saved by this library (its file is trusted)."""
    return BoostedModel(*pickle.loads(bytes(spark.read.parquet(path).first()["boosted"])))


def _samples(group: pa.Table, features: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Features, classes, weights and hashes of a group, in one order whatever the order of arrival."""
    group = group.sort_by("key")
    x = np.stack([group.column(f).to_numpy() for f in features], 1)
    return x, group.column("y").to_numpy(), group.column("weight").to_numpy(), group.column("key").to_numpy().view(np.uint64)


def _level(state, growing: dict[int, Growth], features: np.ndarray, s: Settings, at: int, unit: float) -> dict[int, dict]:
    """The best splits of the open nodes of every growing tree, from the histograms of all shards."""
    trees = {k: (growth.tree, growth.open) for k, growth in growing.items()}
    used = features if any(growth.depth < s.depth for growth in growing.values()) else features[:1]

    def sums(shards):
        for _, shard in shards:
            rows = shard.drawn(s, at)
            g, h = shard.gradients(rows, unit)
            for k, (tree, nodes) in trees.items():
                slots = np.full(len(tree["feature"]), -1)
                slots[nodes] = np.arange(len(nodes))
                slot = slots[shard.leaves(tree, rows)]
                some = slot >= 0
                mine = _histograms(shard.binned, used, rows[some], slot[some], g[k][some], h[k][some], len(nodes))
                for lo in range(0, len(nodes), NODES):
                    yield (k, lo), mine[:, lo : lo + NODES]

    keys = sum(-(-len(nodes) // NODES) for _, nodes in trees.values())
    added = state.mapPartitions(sums).reduceByKey(lambda a, b: a + b, min(keys, state.getNumPartitions()))
    found = dict(added.mapValues(lambda v: _choose(v, s)).collect())  # some numbers per open node
    return {k: {c: np.concatenate([found[key][c] for key in sorted(found) if key[0] == k]) for c in found[k, 0]} for k in trees}


def _fit_shards(stored: DataFrame, shards: int, features: tuple[str, ...], classes: int, s: Settings) -> dict:
    """The same model as :func:`fit` gives, from samples that are dealt over so many shards."""
    spark = stored.sparkSession
    edges = [np.unique(quantile_values(stored, F.col(f), _PROBS)) for f in features]

    def begin(group):
        x, y, weight, key = _samples(group, features)
        shard = Shard(_binned(x, edges), y.astype(np.uint8), weight, key, np.zeros((len(x), classes)))
        return pa.table({"shard": group.column("shard")[:1], "state": pa.array([pickle.dumps(shard)], pa.binary())})

    def load(table):
        rows = table.rdd.map(lambda r: (r["shard"], bytes(r["state"]))).partitionBy(shards, int)
        return rows.mapValues(pickle.loads).persist(StorageLevel.MEMORY_AND_DISK)

    kind = "shard int, state binary"
    dealt = stored.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(begin, kind)
    saved = materialize(dealt, "boost-shards")
    state = load(saved)
    unit = _unit(math.fsum(state.map(lambda x: math.fsum(x[1].weight)).collect()))  # a number per shard
    out = Collected(edges)
    for at in range(s.rounds):
        used = _features(s, at, len(edges))
        grown = [Growth(used, s) for _ in range(classes)]
        growing = dict(enumerate(grown))
        while growing:
            found = _level(state, growing, used, s, at, unit)
            growing = {k: growth for k, growth in growing.items() if growth.divide(found[k]).any()}
        for growth in grown:
            out.add(growth)
        trees = [growth.tree for growth in grown]
        after, before = state.mapValues(lambda shard, trees=trees: shard.after(trees)).persist(StorageLevel.MEMORY_AND_DISK), state
        if (at + 1) % SAVE_ROUNDS:
            after.count()
            state = after
        else:
            pickled = after.mapValues(lambda shard: bytearray(pickle.dumps(shard)))
            old, saved = saved, materialize(spark.createDataFrame(pickled, kind), "boost-shards")
            state = load(saved)
            state.count()
            after.unpersist()
            release(old)
        before.unpersist()
    state.unpersist()
    release(saved)
    return out.model(classes, s)


def fit_many(
    fits: dict[str, tuple[DataFrame, Settings]], features: tuple[str, ...], label: Column, classes: int
) -> dict[str, BoostedModel]:
    """Fit several models on all rows of their frames: each in a task of its own, or over shards if it has too many.

    Every frame has ``weight``; ``label`` gives the class's number.
    """
    parts, settings = None, {}
    for name, (samples, s) in fits.items():
        columns = [F.col(f).cast("double").alias(f) for f in features]
        rows = samples.select(F.lit(name).alias("fit"), *columns, label.alias("y"), F.col("weight").cast("double").alias("weight"))
        parts = rows if parts is None else parts.unionByName(rows)
        settings[name] = s
    if parts is None:
        return {}
    # equal samples are numbered, so that each has a hash of its own
    same = ["fit", *features, "y", "weight"]
    counted = parts.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_at", F.explode(F.expr("sequence(0L, (_n - 1) div 65536)"))).withColumn(
        "_at", F.explode(F.expr("sequence(_at * 65536, least(_n, (_at + 1) * 65536) - 1)"))
    )
    stored = materialize(numbered.select(*same, F.xxhash64(*same[1:], "_at").alias("key")), "boost-samples")
    sizes = {r["fit"]: r["count"] for r in stored.groupBy("fit").count().collect()}  # a row per fit
    one = [name for name, n in sizes.items() if n <= SHARD_ROWS]

    def run(key, group):
        x, y, weight, hashes = _samples(group, features)
        model = fit(x, y, weight, classes, settings[key[0].as_py()], hashes)
        return pa.table({"fit": pa.array([key[0].as_py()]), "model": pa.array([pickle.dumps(model)], pa.binary())})

    def in_tasks():
        # more partitions than fits, as two that meet in one would wait for each other
        dealt = stored.where(F.col("fit").isin(one)).repartition(8 * len(one), "fit")
        found = dealt.groupBy("fit").applyInArrow(run, "fit string, model binary").collect()  # a row per fit
        return {r["fit"]: pickle.loads(bytes(r["model"])) for r in found}

    def spread(name):
        mine = stored.where(F.col("fit") == name)
        return lambda: {name: _fit_shards(mine, -(-sizes[name] // SHARD_ROWS), features, classes, settings[name])}

    jobs = [in_tasks] if one else []
    found = side_by_side(stored.sparkSession, jobs + [spread(name) for name in sizes if name not in one])
    release(stored)
    return {name: BoostedModel(model, tuple(features)) for some in found for name, model in some.items()}
