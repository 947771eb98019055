"""Risk classifiers on MLlib: training, prediction, evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark.functions.coerce import percent, ratio
from gridspark.operators import boosting
from gridspark.operators.boosting import BoostedModel
from gridspark.operators.grid import FEATURES, RISK_LEVELS
from gridspark.operators.quantiles import quantile_values
from gridspark.session import materialize

SEED = 42


@dataclass(frozen=True)
class Config:
    """One model configuration.

    ``kind`` is ``forest`` (MLlib) or ``boosted`` (multi-class, see ``boosting``); both see all samples.
    ``features`` is MLlib's strategy, or the share of features a boosted tree sees. ``scale`` in the training
    functions shrinks the number of trees for quick runs.
    """

    name: str
    kind: str
    trees: int
    depth: int
    min_leaf: int = 1
    rate: float = 0.1
    subsample: float = 1.0
    features: str = "auto"
    balanced: bool = False
    smote: bool = False
    min_gain: float = 0.0
    l1: float = 0.0


# The two production models and the ten compared configurations.
FOREST = Config("Random Forest", "forest", 200, 12, min_leaf=2, balanced=True)
BOOSTED = Config(
    "Boosted trees", "boosted", 500, 10, 1, 0.03, 0.7, "0.7", balanced=True, min_gain=0.2, l1=0.1
)
CONFIGS = (
    Config("RF (original)", "forest", 200, 12, min_leaf=2, balanced=True),
    Config("XGB (original)", "boosted", 200, 6, rate=0.1, subsample=0.8, features="0.8"),
    Config("RF (improved)", "forest", 500, 15, features="sqrt", balanced=True),
    Config("XGB (improved)", "boosted", 300, 6, 3, 0.05, 0.8, "0.8", True, min_gain=0.1, l1=0.1),
    Config("RF (deep)", "forest", 800, 25, features="sqrt", balanced=True),
    Config("XGB (deep)", "boosted", 500, 10, 1, 0.03, 0.7, "0.7", True, min_gain=0.2, l1=0.1),
    Config("RF + SMOTE", "forest", 500, 15, features="sqrt", smote=True),
    Config("XGB + SMOTE", "boosted", 300, 8, 1, 0.05, 0.8, "0.8", smote=True),
    Config("RF + SMOTE + deep", "forest", 800, 30, features="sqrt", smote=True),
    Config("XGB + SMOTE + deep", "boosted", 500, 12, 1, 0.03, 0.7, "0.7", smote=True, min_gain=0.1),
)


def class_distribution(samples: DataFrame, label: str = "risk_level") -> DataFrame:
    """Samples per class with their share."""
    total = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), total))


def class_weights(samples: DataFrame, label: str = "risk_level") -> DataFrame:
    """Balanced weights: ``n / (classes * n_class)``."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("n").alias("k")).alias("t"))
    return counts.withColumn("_t", totals.scalar()).select(
        label, "n", ratio(F.col("_t.n"), F.col("_t.k") * F.col("n")).alias("weight")
    )


def with_weights(samples: DataFrame, label: str = "risk_level") -> DataFrame:
    """Samples with their class weight (an action that reads at most three numbers)."""
    weights = {r[label]: r["weight"] for r in class_weights(samples, label).collect()}
    cases = [F.when(F.col(label) == c, F.lit(w)) for c, w in weights.items()]
    return samples.withColumn("weight", F.coalesce(*cases, F.lit(1.0)))


def _stages() -> list:
    """Label index over the fixed three classes, and the feature vector."""
    indexer = StringIndexerModel.from_labels(
        list(RISK_LEVELS), inputCol="risk_level", outputCol="label", handleInvalid="keep"
    )
    return [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), indexer]


def weighted(samples: DataFrame, config: Config, rows: int | None = None) -> DataFrame:
    """Samples with the weight a fit gives them, at most ``rows`` of each class if the caller bounds them."""
    data = with_weights(samples) if config.balanced else samples.withColumn("weight", F.lit(1.0))
    if rows is None:
        return data
    data = boosting.bounded(data, list(FEATURES), "risk_level", rows)
    data = data.withColumn("weight", F.col("weight") * F.col("stands_for")).drop("stands_for")
    return data.repartition(data.sparkSession.sparkContext.defaultParallelism)  # a few rows, many passes


def train(
    samples: DataFrame, config: Config = FOREST, scale: float = 1.0, max_depth: int | None = None,
    rows: int | None = None,
) -> PipelineModel | BoostedModel:
    """Fit one configuration. The label index is attached only for the fit.

    ``rows`` bounds a forest's samples of each class; no registered query does so.
    """
    if config.kind == "boosted":
        return train_boosted({"": (samples, config)}, scale, max_depth)[""]
    depth = min(config.depth, max_depth or config.depth)
    trees = max(1, round(config.trees * scale))
    data = weighted(smote(samples) if config.smote else samples, config, rows)
    assembler, indexer = _stages()
    learner = RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=config.min_leaf,
        featureSubsetStrategy=config.features,
        seed=SEED,
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
    )
    ready = _with_three_classes(indexer.transform(assembler.transform(data)))
    return PipelineModel([assembler, learner.fit(ready)])


def train_boosted(
    fits: dict[str, tuple[DataFrame, Config]], scale: float = 1.0, max_depth: int | None = None
) -> dict[str, BoostedModel]:
    """Fit boosted configurations on all their samples, side by side."""
    ready = {}
    for name, (samples, config) in fits.items():
        rows = weighted(smote(samples) if config.smote else samples, config)
        ready[name] = rows, boosting.Settings(
            rounds=max(1, round(config.trees * scale)),
            depth=min(config.depth, max_depth or config.depth),
            rate=config.rate,
            subsample=config.subsample,
            columns=1.0 if config.features == "auto" else float(config.features),
            min_weight=config.min_leaf,
            min_gain=config.min_gain,
            l1=config.l1,
            seed=SEED,
        )
    level = F.array_position(F.array(*[F.lit(v) for v in RISK_LEVELS]), F.col("risk_level")).cast("int") - 1
    return boosting.fit_many(ready, FEATURES, level, len(RISK_LEVELS))


def _with_three_classes(df: DataFrame) -> DataFrame:
    """Declare three classes in the label metadata, whichever of them occur."""
    meta = {"ml_attr": {"type": "nominal", "name": "label", "vals": list(RISK_LEVELS)}}
    return df.withMetadata("label", meta)


def _probabilities(df: DataFrame) -> Column:
    array = isinstance(df.schema["probability"].dataType, T.ArrayType)
    return F.col("probability") if array else vector_to_array("probability")


def predict(model: PipelineModel | BoostedModel, cells: DataFrame) -> DataFrame:
    """Cells with predicted level, confidence and the three probabilities."""
    keep = [c for c in cells.columns if c not in FEATURES and c not in ("risk_level", "risk_rank")]
    actual = ["risk_level"] if "risk_level" in cells.columns else []
    scored = model.transform(cells)
    p = _probabilities(scored)
    names = [f"prob_{v.lower()}" for v in RISK_LEVELS]
    levels = F.array(*[F.lit(v) for v in RISK_LEVELS])
    out = scored.withColumn("_p", p).select(
        *keep,
        *[F.col(c).alias("actual_level") for c in actual],
        F.element_at(levels, F.col("prediction").cast("int") + 1).alias("risk_level"),
        *[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names)],
    )
    return out.withColumn("confidence", F.greatest(*names))


# --- evaluation --------------------------------------------------------------------------------


def confusion(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of actual against predicted level (at most nine rows per group)."""
    return preds.groupBy(*by, "actual_level", "risk_level").agg(F.count(F.lit(1)).alias("n"))


def class_report(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class; undefined ratios count as zero."""
    figures = []
    for level in RISK_LEVELS:
        actual, predicted = F.col("actual_level") == level, F.col("risk_level") == level
        figures.append(
            F.struct(
                F.lit(level).alias("level"),
                F.coalesce(F.sum(F.when(actual & predicted, F.col("n"))), F.lit(0)).alias("hit"),
                F.coalesce(F.sum(F.when(actual, F.col("n"))), F.lit(0)).alias("support"),
                F.coalesce(F.sum(F.when(predicted, F.col("n"))), F.lit(0)).alias("predicted"),
            ).alias(f"_{level}")
        )
    wide = counts.groupBy(*by).agg(*figures)
    rows = wide.select(*by, F.inline(F.array(*[f"_{v}" for v in RISK_LEVELS])))
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("hit"), F.col("predicted")), zero)
    recall = F.coalesce(ratio(F.col("hit"), F.col("support")), zero)
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(ratio(2.0 * F.col("precision") * F.col("recall"), both), zero)
    return rows.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)


def metrics(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted F1, macro precision and recall over the fixed three classes."""
    report = class_report(counts, by)
    total = F.sum("support")
    return report.groupBy(*by).agg(
        ratio(F.sum("hit"), total).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        ratio(F.sum(F.col("f1") * F.col("support")), total).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def evaluate(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    return metrics(confusion(preds, by), by)


def feature_importance(spark: SparkSession, model: PipelineModel | BoostedModel) -> DataFrame:
    """Features by falling importance; for boosting the mean gain of their splits."""
    if isinstance(model, BoostedModel):
        values = model.importances
    else:
        values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(FEATURES, values))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


def tune_thresholds(preds: DataFrame, values=(0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """Macro F1 of every combination of class thresholds, best first.

    A row's class is the one with the highest probability over threshold. The 64 combinations are
    a literal array; each map task combines its rows to at most nine counts per combination. Of
    equal scores the earlier combination is first.
    """
    # Class order of the combinations and of ties.
    order = ("High", "Low", "Medium")
    combos = list(product(values, repeat=len(order)))
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("combo"), *[F.lit(float(t)).alias(v) for v, t in zip(order, c)]
            )
            for i, c in enumerate(combos)
        ]
    )
    score = {v: F.col(f"prob_{v.lower()}") / F.col(f"o.{v}") for v in order}
    best = F.greatest(*score.values())
    pick = F.coalesce(*[F.when(score[v] == best, F.lit(v)) for v in order])
    rows = (
        preds.select("actual_level", "prob_high", "prob_low", "prob_medium")
        .withColumn("o", F.explode(options))
        .select(
            "actual_level",
            pick.alias("risk_level"),
            F.col("o.combo").alias("combo"),
            *[F.col(f"o.{v}").alias(f"threshold_{v.lower()}") for v in order],
        )
    )
    by = ["combo", *[f"threshold_{v.lower()}" for v in order]]
    return evaluate(rows, by).orderBy(F.col("f1_macro").desc(), "combo")


# --- oversampling ------------------------------------------------------------------------------

BLOCK_ROWS = 2000


_BY_POINT = ["risk_level", "x"]
_BLOCK = ["risk_level", "_block", "_deal"]
_NEAR = "near array<struct<d: double, y: array<double>, m: bigint>>"


def _vectors(table, name: str):
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))


def _closest(points, others, copies, k: int, own: bool):
    """Per point its ``k`` closest of ``others`` by squared distance, equals in order of features.

    With ``own`` the two are the same rows and no point is its own neighbour.
    """
    import numpy as np

    order = np.lexsort(others.T[::-1])
    place = np.argsort(order)
    others, copies = others[order], copies[order]
    out = []
    for at in range(0, len(points), 256):
        some = points[at : at + 256]
        d = np.zeros((len(some), len(others)))
        for f in range(points.shape[1]):  # one order of addition, whatever the block
            d += (some[:, f, None] - others[None, :, f]) ** 2
        if own:
            d[np.arange(len(some)), place[at : at + len(some)]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(others) - own)]
        out += [
            [{"d": float(d[i, j]), "y": others[j].tolist(), "m": int(copies[j])} for j in row]
            for i, row in enumerate(near.tolist())
        ]
    return out


def _within(k: int):
    """Per block: neighbours inside it, and the distance by which a closer one must lie outside."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        x, copies = _vectors(group, "x"), group.column("m").to_numpy()
        near = _closest(x, x, copies, k, True)
        reach = []
        for i, (found, m) in enumerate(zip(near, copies.tolist())):
            if m > 1:
                found.insert(0, {"d": 0.0, "y": x[i].tolist(), "m": m - 1})
            sums = np.cumsum([e["m"] for e in found])
            enough = np.flatnonzero(sums >= k)
            reach.append(found[enough[0]]["d"] ** 0.5 if len(enough) else float("inf"))
        kind = pa.list_(pa.struct([("d", pa.float64()), ("y", pa.list_(pa.float64())), ("m", pa.int64())]))
        return group.append_column("near", pa.array(near, kind)).append_column("reach", pa.array(reach, pa.float64()))

    return run


def _across(k: int):
    """Per block: its closest rows to points of other blocks (those with ``asks``)."""

    def run(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        asks = group.column("asks")
        points, rows = group.filter(asks), group.filter(pc.invert(asks))
        near = _closest(_vectors(points, "x"), _vectors(rows, "x"), rows.column("m").to_numpy(), k, False)
        kind = pa.list_(pa.struct([("d", pa.float64()), ("y", pa.list_(pa.float64())), ("m", pa.int64())]))
        return pa.table({"risk_level": points.column("risk_level"), "x": points.column("x"), "near": pa.array(near, kind)})

    return run


def _blocked(points: DataFrame, block_rows: int) -> DataFrame:
    """Points with their place ``p`` on the class's most varied feature, and blocks along it."""
    names = list(FEATURES)
    at = [F.col("x")[i] for i in range(len(names))]
    spread = points.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]
    )
    parts = []
    for r in spread.collect():
        axis = max(range(len(names)), key=lambda i: r[f"s{i}"])
        rows = points.where(F.col("risk_level") == r["risk_level"]).withColumn("p", at[axis])
        blocks = -(-r["n"] // block_rows)
        block = F.lit(0)
        if blocks > 1:
            shares = [i / blocks for i in range(1, blocks)]
            cuts = rows.agg(F.percentile_approx("p", shares, 10_000).alias("c")).scalar()
            rows = rows.withColumn("_cuts", cuts)
            block = F.size(F.filter("_cuts", lambda c: c < F.col("p")))
        parts.append(rows.withColumn("_block", block).drop("_cuts"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    # equal places may overfill a block: it is dealt over several, which ask each other
    sizes = out.groupBy("risk_level", "_block").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_parts"))
    out = out.join(sizes, ["risk_level", "_block"])
    return out.withColumn("_deal", F.pmod(F.xxhash64("x"), F.col("_parts")).cast("int")).drop("_parts")


def nearest_samples(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The vectors of the ``k`` nearest samples of every distinct point (risk_level, x, m copies).

    Exact: a block gives each point a first k-th distance, and every other block that comes within
    it along one feature (no two points are closer than their difference there) is asked as well.
    """
    rows = materialize(_blocked(points, block_rows), "smote-blocks")
    first = rows.groupBy(*_BLOCK).applyInArrow(
        _within(k), f"{rows._jdf.schema().toDDL()}, {_NEAR}, reach double"
    )
    first = materialize(first, "smote-within")
    spans = rows.groupBy(*_BLOCK).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    spans = spans.agg(F.collect_list(F.struct(*_BLOCK, "lo", "hi")).alias("s")).scalar()
    reach = F.col("reach") * (1.0 + 1e-9) + F.abs("p") * 1e-12

    def open_block(s):
        same = (s["_block"] == F.col("_block")) & (s["_deal"] == F.col("_deal"))
        close = (s["lo"] <= F.col("p") + reach) & (s["hi"] >= F.col("p") - reach)
        return (s["risk_level"] == F.col("risk_level")) & ~same & close

    asked = first.withColumn("_s", spans).withColumn("_s", F.explode(F.filter("_s", open_block)))
    asked = asked.select("risk_level", "x", "m", F.col("_s._block").alias("_block"), F.col("_s._deal").alias("_deal"))
    asked = materialize(asked, "smote-asked")
    # no task holds more than about a block of points and a block of rows
    chunks = asked.groupBy(*_BLOCK).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_n"))
    asks = asked.join(chunks, _BLOCK).withColumn("_chunk", F.pmod(F.xxhash64("x", F.lit(1)), F.col("_n")).cast("int"))
    holds = rows.join(chunks, _BLOCK).withColumn("_chunk", F.explode(F.expr("sequence(0, _n - 1)")))
    cols = [*_BLOCK, "_chunk", "x", "m"]
    both = asks.select(*cols, F.lit(True).alias("asks")).unionByName(holds.select(*cols, F.lit(False).alias("asks")))
    second = both.groupBy(*_BLOCK, "_chunk").applyInArrow(_across(k), f"risk_level string, x array<double>, {_NEAR}")
    found = first.select(*_BY_POINT, "near").unionByName(second).groupBy(*_BY_POINT)
    found = found.agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    each = F.transform("near", lambda e: F.array_repeat(e["y"], F.least(e["m"], F.lit(k)).cast("int")))
    return found.select(*_BY_POINT, F.slice(F.flatten(each), 1, k).alias("near"))


def smote(
    samples: DataFrame, k: int = 3, seed: int = SEED, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Oversample every minority class to exactly the size of the largest.

    New points lie between a sample and one of its ``k`` nearest neighbours of the same class
    (:func:`nearest_samples`); equally near ones rank by their features. The points depend on the
    samples and the seed only, not on partitions or ``block_rows``. The only sample of a class has
    no neighbour and is repeated.
    """
    counts = {r["risk_level"]: r["n"] for r in class_distribution(samples).collect()}
    largest = max(counts.values(), default=0)
    need = {c: largest - n for c, n in counts.items() if n < largest}
    doubles = [F.col(c).cast("double").alias(c) for c in FEATURES]
    base = samples.select(*doubles, "risk_level")
    if not need:
        return base
    points = base.where(F.col("risk_level").isin(*need)).select(
        "risk_level", F.array(*[F.col(c) + 0.0 for c in FEATURES]).alias("x")
    )
    points = materialize(points.groupBy(*_BY_POINT).agg(F.count(F.lit(1)).alias("m")), "smote-points")
    near = nearest_samples(points, k, block_rows)

    def chance(*of):
        return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / float(1 << 53)

    def per_class(values):
        return F.coalesce(*[F.when(F.col("risk_level") == c, F.lit(v)) for c, v in values.items()])

    each = per_class({c: n // counts[c] for c, n in need.items()})
    drawn = points.join(near, _BY_POINT).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    drawing = chance(F.lit(0), F.col("x"), F.col("_copy"))
    # one more for as many samples as are still missing: those of the least hashes, whose bound is
    # the exact quantile half-way between two ranks
    copies = points.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    bounds = {}
    for c, n in need.items():
        more = n % counts[c]
        at = [(more - 0.5) / (counts[c] - 1)] if more else None
        bounds[c] = quantile_values(copies.where(F.col("risk_level") == c), drawing, at)[0] if at else -1.0
    extra = (drawing < per_class(bounds)).cast("int")
    drawn = drawn.withColumn("_times", each + extra).where("_times > 0")
    drawn = drawn.withColumn("_time", F.explode(F.expr("sequence(1, _times)")))
    one = [F.col("x"), F.col("_copy"), F.col("_time")]
    drawn = drawn.withColumns({"_pick": chance(F.lit(1), *one), "_gap": chance(F.lit(2), *one)})
    other = F.coalesce(F.get("near", F.floor(F.col("_pick") * F.size("near")).cast("int")), F.col("x"))
    made = F.zip_with("x", "_other", lambda u, v: u + F.col("_gap") * (v - u))
    made = drawn.withColumn("_other", other).select("risk_level", made.alias("x"))
    return base.unionByName(made.select(*[F.col("x")[i].alias(c) for i, c in enumerate(FEATURES)], "risk_level"))


# --- saving ------------------------------------------------------------------------------------


def save_model(model: PipelineModel | BoostedModel, path: str) -> None:
    if isinstance(model, BoostedModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | BoostedModel:
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stages")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # MLlib's layout
        return PipelineModel.load(path)
    return boosting.load(spark, path)
