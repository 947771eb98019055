"""Walk-forward validation, comparison of configurations and the final models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from gridspark.operators import grid, ml
from gridspark.session import materialize, side_by_side

METRICS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


def walk_forward(
    samples: DataFrame, configs=(ml.FOREST, ml.BOOSTED), folds: int = 5, scale: float = 1.0,
    max_depth: int | None = None, forest_scale: float | None = None,
) -> DataFrame:
    """Metrics per configuration and round: train on the past, validate on the next fold.

    Every fit sees all samples of the past and every validation the whole fold. A round's samples are
    oversampled once for all configurations that ask for it. The boosted fits of all rounds run side by
    side and share the cores with the forests, a few at a time; only metric rows and models come to the
    driver. ``forest_scale`` shrinks forests alone.
    """
    spark = samples.sparkSession
    data = materialize(grid.with_folds(samples, folds), "samples")
    filled = {r["fold"] for r in data.select("fold").distinct().collect()}  # a few numbers
    rounds = [k for k in range(1, folds) if k + 1 in filled and min(filled) <= k]
    fits = {}
    for k in rounds:
        past = data.where(F.col("fold") <= k)
        if any(config.smote for config in configs):
            filled_up = materialize(ml.smote(past), "oversampled")
        for config in configs:
            fits[config.name, k] = (filled_up, replace(config, smote=False)) if config.smote else (past, config)
    boosted = {f"{n} {k}": fit for (n, k), fit in fits.items() if fit[1].kind == "boosted"}

    def scores(model, k: int):
        return ml.evaluate(ml.predict(model, data.where(F.col("fold") == k + 1))).first()

    def forest(k: int, past: DataFrame, config: ml.Config) -> Callable:
        return lambda: scores(ml.train(past, config, forest_scale or scale, max_depth), k)

    others = [key for key in fits if f"{key[0]} {key[1]}" not in boosted]
    forests = [forest(key[1], *fits[key]) for key in others]
    models, *found = side_by_side(spark, [lambda: ml.train_boosted(boosted, scale, max_depth), *forests])
    by_fit = dict(zip(others, found))
    rows = []
    for name, k in fits:
        s = by_fit.get((name, k)) or scores(models[f"{name} {k}"], k)
        rows.append((name, k, *[float(s[m]) for m in METRICS]))
    schema = "config string, fold int, " + ", ".join(f"{m} double" for m in METRICS)
    return spark.createDataFrame(rows, schema)


def compare(rounds: DataFrame) -> DataFrame:
    """Mean and population deviation of every metric per configuration, best macro F1 first."""
    stats = []
    for m in METRICS:
        stats += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return rounds.groupBy("config").agg(*stats).orderBy(F.col("f1_macro_mean").desc(), "config")


def tune_last_fold(
    samples: DataFrame, config=ml.FOREST, folds: int = 5, scale: float = 1.0,
    max_depth: int | None = None,
) -> DataFrame:
    """Threshold tuning of one configuration on the last round."""
    data = materialize(grid.with_folds(samples, folds), "samples")
    model = ml.train(data.where(F.col("fold") < folds), config, scale, max_depth)
    preds = ml.predict(model, data.where(F.col("fold") == folds))
    return ml.tune_thresholds(preds)


def final_models(
    outages: DataFrame, samples: DataFrame, path: str, configs=(ml.FOREST, ml.BOOSTED),
    scale: float = 1.0, max_depth: int | None = None,
) -> DataFrame:
    """Fit on all samples, save the models, and predict every cell of the full grid.

    Returns the stacked predictions with ``model`` and ``model_order``.
    """
    from gridspark.sources.tables import union_models

    features = grid.cells_with_data(grid.grid_features(outages))
    data = materialize(samples, "samples")

    def fitted(config: ml.Config) -> Callable:
        return lambda: ml.save_model(ml.train(data, config, scale, max_depth), f"{path}/{config.kind}")

    side_by_side(data.sparkSession, [fitted(config) for config in configs])
    parts = {c.name: ml.predict(ml.load_model(f"{path}/{c.kind}"), features) for c in configs}
    return union_models(parts)
