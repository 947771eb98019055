"""Models: quality floor, zero-division rules, oversampling, folds."""

import random
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridspark.operators import boosting, grid, ml
from gridspark.plans import training


@pytest.fixture(scope="module")
def samples(spark):
    """Three classes that depend on two features, unbalanced, over ten cutoffs."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        x = {f: rng.random() for f in grid.FEATURES}
        n = x["outage_count"] * 10 + rng.gauss(0, 0.3)
        level = "High" if n > 9 else "Medium" if n > 7 else "Low"
        rows.append((*[float(x[f]) for f in grid.FEATURES], level, f"2020-{i % 10 + 1:02d}-01"))
    schema = ", ".join(f"{f} double" for f in grid.FEATURES)
    df = spark.createDataFrame(rows, schema + ", risk_level string, day string")
    return df.select("*", F.to_date("day").alias("cutoff_date")).drop("day").cache()


@pytest.mark.parametrize("config, scale", [(ml.FOREST, 0.1), (ml.BOOSTED, 0.02)])
def test_models_beat_the_majority(spark, samples, config, scale, tmp_path):
    model = ml.train(samples, config, scale, max_depth=5)
    preds = ml.predict(model, samples)
    row = ml.evaluate(preds).first()
    majority = ml.evaluate(
        samples.select(F.col("risk_level").alias("actual_level"), F.lit("Low").alias("risk_level"))
    ).first()
    assert row["f1_macro"] > majority["f1_macro"] + 0.3
    total = preds.select(F.col("prob_low") + F.col("prob_medium") + F.col("prob_high")).limit(20)
    assert all(abs(r[0] - 1) < 1e-9 for r in total.collect())
    # the most probable class is the predicted one, and saving changes nothing
    best = F.greatest("prob_low", "prob_medium", "prob_high")
    assert preds.where(F.abs(best - F.col("confidence")) > 1e-12).count() == 0
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.predict(ml.load_model(str(tmp_path / "m")), samples)
    assert again.exceptAll(preds).count() == 0
    importance = ml.feature_importance(spark, model).collect()
    assert len(importance) == 13 and importance[0]["feature"] == "outage_count"


def test_registered_fits_are_full(spark, sf_dir, monkeypatch):
    from gridspark.registry import QUERIES

    class Seen(Exception):
        pass

    def record(samples, config=ml.FOREST, scale=1.0, max_depth=None, rows=None):
        raise Seen(config.name, scale, max_depth, rows)

    monkeypatch.setattr(ml, "train", record)
    fits = {"g2_forest_predictions": ml.FOREST, "g3_boosted_predictions": ml.BOOSTED, "g6_feature_importance": ml.FOREST, "a9_saved_model": ml.FOREST}
    for name, config in fits.items():
        with pytest.raises(Seen) as seen:
            QUERIES[name](spark, sf_dir)
        assert seen.value.args == (config.name, 1.0, None, None)


def test_one_boosted_split_is_the_best_newton_step():
    """A tree of one split against trying every cut, with L1, L2 and the least weight on both sides."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, s = 400, boosting.Settings(1, 1, 0.5, min_weight=4.0, l1=0.3, l2=1.5)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = np.where(x[:, 1] > 7, 2, np.where(x[:, 1] > 3, 1, 0))
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), y)
    w = rng.random(n) + 0.5
    model = boosting.fit(x, y, w, 3, s)
    got = boosting.margins(model, x)
    p = 1 / 3
    for k in range(3):
        g, h = (p - (y == k)) * w, np.full(n, 2 * p * (1 - p)) * w
        score = lambda m: max(abs(g[m].sum()) - s.l1, 0) ** 2 / (h[m].sum() + s.l2)
        step = lambda m: -s.rate * np.sign(g[m].sum()) * max(abs(g[m].sum()) - s.l1, 0) / (h[m].sum() + s.l2)
        tried = {}
        for f in range(3):
            for cut in range(11):
                left = x[:, f] <= cut
                if h[left].sum() >= s.min_weight and h[~left].sum() >= s.min_weight:
                    tried[f, cut] = score(left) + score(~left)
        left = x[:, max(tried, key=tried.get)[0]] <= max(tried, key=tried.get)[1]
        assert got[:, k] == pytest.approx(np.where(left, step(left), step(~left)))


def test_boosting_shares_rounds_between_classes():
    """Three classes that no single binary split tells apart; margins of a class grow as the others' fall."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.random((3000, 4))
    y = (3 * ((x[:, 0] * 2) % 1)).astype(int)
    model = boosting.fit(x, y, np.ones(3000), 3, boosting.Settings(40, 5, 0.3, subsample=0.8, columns=0.75))
    fresh = rng.random((2000, 4))
    truth = (3 * ((fresh[:, 0] * 2) % 1)).astype(int)
    assert (boosting.margins(model, fresh).argmax(1) == truth).mean() > 0.95
    assert int(np.argmax(model["gain"])) == 0 and model["gain"].sum() == pytest.approx(1)
    assert len(model["size"]) == 40 * 3


def test_bounded_samples_stand_for_all(spark, samples):
    kept = boosting.bounded(samples, list(grid.FEATURES), "risk_level", 100)
    rows = kept.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.sum("stands_for").alias("all")).collect()
    whole = {r.risk_level: r["count"] for r in samples.groupBy("risk_level").count().collect()}
    assert {r.risk_level: round(r["all"]) for r in rows} == whole
    assert all(r.n == min(100, whole[r.risk_level]) for r in rows)
    again = boosting.bounded(samples.repartition(7), list(grid.FEATURES), "risk_level", 100)
    assert kept.exceptAll(again).count() == 0


def test_fits_side_by_side_equal_single_ones(spark, samples):
    import dataclasses

    small = dataclasses.replace(ml.BOOSTED, trees=5, depth=4)
    both = ml.train_boosted({"a": (samples, small), "b": (samples.where("risk_level <> 'High'"), small)})
    one = ml.train(samples.repartition(5), small)
    assert both["a"].trees["value"].tolist() == one.trees["value"].tolist()
    assert ml.predict(both["b"], samples).where("risk_level = 'High'").count() == 0


def test_a_missing_class_keeps_three_probabilities(samples):
    two = samples.where("risk_level <> 'High'")
    preds = ml.predict(ml.train(two, ml.FOREST, 0.02, 3), two)
    assert preds.where("prob_high > 0").count() == 0


def test_undefined_ratios_count_as_zero(spark):
    df = spark.createDataFrame([("Low", "Low"), ("Low", "Medium")], "actual_level string, risk_level string")
    report = {r["level"]: r for r in ml.class_report(ml.confusion(df)).collect()}
    assert report["High"]["f1"] == 0.0 and report["Low"]["precision"] == 1.0
    row = ml.evaluate(df).first()
    assert row["accuracy"] == 0.5 and row["f1_macro"] == pytest.approx((2 / 3) / 3)
    assert row["f1_weighted"] == pytest.approx(2 / 3)


def test_balanced_weights(samples):
    rows = ml.class_weights(samples).collect()
    assert all(r["weight"] * 3 * r["n"] == pytest.approx(1500) for r in rows)


@pytest.mark.parametrize("block_rows", [2000, 20])
def test_smote_fills_the_small_classes(samples, block_rows):
    grown = ml.smote(samples, block_rows=block_rows)
    before = {r["risk_level"]: r["n"] for r in ml.class_distribution(samples).collect()}
    after = {r["risk_level"]: r["n"] for r in ml.class_distribution(grown).collect()}
    largest = max(before.values())
    for level in before:
        assert after[level] == largest
    lo, hi = grown.where("risk_level = 'High'").agg(F.min("outage_count"), F.max("outage_count")).first()
    was = samples.where("risk_level = 'High'").agg(F.min("outage_count"), F.max("outage_count")).first()
    assert was[0] <= lo and hi <= was[1]


@pytest.mark.parametrize("block_rows", [2000, 15])
def test_smote_neighbours_are_the_nearest(spark, block_rows):
    """Against all pairs, whatever the block size; repeated samples and equal places included."""
    rng = random.Random(5)
    rows = [tuple(float(rng.choice([0, 0, rng.random() * 9])) for _ in grid.FEATURES) for _ in range(120)]
    rows += rows[:5] * 3
    schema = "risk_level string, x array<double>"
    points = spark.createDataFrame([("High", list(r)) for r in rows], schema).groupBy("risk_level", "x").agg(F.count("x").alias("m"))
    got = {tuple(r["x"]): [tuple(y) for y in r["near"]] for r in ml.nearest_samples(points, 3, block_rows).collect()}
    assert len(got) == len(set(rows))
    for x in set(rows):
        others = list(rows)
        others.remove(x)
        want = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), y) for y in others)[:3]
        have = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), y) for y in got[x])
        assert have == want


def test_smote_does_not_depend_on_blocks_and_repeats_an_only_sample(samples):
    few = samples.where("risk_level <> 'High'").unionByName(samples.where("risk_level = 'High'").limit(1))
    one, other = ml.smote(few), ml.smote(few.repartition(5), block_rows=25)
    assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0
    after = {r["risk_level"]: r["n"] for r in ml.class_distribution(one).collect()}
    assert after["High"] == after["Low"] and one.where("risk_level = 'High'").distinct().count() == 1


def test_thresholds_prefer_the_first_of_equals(spark):
    df = spark.createDataFrame(
        [("High", 0.4, 0.6, 0.0), ("Low", 0.1, 0.9, 0.0)],
        "actual_level string, prob_high double, prob_low double, prob_medium double",
    )
    best = ml.tune_thresholds(df).first()
    assert best["f1_macro"] == pytest.approx(2 / 3)
    # 0.4 / 0.2 and 0.6 / 0.3 tie, and High comes first
    assert (best["threshold_high"], best["threshold_low"]) == (0.2, 0.3)
    assert best["threshold_medium"] == 0.2


def test_folds_are_as_even_as_array_split(spark):
    import numpy as np

    rows = [(f"20{i // 12 + 10}-{i % 12 + 1:02d}-01",) for i in range(23)]
    df = spark.createDataFrame(rows, "d string").select(F.to_date("d").alias("cutoff_date"))
    sizes = grid.fold_edges(df).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [len(x) for x in np.array_split(np.arange(23), 5)]


def test_walk_forward_trains_on_the_past(samples):
    rounds = training.walk_forward(samples, (ml.FOREST,), scale=0.02, max_depth=4).collect()
    assert [r["fold"] for r in rounds] == [1, 2, 3, 4]
    assert all(0 < r["f1_macro"] <= 1 for r in rounds)


def test_all_ten_configurations_are_there():
    assert len({c.name for c in ml.CONFIGS}) == 10


def test_fits_share_the_cores(samples, monkeypatch):
    """A forest and a boosted fit are under way at the same time; each model meets its own fold."""
    both = threading.Barrier(2, timeout=30)
    train, train_boosted = ml.train, ml.train_boosted

    def met(fit):
        def run(*args):
            both.wait()
            return fit(*args)

        return run

    monkeypatch.setattr(training.ml, "train", met(train))
    monkeypatch.setattr(training.ml, "train_boosted", met(train_boosted))
    small = (replace(ml.FOREST, trees=2, depth=3), replace(ml.BOOSTED, trees=2, depth=3))
    rounds = training.walk_forward(samples, small, folds=2).collect()
    assert [(r["config"], r["fold"]) for r in rounds] == [(c.name, 1) for c in small]
    data = grid.with_folds(samples, 2)
    past, after = data.where("fold = 1"), data.where("fold = 2")
    model = train_boosted({"x": (past, small[1])})["x"]
    assert rounds[1]["recall_macro"] == pytest.approx(ml.evaluate(ml.predict(model, after)).first()["recall_macro"])


def _many(spark, n=600):
    """Samples with repeated rows and three levels that follow from two features."""
    rng = random.Random(7)
    rows = []
    for _ in range(n):
        x = [float(rng.randrange(9)) for _ in grid.FEATURES]
        rows.append((*x, "High" if x[0] > 5 else "Medium" if x[1] > 4 else "Low"))
    rows += [rows[0]] * 90
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in grid.FEATURES) + ", risk_level string")


def test_fits_over_shards_equal_fits_in_one_task(spark, monkeypatch):
    """Draws of samples and of features, classes with weights and a frame of one class included."""
    rows = _many(spark)
    small = replace(ml.BOOSTED, trees=4, depth=4, min_gain=0.05)
    fits = {"all": (rows, small), "one": (rows.where("risk_level = 'Low'"), replace(small, trees=1, subsample=1.0))}
    whole = ml.train_boosted(fits)
    monkeypatch.setattr(boosting, "SHARD_ROWS", 250)
    monkeypatch.setattr(boosting, "SAVE_ROUNDS", 2)
    monkeypatch.setattr(boosting, "NODES", 3)
    dealt = ml.train_boosted({k: (df.repartition(5), config) for k, (df, config) in fits.items()})
    for name in fits:
        for part in ("feature", "split", "left", "value", "size", "gain"):
            assert dealt[name].trees[part].tolist() == whole[name].trees[part].tolist()
    assert len(whole["all"].trees["value"]) > 50


def test_fits_see_all_samples(spark, monkeypatch):
    """Samples beyond the first 8,000 of a class decide: they alone tell the levels apart."""
    import numpy as np

    n = 24_000
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    levels = F.when(x > 0.5, "High").otherwise("Low")
    rows = spark.range(n).select(*[(x if f == "max_duration" else F.lit(0.0)).alias(f) for f in grid.FEATURES], levels.alias("risk_level"))
    seen = spark.sparkContext.accumulator(0)
    fit = boosting.fit

    def counted(x, *rest):
        seen.add(len(x))
        return fit(x, *rest)

    monkeypatch.setattr(boosting, "fit", counted)
    config = replace(ml.BOOSTED, trees=2, depth=2)
    model = ml.train_boosted({"": (rows, config)})[""]
    assert seen.value == n and np.isfinite(model.trees["value"]).all()


def test_walk_forward_fits_all_of_the_past(spark, samples, monkeypatch):
    """Neither forests nor boosted fits nor oversampled ones get a bounded part of the past."""
    given = []
    train, train_boosted = ml.train, ml.train_boosted

    def forest(rows, config, scale, max_depth, bound=None):
        given.append((config.name, rows.count(), bound))
        return train(rows, config, scale, max_depth, bound)

    def boosted(fits, *rest):
        given.extend((config.name, rows.count(), None) for rows, config in fits.values())
        return train_boosted(fits, *rest)

    monkeypatch.setattr(training.ml, "train", forest)
    monkeypatch.setattr(training.ml, "train_boosted", boosted)
    monkeypatch.setattr(boosting, "bounded", None)
    small = [replace(c, trees=2, depth=3) for c in (ml.FOREST, ml.BOOSTED, ml.CONFIGS[7])]
    training.walk_forward(samples, small, folds=2).collect()
    past = grid.with_folds(samples, 2).where("fold = 1")
    counts = [r["n"] for r in ml.class_distribution(past).collect()]
    wanted = {small[0].name: sum(counts), small[1].name: sum(counts), small[2].name: max(counts) * len(counts)}
    assert {(n, k) for n, k, _ in given} == set(wanted.items()) and not any(bound for *_, bound in given)
