"""Grid features and training samples (F), models (G), feature correlation (E32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import grid, ml, profile, risk_query
from gridspark.plans import training
from gridspark.registry.base import Domain, hav, piece, query, rounded, text_times, with_
from gridspark.session import materialize, scratch_dir

START_YEAR = 1995

piece(
    "model_rows",
    "outages",
    """SELECT *, CAST(round_even(latitude / 0.02, 0) AS BIGINT) AS ci, CAST(round_even(longitude / 0.02, 0) AS BIGINT) AS cj,
  least(COALESCE(duration_hours, 0), 168) AS h, COALESCE(total_customer_minutes_lost, 0) AS minutes,
  CASE WHEN month(incident_date_time) IN (12, 1, 2) THEN 1.0 ELSE 0.0 END AS is_winter,
  CASE WHEN hour(incident_date_time) >= 22 OR hour(incident_date_time) < 6 THEN 1.0 ELSE 0.0 END AS is_night,
  CASE WHEN is_exceptional_event THEN 1.0 ELSE 0.0 END AS is_exc
FROM outages""",
)

_AGGS = """count(*) AS outage_count, avg(h) AS avg_duration, COALESCE(stddev_samp(h), 0) AS std_duration,
  sum(minutes) / 60.0 AS total_customer_hours, max(h) AS max_duration, ln(1 + avg(h)) AS log_avg_duration,
  ln(1 + sum(minutes) / 60.0) AS log_total_customer_hours, avg(is_winter) AS winter_ratio,
  avg(is_night) AS night_ratio, avg(is_exc) AS exceptional_ratio,
  count(DISTINCT direct_cause_category) AS cause_diversity"""


def _features(name: str, rows: str, keys: str) -> None:
    """Pieces for features per key columns (or none) over a table of model rows."""
    k = f"{keys}, " if keys else ""
    on = f"a.{keys} = b.{keys} AND " if keys else ""
    piece(
        f"{name}_base",
        rows,
        f"SELECT {k}ci, cj, {_AGGS} FROM {rows} WHERE ci IS NOT NULL GROUP BY {k}ci, cj",
    )
    piece(
        f"{name}_subs",
        rows,
        f"""SELECT {k}primary_substation, avg(latitude) AS slat, avg(longitude) AS slon FROM {rows}
WHERE primary_substation IS NOT NULL AND latitude IS NOT NULL GROUP BY ALL""",
    )
    piece(
        f"{name}_near",
        f"{name}_base {name}_subs",
        f"""SELECT {f"a.{keys}, " if keys else ""}a.ci, a.cj,
  min({hav("a.ci / 50.0", "a.cj / 50.0", "b.slat", "b.slon")}) AS km
FROM {name}_base a JOIN {name}_subs b ON {on}TRUE GROUP BY ALL""",
    )
    piece(
        f"{name}_around",
        f"{name}_base",
        f"""SELECT {f"a.{keys}, " if keys else ""}a.ci, a.cj, sum(b.outage_count) AS s
FROM {name}_base a JOIN {name}_base b ON {on}abs(a.ci - b.ci) <= 1 AND abs(a.cj - b.cj) <= 1
  AND NOT (a.ci = b.ci AND a.cj = b.cj) GROUP BY ALL""",
    )
    using = f"({k}ci, cj)"
    piece(
        name,
        f"{name}_base {name}_near {name}_around",
        f"""SELECT f.*, ci / CAST(50 AS DOUBLE) AS lat, cj / CAST(50 AS DOUBLE) AS lon,
  COALESCE(km, 0) AS nearest_substation_km, CAST(COALESCE(s, 0) AS BIGINT) AS neighbor_outage_count
FROM {name}_base f LEFT JOIN {name}_near USING {using} LEFT JOIN {name}_around USING {using}""",
    )


_features("feats", "model_rows", "")
piece(
    "model_rows_97",
    "model_rows",
    """SELECT * FROM model_rows WHERE incident_date_time >= TIMESTAMP '1997-01-01'
  AND incident_date_time < TIMESTAMP '1998-01-01'""",
)
_features("feats_97", "model_rows_97", "")

_COUNTS = ("outage_count", "cause_diversity", "neighbor_outage_count")


def _digits(c: str) -> int:
    """Deviations and distances come from sums in any order: fewer digits are comparable."""
    return {"std_duration": 4, "nearest_substation_km": 5}.get(c, 7)


def _cols() -> str:
    return ", ".join(
        c if c in _COUNTS else f"round({c}, {_digits(c)}) AS {c}" for c in grid.FEATURES
    )


def _shown(df, *extra):
    features = [
        F.col(c) if c in _COUNTS else (F.round(c, _digits(c)) + F.lit(0.0)).alias(c)
        for c in grid.FEATURES
    ]
    return df.select("ci", "cj", *extra, *features)


@query("f1_cells", with_("cells", "SELECT ci, cj, n FROM cells"))
def f1(d: Domain):
    from gridspark.fixtures import cells

    return cells(d.raw)


@query(
    "f2_window",
    with_(
        "outages",
        """SELECT incident_reference_number FROM outages
WHERE incident_date_time >= TIMESTAMP '1997-01-01' AND incident_date_time < TIMESTAMP '1997-04-01'""",
    ),
)
def f2(d: Domain):
    return grid.in_window(d.outages, "1997-01-01", "1997-04-01").select(
        "incident_reference_number"
    )


@query(
    "f3_model_rows",
    with_(
        "model_rows",
        """SELECT ci, cj, round(h, 6) AS hours, CAST(minutes AS DOUBLE) AS minutes, is_winter = 1 AS is_winter,
  is_night = 1 AS is_night, is_exc = 1 AS is_exceptional FROM model_rows""",
    ),
)
def f3(d: Domain):
    rows = grid.model_rows(d.outages)
    return rounded(
        rows.select("ci", "cj", "hours", "minutes", "is_winter", "is_night", "is_exceptional")
    )


@query("f4_grid_features", with_("feats", f"SELECT ci, cj, {_cols()} FROM feats"))
def f4(d: Domain):
    """All cell features: aggregates, nearest substation (F5) and neighbours (F6)."""
    return _shown(grid.grid_features(d.outages))


@query(
    "f5_nearest_substation",
    with_("feats", "SELECT ci, cj, round(nearest_substation_km, 5) AS nearest_substation_km FROM feats"),
)
def f5(d: Domain):
    found = grid.grid_features(d.outages)
    return rounded(found.select("ci", "cj", "nearest_substation_km"), 5)


@query(
    "f6_neighbour_counts",
    with_(
        "cells",
        """SELECT a.ci, a.cj, CAST(sum(b.n) AS BIGINT) AS neighbor_outage_count FROM cells a JOIN cells b
  ON abs(a.ci - b.ci) <= 1 AND abs(a.cj - b.cj) <= 1 AND NOT (a.ci = b.ci AND a.cj = b.cj) GROUP BY 1, 2""",
    ),
)
def f6(d: Domain):
    counts = d.cells.select("ci", "cj", "n")
    return grid.neighbour_counts(counts).join(counts.select("ci", "cj"), ["ci", "cj"])


@query(
    "f7_completed_grid",
    with_(
        "feats_97 cells",
        "SELECT c.ci, c.cj, "
        + ", ".join(
            f"COALESCE({c}, 0) AS {c}"
            if c in _COUNTS
            else f"round(COALESCE({c}, 0), {_digits(c)}) AS {c}"
            for c in grid.FEATURES
        )
        + " FROM cells c LEFT JOIN feats_97 f USING (ci, cj)",
    ),
)
def f7(d: Domain):
    """One year's features on the fixed grid of all years."""
    whole = grid.grid_cells(d.outages)
    return _shown(grid.grid_features(d.outages, "1997-01-01", "1998-01-01", whole))


_LABEL = """CASE WHEN {n} > {q} THEN 'High' WHEN {n} > 0 THEN 'Medium' ELSE 'Low' END"""


@query(
    "f8_labels",
    with_(
        "feats",
        f"""SELECT ci, cj, outage_count, {_LABEL.format(n="outage_count", q="q")} AS risk_level,
  CAST(CASE WHEN outage_count > q THEN 2 ELSE 1 END AS INTEGER) AS risk_rank
FROM feats, (SELECT quantile_cont(outage_count, 0.67) AS q FROM feats WHERE outage_count > 0) t""",
    ),
)
def f8(d: Domain):
    counts = d.cells.select("ci", "cj", F.col("n").alias("outage_count"))
    return grid.label_by_count(counts)


piece(
    "cutoffs",
    "outages",
    f"""SELECT CAST(c AS TIMESTAMP) AS c FROM (SELECT unnest(generate_series(TIMESTAMP '{START_YEAR + 1}-01-01',
  (SELECT max(incident_date_time) - INTERVAL 3 MONTH FROM outages), INTERVAL 1 MONTH)) AS c) t""",
)
piece(
    "windowed",
    "cutoffs model_rows",
    """SELECT c, model_rows.* FROM cutoffs JOIN model_rows
  ON incident_date_time >= c - INTERVAL 12 MONTH AND incident_date_time < c""",
)
_features("feats_c", "windowed", "c")
piece(
    "future",
    "cutoffs model_rows",
    """SELECT c, ci, cj, count(*) AS fn FROM cutoffs JOIN model_rows
  ON incident_date_time >= c AND incident_date_time < c + INTERVAL 3 MONTH
WHERE ci IS NOT NULL GROUP BY 1, 2, 3""",
)
piece("future_q", "future", "SELECT c, quantile_cont(fn, 0.67) AS q FROM future GROUP BY 1")
piece(
    "samples",
    "feats_c future future_q",
    f"""SELECT f.*, strftime(f.c, '%Y-%m-%d') AS cutoff_date, CAST(COALESCE(fn, 0) AS BIGINT) AS future_outage_count,
  {_LABEL.format(n="COALESCE(fn, 0)", q="COALESCE(q, 0)")} AS risk_level
FROM feats_c f LEFT JOIN future u ON f.c = u.c AND f.ci = u.ci AND f.cj = u.cj
LEFT JOIN future_q x ON f.c = x.c""",
)


def _samples(d: Domain):
    return grid.training_samples(d.outages, start_year=START_YEAR)


@query(
    "f9_training_samples",
    with_(
        "samples",
        f"SELECT cutoff_date, ci, cj, {_cols()}, future_outage_count, risk_level FROM samples",
    ),
)
def f9(d: Domain):
    return text_times(_shown(_samples(d), "cutoff_date", "future_outage_count", "risk_level"))


@query(
    "f10_cells_with_data",
    with_("feats_97", "SELECT ci, cj, outage_count FROM feats_97"),
)
def f10(d: Domain):
    whole = grid.grid_cells(d.outages)
    full = grid.grid_features(d.outages, "1997-01-01", "1998-01-01", whole)
    return grid.cells_with_data(full).select("ci", "cj", "outage_count")


@query(
    "f11_folds",
    with_(
        "feats_c_base",
        """SELECT strftime(c, '%Y-%m-%d') AS cutoff_date, CAST(fold AS INTEGER) AS fold,
  strftime(max(c) OVER (PARTITION BY fold), '%Y-%m-%d') AS fold_edge
FROM (SELECT c, ntile(5) OVER (ORDER BY c) AS fold FROM (SELECT DISTINCT c FROM feats_c_base) t) u""",
    ),
)
def f11(d: Domain):
    return text_times(grid.fold_edges(_samples(d)))


@query(
    "e32_feature_correlations",
    with_(
        "feats",
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS corr FROM feats"
            for i, a in enumerate(grid.FEATURES)
            for b in grid.FEATURES[i + 1 :]
        ),
    ),
)
def e32(d: Domain):
    features = grid.grid_features(d.outages)
    return rounded(profile.correlation_pairs(features, grid.FEATURES), 4)


@query(
    "e32_strongest_correlations",
    with_(
        "feats",
        "SELECT * FROM ("
        + "\nUNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS corr FROM feats"
            for i, a in enumerate(grid.FEATURES)
            for b in grid.FEATURES[i + 1 :]
        )
        + ") t ORDER BY abs(corr) DESC LIMIT 5",
    ),
)
def e32b(d: Domain):
    pairs = profile.correlations(grid.grid_features(d.outages), grid.FEATURES)
    return rounded(profile.strongest_correlations(pairs), 4)


# --- G: models ---------------------------------------------------------------------------------
# All fits have their full number of trees and depth but for G8's forests, which take hours.

_G8_FOREST_SCALE = 0.01


def _stored_samples(d: Domain):
    return materialize(_samples(d), "samples")


@query(
    "g1_class_weights",
    with_(
        "samples",
        """SELECT risk_level, n, round(t / CAST(k * n AS DOUBLE), 6) AS weight FROM
  (SELECT risk_level, count(*) AS n FROM samples GROUP BY 1) a,
  (SELECT count(*) AS t, count(DISTINCT risk_level) AS k FROM samples) b""",
    ),
)
def g1(d: Domain):
    return rounded(ml.class_weights(_samples(d)))


def _trained(d: Domain, config):
    features = materialize(grid.cells_with_data(grid.grid_features(d.outages)), "features")
    samples = _stored_samples(d)
    return ml.train(samples, config), features, samples


_CHANCE = 1.0 / len(grid.RISK_LEVELS)  # mean recall of a model that always names one level


def _checked(preds, on_samples):
    """Per cell: the level is the most probable one, the probabilities add up to one.

    ``learned``: over all samples the mean recall beats that of any constant answer by 0.05.
    """
    probs = [F.col(f"prob_{v.lower()}") for v in grid.RISK_LEVELS]
    best = F.greatest(*probs)
    by_level = F.element_at(F.array(*probs), F.array_position(
        F.array(*[F.lit(v) for v in grid.RISK_LEVELS]), F.col("risk_level")).cast("int"))
    total = probs[0] + probs[1] + probs[2]
    good = (F.col("confidence") == best) & (by_level == best) & (F.abs(total - 1.0) < 1e-9)
    learned = ml.evaluate(on_samples).select(F.col("recall_macro") > _CHANCE + 0.05).scalar()
    return preds.select("ci", "cj", good.alias("consistent"), learned.alias("learned"))


_ALL_CELLS = with_("cells", "SELECT ci, cj, TRUE AS consistent, TRUE AS learned FROM cells")


@query("g2_forest_predictions", _ALL_CELLS)
def g2(d: Domain):
    model, features, samples = _trained(d, ml.FOREST)
    return _checked(ml.predict(model, features), ml.predict(model, samples))


@query("g3_boosted_predictions", _ALL_CELLS)
def g3(d: Domain):
    model, features, samples = _trained(d, ml.BOOSTED)
    return _checked(ml.predict(model, features), ml.predict(model, samples))


piece(
    "as_predictions",
    "preds stacked",
    """SELECT p.ci, p.cj, CASE WHEN p.n > 5 THEN 'High' WHEN p.n > 2 THEN 'Medium' ELSE 'Low' END AS actual_level,
  p.risk_level, p.prob_high, p.prob_medium, p.prob_low FROM preds p""",
)


def _as_predictions(d: Domain):
    """The stand-in predictions with an actual level by count, for the evaluation operators."""
    n = F.col("n")
    actual = F.when(n > 5, "High").when(n > 2, "Medium").otherwise("Low")
    return d.cells.withColumn("actual_level", actual)


@query("g4_prediction_fields", with_("cells", "SELECT ci, cj, TRUE AS consistent, TRUE AS learned, 3 AS fields FROM cells"))
def g4(d: Domain):
    """What ``predict`` returns for every cell, of a model fitted on labels by count."""
    features = materialize(grid.label_by_count(grid.grid_features(d.outages)), "features")
    model = ml.train(features, ml.Config("small", "boosted", 20, 4, rate=0.3, balanced=True))
    preds = ml.predict(model, features)
    fields = sum(F.col(f"prob_{v.lower()}").isNotNull().cast("int") for v in grid.RISK_LEVELS)
    return _checked(preds, preds).join(preds.select("ci", "cj", fields.alias("fields")), ["ci", "cj"])


piece(
    "class_scores",
    "as_predictions",
    """SELECT level, hit, support, predicted, COALESCE(hit / nullif(predicted, 0), 0) AS precision,
  COALESCE(hit / nullif(support, 0), 0) AS recall,
  COALESCE(2.0 * hit / nullif(support + predicted, 0), 0) AS f1
FROM (SELECT level, count(CASE WHEN actual_level = level AND risk_level = level THEN 1 END) AS hit,
    count(CASE WHEN actual_level = level THEN 1 END) AS support,
    count(CASE WHEN risk_level = level THEN 1 END) AS predicted
  FROM as_predictions CROSS JOIN (VALUES ('Low'), ('Medium'), ('High')) v(level) GROUP BY level) t""",
)


@query(
    "g5_class_report",
    with_(
        "class_scores",
        """SELECT level, hit, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM class_scores""",
    ),
)
def g5(d: Domain):
    return rounded(ml.class_report(ml.confusion(_as_predictions(d))))


@query(
    "g5_metrics",
    with_(
        "class_scores",
        """SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(precision), 6) AS precision_macro,
  round(avg(recall), 6) AS recall_macro FROM class_scores""",
    ),
)
def g5m(d: Domain):
    return rounded(ml.evaluate(_as_predictions(d)))


@query(
    "g5_confusion",
    with_(
        "as_predictions",
        "SELECT actual_level, risk_level, count(*) AS n FROM as_predictions GROUP BY 1, 2",
    ),
)
def g5c(d: Domain):
    return ml.confusion(_as_predictions(d))


@query(
    "g6_feature_importance",
    "\nUNION ALL ".join(f"SELECT '{f}' AS feature, TRUE AS in_range, TRUE AS sums_to_one, TRUE AS label_first" for f in grid.FEATURES),
)
def g6(d: Domain):
    """The labels are cut from the outage count, so that feature must lead."""
    features = materialize(grid.label_by_count(grid.grid_features(d.outages)), "features")
    model = ml.train(features, ml.FOREST)
    table = ml.feature_importance(d.spark, model)
    whole = table.agg(F.abs(F.sum("importance") - 1.0) < 1e-6).scalar()
    first = table.agg(F.max_by("feature", "importance") == "outage_count").scalar()
    return table.select(
        "feature", F.col("importance").between(0.0, 1.0).alias("in_range"), whole.alias("sums_to_one"),
        first.alias("label_first"),
    )


def _good_rounds(rounds, margin=0.003):
    """Per round: metrics lie in 0..1; over all rounds the mean recall on unseen folds beats a constant answer's."""
    good = F.lit(True)
    for m in training.METRICS:
        good = good & F.col(m).between(0.0, 1.0)
    mean = rounds.groupBy(F.col("config").alias("_config")).agg(F.avg("recall_macro").alias("_recall"))
    both = rounds.join(mean, F.col("config") == F.col("_config"))
    return both.select("config", "fold", good.alias("in_range"), (F.col("_recall") > _CHANCE + margin).alias("learned"))


@query(
    "g7_walk_forward",
    "SELECT config, fold, TRUE AS in_range, TRUE AS learned FROM (VALUES "
    + ", ".join(f"('{c.name}')" for c in (ml.FOREST, ml.BOOSTED))
    + ") a(config) CROSS JOIN (VALUES (1), (2), (3), (4)) b(fold)",
)
def g7(d: Domain):
    """Both production models over the chronological rounds."""
    return _good_rounds(training.walk_forward(_samples(d)))


@query(
    "g7_final_models",
    with_(
        "cells",
        "SELECT ci, cj, model, TRUE AS consistent, TRUE AS learned FROM cells CROSS JOIN (VALUES "
        + ", ".join(f"('{c.name}')" for c in (ml.FOREST, ml.BOOSTED))
        + ") t(model)",
    ),
)
def g7f(d: Domain):
    path, samples = scratch_dir(d.spark, "models"), _stored_samples(d)
    preds = training.final_models(d.outages, samples, path)
    out = None
    for config in (ml.FOREST, ml.BOOSTED):
        mine = preds.where(F.col("model") == config.name)
        checked = _checked(mine, ml.predict(ml.load_model(f"{path}/{config.kind}"), samples))
        part = checked.withColumn("model", F.lit(config.name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "g8_compare_configurations",
    "SELECT config, 4 AS folds, TRUE AS in_range, TRUE AS learned FROM (VALUES "
    + ", ".join(f"('{c.name}')" for c in ml.CONFIGS) + ") t(config)",
)
def g8(d: Domain):
    """All ten configurations over the chronological rounds; forests have a hundredth of their trees, depth 12 at most."""
    rounds = training.walk_forward(_samples(d), ml.CONFIGS, max_depth=12, forest_scale=_G8_FOREST_SCALE)
    ranked = training.compare(rounds).select("config")
    # without class weights little is gained on labels this rare
    found = _good_rounds(rounds, 0.001).groupBy("config").agg(
        F.count(F.lit(1)).cast("int").alias("folds"), F.every("in_range").alias("in_range"), F.every("learned").alias("learned")
    )
    return ranked.join(found, "config")


@query(
    "g9_smote",
    with_(
        "samples",
        "SELECT risk_level, count(*) AS originals, TRUE AS filled FROM samples GROUP BY 1",
    ),
)
def g9(d: Domain):
    """Every class reaches the largest one exactly."""
    samples = _stored_samples(d)
    before = ml.class_distribution(samples).select("risk_level", F.col("n").alias("originals"))
    after = ml.class_distribution(ml.smote(samples)).select("risk_level", "n")
    filled = F.col("n") == before.agg(F.max("originals")).scalar()
    return before.join(after, "risk_level").select("risk_level", "originals", filled.alias("filled"))


_PICK = """CASE WHEN prob_high / th >= prob_low / tl AND prob_high / th >= prob_medium / tm THEN 'High'
  WHEN prob_low / tl >= prob_medium / tm THEN 'Low' ELSE 'Medium' END"""
_T = "(VALUES (0, 0.2), (1, 0.3), (2, 0.4), (3, 0.5))"


@query(
    "g10_threshold_tuning",
    with_(
        "as_predictions",
        f"""SELECT CAST(combo AS INTEGER) AS combo, threshold_high, threshold_low, threshold_medium,
  round(avg(COALESCE(2.0 * hit / nullif(support + predicted, 0), 0)), 6) AS f1_macro FROM (
  SELECT combo, th AS threshold_high, tl AS threshold_low, tm AS threshold_medium, level,
    count(CASE WHEN actual_level = level AND pick = level THEN 1 END) AS hit,
    count(CASE WHEN actual_level = level THEN 1 END) AS support, count(CASE WHEN pick = level THEN 1 END) AS predicted
  FROM (SELECT *, {_PICK} AS pick FROM as_predictions, (SELECT a.i * 16 + b.i * 4 + c.i AS combo,
      CAST(a.t AS DOUBLE) AS th, CAST(b.t AS DOUBLE) AS tl, CAST(c.t AS DOUBLE) AS tm
      FROM {_T} a(i, t), {_T} b(i, t), {_T} c(i, t)) o) x
  CROSS JOIN (VALUES ('Low'), ('Medium'), ('High')) v(level) GROUP BY ALL) y GROUP BY 1, 2, 3, 4""",
    ),
)
def g10(d: Domain):
    tuned = ml.tune_thresholds(_as_predictions(d))
    return rounded(
        tuned.select("combo", "threshold_high", "threshold_low", "threshold_medium", "f1_macro")
    )


@query(
    "g11_class_distribution",
    with_(
        "samples",
        """SELECT risk_level, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM samples), 6) AS pct
FROM samples GROUP BY 1""",
    ),
)
def g11(d: Domain):
    return rounded(ml.class_distribution(_samples(d)))


def _agreement(p: str) -> str:
    c = f"{p}.confidence"
    return f"""round(avg({c}), 6) AS {p}_mean_confidence, round(stddev_samp({c}), 6) AS {p}_std_confidence,
  round(min({c}), 6) AS {p}_min_confidence,
  round(100.0 * count(CASE WHEN {c} < 0.5 THEN 1 END) / count(*), 6) AS {p}_below_half_pct"""


@query(
    "g12_model_agreement",
    with_(
        "preds preds2",
        f"""SELECT count(*) AS common_cells, count(CASE WHEN a.risk_level = b.risk_level THEN 1 END) AS same_level,
  round(100.0 * count(CASE WHEN a.risk_level = b.risk_level THEN 1 END) / count(*), 6) AS agreement_pct,
  round(corr(a.confidence, b.confidence), 6) AS confidence_corr, {_agreement("a")}, {_agreement("b")}
FROM preds a JOIN preds2 b ON a.ci = b.ci AND a.cj = b.cj""",
    ),
)
def g12(d: Domain):
    return rounded(risk_query.model_agreement(d.cells, d.cells2))


@query(
    "g12_level_shares",
    with_(
        "stacked",
        """SELECT model, risk_level, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model), 6) AS pct FROM stacked GROUP BY 1, 2""",
    ),
)
def g12b(d: Domain):
    return rounded(risk_query.level_shares(d.stacked))
