"""Queries over risk predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.coerce import correlation, percent
from gridspark.operators.filters import by_name, visible_risk_cells
from gridspark.operators.ranking import top_k
from gridspark.operators.spatial import (
    nearest_join,
    nearest_to_point,
    radius_join,
    within_radius,
)

PROBABILITIES = ("prob_high", "prob_medium", "prob_low")


def with_districts(cells: DataFrame, outages: DataFrame) -> DataFrame:
    """Every cell with the district of its nearest outage."""
    known = outages.where(F.col("district_name").isNotNull()).select(
        "row_id",
        "district_name",
        F.col("latitude").alias("_olat"),
        F.col("longitude").alias("_olon"),
    )
    tagged = nearest_join(
        cells, known, ("lat", "lon"), ("_olat", "_olon"), ["row_id"], distance="_d"
    )
    return tagged.drop("row_id", "_olat", "_olon", "_d")


def merge_models(stacked: DataFrame, keys: list[str] = ("lat", "lon")) -> DataFrame:
    """One row per cell: the first model's level, mean confidence and probabilities.

    Level and averaged probabilities may disagree; that is how the figures are defined.
    """
    extra = ["district_name"] if "district_name" in stacked.columns else []
    return stacked.groupBy(*keys).agg(
        F.min_by("risk_level", "model_order").alias("risk_level"),
        F.avg("confidence").alias("confidence"),
        *[F.avg(p).alias(p) for p in PROBABILITIES],
        *[F.min_by(c, "model_order").alias(c) for c in extra],
    )


def risk_at_point(merged: DataFrame, lat: float, lon: float, top: int = 10):
    """``(results, summary)``: the nearest cells to a point."""
    results = nearest_to_point(merged, lat, lon, top, ["lat", "lon"], at=("lat", "lon"))
    nearest = F.struct(F.round("distance_km", 9), "lat", "lon")
    summary = results.agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.min_by("risk_level", nearest).alias("nearest_risk_level"),
        F.min("distance_km").alias("nearest_distance_km"),
    )
    return results, summary


def district_risk_summary(merged: DataFrame, district: str) -> DataFrame:
    """Cells, High cells, mean confidence and share of High cells of one district."""
    total = F.count(F.lit(1))
    high = F.count_if(F.col("risk_level") == "High")
    return by_name(merged, district).agg(
        total.alias("total_cells"),
        high.alias("high_risk_cells"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(percent(high, total), F.lit(0.0)).alias("high_risk_pct"),
    )


def risk_in_district(merged: DataFrame, district: str, top: int = 10):
    """``(results, summary)`` for one district, cells in order of position."""
    cells = by_name(merged, district)
    results = top_k(cells, [F.col("lat"), F.col("lon")], top)
    return results, district_risk_summary(merged, district)


def _argmax(high: Column, medium: Column, low: Column) -> Column:
    """The most probable level; High before Medium before Low when equal."""
    return (
        F.when((high >= medium) & (high >= low), "High")
        .when(medium >= low, "Medium")
        .otherwise("Low")
    )


def _blend(pairs: DataFrame, keys: list[str]) -> DataFrame:
    weight = F.lit(1.0) / (F.col("_d") + 0.001)
    sums = pairs.groupBy(*keys).agg(
        F.sum(weight).alias("_w"), *[F.sum(F.col(p) * weight).alias(p) for p in PROBABILITIES]
    )
    mixed = sums.withColumns({p: F.col(p) / F.col("_w") for p in PROBABILITIES}).drop("_w")
    high, medium, low = (F.col(p) for p in PROBABILITIES)
    return mixed.withColumns(
        {"risk_level": _argmax(high, medium, low), "confidence": F.greatest(high, medium, low)}
    )


def interpolated_risk(
    points: DataFrame, cells: DataFrame, key: str, radius: float = 5.0,
    at: tuple[str, str] = ("latitude", "longitude"),
) -> DataFrame:
    """Class probabilities at points, weighted by inverse distance to the cells in reach.

    Points with no cell in reach are absent.
    """
    places = points.select(key, *at)
    values = cells.select("lat", "lon", *PROBABILITIES)
    pairs = radius_join(places, values, radius, at, ("lat", "lon"), distance="_d")
    return _blend(pairs, [key])


def interpolated_risk_at(cells: DataFrame, lat: float, lon: float, radius: float = 5.0):
    """The same for one point: one row, or none without a cell in reach."""
    near = within_radius(cells, lat, lon, radius, at=("lat", "lon"), distance="_d")
    return _blend(near.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")


def model_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """How two models agree on their common cells (joined on the integer cell index)."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            "ci", "cj", F.col("risk_level").alias(f"{p}_level"), F.col("confidence").alias(f"{p}_c")
        )

    both = side(first, "a").join(side(second, "b"), ["ci", "cj"])
    n = F.count(F.lit(1))
    same = F.count_if(F.col("a_level") == F.col("b_level"))
    stats = []
    for p in ("a", "b"):
        c = F.col(f"{p}_c")
        stats += [
            F.avg(c).alias(f"{p}_mean_confidence"),
            F.stddev_samp(c).alias(f"{p}_std_confidence"),
            F.min(c).alias(f"{p}_min_confidence"),
            percent(F.count_if(c < 0.5), n).alias(f"{p}_below_half_pct"),
        ]
    return both.agg(
        n.alias("common_cells"),
        same.alias("same_level"),
        percent(same, n).alias("agreement_pct"),
        correlation(F.col("a_c"), F.col("b_c")).alias("confidence_corr"),
        *stats,
    )


def level_shares(stacked: DataFrame) -> DataFrame:
    """Cells per model and level, with the share within the model."""
    counts = stacked.groupBy("model", "risk_level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("model").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "model").withColumn("pct", percent(F.col("n"), F.col("_t"))).drop("_t")


def risk_layer(cells: DataFrame, min_confidence: float = 0.95) -> DataFrame:
    """Drawable cells: bounds, colour from green over yellow to red, opacity."""
    ph, pm = F.col("prob_high"), F.col("prob_medium")
    red = F.least(F.lit(255.0), ph * 255 + pm * 200).cast("int")
    green = F.least(F.lit(255.0), (1 - ph) * 200 + pm * 100).cast("int")
    blue = F.greatest(F.lit(0.0), (1 - ph - pm) * 150).cast("int")
    return visible_risk_cells(cells, min_confidence).select(
        "lat",
        "lon",
        (F.col("lat") - 0.01).alias("south"),
        (F.col("lat") + 0.01).alias("north"),
        (F.col("lon") - 0.01).alias("west"),
        (F.col("lon") + 0.01).alias("east"),
        F.format_string("#%02x%02x%02x", red, green, blue).alias("color"),
        F.least(F.lit(0.8), 0.4 + 0.4 * ph + 0.15 * pm).alias("opacity"),
        "risk_level",
        "confidence",
    )
