"""Outages around sites: counts, summaries, scores, rule-based levels.

Everything here starts from one radius aggregation, so the outage rows are read and combined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions import geo, outage as out
from gridspark.functions.coerce import ratio, to_double
from gridspark.operators.cleaning import SITE_CATEGORIES, V2X
from gridspark.operators.ranking import top_k
from gridspark.operators.spatial import (
    LATLON,
    attach_by_position,
    located,
    radius_aggregate,
    radius_join,
)


def _hours() -> Column:
    return to_double(F.col("duration_hours"))


def site_stats(
    sites: DataFrame,
    outages: DataFrame,
    radius: float = geo.TWO_MILES_KM,
    metric: str = "haversine",
) -> DataFrame:
    """Every site with count, duration and impact sums of the outages within ``radius``.

    The duration moments (`n`, sum, sum of squares) are enough for mean and both deviations.
    """
    hours = _hours()
    winter = F.col("month_name").isin(*out.WINTER_MONTH_NAMES).cast("bigint")
    measures = {
        "outages": ("count", F.lit(1)),
        "_n": ("count", hours),
        "_s": ("sum", hours),
        "_ss": ("sum", hours * hours),
        "_minutes": ("sum", F.col("total_customer_minutes_lost")),
        "_winter": ("sum", winter),
        "latest_outage": ("max", F.col("incident_date_time")),
    }
    stats = radius_aggregate(sites, outages, radius, measures, metric=metric)
    joined = attach_by_position(sites, stats)
    n, s, ss = F.col("_n"), F.col("_s"), F.col("_ss")
    spread = F.greatest(F.lit(0.0), ss - ratio(s * s, n))
    return joined.withColumns(
        {
            "outages": F.coalesce("outages", F.lit(0)).cast("bigint"),
            "avg_duration": ratio(s, n),
            "customer_hours": F.coalesce(F.col("_minutes") / 60.0, F.lit(0.0)),
            "hours": F.coalesce(s, F.lit(0.0)),
            "std_pop": F.sqrt(ratio(spread, n)),
            "std_samp": F.sqrt(ratio(spread, F.when(n > 1, n - 1))),
            "winter_outages": F.coalesce("_winter", F.lit(0)).cast("bigint"),
        }
    ).drop("_n", "_s", "_ss", "_minutes", "_winter")


def count_outages_near_sites(
    sites: DataFrame, outages: DataFrame, radius: float = geo.TWO_MILES_EXACT_KM
) -> DataFrame:
    """Number of outages within ``radius`` of every site, sites without any included."""
    n = {"outages_within_radius": ("count", F.lit(1))}
    counts = radius_aggregate(sites, outages, radius, n)
    return attach_by_position(sites, counts).withColumn(
        "outages_within_radius",
        F.coalesce("outages_within_radius", F.lit(0)).cast("bigint"),
    )


def busiest_sites(counts: DataFrame, top: int = 0) -> DataFrame:
    """Sites by falling count; all of them when ``top`` is 0."""
    order = [F.col("outages_within_radius").desc(), F.col("charge_point_location")]
    return top_k(counts, order, top) if top else counts.orderBy(*order)


def near_sites_summary(counts: DataFrame, radius: float = geo.TWO_MILES_EXACT_KM) -> DataFrame:
    n = F.col("outages_within_radius")
    total, with_any = F.count(F.lit(1)), F.count_if(n > 0)
    return counts.agg(
        total.alias("total_sites"),
        with_any.alias("sites_with_outages"),
        (total - with_any).alias("sites_without_outages"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_outages_near_sites"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_outages_per_site"),
        F.lit(round(radius, 3)).alias("radius_km"),
        F.lit(round(radius / 1.609344, 2)).alias("radius_miles"),
    )


def outages_at_site(sites: DataFrame, outages: DataFrame, name: str, radius=geo.TWO_MILES_KM):
    """The outage rows around one named site."""
    place = sites.where(F.col("charge_point_location") == name).select(
        F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon")
    )
    near = radius_join(place.limit(1), outages, radius, ("_slat", "_slon"), LATLON)
    return near.drop("_slat", "_slon")


def site_summary(stats: DataFrame) -> DataFrame:
    """Count, mean duration, customer hours and a three-step label per site."""
    n = F.col("outages")
    label = F.when(n > 20, "High Risk").when(n > 10, "Medium Risk").otherwise("Low Risk")
    return stats.select(
        "charge_point_location",
        "site_category",
        "outages",
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
        "customer_hours",
        label.alias("risk_label"),
    )


def metric_ranges(stats: DataFrame) -> DataFrame:
    """Smallest and largest frequency, duration, impact and variation over all sites.

    A site without outages counts as zero everywhere. Equal ends are widened by one. The variation
    uses the population deviation here and the sample deviation in a site's own score.
    """
    cv = F.coalesce(ratio(F.col("std_pop"), F.col("avg_duration")), F.lit(0.0))
    values = {
        "freq": F.col("outages").cast("double"),
        "duration": F.coalesce("avg_duration", F.lit(0.0)),
        "impact": F.col("customer_hours"),
        "cv": cv,
    }
    ends = stats.agg(
        *[F.min(c).alias(f"{n}_min") for n, c in values.items()],
        *[F.max(c).alias(f"{n}_top") for n, c in values.items()],
    )
    columns = []
    for name in values:
        low, high = F.col(f"{name}_min"), F.col(f"{name}_top")
        columns += [low, F.when(high == low, low + 1.0).otherwise(high).alias(f"{name}_max")]
    return ends.select(*columns)


def risk_scores(stats: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Scores from 0 to 100 and their mean for every site with outages.

    ``ranges`` (one row) keeps the scale fixed when ``stats`` comes from filtered outages.
    """
    r = (ranges if ranges is not None else metric_ranges(stats)).select(F.struct("*").alias("r"))
    df = stats.where(F.col("outages") > 0).withColumn("r", r.scalar())

    def scaled(value: Column, name: str) -> Column:
        low, high = F.col(f"r.{name}_min"), F.col(f"r.{name}_max")
        return F.when(high > low, ratio(value - low, high - low) * 100.0).otherwise(F.lit(50.0))

    cv = F.coalesce(ratio(F.col("std_samp"), F.col("avg_duration")), F.lit(0.0))
    scores = {
        "frequency_score": scaled(F.col("outages").cast("double"), "freq"),
        "duration_score": scaled(F.col("avg_duration"), "duration"),
        "impact_score": scaled(F.col("customer_hours"), "impact"),
        "consistency_score": scaled(F.col("r.cv_max") - cv, "cv"),
    }
    df = df.withColumns(scores)
    overall = sum((F.col(n) for n in scores), F.lit(0.0)) / 4.0
    return df.withColumn("overall_score", overall).select(
        "charge_point_location", "site_category", "outages", *scores, "overall_score"
    )


def weighted_priority(scores: DataFrame) -> DataFrame:
    """Alternate priority: fixed weights, raised for sites without V2X and with many outages."""
    base = (
        0.30 * F.col("frequency_score")
        + 0.25 * F.col("duration_score")
        + 0.35 * F.col("impact_score")
        + 0.10 * F.col("consistency_score")
    )
    upgrade = F.when(F.col("site_category") != V2X, 1.2).otherwise(1.0)
    busy = F.when(F.col("outages") > 5, 1.1).otherwise(1.0)
    return scores.select(
        "charge_point_location", "site_category", (base * upgrade * busy).alias("priority_score")
    )


def rule_based_levels(stats: DataFrame) -> DataFrame:
    """Rule-based risk level with its list of recommendations."""
    n, avg = F.col("outages"), F.col("avg_duration")
    level = (
        F.when(n == 0, "Unknown")
        .when((n > 20) & (avg > 8), "Critical")
        .when((n > 10) | (avg > 4), "High")
        .when(n > 5, "Medium")
        .otherwise("Low")
    )
    v2x = F.col("site_category") == V2X

    def note(condition: Column, text: str) -> Column:
        return F.when(condition, text)

    lv = F.col("risk_level")
    known = lv != "Unknown"
    # The recommendation texts.
    notes = F.array_compact(
        F.array(
            note(~known, "Insufficient data for analysis"),
            note(lv == "Critical", "Priority location for immediate V2X deployment"),
            note(lv == "Critical", "Conduct detailed grid stability analysis"),
            note(lv == "High", "Recommended for V2X upgrade"),
            note(lv == "High", "Consider backup power solutions"),
            note(lv == "Medium", "Monitor for trend changes"),
            note(lv == "Medium", "Evaluate V2X cost-benefit"),
            note(lv == "Low", "Current infrastructure appears adequate"),
            note(known & v2x, "V2X capability can mitigate grid instability"),
            note(known & ~v2x, "Consider V2X upgrade for grid support"),
            note(
                known & (F.col("winter_outages") > n * 0.4),
                "High winter vulnerability - prioritize cold weather resilience",
            ),
        )
    )
    value = F.when(v2x, "High - Already equipped for bidirectional power flow").otherwise(
        "Potential - Retrofit could provide grid benefits"
    )
    return stats.withColumn("risk_level", level).select(
        "charge_point_location",
        "site_category",
        "outages",
        "avg_duration",
        "customer_hours",
        "risk_level",
        notes.alias("recommendations"),
        F.when(known, value).alias("v2x_value"),
    )


def nearby_by_category(stats: DataFrame) -> DataFrame:
    """Sites per category with the mean count and hours nearby."""
    return (
        stats.groupBy("site_category")
        .agg(
            F.count(F.lit(1)).alias("sites"),
            F.count_if(F.col("outages") > 0).alias("sites_with_outages"),
            F.avg("outages").alias("mean_outages"),
            F.avg("hours").alias("mean_hours"),
        )
        .withColumn("category_rank", out.rank_in(F.col("site_category"), SITE_CATEGORIES))
    )


def overlapping_outages(
    sites: DataFrame, outages: DataFrame, radius: float = geo.TWO_MILES_KM, least: int = 2
) -> DataFrame:
    """Outages that lie in the buffers of at least ``least`` sites, with the number of sites."""
    n = {"sites_in_reach": ("count", F.lit(1))}
    counts = radius_aggregate(outages, sites, radius, n, repeat="right")
    return attach_by_position(
        located(outages), counts.where(F.col("sites_in_reach") >= least), how="inner"
    )
