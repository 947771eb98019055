"""Ranked recommendations from risk predictions, outages and sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.functions import geo, outage as out
from gridspark.functions.coerce import percent, to_double
from gridspark.operators.cleaning import V2X, is_community_building
from gridspark.operators.ranking import top_k
from gridspark.operators.spatial import (
    LATLON,
    attach_by_position,
    located,
    nearest_by_position,
    nearest_join,
    radius_aggregate,
    radius_exists,
)

CELL_AT = ("lat", "lon")
COVERED_KM = 3.0

# Priorities in order, categories in report order.
PRIORITIES = ("Critical", "High", "Medium", "Low")
COLUMNS = ("category", "priority", "title", "detail", "lat", "lon", "score", "position")


def community_buildings(sites: DataFrame) -> DataFrame:
    return sites.where(is_community_building(F.col("charge_point_location")))


def describe_places(
    best: DataFrame, sites: DataFrame, lookups: dict[str, Column], at=CELL_AT
) -> DataFrame:
    """Add name and distance of the nearest site of several kinds to a few rows, in one pass.

    ``best`` holds a handful of ranked rows (a top-k), so it travels as one array to the sites,
    which are read once and combined map-side. ``lookups`` maps a prefix to the condition on a
    site; each adds ``<prefix>_name`` and ``<prefix>_km``. Also adds ``place``, "near <site>".
    """
    rows = best.agg(F.collect_list(F.struct(*best.columns)).alias("r")).scalar()
    named = located(sites).select("charge_point_location", "site_category", *LATLON)
    # one empty row keeps the places when there are no sites at all
    spark = best.sparkSession
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in named.schema.fields]
    padded = named.unionByName(spark.range(1).select(*blank))
    pairs = padded.withColumn("_p", F.explode(rows)).withColumn(
        "_d",
        geo.haversine_km(
            F.col("_p")[at[0]], F.col("_p")[at[1]], F.col("latitude"), F.col("longitude")
        ),
    )
    name = F.col("charge_point_location")
    key = F.struct(F.round("_d", 9).alias("d"), name.alias("n"))
    found = []
    for prefix, condition in {**lookups, "place": F.lit(True)}.items():
        hit = F.when(condition & F.col("_d").isNotNull(), key)
        found += [
            F.min_by(name, hit).alias(f"{prefix}_name"),
            F.min_by("_d", hit).alias(f"{prefix}_km"),
        ]
    columns = [f"{p}_{what}" for p in [*lookups, "place"] for what in ("name", "km")]
    near = pairs.groupBy("_p").agg(*found).select("_p.*", *columns)
    coordinates = F.format_string("Location (%.4f, %.4f)", F.col(at[0]), F.col(at[1]))
    label = F.coalesce(F.concat(F.lit("near "), F.col("place_name")), coordinates)
    return near.withColumn("place", label).drop("place_name", "place_km")


def _ranked_cells(cells: DataFrame):
    if "prob_high" in cells.columns:
        return cells, [F.col("prob_high").desc(), F.col("lat"), F.col("lon")]
    high = cells.where(F.col("risk_level") == "High").withColumn("prob_high", F.lit(0.0))
    return high, [F.col("confidence").desc(), F.col("lat"), F.col("lon")]


def _position(df: DataFrame, order: list[Column], top: int) -> DataFrame:
    """Top rows with their 0-based position; only ``top`` rows are numbered."""
    best = top_k(df, order, top)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    return best.withColumn("position", number)


def _percent_text(p: Column) -> Column:
    return F.format_string("%.0f%%", p * 100.0)


def _km_text(km: Column) -> Column:
    return F.coalesce(F.format_string("%.1f", km), F.lit("inf"))


def _community_text(ending: str) -> Column:
    return F.when(
        F.col("community_name").isNotNull(),
        F.concat(
            F.format_string(
                " Nearest community building: %s (%.1f km). ", "community_name", "community_km"
            ),
            F.lit(ending),
        ),
    ).otherwise(F.lit(""))


def v2x_candidates(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells with a site without V2X within 3 km (inclusive) and no V2X site closer than 3 km."""
    ranked, _ = _ranked_cells(cells)
    is_v2x = F.col("site_category") == V2X
    near_plain = radius_exists(ranked, sites.where(~is_v2x), COVERED_KM, CELL_AT, LATLON)
    return radius_exists(
        near_plain, sites.where(is_v2x), COVERED_KM, CELL_AT, LATLON, strict=True, negate=True
    )


def uncovered_cells(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells with no site at all closer than 3 km."""
    ranked, _ = _ranked_cells(cells)
    return radius_exists(ranked, sites, COVERED_KM, CELL_AT, LATLON, strict=True, negate=True)


def v2x_upgrades(cells: DataFrame, sites: DataFrame, top: int = 3) -> DataFrame:
    """The riskiest cells whose charge points lack V2X."""
    _, order = _ranked_cells(cells)
    best = _position(v2x_candidates(cells, sites), order, top)
    is_v2x = F.col("site_category") == V2X
    lookups = {"v2x": is_v2x, "site": ~is_v2x, "community": is_community_building(F.col("charge_point_location"))}
    named = describe_places(best, sites, lookups)
    detail = F.concat(
        F.format_string(
            "High-risk area near **%s** has a chargepoint (%s) but no V2X coverage within 3 km. ",
            "place",
            "site_name",
        ),
        F.format_string(
            "(high-risk probability: %s, risk: %s). ",
            _percent_text(F.col("prob_high")),
            "risk_level",
        ),
        F.format_string(
            "Nearest V2X site: %s (%s km away).",
            F.coalesce("v2x_name", F.lit("N/A")),
            _km_text(F.col("v2x_km")),
        ),
        _community_text("V2X deployment here could provide backup power for the community."),
    )
    return named.withColumns(
        {
            "category": F.lit("Charging Station Placement"),
            "priority": F.lit("Critical"),
            "title": F.concat(F.lit("V2X upgrade recommended at "), F.col("place")),
            "detail": detail,
            "score": F.col("confidence"),
        }
    )


def new_chargepoints(cells: DataFrame, sites: DataFrame, top: int = 3) -> DataFrame:
    """The riskiest cells without any charge point in reach."""
    _, order = _ranked_cells(cells)
    best = _position(uncovered_cells(cells, sites), order, top)
    named = describe_places(best, sites, {"site": F.lit(True), "community": is_community_building(F.col("charge_point_location"))})
    detail = F.concat(
        F.format_string("High-risk area near **%s** has no chargepoints within 3 km. ", "place"),
        F.format_string(
            "(high-risk probability: %s, risk: %s). ",
            _percent_text(F.col("prob_high")),
            "risk_level",
        ),
        F.format_string(
            "Nearest chargepoint: %s (%s km away).",
            F.coalesce("site_name", F.lit("N/A")),
            _km_text(F.col("site_km")),
        ),
        _community_text("New chargepoint here could improve resilience for the community."),
    )
    return named.withColumns(
        {
            "category": F.lit("Chargepoint Placement"),
            "priority": F.lit("High"),
            "title": F.concat(F.lit("New chargepoint recommended at "), F.col("place")),
            "detail": detail,
            "score": F.col("confidence"),
        }
    )


def district_burden(outages: DataFrame) -> DataFrame:
    """Count, mean and total duration and winter outages per district."""
    hours = to_double(F.col("duration_hours"), 0.0)
    return (
        outages.where(F.col("district_name").isNotNull())
        .groupBy("district_name")
        .agg(
            F.count(F.lit(1)).alias("outage_count"),
            F.avg(hours).alias("avg_duration"),
            F.sum(hours).alias("total_hours"),
            F.count_if(F.col("season") == "Winter").alias("winter_count"),
        )
    )


def resilience_priorities(outages: DataFrame, top: int = 5) -> DataFrame:
    """The districts with most outages."""
    order = [F.col("outage_count").desc(), F.col("district_name")]
    best = _position(district_burden(outages), order, top)
    detail = F.concat(
        F.format_string(
            "%s experienced %d outages (avg %.1fh each, %.0fh total). %d occurred in winter. ",
            "district_name",
            "outage_count",
            "avg_duration",
            "total_hours",
            "winter_count",
        ),
        F.when(
            F.col("winter_count") > 20,
            "High winter vulnerability — priority for infrastructure upgrade.",
        ).otherwise(""),
    )
    return best.withColumns(
        {
            "category": F.lit("Grid Resilience"),
            "priority": F.when(F.col("outage_count") > 50, "High").otherwise("Medium"),
            "title": F.concat(F.lit("Grid resilience priority: "), F.col("district_name")),
            "detail": detail,
            "lat": F.lit(None).cast("double"),
            "lon": F.lit(None).cast("double"),
            "score": F.col("outage_count").cast("double"),
        }
    )


def community_impact(sites: DataFrame, outages: DataFrame, radius: float = 2.0) -> DataFrame:
    """Community buildings with more than five outages nearby, busiest first."""
    measures = {
        "nearby_outages": ("count", F.lit(1)),
        "nearby_hours": ("sum", to_double(F.col("duration_hours"))),
    }
    buildings = community_buildings(sites)
    stats = radius_aggregate(buildings, outages, radius, measures)
    hit = attach_by_position(buildings, stats, how="inner").where(F.col("nearby_outages") > 5)
    has_v2x = F.col("site_category") == V2X
    detail = F.concat(
        F.format_string(
            "%s has experienced %d nearby outages (%.0f hours total impact). ",
            "charge_point_location",
            "nearby_outages",
            F.coalesce("nearby_hours", F.lit(0.0)),
        ),
        F.when(
            has_v2x, "Site already has V2X — can provide backup power during outages."
        ).otherwise("No V2X backup available — community is vulnerable during outages."),
    )
    return hit.withColumns(
        {
            "category": F.lit("Community Impact"),
            "priority": F.when(has_v2x, "Medium").otherwise("High"),
            "title": F.concat(
                F.lit("Community building at risk: "), F.col("charge_point_location")
            ),
            "detail": detail,
            "lat": F.col("latitude"),
            "lon": F.col("longitude"),
            "score": F.col("nearby_outages").cast("double"),
            # busiest first without numbering the whole table
            "position": (-F.col("nearby_outages")).cast("int"),
        }
    )


def investment_ranking(
    cells: DataFrame, outages: DataFrame, sites: DataFrame, radius: float = geo.TWO_MILES_KM
) -> DataFrame:
    """Composite investment score of every site, highest first."""
    right = cells.select(
        F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), "risk_level",
        F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon"),
    )
    risky = nearest_join(sites, right, LATLON, ("_clat", "_clon"), ["_tlat", "_tlon"])
    measures = {
        "nearby_outages": ("count", F.lit(1)),
        "nearby_hours": ("sum", to_double(F.col("duration_hours"))),
    }
    stats = radius_aggregate(sites, outages, radius, measures)
    df = attach_by_position(risky, stats)
    n = F.coalesce("nearby_outages", F.lit(0)).cast("bigint")
    h = F.coalesce("nearby_hours", F.lit(0.0))
    level = F.coalesce("risk_level", F.lit("Unknown"))
    risk = F.when(level == "High", 1.0).when(level == "Medium", 0.5).otherwise(0.1)
    penalty = F.when(F.col("site_category") == V2X, -1.0).otherwise(0.0)
    score = (
        risk * 0.4
        + F.least(n / 50.0, F.lit(1.0)) * 0.3
        + F.least(h / 1000.0, F.lit(1.0)) * 0.2
        + penalty * 0.1
    )
    return df.select(
        F.col("charge_point_location").alias("site_name"),
        F.col("site_category").alias("category"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        level.alias("risk_level"),
        n.alias("nearby_outages"),
        h.alias("nearby_hours"),
        score.alias("composite_score"),
    ).orderBy(F.col("composite_score").desc(), "site_name")


def combined_report(
    cells: DataFrame, outages: DataFrame, sites: DataFrame, kind: str = "all"
) -> DataFrame:
    """Recommendations of one kind (``v2x``, ``chargepoint``) or all, most urgent first."""
    parts = []
    if kind in ("v2x", "all"):
        parts.append(v2x_upgrades(cells, sites))
    if kind in ("chargepoint", "all"):
        parts.append(new_chargepoints(cells, sites))
    if kind == "all":
        parts.append(resilience_priorities(outages))
        parts.append(community_impact(sites, outages))
    if not parts:
        raise ValueError(f"unknown kind {kind!r}")
    stacked = [p.select(*COLUMNS, F.lit(i).alias("source")) for i, p in enumerate(parts)]
    rank = F.coalesce(out.rank_in(F.col("priority"), PRIORITIES), F.lit(9))
    return (
        reduce(DataFrame.unionByName, stacked)
        .withColumn("score", F.round("score", 4))
        .withColumn("priority_rank", rank)
        .orderBy("priority_rank", "source", "position", "title")
    )


# --- answers -----------------------------------------------------------------------------------


def highest_risk_cells(cells: DataFrame, top: int = 5) -> DataFrame:
    order = [F.col("confidence").desc(), F.col("lat"), F.col("lon")]
    return top_k(cells.where(F.col("risk_level") == "High"), order, top)


def winter_risk(outages: DataFrame) -> DataFrame:
    """Winter outages, their share and mean duration."""
    winter = F.coalesce(F.col("season") == "Winter", F.lit(False))
    n = F.count_if(winter)
    return outages.agg(
        n.alias("winter_outages"),
        F.coalesce(percent(n, F.count(F.lit(1))), F.lit(0.0)).alias("winter_pct"),
        F.avg(F.when(winter, to_double(F.col("duration_hours")))).alias("avg_winter_duration"),
    )


def risk_summary(cells: DataFrame, outages: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells per level with shares, outages used, community buildings tracked."""
    total = F.count(F.lit(1))
    n = outages.agg(F.count(F.lit(1)).alias("n")).scalar()
    buildings = community_buildings(sites).agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = []
    for level in ("High", "Medium", "Low"):
        hit = F.count_if(F.col("risk_level") == level)
        counts += [hit.alias(f"{level.lower()}_cells"), percent(hit, total).alias(f"{level.lower()}_pct")]
    return cells.agg(total.alias("cells"), *counts).withColumns(
        {"outages": n, "community_buildings": buildings}
    )


def community_list(sites: DataFrame) -> DataFrame:
    return community_buildings(sites).select("charge_point_location", "site_category")


# --- candidate cells ---------------------------------------------------------------------------


def candidate_cells(
    cells: DataFrame, outages: DataFrame, sites: DataFrame, top: int = 10
) -> DataFrame:
    """The top High and the top Medium cells with outages within 0.05° and sites within 0.1°."""
    order = [F.col("prob_high").desc(), F.col("lat"), F.col("lon")]
    best = reduce(
        DataFrame.unionByName,
        [top_k(cells.where(F.col("risk_level") == v), order, top) for v in ("High", "Medium")],
    )
    return _with_counts(best, outages, sites)


def _with_counts(cells: DataFrame, outages: DataFrame | None, sites: DataFrame) -> DataFrame:
    def count(points: DataFrame, degrees: float, name: str) -> DataFrame:
        return radius_aggregate(
            cells, points, degrees, {name: ("count", F.lit(1))}, CELL_AT, LATLON,
            metric="planar_deg", strict=True,
        )

    names = ["nearby_sites"]
    df = attach_by_position(cells, count(sites, 0.1, "nearby_sites"), CELL_AT)
    if outages is not None:
        df = attach_by_position(df, count(outages, 0.05, "nearby_outages"), CELL_AT)
        names.append("nearby_outages")
    return df.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names})


def underserved_cells(cells: DataFrame, sites: DataFrame, top: int = 10, fewer: int = 3):
    """Of the riskiest High or Medium cells those with fewer than three sites within 0.1°."""
    order = [F.col("prob_high").desc(), F.col("lat"), F.col("lon")]
    best = top_k(cells.where(F.col("risk_level").isin("High", "Medium")), order, top)
    return _with_counts(best, None, sites).where(F.col("nearby_sites") < fewer)


# --- cross references of planned sites ---------------------------------------------------------


def cross_reference_risk(
    planned: DataFrame, cells: DataFrame, radius: float = 10.0
) -> DataFrame:
    """Nearest cell within ``radius`` with its figures, mean P(high) and High cells in reach.

    Returns one row per distinct position (``site_lat``, ``site_lon``); positions without a cell
    in reach are absent.
    """
    right = cells.select(
        F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), "risk_level", "confidence",
        "prob_high", "prob_medium", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"),
    )
    near = nearest_by_position(
        planned, right, LATLON, ("_clat", "_clon"), ["cell_lat", "cell_lon"],
        distance="nearest_risk_cell_km",
    ).drop("rank", "_clat", "_clon", "cell_lat", "cell_lon")
    measures = {
        "_n": ("count", F.lit(1)),
        "_p": ("sum", F.col("prob_high")),
        "high_risk_cells": ("sum", (F.col("risk_level") == "High").cast("bigint")),
    }
    around = radius_aggregate(planned, cells, radius, measures, LATLON, CELL_AT)
    return (
        near.join(around, ["site_lat", "site_lon"])
        .withColumn("avg_prob_high_nearby", F.col("_p") / F.col("_n"))
        .drop("_n", "_p")
    )


def cross_reference_sites(planned: DataFrame, sites: DataFrame, radius: float = 10.0):
    """Charge points around: how many, the nearest, and the five nearest in reach as an array."""
    right = sites.select(
        F.col("charge_point_location").alias("name"), F.col("site_category").alias("category"),
        F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"),
    )
    five = nearest_by_position(planned, right, LATLON, ("_slat", "_slon"), ["name"], k=5)
    inside = F.col("distance_km") <= radius
    item = F.struct("rank", "name", "category", "distance_km")
    nearest = five.groupBy("site_lat", "site_lon").agg(
        F.min("distance_km").alias("nearest_chargepoint_km"),
        F.max(F.when((F.col("rank") == 1) & inside, F.col("name"))).alias(
            "nearest_chargepoint_name"
        ),
        F.sort_array(F.collect_list(F.when(inside, item))).alias("chargepoints"),
    )
    counts = radius_aggregate(planned, sites, radius, {"count_within_radius": ("count", F.lit(1))})
    return nearest.join(counts, ["site_lat", "site_lon"], "left").withColumn(
        "count_within_radius", F.coalesce("count_within_radius", F.lit(0)).cast("bigint")
    )


# The reasons given.
REASON_NEW = "High-risk area with no chargepoints within 3km — recommended for new placement"
REASON_UPGRADE = "High-risk area with existing chargepoints — may need V2X upgrade"
REASON_NONE = "Not a priority recommendation area"
REASON_NO_DATA = "No risk data nearby"


def cross_reference_priority(
    planned: DataFrame, cells: DataFrame, sites: DataFrame, radius: float = 5.0
) -> DataFrame:
    """Whether a planned site is in a recommended area, and why, per distinct position."""
    places = (
        planned.select(*LATLON).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    ).distinct()
    measures = {
        "_cells": ("count", F.lit(1)),
        "_high": ("sum", (F.col("risk_level") == "High").cast("bigint")),
    }
    around = radius_aggregate(places, cells, radius, measures, LATLON, CELL_AT)
    covered = radius_aggregate(places, sites, COVERED_KM, {"_sites": ("count", F.lit(1))})
    df = attach_by_position(attach_by_position(places, around), covered)
    high, gap = F.coalesce(F.col("_high") > 0, F.lit(False)), F.col("_sites").isNull()
    reason = (
        F.when(F.col("_cells").isNull(), REASON_NO_DATA)
        .when(high & gap, REASON_NEW)
        .when(high, REASON_UPGRADE)
        .otherwise(REASON_NONE)
    )
    return df.select(
        F.col("latitude").alias("site_lat"),
        F.col("longitude").alias("site_lon"),
        high.alias("matches_recommendation"),
        reason.alias("reason"),
    )
