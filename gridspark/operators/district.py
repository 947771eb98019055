"""District and place summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.functions import geo, outage as out
from gridspark.functions.coerce import to_double
from gridspark.operators.cleaning import BUILDING, OTHER, V2X
from gridspark.operators.filters import by_name
from gridspark.operators.profile import top_values
from gridspark.operators.ranking import top_k
from gridspark.operators.risk_query import district_risk_summary
from gridspark.operators.site_risk import site_stats
from gridspark.operators.spatial import located, nearest_to_point, within_radius


def outage_summary(outages: DataFrame, district: str) -> DataFrame:
    """Count, mean duration and customer hours of one district."""
    hours = to_double(F.col("duration_hours"), 0.0)
    impact = out.customer_hours_from_duration(F.col("customer_affected"), F.col("duration_hours"))
    return by_name(outages, district).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg(hours), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.sum(impact), F.lit(0.0)).alias("total_customer_hours"),
    )


def top_causes(outages: DataFrame, district: str, k: int = 5) -> DataFrame:
    return top_values(by_name(outages, district), "direct_cause_category", k)


def sites_near_district(
    sites: DataFrame, outages: DataFrame, district: str, radius: float = 15.0
) -> DataFrame:
    """Sites within ``radius`` of the mean position of the district's outages, nearest first."""
    center = (
        located(by_name(outages, district))
        .agg(F.struct(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")).alias("c"))
        .scalar()
    )
    d = geo.haversine_km(
        F.col("_c.lat"), F.col("_c.lon"), F.col("latitude"), F.col("longitude")
    )
    return (
        located(sites)
        .withColumn("_c", center)
        .withColumn("distance_km", d)
        .where(F.col("distance_km") <= radius)
        .drop("_c")
        .orderBy(F.round("distance_km", 9), "charge_point_location")
    )


def site_totals(near: DataFrame) -> DataFrame:
    kind = F.col("site_category")
    return near.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == V2X).alias("v2x"),
        F.count_if(kind == BUILDING).alias("building_supplied"),
        F.count_if(kind == OTHER).alias("other"),
    )


def district_report(
    cells: DataFrame, outages: DataFrame, sites: DataFrame, district: str
) -> DataFrame:
    """One row: risk, outage and site figures of a district and a sentence about them."""
    risk = district_risk_summary(cells, district)
    outage = outage_summary(outages, district).select(F.struct("*").alias("o"))
    near = site_totals(sites_near_district(sites, outages, district)).select(
        F.struct("*").alias("s")
    )
    row = risk.withColumns({"o": outage.scalar(), "s": near.scalar()})
    head = F.format_string(
        "%s has %d high-risk grid cells out of %d (%s%%).",
        F.lit(district),
        "high_risk_cells",
        "total_cells",
        F.format_number("high_risk_pct", 1),
    )
    history = F.when(
        F.col("o.total") > 0,
        F.format_string(
            "Historically %d outages, avg %.1fh, %.0f customer-hours lost.",
            F.col("o.total"),
            F.col("o.avg_duration"),
            F.col("o.total_customer_hours"),
        ),
    )
    chargers = F.when(
        F.col("s.total") > 0,
        F.format_string(
            "%d charging sites nearby (%d V2X).", F.col("s.total"), F.col("s.v2x")
        ),
    )
    return row.select(
        F.lit(district).alias("district"),
        "total_cells",
        "high_risk_cells",
        "avg_confidence",
        "high_risk_pct",
        F.col("o.total").alias("outages"),
        F.col("o.avg_duration").alias("avg_duration"),
        F.col("o.total_customer_hours").alias("total_customer_hours"),
        F.col("s.total").alias("sites"),
        F.col("s.v2x").alias("v2x_sites"),
        F.concat_ws(" ", head, history, chargers).alias("summary_text"),
    )


# --- quick look around a place, in planar degrees ----------------------------------------------

PLACE_DEGREES = 0.05


def nearest_in_degrees(
    df: DataFrame, lat: float, lon: float, k: int, tie: list[str], at: tuple[str, str]
) -> DataFrame:
    """The ``k`` nearest rows by planar distance, shown in km at 111 km per degree."""
    near = nearest_to_point(df, lat, lon, k, tie, "planar_deg", at, distance="_deg")
    return near.withColumn("distance_km", F.col("_deg") * geo.KM_PER_DEGREE).drop("_deg")


def place_outages(df: DataFrame, lat: float, lon: float, rings_km=(5, 10, 20)) -> DataFrame:
    """One row: outages within each ring, and count, mean duration and customers close by."""
    widest = max([PLACE_DEGREES, *[r / geo.KM_PER_DEGREE for r in rings_km]])
    near = within_radius(df, lat, lon, widest, "planar_deg", strict=True, distance="_deg")
    close = F.col("_deg") < PLACE_DEGREES
    return near.agg(
        *[
            F.count_if(F.col("_deg") < r / geo.KM_PER_DEGREE).alias(f"within_{r}km")
            for r in rings_km
        ],
        F.count_if(close).alias("close_outages"),
        F.avg(F.when(close, F.col("duration_hours"))).alias("avg_duration"),
        F.avg(F.when(close, F.col("customer_affected"))).alias("avg_customers"),
    )


def place_districts(df: DataFrame, lat: float, lon: float, k: int = 5) -> DataFrame:
    near = within_radius(df, lat, lon, PLACE_DEGREES, "planar_deg", strict=True)
    counts = near.where(F.col("district_name").isNotNull()).groupBy("district_name")
    counted = counts.agg(F.count(F.lit(1)).alias("n"))
    return top_k(counted, [F.col("n").desc(), F.col("district_name")], k)


# --- map layers --------------------------------------------------------------------------------


def chargepoint_layer(
    sites: DataFrame, outages: DataFrame, categories=None, metric: str = "haversine"
) -> DataFrame:
    """Markers: outages in the buffer, mean duration, latest outage and a size from 8 to 15."""
    stats = site_stats(sites, outages, geo.TWO_MILES_KM, metric)
    if categories is not None:
        stats = stats.where(F.col("site_category").isin(*categories))
    size = F.greatest(F.lit(8), F.least(F.lit(15), F.col("outages") + 5))
    return stats.select(
        "charge_point_location",
        "site_category",
        "latitude",
        "longitude",
        "outages",
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
        "latest_outage",
        size.cast("int").alias("marker_size"),
    )


def incident_rows(incidents: DataFrame) -> DataFrame:
    """Display fields of live incidents with a position."""
    kind = F.nullif(F.trim("incident_type"), F.lit(""))
    return located(incidents).select(
        "incident_num",
        F.coalesce("incident_status", F.lit("Unknown")).alias("incident_status"),
        F.coalesce("customers_off_supply", F.lit(0)).alias("customers_off_supply"),
        F.coalesce("customers_affected", F.lit(0)).alias("customers_affected"),
        F.coalesce(
            F.date_format("estimated_restoration_time", "dd MMM yyyy, HH:mm"), F.lit("TBC")
        ).alias("restoration"),
        F.concat_ws(" - ", "incident_num", kind).alias("tooltip"),
        "latitude",
        "longitude",
    )
