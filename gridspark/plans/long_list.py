"""From the raw long list of community sites to a located, cross-referenced table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.operators.cleaning import locate_places, name_long_list
from gridspark.operators.filters import by_authority
from gridspark.operators.recommend import (
    cross_reference_priority,
    cross_reference_risk,
    cross_reference_sites,
)
from gridspark.operators.spatial import attach_by_position

_COLUMNS = (
    "site_name", "town", "site_type", "latitude", "longitude", "local_authority",
    "brief_description", "contact", "email",
)


def prepare_long_list(
    raw: DataFrame,
    gazetteer: DataFrame,
    order: str,
    authority: str | None = None,
    top: int | None = None,
) -> DataFrame:
    """Clean, filter, classify and locate the sites."""
    rows = by_authority(raw.na.drop(subset=["town", "potential_sites"]), authority, top,
                        [F.col(order)])
    return locate_places(name_long_list(rows), gazetteer).select(order, *_COLUMNS)


def cross_reference(
    located: DataFrame, cells: DataFrame, sites: DataFrame, radius: float = 10.0
) -> DataFrame:
    """Add the structs ``risk``, ``charging`` and ``recommendation`` (null without coordinates)."""

    def nested(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in ("site_lat", "site_lon")]
        return df.select("site_lat", "site_lon", F.struct(*fields).alias(name))

    df = attach_by_position(located, nested(cross_reference_risk(located, cells, radius), "risk"))
    df = attach_by_position(
        df, nested(cross_reference_sites(located, sites, radius), "charging")
    )
    return attach_by_position(
        df, nested(cross_reference_priority(located, cells, sites, radius), "recommendation")
    )


def long_list_summary(rows: DataFrame) -> DataFrame:
    """Counts of sites, located and not, and of the cross references where present."""
    total, found = F.count(F.lit(1)), F.count("latitude")
    figures = [
        total.alias("total_sites"),
        found.alias("geocoded"),
        (total - found).alias("failed_geocode"),
    ]
    if "risk" in rows.columns:
        figures += [
            F.count_if(F.col("risk.risk_level") == "High").alias("high_risk_sites"),
            F.count_if(F.col("charging.count_within_radius") > 0).alias(
                "sites_with_nearby_charging"
            ),
            F.count_if("recommendation.matches_recommendation").alias("matches_recommendation"),
        ]
    return rows.agg(*figures)
