"""Outage, site and cell filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.functions import outage as out
from gridspark.functions.coerce import percent, to_double
from gridspark.operators.cleaning import BUILDING, OTHER, V2X
from gridspark.operators.quantiles import quantile_values
from gridspark.operators.ranking import top_k
from gridspark.operators.spatial import within_radius

MAX_UPPER_HOURS = 49.0


def by_years(df: DataFrame, years) -> DataFrame:
    """Rows of the given years; an empty set filters nothing."""
    return df.where(F.col("year").isin(*years)) if years else df


def daytime(df: DataFrame, first: int = 9, last: int = 21) -> DataFrame:
    return df.where(F.col("hour").between(first, last))


def without_exceptional(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("is_exceptional_event", F.lit(False)))


def duration_bounds(df: DataFrame, k: float = 1.5, column: str = "duration_hours"):
    """``(lower, upper)`` of the interquartile-range rule, or None without values (an action)."""
    q = quantile_values(df, F.col(column), [0.25, 0.75])
    if q is None:
        return None
    spread = k * (q[1] - q[0])
    return max(0.0, q[0] - spread), min(MAX_UPPER_HOURS, q[1] + spread)


def duration_outliers_removed(df: DataFrame, k: float = 1.5, column: str = "duration_hours"):
    """Keep durations inside the interquartile-range bounds; null durations go."""
    bounds = duration_bounds(df, k, column)
    if bounds is None:
        return df.where(F.lit(False))
    return df.where(F.col(column).between(*bounds))


def significant_only(df: DataFrame, quantile: float = 0.5) -> DataFrame:
    """Keep outages whose significance ratio reaches the given quantile of all ratios."""
    ratio = out.significance_ratio(F.col("total_customer_minutes_lost"), F.col("duration_hours"))
    rated = df.withColumn("significance_ratio", ratio)
    q = min(1.0, max(0.0, quantile))
    threshold = quantile_values(rated, F.col("significance_ratio"), [q])
    if threshold is None:
        return rated
    return rated.where(F.col("significance_ratio") >= threshold[0])


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, kept and removed, and the share removed."""
    kept = after.agg(F.count(F.lit(1)).alias("n"))
    total = before.agg(F.count(F.lit(1)).alias("total_rows"))
    out_ = total.withColumn("kept_rows", kept.scalar())
    removed = F.col("total_rows") - F.col("kept_rows")
    return out_.withColumns(
        {"removed_rows": removed, "removed_pct": percent(removed, F.col("total_rows"))}
    )


def apply_filters(
    df: DataFrame,
    years=(),
    daytime_only: bool = False,
    exclude_exceptional: bool = False,
    iqr_multiplier: float | None = None,
    significance_quantile: float | None = None,
) -> DataFrame:
    """The filters in their fixed order; thresholds come from what is left at that step."""
    df = by_years(df, years)
    if daytime_only:
        df = daytime(df)
    if exclude_exceptional:
        df = without_exceptional(df)
    if iqr_multiplier is not None:
        df = duration_outliers_removed(df, iqr_multiplier)
    if significance_quantile is not None:
        df = significant_only(df, significance_quantile)
    return df


# --- outage query ------------------------------------------------------------------------------

_RESULT_COLUMNS = (
    "incident_date_time", "district_name", "primary_substation", "duration_hours",
    "customer_affected", "direct_cause_category", "latitude", "longitude",
)
_SORT_COLUMNS = {
    "duration": "duration_hours",
    "customers": "customer_affected",
    "date": "incident_date_time",
}


def matching_outages(
    df: DataFrame,
    district: str | None = None,
    lat: float | None = None,
    lon: float | None = None,
    radius: float = 15.0,
    year: int | None = None,
    start: str | None = None,
    end: str | None = None,
    cause: str | None = None,
    min_duration: float | None = None,
) -> DataFrame:
    """Outages matching every given condition; the end date is inclusive."""
    if year:
        df = df.where(F.col("year") == year)
    if start:
        df = df.where(F.col("incident_date_time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        last = F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
        df = df.where(F.col("incident_date_time") <= last)
    if district:
        df = df.where(out.contains_text(F.col("district_name"), district))
    if cause:
        df = df.where(out.contains_text(F.col("direct_cause_category"), cause))
    if lat is not None and lon is not None:
        df = within_radius(df, lat, lon, radius, distance="distance_km")
    df = df.withColumns(
        {
            "duration_hours": to_double(F.col("duration_hours"), 0.0),
            "customer_affected": to_double(F.col("customer_affected"), 0.0),
        }
    )
    if min_duration is not None:
        df = df.where(F.col("duration_hours") >= min_duration)
    return df


def query_outages(df: DataFrame, sort: str = "duration", top: int = 10, **conditions):
    """``(results, summary)``: the top rows and totals over all matches."""
    found = matching_outages(df, **conditions)
    columns = [*_RESULT_COLUMNS] + (["distance_km"] if "distance_km" in found.columns else [])
    order = [F.col(_SORT_COLUMNS[sort]).desc_nulls_last(), F.col("incident_reference_number")]
    results = top_k(found, order, top).select("incident_reference_number", *columns)
    impact = out.customer_hours_from_duration(F.col("customer_affected"), F.col("duration_hours"))
    summary = found.agg(
        F.count(F.lit(1)).alias("match_count"),
        F.coalesce(F.avg("duration_hours"), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.sum(impact), F.lit(0.0)).alias("total_customer_hours"),
    )
    return results, summary


# --- sites, cells and names --------------------------------------------------------------------

# Short names of the site categories.
CATEGORY_ALIASES = {"v2x": V2X, "building-supplied": BUILDING, "other": OTHER}


def by_category(df: DataFrame, category: str | None, column: str = "site_category") -> DataFrame:
    """Sites of one category by its short name, else by any part of the name."""
    if not category:
        return df
    known = CATEGORY_ALIASES.get(category.lower())
    if known:
        return df.where(F.col(column) == known)
    return df.where(out.contains_text(F.col(column), category))


def by_name(df: DataFrame, name: str, column: str = "district_name") -> DataFrame:
    """Rows equal to ``name`` ignoring case; where there is none, rows containing it."""
    same = F.coalesce(F.lower(column) == name.lower(), F.lit(False))
    any_same = df.agg(F.max(same.cast("int")).alias("m")).scalar()
    loose = (F.coalesce(any_same, F.lit(0)) == 0) & out.contains_text(F.col(column), name)
    return df.where(same | loose)


def visible_risk_cells(df: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Cells worth drawing: not Low, and confident enough."""
    return df.where((F.col("risk_level") != "Low") & (F.col("confidence") >= min_confidence))


def by_authority(df: DataFrame, authority: str | None, top: int | None, order: list):
    """Rows of one authority (part of its name) in the given order, at most ``top``."""
    if authority:
        df = df.where(out.contains_text(F.col("local_authority"), authority))
    return top_k(df, order, top) if top else df


def query_sites(
    df: DataFrame,
    category: str | None = None,
    lat: float | None = None,
    lon: float | None = None,
    radius: float = 5.0,
    top: int = 10,
):
    """``(results, summary)`` of a site search by category and proximity."""
    found = by_category(df, category)
    order = [F.col("charge_point_location")]
    if lat is not None and lon is not None:
        found = within_radius(found, lat, lon, radius, distance="distance_km")
        order = [F.round("distance_km", 9), *order]
    return top_k(found, order, top), found.agg(F.count(F.lit(1)).alias("match_count"))

