"""Incremental loads in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.coerce import to_double
from gridspark.operators.ranking import keep_first, top_k_per_group
from gridspark.operators.spatial import (
    LATLON,
    attach_by_position,
    nearest_by_position,
    radius_aggregate,
)


def high_water_mark(stored: DataFrame | None, saved: str | None = None):
    """The later of the saved mark and the newest stored incident, or None (an action)."""
    marks = [F.lit(saved).cast("timestamp_ntz")] if saved else []
    if stored is None:
        if not saved:
            return None
        raise ValueError("a saved mark alone needs no query; pass it as `since`")
    newest = F.max("incident_date_time")
    best = F.greatest(newest, *marks) if marks else newest
    return stored.agg(best.alias("mark")).first()["mark"]


def new_rows(
    feed: DataFrame, stored: DataFrame | None, saved: str | None = None, since: str | None = None,
    full: bool = False,
) -> DataFrame:
    """Feed rows after the mark; from ``since`` on inclusively; all of them when ``full``."""
    ts = F.col("incident_date_time")
    if since:
        return feed.where(ts >= F.lit(since).cast("timestamp_ntz"))
    if full or (stored is None and not saved):
        return feed
    if stored is None:
        return feed.where(ts > F.lit(saved).cast("timestamp_ntz"))
    mark = high_water_mark(stored, saved)
    return feed if mark is None else feed.where(ts > F.lit(mark).cast("timestamp_ntz"))


def next_mark(stored: DataFrame, batch: DataFrame) -> Column:
    """The mark after a load: unchanged when the batch is empty."""
    newest = F.max("incident_date_time")
    old = stored.agg(newest.alias("m")).scalar()
    new = batch.agg(newest.alias("m")).scalar()
    return F.greatest(old, new)


def upsert(
    stored: DataFrame, batch: DataFrame, order: str, key: str = "incident_reference_number"
) -> DataFrame:
    """Stored rows replaced by the batch where keys meet; within the batch the last row wins.

    ``stored`` holds one row per key, as every load leaves it (a first load goes through
    ``keep_first``); its rows are not ranked again. Without the key column on both sides this is
    a plain union.
    """
    if key not in stored.columns or key not in batch.columns:
        return stored.unionByName(batch, allowMissingColumns=True)
    newest = keep_first(batch, [key], [F.col(order).desc()])
    # AQE broadcasts the batch's keys once it has measured them: the stored rows need not move
    keys = newest.select(F.col(key).alias("_key")).distinct()
    kept = stored.join(keys, stored[key].eqNullSafe(keys["_key"]), "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


# --- live incidents ----------------------------------------------------------------------------


def new_incidents(current: DataFrame, known: DataFrame) -> DataFrame:
    """Incidents of the feed whose number is not known yet."""
    with_id = current.where(F.col("incident_num").isNotNull())
    return with_id.join(known.select("incident_num"), "incident_num", "left_anti")


def next_known(current: DataFrame, known: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The known numbers after a check (actions on one feed snapshot).

    ``fresh`` are its new incidents, if they are at hand.

    An empty feed clears them. They are replaced by the current numbers only when something new
    was reported; otherwise they stay as they are.
    """
    ids = current.where(F.col("incident_num").isNotNull()).select("incident_num").distinct()
    if current.isEmpty():
        return ids
    if (fresh if fresh is not None else new_incidents(current, known)).isEmpty():
        return known.select("incident_num")
    return ids


def with_context(
    incidents: DataFrame, cells: DataFrame, sites: DataFrame, outages: DataFrame,
    top: int = 3, radius: float = 5.0,
) -> DataFrame:
    """Risk at the nearest cell, the nearest charge points and the outage history around.

    One row per incident; the charge points are an array of at most ``top`` structs.
    """
    keys = ["site_lat", "site_lon"]
    right = cells.select(
        F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), "risk_level", "confidence",
        "prob_high", F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon"),
    )
    risk = nearest_by_position(
        incidents, right, LATLON, ("_clat", "_clon"), ["_tlat", "_tlon"],
        distance="cell_distance_km",
    ).drop("rank", "_clat", "_clon", "_tlat", "_tlon")
    named = sites.select(
        F.col("charge_point_location").alias("name"), F.col("site_category").alias("category"),
        F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"),
    )
    close = nearest_by_position(incidents, named, LATLON, ("_slat", "_slon"), ["name"], k=top)
    item = F.struct("rank", "name", "category", "distance_km")
    chargers = close.groupBy(*keys).agg(
        F.sort_array(F.collect_list(item)).alias("nearest_chargepoints")
    )
    hours = to_double(F.col("duration_hours"), 0.0)
    measures = {
        "history_count": ("count", F.lit(1)),
        "_hours": ("sum", hours),
        "history_customer_hours": (
            "sum",
            to_double(F.col("customer_affected"), 0.0) * hours,
        ),
    }
    history = radius_aggregate(incidents, outages, radius, measures)
    df = attach_by_position(incidents, risk)
    df = attach_by_position(df, chargers)
    df = attach_by_position(df, history)
    return df.withColumns(
        {
            "history_count": F.when(
                F.col("latitude").isNotNull(), F.coalesce("history_count", F.lit(0))
            ).cast("bigint"),
            "history_avg_duration": F.try_divide(F.col("_hours"), F.col("history_count")),
        }
    ).drop("_hours")


def incident_list(incidents: DataFrame) -> DataFrame:
    """The feed as shown: fixed columns, nulls kept."""
    return incidents.select(
        "incident_num", "incident_type", "outage_time", "customers_affected",
        "customers_off_supply", "incident_status", "estimated_restoration_time", "latitude",
        "longitude",
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k_per_group(df, keys, order, 1)
