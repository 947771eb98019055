"""Registration of the checkable queries and the SQL building blocks of their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridspark import fixtures as fx
from gridspark.operators.cleaning import derive_fields
from gridspark.sources.tables import union_models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Domain:
    """The domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = fx.use(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def view(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    @property
    def raw(self) -> DataFrame:
        return fx.outages(self.spark)

    @property
    def outages(self) -> DataFrame:
        return derive_fields(self.raw)

    @property
    def sites(self) -> DataFrame:
        return fx.sites(self.spark)

    @property
    def cells(self) -> DataFrame:
        return fx.predictions(self.spark)

    @property
    def cells2(self) -> DataFrame:
        return fx.predictions(self.spark, second=True)

    @property
    def stacked(self) -> DataFrame:
        return union_models({"rf": self.cells, "xgb": self.cells2})

    @property
    def regions(self) -> DataFrame:
        return fx.regions(self.spark)

    @property
    def incidents(self) -> DataFrame:
        return self.spark.sql(fx.INCIDENTS)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its counterpart over the same tables."""

    def register(build: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Domain(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


# Means and scores of whole minutes often end exactly half-way at few digits; these are compared finer.
_FINE = {"avg_duration", "history_avg_duration", "composite_score"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, negative zero removed."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns(
        {c: F.round(F.col(c), 9 if c in _FINE else digits) + F.lit(0.0) for c in doubles}
    )


def text_times(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text."""
    changes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            changes[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            changes[f.name] = F.date_format(f.name, "yyyy-MM-dd")
    return df.withColumns(changes)


# --- SQL pieces --------------------------------------------------------------------------------


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in km."""
    dlat, dlon = f"radians({lat2}) - radians({lat1})", f"radians({lon2}) - radians({lon1})"
    return (
        f"(12742.0 * asin(sqrt(least(1.0, power(sin(({dlat}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * power(sin(({dlon}) / 2), 2)))))"
    )


def deg(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"sqrt(power({lat2} - {lat1}, 2) + power({lon2} - {lon1}, 2))"


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


_SEASON = """CASE WHEN month(local_ts) IN (12, 1, 2) THEN 'Winter' WHEN month(local_ts) IN (3, 4, 5) THEN 'Spring'
    WHEN month(local_ts) IN (6, 7, 8) THEN 'Summer' WHEN local_ts IS NOT NULL THEN 'Autumn' END"""

_PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), fx.OUTAGES),
    "timed": (
        ("raw",),
        """SELECT *, timezone('Europe/London', timezone('UTC', incident_date_time)) AS local_ts,
  COALESCE(incident_duration / CAST(60 AS DOUBLE),
    (epoch_us(restoration_date_time) - epoch_us(incident_date_time)) / 3.6e9) AS duration_hours
FROM raw""",
    ),
    "outages": (
        ("timed",),
        f"""SELECT * EXCLUDE (local_ts), CAST(year(local_ts) AS INTEGER) AS year,
  monthname(local_ts) AS month_name, CAST(month(local_ts) AS INTEGER) AS month_number,
  CAST(hour(local_ts) AS INTEGER) AS hour, {_SEASON} AS season,
  CASE WHEN duration_hours < 3 THEN 'x < 3 hours' WHEN duration_hours < 6 THEN '3 ≤ x < 6 hours'
    WHEN duration_hours < 12 THEN '6 ≤ x < 12 hours' WHEN duration_hours >= 12 THEN 'x > 12 hours'
    END AS duration_category,
  COALESCE(trim(exceptional_event_id) <> '', FALSE) AS is_exceptional_event
FROM timed""",
    ),
    "sites": ((), fx.SITES),
    "cells": (
        ("raw",),
        """SELECT CAST(round_even(latitude / 0.02, 0) AS BIGINT) AS ci,
  CAST(round_even(longitude / 0.02, 0) AS BIGINT) AS cj, count(*) AS n
FROM raw WHERE latitude IS NOT NULL GROUP BY 1, 2""",
    ),
    "preds": (("cells",), fx.PREDICTIONS.format(h="h")),
    "preds2": (("cells",), fx.PREDICTIONS.format(h="(99 - h)")),
    "stacked": (
        ("preds", "preds2"),
        """SELECT *, 'rf' AS model, 0 AS model_order FROM preds
UNION ALL SELECT *, 'xgb' AS model, 1 AS model_order FROM preds2""",
    ),
    "merged": (
        ("stacked",),
        """SELECT lat, lon, arg_min(risk_level, model_order) AS risk_level, avg(confidence) AS confidence,
  avg(prob_high) AS prob_high, avg(prob_medium) AS prob_medium, avg(prob_low) AS prob_low
FROM stacked GROUP BY lat, lon""",
    ),
    "cell_districts": (
        ("cells", "raw"),
        f"""SELECT ci, cj, district_name FROM (
  SELECT ci, cj, district_name, ROW_NUMBER() OVER (PARTITION BY ci, cj ORDER BY
    round({hav("ci / 50.0", "cj / 50.0", "latitude", "longitude")}, 9), row_id) AS rn
  FROM cells JOIN raw ON abs(latitude - ci / 50.0) <= 0.04 AND abs(longitude - cj / 50.0) <= 0.04) t
WHERE rn = 1""",
    ),
    "merged_d": (
        ("merged", "cell_districts"),
        """SELECT m.*, district_name FROM merged m JOIN cell_districts d
  ON m.lat = d.ci / CAST(50 AS DOUBLE) AND m.lon = d.cj / CAST(50 AS DOUBLE)""",
    ),
    "regions": ((), fx.REGIONS),
    "incidents": ((), fx.INCIDENTS),
    "rawcp": ((), fx.RAW_CHARGEPOINTS),
    "buildings": ((), fx.BUILDING_SITES),
    "long_list": ((), fx.LONG_LIST),
    "gazetteer": ((), fx.GAZETTEER),
    "pairs": (
        ("sites", "outages"),
        f"""SELECT s.charge_point_location, s.site_category, o.*,
  {hav("s.latitude", "s.longitude", "o.latitude", "o.longitude")} AS d
FROM sites s JOIN outages o ON abs(s.latitude - o.latitude) < 0.06""",
    ),
    "site_stats": (
        ("pairs",),
        """SELECT s.charge_point_location, s.site_category, s.latitude, s.longitude,
  count(p.row_id) AS outages, avg(p.duration_hours) AS avg_duration,
  COALESCE(sum(p.total_customer_minutes_lost) / 60.0, 0) AS customer_hours,
  COALESCE(sum(p.duration_hours), 0) AS hours, stddev_pop(p.duration_hours) AS std_pop,
  stddev_samp(p.duration_hours) AS std_samp, max(p.incident_date_time) AS latest_outage,
  count(CASE WHEN p.month_name IN ('December', 'January', 'February') THEN 1 END) AS winter_outages
FROM sites s LEFT JOIN (SELECT * FROM pairs WHERE d <= 3.218) p
  ON s.charge_point_location = p.charge_point_location
GROUP BY ALL""",
    ),
    "scores": (
        ("site_stats",),
        """SELECT charge_point_location, site_category, outages,
  100.0 * (outages - f0) / (CASE WHEN f1 = f0 THEN 1.0 ELSE f1 - f0 END) AS frequency_score,
  100.0 * (avg_duration - d0) / (CASE WHEN d1 = d0 THEN 1.0 ELSE d1 - d0 END) AS duration_score,
  100.0 * (customer_hours - i0) / (CASE WHEN i1 = i0 THEN 1.0 ELSE i1 - i0 END) AS impact_score,
  100.0 * ((CASE WHEN c1 = c0 THEN c0 + 1 ELSE c1 END)
    - COALESCE(std_samp / nullif(avg_duration, 0), 0) - c0)
    / (CASE WHEN c1 = c0 THEN 1.0 ELSE c1 - c0 END) AS consistency_score
FROM site_stats, (SELECT min(outages) AS f0, max(outages) AS f1,
    min(COALESCE(avg_duration, 0)) AS d0, max(COALESCE(avg_duration, 0)) AS d1,
    min(customer_hours) AS i0, max(customer_hours) AS i1,
    min(COALESCE(std_pop / nullif(avg_duration, 0), 0)) AS c0,
    max(COALESCE(std_pop / nullif(avg_duration, 0), 0)) AS c1 FROM site_stats) r
WHERE outages > 0""",
    ),
}


def with_(needs: str, body: str) -> str:
    """``body`` preceded by the named pieces and what they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in _PIECES[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    ctes = ",\n".join(f"{name} AS (\n{_PIECES[name][1].strip()}\n)" for name in order)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def piece(name: str, needs: str, text: str) -> None:
    _PIECES[name] = (tuple(needs.split()), text)
