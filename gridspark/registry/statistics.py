"""Timelines, forecasts, profiles, district reports and map layers (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import district, polygons, profile, risk_query, timelines
from gridspark.operators import site_risk as sr
from gridspark.registry.base import (
    Domain,
    hav,
    piece,
    query,
    rounded,
    stamp,
    text_times,
    with_,
)
from gridspark.registry.rows import tenders
from gridspark.session import materialize

_SITE = "charge_point_location"

piece(
    "monthly",
    "outages",
    """SELECT *, year || '-' || lpad(CAST(month_number AS VARCHAR), 2, '0') AS year_month,
  month_name || ' ' || year AS year_month_label FROM outages""",
)


def _grid(period: str, table: str) -> str:
    cols = ", ".join(f"p.{c}" for c in period.split(", "))
    on = " AND ".join(f"p.{c} = n.{c}" for c in period.split(", "))
    return f"""SELECT {cols}, c.duration_category, COALESCE(n.n, 0) AS n
FROM (SELECT DISTINCT {period} FROM {table} WHERE duration_category IS NOT NULL) p
CROSS JOIN (SELECT DISTINCT duration_category FROM {table} WHERE duration_category IS NOT NULL) c
LEFT JOIN (SELECT {period}, duration_category, count(*) AS n FROM {table} GROUP BY ALL) n
  ON {on} AND c.duration_category = n.duration_category"""


@query("e5_monthly_frequency", with_("monthly", _grid("year_month, year_month_label", "monthly")))
def e5(d: Domain):
    return timelines.monthly_frequency(d.outages)


@query(
    "e6_monthly_customer_hours",
    with_(
        "monthly",
        """SELECT year_month, year_month_label,
  round(avg(total_customer_minutes_lost / 60.0), 6) AS customer_hours_lost FROM monthly GROUP BY 1, 2""",
    ),
)
def e6(d: Domain):
    return rounded(timelines.monthly_customer_hours(d.outages))


@query("e7_yearly_frequency", with_("outages", _grid("year", "outages")))
def e7(d: Domain):
    return timelines.yearly_frequency(d.outages)


@query(
    "e7_yearly_customer_hours",
    with_(
        "outages",
        "SELECT year, round(avg(total_customer_minutes_lost / 60.0), 6) AS customer_hours_lost FROM outages GROUP BY 1",
    ),
)
def e7b(d: Domain):
    return rounded(timelines.yearly_customer_hours(d.outages))


@query(
    "e8_customer_hours_by_category",
    with_(
        "outages",
        """SELECT duration_category, round(sum(total_customer_minutes_lost / 60.0), 3) AS customer_hours_lost
FROM outages WHERE duration_category IS NOT NULL GROUP BY 1""",
    ),
)
def e8(d: Domain):
    return rounded(timelines.customer_hours_by_category(d.outages), 3)


@query(
    "e9_count_by_category",
    with_(
        "outages",
        "SELECT duration_category, count(*) AS n FROM outages WHERE duration_category IS NOT NULL GROUP BY 1",
    ),
)
def e9(d: Domain):
    return timelines.count_by_category(d.outages)


piece(
    "site_months",
    "pairs monthly",
    f"""SELECT p.{_SITE}, m.year_month, m.duration_category, m.total_customer_minutes_lost
FROM pairs p JOIN monthly m ON p.row_id = m.row_id WHERE d <= 3.218""",
)


@query(
    "e10_site_timelines",
    with_(
        "site_months",
        f"""SELECT p.{_SITE}, p.year_month, c.duration_category, COALESCE(n.n, 0) AS n,
  round(h.customer_hours_lost, 5) AS customer_hours_lost
FROM (SELECT DISTINCT {_SITE}, year_month FROM site_months WHERE duration_category IS NOT NULL) p
JOIN (SELECT DISTINCT {_SITE}, duration_category FROM site_months WHERE duration_category IS NOT NULL) c
  ON p.{_SITE} = c.{_SITE}
LEFT JOIN (SELECT {_SITE}, year_month, duration_category, count(*) AS n FROM site_months GROUP BY ALL) n
  ON p.{_SITE} = n.{_SITE} AND p.year_month = n.year_month AND c.duration_category = n.duration_category
JOIN (SELECT {_SITE}, year_month, avg(total_customer_minutes_lost / 60.0) AS customer_hours_lost
  FROM site_months GROUP BY ALL) h ON p.{_SITE} = h.{_SITE} AND p.year_month = h.year_month""",
    ),
)
def e10(d: Domain):
    lines = timelines.site_timelines(d.sites, d.outages)
    return rounded(
        lines.select(_SITE, "year_month", "duration_category", "n", "customer_hours_lost"), 5
    )


piece(
    "months",
    "outages",
    """SELECT strftime(incident_date_time, '%Y-%m') AS ym, sum(customer_affected) AS c,
  sum(total_customer_minutes_lost) / 60.0 AS h, median(duration_hours) AS m
FROM outages GROUP BY 1 ORDER BY 1 DESC LIMIT 2""",
)


@query(
    "e11_month_over_month",
    with_(
        "months",
        """SELECT a.ym AS current_month, b.ym AS previous_month, CAST(a.c AS BIGINT) AS customers_affected,
  round(a.h, 6) AS customer_hours, round(a.m, 6) AS median_duration,
  CAST(b.c AS BIGINT) AS previous_customers_affected, round(b.h, 6) AS previous_customer_hours,
  round(b.m, 6) AS previous_median_duration,
  round((a.c - b.c) * 100.0 / b.c, 6) AS customers_affected_change_pct,
  round((a.h - b.h) * 100.0 / b.h, 6) AS customer_hours_change_pct,
  round((a.m - b.m) * 100.0 / b.m, 6) AS median_duration_change_pct,
  (SELECT direct_cause_category FROM outages WHERE strftime(incident_date_time, '%Y-%m') = a.ym
   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_cause
FROM (SELECT * FROM months ORDER BY ym DESC LIMIT 1) a, (SELECT * FROM months ORDER BY ym LIMIT 1) b""",
    ),
)
def e11(d: Domain):
    return rounded(timelines.month_over_month(d.outages))


_RANK = """CAST(CASE site_category WHEN 'V2X Chargepoint' THEN 1 WHEN 'Building-supplied Charger' THEN 2
  ELSE 3 END AS INTEGER)"""


@query(
    "e12_site_distribution",
    with_(
        "sites",
        f"SELECT site_category, count(*) AS n, {_RANK} AS display_order FROM sites GROUP BY 1",
    ),
)
def e12(d: Domain):
    return timelines.site_distribution(d.sites)


@query(
    "e13_quick_insights",
    with_(
        "outages sites",
        """SELECT round(100.0 * count(CASE WHEN month_name IN ('December', 'January', 'February') THEN 1 END) / count(*), 6) AS winter_pct,
  round(100.0 * count(CASE WHEN duration_hours > 12 THEN 1 END) / count(*), 6) AS long_pct,
  (SELECT count(*) FROM sites WHERE site_category = 'V2X Chargepoint') AS v2x_sites FROM outages""",
    ),
)
def e13(d: Domain):
    return rounded(timelines.quick_insights(d.outages, d.sites))


def _forecast(where: str, threshold: int) -> str:
    return with_(
        "outages",
        f"""SELECT season, round(avg(n), 6) AS historical_mean, round(median(n), 6) AS historical_median,
  round(COALESCE(stddev_samp(n), 0), 6) AS historical_std, min(n) AS historical_min, max(n) AS historical_max,
  count(*) AS years_of_data,
  CAST(greatest(0, round_even(avg(n) - COALESCE(stddev_samp(n), 0), 0)) AS BIGINT) AS forecast_low,
  CAST(round_even(avg(n), 0) AS BIGINT) AS forecast_expected,
  CAST(round_even(avg(n) + COALESCE(stddev_samp(n), 0), 0) AS BIGINT) AS forecast_high
FROM (SELECT y.year, s.season, count(o.row_id) AS n
  FROM (SELECT year FROM outages WHERE {where} GROUP BY 1 HAVING count(*) >= {threshold}) y
  CROSS JOIN (VALUES ('Winter'), ('Spring'), ('Summer'), ('Autumn')) s(season)
  LEFT JOIN (SELECT * FROM outages WHERE {where}) o ON o.year = y.year AND o.season = s.season
  GROUP BY 1, 2) t GROUP BY season""",
    )


@query("e15_seasonal_forecast", _forecast("TRUE", 100))
def e15(d: Domain):
    return rounded(timelines.seasonal_forecast(d.outages))


@query(
    "e16_filtered_forecast",
    "SELECT * FROM ("
    + _forecast(
        "lower(district_name) LIKE '%nation_1%' AND lower(direct_cause_category) LIKE '%high%'", 100
    )
    + ") f WHERE season = 'Winter'",
)
def e16(d: Domain):
    rows = timelines.forecast_filter(d.outages, "nation_1", "HIGH")
    return rounded(timelines.seasonal_forecast(rows, season="Winter"))


@query(
    "e17_season_durations",
    with_(
        "outages",
        """SELECT season, round(median(duration_hours), 6) AS median_duration_hours,
  round(avg(duration_hours), 6) AS mean_duration_hours FROM outages WHERE season IS NOT NULL GROUP BY 1""",
    ),
)
def e17(d: Domain):
    return rounded(timelines.season_durations(d.outages))


@query(
    "e18_season_causes",
    with_(
        "outages",
        """SELECT season, direct_cause_category, n, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY n DESC, direct_cause_category) AS rn
  FROM (SELECT season, direct_cause_category, count(*) AS n FROM outages GROUP BY ALL) a) b WHERE rn <= 5""",
    ),
)
def e18(d: Domain):
    return timelines.season_causes(d.outages)


_PROBS = "round(confidence, 6) AS confidence, round(prob_high, 6) AS prob_high, round(prob_medium, 6) AS prob_medium, round(prob_low, 6) AS prob_low"


@query("e19_merged_models", with_("merged", f"SELECT lat, lon, risk_level, {_PROBS} FROM merged"))
def e19(d: Domain):
    return rounded(risk_query.merge_models(d.stacked))


_TO_CELL = hav("54.05", "-2.8", "lat", "lon")


@query(
    "e20_risk_at_point",
    with_(
        "merged",
        f"""SELECT lat, lon, risk_level, {_PROBS}, round({_TO_CELL}, 6) AS distance_km FROM merged
ORDER BY round({_TO_CELL}, 9), lat, lon LIMIT 10""",
    ),
)
def e20a(d: Domain):
    results, _ = risk_query.risk_at_point(risk_query.merge_models(d.stacked), 54.05, -2.8)
    return rounded(results)


@query(
    "e20_point_summary",
    with_(
        "merged",
        f"""SELECT CAST(10 AS BIGINT) AS cell_count, risk_level AS nearest_risk_level,
  round({_TO_CELL}, 6) AS nearest_distance_km FROM merged ORDER BY round({_TO_CELL}, 9), lat, lon LIMIT 1""",
    ),
)
def e20b(d: Domain):
    _, summary = risk_query.risk_at_point(risk_query.merge_models(d.stacked), 54.05, -2.8)
    return rounded(summary)


def _merged_by_district(d: Domain):
    """Merged cells with districts, stored: the district filters look at them twice."""
    merged = risk_query.merge_models(d.stacked)
    return materialize(risk_query.with_districts(merged, d.raw), "districts")


_RISK_SUMMARY = """count(*) AS total_cells, count(CASE WHEN risk_level = 'High' THEN 1 END) AS high_risk_cells,
  round(avg(confidence), 6) AS avg_confidence,
  round(100.0 * count(CASE WHEN risk_level = 'High' THEN 1 END) / count(*), 6) AS high_risk_pct
FROM merged_d WHERE lower(district_name) = 'nation_7'"""


@query(
    "e20_risk_in_district",
    with_(
        "merged_d",
        f"""SELECT lat, lon, district_name, risk_level, {_PROBS} FROM merged_d
WHERE lower(district_name) = 'nation_7' ORDER BY lat, lon LIMIT 10""",
    ),
)
def e20c(d: Domain):
    results, _ = risk_query.risk_in_district(_merged_by_district(d), "NATION_7")
    return rounded(
        results.select(
            "lat", "lon", "district_name", "risk_level", "confidence", "prob_high", "prob_medium",
            "prob_low",
        )
    )


@query("e20_district_summary", with_("merged_d", f"SELECT {_RISK_SUMMARY}"))
def e20d(d: Domain):
    return rounded(risk_query.district_risk_summary(_merged_by_district(d), "NATION_7"))


_OUTAGE_SUMMARY = """count(*) AS total, round(avg(COALESCE(duration_hours, 0)), 9) AS avg_duration,
  round(sum(customer_affected * COALESCE(duration_hours, 0)), 4) AS total_customer_hours
FROM outages WHERE lower(district_name) = 'nation_7'"""


@query("e21_district_outages", with_("outages", f"SELECT {_OUTAGE_SUMMARY}"))
def e21(d: Domain):
    summary = rounded(district.outage_summary(d.outages, "NATION_7"))
    return summary.withColumn("total_customer_hours", F.round("total_customer_hours", 4))


@query(
    "e21_district_causes",
    with_(
        "outages",
        """SELECT direct_cause_category, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM outages WHERE lower(district_name) = 'nation_7'), 6) AS pct
FROM outages WHERE lower(district_name) = 'nation_7' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""",
    ),
)
def e21b(d: Domain):
    return rounded(district.top_causes(d.outages, "NATION_7"))


piece(
    "near_district",
    "outages sites",
    f"""SELECT * FROM (SELECT s.*, {hav("c.lat", "c.lon", "s.latitude", "s.longitude")} AS dist FROM sites s,
  (SELECT avg(latitude) AS lat, avg(longitude) AS lon FROM outages WHERE lower(district_name) = 'nation_7') c) t
WHERE dist <= 15""",
)


@query(
    "e22_district_sites",
    with_(
        "near_district",
        """SELECT count(*) AS total, count(CASE WHEN site_category = 'V2X Chargepoint' THEN 1 END) AS v2x,
  count(CASE WHEN site_category = 'Building-supplied Charger' THEN 1 END) AS building_supplied,
  count(CASE WHEN site_category = 'Other Chargepoint' THEN 1 END) AS other FROM near_district""",
    ),
)
def e22(d: Domain):
    return district.site_totals(district.sites_near_district(d.sites, d.outages, "NATION_7"))


@query(
    "e23_district_report",
    with_(
        "merged_d near_district",
        f"""SELECT 'NATION_7' AS district, total_cells, high_risk_cells, avg_confidence, high_risk_pct,
  total AS outages, avg_duration, total_customer_hours, sites, v2x_sites,
  'NATION_7 has ' || high_risk_cells || ' high-risk grid cells out of ' || total_cells || ' (' AS text_start
FROM (SELECT {_RISK_SUMMARY}) r, (SELECT {_OUTAGE_SUMMARY}) o,
  (SELECT count(*) AS sites, count(CASE WHEN site_category = 'V2X Chargepoint' THEN 1 END) AS v2x_sites FROM near_district) s""",
    ),
)
def e23(d: Domain):
    report = district.district_report(_merged_by_district(d), d.outages, d.sites, "NATION_7")
    start = F.concat(F.substring_index("summary_text", "(", 1), F.lit("("))
    return (
        rounded(report)
        .withColumn("total_customer_hours", F.round("total_customer_hours", 4))
        .withColumn("text_start", start)
        .drop("summary_text")
    )


# --- profile -----------------------------------------------------------------------------------


@query(
    "e24_overview",
    with_(
        "raw",
        f"""SELECT count(*) AS records, {stamp("min(incident_date_time)")} AS first_incident,
  {stamp("max(incident_date_time)")} AS last_incident, min(latitude) AS lat_min, max(latitude) AS lat_max,
  min(longitude) AS lon_min, max(longitude) AS lon_max FROM raw""",
    ),
)
def e24(d: Domain):
    return text_times(profile.overview(d.raw))


_MISSING = (
    "restoration_date_time", "incident_duration", "primary_substation", "exceptional_event_id",
    "latitude", "longitude", "duration_hours", "duration_category",
)


@query(
    "e25_missing_values",
    with_(
        "outages",
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM outages"
            for c in _MISSING
        ),
    ),
)
def e25(d: Domain):
    return rounded(profile.missing_values(d.outages))


@query(
    "e26_duration_profile",
    with_(
        "outages",
        """SELECT count(duration_hours) AS n, round(avg(duration_hours), 6) AS mean,
  round(stddev_samp(duration_hours), 6) AS std, round(min(duration_hours), 6) AS min,
  round(max(duration_hours), 6) AS max, round(quantile_cont(duration_hours, 0.25), 6) AS p25,
  round(median(duration_hours), 6) AS median, round(quantile_cont(duration_hours, 0.75), 6) AS p75,
  round(quantile_cont(duration_hours, 0.95), 6) AS p95, round(quantile_cont(duration_hours, 0.99), 6) AS p99
FROM outages""",
    ),
)
def e26(d: Domain):
    return rounded(profile.duration_profile(d.outages))


_ORDER = {
    "season": "list_position(['Winter', 'Spring', 'Summer', 'Autumn'], season)",
    "month_name": "month_number",
    "duration_category": "list_position(['x < 3 hours', '3 ≤ x < 6 hours', '6 ≤ x < 12 hours', 'x > 12 hours'], duration_category)",
}


def _counts(field: str, limit: str = "") -> str:
    order = _ORDER.get(field, "CAST(NULL AS INTEGER)")
    return f"""SELECT * FROM (SELECT '{field}' AS field, CAST({field} AS VARCHAR) AS value, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM outages), 6) AS pct, CAST({order} AS INTEGER) AS display_order
FROM outages WHERE {field} IS NOT NULL GROUP BY ALL ORDER BY n DESC, value {limit}) x"""


@query(
    "e27_value_counts",
    with_(
        "outages",
        "\nUNION ALL ".join(
            _counts(f, "LIMIT 10" if f == "district_name" else "") for f in profile.COUNTED_FIELDS
        ),
    ),
)
def e27(d: Domain):
    return rounded(profile.value_counts(d.outages, top={"district_name": 10}))


@query(
    "e28_customer_impact",
    with_(
        "outages",
        """SELECT CAST(sum(total_customer_minutes_lost) AS DOUBLE) AS total,
  round(avg(total_customer_minutes_lost), 6) AS mean, CAST(max(total_customer_minutes_lost) AS DOUBLE) AS max,
  CAST(median(total_customer_minutes_lost) AS DOUBLE) AS median FROM outages""",
    ),
)
def e28(d: Domain):
    return rounded(profile.customer_impact(d.outages))


@query(
    "e29_causes_of_long_outages",
    with_(
        "outages",
        """SELECT percentile, round(threshold, 6) AS threshold, direct_cause_category, n, CAST(rn AS INTEGER) AS rank,
  outages, round(100.0 * n / outages, 6) AS pct
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY percentile ORDER BY n DESC, direct_cause_category) AS rn,
    CAST(sum(n) OVER (PARTITION BY percentile) AS BIGINT) AS outages
  FROM (SELECT percentile, threshold, direct_cause_category, count(*) AS n FROM outages,
      (SELECT p AS percentile, CASE p WHEN 90 THEN a WHEN 95 THEN b ELSE c END AS threshold
       FROM (VALUES (90), (95), (99)) v(p), (SELECT quantile_cont(duration_hours, 0.9) AS a,
         quantile_cont(duration_hours, 0.95) AS b, quantile_cont(duration_hours, 0.99) AS c FROM outages) q) t
    WHERE duration_hours >= threshold GROUP BY ALL) g) h WHERE rn <= 5""",
    ),
)
def e29(d: Domain):
    return rounded(profile.causes_of_long_outages(d.outages))


@query(
    "e30_cause_by_month",
    with_(
        "outages",
        """SELECT m.month_name, m.month, t.direct_cause_category, count(o.row_id) AS n
FROM (SELECT DISTINCT month_name, month_number AS month FROM outages) m
CROSS JOIN (SELECT direct_cause_category FROM outages GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) t
LEFT JOIN outages o ON o.month_name = m.month_name AND o.direct_cause_category = t.direct_cause_category
GROUP BY 1, 2, 3""",
    ),
)
def e30(d: Domain):
    return profile.cause_by_month(d.outages).select(
        "month_name", "month", "direct_cause_category", "n"
    )


piece(
    "chi",
    "outages",
    """SELECT CAST(sum(o) AS BIGINT) AS n, sum(power(o - e, 2) / e) AS chi2, count(DISTINCT month_name) AS nr,
  count(DISTINCT cause) AS nc, (count(DISTINCT month_name) - 1) * (count(DISTINCT cause) - 1) AS dof
FROM (SELECT a.month_name, b.cause, COALESCE(c.n, 0) AS o, a.n * b.n / CAST(t.n AS DOUBLE) AS e
  FROM (SELECT month_name, count(*) AS n FROM outages GROUP BY 1) a
  CROSS JOIN (SELECT direct_cause_category AS cause, count(*) AS n FROM outages GROUP BY 1) b
  CROSS JOIN (SELECT count(*) AS n FROM outages) t
  LEFT JOIN (SELECT month_name, direct_cause_category AS cause, count(*) AS n FROM outages GROUP BY 1, 2) c
    ON a.month_name = c.month_name AND b.cause = c.cause) x""",
)


@query(
    "e31_independence_test",
    with_(
        "chi",
        """SELECT n, round(chi2, 4) AS chi2, dof, round(v, 4) AS cramers_v,
  CASE WHEN v < 0.1 THEN 'Weak' WHEN v < 0.3 THEN 'Small' WHEN v < 0.5 THEN 'Medium' ELSE 'Strong' END AS effect
FROM (SELECT *, sqrt(chi2 / (n * least(nr - 1, nc - 1))) AS v FROM chi) t""",
    ),
)
def e31(d: Domain):
    return rounded(profile.independence_test(d.outages), 4)


@query(
    "e31_p_value",
    with_(
        "chi",
        """SELECT dof, round(chi2, 4) AS chi2, round(p, 9) AS p_value, p < 0.05 AS significant FROM (
  SELECT *, greatest(0.0, 1.0 - list_sum(list_transform(range(0, 20000),
    lambda n: exp((dof / 2.0 + n) * ln(chi2 / 2.0) - chi2 / 2.0 - lgamma(dof / 2.0 + n + 1))))) AS p
  FROM chi) t""",
    ),
)
def e31p(d: Domain):
    """The SQL side sums the power series; ours takes the continued fraction above the mean."""
    test = profile.independence_p_value(d.outages)
    return test.select(
        "dof", F.round("chi2", 4).alias("chi2"), (F.round("p_value", 9) + F.lit(0.0)).alias("p_value"), "significant"
    )


@query(
    "e33_duration_histogram",
    with_(
        "outages",
        """SELECT CAST(least(49, floor((duration_hours - lo) * 50 / (hi - lo))) AS INTEGER) AS bin,
  round(min(lo) + least(49, floor((duration_hours - lo) * 50 / (hi - lo))) * min(hi - lo) / 50, 6) AS bin_start,
  round(min(lo) + (least(49, floor((duration_hours - lo) * 50 / (hi - lo))) + 1) * min(hi - lo) / 50, 6) AS bin_end,
  count(*) AS n
FROM outages, (SELECT min(duration_hours) AS lo, max(duration_hours) AS hi FROM outages) e
WHERE duration_hours IS NOT NULL GROUP BY least(49, floor((duration_hours - lo) * 50 / (hi - lo)))""",
    ),
)
def e33(d: Domain):
    return rounded(profile.histogram(d.outages, "duration_hours"))


@query(
    "e33_nearby_histogram",
    with_(
        "site_stats",
        """SELECT CAST(least(19, floor(outages * 20.0 / hi)) AS INTEGER) AS bin, count(*) AS n
FROM site_stats, (SELECT max(outages) AS hi FROM site_stats) e GROUP BY 1""",
    ),
)
def e33b(d: Domain):
    stats = sr.site_stats(d.sites, d.outages)
    return profile.histogram(stats, "outages", 20).select("bin", "n")


@query(
    "e35_tender_counts",
    with_("regions", "SELECT 2 * count(*) AS polygons, count(DISTINCT name) AS substations FROM regions"),
)
def e35(d: Domain):
    return polygons.tender_counts(tenders(d))


@query(
    "e35_tender_breakdown",
    with_(
        "regions",
        """SELECT 'geometry_type' AS field, CASE WHEN region_id % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS value, 2 * count(*) AS n
FROM regions GROUP BY 2
UNION ALL SELECT 'need_type', CASE WHEN region_id % 2 = 0 THEN 'Variable Availability'
  ELSE 'Variable Availability + Operational Utilisation' END, 2 * count(*) FROM regions GROUP BY 2
UNION ALL SELECT 'voltage_of_connection_kv', v, count(*) FROM regions CROSS JOIN (VALUES ('11'), ('33')) t(v) GROUP BY 2""",
    ),
)
def e35b(d: Domain):
    return polygons.tender_breakdown(tenders(d))


@query(
    "e37_heat_points",
    with_(
        "outages",
        """SELECT latitude, longitude, round(duration_hours, 6) AS weight FROM outages
WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
    ),
)
def e37(d: Domain):
    return rounded(profile.heat_points(d.outages))


@query(
    "e37_binned_heat_points",
    with_(
        "outages",
        """SELECT round(round_even(latitude / 0.02, 0) * 0.02, 6) AS latitude,
  round(round_even(longitude / 0.02, 0) * 0.02, 6) AS longitude, round(sum(duration_hours), 5) AS weight,
  count(*) AS n FROM outages WHERE latitude IS NOT NULL GROUP BY 1, 2""",
    ),
)
def e37b(d: Domain):
    binned = profile.binned_heat_points(d.outages)
    return rounded(rounded(binned, 5))


@query(
    "e38_risk_layer",
    with_(
        "preds",
        """SELECT lat, lon, round(lat - 0.01, 6) AS south, round(lat + 0.01, 6) AS north,
  round(lon - 0.01, 6) AS west, round(lon + 0.01, 6) AS east,
  printf('#%02x%02x%02x', CAST(trunc(least(255.0, prob_high * 255 + prob_medium * 200)) AS INTEGER),
    CAST(trunc(least(255.0, (1 - prob_high) * 200 + prob_medium * 100)) AS INTEGER),
    CAST(trunc(greatest(0.0, (1 - prob_high - prob_medium) * 150)) AS INTEGER)) AS color,
  round(least(0.8, 0.4 + 0.4 * prob_high + 0.15 * prob_medium), 6) AS opacity, risk_level,
  round(confidence, 6) AS confidence
FROM preds WHERE risk_level <> 'Low' AND confidence >= 0.5""",
    ),
)
def e38(d: Domain):
    return rounded(risk_query.risk_layer(d.cells, 0.5))


@query(
    "e39_chargepoint_layer",
    with_(
        "site_stats",
        f"""SELECT {_SITE}, site_category, latitude, longitude, outages,
  round(COALESCE(avg_duration, 0), 9) AS avg_duration, {stamp("latest_outage")} AS latest_outage,
  CAST(greatest(8, least(15, outages + 5)) AS INTEGER) AS marker_size
FROM site_stats WHERE site_category IN ('V2X Chargepoint', 'Other Chargepoint')""",
    ),
)
def e39(d: Domain):
    layer = district.chargepoint_layer(
        d.sites, d.outages, ["V2X Chargepoint", "Other Chargepoint"]
    )
    return text_times(rounded(layer))


@query(
    "e40_incident_rows",
    with_(
        "incidents",
        """SELECT incident_num, incident_status, customers_off_supply, customers_affected,
  COALESCE(strftime(estimated_restoration_time, '%d %b %Y, %H:%M'), 'TBC') AS restoration,
  incident_num || ' - ' || incident_type AS tooltip, latitude, longitude FROM incidents""",
    ),
)
def e40(d: Domain):
    return district.incident_rows(d.incidents)


@query(
    "e41_region_cards",
    with_(
        "regions",
        """SELECT name AS substation_name, '11' AS voltage_of_connection_kv,
  CASE WHEN region_id % 2 = 0 THEN 'Variable Availability' ELSE 'Variable Availability + Operational Utilisation' END
    || ' | ' || CASE k WHEN 0 THEN '2026-04-01' ELSE '2026-10-01' END || ' | '
    || CASE k WHEN 0 THEN '—' ELSE 'P' || region_id END AS heading
FROM regions CROSS JOIN (VALUES (0), (1)) p(k)""",
    ),
)
def e41(d: Domain):
    t = tenders(d)
    cards = polygons.region_cards(t).select("substation_name", "voltage_of_connection_kv")
    return cards.join(
        polygons.contract_rows(t).select("substation_name", "heading"), "substation_name"
    )
