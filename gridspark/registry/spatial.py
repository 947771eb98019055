"""Spatial joins (D) and outages around sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import district, polygons, risk_query, site_risk, spatial
from gridspark.registry.base import (
    Domain,
    deg,
    hav,
    piece,
    query,
    rounded,
    stamp,
    text_times,
    with_,
)
from gridspark.registry.rows import tenders

_REF = "incident_reference_number"
_SITE = "charge_point_location"
_POINT = hav("54.5", "-2.75", "latitude", "longitude")


@query(
    "d1_haversine",
    with_("raw", f"SELECT {_REF}, round({_POINT}, 6) AS distance_km FROM raw"),
)
def d1(d: Domain):
    km = geo.haversine_km(F.lit(54.5), F.lit(-2.75), F.col("latitude"), F.col("longitude"))
    return rounded(d.raw.select(_REF, km.alias("distance_km")))


@query(
    "d2_outages_within_radius",
    with_(
        "raw",
        f"SELECT {_REF}, round({_POINT}, 6) AS distance_km FROM raw WHERE {_POINT} <= 12.5",
    ),
)
def d2(d: Domain):
    near = spatial.within_radius(d.raw, 54.5, -2.75, 12.5, distance="distance_km")
    return rounded(near.select(_REF, "distance_km"))


@query(
    "d3_radius_pairs",
    with_(
        "pairs",
        f"SELECT {_SITE}, row_id, round(d, 6) AS distance_km FROM pairs WHERE d <= 3.218",
    ),
)
def d3(d: Domain):
    right = d.raw.select(
        "row_id", F.col("latitude").alias("olat"), F.col("longitude").alias("olon")
    )
    pairs = spatial.radius_join(
        d.sites, right, 3.218, ("latitude", "longitude"), ("olat", "olon")
    )
    return rounded(pairs.select(_SITE, "row_id", "distance_km"))


@query(
    "d4_cell_district",
    with_("cell_districts", "SELECT ci, cj, district_name FROM cell_districts"),
)
def d4a(d: Domain):
    """District of the outage nearest to every cell."""
    return risk_query.with_districts(d.cells, d.raw).select("ci", "cj", "district_name")


def _nearest(left: str, right: str, part: str, order: str, dist: str, cols: str) -> str:
    return f"""SELECT {cols} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {part}
    ORDER BY round(dist, 9), {order}) AS rn FROM (SELECT *, {dist} AS dist FROM {left}, {right}) a) b"""


_SITE_CELL = hav("latitude", "longitude", "lat", "lon")


@query(
    "d4_site_risk_cell",
    with_(
        "sites preds",
        _nearest("sites", "preds", _SITE, "ci, cj", _SITE_CELL,
                 f"{_SITE}, ci, cj, risk_level, round(dist, 6) AS distance_km") + " WHERE rn = 1",
    ),
)
def d4b(d: Domain):
    """Risk cell nearest to every site, however far away the site is."""
    right = d.cells.select("lat", "lon", "ci", "cj", "risk_level")
    found = spatial.nearest_join(
        d.sites, right, ("latitude", "longitude"), ("lat", "lon"), ["ci", "cj"]
    )
    return rounded(found.select(_SITE, "ci", "cj", "risk_level", "distance_km"))


piece(
    "stations",
    "raw",
    """SELECT primary_substation, avg(latitude) AS slat, avg(longitude) AS slon FROM raw
WHERE primary_substation IS NOT NULL AND latitude IS NOT NULL GROUP BY 1""",
)


@query(
    "d4_cell_substation",
    with_(
        "cells stations",
        f"""SELECT ci, cj, round(min({hav("ci / 50.0", "cj / 50.0", "slat", "slon")}), 5) AS distance_km
FROM cells, stations GROUP BY 1, 2""",
    ),
)
def d4c(d: Domain):
    """Distance from every cell to the nearest substation."""
    stations = (
        spatial.located(d.raw)
        .where(F.col("primary_substation").isNotNull())
        .groupBy("primary_substation")
        .agg(F.avg("latitude").alias("slat"), F.avg("longitude").alias("slon"))
    )
    cells = d.cells.select("ci", "cj", "lat", "lon")
    near = spatial.nearest_join(
        cells, stations, ("lat", "lon"), ("slat", "slon"), ["primary_substation"]
    )
    return rounded(near.select("ci", "cj", "distance_km"), 5)


@query(
    "d4_outage_site_name",
    with_(
        "raw sites",
        f"""SELECT row_id, 'near ' || {_SITE} AS place FROM (
  SELECT r.row_id, s.{_SITE}, ROW_NUMBER() OVER (PARTITION BY r.row_id ORDER BY
    round({hav("r.latitude", "r.longitude", "s.latitude", "s.longitude")}, 9), s.{_SITE}) AS rn
  FROM (SELECT * FROM raw WHERE latitude IS NOT NULL) r, sites s) t WHERE rn = 1
UNION ALL SELECT row_id, NULL FROM raw WHERE latitude IS NULL""",
    ),
)
def d4d(d: Domain):
    """Name of the site nearest to every outage (the big table on the left)."""
    right = d.sites.select(
        _SITE, F.col("latitude").alias("slat"), F.col("longitude").alias("slon")
    )
    near = spatial.nearest_join(
        d.raw.select("row_id", "latitude", "longitude"), right, ("latitude", "longitude"),
        ("slat", "slon"), [_SITE],
    )
    return near.select("row_id", F.concat(F.lit("near "), F.col(_SITE)).alias("place"))


@query(
    "d5_nearest_cells_to_point",
    with_(
        "preds",
        f"""SELECT ci, cj, round({hav("54.5", "-2.75", "lat", "lon")}, 6) AS distance_km FROM preds
ORDER BY round({hav("54.5", "-2.75", "lat", "lon")}, 9), ci, cj LIMIT 10""",
    ),
)
def d5a(d: Domain):
    near = spatial.nearest_to_point(d.cells, 54.5, -2.75, 10, ["ci", "cj"], at=("lat", "lon"))
    return rounded(near.select("ci", "cj", "distance_km"))


@query(
    "d5_five_nearest_sites",
    with_(
        "preds sites",
        _nearest("preds", "sites", "ci, cj", _SITE, _SITE_CELL,
                 f"ci, cj, {_SITE}, CAST(rn AS INTEGER) AS rank, round(dist, 6) AS distance_km")
        + " WHERE rn <= 5",
    ),
)
def d5b(d: Domain):
    right = d.sites.select(
        _SITE, F.col("latitude").alias("slat"), F.col("longitude").alias("slon")
    )
    near = spatial.nearest_join(
        d.cells.select("ci", "cj", "lat", "lon"), right, ("lat", "lon"), ("slat", "slon"),
        [_SITE], k=5,
    )
    return rounded(near.select("ci", "cj", _SITE, "rank", "distance_km"))


piece(
    "cell_pairs",
    "sites preds",
    f"""SELECT s.{_SITE}, s.latitude, s.longitude, p.*, {hav("s.latitude", "s.longitude", "p.lat", "p.lon")} AS d
FROM sites s, preds p""",
)


@query(
    "d6_risk_around_sites",
    with_(
        "cell_pairs",
        f"""SELECT {_SITE}, round(min(d), 6) AS nearest_risk_cell_km,
  arg_min(risk_level, (round(d, 9), ci, cj)) AS risk_level,
  round(arg_min(confidence, (round(d, 9), ci, cj)), 6) AS confidence,
  round(avg(prob_high), 6) AS avg_prob_high_nearby,
  count(CASE WHEN risk_level = 'High' THEN 1 END) AS high_risk_cells
FROM cell_pairs WHERE d <= 10 GROUP BY 1""",
    ),
)
def d6(d: Domain):
    from gridspark.operators.recommend import cross_reference_risk

    found = cross_reference_risk(d.sites, d.cells, 10.0)
    rows = spatial.attach_by_position(d.sites, found, how="inner")
    return rounded(
        rows.select(
            _SITE, "nearest_risk_cell_km", "risk_level", "confidence", "avg_prob_high_nearby",
            "high_risk_cells",
        )
    )


_NEAR3 = """EXISTS (SELECT 1 FROM (SELECT * FROM sites WHERE {cond}) s
    WHERE abs(s.latitude - p.lat) < 0.05 AND {dist} {op} 3.0)"""
_D7 = hav("p.lat", "p.lon", "s.latitude", "s.longitude")


@query(
    "d7_semi_anti",
    with_(
        "preds sites",
        f"""SELECT 'plain near' AS test, ci, cj FROM preds p
WHERE {_NEAR3.format(cond="site_category <> 'V2X Chargepoint'", dist=_D7, op="<=")}
UNION ALL SELECT 'no v2x', ci, cj FROM preds p
WHERE NOT {_NEAR3.format(cond="site_category = 'V2X Chargepoint'", dist=_D7, op="<")}
UNION ALL SELECT 'no site', ci, cj FROM preds p
WHERE NOT {_NEAR3.format(cond="TRUE", dist=_D7, op="<")}""",
    ),
)
def d7(d: Domain):
    cells, at, site_at = d.cells.select("ci", "cj", "lat", "lon"), ("lat", "lon"), spatial.LATLON
    v2x = F.col("site_category") == "V2X Chargepoint"

    def tagged(df, name):
        return df.select(F.lit(name).alias("test"), "ci", "cj")

    near = spatial.radius_exists(cells, d.sites.where(~v2x), 3.0, at, site_at)
    no_v2x = spatial.radius_exists(
        cells, d.sites.where(v2x), 3.0, at, site_at, strict=True, negate=True
    )
    nothing = spatial.radius_exists(cells, d.sites, 3.0, at, site_at, strict=True, negate=True)
    return (
        tagged(near, "plain near")
        .unionByName(tagged(no_v2x, "no v2x"))
        .unionByName(tagged(nothing, "no site"))
    )


_TILE = "{x} >= x0 AND {x} < x1 AND {y} >= y0 AND {y} < y1"


@query(
    "d8_point_in_polygon",
    with_(
        "regions",
        f"SELECT name FROM regions WHERE {_TILE.format(x='-2.75', y='54.5')} ORDER BY name LIMIT 1",
    ),
)
def d8(d: Domain):
    return polygons.region_at_point(d.regions, 54.5, -2.75).select("name")


piece(
    "tagged",
    "raw regions",
    f"""SELECT raw.*, name AS region FROM raw LEFT JOIN regions
  ON {_TILE.format(x="longitude", y="latitude")}""",
)


@query("d9_region_tags", with_("tagged", f"SELECT {_REF}, region FROM tagged"))
def d9(d: Domain):
    return polygons.tag_regions(d.raw, d.regions).select(_REF, "region")


@query(
    "d9_tag_summary",
    with_(
        "tagged",
        """SELECT count(*) AS processed, count(latitude) AS valid_coordinates, count(region) AS tagged,
  count(latitude) - count(region) AS untagged, count(DISTINCT region) AS regions_found FROM tagged""",
    ),
)
def d9s(d: Domain):
    return polygons.tag_summary(polygons.tag_regions(d.raw, d.regions))


@query(
    "d10_planar_buffer_stats",
    with_(
        "sites outages",
        f"""SELECT s.{_SITE}, count(o.row_id) AS outages, round(avg(o.duration_hours), 9) AS avg_duration,
  {stamp("max(o.incident_date_time)")} AS latest_outage
FROM sites s LEFT JOIN outages o ON 6371.0 * radians({deg("s.latitude", "s.longitude", "o.latitude", "o.longitude")}) <= 3.218
GROUP BY 1""",
    ),
)
def d10(d: Domain):
    stats = site_risk.site_stats(d.sites, d.outages, metric="planar_rad")
    return text_times(
        rounded(stats.select(_SITE, "outages", "avg_duration", "latest_outage"))
    )


_PLACE = deg("54.5", "-2.75", "latitude", "longitude")


@query(
    "d11_place_outages",
    with_(
        "outages",
        f"""SELECT count(CASE WHEN g < 5 / 111.0 THEN 1 END) AS within_5km,
  count(CASE WHEN g < 10 / 111.0 THEN 1 END) AS within_10km,
  count(CASE WHEN g < 20 / 111.0 THEN 1 END) AS within_20km,
  count(CASE WHEN g < 0.05 THEN 1 END) AS close_outages,
  round(avg(CASE WHEN g < 0.05 THEN duration_hours END), 9) AS avg_duration,
  round(avg(CASE WHEN g < 0.05 THEN customer_affected END), 6) AS avg_customers
FROM (SELECT *, {_PLACE} AS g FROM outages) t""",
    ),
)
def d11a(d: Domain):
    return rounded(district.place_outages(d.outages, 54.5, -2.75))


@query(
    "d11_place_districts",
    with_(
        "outages",
        f"""SELECT district_name, count(*) AS n FROM outages WHERE {_PLACE} < 0.05
GROUP BY 1 ORDER BY n DESC, district_name LIMIT 5""",
    ),
)
def d11b(d: Domain):
    return district.place_districts(d.outages, 54.5, -2.75)


@query(
    "d11_nearest_in_degrees",
    with_(
        "preds sites",
        f"""SELECT * FROM (SELECT 'cell' AS kind, ci || '/' || cj AS name, round(111.0 * {deg("54.5", "-2.75", "lat", "lon")}, 6) AS distance_km
  FROM preds ORDER BY round({deg("54.5", "-2.75", "lat", "lon")}, 9), ci, cj LIMIT 5) a
UNION ALL SELECT * FROM (SELECT 'site' AS kind, {_SITE} AS name, round(111.0 * {_PLACE}, 6) AS distance_km
  FROM sites ORDER BY round({_PLACE}, 9), {_SITE} LIMIT 5) b""",
    ),
)
def d11c(d: Domain):
    cells = district.nearest_in_degrees(d.cells, 54.5, -2.75, 5, ["ci", "cj"], ("lat", "lon"))
    sites = district.nearest_in_degrees(d.sites, 54.5, -2.75, 5, [_SITE], spatial.LATLON)
    a = cells.select(
        F.lit("cell").alias("kind"),
        F.concat_ws("/", F.col("ci").cast("string"), F.col("cj").cast("string")).alias("name"),
        "distance_km",
    )
    b = sites.select(F.lit("site").alias("kind"), F.col(_SITE).alias("name"), "distance_km")
    return rounded(a.unionByName(b))


@query(
    "d12_dissolve",
    with_(
        "regions",
        """SELECT name AS substation_name, CAST(2 AS BIGINT) AS contracts,
  '2026-04-01' AS delivery_start_date, 'P' || region_id AS period, CAST(1 AS BIGINT) AS parts FROM regions""",
    ),
)
def d12(d: Domain):
    t = tenders(d)
    parts = polygons.substation_parts(t).groupBy(F.col("name").alias("substation_name"))
    counted = parts.agg(F.count(F.lit(1)).alias("parts"))
    return polygons.dissolve(t).join(counted, "substation_name").select(
        "substation_name", "contracts", "delivery_start_date", "period", "parts"
    )


@query(
    "d12_contracts_in_order",
    with_(
        "regions",
        """SELECT CAST(ROW_NUMBER() OVER (ORDER BY substation_name, delivery_start_date) AS BIGINT) AS position,
  substation_name, delivery_start_date FROM (SELECT name AS substation_name,
  CASE k WHEN 0 THEN '2026-04-01' ELSE '2026-10-01' END AS delivery_start_date
  FROM regions CROSS JOIN (VALUES (0), (1)) p(k)) t""",
    ),
)
def d12b(d: Domain):
    ordered = polygons.contracts_in_order(tenders(d)).select(
        "substation_name", "delivery_start_date"
    )
    # the position shows the order; the tender table has two rows per nation
    from pyspark.sql import Window

    by_time = Window.partitionBy(F.lit(0)).orderBy("substation_name", "delivery_start_date")
    return ordered.withColumn("position", F.row_number().over(by_time).cast("bigint"))


@query(
    "d12_tagged_by_substation",
    with_("tagged", "SELECT region, count(*) AS n FROM tagged WHERE region IS NOT NULL GROUP BY 1"),
)
def d12c(d: Domain):
    """Outages inside the dissolved shapes, once per substation."""
    pairs = polygons.polygon_pairs(d.raw, polygons.substation_parts(tenders(d))).distinct()
    hit = spatial.attach_by_position(d.raw, pairs, how="inner")
    return hit.groupBy(F.col("name").alias("region")).agg(F.count(F.lit(1)).alias("n"))


_W = "1.0 / (d + 0.001)"


@query(
    "d13_interpolated_risk",
    with_(
        "cell_pairs",
        f"""SELECT {_SITE}, round(h, 6) AS prob_high, round(m, 6) AS prob_medium, round(l, 6) AS prob_low,
  CASE WHEN h >= m AND h >= l THEN 'High' WHEN m >= l THEN 'Medium' ELSE 'Low' END AS risk_level,
  round(greatest(h, m, l), 6) AS confidence
FROM (SELECT {_SITE}, sum(prob_high * {_W}) / sum({_W}) AS h, sum(prob_medium * {_W}) / sum({_W}) AS m,
    sum(prob_low * {_W}) / sum({_W}) AS l FROM cell_pairs WHERE d <= 5 GROUP BY 1) t""",
    ),
)
def d13(d: Domain):
    return rounded(risk_query.interpolated_risk(d.sites, d.cells, _SITE, 5.0))


@query(
    "d14_sites_near_district",
    with_(
        "outages sites",
        f"""SELECT {_SITE}, site_category, round(dist, 6) AS distance_km FROM (
  SELECT s.*, {hav("c.lat", "c.lon", "s.latitude", "s.longitude")} AS dist FROM sites s,
    (SELECT avg(latitude) AS lat, avg(longitude) AS lon FROM outages WHERE lower(district_name) = 'nation_7') c) t
WHERE dist <= 15""",
    ),
)
def d14(d: Domain):
    near = district.sites_near_district(d.sites, d.outages, "nation_7")
    return rounded(near.select(_SITE, "site_category", "distance_km"))


@query(
    "d15_buffer_overlap",
    with_(
        "pairs",
        """SELECT row_id, count(*) AS sites_in_reach FROM pairs WHERE d <= 3.218
GROUP BY 1 HAVING count(*) >= 2""",
    ),
)
def d15(d: Domain):
    return site_risk.overlapping_outages(d.sites, d.raw).select("row_id", "sites_in_reach")


# --- outages around sites ----------------------------------------------------------------------


@query(
    "e1_site_summary",
    with_(
        "site_stats",
        f"""SELECT {_SITE}, site_category, outages, round(COALESCE(avg_duration, 0), 9) AS avg_duration,
  round(customer_hours, 6) AS customer_hours,
  CASE WHEN outages > 20 THEN 'High Risk' WHEN outages > 10 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_label
FROM site_stats""",
    ),
)
def e1(d: Domain):
    return rounded(site_risk.site_summary(site_risk.site_stats(d.sites, d.outages)))


_CV = "COALESCE(std_pop / nullif(avg_duration, 0), 0)"


@query(
    "e2_metric_ranges",
    with_(
        "site_stats",
        f"""SELECT CAST(min(outages) AS DOUBLE) AS freq_min, CAST(max(outages) AS DOUBLE) AS freq_max,
  round(min(COALESCE(avg_duration, 0)), 6) AS duration_min, round(max(COALESCE(avg_duration, 0)), 6) AS duration_max,
  round(min(customer_hours), 6) AS impact_min, round(max(customer_hours), 6) AS impact_max,
  round(min({_CV}), 6) AS cv_min, round(max({_CV}), 6) AS cv_max FROM site_stats""",
    ),
)
def e2(d: Domain):
    return rounded(site_risk.metric_ranges(site_risk.site_stats(d.sites, d.outages)))


_SCORES = ("frequency_score", "duration_score", "impact_score", "consistency_score")
_OVERALL = "(" + " + ".join(_SCORES) + ") / 4"


@query(
    "e3_risk_scores",
    with_(
        "scores",
        f"SELECT {_SITE}, site_category, outages, "
        + ", ".join(f"round({c}, 5) AS {c}" for c in _SCORES)
        + f", round({_OVERALL}, 5) AS overall_score FROM scores",
    ),
)
def e3(d: Domain):
    return rounded(site_risk.risk_scores(site_risk.site_stats(d.sites, d.outages)), 5)


_LEVEL = """CASE WHEN outages = 0 THEN 'Unknown' WHEN outages > 20 AND avg_duration > 8 THEN 'Critical'
  WHEN outages > 10 OR avg_duration > 4 THEN 'High' WHEN outages > 5 THEN 'Medium' ELSE 'Low' END"""


@query(
    "e4_rule_based_levels",
    with_(
        "site_stats",
        f"""SELECT {_SITE}, {_LEVEL} AS risk_level,
  CAST(CASE WHEN outages = 0 THEN 1 ELSE 2 + CASE WHEN {_LEVEL} = 'Low' THEN 0 ELSE 1 END
    + CASE WHEN winter_outages > outages * 0.4 THEN 1 ELSE 0 END END AS INTEGER) AS notes,
  CASE WHEN outages = 0 THEN NULL WHEN site_category = 'V2X Chargepoint'
    THEN 'High - Already equipped for bidirectional power flow'
    ELSE 'Potential - Retrofit could provide grid benefits' END AS v2x_value,
  outages > 0 AND winter_outages > outages * 0.4 AS winter_note
FROM site_stats""",
    ),
)
def e4(d: Domain):
    rules = site_risk.rule_based_levels(site_risk.site_stats(d.sites, d.outages))
    return rules.select(
        _SITE,
        "risk_level",
        F.size("recommendations").alias("notes"),
        "v2x_value",
        F.exists("recommendations", lambda t: t.startswith("High winter")).alias("winter_note"),
    )


piece(
    "near_counts",
    "sites pairs",
    f"""SELECT s.*, count(p.row_id) AS outages_within_radius FROM sites s
LEFT JOIN (SELECT * FROM pairs WHERE d <= 3.218688) p ON s.{_SITE} = p.{_SITE} GROUP BY ALL""",
)


@query(
    "e14_outages_near_sites",
    with_(
        "near_counts",
        f"SELECT {_SITE}, site_category, latitude, longitude, outages_within_radius FROM near_counts",
    ),
)
def e14(d: Domain):
    return site_risk.busiest_sites(site_risk.count_outages_near_sites(d.sites, d.raw))


@query(
    "e14_busiest_sites",
    with_(
        "near_counts",
        f"""SELECT {_SITE}, outages_within_radius FROM near_counts
ORDER BY outages_within_radius DESC, {_SITE} LIMIT 10""",
    ),
)
def e14t(d: Domain):
    counts = site_risk.count_outages_near_sites(d.sites, d.raw)
    return site_risk.busiest_sites(counts, 10).select(_SITE, "outages_within_radius")


@query(
    "e14_summary",
    with_(
        "near_counts",
        """SELECT count(*) AS total_sites, count(CASE WHEN outages_within_radius > 0 THEN 1 END) AS sites_with_outages,
  count(CASE WHEN outages_within_radius = 0 THEN 1 END) AS sites_without_outages,
  CAST(sum(outages_within_radius) AS BIGINT) AS total_outages_near_sites,
  round(avg(outages_within_radius), 6) AS avg_outages_per_site, CAST(3.219 AS DOUBLE) AS radius_km,
  CAST(2.0 AS DOUBLE) AS radius_miles FROM near_counts""",
    ),
)
def e14s(d: Domain):
    return rounded(
        site_risk.near_sites_summary(site_risk.count_outages_near_sites(d.sites, d.raw))
    )


@query(
    "e34_nearby_by_category",
    with_(
        "site_stats",
        """SELECT site_category, count(*) AS sites, count(CASE WHEN outages > 0 THEN 1 END) AS sites_with_outages,
  round(avg(outages), 6) AS mean_outages, round(avg(hours), 6) AS mean_hours,
  CAST(CASE site_category WHEN 'V2X Chargepoint' THEN 1 WHEN 'Building-supplied Charger' THEN 2 ELSE 3 END AS INTEGER) AS category_rank
FROM site_stats GROUP BY 1""",
    ),
)
def e34(d: Domain):
    return rounded(site_risk.nearby_by_category(site_risk.site_stats(d.sites, d.outages)))


@query(
    "h12_weighted_priority",
    with_(
        "scores",
        f"""SELECT {_SITE}, site_category, round((0.30 * frequency_score + 0.25 * duration_score + 0.35 * impact_score
  + 0.10 * consistency_score) * CASE WHEN site_category <> 'V2X Chargepoint' THEN 1.2 ELSE 1.0 END
  * CASE WHEN outages > 5 THEN 1.1 ELSE 1.0 END, 5) AS priority_score FROM scores""",
    ),
)
def h12(d: Domain):
    scores = site_risk.risk_scores(site_risk.site_stats(d.sites, d.outages))
    return rounded(site_risk.weighted_priority(scores), 5)
