"""Sources (A), cleaning (B), filters (C), text (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.functions import outage as out
from gridspark.operators import cleaning, filters, ml, grid, textsearch
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
from gridspark.session import materialize, scratch_dir
from gridspark.sources import geojson, incidents as inc, outages as src, tables


# --- A: sources and sinks ----------------------------------------------------------------------


@query(
    "a1_outage_export",
    with_(
        "raw",
        f"""SELECT incident_reference_number, {stamp("incident_date_time")} AS incident_date_time,
  {stamp("restoration_date_time")} AS restoration_date_time, incident_duration, customer_affected,
  total_customer_minutes_lost, direct_cause_category, district_name, exceptional_event_id,
  latitude, longitude FROM raw""",
    ),
)
def a1(d: Domain):
    """Write the outages as a raw export and read them back typed."""
    path = scratch_dir(d.spark, "export")
    bom = d.raw.withColumn(
        "geometry",
        F.coalesce(
            F.concat_ws(", ", F.col("latitude").cast("string"), F.col("longitude").cast("string")),
            F.lit(""),
        ),
    ).drop("latitude", "longitude", "row_id")
    first, *rest = bom.columns
    named = bom.withColumnRenamed(first, "\ufeff" + first)
    options = {
        "sep": ";",
        "header": True,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    named.write.options(**options).csv(path)
    read = src.read_outage_export(d.spark, path)
    return text_times(read).select(
        "incident_reference_number", "incident_date_time", "restoration_date_time",
        "incident_duration", "customer_affected", "total_customer_minutes_lost",
        "direct_cause_category", "district_name", "exceptional_event_id", "latitude", "longitude",
    )


@query(
    "a2_read_outages",
    with_(
        "raw",
        """SELECT CAST(hour(incident_date_time) AS INTEGER) AS hour, count(*) AS n FROM raw
GROUP BY 1""",
    ),
)
def a2(d: Domain):
    path = scratch_dir(d.spark, "stored") + ".parquet"
    cleaning.with_display_aliases(d.raw).write.parquet(path)
    read = src.read_outages(d.spark, path)
    return read.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a3_write_outages",
    with_(
        "raw",
        """SELECT f AS format, count(*) AS n, CAST(sum(total_customer_minutes_lost) AS BIGINT) AS minutes,
  count(restoration_date_time) AS restored, round(sum(latitude), 4) AS lat_sum
FROM raw CROSS JOIN (VALUES ('csv'), ('parquet')) t(f) GROUP BY f""",
    ),
)
def a3(d: Domain):
    csv, parquet = src.write_outages(d.raw, scratch_dir(d.spark, "outages"))
    parts = []
    for name, path in (("csv", csv), ("parquet", parquet)):
        parts.append(
            src.read_outages(d.spark, path).agg(
                F.lit(name).alias("format"),
                F.count(F.lit(1)).alias("n"),
                F.sum("total_customer_minutes_lost").alias("minutes"),
                F.count("restoration_date_time").alias("restored"),
                F.round(F.sum("latitude"), 4).alias("lat_sum"),
            )
        )
    return parts[0].unionByName(parts[1])


def _raw_chargepoints(d: Domain):
    """The raw export as read from CSV."""
    path = scratch_dir(d.spark, "chargepoints")
    d.view(fx.RAW_CHARGEPOINTS).select(
        F.col("row_id").cast("string").alias("row_id"),
        F.col("place").alias('"field_place_name|value"'),
        F.col("lat").alias("Lat"),
        F.col("lng").alias("lng"),
        F.col("vx").alias("field_vx_bool|value"),
        F.col("status").alias("Status"),
    ).write.option("header", True).option("emptyValue", "").option(
        "ignoreTrailingWhiteSpace", False
    ).option("ignoreLeadingWhiteSpace", False).csv(path)
    return tables.read_chargepoint_export(d.spark, path)


@query(
    "a4_chargepoint_export",
    with_(
        "rawcp",
        """SELECT row_id, place AS place, lat AS latitude, lng AS longitude,
  trim(status) AS status FROM rawcp""",
    ),
)
def a4(d: Domain):
    raw = _raw_chargepoints(d)
    return raw.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        F.col("`field_place_name|value`").alias("place"),
        F.col("Lat").alias("latitude"),
        F.col("lng").alias("longitude"),
        F.trim("Status").alias("status"),
    )


TENDERS = f"""
SELECT r.*, p.k, CAST(CASE p.k WHEN 0 THEN '2026-04-01' ELSE '2026-10-01' END AS STRING) AS start_date
FROM ({fx.REGIONS}) r CROSS JOIN (VALUES (0), (1)) p(k)
"""


def tenders(d: Domain):
    """Two contracts per nation, written as a feature collection and read back."""
    path = scratch_dir(d.spark, "tenders")
    ring = "array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1), array(x0, y0))"
    even = "region_id % 2 = 0"
    d.view(
        f"""SELECT to_json(named_struct('type', 'FeatureCollection', 'features', sort_array(collect_list(
  named_struct('type', 'Feature', 'properties', map('substation_name', name, 'need_type',
    CASE WHEN {even} THEN 'Variable Availability' ELSE 'Variable Availability + Operational Utilisation' END,
    'delivery_start_date', start_date, 'voltage_of_connection_kv', CASE k WHEN 0 THEN '11' ELSE '33' END,
    'period', CASE WHEN k = 1 THEN 'P' || region_id END),
  'geometry', CASE WHEN {even}
    THEN parse_json(to_json(named_struct('type', 'Polygon', 'coordinates', array({ring}))))
    ELSE parse_json(to_json(named_struct('type', 'MultiPolygon', 'coordinates', array(array({ring}))))) END
)) ))) AS value FROM ({TENDERS}) t""".replace("sort_array(", "(")
    ).write.text(path)
    return geojson.read_tenders(d.spark, path)


_TENDER_SQL = """SELECT name AS substation_name,
  CASE WHEN region_id % 2 = 0 THEN 'Variable Availability'
    ELSE 'Variable Availability + Operational Utilisation' END AS need_type,
  CASE k WHEN 0 THEN '2026-04-01' ELSE '2026-10-01' END AS delivery_start_date,
  CASE k WHEN 0 THEN '11' ELSE '33' END AS voltage_of_connection_kv,
  CASE WHEN region_id % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS geometry_type,
  CASE WHEN k = 1 THEN 'P' || region_id END AS period, x0, y0
FROM regions CROSS JOIN (VALUES (0), (1)) p(k)"""


@query("a5_read_geojson", with_("regions", _TENDER_SQL))
def a5(d: Domain):
    first = F.col("polygons")[0][0][0]
    return tenders(d).select(
        "substation_name", "need_type", "delivery_start_date", "voltage_of_connection_kv",
        "geometry_type", "period", first[0].alias("x0"), first[1].alias("y0"),
    )


@query(
    "a6_records_to_geojson",
    with_(
        "regions",
        """SELECT 'Feature' AS type, name AS county, 'Polygon' AS shape, x0, y0
FROM regions WHERE region_id % 6 <> 5""",
    ),
)
def a6(d: Domain):
    """Records with a shape text become features; every sixth has none."""
    geometry = F.to_json(
        F.struct(
            F.lit("Polygon").alias("type"), F.col("polygons")[0].alias("coordinates")
        )
    )
    wrapped = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit("}"))
    records = d.regions.select(
        F.col("name").alias("county"),
        F.lit("0,0").alias("geo_point_2d"),
        F.when(F.col("region_id") % 6 == 5, F.lit(None))
        .when(F.col("region_id") % 2 == 0, geometry)
        .otherwise(wrapped)
        .alias("geo_shape"),
    )
    value = F.col("value")
    corner = "$.geometry.coordinates[0][0]"
    return geojson.records_to_features(records).select(
        F.get_json_object(value, "$.type").alias("type"),
        F.get_json_object(value, "$.properties.county").alias("county"),
        F.get_json_object(value, "$.geometry.type").alias("shape"),
        F.get_json_object(value, f"{corner}[0]").cast("double").alias("x0"),
        F.get_json_object(value, f"{corner}[1]").cast("double").alias("y0"),
    )


@query(
    "a7_live_incidents",
    with_(
        "incidents",
        f"""SELECT incident_num, incident_type, {stamp("outage_time")} AS outage_time, customers_affected,
  customers_off_supply, incident_status,
  {stamp("estimated_restoration_time")} AS estimated_restoration_time, latitude, longitude
FROM incidents""",
    ),
)
def a7(d: Domain):
    """Every snapshot written as the raw feed: positions as objects or as text, mixed-case names."""
    path = scratch_dir(d.spark, "feed")
    lat, lon = F.col("latitude"), F.col("longitude")
    geo = F.when(
        F.col("customers_affected") % 2 == 0,
        F.to_variant_object(F.struct(lat.alias("lat"), lon.alias("lon"))),
    ).otherwise(F.concat_ws(", ", lat.cast("string"), lon.cast("string")).cast("variant"))
    raw = d.incidents.select(
        F.col("incident_num").alias("Incident_Num"),
        "incident_type",
        F.date_format("outage_time", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("OUTAGE_TIME"),
        "customers_affected",
        "customers_off_supply",
        "incident_status",
        F.date_format(
            "estimated_restoration_time", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
        ).alias("estimated_restoration_time"),
        geo.alias("geo_point_2d"),
        F.lit("ignored").alias("geo_shape"),
    )
    raw.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return text_times(inc.read_live_incidents(d.spark, path, multi_line=False))


@query(
    "a8_read_predictions",
    with_(
        "stacked",
        """SELECT model, risk_level, count(*) AS n, round(sum(confidence), 6) AS confidence
FROM stacked GROUP BY 1, 2""",
    ),
)
def a8(d: Domain):
    path = scratch_dir(d.spark, "predictions")
    tables.write_predictions(d.stacked, path)
    both = tables.read_predictions(d.spark, path, ["rf", "xgb"])
    return rounded(
        both.groupBy("model", "risk_level").agg(
            F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence")
        )
    )


@query("a9_saved_model", with_("cells", "SELECT count(*) AS cells, count(*) AS same FROM cells"))
def a9(d: Domain):
    """A saved and loaded model predicts what the fitted one predicts."""
    features = materialize(grid.label_by_count(grid.grid_features(d.outages)), "features")
    model = ml.train(features, ml.FOREST)
    path = scratch_dir(d.spark, "model")
    ml.save_model(model, path)

    def side(m, name):
        return ml.predict(m, features).select("ci", "cj", F.col("risk_level").alias(name))

    both = side(model, "a").join(side(ml.load_model(path), "b"), ["ci", "cj"])
    return both.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("a") == F.col("b")).alias("same")
    )


def _long_list(d: Domain):
    """The long list written with its published headings and read back."""
    path = scratch_dir(d.spark, "long-list")
    d.view(fx.LONG_LIST).select(
        F.col("row_id").cast("string").alias("No"),
        F.col("town").alias("Town/ Village "),
        F.col("potential_sites").alias("Potential Sites"),
        F.col("brief_description").alias("Brief Description"),
        F.col("local_authority").alias(" Local Authority Area"),
        F.col("contact").alias("Contact"),
        F.col("email").alias("Email"),
    ).write.option("header", True).csv(path)
    return tables.read_long_list(d.spark, path).withColumn("row_id", F.col("No").cast("bigint"))


@query(
    "a10_long_list",
    with_(
        "long_list",
        "SELECT row_id, town, trim(potential_sites) AS potential_sites, brief_description, local_authority, email FROM long_list",
    ),
)
def a10(d: Domain):
    return _long_list(d).select(
        "row_id", "town", F.trim("potential_sites").alias("potential_sites"), "brief_description",
        "local_authority", "email",
    )


@query(
    "a12_json_rows",
    with_(
        "sites",
        """SELECT '{"charge_point_location":"' || charge_point_location || '","site_category":"' || site_category
  || '","latitude":' || latitude || ',"longitude":' || longitude || ',"note":null}' AS value FROM sites""",
    ),
)
def a12(d: Domain):
    return tables.to_json_rows(d.sites.withColumn("note", F.lit(None).cast("string")))


@query(
    "a13_snapshot_changed",
    with_(
        "raw",
        """SELECT 'same' AS pair, FALSE AS changed, count(*) AS old_rows, count(*) AS new_rows FROM raw
UNION ALL SELECT 'edited', TRUE, count(*), count(*) FROM raw""",
    ),
)
def a13(d: Domain):
    raw = d.raw
    edit = F.when(F.col("row_id") % 10 == 0, F.col("incident_duration") + 1).otherwise(
        F.col("incident_duration")
    )
    same = tables.table_changed(raw, raw.orderBy(F.col("row_id").desc()))
    other = tables.table_changed(raw, raw.withColumn("incident_duration", edit))
    return same.select(F.lit("same").alias("pair"), "*").unionByName(
        other.select(F.lit("edited").alias("pair"), "*")
    )


# --- B: cleaning -------------------------------------------------------------------------------


@query(
    "b1_derived_fields",
    with_(
        "outages",
        """SELECT incident_reference_number, round(duration_hours, 6) AS duration_hours, year, month_name,
  hour, season, duration_category, is_exceptional_event FROM outages""",
    ),
)
def b1(d: Domain):
    return rounded(
        d.outages.select(
            "incident_reference_number", "duration_hours", "year", "month_name", "hour", "season",
            "duration_category", "is_exceptional_event",
        )
    )


@query(
    "b1d_longest_when_null",
    with_(
        "outages",
        """SELECT COALESCE(duration_category, 'x > 12 hours') AS duration_category, count(*) AS n
FROM outages GROUP BY 1""",
    ),
)
def b1d(d: Domain):
    """The variant that puts a null duration in the longest class."""
    rows = cleaning.derive_fields(d.raw, null_as_longest=True)
    return rows.groupBy("duration_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b1f_display_aliases",
    with_(
        "raw",
        f"""SELECT incident_reference_number, {stamp("incident_date_time")} AS "Incident Date-time",
  total_customer_minutes_lost AS "Total Customer Minutes Lost" FROM raw""",
    ),
)
def b1f(d: Domain):
    return text_times(
        cleaning.with_display_aliases(d.raw).select(
            "incident_reference_number", "Incident Date-time", "Total Customer Minutes Lost"
        )
    )


_CLEAN_CP = """SELECT charge_point_location, site_category, CAST(lat AS DOUBLE) AS latitude,
  CAST(lng AS DOUBLE) AS longitude FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY charge_point_location ORDER BY row_id) AS rn FROM (
    SELECT *, CASE WHEN vx = '1' AND st IN ('open', 'cwys') THEN 'V2X Chargepoint'
        WHEN lower(charge_point_location) IN (SELECT name FROM buildings) THEN 'Building-supplied Charger'
        WHEN vx <> '1' AND st = 'open' THEN 'Other Chargepoint' END AS site_category
    FROM (SELECT *, trim(place, '"') AS charge_point_location, lower(trim(status)) AS st FROM rawcp) a
  ) b WHERE site_category IS NOT NULL) c
WHERE rn = 1 AND lat <> 'n/a'"""


@query("b2_clean_chargepoints", with_("rawcp buildings", _CLEAN_CP))
def b2(d: Domain):
    raw = _raw_chargepoints(d).withColumn("row_id", F.col("row_id").cast("bigint"))
    return cleaning.clean_chargepoints(raw, "row_id", d.view(fx.BUILDING_SITES))


_TYPE = """CASE WHEN t LIKE '%village hall%' THEN 'Village Hall' WHEN t LIKE '%community cent%' THEN 'Community Centre'
  WHEN t LIKE '%church%' OR t LIKE '%chapel%' OR t LIKE '%memorial hall%' OR t LIKE '%educational institute%'
    OR t LIKE '%parish council%' THEN 'Community Building' ELSE 'Other Community Site' END"""


@query(
    "b3_site_types",
    with_(
        "long_list",
        f"""SELECT row_id, town || ' - ' || trim(potential_sites) AS site_name, {_TYPE} AS site_type,
  nullif(trim(contact), '') AS contact, email
FROM (SELECT *, lower(potential_sites || ' ' || brief_description) AS t FROM long_list) x""",
    ),
)
def b3(d: Domain):
    named = cleaning.name_long_list(d.view(fx.LONG_LIST))
    return named.select("row_id", "site_name", "site_type", "contact", "email")


@query(
    "b4_site_names",
    with_(
        "long_list",
        """SELECT row_id, town || ' - ' || trim(potential_sites) AS site_name, nullif(trim(contact), '') AS contact,
  nullif(trim(email), '') AS email, local_authority FROM long_list""",
    ),
)
def b4(d: Domain):
    named = cleaning.name_long_list(d.view(fx.LONG_LIST))
    return named.select("row_id", "site_name", "contact", "email", "local_authority")


@query(
    "b5_community_buildings",
    with_(
        "sites",
        """SELECT charge_point_location, site_category FROM sites
WHERE lower(charge_point_location) LIKE '%village hall%' OR lower(charge_point_location) LIKE '%community cent%'""",
    ),
)
def b5(d: Domain):
    keep = cleaning.is_community_building(F.col("charge_point_location"))
    return d.sites.where(keep).select("charge_point_location", "site_category")


_PLACED = """SELECT l.row_id, COALESCE(e.latitude, t.latitude) AS latitude,
  COALESCE(e.longitude, t.longitude) AS longitude
FROM long_list l LEFT JOIN gazetteer e ON l.town = e.town AND l.local_authority = e.authority
LEFT JOIN gazetteer t ON l.town = t.town"""


@query("b6_locate_places", with_("long_list gazetteer", _PLACED))
def b6(d: Domain):
    found = cleaning.locate_places(d.view(fx.LONG_LIST), d.view(fx.GAZETTEER))
    return found.select("row_id", "latitude", "longitude")


@query(
    "b6_place_summary",
    with_(
        "long_list gazetteer",
        f"""SELECT count(*) AS total_sites, count(latitude) AS geocoded,
  count(*) - count(latitude) AS failed_geocode FROM ({_PLACED}) p""",
    ),
)
def b6s(d: Domain):
    return cleaning.place_summary(
        cleaning.locate_places(d.view(fx.LONG_LIST), d.view(fx.GAZETTEER))
    )


@query(
    "b7_numeric_coercion",
    with_(
        "rawcp",
        """SELECT row_id, COALESCE(TRY_CAST(vx AS DOUBLE), 0) AS vx,
  round(COALESCE(TRY_CAST(lat AS DOUBLE), 0), 6) AS lat FROM rawcp""",
    ),
)
def b7(d: Domain):
    return rounded(
        cleaning.coerce_numbers(
            d.view(fx.RAW_CHARGEPOINTS).select("row_id", "vx", "lat"), ["vx", "lat"]
        )
    )


@query(
    "b8_significance_ratio",
    with_(
        "outages",
        """SELECT incident_reference_number, CASE WHEN duration_hours = 0 AND total_customer_minutes_lost > 0 THEN -1
  WHEN duration_hours = 0 THEN 0
  ELSE round(COALESCE(total_customer_minutes_lost / (duration_hours * 60), 0), 6) END AS significance_ratio
FROM outages""",
    ),
)
def b8(d: Domain):
    value = out.significance_ratio(F.col("total_customer_minutes_lost"), F.col("duration_hours"))
    finite = F.when(value == float("inf"), F.lit(-1.0)).otherwise(value)
    return rounded(
        d.outages.select("incident_reference_number", finite.alias("significance_ratio"))
    )


# --- C: filters --------------------------------------------------------------------------------

_REF = "incident_reference_number"


@query(
    "c1_years",
    with_("outages", f"SELECT {_REF}, year FROM outages WHERE year IN (1996, 1998)"),
)
def c1(d: Domain):
    return filters.by_years(d.outages, [1996, 1998]).select(_REF, "year")


@query(
    "c2_daytime",
    with_("outages", f"SELECT {_REF}, hour FROM outages WHERE hour BETWEEN 9 AND 21"),
)
def c2(d: Domain):
    return filters.daytime(d.outages).select(_REF, "hour")


@query(
    "c3_without_exceptional",
    with_("outages", f"SELECT {_REF} FROM outages WHERE NOT is_exceptional_event"),
)
def c3(d: Domain):
    return filters.without_exceptional(d.outages).select(_REF)


_IQR = """(SELECT greatest(0.0, q1 - {k} * (q3 - q1)) AS lo, least(49.0, q3 + {k} * (q3 - q1)) AS hi
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}) q) b"""


@query(
    "c4_duration_outliers",
    with_(
        "outages",
        f"""SELECT {_REF}, round(duration_hours, 6) AS duration_hours
FROM outages, {_IQR.format(k=0.5, c="duration_hours", t="outages")}
WHERE duration_hours BETWEEN lo AND hi""",
    ),
)
def c4(d: Domain):
    """A narrow multiplier so that the bounds cut on both sides."""
    return rounded(
        filters.duration_outliers_removed(d.outages, 0.5).select(_REF, "duration_hours")
    )


@query(
    "c4_removal_report",
    with_(
        "outages",
        f"""SELECT count(*) AS total_rows, count(CASE WHEN duration_hours BETWEEN lo AND hi THEN 1 END) AS kept_rows,
  count(*) - count(CASE WHEN duration_hours BETWEEN lo AND hi THEN 1 END) AS removed_rows,
  round(100.0 * (count(*) - count(CASE WHEN duration_hours BETWEEN lo AND hi THEN 1 END)) / count(*), 6) AS removed_pct
FROM outages, {_IQR.format(k=1.5, c="duration_hours", t="outages")}""",
    ),
)
def c4r(d: Domain):
    before = d.outages
    return rounded(
        filters.removal_report(before, filters.duration_outliers_removed(before))
    )


_RATED = """SELECT *, CASE WHEN duration_hours = 0 AND total_customer_minutes_lost > 0 THEN CAST('inf' AS DOUBLE)
  WHEN duration_hours = 0 THEN 0 ELSE COALESCE(total_customer_minutes_lost / (duration_hours * 60), 0) END AS ratio
FROM {t}"""


@query(
    "c5_significant_only",
    with_(
        "outages",
        f"""SELECT {_REF} FROM ({_RATED.format(t="outages")}) r
WHERE ratio >= (SELECT quantile_cont(ratio, 0.5) FROM ({_RATED.format(t="outages")}) s)""",
    ),
)
def c5(d: Domain):
    return filters.significant_only(d.outages, 0.5).select(_REF)


piece(
    "base6",
    "outages",
    """SELECT * FROM outages WHERE year IN (1996, 1997, 1998) AND hour BETWEEN 9 AND 21
  AND NOT is_exceptional_event""",
)
piece(
    "kept6",
    "base6",
    f"""SELECT base6.* FROM base6, {_IQR.format(k=0.7, c="duration_hours", t="base6")}
WHERE duration_hours BETWEEN lo AND hi""",
)


@query(
    "c6_filter_chain",
    with_(
        "kept6",
        f"""SELECT {_REF} FROM ({_RATED.format(t="kept6")}) r
WHERE ratio >= (SELECT quantile_cont(ratio, 0.6) FROM ({_RATED.format(t="kept6")}) s)""",
    ),
)
def c6(d: Domain):
    kept = filters.apply_filters(
        d.outages,
        years=[1996, 1997, 1998],
        daytime_only=True,
        exclude_exceptional=True,
        iqr_multiplier=0.7,
        significance_quantile=0.6,
    )
    return kept.select(_REF)


_C7_WHERE = f"""lower(district_name) LIKE '%nation_1%' AND year = 1997
  AND incident_date_time >= TIMESTAMP '1997-02-01' AND incident_date_time <= TIMESTAMP '1997-11-30 23:59:59'
  AND lower(direct_cause_category) LIKE '%urgent%' AND COALESCE(duration_hours, 0) >= 2
  AND {hav("54.5", "-2.75", "latitude", "longitude")} <= 60"""
_C7 = {
    "district": "Nation_1", "lat": 54.5, "lon": -2.75, "radius": 60.0, "year": 1997,
    "start": "1997-02-01", "end": "1997-11-30", "cause": "URGENT", "min_duration": 2.0,
}


@query(
    "c7_query_outages",
    with_(
        "outages",
        f"""SELECT {_REF}, {stamp("incident_date_time")} AS incident_date_time, district_name, primary_substation,
  round(COALESCE(duration_hours, 0), 6) AS duration_hours, CAST(customer_affected AS DOUBLE) AS customer_affected,
  direct_cause_category, latitude, longitude,
  round({hav("54.5", "-2.75", "latitude", "longitude")}, 6) AS distance_km
FROM outages WHERE {_C7_WHERE}
ORDER BY customer_affected DESC NULLS LAST, {_REF} LIMIT 10""",
    ),
)
def c7(d: Domain):
    results, _ = filters.query_outages(d.outages, sort="customers", top=10, **_C7)
    return text_times(rounded(results))


@query(
    "c7_query_summary",
    with_(
        "outages",
        f"""SELECT count(*) AS match_count, round(COALESCE(avg(COALESCE(duration_hours, 0)), 0), 9) AS avg_duration,
  round(COALESCE(sum(COALESCE(customer_affected, 0) * COALESCE(duration_hours, 0)), 0), 4) AS total_customer_hours
FROM outages WHERE {_C7_WHERE}""",
    ),
)
def c7s(d: Domain):
    _, summary = filters.query_outages(d.outages, sort="customers", top=10, **_C7)
    return rounded(summary).withColumn("total_customer_hours", F.round("total_customer_hours", 4))


@query(
    "c8_site_category",
    with_(
        "sites",
        """SELECT charge_point_location, site_category, 'alias' AS how FROM sites WHERE site_category = 'V2X Chargepoint'
UNION ALL SELECT charge_point_location, site_category, 'part' FROM sites WHERE lower(site_category) LIKE '%supplied%'""",
    ),
)
def c8(d: Domain):
    a = filters.by_category(d.sites, "V2X").withColumn("how", F.lit("alias"))
    b = filters.by_category(d.sites, "supplied").withColumn("how", F.lit("part"))
    return a.unionByName(b).select("charge_point_location", "site_category", "how")


@query(
    "c8_query_sites",
    with_(
        "sites",
        f"""SELECT *, count(*) OVER () AS match_count FROM (
  SELECT charge_point_location, site_category, round({hav("54.5", "-2.0", "latitude", "longitude")}, 6) AS distance_km
  FROM sites WHERE site_category = 'V2X Chargepoint') t
WHERE distance_km <= 250 ORDER BY round(distance_km, 9), charge_point_location LIMIT 10""",
    ),
)
def c8q(d: Domain):
    """The ten nearest sites of a category around a point, and how many there are."""
    results, summary = filters.query_sites(d.sites, "v2x", 54.5, -2.0, 250.0, 10)
    found = results.withColumn("match_count", summary.select("match_count").scalar())
    return rounded(found.select("charge_point_location", "site_category", "distance_km", "match_count"))


@query(
    "c9_district_match",
    with_(
        "outages",
        f"""SELECT 'exact' AS how, district_name, count(*) AS n FROM outages WHERE lower(district_name) = 'nation_1' GROUP BY 2
UNION ALL SELECT 'contains', district_name, count(*) FROM outages WHERE lower(district_name) LIKE '%nation_2%'
  AND NOT EXISTS (SELECT 1 FROM outages WHERE lower(district_name) = 'ation_2') GROUP BY 2""",
    ),
)
def c9(d: Domain):
    def counts(name, how):
        found = filters.by_name(d.outages, name).groupBy("district_name")
        return found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "*")

    return counts("NATION_1", "exact").unionByName(counts("ation_2", "contains"))


@query(
    "c10_visible_cells",
    with_(
        "preds",
        "SELECT ci, cj, risk_level, round(confidence, 6) AS confidence FROM preds WHERE risk_level <> 'Low' AND confidence >= 0.5",
    ),
)
def c10(d: Domain):
    return rounded(
        filters.visible_risk_cells(d.cells).select("ci", "cj", "risk_level", "confidence")
    )


@query(
    "c11_authority",
    with_(
        "long_list",
        """SELECT row_id, local_authority FROM long_list WHERE lower(local_authority) LIKE '%asi%'
ORDER BY row_id LIMIT 10""",
    ),
)
def c11(d: Domain):
    rows = filters.by_authority(d.view(fx.LONG_LIST), "Asi", 10, [F.col("row_id")])
    return rows.select("row_id", "local_authority")


@query(
    "c12_located",
    with_(
        "outages",
        f"SELECT {_REF}, latitude, longitude FROM outages WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    ),
)
def c12(d: Domain):
    from gridspark.operators.spatial import located

    return located(d.outages).select(_REF, "latitude", "longitude")


# --- J: text -----------------------------------------------------------------------------------

_LINES = r"""SELECT doc_id, line, i FROM (SELECT doc_id,
  unnest(list) AS line, generate_subscripts(list, 1) AS i FROM (SELECT doc_id,
    regexp_split_to_array(regexp_replace(text, '(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])\z', ''),
      '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS list FROM documents) a) b"""


@query(
    "j1_document_search",
    f"""WITH lines AS ({_LINES}),
hits AS (SELECT doc_id, i, line, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) AS rn,
    count(*) OVER (PARTITION BY doc_id) AS match_count FROM lines WHERE contains(lower(line), 'the '))
SELECT h.doc_id, CAST(h.match_count AS INTEGER) AS match_count, CAST(h.i AS INTEGER) AS line_number,
  md5(string_agg(l.line, chr(10) ORDER BY l.i)) AS context_md5
FROM hits h JOIN lines l ON h.doc_id = l.doc_id AND l.i BETWEEN h.i - 2 AND h.i + 2
WHERE h.rn <= 5 GROUP BY 1, 2, 3""",
)
def j1(d: Domain):
    found = textsearch.search_documents(d.table("documents").select("doc_id", "text"), "The ")
    return textsearch.match_rows(found).select(
        "doc_id", "match_count", "line_number", F.md5("context").alias("context_md5")
    )


@query(
    "j2_document_titles",
    r"""SELECT doc_id, trim(ltrim(regexp_extract(text, '(?m)^[ \t]*# (.*\S.*)$', 1), '# ')) AS title FROM documents""",
)
def j2(d: Domain):
    return textsearch.document_titles(d.table("documents").select("doc_id", "text"))

