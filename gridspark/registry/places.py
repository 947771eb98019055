"""Recommendations (H), incremental loads and live incidents (I)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from gridspark import fixtures as fx
from gridspark.operators import incremental, recommend, spatial
from gridspark.plans import long_list as plan
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
from gridspark.registry.rows import _PLACED
from gridspark.session import scratch_dir
from gridspark.streaming import incidents as stream

_SITE = "charge_point_location"
_CELL_SITE = hav("p.lat", "p.lon", "s.latitude", "s.longitude")

piece(
    "cell_sites",
    "preds sites",
    f"SELECT p.ci, p.cj, s.{_SITE}, s.site_category, {_CELL_SITE} AS d FROM preds p, sites s",
)
_COMMUNITY = (
    "(lower(charge_point_location) LIKE '%village hall%' OR lower(charge_point_location) LIKE '%community cent%')"
)


def _closest(where: str) -> str:
    return f"""(SELECT ci, cj, arg_min({_SITE}, (round(d, 9), {_SITE})) AS name, min(d) AS km FROM cell_sites
  WHERE {where} GROUP BY 1, 2)"""


piece(
    "cell_context",
    "preds cell_sites",
    f"""SELECT p.*, v.name AS v2x_name, v.km AS v2x_km, c.name AS site_name, c.km AS plain_km,
  a.name AS any_name, a.km AS any_km, m.name AS community_name, m.km AS community_km
FROM preds p LEFT JOIN {_closest("site_category = 'V2X Chargepoint'")} v USING (ci, cj)
LEFT JOIN {_closest("site_category <> 'V2X Chargepoint'")} c USING (ci, cj)
LEFT JOIN {_closest("TRUE")} a USING (ci, cj)
LEFT JOIN {_closest(_COMMUNITY)} m USING (ci, cj)""",
)
piece(
    "v2x_top",
    "cell_context",
    """SELECT * FROM cell_context WHERE plain_km <= 3.0 AND NOT COALESCE(v2x_km < 3.0, FALSE)
ORDER BY prob_high DESC, lat, lon LIMIT 3""",
)
piece(
    "gap_top",
    "cell_context",
    "SELECT * FROM cell_context WHERE NOT COALESCE(any_km < 3.0, FALSE) ORDER BY prob_high DESC, lat, lon LIMIT 3",
)

_CONTEXT = "community_name, round(community_km, 6) AS community_km, round(confidence, 6) AS score"


@query(
    "h1_v2x_upgrades",
    with_(
        "v2x_top",
        f"""SELECT 'Critical' AS priority, 'V2X upgrade recommended at near ' || any_name AS title, lat, lon,
  v2x_name, round(v2x_km, 6) AS v2x_km, site_name, {_CONTEXT} FROM v2x_top""",
    ),
)
def h1(d: Domain):
    return rounded(
        recommend.v2x_upgrades(d.cells, d.sites).select(
            "priority", "title", "lat", "lon", "v2x_name", "v2x_km", "site_name",
            "community_name", "community_km", "score",
        )
    )


@query(
    "h2_new_chargepoints",
    with_(
        "gap_top",
        f"""SELECT 'High' AS priority, 'New chargepoint recommended at near ' || any_name AS title, lat, lon,
  any_name AS site_name, round(any_km, 6) AS site_km, {_CONTEXT} FROM gap_top""",
    ),
)
def h2(d: Domain):
    return rounded(
        recommend.new_chargepoints(d.cells, d.sites).select(
            "priority", "title", "lat", "lon", "site_name", "site_km", "community_name",
            "community_km", "score",
        )
    )


piece(
    "burden_top",
    "outages",
    """SELECT district_name, count(*) AS outage_count, avg(COALESCE(duration_hours, 0)) AS avg_duration,
  sum(COALESCE(duration_hours, 0)) AS total_hours, count(CASE WHEN season = 'Winter' THEN 1 END) AS winter_count
FROM outages GROUP BY 1 ORDER BY outage_count DESC, district_name LIMIT 5""",
)


@query(
    "h3_resilience_priorities",
    with_(
        "burden_top",
        """SELECT CASE WHEN outage_count > 50 THEN 'High' ELSE 'Medium' END AS priority,
  'Grid resilience priority: ' || district_name AS title, outage_count, round(avg_duration, 9) AS avg_duration,
  round(total_hours, 4) AS total_hours, winter_count FROM burden_top""",
    ),
)
def h3(d: Domain):
    top = recommend.resilience_priorities(d.outages).select(
        "priority", "title", "outage_count", "avg_duration", "total_hours", "winter_count"
    )
    return rounded(top).withColumn("total_hours", F.round("total_hours", 4))


piece(
    "community",
    "pairs",
    f"""SELECT {_SITE}, any_value(site_category) AS site_category, count(*) AS n, sum(duration_hours) AS h
FROM pairs WHERE d <= 2.0 AND {_COMMUNITY} GROUP BY 1 HAVING count(*) > 5""",
)


@query(
    "h4_community_impact",
    with_(
        "community",
        f"""SELECT CASE WHEN site_category = 'V2X Chargepoint' THEN 'Medium' ELSE 'High' END AS priority,
  'Community building at risk: ' || {_SITE} AS title, n AS nearby_outages, round(h, 5) AS nearby_hours FROM community""",
    ),
)
def h4(d: Domain):
    return rounded(
        recommend.community_impact(d.sites, d.outages).select(
            "priority", "title", "nearby_outages", "nearby_hours"
        ),
        5,
    )


piece(
    "ranking",
    "site_stats cell_pairs",
    f"""SELECT s.{_SITE} AS site_name, site_category AS category, latitude AS lat, longitude AS lon, risk_level,
  outages AS nearby_outages, hours AS nearby_hours,
  CASE risk_level WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.5 ELSE 0.1 END * 0.4 + least(outages / 50.0, 1.0) * 0.3
  + least(hours / 1000.0, 1.0) * 0.2 - CASE WHEN site_category = 'V2X Chargepoint' THEN 0.1 ELSE 0.0 END AS score
FROM site_stats s JOIN (SELECT {_SITE}, arg_min(risk_level, (round(d, 9), lat, lon)) AS risk_level
  FROM cell_pairs GROUP BY 1) c ON s.{_SITE} = c.{_SITE}""",
)
_RANKING = "site_name, category, lat, lon, risk_level, nearby_outages, round(nearby_hours, 5) AS nearby_hours, round(score, 9) AS composite_score"


@query("h5_investment_ranking", with_("ranking", f"SELECT {_RANKING} FROM ranking"))
def h5(d: Domain):
    return rounded(recommend.investment_ranking(d.cells, d.outages, d.sites), 5)


@query(
    "h6_combined_report",
    with_(
        "v2x_top gap_top burden_top community",
        f"""SELECT 'Charging Station Placement' AS category, 'Critical' AS priority,
  'V2X upgrade recommended at near ' || any_name AS title, lat, lon, round(confidence, 4) AS score FROM v2x_top
UNION ALL SELECT 'Chargepoint Placement', 'High', 'New chargepoint recommended at near ' || any_name, lat, lon,
  round(confidence, 4) FROM gap_top
UNION ALL SELECT 'Grid Resilience', CASE WHEN outage_count > 50 THEN 'High' ELSE 'Medium' END,
  'Grid resilience priority: ' || district_name, NULL, NULL, outage_count FROM burden_top
UNION ALL SELECT 'Community Impact', CASE WHEN site_category = 'V2X Chargepoint' THEN 'Medium' ELSE 'High' END,
  'Community building at risk: ' || c.{_SITE}, s.latitude, s.longitude, n FROM community c
  JOIN (SELECT {_SITE}, latitude, longitude FROM sites) s ON s.{_SITE} = c.{_SITE}""",
    ),
)
def h6(d: Domain):
    report = recommend.combined_report(d.cells, d.outages, d.sites)
    return report.select("category", "priority", "title", "lat", "lon", "score")


@query(
    "h6_report_of_one_kind",
    with_(
        "v2x_top gap_top",
        """SELECT 'v2x' AS kind, 'Charging Station Placement' AS category, 'Critical' AS priority,
  'V2X upgrade recommended at near ' || any_name AS title, lat, lon, round(confidence, 4) AS score FROM v2x_top
UNION ALL SELECT 'chargepoint', 'Chargepoint Placement', 'High', 'New chargepoint recommended at near ' || any_name, lat, lon,
  round(confidence, 4) FROM gap_top""",
    ),
)
def h6k(d: Domain):
    """The reports on upgrades alone and on new chargepoints alone."""
    parts = [
        recommend.combined_report(d.cells, d.outages, d.sites, kind).withColumn("kind", F.lit(kind))
        for kind in ("v2x", "chargepoint")
    ]
    return parts[0].unionByName(parts[1]).select("kind", "category", "priority", "title", "lat", "lon", "score")


@query(
    "h7_community_list",
    with_("sites", f"SELECT {_SITE}, site_category FROM sites WHERE {_COMMUNITY}"),
)
def h7e(d: Domain):
    return recommend.community_list(d.sites)


@query(
    "h7_highest_risk_cells",
    with_(
        "preds",
        """SELECT lat, lon, round(confidence, 6) AS confidence, round(prob_high, 6) AS prob_high FROM preds
WHERE risk_level = 'High' ORDER BY preds.confidence DESC, lat, lon LIMIT 5""",
    ),
)
def h7a(d: Domain):
    top = recommend.highest_risk_cells(d.cells)
    return rounded(top.select("lat", "lon", "confidence", "prob_high"))


@query(
    "h7_winter_risk",
    with_(
        "outages",
        """SELECT count(CASE WHEN season = 'Winter' THEN 1 END) AS winter_outages,
  round(100.0 * count(CASE WHEN season = 'Winter' THEN 1 END) / count(*), 6) AS winter_pct,
  round(avg(CASE WHEN season = 'Winter' THEN duration_hours END), 6) AS avg_winter_duration FROM outages""",
    ),
)
def h7b(d: Domain):
    return rounded(recommend.winter_risk(d.outages))


def _share(level: str) -> str:
    hit = f"count(CASE WHEN risk_level = '{level}' THEN 1 END)"
    n = level.lower()
    return f"{hit} AS {n}_cells, round(100.0 * {hit} / count(*), 6) AS {n}_pct"


@query(
    "h7_risk_summary",
    with_(
        "preds sites",
        f"""SELECT count(*) AS cells, {_share("High")}, {_share("Medium")}, {_share("Low")},
  (SELECT count(*) FROM raw) AS outages, (SELECT count(*) FROM sites WHERE {_COMMUNITY}) AS community_buildings
FROM preds""",
    ),
)
def h7c(d: Domain):
    return rounded(recommend.risk_summary(d.cells, d.raw, d.sites))


@query(
    "h7_top_investments",
    with_(
        "ranking",
        f"SELECT {_RANKING} FROM ranking ORDER BY score DESC, site_name LIMIT 5",
    ),
)
def h7d(d: Domain):
    return rounded(recommend.investment_ranking(d.cells, d.outages, d.sites).limit(5), 5)


piece(
    "located_list",
    "long_list gazetteer",
    f"SELECT l.*, p.latitude, p.longitude FROM long_list l JOIN ({_PLACED}) p USING (row_id)",
)
piece(
    "list_places",
    "located_list",
    "SELECT DISTINCT latitude, longitude FROM located_list WHERE latitude IS NOT NULL",
)
piece(
    "place_risk",
    "list_places preds",
    f"""SELECT latitude, longitude, count(*) AS cells, min(d) AS km,
  arg_min(risk_level, (round(d, 9), lat, lon)) AS risk_level, avg(prob_high) AS avg_prob_high,
  count(CASE WHEN risk_level = 'High' THEN 1 END) AS high
FROM (SELECT q.latitude, q.longitude, p.*, {hav("q.latitude", "q.longitude", "p.lat", "p.lon")} AS d
  FROM list_places q, preds p) t WHERE d <= 10 GROUP BY 1, 2""",
)
piece(
    "place_sites",
    "list_places sites",
    f"""SELECT latitude, longitude, min(d) AS km, count(CASE WHEN d <= 10 THEN 1 END) AS near,
  arg_min({_SITE}, (round(d, 9), {_SITE})) AS name
FROM (SELECT q.latitude, q.longitude, s.{_SITE}, {hav("q.latitude", "q.longitude", "s.latitude", "s.longitude")} AS d
  FROM list_places q, sites s) t GROUP BY 1, 2""",
)
_REASON = f"""CASE WHEN r.cells IS NULL THEN '{recommend.REASON_NO_DATA}'
  WHEN r.high > 0 AND s.km > 3.0 THEN '{recommend.REASON_NEW}' WHEN r.high > 0 THEN '{recommend.REASON_UPGRADE}'
  ELSE '{recommend.REASON_NONE}' END"""


def _placed(d: Domain):
    return plan.prepare_long_list(d.view(fx.LONG_LIST), d.view(fx.GAZETTEER), "row_id")


@query(
    "h8_recommended_places",
    with_(
        "located_list place_risk place_sites",
        f"""SELECT l.row_id, {_REASON} AS reason, COALESCE(r.high > 0, FALSE) AS matches_recommendation
FROM located_list l LEFT JOIN place_risk r USING (latitude, longitude) LEFT JOIN place_sites s USING (latitude, longitude)
WHERE l.latitude IS NOT NULL""",
    ),
)
def h8(d: Domain):
    placed = _placed(d)
    found = recommend.cross_reference_priority(placed, d.cells, d.sites, 10.0)
    rows = spatial.attach_by_position(placed, found, how="inner")
    return rows.select("row_id", "reason", "matches_recommendation")


@query(
    "h9_chargepoints_around",
    with_(
        "place_sites",
        """SELECT latitude AS site_lat, longitude AS site_lon, near AS count_within_radius,
  round(km, 6) AS nearest_chargepoint_km, CASE WHEN km <= 10 THEN name END AS nearest_chargepoint_name,
  CAST(least(near, 5) AS INTEGER) AS listed FROM place_sites""",
    ),
)
def h9(d: Domain):
    found = recommend.cross_reference_sites(_placed(d), d.sites, 10.0)
    return rounded(
        found.select(
            "site_lat", "site_lon", "count_within_radius", "nearest_chargepoint_km",
            "nearest_chargepoint_name", F.size("chargepoints").alias("listed"),
        )
    )


@query(
    "h10_long_list",
    with_(
        "located_list place_risk place_sites",
        f"""SELECT l.row_id, l.town || ' - ' || trim(l.potential_sites) AS site_name, l.latitude, l.longitude,
  r.risk_level, round(r.km, 6) AS risk_km, round(r.avg_prob_high, 6) AS avg_prob_high, r.high,
  s.near AS chargepoints, CASE WHEN l.latitude IS NOT NULL THEN {_REASON} END AS reason
FROM located_list l LEFT JOIN place_risk r USING (latitude, longitude) LEFT JOIN place_sites s USING (latitude, longitude)""",
    ),
)
def h10(d: Domain):
    full = plan.cross_reference(_placed(d), d.cells, d.sites)
    return rounded(
        full.select(
            "row_id", "site_name", "latitude", "longitude",
            F.col("risk.risk_level").alias("risk_level"),
            F.col("risk.nearest_risk_cell_km").alias("risk_km"),
            F.col("risk.avg_prob_high_nearby").alias("avg_prob_high"),
            F.col("risk.high_risk_cells").alias("high"),
            F.col("charging.count_within_radius").alias("chargepoints"),
            F.col("recommendation.reason").alias("reason"),
        )
    )


@query(
    "h10_long_list_summary",
    with_(
        "located_list place_risk place_sites",
        """SELECT count(*) AS total_sites, count(l.latitude) AS geocoded, count(*) - count(l.latitude) AS failed_geocode,
  count(CASE WHEN r.risk_level = 'High' THEN 1 END) AS high_risk_sites,
  count(CASE WHEN s.near > 0 THEN 1 END) AS sites_with_nearby_charging,
  count(CASE WHEN r.high > 0 THEN 1 END) AS matches_recommendation
FROM located_list l LEFT JOIN place_risk r USING (latitude, longitude) LEFT JOIN place_sites s USING (latitude, longitude)""",
    ),
)
def h10s(d: Domain):
    return plan.long_list_summary(plan.cross_reference(_placed(d), d.cells, d.sites))


_NEAR_SITES = f"(SELECT count(*) FROM sites s WHERE {deg('c.lat', 'c.lon', 's.latitude', 's.longitude')} < 0.1)"


def _top_cells(where: str) -> str:
    return f"(SELECT * FROM preds WHERE {where} ORDER BY prob_high DESC, lat, lon LIMIT 10)"


@query(
    "h11_candidate_cells",
    with_(
        "preds sites",
        f"""SELECT ci, cj, risk_level, {_NEAR_SITES} AS nearby_sites,
  (SELECT count(*) FROM raw o WHERE {deg("c.lat", "c.lon", "o.latitude", "o.longitude")} < 0.05) AS nearby_outages
FROM (SELECT * FROM {_top_cells("risk_level = 'High'")} a UNION ALL
  SELECT * FROM {_top_cells("risk_level = 'Medium'")} b) c""",
    ),
)
def h11(d: Domain):
    found = recommend.candidate_cells(d.cells, d.raw, d.sites)
    return found.select("ci", "cj", "risk_level", "nearby_sites", "nearby_outages")


@query(
    "h11_underserved_cells",
    with_(
        "preds sites",
        f"""SELECT * FROM (SELECT ci, cj, {_NEAR_SITES} AS nearby_sites
FROM {_top_cells("risk_level IN ('High', 'Medium')")} c) t WHERE nearby_sites < 3""",
    ),
)
def h11b(d: Domain):
    return recommend.underserved_cells(d.cells, d.sites).select("ci", "cj", "nearby_sites")


# --- I: incremental loads and live incidents ---------------------------------------------------

_MARK = "1999-06-30 12:00:00"
_REF = "incident_reference_number"


@query(
    "i1_rows_after_mark",
    with_(
        "raw",
        f"""SELECT 'mark' AS how, count(*) AS n FROM raw WHERE incident_date_time > TIMESTAMP '{_MARK}'
UNION ALL SELECT 'since', count(*) FROM raw WHERE incident_date_time >= TIMESTAMP '1999-06-01'
UNION ALL SELECT 'full', count(*) FROM raw""",
    ),
)
def i1(d: Domain):
    """The stored table ends before the saved mark, so the saved mark counts."""
    raw = d.raw
    stored = raw.where(F.col("incident_date_time") < F.lit("1999-01-01").cast("timestamp_ntz"))

    def n(df, how):
        return df.agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n"))

    return (
        n(incremental.new_rows(raw, stored, saved=_MARK), "mark")
        .unionByName(n(incremental.new_rows(raw, stored, since="1999-06-01"), "since"))
        .unionByName(n(incremental.new_rows(raw, stored, full=True), "full"))
    )


@query(
    "i2_upsert",
    with_(
        "raw",
        f"SELECT {_REF}, incident_duration + CASE WHEN row_id % 10 = 0 THEN 1 ELSE 0 END AS incident_duration FROM raw",
    ),
)
def i2(d: Domain):
    batch = d.raw.where(F.col("row_id") % 10 == 0).withColumn(
        "incident_duration", F.col("incident_duration") + 1
    )
    return incremental.upsert(d.raw, batch, "row_id").select(_REF, "incident_duration")


@query(
    "i2_upsert_stream",
    with_(
        "raw",
        f"SELECT {_REF}, incident_duration + CASE WHEN row_id % 10 = 0 THEN 1 ELSE 0 END AS incident_duration FROM raw",
    ),
)
def i2s(d: Domain):
    """The same as a stream: two loads of files, resolved when the table is read."""
    base = scratch_dir(d.spark, "outage-stream")
    columns = ["row_id", _REF, "incident_date_time", "incident_duration"]
    raw = d.raw.select(*columns)
    later = raw.where(F.col("row_id") % 10 == 0).withColumn(
        "incident_duration", F.col("incident_duration") + 1
    )
    for part in (raw, later):
        part.write.mode("append").parquet(f"{base}/feed")
        stream.outage_stream(
            d.spark, f"{base}/feed", raw.schema, f"{base}/checkpoint", f"{base}/table"
        ).awaitTermination()
    table = stream.current_outages(d.spark, f"{base}/table", raw.schema, "row_id")
    return table.select(_REF, "incident_duration")


piece(
    "ordered",
    "incidents",
    "SELECT incident_num, snapshot, dense_rank() OVER (ORDER BY snapshot) AS k FROM incidents",
)


@query(
    "i3_new_incidents",
    with_(
        "ordered",
        """SELECT a.incident_num, strftime(a.snapshot, '%Y-%m-%d') AS snapshot FROM ordered a
LEFT JOIN ordered b ON b.incident_num = a.incident_num AND b.k = a.k - 1
WHERE b.incident_num IS NULL""",
    ),
)
def i3(d: Domain):
    """Every daily snapshot against the one before (each day brings something new)."""
    snaps = d.incidents.select("incident_num", "snapshot")
    before = snaps.select(
        "incident_num", F.date_add("snapshot", 1).alias("snapshot")
    )
    fresh = snaps.join(before, ["incident_num", "snapshot"], "left_anti")
    return text_times(fresh)


# The state rule in SQL: the known numbers are those of the last day that reported something new.
piece(
    "news",
    "ordered",
    """SELECT i, j, EXISTS (SELECT 1 FROM ordered a WHERE a.k = j AND a.incident_num NOT IN
    (SELECT incident_num FROM ordered b WHERE b.k = i)) AS has_new
FROM (SELECT DISTINCT k AS i FROM ordered) x, (SELECT DISTINCT k AS j FROM ordered) y WHERE i < j""",
)
piece(
    "states",
    "news",
    """SELECT CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS s
UNION ALL SELECT n.j, CASE WHEN n.has_new THEN n.j ELSE states.s END
FROM states JOIN news n ON n.i = states.s AND n.j = states.k + 1""",
)


@query(
    "i3_incident_stream",
    with_(
        "states ordered",
        """SELECT a.incident_num, strftime(a.snapshot, '%Y-%m-%d') AS day FROM ordered a WHERE a.k = 1
UNION ALL SELECT a.incident_num, strftime(a.snapshot, '%Y-%m-%d') FROM ordered a JOIN states t ON t.k = a.k - 1
WHERE a.incident_num NOT IN (SELECT incident_num FROM ordered b WHERE b.k = t.s)""",
    ),
)
def i3s(d: Domain):
    """The polled check as a stream, one snapshot per batch, with the exact state rule."""
    base = scratch_dir(d.spark, "incident-stream")
    snaps = d.incidents.withColumn("day", F.date_format("snapshot", "yyyy-MM-dd"))
    schema = snaps.schema
    # the events are read and ranked once; a snapshot's file is then made from its own day's rows alone
    snaps.withColumn("_day", F.col("day")).hint("rebalance", "_day").write.partitionBy("_day").parquet(f"{base}/days")
    stored = d.spark.read.schema(T.StructType([*schema.fields, T.StructField("_day", T.StringType())]))
    stored = stored.parquet(f"{base}/days").where(F.col("_day").isNotNull())
    days = [r["_day"] for r in stored.select("_day").distinct().orderBy("_day").collect()]
    for day in days:
        own = stored.where(F.col("_day") == day).drop("_day")
        own.coalesce(1).write.mode("append").parquet(f"{base}/feed")
    stream.incident_stream(
        d.spark, f"{base}/feed", schema, f"{base}/checkpoint", f"{base}/known", f"{base}/new"
    ).awaitTermination()
    return d.spark.read.schema(schema).parquet(f"{base}/new/*").select("incident_num", "day")


piece(
    "last_day",
    "incidents",
    "SELECT * FROM incidents WHERE snapshot = (SELECT max(snapshot) FROM incidents)",
)


def _last_day(d: Domain):
    day = d.incidents.agg(F.max("snapshot").alias("m")).scalar()
    return d.incidents.where(F.col("snapshot") == day)


_INC_CELL = hav("i.latitude", "i.longitude", "p.lat", "p.lon")
_INC_SITE = hav("i.latitude", "i.longitude", "s.latitude", "s.longitude")
_INC_OUT = hav("i.latitude", "i.longitude", "o.latitude", "o.longitude")


@query(
    "i4_incident_context",
    with_(
        "incidents preds sites outages",
        f"""SELECT i.incident_num, i.day, c.risk_level, round(c.km, 6) AS cell_distance_km, s.name AS nearest_name,
  round(s.km, 6) AS nearest_km, COALESCE(h.n, 0) AS history_count, round(h.a, 9) AS history_avg_duration,
  round(h.c, 4) AS history_customer_hours
FROM (SELECT *, strftime(snapshot, '%Y-%m-%d') AS day FROM incidents) i
JOIN (SELECT latitude, longitude, arg_min(risk_level, (round({_INC_CELL}, 9), lat, lon)) AS risk_level, min({_INC_CELL}) AS km
  FROM (SELECT DISTINCT latitude, longitude FROM incidents) i, preds p GROUP BY 1, 2) c USING (latitude, longitude)
JOIN (SELECT i.latitude, i.longitude, arg_min({_SITE}, (round({_INC_SITE}, 9), {_SITE})) AS name, min({_INC_SITE}) AS km
  FROM (SELECT DISTINCT latitude, longitude FROM incidents) i, sites s GROUP BY 1, 2) s USING (latitude, longitude)
LEFT JOIN (SELECT i.latitude, i.longitude, count(*) AS n, avg(COALESCE(duration_hours, 0)) AS a,
    sum(customer_affected * COALESCE(duration_hours, 0)) AS c
  FROM (SELECT DISTINCT latitude, longitude FROM incidents) i, outages o WHERE {_INC_OUT} <= 5 GROUP BY 1, 2) h
  USING (latitude, longitude)""",
    ),
)
def i4(d: Domain):
    found = incremental.with_context(d.incidents, d.cells, d.sites, d.outages)
    first = F.col("nearest_chargepoints")[0]
    return rounded(
        found.select(
            "incident_num", F.date_format("snapshot", "yyyy-MM-dd").alias("day"), "risk_level",
            "cell_distance_km", first["name"].alias("nearest_name"),
            first["distance_km"].alias("nearest_km"), "history_count", "history_avg_duration",
            "history_customer_hours",
        )
    ).withColumn("history_customer_hours", F.round("history_customer_hours", 4))


@query(
    "i5_incident_list",
    with_(
        "last_day",
        f"""SELECT incident_num, incident_type, {stamp("outage_time")} AS outage_time, customers_affected,
  customers_off_supply, incident_status, {stamp("estimated_restoration_time")} AS estimated_restoration_time,
  latitude, longitude FROM last_day""",
    ),
)
def i5(d: Domain):
    return text_times(incremental.incident_list(_last_day(d)))
