"""Domain tables as views over the provided parquet tables.

Each view is one SQL text that runs unchanged in Spark SQL and in the checking engine. Only
integer arithmetic and one division feed a coordinate, so both engines get identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.functions.geo import cell_index
from gridspark.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

OUTAGES = """
SELECT 'INC' || o_orderkey AS incident_reference_number,
  CAST(o_orderkey AS BIGINT) AS row_id,
  o_orderdate + ((o_orderkey * 7919) % 1440) * INTERVAL '1' MINUTE AS incident_date_time,
  CASE WHEN o_orderkey % 122 = 0 THEN NULL ELSE
    o_orderdate + ((o_orderkey * 7919) % 1440 + (o_orderkey * 37) % 1500 + 15) * INTERVAL '1' MINUTE
  END AS restoration_date_time,
  CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE (o_orderkey * 37) % 1500 END AS incident_duration,
  (o_custkey * 13) % 400 AS customer_affected,
  ((o_custkey * 13) % 400) * ((o_orderkey * 37) % 1500) AS total_customer_minutes_lost,
  o_orderpriority AS direct_cause_category,
  CASE o_orderstatus WHEN 'P' THEN 'LV' WHEN 'O' THEN 'HV' ELSE 'EHV' END AS network_type,
  CASE WHEN o_custkey % 3 = 0 THEN '11kV' ELSE '0.4kV' END AS voltage,
  n_name AS district_name,
  CASE WHEN o_orderkey % 50 <> 0 THEN 'SUB' || (o_custkey % 40) END AS primary_substation,
  CASE WHEN o_orderkey % 200 = 0 THEN 'EX' || o_orderkey WHEN o_orderkey % 201 = 0 THEN '  ' END
    AS exceptional_event_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE
    CAST(54000 + (o_custkey * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE
    CAST(-3500 + (o_orderkey * 104729) % 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS longitude
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

SITES = """
SELECT s_name || CASE WHEN s_suppkey % 7 = 0 THEN ' Village Hall'
                      WHEN s_suppkey % 11 = 0 THEN ' community centre' ELSE '' END
    AS charge_point_location,
  CASE WHEN s_suppkey % 18 = 0 THEN 'V2X Chargepoint'
       WHEN s_suppkey % 10 = 1 THEN 'Building-supplied Charger'
       ELSE 'Other Chargepoint' END AS site_category,
  CAST(CASE WHEN s_suppkey % 25 = 9 THEN 58000 ELSE 54000 END + (s_suppkey * 7919) % 1000 AS DOUBLE)
    / CAST(1000 AS DOUBLE) AS latitude,
  CAST(-3500 + (s_suppkey * 104729) % 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
FROM supplier
"""

# {h} is the hash of the cell: h for the first model, 99 - h for the second.
PREDICTIONS = """
SELECT ci, cj, ci / CAST(50 AS DOUBLE) AS lat, cj / CAST(50 AS DOUBLE) AS lon, n,
  ph AS prob_high, (1 - ph) * m AS prob_medium, (1 - ph) * (1 - m) AS prob_low,
  CASE WHEN ph >= (1 - ph) * m AND ph >= (1 - ph) * (1 - m) THEN 'High'
       WHEN m >= CAST(1 AS DOUBLE) - m THEN 'Medium' ELSE 'Low' END AS risk_level,
  GREATEST(ph, (1 - ph) * m, (1 - ph) * (1 - m)) AS confidence
FROM (SELECT ci, cj, n, ({h} + 1) / CAST(202 AS DOUBLE) + LEAST(n, 10) / CAST(20 AS DOUBLE) AS ph,
             ({h} % 10) / CAST(10 AS DOUBLE) AS m
      FROM (SELECT ci, cj, n, ((ci*31 + cj*17) % 100 + 100) % 100 AS h FROM cells) c) t
"""

# One rectangle per nation, shifted off the lattice of coordinates so that no point is on an edge.
REGIONS = """
SELECT n_nationkey AS region_id, n_name AS name,
  CAST(-34995 + (n_nationkey % 5) * 3000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS x0,
  CAST(-31995 + (n_nationkey % 5) * 3000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS x1,
  CAST(540005 + ((n_nationkey - n_nationkey % 5) / 5) * 2000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS y0,
  CAST(542005 + ((n_nationkey - n_nationkey % 5) / 5) * 2000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS y1
FROM nation
"""

INCIDENTS = """
SELECT snapshot, 'INC ' || user_id AS incident_num, event_type AS incident_type, ts AS outage_time,
  CAST(floor(value) AS INT) AS customers_affected,
  CAST(floor(floor(value) / 2) AS INT) AS customers_off_supply,
  CASE event_type WHEN 'purchase' THEN 'Restored' ELSE 'Dispatched' END AS incident_status,
  CASE WHEN event_type <> 'error' THEN ts + INTERVAL '4' HOUR END AS estimated_restoration_time,
  CAST(54000 + (user_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
  CAST(-3500 + (user_id * 104729) % 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
FROM (SELECT *, CAST(ts AS DATE) AS snapshot,
        ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) e
WHERE rn = 1
"""

RAW_CHARGEPOINTS = """
SELECT s_suppkey AS row_id,
  '"' || CASE WHEN s_suppkey % 9 = 8 THEN 'Site ' || (s_suppkey - 1) ELSE 'Site ' || s_suppkey END
    || '"' AS place,
  CASE WHEN s_suppkey % 40 = 39 THEN 'n/a' ELSE '' || (54 + s_suppkey % 100 / CAST(128 AS DOUBLE)) END AS lat,
  '' || (-3 + s_suppkey % 60 / CAST(64 AS DOUBLE)) AS lng,
  CASE s_suppkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'Array' ELSE '' END AS vx,
  CASE s_suppkey % 5 WHEN 0 THEN 'Open' WHEN 1 THEN ' open ' WHEN 2 THEN 'cwys' WHEN 3 THEN 'comingsoon'
    ELSE 'check' END AS status
FROM supplier
"""

BUILDING_SITES = "SELECT 'site ' || s_suppkey AS name FROM supplier WHERE s_suppkey % 10 = 1"

LONG_LIST = """
SELECT s_suppkey AS row_id, n_name AS town,
  'Site ' || s_suppkey || CASE s_suppkey % 9 WHEN 0 THEN ' Village Hall' WHEN 1 THEN ' Community Centre'
    WHEN 2 THEN ' community center' WHEN 3 THEN ' Church' WHEN 4 THEN ' Chapel' WHEN 5 THEN ' Memorial Hall'
    WHEN 6 THEN ' Educational Institute' WHEN 7 THEN '' ELSE ' Depot' END AS potential_sites,
  CASE WHEN s_suppkey % 9 = 7 THEN 'Run by the Parish Council' ELSE 'No note' END AS brief_description,
  r_name AS local_authority,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Contact ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN ' ' END AS contact,
  CASE WHEN s_suppkey % 2 = 0 THEN 'c' || s_suppkey || '@example.org' END AS email
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

# Every fourth nation has no authority (found by town only); four nations are left out.
GAZETTEER = """
SELECT n_name AS town, CASE WHEN n_nationkey % 4 <> 0 THEN r_name END AS authority,
  CAST(54100 + ((n_nationkey - n_nationkey % 5) / 5) * 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
  CAST(-3350 + (n_nationkey % 5) * 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_nationkey NOT IN (3, 9, 14, 22)
"""


_READ: dict[tuple[str, str, str], DataFrame] = {}


def use(spark: SparkSession, sf_dir: str) -> SparkSession:
    """Register the tables of one data folder as views; footers are read once per session."""
    configure(spark)
    app = spark.sparkContext.applicationId
    for name in TABLES:
        key = (app, sf_dir, name)
        if key not in _READ:
            _READ[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        _READ[key].createOrReplaceTempView(name)
    return spark


def outages(spark: SparkSession) -> DataFrame:
    return spark.sql(OUTAGES)


def sites(spark: SparkSession) -> DataFrame:
    return spark.sql(SITES)


def cells(raw: DataFrame) -> DataFrame:
    """Outage counts per grid cell."""
    return (
        raw.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(
            cell_index(F.col("latitude")).alias("ci"), cell_index(F.col("longitude")).alias("cj")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def predictions(spark: SparkSession, second: bool = False) -> DataFrame:
    """Deterministic stand-in for a model's output, one row per cell with outages."""
    cells(outages(spark)).createOrReplaceTempView("cells")
    return spark.sql(PREDICTIONS.format(h="(99 - h)" if second else "h"))


def regions(spark: SparkSession) -> DataFrame:
    """Boundary polygons in the shape the polygon operators take."""
    ring = "array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1), array(x0, y0))"
    return spark.sql(
        f"SELECT region_id, name, array(array({ring})) AS polygons FROM ({REGIONS}) r"
    )

