"""Row-level cleaning: derived outage fields, charge point cleaning, community sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions import outage as out
from gridspark.functions.coerce import blank_to_null, to_double, unquote
from gridspark.operators.ranking import keep_first

# --- outages -----------------------------------------------------------------------------------


def derive_fields(df: DataFrame, null_as_longest: bool = False) -> DataFrame:
    """Add the derived outage columns to a typed outage table."""
    local = out.local_time(F.col("incident_date_time"))
    hours = out.duration_hours(
        F.col("incident_duration"), F.col("incident_date_time"), F.col("restoration_date_time")
    )
    return (
        df.withColumn("duration_hours", hours)
        .withColumn("_local", local)
        .withColumns(
            {
                "year": F.year("_local"),
                "month_name": F.element_at(
                    F.array(*[F.lit(m) for m in out.MONTHS]), F.month("_local")
                ),
                "hour": F.hour("_local"),
                "season": out.season_of(F.month("_local")),
                "duration_category": out.duration_category(
                    F.col("duration_hours"), null_as_longest
                ),
                "is_exceptional_event": out.is_exceptional(F.col("exceptional_event_id")),
            }
        )
        .drop("_local")
    )


def with_display_aliases(df: DataFrame) -> DataFrame:
    """Add the two spelled-out column names that older reports read."""
    return df.withColumns(
        {
            "Incident Date-time": F.col("incident_date_time"),
            "Total Customer Minutes Lost": F.col("total_customer_minutes_lost"),
        }
    )


def coerce_numbers(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Numeric coercion with a fill value for what is missing or unreadable."""
    return df.withColumns({c: to_double(F.col(c), fill) for c in columns})


# --- charge points -----------------------------------------------------------------------------

# Header spellings of the raw exports, per target column.
CHARGEPOINT_ALIASES = {
    "charge_point_location": (
        "field_place_name|value", "place_name", "field_site_name|value", "location",
        "charge_point_location", "site_name",
    ),
    "latitude": ("field_latitude|value", "latitude", "lat", "lat_val"),
    "longitude": ("field_longitude|value", "longitude", "lon", "lng", "long"),
    "vx_flag": ("field_vx_bool|value", "vx", "v2x", "vx_flag"),
    "site_category": ("category", "site_category"),
    "cp_status": ("field_cp_status|value", "cp_status", "status", "field_cp_status"),
}

# Locations whose chargers are powered by the host building.
BUILDING_SUPPLIED_SITES = (
    "Rydal Hall",
    "Keswick Quaker Meeting House",
    "Alresford Parish Council Car Park",
    "Bampton Memorial Hall",
    "Eaglesfield Village Hall",
    "Skelton Toppin Memorial Hall",
    "Gamblesby Community Centre",
    "Adams Recreation Ground",
    "Arnside Educational Institute",
    "Cedar Road Car Park, Marsh, Lancaster",
    "Alston Community Gym, Tyne Willows",
    "Yealands Village Hall",
    "Stanhope Masonic Hall",
    "Weardale Community Transport",
    "Hamsterley Colliery",
    "Newbiggin Village Hall",
    "Haven Cottage B&B",
)

# The site categories.
V2X, BUILDING, OTHER = "V2X Chargepoint", "Building-supplied Charger", "Other Chargepoint"
SITE_CATEGORIES = (V2X, BUILDING, OTHER)

_SITE_COLUMNS = ("charge_point_location", "site_category", "latitude", "longitude")


def rename_by_alias(df: DataFrame, aliases=CHARGEPOINT_ALIASES) -> DataFrame:
    """Rename columns whose lower-cased header is a known spelling."""
    target = {spelling: name for name, group in aliases.items() for spelling in group}
    renames = {c: target[c.lower().strip()] for c in df.columns if c.lower().strip() in target}
    return df.withColumnsRenamed(renames)


def normalise_chargepoints(df: DataFrame) -> DataFrame:
    """Strip blanks and quotes, read the V2X flag as a number, lower-case the status."""
    changes = {
        c: unquote(F.col(c))
        for c in ("charge_point_location", "latitude", "longitude")
        if c in df.columns
    }
    if "vx_flag" in df.columns:
        changes["vx_flag"] = to_double(unquote(F.col("vx_flag")), 0.0).cast("int")
    status = unquote(F.col("cp_status")) if "cp_status" in df.columns else F.lit(None)
    changes["cp_status"] = F.coalesce(F.lower(status.cast("string")), F.lit("unknown"))
    return df.withColumns(changes)


def site_category(
    name: Column, vx: Column, status: Column, is_building: Column | None = None
) -> Column:
    """Category of a charge point, or null where it is neither active nor building-supplied."""
    if is_building is None:
        known = [n.lower() for n in BUILDING_SUPPLIED_SITES]
        is_building = F.lower(F.trim(name)).isin(*known)
    return (
        F.when((vx >= 1) & status.isin("open", "cwys"), V2X)
        .when(F.coalesce(is_building, F.lit(False)), BUILDING)
        .when((vx < 1) & (status == "open"), OTHER)
    )


def clean_chargepoints(raw: DataFrame, order: str, buildings: DataFrame | None = None):
    """Raw export to the cleaned site table.

    ``order`` names a column giving the order of the rows; of rows with the same location the
    first is kept. ``buildings`` (one ``name`` column, lower case) replaces the fixed list.
    """
    df = normalise_chargepoints(rename_by_alias(raw))
    if "vx_flag" not in df.columns:
        df = df.withColumn("vx_flag", F.lit(0))
    missing = [c for c in _SITE_COLUMNS if c != "site_category" and c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    flag = None
    if buildings is not None:
        listed = buildings.select(
            F.lower(F.trim("name")).alias("_key"), F.lit(True).alias("_building")
        ).distinct()
        key = F.lower(F.trim("charge_point_location"))
        df = df.withColumn("_key", key).join(listed, "_key", "left")
        flag = F.col("_building")
    category = site_category(
        F.col("charge_point_location"), F.col("vx_flag"), F.col("cp_status"), flag
    )
    active = df.withColumn("site_category", category).where(F.col("site_category").isNotNull())
    first = keep_first(
        active.select(order, *_SITE_COLUMNS), ["charge_point_location"], [F.col(order)]
    )
    coords = {c: to_double(F.col(c)) for c in ("latitude", "longitude")}
    return first.withColumns(coords).na.drop(subset=["latitude", "longitude"]).drop(order)


# --- community sites ---------------------------------------------------------------------------

# Keyword to site type; the first keyword found decides.
SITE_TYPE_KEYWORDS = (
    ("village hall", "Village Hall"),
    ("community centre", "Community Centre"),
    ("community center", "Community Centre"),
    ("church", "Community Building"),
    ("chapel", "Community Building"),
    ("memorial hall", "Community Building"),
    ("educational institute", "Community Building"),
    ("parish council", "Community Building"),
)

COMMUNITY_PATTERN = "(?i)Village Hall|Community Centre|Community Center"


def site_type(potential: Column, description: Column) -> Column:
    """Type of a community site from its name and description."""
    text = F.lower(F.concat_ws(" ", potential, description))
    result = F
    for keyword, kind in SITE_TYPE_KEYWORDS:
        result = result.when(F.contains(text, F.lit(keyword)), kind)
    return result.otherwise("Other Community Site")


def is_community_building(name: Column) -> Column:
    return F.coalesce(name.rlike(COMMUNITY_PATTERN), F.lit(False))


def name_long_list(df: DataFrame) -> DataFrame:
    """Site name and type, contact and e-mail with blanks as null."""
    text = {c: F.trim(c) for c in ("town", "potential_sites", "brief_description")}
    df = df.withColumns({**text, "local_authority": F.trim("local_authority")})
    return df.withColumns(
        {
            "site_name": F.concat_ws(" - ", "town", "potential_sites"),
            "site_type": site_type(F.col("potential_sites"), F.col("brief_description")),
            "contact": blank_to_null(F.col("contact")),
            "email": blank_to_null(F.col("email")),
        }
    )


def locate_places(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates by (town, authority), else by town alone, rounded to 6 digits.

    The gazetteer has ``town``, ``authority`` (nullable), ``latitude``, ``longitude``. Of several
    entries with the same key the smallest position is taken, so a row never multiplies.
    """
    town = F.lower(F.trim("town"))
    position = F.struct(
        F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude")
    )
    places = gazetteer.na.drop(subset=["latitude", "longitude"]).select(
        town.alias("_town"), F.lower(F.trim("authority")).alias("_authority"), position.alias("_p")
    )
    exact = places.na.drop().groupBy("_town", "_authority").agg(F.min("_p").alias("_exact"))
    loose = places.groupBy("_town").agg(F.min("_p").alias("_loose"))
    keyed = df.withColumns({"_town": town, "_authority": F.lower(F.trim("local_authority"))})
    found = keyed.join(exact, ["_town", "_authority"], "left").join(loose, "_town", "left")
    best = F.coalesce("_exact", "_loose")
    return found.withColumns(
        {"latitude": best["latitude"], "longitude": best["longitude"]}
    ).drop("_town", "_authority", "_exact", "_loose")


def place_summary(located: DataFrame) -> DataFrame:
    """How many sites got coordinates."""
    hits = F.count("latitude")
    total = F.count(F.lit(1))
    return located.agg(
        total.alias("total_sites"), hits.alias("geocoded"), (total - hits).alias("failed_geocode")
    )
