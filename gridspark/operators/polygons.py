"""Point in polygon and polygon joins.

A polygon column is an array of polygons, each an array of rings, each an array of [lon, lat].
Containment is the even-odd rule over all rings, so holes need no special case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.operators.ranking import top_k_per_group
from gridspark.operators.spatial import LATLON, located
from gridspark.session import materialize

SPLIT = 4  # a tile's parts along each axis; tiles of level 0 are 1 / SPLIT degrees wide
LEVELS = 5  # the finest are 1/1024 of a degree
TILE_TESTS = 200_000  # positions times edges above which a border tile is split


def _edges(rings: Column) -> Column:
    """All edges of a polygon, rings closed where they are not."""

    def of(ring: Column) -> Column:
        n = F.size(ring)
        steps = F.when(n >= 2, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

        def edge(i: Column) -> Column:
            a = F.element_at(ring, i)
            b = F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
            return F.struct(
                a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")
            )

        return F.transform(steps, edge)

    return F.flatten(F.transform(rings, of))


def _odd_crossings(edges: Column, lat: Column, lon: Column) -> Column:
    """Whether a ray towards growing longitude crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        at = e["x1"] + F.try_divide((lat - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return straddles & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def contains_point(polygons: Column, lat: Column, lon: Column) -> Column:
    """Whether any polygon contains the point. Points exactly on an edge are unspecified."""
    return F.exists(polygons, lambda rings: _odd_crossings(_edges(rings), lat, lon))


def with_bounds(df: DataFrame, column: str = "polygons") -> DataFrame:
    """Add the bounding box ``x0, x1, y0, y1`` of a polygon column."""
    vertices = F.flatten(F.flatten(F.col(column)))
    xs, ys = F.transform(vertices, lambda v: v[0]), F.transform(vertices, lambda v: v[1])
    return df.withColumns(
        {
            "x0": F.array_min(xs),
            "x1": F.array_max(xs),
            "y0": F.array_min(ys),
            "y1": F.array_max(ys),
        }
    )


def regions_at_point(regions: DataFrame, lat: float, lon: float) -> DataFrame:
    """Regions containing one point."""
    return regions.where(contains_point(F.col("polygons"), F.lit(float(lat)), F.lit(float(lon))))


def region_at_point(regions: DataFrame, lat: float, lon: float) -> DataFrame:
    """The one region of a point: of overlapping ones the first by name."""
    return regions_at_point(regions, lat, lon).orderBy("name").limit(1)


def _tile(x: Column, level: int) -> Column:
    """Tile number of a coordinate; every level's tiles are ``SPLIT`` by ``SPLIT`` in one of the level before."""
    return F.floor(x * F.lit(float(SPLIT ** (1 + level)))).cast("long")


def _clipped(tiles: DataFrame, level: int) -> DataFrame:
    """Tiles (``ti, tj``) of one level with only the edges that decide there, without tiles outside.

    An edge beside the tile's latitudes or west of it is never crossed. One that is east of the tile and spans
    its latitudes always is: it only flips ``_odd``. If no other edge reaches into the tile, its middle
    decides for all of it, and it keeps no edge.
    """
    side = 1.0 / SPLIT ** (1 + level)
    west, south = F.col("tj") * side, F.col("ti") * side
    east, north = west + side, south + side

    def low(e: Column, axis: str) -> Column:
        return F.least(e[f"{axis}1"], e[f"{axis}2"])

    def high(e: Column, axis: str) -> Column:
        return F.greatest(e[f"{axis}1"], e[f"{axis}2"])

    def always(e: Column) -> Column:
        return (low(e, "x") > east) & (low(e, "y") <= south) & (high(e, "y") >= north)

    reach = F.filter("_edges", lambda e: (high(e, "y") > south) & (low(e, "y") < north) & (high(e, "x") >= west))
    middle = _odd_crossings(F.col("_edges"), south + side / 2, west + side / 2) != F.col("_odd")
    border = F.exists("_edges", lambda e: low(e, "x") <= east)
    return (
        tiles.withColumn("_edges", reach)
        .withColumn("_odd", F.col("_odd") != (F.size(F.filter("_edges", always)) % 2 == 1))
        .withColumn("_edges", F.filter("_edges", lambda e: ~always(e)))
        .withColumns({"_border": border, "_middle": middle})
        .where("_border OR _middle")
        .withColumn("_edges", F.when(F.col("_border"), F.col("_edges")).otherwise(F.slice("_edges", 1, 0)))
        .drop("_middle")
    )


def cover(places: DataFrame, parts: DataFrame, region_cols=("name",)) -> DataFrame:
    """Tiles of several levels that cover ``parts`` (``_rings``) where ``places`` lie, stored.

    Inner tiles have no edges and need no test. A border tile is split while positions times edges exceed
    ``TILE_TESTS``, so dense places and long outlines spread over many small tiles. Tiles without positions go.
    Columns: ``region_cols``, ``level, ti, tj``, ``_edges``, ``_odd``, ``_border``.
    """
    last = LEVELS - 1
    finest = places.groupBy(_tile(F.col("site_lat"), last).alias("ti"), _tile(F.col("site_lon"), last).alias("tj"))
    finest = materialize(finest.agg(F.count(F.lit(1)).alias("_places")), "polygon-places")

    def counts(level: int) -> DataFrame:
        up = SPLIT ** (last - level)
        keys = [F.floor(F.col(c) / up).cast("long").alias(c) for c in ("ti", "tj")]
        return finest.groupBy(*keys).agg(F.sum("_places").alias("_places"))

    vertices = F.flatten("_rings")
    xs, ys = F.transform(vertices, lambda v: v[0]), F.transform(vertices, lambda v: v[1])
    rows = F.sequence(_tile(F.array_min(ys), 0), _tile(F.array_max(ys), 0))
    columns = F.sequence(_tile(F.array_min(xs), 0), _tile(F.array_max(xs), 0))
    tiles = parts.where(F.size(vertices) > 0).select(
        *region_cols, _edges(F.col("_rings")).alias("_edges"), F.lit(False).alias("_odd"),
        rows.alias("_rows"), columns.alias("_columns"),
    )
    tiles = tiles.withColumn("ti", F.explode("_rows")).drop("_rows")
    in_band = F.filter(
        "_edges",
        lambda e: (F.least(e["y1"], e["y2"]) * SPLIT < F.col("ti") + 1) & (F.greatest(e["y1"], e["y2"]) * SPLIT > F.col("ti")),
    )
    tiles = tiles.withColumn("_edges", in_band).withColumn("tj", F.explode("_columns")).drop("_columns")

    def inner(c: str) -> Column:
        return F.sequence(F.col(c) * SPLIT, F.col(c) * SPLIT + SPLIT - 1)

    done = []
    for level in range(LEVELS):
        known = _clipped(tiles.join(counts(level), ["ti", "tj"]), level)
        crowded = F.col("_border") & (F.col("_places") * F.size("_edges") > TILE_TESTS) & F.lit(level < last)
        known = materialize(known.withColumn("_crowded", crowded), "polygon-tiles")
        done.append(
            known.where("NOT _crowded").select(*region_cols, F.lit(level).alias("level"), "ti", "tj", "_edges", "_odd", "_border")
        )
        open_tiles = known.where("_crowded")
        if level == last or not open_tiles.limit(1).count():
            break
        tiles = open_tiles.select(
            *region_cols, "_edges", "_odd", "tj", F.explode(inner("ti")).alias("ti")
        ).select(*region_cols, "_edges", "_odd", "ti", F.explode(inner("tj")).alias("tj"))
    return reduce(DataFrame.unionByName, done)


def _hits(points: DataFrame, regions: DataFrame, at, region_cols) -> DataFrame:
    """Positions with the polygon parts containing them (a region once per part).

    Positions meet the tiles of :func:`cover` under their tile of every level; in inner tiles nothing is left
    to test, in border tiles only the edges that reach into them.
    """
    lat, lon = F.col("site_lat"), F.col("site_lon")
    places = located(points, at).select(F.col(at[0]).cast("double").alias("site_lat"), F.col(at[1]).cast("double").alias("site_lon"))
    places = materialize(places.where(~F.isnan(lat) & ~F.isnan(lon)).distinct(), "polygon-positions")
    tiles = cover(places, regions.select(*region_cols, F.explode("polygons").alias("_rings")), region_cols)
    levels = sorted(r["level"] for r in tiles.select("level").distinct().collect())  # at most LEVELS
    keys = [F.struct(F.lit(k).alias("level"), _tile(lat, k).alias("ti"), _tile(lon, k).alias("tj")) for k in levels or [0]]
    near = places.select("site_lat", "site_lon", F.inline(F.array(*keys))).join(tiles, ["level", "ti", "tj"])
    inside = near.where(F.when(F.col("_border"), _odd_crossings(F.col("_edges"), lat, lon) != F.col("_odd")).otherwise(F.lit(True)))
    return inside.select("site_lat", "site_lon", *region_cols)


def polygon_pairs(
    points: DataFrame, regions: DataFrame, at: tuple[str, str] = LATLON, region_cols=("name",)
) -> DataFrame:
    """Distinct point positions (``site_lat``, ``site_lon``) with the regions containing them."""
    return _hits(points, regions, at, region_cols).distinct()


def tag_regions(
    points: DataFrame, regions: DataFrame, at: tuple[str, str] = LATLON, tag: str = "region"
) -> DataFrame:
    """Every row with the name of its region, null outside; the smallest name where they overlap."""
    missing = [c for c in at if c not in points.columns]
    if missing:
        raise ValueError(f"missing coordinate columns: {missing}")
    found = (
        _hits(points, regions, at, ("name",))
        .groupBy(F.col("site_lat").alias("_slat"), F.col("site_lon").alias("_slon"))
        .agg(F.min("name").alias(tag))
    )
    on = (F.col(at[0]) == F.col("_slat")) & (F.col(at[1]) == F.col("_slon"))
    return points.join(found, on, "left").drop("_slat", "_slon")


def tag_summary(
    tagged: DataFrame, at: tuple[str, str] = LATLON, tag: str = "region"
) -> DataFrame:
    """Counts of processed, valid, tagged and untagged rows and of distinct regions."""
    valid = F.count_if(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
    hits = F.count(tag)
    return tagged.agg(
        F.count(F.lit(1)).alias("processed"),
        valid.alias("valid_coordinates"),
        hits.alias("tagged"),
        (valid - hits).alias("untagged"),
        F.count_distinct(tag).alias("regions_found"),
    )


# --- tenders -----------------------------------------------------------------------------------


def dissolve(tenders: DataFrame, key: str = "substation_name", order: str = "feature_id"):
    """One row per substation: the first non-null value of every attribute, number of records.

    The shape of a substation is the set of its parts (see ``substation_parts``); edges between
    touching parts are not removed, which changes no containment.
    """
    attributes = [c for c in tenders.columns if c not in (key, order, "polygons", "geometry_type")]

    def first_value(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)

    return tenders.groupBy(key).agg(
        F.count(F.lit(1)).alias("contracts"), *[first_value(c) for c in attributes]
    )


def substation_parts(tenders: DataFrame, key: str = "substation_name") -> DataFrame:
    """The distinct polygons of every substation, one per row."""
    parts = tenders.select(key, F.explode("polygons").alias("polygon")).distinct()
    return parts.select(F.col(key).alias("name"), F.array("polygon").alias("polygons"))


def contracts_in_order(tenders: DataFrame, key: str = "substation_name") -> DataFrame:
    """All contract records sorted by substation and delivery start (a range-partitioned sort)."""
    return tenders.drop("polygons").orderBy(key, "delivery_start_date", "feature_id")


# Which tender fields describe the region and which the contract.
REGION_CARD_FIELDS = (
    "substation_name", "post_codes", "voltage_of_connection_kv", "maximum_requirement_mva",
    "easting", "northing", "lat", "long",
)
CONTRACT_FIELDS = (
    "need_type", "delivery_start_date", "months_required", "times_required", "days_required",
    "maximum_utilisation_price_mw", "estimated_availability_hours",
    "estimated_utilisation_hours", "period", "site_number", "ceiling_price_period",
)


def region_cards(tenders: DataFrame) -> DataFrame:
    """The region fields of every substation, from its first contract."""
    order = [F.col("delivery_start_date"), F.col("feature_id")]
    first = top_k_per_group(tenders, ["substation_name"], order, 1)
    return first.select(*REGION_CARD_FIELDS)


def contract_rows(tenders: DataFrame) -> DataFrame:
    """Contract fields with the heading under which a contract is shown."""
    blank = F.lit("—")
    heading = F.concat_ws(
        " | ", *[F.coalesce(c, blank) for c in ("need_type", "delivery_start_date", "period")]
    )
    return tenders.select(
        "substation_name", "feature_id", heading.alias("heading"), *CONTRACT_FIELDS
    )


def tender_counts(tenders: DataFrame) -> DataFrame:
    """Number of polygons and of distinct substations."""
    return tenders.agg(
        F.count(F.lit(1)).alias("polygons"),
        F.count_distinct("substation_name").alias("substations"),
    )


def tender_breakdown(tenders: DataFrame) -> DataFrame:
    """Counts by need, voltage and geometry type in one pass over the tenders."""
    fields = ("need_type", "voltage_of_connection_kv", "geometry_type")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields]
    )
    return (
        tenders.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
