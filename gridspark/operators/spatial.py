"""Radius and nearest joins.

Coordinates repeat (outages are recorded at a substation or post code), so both joins first reduce
each side to its distinct positions with a map-side combine. That takes any hot position out of
the shuffle and bounds a bucket by the number of positions it can hold, whatever the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.functions import geo
from gridspark.operators.skew import SPLIT_ROWS, split_hot_keys
from gridspark.session import materialize

LATLON = ("latitude", "longitude")


def located(df: DataFrame, at: tuple[str, str] = LATLON) -> DataFrame:
    """Rows with both coordinates."""
    return df.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())


def within_radius(
    df: DataFrame,
    lat: float,
    lon: float,
    radius: float = geo.TWO_MILES_KM,
    metric: str = "haversine",
    at: tuple[str, str] = LATLON,
    strict: bool = False,
    distance: str | None = None,
) -> DataFrame:
    """Rows within ``radius`` of one point. The bounding box reaches the scan as a pushed filter."""
    lat0, lat1, lon0, lon1 = geo.bounding_box(lat, lon, radius, metric)
    y, x = F.col(at[0]), F.col(at[1])
    d = geo.distance(metric, F.lit(float(lat)), F.lit(float(lon)), y, x)
    beside = x.between(lon0, lon1)
    if metric == "haversine" and (lon0 < -180.0 or lon1 > 180.0):  # longitudes are a circle
        beside = beside | x.between(lon0 + 360.0, lon1 + 360.0) | x.between(lon0 - 360.0, lon1 - 360.0)
    near = df.where(y.between(lat0, lat1) & beside)
    near = near.where(d < radius if strict else d <= radius)
    return near.withColumn(distance, d) if distance else near


def nearest_to_point(
    df: DataFrame,
    lat: float,
    lon: float,
    k: int,
    tie: list[str],
    metric: str = "haversine",
    at: tuple[str, str] = LATLON,
    distance: str = "distance_km",
) -> DataFrame:
    """The ``k`` rows nearest to one point (TakeOrderedAndProject)."""
    d = geo.distance(metric, F.lit(float(lat)), F.lit(float(lon)), F.col(at[0]), F.col(at[1]))
    return (
        located(df, at)
        .withColumn(distance, d)
        .orderBy(F.round(F.col(distance), 9), *tie)
        .limit(k)
    )


def radius_join(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    metric: str = "haversine",
    strict: bool = False,
    distance: str = "distance_km",
    split_rows: int | None = SPLIT_ROWS,
    repeat: str = "left",
) -> DataFrame:
    """All pairs within ``radius``; column names of the two sides must not overlap.

    The ``repeat`` side, which should be the smaller one, has its rows repeated once per bucket in
    reach; the other side keeps one row per point. Its buckets with more than ``split_rows``
    points are split. Haversine buckets form a ring, so pairs across 180 degrees are found.
    """
    keys = ["band", "slot"]
    few, few_at, many, many_at = left, left_at, right, right_at
    if repeat == "right":
        few, few_at, many, many_at = right, right_at, left, left_at
    near = geo.buckets_near(F.col(few_at[0]), F.col(few_at[1]), radius, metric)
    mine = located(few, few_at).withColumn("_b", F.explode(near)).select("*", "_b.*").drop("_b")
    own = geo.bucket_of(F.col(many_at[0]), F.col(many_at[1]), radius, metric)
    theirs = located(many, many_at).withColumn("_b", own).select("*", "_b.*").drop("_b")
    if split_rows:
        theirs, mine = split_hot_keys(theirs, mine, keys, split_rows)
        keys = [*keys, "_part"]
    d = geo.distance(
        metric, F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1])
    )
    pairs = mine.join(theirs, keys).drop(*keys).withColumn(distance, d)
    return pairs.where(F.col(distance) < radius if strict else F.col(distance) <= radius)


# How a measure is computed per position and merged over positions.
_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def radius_aggregate(
    sites: DataFrame,
    points: DataFrame,
    radius: float,
    measures: dict[str, tuple[str, Column]],
    site_at: tuple[str, str] = LATLON,
    point_at: tuple[str, str] = LATLON,
    by: list[str] = (),
    metric: str = "haversine",
    strict: bool = False,
    repeat: str = "left",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Aggregates of the points around every distinct site position.

    ``measures`` maps a name to ``(kind, column)`` with kind count, sum, min or max. Points are
    combined per position (and ``by``) before the join, so the join sees positions, not rows. Buckets
    with many positions are split, and what their parts find is merged like the rest.
    Returns ``site_lat``, ``site_lon``, ``by`` and the measures; positions with nothing in reach
    are absent.
    """
    partial = (
        located(points, point_at)
        .groupBy(F.col(point_at[0]).alias("_plat"), F.col(point_at[1]).alias("_plon"), *by)
        .agg(*[_PARTIAL[kind](col).alias(name) for name, (kind, col) in measures.items()])
    )
    places = (
        located(sites, site_at)
        .select(F.col(site_at[0]).alias("site_lat"), F.col(site_at[1]).alias("site_lon"))
        .distinct()
    )
    if repeat == "right":
        places = materialize(places, "places")
    else:
        partial = materialize(partial, "positions")  # read for the buckets' sizes and for the join
    pairs = radius_join(
        places, partial, radius, ("site_lat", "site_lon"), ("_plat", "_plon"), metric, strict,
        distance="_d", split_rows=split_rows, repeat=repeat,
    )
    return pairs.groupBy("site_lat", "site_lon", *by).agg(
        *[_MERGE[kind](name).alias(name) for name, (kind, _) in measures.items()]
    )


def attach_by_position(
    df: DataFrame, stats: DataFrame, at: tuple[str, str] = LATLON, how: str = "left"
) -> DataFrame:
    """Join per-position results (``site_lat``, ``site_lon``) back to the rows."""
    named = stats.withColumnsRenamed({"site_lat": "_slat", "site_lon": "_slon"})
    on = (F.col(at[0]) == F.col("_slat")) & (F.col(at[1]) == F.col("_slon"))
    return df.join(named, on, how).drop("_slat", "_slon")


# --- nearest join ------------------------------------------------------------------------------
# The right side is put on a pyramid of grids. Every occupied cell of the left side starts
# with the coarse right cells and refines them level by level; a right cell is dropped once its
# least possible distance exceeds what another one guarantees. What is left is a handful of
# candidate cells per left cell, near or far, dense or sparse. Where two of them still hold too many points to
# compare all with all, both sides of that left cell are divided further, as often as it takes, so a
# crowded cell costs about as much per point as any other. No radius is guessed, nothing is
# retried, and every step joins on cell keys.

_CELL = 0.01
_FANOUT = 8
_LEVELS = 3  # 0.01, 0.08, 0.64, 5.12 degrees: the coarsest has at most 36 x 71 cells on Earth
_CROWDED = 4096  # pairs of points that two cells may have
_PARTS = 4  # a crowded cell is cut into 4 x 4
_DEPTHS = 5  # so often at most: about a metre
_FINE = _PARTS**_DEPTHS


def _pyramid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Right cells of all grids with their numbers of points and the key of the cell above, stored.

    Spark sees the table's size, and where it is small the left cells need no shuffle per level.
    """
    out = None
    for level in range(_LEVELS + 1):
        f = float(_FANOUT**level)
        i, j = F.floor(F.col("ri") / f).alias("ri"), F.floor(F.col("rj") / f).alias("rj")
        grid = cells.groupBy(*keys, i, j).agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
        out = grid if out is None else out.unionByName(grid)
    up = {"pi": F.floor(F.col("ri") / _FANOUT), "pj": F.floor(F.col("rj") / _FANOUT)}
    return materialize(out.withColumns(up), "pyramid")


def _box(i: str, j: str, size: float):
    pad = 1e-9
    lat, lon = F.col(i) * size - 90.0, F.col(j) * size - 180.0
    return lat - pad, lat + (size + pad), lon - pad, lon + (size + pad)


def _prune(pairs: DataFrame, left: float, right: float, metric: str, k: int, keys: list[str]) -> DataFrame:
    """Drop right cells that cannot hold one of the ``k`` nearest of their left cell; sizes in degrees."""
    low, high = geo.box_bounds(metric, _box("li", "lj", left), _box("ri", "rj", right))
    scored = pairs.withColumn("_low", low).withColumn("_high", high)
    cell = Window.partitionBy(*keys, "li", "lj")
    if k == 1:
        bound = F.min("_high").over(cell)
    else:
        # the guarantee of the k-th point: count points in order of their cell's guarantee
        running = F.sum("n").over(cell.orderBy("_high").rangeBetween(Window.unboundedPreceding, 0))
        scored = scored.withColumn("_seen", running)
        enough = F.min(F.when(F.col("_seen") >= k, F.col("_high"))).over(cell)
        bound = F.coalesce(enough, F.lit(float("inf")))
    kept = scored.withColumn("_bound", bound).where(
        F.col("_low") <= F.col("_bound") * (1.0 + 1e-9) + 1e-15
    )
    return kept.select(*keys, "li", "lj", "m", "ri", "rj", "n")


def _candidate_cells(
    left: DataFrame, right: DataFrame, metric: str, k: int, keys: list[str]
) -> DataFrame:
    """Pairs of cells (with their numbers of points) that can hold one of the ``k`` nearest."""
    # Start: the coarsest right cells (at most 36 x 71, usually a few) for every left cell. Without
    # keys they travel as one array; either way the left cells stay where they are.
    pyramid = _pyramid(right, keys)
    root = pyramid.where(F.col("level") == _LEVELS).select(*keys, "ri", "rj", "n")
    if keys:
        start = left.join(root, keys)
    else:
        cells = root.agg(F.collect_list(F.struct("ri", "rj", "n")).alias("r")).scalar()
        start = left.select("li", "lj", "m", F.inline(cells))
    front = _prune(start, _CELL, _CELL * _FANOUT**_LEVELS, metric, k, keys)
    for level in range(_LEVELS - 1, -1, -1):
        parents = front.drop("n").withColumnsRenamed({"ri": "pi", "rj": "pj"})
        pairs = parents.join(pyramid.where(F.col("level") == level).drop("level"), [*keys, "pi", "pj"])
        front = _prune(pairs.drop("pi", "pj"), _CELL, _CELL * _FANOUT**level, metric, k, keys)
    return front


def _fine(lat: str, lon: str) -> dict[str, Column]:
    """The smallest cell of a point; all larger ones follow from it."""
    size = _CELL / _FINE
    return {"_fi": F.floor((F.col(lat) + 90.0) / size), "_fj": F.floor((F.col(lon) + 180.0) / size)}


def _at_depth(points: DataFrame, depth: int, i: str, j: str) -> DataFrame:
    """``points`` with their cell after so many divisions."""
    f = float(_PARTS ** (_DEPTHS - depth))
    return points.withColumns({i: F.floor(F.col("_fi") / f), j: F.floor(F.col("_fj") / f)})


def _cells_at(points: DataFrame, depth: int, keys: list[str], i: str, j: str, n: str) -> DataFrame:
    return _at_depth(points, depth, i, j).groupBy(*keys, i, j).agg(F.count(F.lit(1)).alias(n))


def _divided(near: DataFrame, a: DataFrame, b: DataFrame, depth: int, metric: str, k: int, keys: list[str]) -> DataFrame:
    """Candidates after one more division of both sides."""
    f = float(_PARTS)
    left = _cells_at(a, depth, keys, "li", "lj", "m").withColumns(
        {"_pi": F.floor(F.col("li") / f), "_pj": F.floor(F.col("lj") / f)}
    )
    right = _cells_at(b, depth, keys, "ri", "rj", "n").withColumns(
        {"_qi": F.floor(F.col("ri") / f), "_qj": F.floor(F.col("rj") / f)}
    )
    parents = near.select(
        *keys, F.col("li").alias("_pi"), F.col("lj").alias("_pj"), F.col("ri").alias("_qi"), F.col("rj").alias("_qj")
    )
    pairs = parents.join(left, [*keys, "_pi", "_pj"]).join(right, [*keys, "_qi", "_qj"])
    size = _CELL / _PARTS**depth
    return _prune(pairs, size, size, metric, k, keys)


def _near_points(a: DataFrame, b: DataFrame, metric: str, k: int, keys: list[str]) -> DataFrame:
    """Pairs of points of all candidate cells, crowded ones divided first."""
    left = _cells_at(a, 0, keys, "li", "lj", "m")
    right = _cells_at(b, 0, keys, "ri", "rj", "n")
    near = materialize(_candidate_cells(left, right, metric, k, keys), "near")
    out, cell = None, [*keys, "li", "lj"]
    for depth in range(_DEPTHS + 1):
        crowded = near.groupBy(*cell).agg(F.max(F.col("m") * F.col("n")).alias("_pairs"))
        crowded = crowded.where(F.col("_pairs") > _CROWDED)
        done = depth == _DEPTHS or crowded.isEmpty()
        ready = near if done else near.join(crowded, cell, "left_anti")
        x = _at_depth(a, depth, "li", "lj").drop("_fi", "_fj")
        y = _at_depth(b, depth, "ri", "rj").drop("_fi", "_fj")
        pairs = x.join(ready.drop("m", "n"), cell).join(y, [*keys, "ri", "rj"]).drop("li", "lj", "ri", "rj")
        out = pairs if out is None else out.unionByName(pairs)
        if done:
            return out
        rest = near.join(crowded, cell, "left_semi")
        near = materialize(_divided(rest, a, b, depth + 1, metric, k, keys), "near")


def nearest_by_position(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    tie: list[str],
    k: int = 1,
    metric: str = "haversine",
    distance: str = "distance_km",
    rank: str = "rank",
    keys: list[str] = (),
) -> DataFrame:
    """The ``k`` nearest right rows of every distinct left position, exactly.

    Returns ``site_lat``, ``site_lon``, all right columns, the distance and the 1-based rank.
    Equal distances (to a micrometre) are ordered by ``tie``. With ``keys`` only rows with equal
    keys are compared, and positions are distinct per key.
    """
    keys = list(keys)
    payload = [c for c in right.columns if c not in right_at and c not in keys]
    places = (
        located(left, left_at)
        .select(*keys, F.col(left_at[0]).alias("site_lat"), F.col(left_at[1]).alias("site_lon"))
        .distinct()
    )
    valid = located(right, right_at)
    if k == 1:
        # one row per position is enough, chosen map-side
        first = F.min_by(F.struct(*payload), F.struct(*tie)).alias("_row")
        rows = valid.groupBy(*keys, *right_at).agg(first).select(*keys, *right_at, "_row.*")
    else:
        order = Window.partitionBy(*keys, *right_at).orderBy(*tie)
        rows = valid.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= k).drop("_o")
    # Both sides are used on every level and once more for the points. Stored once in the shared
    # folder, whatever lies behind them is computed once.
    a = materialize(places.withColumns(_fine("site_lat", "site_lon")), "left")
    b = materialize(rows.withColumns(_fine(*right_at)), "right")
    pairs = _near_points(a, b, metric, k, keys)
    d = geo.distance(
        metric, F.col("site_lat"), F.col("site_lon"), F.col(right_at[0]), F.col(right_at[1])
    )
    pairs = pairs.withColumn(distance, d)
    order = [F.round(F.col(distance), 9), *[F.col(t) for t in tie]]
    best = Window.partitionBy(*keys, "site_lat", "site_lon").orderBy(*order)
    return pairs.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k)


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    tie: list[str],
    k: int = 1,
    metric: str = "haversine",
    distance: str = "distance_km",
    how: str = "left",
) -> DataFrame:
    """Every left row with its ``k`` nearest right rows; column names must not overlap.

    With ``k`` above one a 1-based ``rank`` column is added. Left rows without coordinates keep
    null right columns under a left join.
    """
    found = nearest_by_position(left, right, left_at, right_at, tie, k, metric, distance)
    if k == 1:
        found = found.drop("rank")
    return attach_by_position(left, found, left_at, how)


def radius_exists(
    df: DataFrame,
    other: DataFrame,
    radius: float,
    at: tuple[str, str],
    other_at: tuple[str, str],
    strict: bool = False,
    negate: bool = False,
) -> DataFrame:
    """Rows with (or, negated, without) any row of ``other`` in reach: a semi or anti join."""
    hits = radius_aggregate(df, other, radius, {"_hits": ("count", F.lit(1))}, at, other_at,
                            strict=strict)
    found = hits.select(F.col("site_lat").alias("_slat"), F.col("site_lon").alias("_slon"))
    on = (F.col(at[0]) == F.col("_slat")) & (F.col(at[1]) == F.col("_slon"))
    return df.join(found, on, "left_anti" if negate else "left_semi")
