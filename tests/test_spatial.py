"""Bucketed joins against brute force on random points, and polygon edge cases."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridspark.operators import polygons, spatial

L, R = ("llat", "llon"), ("rlat", "rlon")


def km(a, b, metric):
    (p1, l1), (p2, l2) = a, b
    if metric != "haversine":
        flat = math.hypot(p2 - p1, l2 - l1)
        return flat * (6371.0 * math.pi / 180 if metric == "planar_rad" else 1.0)
    p1, l1, p2, l2 = map(math.radians, (p1, l1, p2, l2))
    a = math.sin((p2 - p1) / 2) ** 2
    a += math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(a)))


def points(n, seed, lat=(53.0, 56.0), lon=(-4.0, -1.0), hot=0):
    rng = random.Random(seed)
    out = [(round(rng.uniform(*lat), 3), round(rng.uniform(*lon), 3)) for _ in range(n)]
    return out + [out[0]] * hot


def frames(spark, left, right):
    a = [(i, *p) for i, p in enumerate(left)] + [(len(left), None, 1.0)]
    b = [(i, *p) for i, p in enumerate(right)] + [(len(right), 1.0, None)]
    return (
        spark.createDataFrame(a, "lid int, llat double, llon double"),
        spark.createDataFrame(b, "rid int, rlat double, rlon double"),
    )


@pytest.mark.parametrize(
    "metric, radius, lat",
    [
        ("haversine", 12.0, (53.0, 56.0)),
        ("haversine", 40.0, (-2.0, 2.0)),
        ("haversine", 60.0, (80.0, 89.9)),
        ("planar_rad", 12.0, (53.0, 56.0)),
        ("planar_deg", 0.2, (53.0, 56.0)),
    ],
)
@pytest.mark.parametrize("split", [None, 20])
def test_radius_join_is_brute_force(spark, metric, radius, lat, split):
    left, right = points(40, 1, lat), points(300, 2, lat, hot=100)
    a, b = frames(spark, left, right)
    got = spatial.radius_join(a, b, radius, L, R, metric, split_rows=split)
    pairs = [(r["lid"], r["rid"]) for r in got.collect()]
    want = {
        (i, j) for i, p in enumerate(left) for j, q in enumerate(right) if km(p, q, metric) <= radius
    }
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == want


@pytest.mark.parametrize("metric", ["haversine", "planar_rad", "planar_deg"])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_brute_force(spark, metric, k):
    # far outliers on both sides, repeated positions, a dense cluster
    left = points(60, 3, hot=20) + [(58.9, -6.5), (50.1, 1.7), (-30.0, 140.0)]
    right = points(200, 4, hot=50) + points(100, 5, (54.0, 54.05), (-2.0, -1.95)) + [(57.5, -6.0)]
    a, b = frames(spark, left, right)
    got = spatial.nearest_join(a, b, L, R, ["rid"], k=k, metric=metric).collect()
    by_left = {}
    for r in got:
        by_left.setdefault(r["lid"], []).append(r)
    assert by_left[len(left)][0]["rid"] is None
    for i, p in enumerate(left):
        want = sorted((round(km(p, q, metric), 9), j) for j, q in enumerate(right))[:k]
        rows = sorted(by_left[i], key=lambda r: r["rank"]) if k > 1 else by_left[i]
        assert [r["rid"] for r in rows] == [j for _, j in want]


@pytest.mark.parametrize("count", [20, 300])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_wraps_at_half_a_turn(spark, count, k):
    left = [(0.5, 179.999), (-40.0, -179.995), (10.0, 180.0), (60.0, 0.0), (5.0, 91.0)]
    right = [(0.5, -179.999), (-40.0, 179.99), (10.0, -180.0), (0.5, 170.0), (5.0, -91.0)] + points(count, 6, (-60.0, 60.0), (-170.0, 170.0))
    a, b = frames(spark, left, right)
    got = defaultdict(list)
    for r in spatial.nearest_join(a, b, L, R, ["rid"], k=k).collect():
        got[r["lid"]].append((r["distance_km"], r["rid"]))
    for i, p in enumerate(left):
        want = sorted((round(km(p, q, "haversine"), 9), j) for j, q in enumerate(right))[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_nearest_within_equal_keys(spark):
    rng = random.Random(9)
    left = [(g, *p) for g in "ab" for p in points(20, g)]
    right = [(g, i, *p) for g in "ab" for i, p in enumerate(points(30, g + "r"))]
    rng.shuffle(right)
    a = spark.createDataFrame(left, "g string, llat double, llon double")
    b = spark.createDataFrame(right, "g string, rid int, rlat double, rlon double")
    got = spatial.nearest_by_position(a, b, L, R, ["rid"], keys=["g"]).collect()
    assert len(got) == 40
    for r in got:
        p = (r["site_lat"], r["site_lon"])
        best = min((round(km(p, (y, x), "haversine"), 9), i) for g, i, y, x in right if g == r["g"])
        assert r["rid"] == best[1]


@pytest.mark.parametrize("metric", ["haversine", "planar_deg"])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_one_crowded_cell(spark, monkeypatch, metric, k):
    """All points in one cell of 0.01 degrees, some in one square metre: divided, and still exact."""
    monkeypatch.setattr(spatial, "_CROWDED", 30)
    rng = random.Random(40)
    some = lambda n, s: [(54.0 + rng.random() * s, -2.0 + rng.random() * s) for _ in range(n)]
    left, right = some(150, 0.0099) + some(30, 1e-5), some(150, 0.0099) + some(30, 1e-5) + [(54.5, -2.5)]
    a, b = frames(spark, left, right)
    got = defaultdict(list)
    for r in spatial.nearest_join(a, b, L, R, ["rid"], k=k, metric=metric).collect():
        if r["rid"] is not None:
            got[r["lid"]].append((r["distance_km"], r["rid"]))
    for i, p in enumerate(left):
        want = sorted((round(km(p, q, metric), 9), j) for j, q in enumerate(right))[:k]
        mine = sorted((round(d, 9), j) for d, j in got[i])
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in want], abs=2e-9)


def test_a_crowded_cell_compares_few_pairs(spark):
    """5,000 points against 5,000 in one cell: far from 25 million pairs."""
    rng = random.Random(41)
    rows = [(54.0 + rng.random() * 0.0099, -2.0 + rng.random() * 0.0099) for _ in range(10_000)]
    a, b = frames(spark, rows[:5000], rows[5000:])
    left = spatial.located(a, L).selectExpr("llat AS site_lat", "llon AS site_lon").withColumns(spatial._fine("site_lat", "site_lon"))
    right = spatial.located(b, R).withColumns(spatial._fine(*R))
    pairs = spatial._near_points(left.cache(), right.cache(), "haversine", 1, []).count()
    assert 5000 <= pairs < 3_000_000


def test_nearest_of_nothing(spark):
    a, b = frames(spark, points(3, 12), [])
    got = spatial.nearest_join(a, b, L, R, ["rid"])
    assert got.count() == 4 and got.where("rid is not null").count() == 0


def test_radius_aggregate_counts_rows_at_hot_positions(spark):
    left, right = points(5, 6), points(50, 7, hot=400)
    a, b = frames(spark, left, right)
    got = spatial.radius_aggregate(
        a, b, 80.0, {"n": ("count", F.lit(1)), "top": ("max", F.col("rid"))}, L, R
    )
    for r in got.collect():
        p = (r["site_lat"], r["site_lon"])
        hits = [j for j, q in enumerate(right) if km(p, q, "haversine") <= 80.0]
        assert (r["n"], r["top"]) == (len(hits), max(hits))


@pytest.mark.parametrize("radius", [30.0, 900.0, 12_000.0])
def test_radius_join_crosses_half_a_turn(spark, radius):
    edge = [(0.1, 179.99), (0.1, -179.99), (10.0, 180.0), (10.0, -180.0), (89.9, 10.0), (89.9, -170.0), (-70.0, 179.9)]
    left = edge + points(20, 20, (-80.0, 80.0), (-180.0, 180.0))
    right = edge + points(60, 21, (-80.0, 80.0), (-180.0, 180.0)) + points(20, 22, (-1.0, 1.0), (179.0, 180.0))
    a, b = frames(spark, left, right)
    for repeat in ("left", "right"):
        pairs = [(r["lid"], r["rid"]) for r in spatial.radius_join(a, b, radius, L, R, repeat=repeat).collect()]
        want = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if km(p, q, "haversine") <= radius}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    one = spatial.within_radius(b, 0.1, 179.99, radius, at=R).collect()
    assert {r["rid"] for r in one} == {j for j, q in enumerate(right) if km((0.1, 179.99), q, "haversine") <= radius}


def test_one_hot_bucket_is_aggregated_in_parts(spark):
    """All points in one bucket: dealt over parts, the same numbers as unsplit."""
    left, right = points(6, 30, (54.0, 54.001), (-2.0, -1.999)), points(400, 31, (54.0, 54.01), (-2.0, -1.99), hot=30)
    a, b = frames(spark, left, right)
    measures = {"n": ("count", F.lit(1)), "low": ("min", F.col("rid")), "sum": ("sum", F.col("rid"))}
    whole = spatial.radius_aggregate(a, b, 40.0, measures, L, R)
    parted = spatial.radius_aggregate(a, b, 40.0, measures, L, R, split_rows=25)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect()))
    assert "_part" in parted._jdf.queryExecution().optimizedPlan().toString()
    assert {r["n"] for r in parted.collect()} == {430}


def test_a_larger_radius_never_counts_less(spark):
    a, b = frames(spark, points(10, 8), points(200, 9))
    small, large = (
        {
            (r["site_lat"], r["site_lon"]): r["n"]
            for r in spatial.radius_aggregate(a, b, km_, {"n": ("count", F.lit(1))}, L, R).collect()
        }
        for km_ in (10.0, 25.0)
    )
    assert all(large.get(p, 0) >= n for p, n in small.items())


def test_semi_and_anti_split_the_rows(spark):
    a, b = frames(spark, points(50, 10), points(30, 11))
    near = spatial.radius_exists(a, b, 15.0, L, R).count()
    far = spatial.radius_exists(a, b, 15.0, L, R, negate=True).count()
    assert near + far == 51  # the row without coordinates is never near


RING = [[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [1.0, 1.0], [1.0, 4.0], [0.0, 4.0]]
HOLE = [[0.2, 0.2], [0.8, 0.2], [0.8, 0.8], [0.2, 0.8]]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize(
    "lon, lat, inside",
    [(0.1, 0.1, True), (3, 0.5, True), (0.5, 3, True), (0.5, 0.5, False), (3, 3, False), (-1, 0.5, False)],
)
def test_l_shape_with_hole(spark, closed, lon, lat, inside):
    rings = [r + r[:1] if closed else r for r in (RING, HOLE)]
    df = spark.createDataFrame(
        [("L", [rings])], "name string, polygons array<array<array<array<double>>>>"
    )
    assert polygons.regions_at_point(df, lat, lon).count() == int(inside)


def test_tagging_takes_the_smallest_name_and_keeps_rows(spark):
    square = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]
    schema = "name string, polygons array<array<array<array<double>>>>"
    regions = spark.createDataFrame([("b", [square]), ("a", [square])], schema)
    rows = [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 9.0, 9.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double")
    tagged = polygons.tag_regions(df, regions)
    got = {r["id"]: r["region"] for r in tagged.collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: None}
    s = polygons.tag_summary(tagged).first()
    assert (s["processed"], s["valid_coordinates"], s["tagged"], s["untagged"]) == (4, 3, 2, 1)
    with pytest.raises(ValueError):
        polygons.tag_regions(df.drop("latitude"), regions)


def star(rng, x, y, size, corners):
    """A closed outline around (x, y) with uneven corners."""
    turns = [2 * math.pi * k / corners for k in range(corners)]
    ring = [[x + size * rng.uniform(0.3, 1) * math.cos(t), y + size * rng.uniform(0.3, 1) * math.sin(t)] for t in turns]
    return ring + ring[:1]


def planted_outlines():
    rng = random.Random(5)
    box = [[-3.0, 54.0], [-1.0, 54.0], [-1.0, 55.0], [-3.0, 55.0]]  # edges on the borders of tiles
    hole = [[-2.5, 54.25], [-1.5, 54.25], [-1.5, 54.75], [-2.5, 54.75]]
    out = [("box", [[box, hole]]), ("two", [[star(rng, -3.5, 53.5, 0.4, 30)], [star(rng, 2.0, 50.0, 0.3, 7)]])]
    out += [(f"star{k}", [[star(rng, -2.5, 54.5, 1.6, 40 + 300 * k)]]) for k in range(3)]
    return out + [("none", []), ("empty", [[[]]])]


REGION_SCHEMA = "name string, polygons array<array<array<array<double>>>>"


@pytest.mark.parametrize("tests", [1, 400, 10**9])
def test_polygon_tiles_give_what_whole_outlines_give(spark, monkeypatch, tests):
    monkeypatch.setattr(polygons, "TILE_TESTS", tests)
    rng = random.Random(11)
    regions = spark.createDataFrame(planted_outlines(), REGION_SCHEMA)
    rows = [(rng.uniform(52.5, 56.5), rng.uniform(-4.5, -0.5)) for _ in range(400)]
    rows += [(54.5 + rng.uniform(-1, 1) / 500, -2.9 + rng.uniform(-1, 1) / 500) for _ in range(400)]  # one dense place
    rows += [(rng.uniform(49.6, 50.4), rng.uniform(1.6, 2.4)) for _ in range(60)]
    rows += [rows[0], (None, 1.0), (float("nan"), -2.0), (float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    got = {tuple(r) for r in polygons.polygon_pairs(df, regions).collect()}
    whole = df.where("latitude < 90").distinct().crossJoin(regions)
    whole = whole.where(polygons.contains_point(F.col("polygons"), F.col("latitude"), F.col("longitude")))
    expected = {tuple(r) for r in whole.select("latitude", "longitude", "name").collect()}
    assert got == expected and len({name for *_, name in expected}) == 5


def test_inner_tiles_keep_no_edges_and_dense_ones_are_split(spark, monkeypatch):
    monkeypatch.setattr(polygons, "TILE_TESTS", 300)
    rng = random.Random(3)
    parts = spark.createDataFrame([("s", star(rng, -2.5, 54.5, 1.9, 200))], "name string, ring array<array<double>>")
    parts = parts.select("name", F.array("ring").alias("_rings"))
    rows = [(54.5 + rng.uniform(-1.5, 1.5), -2.5 + rng.uniform(-1.5, 1.5)) for _ in range(3000)]
    places = spark.createDataFrame(rows, "site_lat double, site_lon double")
    tiles = polygons.cover(places, parts).withColumn("edges", F.size("_edges")).collect()
    assert all(t["edges"] == 0 for t in tiles if not t["_border"])
    assert max(t["level"] for t in tiles) > 0 and any(not t["_border"] for t in tiles)
    # far fewer edge tests than positions times edges
    width = {t: 1.0 / polygons.SPLIT ** (1 + t) for t in range(polygons.LEVELS)}
    tested = 0
    for t in tiles:
        w = width[t["level"]]
        inside = [p for p in rows if math.floor(p[0] / w) == t["ti"] and math.floor(p[1] / w) == t["tj"]]
        tested += len(inside) * t["edges"]
        assert not t["_border"] or len(inside) * t["edges"] <= 300 or t["level"] == polygons.LEVELS - 1
    assert tested < 3000 * 200 / 20


def test_polygons_without_points_or_regions(spark):
    none = spark.createDataFrame([], "latitude double, longitude double")
    regions = spark.createDataFrame(planted_outlines(), REGION_SCHEMA)
    assert polygons.polygon_pairs(none, regions).count() == 0
    one = spark.createDataFrame([(54.1, -2.0)], "latitude double, longitude double")
    assert polygons.polygon_pairs(one, regions.limit(0)).count() == 0
    assert polygons.tag_regions(one, regions.limit(0)).collect()[0]["region"] is None
