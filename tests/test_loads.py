"""Sources, incremental loads and streams."""

import json
from datetime import date, datetime
from types import SimpleNamespace

import pytest

from gridspark.operators import incremental
from gridspark.registry import places
from gridspark.sources import geojson, incidents, outages, tables
from gridspark.streaming import incidents as stream


def test_live_feed_is_an_array_in_any_case(spark, tmp_path):
    rows = [
        {"INCIDENT_NUM": "a", "geo_point_2d": {"lat": 54.5, "lon": -2.5}, "Customers_Affected": 3,
         "outage_time": "2026-01-02T03:04:05+01:00"},
        {"incident_num": "b", "geo_point_2d": "54.25, -2.25", "outage_time": "bad"},
        {"incident_num": "c", "geo_point_2d": None},
    ]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text(json.dumps(rows, indent=1))
    got = {r["incident_num"]: r for r in
           incidents.read_live_incidents(spark, str(tmp_path / "feed")).collect()}
    assert (got["a"]["latitude"], got["a"]["longitude"], got["a"]["customers_affected"]) == (
        54.5, -2.5, 3,
    )
    assert got["a"]["outage_time"] == datetime(2026, 1, 2, 2, 4, 5)
    assert (got["b"]["latitude"], got["b"]["outage_time"]) == (54.25, None)
    assert got["c"]["latitude"] is None


def test_empty_feed_has_the_columns(spark, tmp_path):
    (tmp_path / "1.json").write_text("[]")
    df = incidents.read_live_incidents(spark, str(tmp_path))
    assert df.count() == 0 and len(df.columns) == 9


def test_geometry_is_split_once(spark):
    df = spark.createDataFrame([("54.1, -2.5",), ("x, 1",), ("7",), (None,)], "geometry string")
    got = [tuple(r) for r in outages.split_geometry(df).collect()]
    assert got == [(54.1, -2.5), (None, 1.0), (7.0, None), (None, None)]


def test_hour_defaults_to_zero(spark, tmp_path):
    path = str(tmp_path / "o.parquet")
    spark.createDataFrame([(1,)], "x int").write.parquet(path)
    assert outages.read_outages(spark, path).first()["hour"] == 0


def test_region_name_field(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}}
    named = {"type": "FeatureCollection", "features": [
        {**feature, "properties": {"name": "low", "CTY23NM": "High Wood"}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(named))
    got = geojson.read_regions(spark, str(tmp_path / "a.geojson")).first()
    assert got["name"] == "High Wood" and got["polygons"][0][0][1] == [1.0, 0.0]
    named["features"][0]["properties"] = {"title": "x"}
    (tmp_path / "b.geojson").write_text(json.dumps(named))
    with pytest.raises(ValueError):
        geojson.read_regions(spark, str(tmp_path / "b.geojson"))


def test_long_list_needs_its_columns(spark):
    with pytest.raises(ValueError):
        tables.check_long_list(spark.createDataFrame([("x",)], "Town string"))


def test_predictions_fall_back_to_the_next_model(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1.0, "xgb")], "lat double, model string")
    tables.write_predictions(df, path)
    assert tables.read_predictions(spark, path, ["rf", "xgb"], first_only=True).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_predictions(spark, path, ["rf"], first_only=True)


def test_file_snapshots_differ_by_content(spark, tmp_path):
    for d, texts in (("old", {"a": "1", "b": "2"}), ("new", {"a": "1", "b": "3", "c": "4"})):
        (tmp_path / d).mkdir()
        for name, text in texts.items():
            (tmp_path / d / name).write_text(text)
    rows = tables.snapshot_changed(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()
    assert {r["file"]: r["changed"] for r in rows} == {"a": False, "b": True, "c": True}


def test_table_change_ignores_row_order_but_not_repetition(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    assert not tables.table_changed(a, b).first()["changed"]
    assert tables.table_changed(a, b.union(b)).first()["changed"]
    assert tables.table_changed(a.union(a), a.union(b.limit(1)).union(b.limit(1))).first()["changed"]


def _outages(spark, rows):
    return spark.createDataFrame(
        rows, "incident_reference_number string, n int, incident_date_time timestamp_ntz"
    )


def test_high_water_mark_is_strict_and_kept(spark):
    day = [datetime(2024, 1, d) for d in range(1, 6)]
    stored = _outages(spark, [("a", 1, day[2])])
    feed = _outages(spark, [(str(i), i, d) for i, d in enumerate(day)])
    assert incremental.new_rows(feed, stored).count() == 2
    assert incremental.new_rows(feed, stored, saved="2024-01-04").count() == 1
    assert incremental.new_rows(feed, stored, since="2024-01-03").count() == 3
    assert incremental.new_rows(feed, stored, full=True).count() == 5
    empty = feed.where("n < 0")
    mark = spark.range(1).select(incremental.next_mark(stored, empty).alias("m")).first()["m"]
    assert mark == day[2]


def test_upsert_keeps_the_last_row(spark):
    t = datetime(2024, 1, 1)
    stored = _outages(spark, [("a", 1, t), ("b", 2, t)])
    batch = _outages(spark, [("b", 3, t), ("b", 4, t), ("c", 5, t)])
    got = incremental.upsert(stored, batch, "n").collect()
    assert sorted((r[0], r["n"]) for r in got) == [("a", 1), ("b", 4), ("c", 5)]
    plain = incremental.upsert(stored.drop("incident_reference_number"), batch, "n")
    assert plain.count() == 5


# Known numbers are replaced only when something new is seen, and cleared by an empty feed.
FEEDS = [["a", "b"], ["b"], ["a", "b"], ["b", "c"], ["a", "c"], [], ["c"]]


def reported(feeds):
    """The rule spelled out: new numbers per check."""
    known, out = set(), []
    for feed in feeds:
        fresh = set(feed) - known
        if not feed:
            known = set()
        elif fresh:
            known = set(feed)
        out.append(sorted(fresh))
    return out


def test_the_rule_itself():
    assert reported(FEEDS) == [["a", "b"], [], [], ["c"], ["a"], [], ["c"]]


def test_incident_stream_follows_the_rule(spark, tmp_path):
    schema = "incident_num string, n int"
    base = str(tmp_path)
    args = (spark, f"{base}/feed", spark.createDataFrame([], schema).schema, f"{base}/cp",
            f"{base}/known", f"{base}/new")
    for i, ids in enumerate(FEEDS):
        rows = spark.createDataFrame([(x, i) for x in ids], schema).coalesce(1)
        rows.write.mode("append").parquet(f"{base}/feed")
        # restarting after every snapshot: state and position survive the query
        stream.incident_stream(*args).awaitTermination()
    got = [
        sorted(r[0] for r in spark.read.schema(schema).parquet(f"{base}/new/batch={i}").collect())
        for i in range(len(FEEDS))
    ]
    assert got == reported(FEEDS)


def test_outage_stream_resolves_the_newest_row(spark, tmp_path):
    base, t = str(tmp_path), datetime(2024, 1, 1)
    for rows in ([("a", 1, t), ("b", 2, t)], [("b", 1, t)], [("c", 9, t), ("c", 8, t)]):
        df = _outages(spark, rows)
        df.coalesce(1).write.mode("append").parquet(f"{base}/feed")
        stream.outage_stream(
            spark, f"{base}/feed", df.schema, f"{base}/cp", f"{base}/table"
        ).awaitTermination()
    table = stream.current_outages(spark, f"{base}/table", df.schema, "n")
    assert sorted((r[0], r["n"]) for r in table.collect()) == [("a", 1), ("b", 1), ("c", 9)]


def test_native_dedup_reports_each_number_once(spark, tmp_path):
    base = str(tmp_path)
    schema = "incident_num string, outage_time timestamp_ntz"
    rows = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/feed")
    feed = spark.readStream.schema(schema).parquet(f"{base}/feed")
    (stream.first_sightings(feed).writeStream.format("parquet")
     .option("checkpointLocation", f"{base}/cp").option("path", f"{base}/out")
     .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(f"{base}/out").count() == 2


def test_incidents_without_position_keep_their_row(spark):
    schema = "incident_num string, latitude double, longitude double"
    inc = spark.createDataFrame([("a", 54.5, -2.5), ("b", None, None)], schema)
    cells = spark.createDataFrame(
        [(54.5, -2.52, "High", 0.9, 0.8)],
        "lat double, lon double, risk_level string, confidence double, prob_high double",
    )
    sites = spark.createDataFrame(
        [("s", "Other Chargepoint", 54.4, -2.5)],
        "charge_point_location string, site_category string, latitude double, longitude double",
    )
    outs = spark.createDataFrame(
        [(54.5, -2.5, 2.0, 10)],
        "latitude double, longitude double, duration_hours double, customer_affected long",
    )
    got = {r["incident_num"]: r for r in
           incremental.with_context(inc, cells, sites, outs).collect()}
    assert got["a"]["risk_level"] == "High" and got["a"]["history_customer_hours"] == 20.0
    assert len(got["a"]["nearest_chargepoints"]) == 1
    assert got["b"]["risk_level"] is None and got["b"]["history_count"] is None




def test_incident_stream_query_reads_the_events_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    feeds = [[], ["a", "b"], ["a"], ["b", "c"], ["c", "a"], ["a", "c"]]
    rows = [(date(2024, 1, 1 + i) if i else None, x, float(i)) for i, ids in enumerate(feeds) for x in ids or ["lost"]]
    made = spark.createDataFrame(rows, "snapshot date, incident_num string, value double")
    domain = SimpleNamespace(spark=spark, incidents=made.mapInArrow(counted, made.schema))
    got = places.i3s(domain).collect()
    want = [(x, f"2024-01-0{1 + i}") for i, ids in enumerate(reported(feeds)) for x in ids]
    assert sorted((r["incident_num"], r["day"]) for r in got) == sorted(want)
    assert seen.value == len(rows)
