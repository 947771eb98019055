"""Hand-made edge cases of cleaning, filters, quantiles, timelines and text search."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridspark.functions import outage as out
from gridspark.operators import cleaning, filters, profile, risk_query, site_risk, textsearch, timelines
from gridspark.operators.quantiles import exact_quantiles, quantile_values


def outages(spark, rows):
    """(minutes, start, end, event) rows."""
    schema = """incident_duration long, incident_date_time timestamp_ntz,
        restoration_date_time timestamp_ntz, exceptional_event_id string"""
    return cleaning.derive_fields(spark.createDataFrame(rows, schema))


def test_durations_and_categories(spark):
    t, u = datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 1, 4, 30)
    rows = [
        (0, t, None, None), (179, t, None, None), (180, t, None, None), (360, t, None, " "),
        (719, t, None, ""), (720, t, None, "X"), (None, t, u, None), (None, t, None, None),
    ]
    got = outages(spark, rows).collect()
    assert [r["duration_category"] for r in got] == [
        "x < 3 hours", "x < 3 hours", "3 ≤ x < 6 hours", "6 ≤ x < 12 hours", "6 ≤ x < 12 hours",
        "x > 12 hours", "3 ≤ x < 6 hours", None,
    ]
    assert got[6]["duration_hours"] == 4.5
    assert [r["is_exceptional_event"] for r in got] == [False] * 5 + [True, False, False]
    parity = out.duration_category(F.lit(None).cast("double"), null_as_longest=True)
    assert spark.range(1).select(parity.alias("c")).first()["c"] == "x > 12 hours"


def test_local_calendar_fields(spark):
    times = [
        datetime(2024, 6, 30, 23, 30),  # already July in summer time
        datetime(2024, 3, 31, 0, 59), datetime(2024, 3, 31, 1, 0),  # clocks go forward
        datetime(2024, 12, 1), datetime(2024, 2, 29), datetime(2024, 11, 30), None,
    ]
    got = outages(spark, [(1, t, None, None) for t in times]).collect()
    assert [r["hour"] for r in got] == [0, 0, 2, 0, 0, 0, None]
    assert [r["month_name"] for r in got[:2]] == ["July", "March"]
    assert [r["season"] for r in got] == [
        "Summer", "Spring", "Spring", "Winter", "Winter", "Autumn", None,
    ]


def test_zero_duration_ratio(spark):
    rows = [(60.0, 0.0), (0.0, 0.0), (60.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "m double, h double")
    got = [r[0] for r in df.select(out.significance_ratio(F.col("m"), F.col("h"))).collect()]
    assert got == [float("inf"), 0.0, 1.0, 0.0]


def test_site_categories(spark):
    rows = [
        ("Rydal Hall", 1, "open", cleaning.V2X), (" rydal hall", 0, "check", cleaning.BUILDING),
        ("X", 0, "open", cleaning.OTHER), ("X", 0, "cwys", None), ("X", 1, "comingsoon", None),
        ("X", 1, "cwys", cleaning.V2X),
    ]
    df = spark.createDataFrame(rows, "name string, vx int, status string, want string")
    kind = cleaning.site_category(F.col("name"), F.col("vx"), F.col("status"))
    assert all(r["want"] == r["got"] for r in df.withColumn("got", kind).collect())


def test_chargepoint_export_needs_its_columns(spark):
    raw = spark.createDataFrame([("a", "1")], "place_name string, lat string")
    with pytest.raises(ValueError):
        cleaning.clean_chargepoints(raw.withColumn("n", F.lit(1)), "n")


def test_site_type_takes_the_first_keyword(spark):
    rows = [
        ("St Mary's Church", "next to the village hall", "Village Hall"),
        ("Old Chapel", "a community center", "Community Centre"),
        ("Depot", "none", "Other Community Site"),
    ]
    df = spark.createDataFrame(rows, "p string, d string, want string")
    kind = cleaning.site_type(F.col("p"), F.col("d"))
    assert all(r["want"] == r["got"] for r in df.withColumn("got", kind).collect())


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_interpolate_exactly(spark, seed):
    import numpy as np

    rng = random.Random(seed)
    values = {
        g: [rng.choice([rng.random(), rng.randint(0, 5), 3.0]) for _ in range(n)]
        for g, n in (("a", 1), ("b", 2), ("c", 997))
    }
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.67, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, F.col("v"), probs, ["g"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, vs in values.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, probs)), abs=1e-12)


def test_quantiles_of_infinite_and_of_no_values(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("inf"),)], "v double")
    assert quantile_values(df, F.col("v"), [0.0, 0.5]) == [1.0, float("inf")]
    assert quantile_values(df.where("v < 0"), F.col("v"), [0.5]) is None


def test_empty_input_passes_the_filters(spark):
    df = outages(spark, [(60, datetime(2024, 1, 1), None, None)]).withColumn(
        "total_customer_minutes_lost", F.lit(5)
    )
    none = df.where("year = 1")
    assert filters.apply_filters(none, (), True, True, 1.5, 0.5).count() == 0
    assert filters.apply_filters(df, (), False, True, 1.5, 0.5).count() == 1


def test_exact_name_beats_contained_name(spark):
    df = spark.createDataFrame([("York",), ("New York",), (None,)], "district_name string")
    assert [r[0] for r in filters.by_name(df, "york").collect()] == ["York"]
    assert filters.by_name(df, "ork").count() == 2
    assert filters.by_name(df, "nowhere").count() == 0


def test_one_year_has_no_deviation(spark):
    rows = [(2020, s) for s in ("Winter", "Winter", "Summer")]
    df = spark.createDataFrame(rows, "year int, season string")
    got = {r["season"]: r for r in timelines.seasonal_forecast(df, 3).collect()}
    assert set(got) == set(out.SEASONS)
    assert got["Winter"]["historical_std"] == 0.0
    assert got["Autumn"]["forecast_expected"] == 0
    for r in got.values():
        assert 0 <= r["forecast_low"] <= r["forecast_expected"] <= r["forecast_high"]
        assert r["historical_min"] <= r["historical_mean"] <= r["historical_max"]
    assert timelines.seasonal_forecast(df, 4).count() == 0


def test_single_month_has_no_previous(spark):
    t = datetime(2024, 5, 5)
    schema = """incident_date_time timestamp_ntz, customer_affected long,
        total_customer_minutes_lost long, duration_hours double, direct_cause_category string"""
    df = spark.createDataFrame([(t, 5, 60, 2.0, "b"), (t, 1, 0, 4.0, "a")], schema)
    r = timelines.month_over_month(df).first()
    assert (r["customers_affected"], r["customer_hours"], r["median_duration"]) == (6, 1.0, 3.0)
    assert r["previous_month"] is None and r["customers_affected_change_pct"] is None
    assert r["top_cause"] == "a"


def test_scores_of_a_single_site_use_the_widened_range(spark):
    schema = """charge_point_location string, site_category string, outages long,
        avg_duration double, customer_hours double, std_pop double, std_samp double"""
    df = spark.createDataFrame([("s", cleaning.OTHER, 3, 2.0, 9.0, 0.0, None)], schema)
    r = site_risk.risk_scores(df).first()
    assert r["frequency_score"] == r["duration_score"] == r["impact_score"] == 0.0
    assert r["consistency_score"] == 100.0


def test_near_site_counts_add_up(spark, sf_dir):
    from gridspark import fixtures as fx

    fx.use(spark, sf_dir)
    sites, raw = fx.sites(spark), fx.outages(spark)
    counts = site_risk.count_outages_near_sites(sites, raw, 15.0)
    rows = [r["outages_within_radius"] for r in site_risk.busiest_sites(counts).collect()]
    s = site_risk.near_sites_summary(counts, 15.0).first()
    assert rows == sorted(rows, reverse=True)
    assert s["sites_with_outages"] + s["sites_without_outages"] == s["total_sites"] == len(rows)
    assert s["total_outages_near_sites"] == sum(rows)
    v2x = filters.by_category(counts, "v2x")
    assert v2x.count() < counts.count()


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    rows = profile.histogram(df, "v").collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(0, 2)]


def test_document_search_shows_context(spark):
    text = "one\r\ntwo V2X\nthree\n\n  v2x v2x  \nsix"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id int, text string")
    found = textsearch.search_documents(df, "v2X", first=5).collect()
    assert len(found) == 1 and found[0]["match_count"] == 2
    a, b = found[0]["matches"]
    assert (a["line_number"], a["context"]) == (2, "one\ntwo V2X\nthree\n")
    assert (b["line_number"], b["matching_line"]) == (5, "v2x v2x")
    assert textsearch.search_documents(df, "one\ntwo").count() == 0
    many = spark.createDataFrame([(1, "x\n" * 9)], "id int, text string")
    r = textsearch.search_documents(many, "X").first()
    assert (r["match_count"], len(r["matches"])) == (9, 5)


def test_document_title(spark):
    rows = [(1, "intro\n## no\n  # The Title # \n# other"), (2, "plain"), (3, "#none")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["title"] for r in textsearch.document_titles(df).collect()}
    assert got == {1: "The Title #", 2: "", 3: ""}


def test_quantiles_narrow_large_windows_and_survive_a_wrong_sketch(spark, monkeypatch):
    """Neither the number of values that may meet nor the sketch's bounds change the result."""
    import numpy as np

    from gridspark.operators import quantiles

    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 5.0D ELSE CAST((id * 7919) % 100003 AS DOUBLE) / 7 END AS v",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE 'x' END AS g",
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    rows = df.collect()
    want = {
        g: np.quantile([r.v for r in rows if r.v is not None and r.g == g], probs).tolist()
        for g in (None, "x")
    }

    def check():
        got = quantiles.group_quantiles(df, F.col("v"), probs, ["g"])
        assert {k[0]: q for k, q in got.items()} == {g: pytest.approx(q, abs=1e-9) for g, q in want.items()}

    monkeypatch.setattr(quantiles, "MOST_VALUES", 50)
    check()
    monkeypatch.undo()
    plain, calls = quantiles._window, []

    def wrong_at_first(rank, n, row):
        calls.append(rank)
        return (row["_min"], row["_min"]) if len(calls) < 15 else plain(rank, n, row)

    monkeypatch.setattr(quantiles, "_window", wrong_at_first)
    check()
    assert len(calls) > 15


def test_chi_squared_tail_against_closed_forms(spark):
    """Even degrees are a Poisson sum, odd ones add to the error function."""
    import math

    from gridspark.operators.profile import chi_squared_tail

    def tail(chi2, dof):
        x = chi2 / 2
        if dof % 2 == 0:
            return sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(dof // 2))
        steps = range(1, (dof + 1) // 2)
        return math.erfc(math.sqrt(x)) + sum(math.exp(-x + (k - 0.5) * math.log(x) - math.lgamma(k + 0.5)) for k in steps)

    cases = [(c, d) for d in (1, 2, 3, 9, 10, 55, 110, 999) for c in (0.001, 0.5, d * 0.5, d, d * 1.1 + 2, d * 2 + 10, d * 4 + 40)]
    df = spark.createDataFrame([(float(c), d) for c, d in cases] + [(0.0, 3)], "c double, d int")
    got = [r[0] for r in df.select(chi_squared_tail(F.col("c"), F.col("d"))).collect()]
    assert got[-1] == 1.0
    for (c, d), p in zip(cases, got):
        assert p == pytest.approx(tail(c, d), abs=1e-12, rel=1e-9), (c, d)
    # a fixed value of tables: the 95 % point of ten degrees
    assert spark.range(1).select(chi_squared_tail(F.lit(18.307038053275146), F.lit(10))).first()[0] == pytest.approx(0.05, abs=1e-9)


def test_correlations_of_a_column_that_does_not_vary(spark):
    rows = [(1.0, 0.1, 2.0, None), (2.0, 0.1, 4.5, 1.0), (4.0, 0.1, 5.0, None), (3.0, 0.1, None, None)]
    df = spark.createDataFrame(rows, "a double, flat double, b double, one double").repartition(4)
    got = {(r[0], r[1]): r[2] for r in profile.correlation_pairs(df, ["a", "flat", "b", "one"]).collect()}
    x, y = [1.0, 2.0, 4.0], [2.0, 4.5, 5.0]  # the rows with both
    mx, my = sum(x) / 3, sum(y) / 3
    cov = sum((p - mx) * (q - my) for p, q in zip(x, y))
    want = cov / (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
    assert got["a", "b"] == pytest.approx(want, abs=1e-12)
    assert all(v != v for k, v in got.items() if "flat" in k and "one" not in k)
    assert all(v is None for k, v in got.items() if "one" in k)


def test_agreement_with_a_model_of_one_confidence(spark):
    cells = "ci long, cj long, risk_level string, confidence double"
    a = spark.createDataFrame([(1, 1, "Low", 0.4), (1, 2, "Low", 0.7)], cells)
    b = spark.createDataFrame([(1, 1, "Low", 0.6), (1, 2, "High", 0.6)], cells)
    got = risk_query.model_agreement(a, b).first()
    assert (got["common_cells"], got["same_level"]) == (2, 1)
    assert got["confidence_corr"] != got["confidence_corr"]
