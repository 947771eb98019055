"""Timelines, month-over-month figures and seasonal forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridspark.functions import geo, outage as out
from gridspark.functions.coerce import percent, to_double
from gridspark.operators.cleaning import SITE_CATEGORIES, V2X
from gridspark.operators.quantiles import exact_quantiles
from gridspark.operators.ranking import top_k_per_group
from gridspark.operators.spatial import attach_by_position, radius_aggregate


def _with_month(df: DataFrame) -> DataFrame:
    number = out.rank_in(F.col("month_name"), out.MONTHS)
    return df.withColumns(
        {
            "year_month": F.format_string("%d-%02d", "year", number),
            "year_month_label": F.concat_ws(" ", "month_name", F.col("year").cast("string")),
        }
    )


def _frequency(df: DataFrame, period: list[str], by: list[str]) -> DataFrame:
    """Counts per period and duration category, completed with zeros over observed values.

    Few rows are left after the first aggregation; the completion explodes the set of observed
    categories (at most four) over the observed periods of each group.
    """
    counts = (
        df.where(F.col("duration_category").isNotNull() & F.col(period[0]).isNotNull())
        .groupBy(*by, *period, "duration_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _complete(counts, period, by)


def _complete(counts: DataFrame, period: list[str], by: list[str]) -> DataFrame:
    periods = counts.groupBy(*by, *period).agg(
        F.map_from_entries(F.collect_list(F.struct("duration_category", "n"))).alias("_counts")
    )
    key = by or [F.lit(0).alias("_all")]
    seen = counts.groupBy(*key).agg(F.collect_set("duration_category").alias("_seen"))
    if by:
        grid = periods.join(seen, by)
    else:
        grid = periods.withColumn("_seen", seen.select("_seen").scalar())
    return grid.withColumn("duration_category", F.explode("_seen")).select(
        *by,
        *period,
        "duration_category",
        F.coalesce(F.col("_counts")[F.col("duration_category")], F.lit(0)).alias("n"),
    )


def monthly_frequency(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Outages per month and duration category, zeros filled in."""
    return _frequency(_with_month(df), ["year_month", "year_month_label"], list(by))


def yearly_frequency(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return _frequency(df, ["year"], list(by))


def monthly_customer_hours(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean customer hours (recorded minutes / 60) per month."""
    hours = out.customer_hours_from_minutes(F.col("total_customer_minutes_lost"))
    return (
        _with_month(df.where(F.col("month_name").isNotNull()))
        .groupBy(*by, "year_month", "year_month_label")
        .agg(F.coalesce(F.avg(hours), F.lit(0.0)).alias("customer_hours_lost"))
    )


def yearly_customer_hours(df: DataFrame, by: list[str] = ()) -> DataFrame:
    hours = out.customer_hours_from_minutes(F.col("total_customer_minutes_lost"))
    return (
        df.where(F.col("year").isNotNull())
        .groupBy(*by, "year")
        .agg(F.coalesce(F.avg(hours), F.lit(0.0)).alias("customer_hours_lost"))
    )


def customer_hours_by_category(df: DataFrame) -> DataFrame:
    hours = out.customer_hours_from_minutes(F.col("total_customer_minutes_lost"))
    return (
        df.where(F.col("duration_category").isNotNull())
        .groupBy("duration_category")
        .agg(F.sum(hours).alias("customer_hours_lost"))
    )


def count_by_category(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("duration_category").isNotNull())
        .groupBy("duration_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def site_timelines(
    sites: DataFrame, outages: DataFrame, radius: float = geo.TWO_MILES_KM
) -> DataFrame:
    """Monthly counts by duration category and mean customer hours, for every site.

    Outages are combined per position, month and category before they meet the sites.
    """
    minutes = F.col("total_customer_minutes_lost")
    rows = _with_month(outages.where(F.col("month_name").isNotNull()))
    by = ["year_month", "year_month_label", "duration_category"]
    measures = {
        "n": ("count", F.lit(1)),
        "_m": ("count", minutes),
        "_minutes": ("sum", minutes),
    }
    per_place = radius_aggregate(sites, rows, radius, measures, by=by)
    key = ["site_lat", "site_lon"]
    month = Window.partitionBy(*key, "year_month")
    hours = F.coalesce(
        F.try_divide(F.sum("_minutes").over(month) / 60.0, F.sum("_m").over(month)), F.lit(0.0)
    )
    monthly = per_place.withColumn("customer_hours_lost", hours)
    means = monthly.groupBy(*key, "year_month").agg(
        F.max("customer_hours_lost").alias("customer_hours_lost")
    )
    counts = per_place.where(F.col("duration_category").isNotNull()).drop("_m", "_minutes")
    grid = _complete(counts, ["year_month", "year_month_label"], key)
    found = grid.join(means, [*key, "year_month"])
    return attach_by_position(sites, found, how="inner")


# --- month over month --------------------------------------------------------------------------


def month_over_month(df: DataFrame) -> DataFrame:
    """Latest month against the one before: customers, customer hours, median duration, top cause.

    With fewer than two months everything counts as current and there is nothing before. A change
    is null when the earlier value is not positive.
    """
    dated = df.withColumn("month", F.date_trunc("month", "incident_date_time").cast("date"))
    # The two latest months as numbers (an action), so that the scans below can skip the rest.
    known = dated.where(F.col("month").isNotNull()).select("month").distinct()
    months = [r["month"] for r in known.orderBy(F.col("month").desc()).limit(2).collect()]
    single = F.lit(len(months) < 2)
    if len(months) < 2:
        period = F.lit("current")
    else:
        dated = dated.where(F.col("incident_date_time") >= F.lit(months[1]))
        period = F.when(F.col("month") == F.lit(months[0]), "current").otherwise("previous")
    rows = dated.withColumn("period", period)
    totals = rows.groupBy("period").agg(
        F.max(F.when(~single, F.date_format("month", "yyyy-MM"))).alias("month"),
        F.sum("customer_affected").alias("customers_affected"),
        (F.sum("total_customer_minutes_lost") / 60.0).alias("customer_hours"),
    )
    medians = exact_quantiles(rows, F.col("duration_hours"), [0.5], ["period"]).select(
        "period", F.get("q", F.lit(0)).alias("median_duration")
    )
    causes = (
        rows.where((F.col("period") == "current") & F.col("direct_cause_category").isNotNull())
        .groupBy("direct_cause_category")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "direct_cause_category")
        .limit(1)
        .select("direct_cause_category")
    )
    both = totals.join(medians, "period", "left")

    def pick(name: str, which: str):
        return F.max(F.when(F.col("period") == which, F.col(name)))

    names = ("customers_affected", "customer_hours", "median_duration")
    wide = both.agg(
        pick("month", "current").alias("current_month"),
        pick("month", "previous").alias("previous_month"),
        *[pick(n, "current").alias(n) for n in names],
        *[pick(n, "previous").alias(f"previous_{n}") for n in names],
    )

    def change(name: str):
        now, before = F.col(name), F.col(f"previous_{name}")
        return F.when(before > 0, percent(now - before, before)).alias(f"{name}_change_pct")

    return wide.select("*", *[change(n) for n in names], causes.scalar().alias("top_cause"))


def site_distribution(sites: DataFrame, categories=SITE_CATEGORIES) -> DataFrame:
    """Sites per category with the fixed display order."""
    return (
        sites.where(F.col("site_category").isin(*categories))
        .groupBy("site_category")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("display_order", out.rank_in(F.col("site_category"), SITE_CATEGORIES))
    )


def quick_insights(outages: DataFrame, sites: DataFrame) -> DataFrame:
    """Winter share, share of outages over 12 hours, number of V2X sites."""
    v2x = sites.agg(F.count_if(F.col("site_category") == V2X).alias("n")).scalar()
    winter = F.coalesce(F.col("month_name").isin(*out.WINTER_MONTH_NAMES), F.lit(False))
    long = F.coalesce(F.col("duration_hours") > 12, F.lit(False))
    total = F.count(F.lit(1))
    return outages.agg(
        percent(F.count_if(winter), total).alias("winter_pct"),
        percent(F.count_if(long), total).alias("long_pct"),
    ).withColumn("v2x_sites", v2x)


# --- seasonal forecast -------------------------------------------------------------------------


def forecast_filter(df: DataFrame, district: str | None = None, cause: str | None = None):
    if district:
        df = df.where(out.contains_text(F.col("district_name"), district))
    if cause:
        df = df.where(out.contains_text(F.col("direct_cause_category"), cause))
    return df


def seasonal_forecast(
    df: DataFrame, min_per_year: int = 100, season: str | None = None
) -> DataFrame:
    """Historical counts per season over reliable years and the expected range.

    One aggregation to (year, season) reads the data; the rest works on years. Forecasts are
    rounded half to even.
    """
    per_year = (
        df.where(F.col("year").isNotNull())
        .groupBy("year")
        .pivot("season", list(out.SEASONS))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )
    total = sum((F.col(s) for s in out.SEASONS), F.lit(0))
    reliable = per_year.where(total >= min_per_year)
    seasons = F.array(
        *[F.struct(F.lit(s).alias("season"), F.col(s).alias("n")) for s in out.SEASONS]
    )
    rows = reliable.select("year", F.inline(seasons))
    if season:
        rows = rows.where(F.col("season") == season)
    stats = rows.groupBy("season").agg(
        F.avg("n").alias("historical_mean"),
        F.median("n").alias("historical_median"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("historical_std"),
        F.min("n").alias("historical_min"),
        F.max("n").alias("historical_max"),
        F.count(F.lit(1)).alias("years_of_data"),
    )
    mean, std = F.col("historical_mean"), F.col("historical_std")
    return stats.withColumns(
        {
            "forecast_low": F.greatest(F.lit(0), F.rint(mean - std).cast("bigint")),
            "forecast_expected": F.rint(mean).cast("bigint"),
            "forecast_high": F.rint(mean + std).cast("bigint"),
        }
    )


def reliable_years(df: DataFrame, min_per_year: int = 100) -> DataFrame:
    counts = df.where(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_per_year)


def season_durations(df: DataFrame) -> DataFrame:
    """Median and mean duration per season."""
    rows = df.withColumn("_h", to_double(F.col("duration_hours"))).where(
        F.col("season").isNotNull()
    )
    medians = exact_quantiles(rows, F.col("_h"), [0.5], ["season"])
    means = rows.groupBy("season").agg(F.avg("_h").alias("mean_duration_hours"))
    return means.join(medians, "season", "left").select(
        "season",
        F.get("q", F.lit(0)).alias("median_duration_hours"),
        "mean_duration_hours",
    )


def season_causes(df: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent causes of every season."""
    counts = (
        df.where(F.col("season").isNotNull() & F.col("direct_cause_category").isNotNull())
        .groupBy("season", "direct_cause_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = [F.col("n").desc(), F.col("direct_cause_category")]
    return top_k_per_group(counts, ["season"], order, top, "rank")
