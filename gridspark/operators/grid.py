"""Grid-cell features, labels and sliding-window training samples.

The outage rows are read once and combined per month, cell, cause and substation. Windows are
then built from these partial results, never from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.functions import outage as out
from gridspark.functions.coerce import ratio, to_double
from gridspark.functions.geo import CELL_DEGREES, cell_index
from gridspark.operators.spatial import located, nearest_by_position
from gridspark.session import materialize

DURATION_CAP_HOURS = 168.0
RISK_LEVELS = ("Low", "Medium", "High")

# The model features, in model order.
FEATURES = (
    "outage_count", "avg_duration", "std_duration", "total_customer_hours", "max_duration",
    "log_avg_duration", "log_total_customer_hours", "winter_ratio", "night_ratio",
    "exceptional_ratio", "cause_diversity", "nearest_substation_km", "neighbor_outage_count",
)


def in_window(df: DataFrame, start=None, end=None) -> DataFrame:
    """Outages with ``start <= incident time < end`` (UTC)."""
    ts = F.col("incident_date_time")
    if start is not None:
        df = df.where(ts >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(ts < F.lit(str(end)).cast("timestamp_ntz"))
    return df


def model_rows(df: DataFrame, cell_size: float = CELL_DEGREES) -> DataFrame:
    """Outages with cell, month index and the UTC flags the model uses."""
    ts = F.col("incident_date_time")
    hour = F.hour(ts)
    return df.select(
        cell_index(F.col("latitude"), cell_size).alias("ci"),
        cell_index(F.col("longitude"), cell_size).alias("cj"),
        (F.year(ts) * 12 + F.month(ts) - 1).alias("m"),
        F.least(to_double(F.col("duration_hours"), 0.0), F.lit(DURATION_CAP_HOURS)).alias("hours"),
        to_double(F.col("total_customer_minutes_lost"), 0.0).alias("minutes"),
        F.coalesce(F.month(ts).isin(*out.WINTER_MONTHS), F.lit(False)).alias("is_winter"),
        F.coalesce((hour >= 22) | (hour < 6), F.lit(False)).alias("is_night"),
        F.coalesce("is_exceptional_event", F.lit(False)).alias("is_exceptional"),
        F.col("direct_cause_category").alias("cause"),
        F.col("primary_substation").alias("substation"),
        "latitude",
        "longitude",
    )


def combined_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell, cause and substation with everything that adds up, stored.

    All features and labels come from this table, so the outages are read once. It is written to
    the shared folder because its users need different columns of it: left to the planner, each
    would prune it differently and read the outages again.
    """
    grouped = (
        rows.where(F.col("ci").isNotNull() & F.col("cj").isNotNull())
        .groupBy(*keys, "ci", "cj", "cause", "substation")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("hours").alias("s"),
            F.sum(F.col("hours") * F.col("hours")).alias("ss"),
            F.sum("minutes").alias("minutes"),
            F.max("hours").alias("top"),
            F.count_if("is_winter").alias("winter"),
            F.count_if("is_night").alias("night"),
            F.count_if("is_exceptional").alias("exceptional"),
            F.sum("latitude").alias("lat_sum"),
            F.sum("longitude").alias("lon_sum"),
        )
    )
    return materialize(grouped, "combined")


_SUMS = ("n", "s", "ss", "minutes", "winter", "night", "exceptional")


def _cell_partials(combined: DataFrame, keys: list[str]) -> DataFrame:
    return combined.groupBy(*keys, "ci", "cj").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.max("top").alias("top")
    )


def _cause_partials(combined: DataFrame, keys: list[str]) -> DataFrame:
    known = combined.where(F.col("cause").isNotNull())
    return known.select(*keys, "ci", "cj", "cause").distinct()


def _substation_partials(combined: DataFrame, keys: list[str]) -> DataFrame:
    known = combined.where(F.col("substation").isNotNull())
    return known.groupBy(*keys, "substation").agg(
        *[F.sum(c).alias(c) for c in ("n", "lat_sum", "lon_sum")]
    )


def _assemble(
    cells: DataFrame, causes: DataFrame, stations: DataFrame, keys: list[str], cell_size: float
) -> DataFrame:
    """Features per (keys, cell) from partial results that may still hold several months."""
    cell = [*keys, "ci", "cj"]
    totals = cells.groupBy(*cell).agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.max("top").alias("top")
    )
    n, s = F.col("n"), F.col("s")
    variance = ratio(F.greatest(F.lit(0.0), F.col("ss") - s * s / n), F.when(n > 1, n - 1))
    per_degree = 1.0 / cell_size
    base = totals.select(
        *cell,
        (F.col("ci") / per_degree).alias("lat"),
        (F.col("cj") / per_degree).alias("lon"),
        n.alias("outage_count"),
        (s / n).alias("avg_duration"),
        F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("std_duration"),
        (F.col("minutes") / 60.0).alias("total_customer_hours"),
        F.col("top").alias("max_duration"),
        F.log1p(s / n).alias("log_avg_duration"),
        F.log1p(F.col("minutes") / 60.0).alias("log_total_customer_hours"),
        (F.col("winter") / n).alias("winter_ratio"),
        (F.col("night") / n).alias("night_ratio"),
        (F.col("exceptional") / n).alias("exceptional_ratio"),
    )
    diversity = causes.distinct().groupBy(*cell).agg(F.count(F.lit(1)).alias("cause_diversity"))
    places = stations.groupBy(*keys, "substation").agg(
        (F.sum("lat_sum") / F.sum("n")).alias("_slat"),
        (F.sum("lon_sum") / F.sum("n")).alias("_slon"),
    )
    near = nearest_by_position(
        base.select(*keys, "lat", "lon"), places, ("lat", "lon"), ("_slat", "_slon"),
        ["substation"], distance="nearest_substation_km", keys=keys,
    ).select(*keys, "site_lat", "site_lon", "nearest_substation_km")
    around = neighbour_counts(totals.select(*cell, "n"), keys)
    renamed = {k: f"_{k}" for k in keys}
    near = near.withColumnsRenamed({**renamed, "site_lat": "_nlat", "site_lon": "_nlon"})
    on_place = (F.col("lat") == F.col("_nlat")) & (F.col("lon") == F.col("_nlon"))
    for k in keys:
        on_place = on_place & (F.col(k) == F.col(f"_{k}"))
    joined = (
        base.join(near, on_place, "left")
        .join(diversity, cell, "left")
        .join(around, cell, "left")
    )
    filled = joined.na.fill(
        0, ["cause_diversity", "nearest_substation_km", "neighbor_outage_count"]
    )
    return filled.select(*keys, "ci", "cj", "lat", "lon", *FEATURES)


def neighbour_counts(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sum of ``n`` over the eight surrounding cells, by integer offsets and an equi-join key."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    around = F.array(
        *[
            F.struct((F.col("ci") + i).alias("ci"), (F.col("cj") + j).alias("cj"))
            for i, j in steps
        ]
    )
    spread = counts.select(*keys, F.explode(around).alias("_to"), "n").select(*keys, "_to.*", "n")
    return spread.groupBy(*keys, "ci", "cj").agg(F.sum("n").alias("neighbor_outage_count"))


def grid_features(
    outages: DataFrame, start=None, end=None, grid: DataFrame | None = None,
    cell_size: float = CELL_DEGREES,
) -> DataFrame:
    """One row of features per cell with outages; with ``grid`` every grid cell, zeros filled."""
    rows = combined_rows(model_rows(in_window(outages, start, end), cell_size), [])
    found = _assemble(
        _cell_partials(rows, []), _cause_partials(rows, []), _substation_partials(rows, []),
        [], cell_size,
    )
    return complete_grid(found, grid) if grid is not None else found


def complete_grid(features: DataFrame, grid: DataFrame) -> DataFrame:
    """Every cell of a fixed grid (``ci``, ``cj``, ``lat``, ``lon``), missing features zero."""
    left = grid.select("ci", "cj", "lat", "lon").join(
        features.drop("lat", "lon"), ["ci", "cj"], "left"
    )
    return left.na.fill(0, list(FEATURES))


def grid_cells(outages: DataFrame, cell_size: float = CELL_DEGREES) -> DataFrame:
    """The fixed grid: every cell that ever had an outage."""
    per_degree = 1.0 / cell_size
    cells = located(outages).select(
        cell_index(F.col("latitude"), cell_size).alias("ci"),
        cell_index(F.col("longitude"), cell_size).alias("cj"),
    )
    return cells.distinct().withColumns(
        {"lat": F.col("ci") / per_degree, "lon": F.col("cj") / per_degree}
    )


def cells_with_data(features: DataFrame) -> DataFrame:
    """Cells whose features do not sum to zero."""
    return features.where(sum((F.col(f) for f in FEATURES), F.lit(0.0)) > 0)


def _level(count: Column, q67: Column) -> Column:
    return F.when((count > 0) & (count > q67), "High").when(count > 0, "Medium").otherwise("Low")


def risk_rank(level: Column) -> Column:
    return (out.rank_in(level, RISK_LEVELS) - 1).cast("int")


def label_by_count(features: DataFrame, column: str = "outage_count") -> DataFrame:
    """Low, Medium or High by the 67th percentile of the non-zero counts.

    Counts are integers that sum to the number of outages N, so at most ``sqrt(2 N)`` distinct
    ones exist and the built-in exact percentile stays small.
    """
    positive = features.where(F.col(column) > 0)
    q67 = positive.agg(F.percentile(column, F.lit(0.67)).alias("q")).scalar()
    level = _level(F.col(column), F.coalesce(q67, F.lit(0.0)))
    return features.withColumn("risk_level", level).withColumn(
        "risk_rank", risk_rank(F.col("risk_level"))
    )


# --- sliding windows ---------------------------------------------------------------------------


def _month_of(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def _cutoffs(outages: DataFrame, prediction_months: int, start_year: int):
    """First and last cutoff as month numbers (year * 12 + month - 1)."""
    latest = outages.agg(F.max("incident_date_time").alias("t"))
    moved = F.col("t") - F.make_ym_interval(F.lit(0), F.lit(prediction_months))
    return F.lit((start_year + 1) * 12), latest.select(_month_of(moved).alias("c")).scalar()


def _to_cutoffs(
    df: DataFrame, first: Column, last: Column, offset_lo: int, offset_hi: int, step: int
) -> DataFrame:
    """Repeat monthly rows for every cutoff in ``m + offset_lo .. m + offset_hi``."""
    lo = F.greatest(F.col("m") + offset_lo, F.col("_first"))
    hi = F.least(F.col("m") + offset_hi, F.col("_last"))
    months = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    spread = df.withColumns({"_first": first.cast("int"), "_last": last.cast("int")}).withColumn(
        "c", F.explode(months)
    )
    if step > 1:
        spread = spread.where((F.col("c") - F.col("_first")) % step == 0)
    return spread.drop("m", "_first", "_last")


def label_counts(
    combined: DataFrame, first: Column, last: Column, prediction_months: int, step_months: int
) -> DataFrame:
    """Outages per (cutoff, cell) in the months after each cutoff, with the cutoff's percentile."""
    monthly = combined.groupBy("m", "ci", "cj").agg(F.sum("n").alias("n"))
    spread = _to_cutoffs(monthly, first, last, 1 - prediction_months, 0, step_months)
    counts = spread.groupBy("c", "ci", "cj").agg(F.sum("n").alias("future_outage_count"))
    q67 = counts.groupBy("c").agg(F.percentile("future_outage_count", F.lit(0.67)).alias("q67"))
    return counts.join(q67, "c")


def training_samples(
    outages: DataFrame, feature_months: int = 12, prediction_months: int = 3,
    step_months: int = 1, start_year: int = 2000, cell_size: float = CELL_DEGREES,
) -> DataFrame:
    """Features before and label after every monthly cutoff, for cells with outages before it.

    An outage of month m belongs to the feature windows of cutoffs m+1 .. m+12 and to the label
    windows of m-2 .. m, so monthly partial results are repeated instead of joining on ranges.
    """
    first, last = _cutoffs(outages, prediction_months, start_year)
    rows = combined_rows(model_rows(outages, cell_size).where(F.col("m").isNotNull()), ["m"])

    def spread(df: DataFrame) -> DataFrame:
        return _to_cutoffs(df, first, last, 1, feature_months, step_months)

    features = _assemble(
        spread(_cell_partials(rows, ["m"])),
        spread(_cause_partials(rows, ["m"])),
        spread(_substation_partials(rows, ["m"])),
        ["c"],
        cell_size,
    )
    labels = label_counts(rows, first, last, prediction_months, step_months)
    joined = features.join(labels, ["c", "ci", "cj"], "left")
    count = F.coalesce("future_outage_count", F.lit(0)).cast("bigint")
    cutoff = F.make_date(F.floor(F.col("c") / 12), F.col("c") % 12 + 1, F.lit(1))
    return (
        joined.withColumns(
            {
                "cutoff_date": cutoff,
                "future_outage_count": count,
                "risk_level": _level(count, F.coalesce("q67", F.lit(0.0))),
            }
        )
        .withColumn("risk_rank", risk_rank(F.col("risk_level")))
        .drop("c", "q67")
    )


def with_folds(samples: DataFrame, folds: int = 5) -> DataFrame:
    """Add ``fold`` 1..n: chronological parts of the distinct cutoffs, as equal as possible.

    The window runs over the distinct cutoff months only. Round k trains on folds up to k and
    validates on fold k + 1.
    """
    return samples.join(fold_edges(samples, folds).select("cutoff_date", "fold"), "cutoff_date")


def fold_edges(samples: DataFrame, folds: int = 5) -> DataFrame:
    cutoffs = samples.select("cutoff_date").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("cutoff_date")
    numbered = cutoffs.withColumn("fold", F.ntile(folds).over(order))
    edge = F.max("cutoff_date").over(Window.partitionBy("fold"))
    return numbered.withColumn("fold_edge", edge)
