"""Snapshots of the live incident feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark import schemas
from gridspark.functions.coerce import to_double, to_utc

_FIELDS = [f.name for f in schemas.INCIDENTS.fields[:7]] + ["geo_point_2d"]


def parse_incidents(raw: DataFrame) -> DataFrame:
    """Flatten the raw feed. The position is either a ``{lat, lon}`` object or ``"lat, lon"``."""
    geo = F.col("geo_point_2d")
    parts = F.split(geo, ",", 2)
    is_object = geo.startswith("{")

    def coordinate(key: str, index: int):
        text = F.when(is_object, F.get_json_object(geo, f"$.{key}")).otherwise(
            F.trim(F.get(parts, F.lit(index)))
        )
        return to_double(text)

    return raw.select(
        "incident_num",
        "incident_type",
        to_utc(F.col("outage_time")).alias("outage_time"),
        to_double(F.col("customers_affected")).cast("int").alias("customers_affected"),
        to_double(F.col("customers_off_supply")).cast("int").alias("customers_off_supply"),
        "incident_status",
        to_utc(F.col("estimated_restoration_time")).alias("estimated_restoration_time"),
        coordinate("lat", 0).alias("latitude"),
        coordinate("lon", 1).alias("longitude"),
    )


def raw_fields(records: DataFrame, column: str = "record") -> DataFrame:
    """The feed's fields from a map of texts whose names may be in any case."""
    lowered = F.transform_keys(column, lambda name, _: F.lower(name))
    return records.select(lowered.alias("_m")).select(
        *[F.col("_m").getItem(name).alias(name) for name in _FIELDS]
    )


def read_live_incidents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Feed snapshots, each file one JSON array (or, without ``multi_line``, one record per line).

    An empty feed gives no rows.
    """
    text = spark.read.text(path, wholetext=multi_line)
    if multi_line:
        parsed = F.explode(F.from_json("value", "array<map<string,string>>"))
    else:
        parsed = F.from_json("value", "map<string,string>")
    raw = raw_fields(text.select(parsed.alias("record")))
    return parse_incidents(raw.where(F.col("incident_num").isNotNull()))
