"""Outage exports and the cleaned outage table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark import schemas
from gridspark.functions.coerce import to_double, to_utc

_BOM = "\ufeff"


def _typed(name: str, kind: T.DataType) -> Column:
    col = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        return to_utc(col)
    if isinstance(kind, T.DoubleType):
        return to_double(col)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return to_double(col).try_cast(kind)
    return col.cast(kind)


def split_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Replace a ``"lat, lon"`` text by two numbers; what cannot be read becomes null."""
    parts = F.split(F.col(column), ",", 2)
    return df.withColumns(
        {
            "latitude": to_double(F.trim(F.get(parts, F.lit(0)))),
            "longitude": to_double(F.trim(F.get(parts, F.lit(1)))),
        }
    ).drop(column)


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    names = spark.read.option("sep", sep).option("header", True).csv(path).columns
    return [n.lstrip(_BOM).strip().strip('"') for n in names]


def _read_text_table(spark: SparkSession, path: str, sep: str) -> DataFrame:
    names = _header(spark, path, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("sep", sep).option("header", True).schema(schema).csv(path)


def type_columns(df: DataFrame) -> DataFrame:
    """Cast the known outage columns; unknown ones stay as they are, missing ones stay missing."""
    known = {f.name: f.dataType for f in schemas.OUTAGES.fields}
    return df.select(
        *[_typed(c, known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in df.columns]
    )


def read_outage_export(spark: SparkSession, path: str) -> DataFrame:
    """Raw export: ``;`` separated text with a byte order mark and a ``geometry`` text column."""
    df = _read_text_table(spark, path, ";")
    if "geometry" in df.columns:
        df = split_geometry(df)
    return type_columns(df)


def read_outages(spark: SparkSession, path: str) -> DataFrame:
    """A stored outage table: Parquet when the path ends in ``.parquet``, else CSV.

    An ``hour`` column is added where missing, from the first time column present, else 0.
    """
    if path.rstrip("/").lower().endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = type_columns(_read_text_table(spark, path, ","))
    if "hour" in df.columns:
        return df
    for name in ("start_time", "Incident Date-time"):
        if name in df.columns:
            return df.withColumn("hour", F.hour(to_utc(F.col(f"`{name}`").cast("string"))))
    return df.withColumn("hour", F.lit(0))


def write_outages(df: DataFrame, folder: str, mode: str = "overwrite") -> tuple[str, str]:
    """Write the table as CSV and as Parquet; returns both paths."""
    csv, parquet = f"{folder}/outages.csv", f"{folder}/outages.parquet"
    df.write.mode(mode).option("header", True).csv(csv)
    df.write.mode(mode).parquet(parquet)
    return csv, parquet
