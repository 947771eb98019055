"""Charge points, predictions, long list, results and change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridspark import schemas


def read_chargepoint_export(spark: SparkSession, path: str) -> DataFrame:
    """Raw charge point export: quoted CSV, malformed lines dropped, all columns as text."""
    options = {"header": True, "quote": '"', "escape": "\\", "mode": "DROPMALFORMED"}
    names = spark.read.options(**options).csv(path).columns
    clean = [n.strip().strip('"') for n in names]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in clean])
    return spark.read.options(**options).schema(schema).csv(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned site table."""
    return spark.read.option("header", True).schema(schemas.SITES).csv(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions with a ``model`` column, one folder per model."""
    df.write.mode(mode).partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str, models=None, first_only: bool = False):
    """Predictions of the given models in order of preference.

    With ``first_only`` just the first model that has any rows; without ``models`` all of them.
    """
    df = spark.read.parquet(path)
    if not models:
        return df
    parts = [df.where(F.col("model") == m) for m in models]
    if not first_only:
        return reduce(DataFrame.unionByName, parts)
    for part in parts:
        if not part.isEmpty():
            return part
    raise FileNotFoundError(f"no predictions of {models} under {path}")


def union_models(parts: dict[str, DataFrame]) -> DataFrame:
    """Model outputs stacked with a ``model`` name and ``model_order`` (the order given)."""
    named = [
        df.withColumns({"model": F.lit(name), "model_order": F.lit(i)})
        for i, (name, df) in enumerate(parts.items())
    ]
    return reduce(DataFrame.unionByName, named)


def check_long_list(df: DataFrame) -> DataFrame:
    """Trim headers, insist on the required columns, drop rows without a town or a site."""
    df = df.toDF(*[c.strip() for c in df.columns])
    missing = [c for c in schemas.LONG_LIST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    optional = {"Contact": "contact", "Email": "email"}
    df = df.withColumnsRenamed({**schemas.LONG_LIST_COLUMNS, **optional})
    for name in optional.values():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.na.drop(subset=["town", "potential_sites"])


def read_long_list(spark: SparkSession, path: str) -> DataFrame:
    """Long list of community sites (CSV with the published column headings)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return check_long_list(reader.schema(schema).csv(path))


def to_json_rows(df: DataFrame) -> DataFrame:
    """Result rows as JSON text, nulls included."""
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.to_json(packed, {"ignoreNullFields": "false"}).alias("value"))


def write_json_results(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Results and summary as two folders of JSON lines."""
    to_json_rows(results).write.mode("overwrite").text(f"{path}/results")
    to_json_rows(summary).write.mode("overwrite").text(f"{path}/summary")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and two 64-bit sums of row hashes."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row, other = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    wide = "decimal(38,0)"
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(row.cast(wide)).alias("hash_a"),
        F.sum(other.cast(wide)).alias("hash_b"),
    )


def table_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether two snapshots of a table differ."""
    a = table_fingerprint(old).select(F.struct("*").alias("a"))
    b = table_fingerprint(new).select(F.struct("*").alias("b"))
    # two one-row frames
    return a.withColumn("b", b.scalar()).select(
        (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
        F.col("a.row_count").alias("old_rows"),
        F.col("b.row_count").alias("new_rows"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.sha2(F.col("content"), 256).alias("sha256"),
    )


def snapshot_changed(spark: SparkSession, old_path: str, new_path: str) -> DataFrame:
    """Files of two snapshot folders with whether the content differs (or one is missing)."""
    old = file_digests(spark, old_path).withColumnRenamed("sha256", "old_sha256")
    new = file_digests(spark, new_path).withColumnRenamed("sha256", "new_sha256")
    return old.join(new, "file", "full").withColumn(
        "changed", ~F.col("old_sha256").eqNullSafe(F.col("new_sha256"))
    )
