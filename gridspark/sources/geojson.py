"""GeoJSON feature collections, read and written with Spark's JSON functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark import schemas

# Property names that can hold a region's name, most wanted first.
TAGGING_NAME_FIELDS = ("CTY23NM", "CTY22NM", "CTY21NM", "CTY20NM", "name", "NAME")
BOUNDARY_NAME_FIELDS = ("local_authority", "county", "name")

_FEATURE = T.StructType(
    [
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "geometry",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("coordinates", T.StringType()),
                ]
            ),
        ),
    ]
)
_FILE = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])


def multipolygon(kind: Column, coordinates: Column) -> Column:
    """Coordinates text of a Polygon or MultiPolygon as polygon → ring → [lon, lat]."""
    one = F.from_json(coordinates, schemas.POLYGONS.simpleString())
    many = F.from_json(coordinates, schemas.MULTIPOLYGON.simpleString())
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features as ``feature_id``, ``properties`` (map), ``geometry_type``, ``polygons``.

    A feature collection is one JSON document per file and so one task per file. Large layers
    should be stored one feature per line (``write_feature_lines``) and read with ``lines``.
    """
    if lines:
        rows = spark.read.schema(_FEATURE).json(path).select(
            F.monotonically_increasing_id().alias("feature_id"), F.struct("*").alias("f")
        )
    else:
        files = spark.read.schema(_FILE).option("multiLine", True).json(path)
        rows = files.select(F.posexplode("features").alias("feature_id", "f"))
    kind = F.col("f.geometry.type")
    return rows.select(
        "feature_id",
        F.col("f.properties").alias("properties"),
        kind.alias("geometry_type"),
        multipolygon(kind, F.col("f.geometry.coordinates")).alias("polygons"),
    )


def name_field(features: DataFrame, candidates) -> str:
    """The first candidate that any feature carries; an error when there is none."""
    keys = F.map_keys("properties")
    seen = features.agg(
        *[F.max(F.array_contains(keys, c).cast("int")).alias(c) for c in candidates]
    ).first()
    for name in candidates:
        if seen[name]:
            return name
    raise ValueError(f"no name field among {list(candidates)}")


def read_regions(
    spark: SparkSession, path: str, candidates=TAGGING_NAME_FIELDS, lines: bool = False
) -> DataFrame:
    """Named boundary polygons."""
    features = read_features(spark, path, lines)
    field = name_field(features, candidates)
    return features.select(
        F.col("feature_id").alias("region_id"),
        F.col("properties").getItem(field).alias("name"),
        "polygons",
    )


def read_tenders(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Flexibility tenders: the feed's properties as columns, plus the polygons."""
    features = read_features(spark, path, lines)
    fields = [F.col("properties").getItem(n).alias(n) for n in schemas.TENDER_FIELDS]
    return features.select("feature_id", *fields, "geometry_type", "polygons")


def records_to_features(df: DataFrame, shape: str = "geo_shape") -> DataFrame:
    """Records with a ``geo_shape`` text as one GeoJSON feature per row.

    The shape may be a geometry or a feature wrapping one. Rows without a shape are dropped;
    the geo columns do not appear among the properties.
    """
    inner = F.get_json_object(F.col(shape), "$.geometry")
    geometry = F.parse_json(F.coalesce(inner, F.col(shape)))
    props = F.struct(*[c for c in df.columns if c not in (shape, "geo_point_2d")])
    feature = F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")
    )
    present = F.col(shape).isNotNull() & (F.trim(F.col(shape)) != "")
    return df.where(present).select(F.to_json(feature).alias("value"))


def write_feature_lines(df: DataFrame, path: str, shape: str = "geo_shape") -> None:
    """One feature per line, as many files as there are partitions."""
    records_to_features(df, shape).write.mode("overwrite").text(path)
