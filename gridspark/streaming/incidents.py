"""The live incident feed and the outage feed as streams.

A feed is polled by dropping one snapshot folder per poll into a directory. Each micro-batch is
one snapshot; state is a table in the shared folder, written under the batch's number, so that a
batch that is run again after a failure reads the same state and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from gridspark.operators.incremental import new_incidents, next_known
from gridspark.operators.ranking import keep_first
from gridspark.session import materialize, release


def _state_before(spark: SparkSession, folder: str, batch: int, schema: str | StructType):
    """State left by the batch before; empty at the start. Batches run strictly in order."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch - 1}")


def watch_incidents(
    snapshots: DataFrame,
    state_dir: str,
    output_dir: str,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch handler that reports incidents not seen before, exactly as the polled check does.

    Known numbers are replaced by the current ones only when something new was reported, and
    cleared by an empty snapshot. ``enrich`` adds context (stream-static joins).
    """
    spark = snapshots.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        known = _state_before(spark, state_dir, number, "incident_num string")
        # compared with the state once: what is new is stored, and decides on the next state
        fresh = materialize(new_incidents(batch, known), "fresh")
        report = enrich(fresh) if enrich else fresh
        report.write.mode("overwrite").parquet(f"{output_dir}/batch={number}")
        next_known(batch, known, fresh).write.mode("overwrite").parquet(f"{state_dir}/batch={number}")
        release(fresh)

    return handle


def incident_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    checkpoint: str,
    state_dir: str,
    output_dir: str,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Run the check over a directory of snapshot files, one file per micro-batch."""
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source_dir)
    handler = watch_incidents(feed, state_dir, output_dir, enrich)
    writer = feed.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute"
    )
    return writer.start()


def outage_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    checkpoint: str,
    table_dir: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Load arriving outage files; the stream's checkpoint is the high-water mark.

    Every batch is stored once under its number, so a load writes what arrived and nothing else;
    ``current_outages`` resolves the newest row per key when the table is read.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/batch={number}")

    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (
        feed.parquet(source_dir)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_outages(
    spark: SparkSession,
    table_dir: str,
    schema: StructType,
    order: str,
    key: str = "incident_reference_number",
) -> DataFrame:
    """The newest row of every key over all loaded batches; later batches win."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(full).option("basePath", table_dir).parquet(table_dir)
    latest = [F.col("batch").desc(), F.col(order).desc()]
    return keep_first(rows, [key], latest).drop("batch")


def first_sightings(snapshots: DataFrame, horizon: str = "2 days") -> DataFrame:
    """Native alternative for an incident stream: each number once per horizon of event time.

    Differs from the polled check: a number that leaves the feed and returns within the horizon
    is not reported again.
    """
    marked = snapshots.withColumn("event_time", snapshots["outage_time"].cast("timestamp"))
    return marked.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(
        ["incident_num"]
    )
