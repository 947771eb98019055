"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every job of this package relies on. AQE does the runtime work: it turns a join into a
# broadcast join only after it has measured the side, splits skewed shuffle partitions, and
# coalesces small ones. The one ``broadcast()`` hint (operators/skew.py) is on a list of limited
# length.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need; idempotent."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "gridspark", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session that names no such folder (a test) gets one of its own; on a cluster that
    would scatter files over machines, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/gridspark/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Cut the lineage of ``df`` by writing it to the shared scratch folder and reading it back.

    Unlike an executor-local checkpoint this survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def side_by_side(spark: SparkSession, jobs: list[Callable], most: int = 3) -> list:
    """The results of functions that run Spark jobs, at most so many at a time, in their order.

    As MLlib's cross validation does: fits whose tasks are few or wait for the driver leave cores to others.
    """
    if not jobs:
        return []
    with ThreadPool(min(most, len(jobs))) as pool:
        started = [pool.apply_async(inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.get() for r in started]


def release(*tables) -> None:
    """Remove the stored rows of materialised ``tables`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
