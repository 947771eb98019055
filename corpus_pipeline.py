"""From raw documents to packed training windows, in five stages.

Every stage takes the documents its predecessor kept, as read back from Parquet, and all but the last
return the columns of ``documents``. Low-quality and toxic documents go, one document of every group of
near copies stays, documents that hold benchmark items go, secrets are replaced by a mark, and the rest is
packed into windows of 1024 ids.

Stages hand text to Python in Arrow batches bounded by bytes, set for the session: two tasks of an executor
each hold a batch in the JVM and in a worker, so Spark's default size would outweigh the operators' own slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import table
from gridspark.llm.decontamination import without_contaminated
from gridspark.llm.jaccard_join import one_of_each
from gridspark.llm.packing import pack
from gridspark.llm.quality import KEEP_SCORE, SCORES, co_train
from gridspark.llm.secrets import redact
from gridspark.llm.tokens import tokenizer_path
from gridspark.session import release, scratch_dir


BATCH_BYTES = 4 << 20  # of an Arrow batch, or one row


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds for good."""
    _bounded(spark)
    model = co_train(docs, table(spark, sf_dir, "labels"))
    free = "_".join(["", *docs.columns])  # longer than any column's name
    scored = model.score(docs, tuple(free + name for name in SCORES))
    return scored.where(F.col(f"`{free}{SCORES[-1]}`") >= KEEP_SCORE).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every component of the n-gram Jaccard join."""
    _bounded(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _bounded(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 ids."""
    _bounded(spark)
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        release(docs)  # the stage before; the given table has no such folder
        docs = spark.read.parquet(path)
        docs.scratch_path = path
    return docs
