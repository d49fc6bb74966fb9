"""Incremental indexing of documents: new files are taken in as they come, bad rows go to a table of their own.

A checkpoint remembers the files that are done, so a stopped job goes on where it was and a rerun without new
files writes nothing. Each micro-batch is written under its number, so one that is repeated after a failure
replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.tables import runs

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _write(out: str):
    def batch(df: DataFrame, number: int) -> None:
        good, bad = df.where("doc_id IS NOT NULL AND text IS NOT NULL"), df.where("doc_id IS NULL OR text IS NULL")
        runs(good).write.mode("overwrite").parquet(f"{out}/runs/batch={number}")
        bad.withColumn("reason", F.when(F.col("doc_id").isNull(), "missing_id").otherwise("missing_text")).write.mode("overwrite").parquet(f"{out}/failed/batch={number}")

    return batch


def index_new(spark: SparkSession, source: str, out: str, files_per_trigger: int = 1000) -> None:
    """Index the Parquet files of `source` that are not in `out` yet, then stop."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    query = stream.writeStream.foreachBatch(_write(out)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def indexed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/runs")


def failed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/failed")


def retry_failed(spark: SparkSession, out: str, repaired: DataFrame) -> DataFrame:
    """Runs of repaired documents that had failed: what a retry adds to the index."""
    return runs(repaired.join(failed(spark, out).select("doc_id").distinct(), "doc_id", "left_semi"))
