"""The run ledger kept up to date from a stream of runs.

Each micro-batch adds one small row per scraper it saw (a partial rollup); the
ledger is the merge of those rows.  A batch overwrites its own partition, so a
batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import monitor as M

PARTIAL = (
    "scraper_id string, total_runs bigint, success_count bigint, error_count bigint, mismatch_count bigint, "
    "last_success timestamp, last_error timestamp, last_error_message string, verified boolean, batch bigint"
)


def read_runs(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Runs from files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def keep_ledger(runs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each batch's partial rollup to its own partition of ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        partial = M.rollup(batch).withColumn("batch", F.lit(number).cast("bigint"))
        (
            partial.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(path)
        )

    writer = runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far: counters add up, the newest error keeps its message."""
    parts = spark.read.schema(PARTIAL).parquet(path)
    total = lambda c: F.sum(c).alias(c)
    return parts.groupBy("scraper_id").agg(
        total("total_runs"), total("success_count"), total("error_count"), total("mismatch_count"),
        F.max("last_success").alias("last_success"), F.max("last_error").alias("last_error"),
        F.max_by("last_error_message", F.struct("last_error", "batch")).alias("last_error_message"),
        F.bool_or("verified").alias("verified"),
    )


def daily(runs: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily run counts as a windowed stream; days close when the watermark passes them."""
    day: Column = F.window("ts", "1 day")
    return (
        runs.withWatermark("ts", late).groupBy(day.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "success").alias("successes"),
            F.sum("yaml_count").alias("found"),
        )
        .select(F.to_date("w.start").alias("day"), "runs", "successes", "found")
    )
