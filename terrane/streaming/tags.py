"""Tag counts over arriving files, by Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.session import shared_table


def stream_table(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table, a folder of files or a single one, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def tag_counts(stream: DataFrame) -> DataFrame:
    """(kind, k, cnt) so far: kept by key in the state store, with partial counts before the shuffle."""
    return stream.filter(F.col("k").isNotNull()).groupBy(F.col("kind").cast("int").alias("kind"), "k").agg(F.count(F.lit(1)).alias("cnt"))


def run_once(counts: DataFrame) -> DataFrame:
    """Runs a stream of complete results over all that has arrived and returns the last result as a table."""
    spark = counts.sparkSession
    at = shared_table(spark)
    spark_out = f"{at}/out"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(spark_out)

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(spark_out)
