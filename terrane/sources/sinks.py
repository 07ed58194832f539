"""Writing results as tables: Parquet, laid out for the scans that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo


def write_by_id(df: DataFrame, path: str, id_col: str = "id") -> None:
    """Sorted by id over ranges, so that row groups and files can be skipped by id."""
    df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_by_place(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon") -> None:
    """Sorted by Z-order code over ranges."""
    code = geo.unsigned_order(geo.morton(F.col(lat), F.col(lon)))
    df.withColumn("_code", code).repartitionByRange(F.col("_code")).sortWithinPartitions("_code").drop("_code").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_leaves(assigned: DataFrame, path: str, leaf: str = "node_id") -> None:
    """A folder for each leaf of the kd-tree, which is bounded in size; one task writes a leaf."""
    assigned.withColumnRenamed(leaf, "leaf").repartition("leaf").write.mode("overwrite").option("compression", "zstd").partitionBy("leaf").parquet(path)


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
