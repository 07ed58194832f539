"""Ranks over whole tables without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, bucket: Column, order: list, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based ``rank`` in ``order`` (within ``by``).

    ``bucket`` must rise with ``order``: buckets are counted, their counts added up, and rows are sorted within their
    bucket alone. Only the list of buckets is seen by one task.
    """
    by = by or []
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_m"))
    running = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "_bucket", F.coalesce(F.sum("_m").over(running), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return df.join(before, [*by, "_bucket"]).withColumn(name, F.col("_before") + own - 1).drop("_bucket", "_before")


def piece(counts: DataFrame, at: str, by: str = "node_id") -> DataFrame:
    """Of the counts ``m`` of pieces in order of ``at``, the piece that holds rank ``k``; ``before`` lie below it."""
    upto = F.sum("m").over(Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("m"))
    return found.filter((F.col("before") <= F.col("k")) & (F.col("k") < F.col("upto")))


def nth_value(df: DataFrame, by: str, value: str, rank: DataFrame) -> DataFrame:
    """(``by``, value): the value of 0-based rank ``k`` (``rank``: ``by``, k) of the int column ``value`` of each group.

    Selection by histograms: groups are counted by the upper 16 bits of the value, then, in the piece that holds the
    rank, by the lower 16. Two aggregations, however large a group is.
    """
    v = F.col(value).cast("bigint") + 2**31
    rows = df.select(by, F.shiftright(v, 16).alias("hi"), v.bitwiseAND(F.lit(0xFFFF)).alias("lo"))
    high = piece(rows.groupBy(by, "hi").agg(F.count(F.lit(1)).alias("m")).join(rank, by), "hi", by).select(by, "hi", (F.col("k") - F.col("before")).alias("k"))
    low = piece(rows.join(high, [by, "hi"]).groupBy(by, "hi", "k", "lo").agg(F.count(F.lit(1)).alias("m")), "lo", by)
    return low.select(by, (F.shiftleft("hi", 16) + F.col("lo") - 2**31).cast("int").alias("value"))
