"""Current rows of versioned tables whose rows arrive late, repeated and out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST = -(2**31)


def version() -> Column:
    """The version; a null version is below every other."""
    return F.coalesce(F.col("version"), F.lit(_LEAST))


def live() -> Column:
    """Whether a row doesn't delete its record; null ``visible`` counts as true."""
    return F.coalesce(F.col("visible"), F.lit(True))


def current(df: DataFrame, columns: list[str]) -> DataFrame:
    """(id, ``columns``) of each live record, from its row of the highest version.

    Rows with a null id are no records. Rows of one version that differ, which the tables shouldn't hold, are ordered
    by their contents, so the result is the same on every run.
    """
    row = F.struct(version().alias("version"), live().alias("live"), *columns)
    best = df.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("row"))
    return best.filter("row.live").select("id", *[F.col(f"row.{c}").alias(c) for c in columns])
