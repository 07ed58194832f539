"""Most frequent items in bounded memory: Misra-Gries summaries that are merged as a tree.

Each partition keeps at most ``m`` counters. Where more are held, the (m+1)-th largest counter is subtracted from all
and what isn't positive is dropped; two summaries are merged by adding them and subtracting likewise. A summary of n
entries undercounts each item by at most n / (m + 1), so every item above that frequency is held.

Defined results: nulls aren't entries; the empty string is an item; repeated rows count each time; ties at the
threshold are in; an empty table gives an empty table; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 1024
#: Summaries left after each merge of the tree, before the last to one.
STEPS = (1024, 32)
_SCHEMA = "field string, item string, cnt bigint, n bigint"


def _reduce(items: pa.Array, counts: pa.Array, m: int) -> tuple[pa.Array, pa.Array]:
    t = pa.table({"item": items, "cnt": counts}).group_by("item").aggregate([("cnt", "sum")])
    items, counts = t["item"].combine_chunks(), t["cnt_sum"].to_numpy()
    if len(counts) > m:
        counts = counts - np.partition(counts, len(counts) - m - 1)[len(counts) - m - 1]
        items, counts = items.filter(pa.array(counts > 0)), counts[counts > 0]
    return items, pa.array(counts, pa.int64())


class Summary:
    """Counters of one column; ``n`` is the number of entries seen."""

    def __init__(self, m: int = COUNTERS):
        self.m, self.n, self.items, self.counts = m, 0, pa.array([], pa.string()), pa.array([], pa.int64())

    def add(self, items: pa.Array, counts: pa.Array | None = None, n: int | None = None) -> None:
        if counts is None:
            items = items.drop_null()
            n, counts = len(items), pa.array(np.ones(len(items), np.int64))
        self.n += n or 0
        self.items, self.counts = _reduce(pa.concat_arrays([self.items, items]), pa.concat_arrays([self.counts, counts]), self.m)

    def batch(self, field: str) -> pa.RecordBatch:
        """The counters, and one row with a null item that carries ``n``."""
        k = len(self.items) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([field] * k, pa.string()), pa.concat_arrays([self.items, pa.array([None], pa.string())]), pa.concat_arrays([self.counts, pa.array([0], pa.int64())]), pa.array([0] * (k - 1) + [self.n], pa.int64())],
            names=["field", "item", "cnt", "n"],
        )


def summaries(df: DataFrame, columns: list[str], m: int = COUNTERS) -> DataFrame:
    """A summary of every partition for each column, in one pass without a shuffle."""

    def run(batches):
        held = {c: Summary(m) for c in columns}
        for b in batches:
            for i, c in enumerate(columns):
                held[c].add(b.column(i))
        for c, s in held.items():
            if s.n:
                yield s.batch(c)

    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(run, _SCHEMA).withColumn("part", F.spark_partition_id())


def _merge(m: int):
    def run(key, table):
        s = Summary(m)
        counters = table.filter(table["item"].is_valid())
        s.add(counters["item"].combine_chunks().cast(pa.string()), counters["cnt"].combine_chunks(), int(np.sum(table["n"].to_numpy())))
        return pa.Table.from_batches([s.batch(key[0].as_py())]).append_column("part", pa.array([key[1].as_py()] * (len(s.items) + 1), pa.int32()))

    return run


def merged(parts: DataFrame, m: int = COUNTERS) -> DataFrame:
    """Merge summaries by a tree of fixed depth, so that no task holds more than a few hundred of them."""
    for step in (*STEPS, 0):
        part = F.pmod(F.col("part"), F.lit(step)) if step else F.lit(0)
        parts = parts.withColumn("part", part.cast("int")).groupBy("field", "part").applyInArrow(_merge(m), _SCHEMA + ", part int")
    return parts.drop("part")


def heavy_hitters(df: DataFrame, columns: list[str], m: int = COUNTERS) -> DataFrame:
    """(field, item, lower_count, upper_count, n): at most ``m`` items a column with bounds on their counts.

    The true count lies between ``lower_count`` and ``upper_count`` = lower + n / (m + 1).
    """
    s = merged(summaries(df, columns, m), m)
    total = s.filter(F.col("item").isNull()).groupBy("field").agg(F.max("n").alias("n"))
    items = s.filter(F.col("item").isNotNull()).select("field", "item", "cnt")
    bound = F.floor(F.col("n") / F.lit(m + 1)).cast("bigint")
    return items.join(F.broadcast(total), "field").select("field", "item", F.col("cnt").alias("lower_count"), F.least(F.col("cnt") + bound, F.col("n")).alias("upper_count"), "n")


def frequent(df: DataFrame, columns: list[str], permille: float, m: int = COUNTERS) -> DataFrame:
    """(field, item, cnt, n): exactly the items that make up at least ``permille`` / 1000 of a column's entries.

    The summaries name the candidates, at most ``m`` a column; a second pass counts those alone.
    """
    if permille / 1000 <= 1 / (m + 1):
        raise ValueError(f"{m} counters can't guarantee items of {permille} permille")
    found = heavy_hitters(df, columns, m).filter(F.col("upper_count") * 1000 >= F.col("n") * permille)
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("item")) for c in columns])).alias("x")).select("x.field", "x.item")
    # at most m candidates a column: the broadcast is bounded by the number of counters
    counted = rows.join(F.broadcast(found.select("field", "item", "n")), ["field", "item"]).groupBy("field", "item", "n").agg(F.count("*").alias("cnt"))
    return counted.filter(F.col("cnt") * 1000 >= F.col("n") * permille).select("field", "item", "cnt", "n")
