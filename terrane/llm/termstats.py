"""Rows and records of every distinct term, by recursive radix spilling.

Rows are counted by (term, record) before they are shuffled, so that one that repeats without end is a row a task. They are
spread over tasks by a hash of (term, record): a term that holds a third of all rows is shared by all tasks. A task
appends its rows to radix partitions by bits of the term's hash, in the scratch folders that Spark gives its workers for
spills; partitions beyond ``max_bytes`` are split again by the next bits (of the record's hash once the term's are used
up: all rows of one term), and each is aggregated by DuckDB, which reads it as a stream of batches. Rows and records of a
term add up over tasks, as all rows of one (term, record) are in one.

Defined results: null terms are no terms, their rows still count for the records; the empty string is a term; null
record columns make one record like any value; repeated rows count as rows, once as a record; an empty table gives no
rows; extra columns are never read.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIX_BITS = 4
MAX_BYTES = 64 << 20


def _scratch() -> str:
    """A folder in Spark's own spill space, which it removes with the executor."""
    return tempfile.mkdtemp(prefix="radix-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


def _aggregate(batches: pa.RecordBatchReader, scratch: str) -> pa.Table:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": scratch}) as con:
        con.register("t", batches)
        out = con.sql("SELECT term, sum(n)::BIGINT AS row_count, count(*)::BIGINT AS record_count FROM (SELECT term, rec, sum(n) AS n FROM t GROUP BY ALL) GROUP BY term").to_arrow_table()
    return out.cast(pa.schema([("term", pa.string()), ("row_count", pa.int64()), ("record_count", pa.int64())]))


class _Radix:
    """Radix partitions of one level: Arrow IPC files, one for each value of ``RADIX_BITS`` bits."""

    def __init__(self, root: str, level: int, max_bytes: int):
        self.root, self.level, self.max_bytes, self.size = root, level, max_bytes, {}
        self.files: dict[int, pa.ipc.RecordBatchStreamWriter] = {}

    def _bits(self, b: pa.RecordBatch) -> np.ndarray:
        per = 64 // RADIX_BITS
        name, level = ("h", self.level) if self.level < per else ("r", self.level - per)
        h = b.column(b.schema.get_field_index(name)).to_numpy().view(np.uint64)
        return ((h >> np.uint64(64 - RADIX_BITS * (level + 1))) & np.uint64((1 << RADIX_BITS) - 1)).astype(np.int8)

    def path(self, i: int) -> str:
        return os.path.join(self.root, f"{self.level}-{i}-{id(self)}.arrow")

    def add(self, b: pa.RecordBatch) -> None:
        bits = self._bits(b)
        for i in np.unique(bits).tolist():
            own = b.filter(pa.array(bits == i))
            if i not in self.files:
                self.files[i] = pa.ipc.new_stream(self.path(i), b.schema)
            self.files[i].write_batch(own)
            self.size[i] = self.size.get(i, 0) + own.nbytes

    def results(self):
        for f in self.files.values():
            f.close()
        for i in self.files:
            with pa.OSFile(self.path(i)) as f, pa.ipc.open_stream(f) as batches:
                if self.size[i] <= self.max_bytes or self.level + 1 >= 2 * (64 // RADIX_BITS):
                    yield _aggregate(batches, self.root)
                else:
                    deeper = _Radix(self.root, self.level + 1, self.max_bytes)
                    for b in batches:
                        deeper.add(b)
                    yield from deeper.results()
            os.unlink(self.path(i))


def _spill(max_bytes: int):
    def run(batches):
        root = _scratch()
        try:
            radix = _Radix(root, 0, max_bytes)
            for b in batches:
                if b.num_rows:
                    radix.add(b)
            for t in radix.results():
                yield from t.to_batches()
        finally:
            shutil.rmtree(root, ignore_errors=True)

    return run


def term_counts(df: DataFrame, term: str, record: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(term, row_count, record_count) for every distinct non-null value of ``term``; a record is a distinct ``record``."""
    rec = F.to_json(F.struct(*record))
    rows = df.filter(F.col(term).isNotNull()).groupBy(F.col(term).cast("string").alias("term"), rec.alias("rec")).agg(F.count(F.lit(1)).alias("n"))
    # the aggregate leaves the rows spread by (term, record): no other shuffle follows
    rows = rows.select("term", "rec", "n", F.xxhash64("term").alias("h"), F.xxhash64("rec", F.lit(1)).alias("r"))
    partial = rows.mapInArrow(_spill(max_bytes), "term string, row_count bigint, record_count bigint")
    return partial.groupBy("term").agg(F.sum("row_count").alias("row_count"), F.sum("record_count").alias("record_count"))


def marked_terms(df: DataFrame, term: str, record: list[str], rare_below: int = 3, common_above_percent: int = 12, max_bytes: int = MAX_BYTES) -> DataFrame:
    """:func:`term_counts` with ``mark``: rare (fewer records than ``rare_below``), common (more than the share) or null."""
    records = df.select(*record).distinct().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    counts = term_counts(df, term, record, max_bytes)
    mark = F.when(F.col("record_count") < rare_below, "rare").when(F.col("record_count") * 100 > F.lit(records * common_above_percent), "common")
    return counts.withColumn("mark", mark)
