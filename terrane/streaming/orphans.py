"""Orphan references kept up to date by a stream: each micro-batch advances the keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import orphans
from terrane.session import _delete, _path

#: The one schema in which elements of all kinds arrive.
SCHEMA = "kind tinyint, id bigint, refs array<bigint>, members array<struct<type:tinyint,ref:bigint,role:string>>, version int, ts timestamp, visible boolean, loaded_at timestamp"


class OrphanStream:
    """State in ``folder``, a table set for each batch; a batch that is run again starts from the state before it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> list[int]:
        path = _path(self.spark, self.folder)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n) for n in names if n.isdigit() and fs.exists(_path(self.spark, f"{self.folder}/{n}/refs/_SUCCESS"))]
        return sorted(done)

    def state(self, before: int | None = None) -> orphans.OrphanState:
        done = [n for n in self._batches() if before is None or n < before]
        if not done:
            return orphans.OrphanState()
        read = lambda t: self.spark.read.parquet(f"{self.folder}/{done[-1]}/{t}")
        return orphans.OrphanState(read("parents"), read("owners"), read("refs"))

    def process(self, batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        tables = {0: batch.filter("kind = 0"), 1: batch.filter("kind = 1"), 2: batch.filter("kind = 2")}
        after = orphans.advance(self.state(n), tables)
        for name in ("parents", "owners", "refs"):  # refs last: its marker completes the batch
            getattr(after, name).write.mode("overwrite").parquet(f"{self.folder}/{n}/{name}")
        orphans.release(after.parents, after.owners, after.refs)
        batch.unpersist()
        for old in self._batches():
            if old < n - 1:
                _delete(self.spark, f"{self.folder}/{old}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """``stream`` has the columns of ``SCHEMA``; by default all that has arrived is run, then the query ends."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def report(self) -> DataFrame:
        return orphans.report(self.state())


def arrivals(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """The three tables in the one schema."""
    none = lambda t: F.lit(None).cast(t)
    meta = ["version", "ts", "visible", "loaded_at"]
    member = "array<struct<type:tinyint,ref:bigint,role:string>>"
    parts = [
        nodes.select(F.lit(0).cast("tinyint").alias("kind"), "id", none("array<bigint>").alias("refs"), none(member).alias("members"), *meta),
        ways.select(F.lit(1).cast("tinyint").alias("kind"), "id", "refs", none(member).alias("members"), *meta),
        relations.select(F.lit(2).cast("tinyint").alias("kind"), "id", none("array<bigint>").alias("refs"), F.col("members").cast(member).alias("members"), *meta),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
