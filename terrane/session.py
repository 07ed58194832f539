"""Session helpers: reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, tuple[SparkSession, str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, unless they inherit a path to it."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(sc, "_terrane_shipped", False):
        return
    if root not in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        archive = os.path.join(tempfile.mkdtemp(prefix="terrane-code-"), "terrane.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(os.path.join(root, "terrane")):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
        sc.addPyFile(archive)
    sc._terrane_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_terrane_shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="terrane-shared-")
            spark._terrane_shared = found
    return found.rstrip("/")


def _path(spark: SparkSession, url: str):
    return spark._jvm.org.apache.hadoop.fs.Path(url)


def _delete(spark: SparkSession, url: str) -> None:
    path = _path(spark, url)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the optimiser true sizes. Written tables are
    removed by :func:`release`, or when the driver ends.
    """
    spark = df.sparkSession
    url = shared_table(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(url)
    out = spark.read.schema(df.schema).parquet(url) if not partition_by else spark.read.parquet(url)
    out._terrane_url = url
    return out


def shared_table(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    url = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}"
    _WRITTEN[url] = (spark, url)
    return url


def together(dfs: list[DataFrame]) -> DataFrame:
    """Tables of one schema, each written by :func:`materialize`, read by one scan."""
    spark = dfs[0].sparkSession
    return spark.read.schema(dfs[0].schema).parquet(*[df._terrane_url for df in dfs])


def release(*dfs: DataFrame | None) -> None:
    """Delete tables written by :func:`materialize` that no later plan reads."""
    for df in dfs:
        url = getattr(df, "_terrane_url", None)
        if url and url in _WRITTEN:
            spark, _ = _WRITTEN.pop(url)
            _delete(spark, url)


def size_of(df: DataFrame) -> int:
    """Bytes on disk of a table written by :func:`materialize`."""
    spark = df.sparkSession
    path = _path(spark, df._terrane_url)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()


@atexit.register
def _clean() -> None:
    for spark, url in list(_WRITTEN.values()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, url)
        except Exception:  # the JVM is gone already
            pass
    _WRITTEN.clear()
