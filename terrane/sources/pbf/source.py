"""The data source: frames are scanned once when planned, blobs are decoded by the tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrane.session import ship
from terrane.sources.pbf import decode, wire

#: The greatest sizes that the format allows.
MAX_HEADER, MAX_BLOB = 64 * 1024, 32 * 1024 * 1024


@dataclass(frozen=True)
class Frame:
    start: int
    data: int
    size: int
    type: str


@dataclass
class BlobRange(InputPartition):
    file: str
    frames: list[Frame]

    def __init__(self, file: str, frames: list[Frame]):
        super().__init__((file, frames[0].start))
        self.file, self.frames = file, frames


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = _filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path.removesuffix(inner)
    return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".pbf"))


def frames(path: str, start: int = 0) -> Iterator[Frame]:
    """The frames of a file from the frame that begins at ``start``; only headers are read."""
    system, inner = _filesystem(path)
    with system.open_input_file(inner) as f:
        end, at = f.size(), start
        while at < end:
            f.seek(at)
            head = f.read(4)
            if len(head) < 4:
                raise wire.WireError(f"{path}: {len(head)} bytes behind the last frame")
            (size,) = struct.unpack(">I", head)
            if size > MAX_HEADER:
                raise wire.WireError(f"{path}: blob header of {size} bytes at {at}")
            h = wire.message(f.read(size), decode.BLOB_HEADER)
            data = at + 4 + size
            if not 0 <= h.get("size", -1) <= MAX_BLOB or data + h["size"] > end:
                raise wire.WireError(f"{path}: blob of {h.get('size')} bytes at {at}")
            yield Frame(at, data, h["size"], h.get("type", ""))
            at = data + h["size"]


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("osmpbf needs a path")
        self.entity = options.get("entity", "node")
        self.tags, self.info = (options.get(k, d).lower() == "true" for k, d in (("tags", "true"), ("info", "false")))
        self.start = int(options.get("startoffset", options.get("startOffset", "0")))
        self.target = int(options.get("partitionbytes", options.get("partitionBytes", str(32 << 20))))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in _files(self.path):
            held: list[Frame] = []
            for f in frames(file, self.start):
                if self.entity != "blob" and f.type != ("OSMHeader" if self.entity == "header" else "OSMData"):
                    continue
                if held and f.data + f.size - held[0].start > self.target:
                    out.append(BlobRange(file, held))
                    held = []
                held.append(f)
            if held:
                out.append(BlobRange(file, held))
        return out

    def read(self, partition: BlobRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no blob of the entity
            return
        system, inner = _filesystem(partition.file)
        with system.open_input_file(inner) as f:
            for x in partition.frames:
                f.seek(x.data)
                data = f.read(x.size)
                if self.entity == "blob":
                    blob = decode.parse_blob(data) if x.type in ("OSMHeader", "OSMData") else {}
                    codec = decode.codec_of(blob)
                    kinds = [("file", pa.string()), ("start_position", pa.int64()), ("data_position", pa.int64()), ("type", pa.string()), ("data_size", pa.int32()), ("codec", pa.string()), ("raw_size", pa.int32())]
                    raw = len(blob["raw"]) if codec == "raw" else blob.get("raw_size")
                    yield pa.RecordBatch.from_pylist([dict(zip([k for k, _ in kinds], (partition.file, x.start, x.data, x.type, x.size, codec, raw)))], schema=pa.schema(kinds))
                elif self.entity == "header":
                    yield decode.header(decode.inflate(data))
                else:
                    yield from decode.Block(decode.inflate(data)).batches(self.entity, self.tags, self.info)


class PbfDataSource(DataSource):
    """Options: ``path`` (a file, or a folder of .pbf files), ``entity`` (node, way, relation, header, blob), ``tags``
    and ``info`` (whether to read them), ``startOffset`` (of a frame), ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        entity = self.options.get("entity", "node")
        if entity not in decode.SCHEMAS:
            raise ValueError(f"entity {entity!r} is none of {', '.join(decode.SCHEMAS)}")
        parts = [decode.SCHEMAS[entity]]
        if entity in ("node", "way", "relation"):
            parts += [decode.TAGS_DDL] * (self.options.get("tags", "true").lower() == "true") + [decode.INFO_DDL] * (self.options.get("info", "false").lower() == "true")
        return ", ".join(parts)

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PbfDataSource)


def tables(spark: SparkSession, path: str) -> dict:
    """The tables of an extract in the shapes of the operators: nodes, ways, relations and the flat tags."""
    from functools import reduce

    from pyspark.sql import functions as F

    register(spark)
    read = lambda e: spark.read.format("osmpbf").option("entity", e).option("info", "true").load(path)
    out, tags = {}, []
    for kind, (name, entity) in enumerate((("nodes", "node"), ("ways", "way"), ("relations", "relation"))):
        df = read(entity)
        tags.append(df.select(F.lit(kind).cast("tinyint").alias("kind"), "id", F.inline("tags").alias("k", "v")))
        meta = [F.coalesce(F.col("info.version"), F.lit(1)).alias("version"), F.col("info.timestamp").alias("ts"), F.col("info.changeset").alias("changeset"), F.coalesce(F.col("info.visible"), F.lit(True)).alias("visible"), F.coalesce(F.col("info.timestamp"), F.timestamp_seconds(F.lit(0))).alias("loaded_at")]
        out[name] = df.select(*[c for c in df.columns if c not in ("tags", "info")], *meta)
    out["tags"] = reduce(lambda a, b: a.unionAll(b), tags)
    return out
