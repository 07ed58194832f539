"""Elements to an extract: each task writes the blocks of its rows as a file of its own."""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import ship
from terrane.sources.pbf.source import _filesystem

#: Elements of one block.
BLOCK = 8000
NODE, WAY, RELATION = 0, 1, 2
#: What an extract holds of an element; tags and members hold no nulls.
SCHEMA = "kind int, id bigint, lat double, lon double, refs array<bigint>, members array<struct<type:tinyint,ref:bigint,role:string>>, tags array<struct<k:string,v:string>>"


def varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def _int(number: int, n: int) -> bytes:
    return varint(number << 3) + varint(n)


def _packed(number: int, values: list[int], delta: bool = False) -> bytes:
    if not values:
        return b""
    if delta:
        values = [b - a for a, b in zip([0, *values], values)]
        values = [n << 1 if n >= 0 else (-n << 1) - 1 for n in values]
    return _bytes(number, b"".join(map(varint, values)))


class _Strings:
    """The strings of a block by first use; the first is empty."""

    def __init__(self):
        self.number = {"": 0}

    def of(self, s: str) -> int:
        return self.number.setdefault(s, len(self.number))

    def data(self) -> bytes:
        return b"".join(_bytes(1, s.encode("utf-8")) for s in self.number)


def block(kind: int, rows: list[dict]) -> bytes:
    """A block of elements of one kind; positions in units of 1e-7 degrees."""
    strings = _Strings()
    tags = [[(strings.of(t["k"]), strings.of(t["v"])) for t in r["tags"] or []] for r in rows]
    fixed = lambda c: [math.floor(r[c] * 1e7 + 0.5) for r in rows]
    if kind == NODE:
        flat = [n for own in tags for n in [*(x for kv in own for x in kv), 0]]
        dense = _packed(1, [r["id"] for r in rows], True) + _packed(8, fixed("lat"), True) + _packed(9, fixed("lon"), True) + (_packed(10, flat) if any(tags) else b"")
        group = _bytes(2, dense)
    else:
        group = b""
        for r, own in zip(rows, tags):
            x = _int(1, r["id"]) + _packed(2, [k for k, _ in own]) + _packed(3, [v for _, v in own])
            if kind == WAY:
                group += _bytes(3, x + _packed(8, r["refs"] or [], True))
            else:
                m = r["members"] or []
                group += _bytes(4, x + _packed(8, [strings.of(y["role"]) for y in m]) + _packed(9, [y["ref"] for y in m], True) + _packed(10, [y["type"] for y in m]))
    return _bytes(1, strings.data()) + _bytes(2, group) + _int(17, 100)


def frame(kind: str, data: bytes) -> bytes:
    blob = _int(2, len(data)) + _bytes(3, zlib.compress(data))
    head = _bytes(1, kind.encode()) + _int(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def write_extract(elements: DataFrame, path: str) -> int:
    """Writes ``elements`` (of ``SCHEMA``) into the folder ``path`` as files in order of kind and id; returns how many elements."""
    ship(elements.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        system, inner = _filesystem(path)
        name, n, held = f"{inner.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.pbf", 0, []
        system.create_dir(inner, recursive=True)
        draft = f"{name}.{uuid.uuid4().hex}"  # a task that is run again replaces its file whole
        with system.open_output_stream(draft) as out:
            out.write(frame("OSMHeader", _bytes(4, b"OsmSchema-V0.6") + _bytes(4, b"DenseNodes")))
            for b in batches:
                for r in b.to_pylist():
                    if held and (len(held) == BLOCK or held[0]["kind"] != r["kind"]):
                        out.write(frame("OSMData", block(held[0]["kind"], held)))
                        held = []
                    held.append(r)
                n += b.num_rows
            if held:
                out.write(frame("OSMData", block(held[0]["kind"], held)))
        system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = elements.select(*[F.col(x.split()[0]) for x in SCHEMA.split(", ")]).repartitionByRange("kind", "id").sortWithinPartitions("kind", "id")
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
