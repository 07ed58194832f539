"""Blocks of an extract to Arrow record batches, one entity at a time."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa

from terrane.sources.pbf import wire

_TAGS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
_INFO = pa.struct([("version", pa.int32()), ("timestamp", pa.timestamp("us", "UTC")), ("changeset", pa.int64()), ("uid", pa.int32()), ("user", pa.string()), ("visible", pa.bool_())])
_MEMBER = pa.list_(pa.struct([("type", pa.int8()), ("ref", pa.int64()), ("role", pa.string())]))

SCHEMAS = {
    "node": "id bigint, lat double, lon double",
    "way": "id bigint, refs array<bigint>",
    "relation": "id bigint, members array<struct<type:tinyint,ref:bigint,role:string>>",
    "header": "min_lat double, max_lat double, min_lon double, max_lon double, required array<string>, optional array<string>, program string, source string",
    "blob": "file string, start_position bigint, data_position bigint, type string, data_size int, codec string, raw_size int",
}
TAGS_DDL = "tags array<struct<k:string,v:string>>"
INFO_DDL = "info struct<version:int,timestamp:timestamp,changeset:bigint,uid:int,user:string,visible:boolean>"

# field numbers of the format
_BLOB = {1: ("raw", "bytes"), 2: ("raw_size", "int"), 3: ("zlib", "bytes"), 4: ("lzma", "bytes"), 5: ("bzip2", "bytes"), 6: ("lz4", "bytes"), 7: ("zstd", "bytes")}
BLOB_HEADER = {1: ("type", "string"), 3: ("size", "int")}
_HEADER = {1: ("bbox", "bytes"), 4: ("required", "string[]"), 5: ("optional", "string[]"), 16: ("program", "string"), 17: ("source", "string")}
_BBOX = {1: ("left", "sint"), 2: ("right", "sint"), 3: ("top", "sint"), 4: ("bottom", "sint")}
_BLOCK = {1: ("strings", "bytes"), 2: ("groups", "bytes[]"), 17: ("granularity", "int"), 18: ("date_granularity", "int"), 19: ("lat_offset", "int"), 20: ("lon_offset", "int")}
_GROUP = {1: ("nodes", "bytes[]"), 2: ("dense", "bytes[]"), 3: ("ways", "bytes[]"), 4: ("relations", "bytes[]")}
_NODE = {1: ("id", "sint"), 2: ("keys", "uint[]"), 3: ("values", "uint[]"), 4: ("info", "bytes"), 8: ("lat", "sint"), 9: ("lon", "sint")}
_WAY = {1: ("id", "int"), 2: ("keys", "uint[]"), 3: ("values", "uint[]"), 4: ("info", "bytes"), 8: ("refs", "sint[]")}
_RELATION = {1: ("id", "int"), 2: ("keys", "uint[]"), 3: ("values", "uint[]"), 4: ("info", "bytes"), 8: ("roles", "int[]"), 9: ("ids", "sint[]"), 10: ("types", "int[]")}
_INFO_FIELDS = {1: ("version", "int"), 2: ("timestamp", "int"), 3: ("changeset", "int"), 4: ("uid", "int"), 5: ("user", "int"), 6: ("visible", "bool")}
_DENSE_INFO = {1: ("version", "int[]"), 2: ("timestamp", "sint[]"), 3: ("changeset", "sint[]"), 4: ("uid", "sint[]"), 5: ("user", "sint[]"), 6: ("visible", "bool[]")}


def codec_of(blob: dict) -> str:
    return next((c for c in ("raw", "zlib", "lzma", "bzip2", "lz4", "zstd") if c in blob), "none")


def parse_blob(data) -> dict:
    return wire.message(data, _BLOB)


def inflate(data) -> bytes:
    """The block in a blob."""
    blob = parse_blob(data)
    codec = codec_of(blob)
    if codec == "raw":
        out = bytes(blob["raw"])
    elif codec == "zlib":
        out = zlib.decompress(blob["zlib"])
    elif codec == "lzma":
        out = lzma.decompress(bytes(blob["lzma"]))
    elif codec == "bzip2":
        out = bz2.decompress(bytes(blob["bzip2"]))
    elif codec == "zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(bytes(blob["zstd"]), max_output_size=blob.get("raw_size", 0))
    else:
        raise wire.WireError(f"blob compressed by {codec}, which isn't supported")
    if "raw_size" in blob and codec != "raw" and len(out) != blob["raw_size"]:
        raise wire.WireError(f"blob holds {len(out)} bytes, not {blob['raw_size']}")
    return out


def header(data: bytes) -> pa.RecordBatch:
    h = wire.message(data, _HEADER)
    box = wire.message(h["bbox"], _BBOX) if "bbox" in h else {}
    row = {k: box[f] * 1e-9 if f in box else None for k, f in (("min_lat", "bottom"), ("max_lat", "top"), ("min_lon", "left"), ("max_lon", "right"))}
    row |= {"required": h["required"], "optional": h["optional"], "program": h.get("program"), "source": h.get("source")}
    kinds = [(k, pa.float64()) for k in ("min_lat", "max_lat", "min_lon", "max_lon")] + [("required", pa.list_(pa.string())), ("optional", pa.list_(pa.string())), ("program", pa.string()), ("source", pa.string())]
    return pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))


class Block:
    """One block: its strings and scales, and the elements of its groups."""

    def __init__(self, data: bytes):
        b = wire.message(data, _BLOCK)
        self.strings = [bytes(v).decode("utf-8") for n, _, v in wire.fields(b.get("strings", b"")) if n == 1]
        self.groups = [wire.message(g, _GROUP) for g in b["groups"]]
        self.granularity, self.date_granularity = b.get("granularity", 100), b.get("date_granularity", 1000)
        self.lat_offset, self.lon_offset = b.get("lat_offset", 0), b.get("lon_offset", 0)

    def _tags(self, keys, values) -> list[dict]:
        if len(keys) != len(values):
            raise wire.WireError(f"{len(keys)} keys and {len(values)} values")
        return [{"k": self.strings[k], "v": self.strings[v]} for k, v in zip(keys, values)]

    def _info(self, raw) -> dict | None:
        if raw is None:
            return None
        i = wire.message(raw, _INFO_FIELDS)
        return {"version": i.get("version"), "timestamp": i["timestamp"] * self.date_granularity * 1000 if "timestamp" in i else None, "changeset": i.get("changeset"), "uid": i.get("uid"), "user": self.strings[i["user"]] if "user" in i else None, "visible": i.get("visible", True)}

    def _dense_info(self, raw, n: int) -> list:
        if raw is None:
            return [None] * n
        i = wire.message(raw, _DENSE_INFO)
        run = {k: list(accumulate(i[k])) or [None] * n for k in ("timestamp", "changeset", "uid", "user")}
        version, visible = i["version"] or [None] * n, i["visible"] or [True] * n
        return [{"version": v, "timestamp": None if t is None else t * self.date_granularity * 1000, "changeset": c, "uid": u, "user": None if s is None else self.strings[s], "visible": bool(w)} for v, t, c, u, s, w in zip(version, run["timestamp"], run["changeset"], run["uid"], run["user"], visible)]

    def nodes(self, tags: bool, info: bool) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            for dense in g["dense"]:
                part: dict[int, object] = {n: v for n, _, v in wire.fields(dense)}
                ids, lat, lon = (np.cumsum(wire.packed_zigzag(part.get(n, b""))) for n in (1, 8, 9))
                cols = [pa.array(ids), pa.array(1e-9 * (self.lat_offset + self.granularity * lat)), pa.array(1e-9 * (self.lon_offset + self.granularity * lon))]
                names = ["id", "lat", "lon"]
                if tags:
                    own: list[list] = [[] for _ in range(len(ids))]
                    at, pending = 0, None
                    for v in wire.packed(part.get(10, b"")).tolist():
                        if pending is not None:
                            own[at].append({"k": self.strings[pending], "v": self.strings[v]})
                            pending = None
                        elif v == 0:
                            at += 1
                        else:
                            pending = v
                    cols.append(pa.array(own, _TAGS))
                    names.append("tags")
                if info:
                    cols.append(pa.array(self._dense_info(part.get(5), len(ids)), _INFO))
                    names.append("info")
                yield pa.RecordBatch.from_arrays(cols, names=names)
            plain = [wire.message(x, _NODE) for x in g["nodes"]]
            if plain:
                place = lambda n, f: 1e-9 * (getattr(self, f"{f}_offset") + self.granularity * n.get(f, 0))
                yield self._batch([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64())], [{"id": n.get("id", 0), "lat": place(n, "lat"), "lon": place(n, "lon")} for n in plain], plain, tags, info)

    def _batch(self, kinds, rows, raw, tags: bool, info: bool) -> pa.RecordBatch:
        if tags:
            kinds = [*kinds, ("tags", _TAGS)]
            rows = [r | {"tags": self._tags(x["keys"], x["values"])} for r, x in zip(rows, raw)]
        if info:
            kinds = [*kinds, ("info", _INFO)]
            rows = [r | {"info": self._info(x.get("info"))} for r, x in zip(rows, raw)]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    def ways(self, tags: bool, info: bool) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            raw = [wire.message(x, _WAY) for x in g["ways"]]
            if raw:
                yield self._batch([("id", pa.int64()), ("refs", pa.list_(pa.int64()))], [{"id": w.get("id", 0), "refs": list(accumulate(w["refs"]))} for w in raw], raw, tags, info)

    def relations(self, tags: bool, info: bool) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            raw = [wire.message(x, _RELATION) for x in g["relations"]]
            if raw:
                rows = []
                for r in raw:
                    if not len(r["ids"]) == len(r["roles"]) == len(r["types"]):
                        raise wire.WireError("members, roles and types differ in number")
                    rows.append({"id": r.get("id", 0), "members": [{"type": t, "ref": i, "role": self.strings[o]} for t, i, o in zip(r["types"], accumulate(r["ids"]), r["roles"])]})
                yield self._batch([("id", pa.int64()), ("members", _MEMBER)], rows, raw, tags, info)

    def batches(self, entity: str, tags: bool, info: bool) -> Iterator[pa.RecordBatch]:
        return {"node": self.nodes, "way": self.ways, "relation": self.relations}[entity](tags, info)
