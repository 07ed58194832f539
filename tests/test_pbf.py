"""Extracts written by a test encoder and read back."""

import lzma
import struct
import zlib

import pytest

from terrane.plans.actions import ACTIONS, run
from terrane.sources.pbf import register
from terrane.sources.pbf.source import frames, tables
from tests.test_geo import _varint


def _zz(v):
    return (v << 1) ^ (v >> 63)


def _f(n, value):
    if isinstance(value, int):
        return _varint(n << 3) + _varint(value)
    return _varint(n << 3 | 2) + _varint(len(value)) + value


def _packed(n, values, zigzag=False):
    return _f(n, b"".join(_varint(_zz(v) if zigzag else v) for v in values))


def _deltas(values):
    return [b - a for a, b in zip([0, *values], values)]


def _framed(kind, blob):
    head = _f(1, kind) + _f(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def _blob(block, codec="zlib"):
    if codec == "raw":
        return _f(1, block)
    if codec == "lz4":
        return _f(2, len(block)) + _f(6, b"x")
    return _f(2, len(block)) + (_f(3, zlib.compress(block)) if codec == "zlib" else _f(4, lzma.compress(block, lzma.FORMAT_ALONE)))


def extract(codec="zlib", extra=b""):
    strings = [b"", b"highway", b"residential", b"name", "Straße".encode(), b"outer", b"anna"]
    table = b"".join(_f(1, s) for s in strings)
    ids, lat, lon = [3, 10, 7], [481370000, -900000000, 0], [115750000, 1800000000, -5]
    info = _packed(1, [2, 1, 1]) + _packed(2, _deltas([100, 50, 70]), True) + _packed(3, _deltas([9, 8, 8]), True) + _packed(4, _deltas([1, 1, 2]), True) + _packed(5, _deltas([6, 6, 0]), True) + _packed(6, [1, 0, 1])
    dense = _packed(1, _deltas(ids), True) + _f(5, info) + _packed(8, _deltas(lat), True) + _packed(9, _deltas(lon), True) + _packed(10, [1, 2, 3, 4, 0, 0, 3, 4, 0])
    bare = _packed(1, _deltas([20, 21]), True) + _packed(8, _deltas([1, 2]), True) + _packed(9, _deltas([1, 2]), True)
    plain = _f(1, _zz(-4)) + _packed(2, [3]) + _packed(3, [4]) + _f(8, _zz(10)) + _f(9, _zz(-10))
    way = _f(1, 5) + _packed(2, [1]) + _packed(3, [2]) + _f(4, _f(1, 3) + _f(2, 60) + _f(3, 4) + _f(5, 6)) + _packed(8, _deltas([3, 10, 3]), True) + _f(99, b"unknown")
    relation = _f(1, 8) + _packed(8, [5, 0]) + _packed(9, _deltas([5, 3]), True) + _packed(10, [1, 0])
    block = _f(1, table) + _f(2, _f(2, dense)) + _f(2, _f(2, bare)) + _f(2, _f(1, plain)) + _f(2, _f(3, way)) + _f(2, _f(4, relation))
    box = _f(1, _zz(-10 * 10**9)) + _f(2, _zz(10 * 10**9)) + _f(3, _zz(5 * 10**9)) + _f(4, _zz(-5 * 10**9))
    head = _f(1, box) + _f(4, b"OsmSchema-V0.6") + _f(4, b"DenseNodes") + _f(16, b"test")
    return _framed(b"OSMHeader", _blob(head, codec)) + _framed(b"Other", b"zzz") + _framed(b"OSMData", _blob(block, codec)) + extra


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("pbf") / "a.pbf"
    p.write_bytes(extract())
    return str(p)


def read(spark, path, entity, **options):
    register(spark)
    r = spark.read.format("osmpbf").option("entity", entity)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


@pytest.mark.parametrize("codec", ["zlib", "raw", "lzma"])
def test_nodes(spark, tmp_path, codec):
    (tmp_path / "x.pbf").write_bytes(extract(codec))
    rows = {r.id: r for r in read(spark, str(tmp_path), "node", info="true").collect()}
    assert set(rows) == {3, 10, 7, 20, 21, -4}
    assert rows[3].lat == pytest.approx(48.137) and rows[10].lon == pytest.approx(180.0) and rows[10].lat == pytest.approx(-90.0)
    assert [tuple(t) for t in rows[3].tags] == [("highway", "residential"), ("name", "Straße")] and rows[10].tags == [] and [tuple(t) for t in rows[7].tags] == [("name", "Straße")]
    assert rows[20].tags == [] and rows[20].info is None and [tuple(t) for t in rows[-4].tags] == [("name", "Straße")]
    assert rows[3].info.version == 2 and rows[3].info.user == "anna" and rows[3].info.timestamp.timestamp() == 100 and rows[10].info.visible is False


def test_ways_and_relations(spark, path):
    w = read(spark, path, "way", info="true").collect()
    assert [(r.id, r.refs, [tuple(t) for t in r.tags], r.info.version) for r in w] == [(5, [3, 10, 3], [("highway", "residential")], 3)]
    r = read(spark, path, "relation", tags="false").collect()
    assert r[0].asDict(True) == {"id": 8, "members": [{"type": 1, "ref": 5, "role": "outer"}, {"type": 0, "ref": 3, "role": ""}]}


def test_header_and_blobs(spark, path):
    h = read(spark, path, "header").first()
    assert (h.min_lat, h.max_lon, h.required, h.program) == (-5.0, 10.0, ["OsmSchema-V0.6", "DenseNodes"], "test")
    b = read(spark, path, "blob").orderBy("start_position").collect()
    assert [(x.type, x.codec) for x in b] == [("OSMHeader", "zlib"), ("Other", "none"), ("OSMData", "zlib")]
    assert read(spark, path, "header", startOffset=str(b[1].start_position)).count() == 0
    assert read(spark, path, "way", startOffset=str(b[2].start_position)).count() == 1
    assert [f.start for f in frames(path)] == [x.start_position for x in b]


def test_errors(spark, tmp_path):
    (tmp_path / "lz4.pbf").write_bytes(extract("lz4"))
    with pytest.raises(Exception, match="lz4"):
        read(spark, str(tmp_path / "lz4.pbf"), "node").count()
    (tmp_path / "cut.pbf").write_bytes(extract()[:-5])
    with pytest.raises(Exception, match="blob of"):
        read(spark, str(tmp_path / "cut.pbf"), "node").count()
    with pytest.raises(Exception, match="none of"):
        read(spark, str(tmp_path / "cut.pbf"), "lake").count()


def test_every_action(spark, path, tmp_path):
    t = tables(spark, path)
    assert t["tags"].count() == 5 and t["nodes"].filter("visible").count() == 5
    for name in ACTIONS:
        run(spark, name, path, str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "ways-file/way_stats")).first().n_ways == 1
    assert spark.read.parquet(str(tmp_path / "merge-rel/relation_bbox")).first().n_resolved == 2
    assert spark.read.parquet(str(tmp_path / "join/leaves")).count() >= 6
    assert spark.read.parquet(str(tmp_path / "join/way_geom")).first().nodes[0].node_id == 3
    with pytest.raises(ValueError, match="none of"):
        run(spark, "paint", path, str(tmp_path))
