import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.sources.pbf import wire


def test_fixed_point_cuts_towards_zero(spark):
    df = spark.createDataFrame([(48.137, -48.137), (180.0, -180.0), (0.0, -0.0)], "a double, b double").select(geo.to_fixed(F.col("a")).alias("a"), geo.to_fixed(F.col("b")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(574296833 if int(48.137 / 180 * 2147483647) == 574296833 else int(48.137 / 180 * 2147483647), -int(48.137 / 180 * 2147483647)), (2147483647, -2147483647), (0, 0)]


def test_impossible_positions(spark):
    rows = [(None, 1.0), (1.0, None), (float("nan"), 1.0), (91.0, 0.0), (0.0, -180.5), (90.0, 180.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    assert [r[0] for r in df.select(geo.valid(F.col("lat"), F.col("lon"))).collect()] == [False] * 5 + [True] * 2


def test_morton_by_bits(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(-(2**31), 2**31), rng.randrange(-(2**31), 2**31)) for _ in range(200)] + [(0, 0), (-1, -1), (2**31 - 1, -(2**31))]
    got = [r[0] for r in spark.createDataFrame(rows, "lat int, lon int").select(geo.morton(F.col("lat"), F.col("lon"))).collect()]
    for (lat, lon), m in zip(rows, got):
        want = sum(((lon >> i) & 1) << (2 * i) | ((lat >> i) & 1) << (2 * i + 1) for i in range(32))
        assert m & (2**64 - 1) == want


def test_unsigned_order(spark):
    rows = [(-1,), (0,), (5,), (-(2**63),), (2**63 - 1,)]
    got = [r[0] for r in spark.createDataFrame(rows, "m bigint").orderBy(geo.unsigned_order(F.col("m"))).collect()]
    assert got == [0, 5, 2**63 - 1, -(2**63), -1]


def test_codecs(spark):
    values = [10, 15, 7, 12, 1, 0, -1, 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", geo.zigzag(F.col("v")).alias("z"), geo.unzigzag(geo.zigzag(F.col("v"))).alias("b"))
    assert all(r.v == r.b for r in df.collect())
    lengths = spark.createDataFrame([(v,) for v in (0, 1, 127, 128, 16384, -1, 2**63 - 1)], "v bigint").select(geo.varint_length(F.col("v"))).collect()
    assert [r[0] for r in lengths] == [1, 1, 1, 2, 3, 10, 9]


def test_refs(spark):
    r = spark.createDataFrame([(2, 12345678901)], "k int, id bigint").select(geo.pack_ref(F.col("k"), F.col("id")).alias("r")).select(geo.unpack_kind(F.col("r")), geo.unpack_id(F.col("r"))).first()
    assert tuple(r) == (2, 12345678901)


def _varint(v):
    v &= 2**64 - 1
    out = bytearray()
    while True:
        out.append(v & 0x7F | (0x80 if v > 0x7F else 0))
        v >>= 7
        if not v:
            return bytes(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_packed_round_trip(values):
    data = b"".join(_varint(v) for v in values)
    assert wire.packed_signed(data).tolist() == values
    zz = b"".join(_varint((v << 1) ^ (v >> 63)) for v in values)
    assert wire.packed_zigzag(zz).tolist() == values
    at, out = 0, []
    while at < len(data):
        v, at = wire.varint(data, at)
        out.append(wire.signed(v))
    assert out == values


def test_wire_vectors():
    assert list(wire.fields(bytes([0x08, 0x96, 0x01]))) == [(1, 0, 150)]
    assert wire.message(bytes.fromhex("120774657374696e67"), {2: ("s", "string")}) == {"s": "testing"}
