"""Column functions on coordinates, Z-order codes, packed references and variable-length integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: 180 degrees in fixed point, for both axes.
FULL = 2147483647


def valid(lat: Column, lon: Column) -> Column:
    """Whether a position can be given in fixed point: null, not-a-number and impossible coordinates can't."""
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def to_fixed(degrees: Column) -> Column:
    """Degrees to fixed point, cut towards zero; null where it doesn't fit."""
    return (degrees / 180.0 * float(FULL)).try_cast("int")


def to_degrees(fixed: Column) -> Column:
    return fixed * 180.0 / float(FULL)


def _spread(v: Column) -> Column:
    """The low 32 bits of a bigint moved to its even bits."""
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(keep))
    return v


def morton(lat: Column, lon: Column) -> Column:
    """Z-order code of two fixed-point coordinates: bits of ``lon`` in the even places, of ``lat`` in the odd ones."""
    low = lambda c: _spread(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    return low(lon).bitwiseOR(F.shiftleft(low(lat), 1))


def unsigned_order(code: Column) -> Column:
    """A bigint whose signed order is the unsigned order of ``code``."""
    return code.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))


def pack_ref(kind: Column, id: Column) -> Column:  # noqa: A002
    return F.shiftleft(id.cast("bigint"), 2).bitwiseOR(kind.cast("bigint"))


def unpack_kind(ref: Column) -> Column:
    return ref.bitwiseAND(F.lit(3)).cast("int")


def unpack_id(ref: Column) -> Column:
    return F.shiftright(ref, 2)


def zigzag(v: Column) -> Column:
    v = v.cast("bigint")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def varint_length(v: Column) -> Column:
    """Bytes of a 64-bit value in groups of seven bits: 1 for 0 to 127, ten for negative ones."""
    v = v.cast("bigint")
    out = F.when(v < 0, 10)
    for n in range(1, 9):
        out = out.when(v < (1 << (7 * n)), n)
    return out.otherwise(9)


def heat_bin(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of a fixed-point position on the 16384 x 32768 heat map."""
    return F.shiftright(lat.cast("bigint") + FULL, 18), F.shiftright(lon.cast("bigint") + FULL, 17)
