"""Protobuf wire format over memory views, with packed arrays decoded by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


class WireError(ValueError):
    pass


def varint(buf, at: int) -> tuple[int, int]:
    """(value, next place) of an unsigned varint of up to ten bytes."""
    out = shift = 0
    while True:
        if at >= len(buf):
            raise WireError("varint runs over the end")
        b = buf[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift >= 70:
            raise WireError("varint of more than ten bytes")


def fields(buf) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field of a message; length-delimited values are views."""
    buf = memoryview(buf)
    at = 0
    while at < len(buf):
        tag, at = varint(buf, at)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, at = varint(buf, at)
        elif kind == BYTES:
            size, at = varint(buf, at)
            value, at = buf[at : at + size], at + size
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            value, at = buf[at : at + size], at + size
        else:
            raise WireError(f"wire type {kind} isn't supported")
        if at > len(buf):
            raise WireError("field runs over the end")
        yield number, kind, value


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def unzigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def packed(buf) -> np.ndarray:
    """The varints of a packed field, unsigned."""
    raw = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise WireError("packed field runs over the end")
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    if sizes.max() > 10:
        raise WireError("varint of more than ten bytes")
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(sizes.max())):
        on = sizes > k
        out[on] |= (raw[starts[on] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out


def packed_signed(buf) -> np.ndarray:
    """Packed int32 / int64."""
    return packed(buf).view(np.int64)


def packed_zigzag(buf) -> np.ndarray:
    """Packed sint32 / sint64."""
    v = packed(buf)
    return (v >> np.uint64(1)).view(np.int64) ^ -((v & np.uint64(1)).view(np.int64))


def message(buf, spec: dict[int, tuple[str, str]]) -> dict[str, object]:
    """A message by a table {number: (name, kind)}; unknown fields are skipped.

    Kinds: int, uint, sint, bool, string, bytes; with [] repeated; ints[] and sints[] are packed or not.
    """
    out: dict[str, object] = {name: [] for name, kind in spec.values() if kind.endswith("[]")}
    for number, wire, value in fields(buf):
        if number not in spec:
            continue
        name, kind = spec[number]
        base = kind.removesuffix("[]")
        if base in ("int", "uint", "sint", "bool"):
            if wire == BYTES:
                got = (packed_zigzag(value) if base == "sint" else packed_signed(value)).tolist()
            else:
                got = [unzigzag(value) if base == "sint" else bool(value) if base == "bool" else signed(value) if base == "int" else value]
        elif base == "string":
            got = [bytes(value).decode("utf-8")]
        else:
            got = [value]
        if kind.endswith("[]"):
            out[name] += got
        elif got:
            out[name] = got[-1]
    return out
