"""H.264 units, in streams with start codes (Annex B) and in samples with lengths: bytes to bytes, and columns.

Emulation bytes stand in a unit wherever its own bytes could be taken for a start code; heads are read without them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.configs import avcc, nal_unit

_START = re.compile(rb"\x00\x00\x01")
#: Units that hold a picture's slices: whole ones, partitions and those of key pictures.
SLICES = range(1, 6)
#: Bytes of a unit that hold what slice() reads of it, with emulation bytes.
HEAD = 32
# Slice types that stand for B slices.
B_SLICES = (1, 6)


def escape(raw: bytes) -> bytes:
    """A unit's bytes with emulation bytes: 3 between two zeros and a byte up to 3, or the end."""
    return re.sub(rb"\x00\x00(?=[\x00-\x03]|\Z)", b"\0\0\3", raw)


def unescape(unit: bytes) -> bytes:
    return unit.replace(b"\0\0\3", b"\0\0")


def from_annexb(data: bytes) -> list[bytes]:
    """The units of a stream with start codes. Zeros before a start code belong to no unit; nor does what comes before the first."""
    ends = [m.span() for m in _START.finditer(data)]
    stops = [a for a, _ in ends[1:]] + [len(data)]
    return [u for (_, at), stop in zip(ends, stops) if (u := data[at:stop].rstrip(b"\0"))]


def to_annexb(units: Iterable[bytes]) -> bytes:
    """Units behind start codes, of which the first one has four bytes."""
    joined = b"".join(b"\0\0\1" + u for u in units)
    return b"\0" + joined if joined else b""


def from_lengths(data: bytes, nal_length: int) -> list[bytes]:
    """The units of a sample with lengths of 1 to 4 bytes. One that is cut off, and what follows it, is none."""
    out, at = [], 0
    while at + nal_length <= len(data):
        size = int.from_bytes(data[at : at + nal_length], "big")
        at += nal_length + size
        if at > len(data):
            break
        if size:
            out.append(data[at - size : at])
    return out


def to_lengths(units: Iterable[bytes], nal_length: int = 4) -> bytes:
    """Units behind their lengths; ValueError if one is too long for them."""
    try:
        return b"".join(len(u).to_bytes(nal_length, "big") + u for u in units)
    except OverflowError:
        raise ValueError(f"a unit is too long for {nal_length} bytes of length") from None


def parameter_sets(config: bytes) -> bytes:
    """The parameter sets of an avcC body as a stream with start codes, which decoders of such streams begin with."""
    found = avcc(config)
    return to_annexb(found["sps"] + found["pps"]) if found else b""


def slice_of(units: Iterable[bytes]) -> dict | None:
    """ref_idc, type, first_mb and slice_type of the first unit that holds slices; None if there is none, or its head is cut off."""
    for unit in units:
        if not unit[0] & 128 and unit[0] & 31 in SLICES:
            return nal_unit(unescape(unit[:HEAD]))
    return None


def _bytes_to_bytes(column: Column, change) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else change(b))

    return run(column)


def annexb_to_lengths(data: Column, nal_length: int = 4) -> Column:
    """A stream with start codes as a sample with lengths; null stays null."""
    return _bytes_to_bytes(data, lambda b: to_lengths(from_annexb(b), nal_length))


def lengths_to_annexb(data: Column, nal_length: int = 4) -> Column:
    """A sample with lengths as a stream with start codes; null stays null."""
    return _bytes_to_bytes(data, lambda b: to_annexb(from_lengths(b, nal_length)))


def slice_head(data: Column, nal_length: Column) -> Column:
    """A struct of slice_of() for samples with lengths of their tracks."""

    @F.pandas_udf("ref_idc int, type int, first_mb long, slice_type long")
    def run(data: pd.Series, nal_length: pd.Series) -> pd.DataFrame:
        none = {"ref_idc": None, "type": None, "first_mb": None, "slice_type": None}
        found = [slice_of(from_lengths(b, int(n))) if b and n in (1, 2, 3, 4) else None for b, n in zip(data, nal_length)]
        return pd.DataFrame([f or none for f in found], columns=list(none)).astype("Int64")

    return run(data, nal_length)


def droppable(codec: Column, data: Column, nal_length: Column, sync: Column) -> Column:
    """Which packets before the target of a seek need not be decoded: of H.264, B slices that nothing refers to, by the
    packet's own bytes; of other codecs, all but sync packets. Packets of which no slice can be read are needed."""
    head = slice_head(F.when(codec == "h264", data), nal_length)
    unused = (head["type"] == 1) & (head["ref_idc"] == 0) & head["slice_type"].isin(*B_SLICES)
    return F.when(codec == "h264", F.coalesce(unused, F.lit(False))).otherwise(~sync)
