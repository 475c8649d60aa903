"""Containers as trees of elements: RIFF chunks, MP4 boxes, EBML elements and JPEG segments.

A walker yields (parent index, depth, name, offset of the body, size of the body) in file order and stops quietly where a
file is cut off. elements() runs one over a DataFrame of files; everything beyond the tree is joins and expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Node = tuple[int, int, str, int, int]
#: Rows of a file that are handed on at a time.
ROWS = 50_000

# MP4 boxes that hold boxes, and what comes before those.
MP4_PARENTS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "dinf": 0, "edts": 0, "udta": 0, "mvex": 0, "moof": 0, "traf": 0, "meta": 4, "stsd": 8, "dref": 8, "ilst": 0, "avc1": 78, "avc2": 78, "hvc1": 78, "hev1": 78, "mp4v": 78, "s263": 78, "mp4a": 28, "samr": 28, "alac": 28, "raw ": 28, "twos": 28, "tref": 0, "wave": 0, "sinf": 0, "schi": 0}
# Items of an item list; elsewhere boxes of these names hold no others.
MP4_ITEMS = {"\xa9nam", "\xa9too", "\xa9alb", "\xa9ART", "\xa9cmt", "\xa9gen", "\xa9wrt", "\xa9day", "gnre", "trkn", "disk", "cpil", "tmpo", "pgap", "covr", "aART", "----"}
# Names of EBML elements; those of EBML_PARENTS hold others.
EBML_NAMES = {
    0x1A45DFA3: "EBML", 0x4282: "DocType", 0x18538067: "Segment", 0x1549A966: "Info", 0x2AD7B1: "TimecodeScale", 0x4489: "Duration",
    0x114D9B74: "SeekHead", 0x4DBB: "Seek", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0xD7: "TrackNumber", 0x83: "TrackType", 0x86: "CodecID",
    0x63A2: "CodecPrivate", 0x1F43B675: "Cluster", 0xE7: "Timecode", 0xA3: "SimpleBlock", 0xA0: "BlockGroup", 0xA1: "Block", 0x9B: "BlockDuration",
    0x1C53BB6B: "Cues", 0xBB: "CuePoint", 0xB3: "CueTime", 0xB7: "CueTrackPositions", 0xF7: "CueTrack", 0xF1: "CueClusterPosition",
    0x1254C367: "Tags", 0x1043A770: "Chapters", 0x1941A469: "Attachments", 0xE0: "Video", 0xE1: "Audio", 0xEC: "Void", 0xBF: "CRC32",
    0x4286: "EBMLVersion", 0x42F7: "EBMLReadVersion", 0x42F2: "EBMLMaxIDLength", 0x42F3: "EBMLMaxSizeLength", 0x4287: "DocTypeVersion", 0x4285: "DocTypeReadVersion",
    0x53AB: "SeekID", 0x53AC: "SeekPosition", 0x73A4: "SegmentUID", 0x7BA9: "Title", 0x4D80: "MuxingApp", 0x5741: "WritingApp", 0x4461: "DateUTC",
    0x73C5: "TrackUID", 0xB9: "FlagEnabled", 0x88: "FlagDefault", 0x55AA: "FlagForced", 0x9C: "FlagLacing", 0x23E383: "DefaultDuration", 0x23314F: "TrackTimecodeScale",
    0x536E: "Name", 0x22B59C: "Language", 0x258688: "CodecName", 0x56AA: "CodecDelay", 0x56BB: "SeekPreRoll", 0xB0: "PixelWidth", 0xBA: "PixelHeight", 0x54B0: "DisplayWidth", 0x54BA: "DisplayHeight",
    0xB5: "SamplingFrequency", 0x9F: "Channels", 0x6264: "BitDepth", 0x6D80: "ContentEncodings", 0x6240: "ContentEncoding", 0x5031: "ContentEncodingOrder",
    0x5032: "ContentEncodingScope", 0x5033: "ContentEncodingType", 0x5034: "ContentCompression", 0x4254: "ContentCompAlgo", 0x4255: "ContentCompSettings",
    0xA7: "Position", 0xAB: "PrevSize", 0xFB: "ReferenceBlock", 0x75A2: "DiscardPadding", 0x5378: "CueBlockNumber", 0xF0: "CueRelativePosition",
    0x7373: "Tag", 0x63C0: "Targets", 0x67C8: "SimpleTag", 0x45A3: "TagName", 0x4487: "TagString",
}
EBML_PARENTS = {
    "EBML", "Segment", "Info", "SeekHead", "Seek", "Tracks", "TrackEntry", "Cluster", "BlockGroup", "Cues", "CuePoint", "CueTrackPositions", "Tags", "Tag", "Targets", "SimpleTag",
    "Video", "Audio", "ContentEncodings", "ContentEncoding", "ContentCompression",
}
# Levels of the elements that elements of unknown size can't hold; all others are deeper.
EBML_LEVELS = {"EBML": 0, "Segment": 0, **dict.fromkeys(("SeekHead", "Info", "Tracks", "Cluster", "Cues", "Chapters", "Attachments", "Tags"), 1)}
# Names of JPEG segments.
JPEG_NAMES = {0xD8: "SOI", 0xD9: "EOI", 0xE0: "APP0", 0xE1: "APP1", 0xC0: "SOF0", 0xC2: "SOF2", 0xC4: "DHT", 0xDB: "DQT", 0xDD: "DRI", 0xDA: "SOS", 0xFE: "COM"}


def _nested(end: int, step: Callable[[int, int], tuple[str, int, int, int | None, int] | None]) -> Iterator[Node]:
    """Walk a tree. step(at, end) gives (name, body, body's end, where children start or None, where the next one starts), or
    None if there is nothing more to read there."""
    stack, count = [(0, end, -1)], 0
    while stack:
        at, stop, parent = stack.pop()
        if at >= stop or not (found := step(at, stop)):
            continue
        name, body, body_end, inner, after = found
        body_end = min(body_end, stop)
        yield parent, len(stack), name, body, body_end - body
        stack.append((after, stop, parent))
        if inner is not None:
            stack.append((inner, body_end, count))
        count += 1


def _depths(nodes: Iterator[Node]) -> Iterator[Node]:
    depth = []
    for parent, _, name, body, size in nodes:
        depth.append(0 if parent < 0 else depth[parent] + 1)
        yield parent, depth[-1], name, body, size


def walk_riff(data: bytes) -> Iterator[Node]:
    def step(at: int, end: int):
        if at + 8 > end:
            return None
        tag, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
        inner = at + 12 if tag in ("RIFF", "LIST") else None
        return tag, at + 8, at + 8 + size, inner, at + 8 + size + (size & 1)

    return _depths(_nested(len(data), step))


def walk_mp4(data: bytes) -> Iterator[Node]:
    def step(at: int, end: int):
        if at + 8 > end:
            return None
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        if size == 0:
            size = end - at
        if size < head:
            return None
        name = tag.decode("latin-1")
        skip = MP4_PARENTS.get(name)
        if name == "meta" and data[at + head + 4 : at + head + 8] == b"hdlr":
            skip = 0  # as QuickTime writes it
        if name in MP4_ITEMS and data[at + head + 4 : at + head + 8] in (b"data", b"mean"):
            skip = 0
        return name, at + head, at + size, None if skip is None else at + head + skip, at + size

    return _depths(_nested(len(data), step))


def walk_ebml(data: bytes, opened: set[str] = EBML_PARENTS) -> Iterator[Node]:
    """Elements of the names to open are walked into. An element of unknown size ends where one of its level or above starts, or what it is in ends."""

    def head(at: int, end: int):
        """(name, body, size or None if it is unknown) of the element at a place."""
        if at >= end or not data[at]:
            return None
        n = 9 - data[at].bit_length()
        code, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at >= end or not data[at]:
            return None
        n = 9 - data[at].bit_length()
        size = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
        return EBML_NAMES.get(code, f"0x{code:X}"), at + n, None if size == (1 << 7 * n) - 1 else size

    def open_end(name: str, at: int, end: int) -> int:
        level = EBML_LEVELS.get(name, 2)
        while at < end and (found := head(at, end)) and EBML_LEVELS.get(found[0], 2) > level:
            inner, body, size = found
            at = body + size if size is not None else open_end(inner, body, end)
        return min(at, end) if at < end and head(at, end) else end

    def step(at: int, end: int):
        if not (found := head(at, end)):
            return None
        name, body, size = found
        stop = open_end(name, body, end) if size is None else body + size
        return name, body, stop, body if name in opened else None, stop

    return _depths(_nested(len(data), step))


def walk_jpeg(data: bytes, coded: bool = True) -> Iterator[Node]:
    """Up to the end, or up to the coded data."""
    at = 0
    while at + 2 <= len(data) and data[at] == 0xFF:
        code = data[at + 1]
        name = JPEG_NAMES.get(code, f"0x{code:X}")
        if code in (0xD8, 0xD9):
            yield -1, 0, name, at + 2, 0
            at += 2
            continue
        if at + 4 > len(data):
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big") - 2
        yield -1, 0, name, at + 4, min(size, len(data) - at - 4)
        at += 4 + size
        if code == 0xDA and not coded:
            return
        if code == 0xDA:  # coded data: up to a marker that is not a restart
            while at + 1 < len(data) and not (data[at] == 0xFF and data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7):
                at += 1


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def parsed(files: DataFrame, rows: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """path and the columns of a schema (DDL): what rows(content) yields for each of files (path, content)."""
    fields = StructType.fromDDL("path string, " + schema).fields
    names, kinds = [f.name for f in fields], [_ARROW[f.dataType.simpleString()] for f in fields]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                each = rows(content.as_py() or b"")
                while found := [(path, *r) for r in islice(each, ROWS)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, " + schema)


WALKERS: dict[str, Callable[[bytes], Iterator[Node]]] = {"riff": walk_riff, "mp4": walk_mp4, "ebml": walk_ebml, "jpeg": walk_jpeg}


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file: Spark's own reader, so files can be in any store that it knows."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def elements(files: DataFrame, kind: str) -> DataFrame:
    """The elements of files (path, content) of a kind of WALKERS, with node_id, parent_id (-1 at the top), depth, name,
    path_expr, offset and size. Empty or foreign content has none."""
    walk = WALKERS[kind]

    def rows(content: bytes) -> Iterator[tuple]:
        paths: list[str] = []
        for k, (parent, depth, name, offset, size) in enumerate(walk(content)):
            paths.append((paths[parent] + "/" if parent >= 0 else "") + name)
            yield k, parent, depth, name, paths[-1], offset, size

    return parsed(files, rows, "node_id long, parent_id long, depth int, name string, path_expr string, offset long, size long")


def number(content, at, size: int, little: bool = False):
    """An unsigned number of `size` bytes at an offset (from 0) of binary content, as a column."""
    part = F.call_function("substring", content, (at + 1).cast("int"), F.lit(size))
    digits = F.hex(part)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def dump(found: DataFrame) -> DataFrame:
    """path, node_id, line: the trees, indented."""
    return found.select("path", "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name"), F.lit(" "), F.col("size")).alias("line"))
