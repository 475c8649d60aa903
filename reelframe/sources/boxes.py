"""Bodies of MP4 boxes as values: a grammar of fields, read into a VARIANT column that paths and types are asked of."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import configs
from reelframe.sources.containers import walk_mp4
from reelframe.sources.ranged import ranged, read

#: Entries of a table that a row holds, and characters of rows that are handed on at a time.
PART = 10_000
BATCH = 8 << 20
#: Bytes of a body that have no fields of their own and are still kept, as hex.
RAW = 4096

# Bodies of boxes. A body is fields with commas between them: a kind and a name. Kinds: u and s with bits for whole numbers, f16, f32
# and f2 for 8.8, 16.16 and 2.30, v, w and o for those whose size or sign the version decides, cc for four characters, lang
# for three packed letters, str for a text up to a zero, text and hex for all that is left; skip with bytes; a number in
# front with a question mark is the flag without which a field is missing, and "v1?" stands for a version. "name*count(...)" is a table of as many entries as a field
# says, or up to the end. Full boxes begin with "full".
_FULL = "full"
_TIMES = "full, v creation_time, v modification_time, "
_VISUAL = "skip6, u16 data_reference_index, skip16, u16 width, u16 height, f32 horizresolution, f32 vertresolution, skip4, u16 frame_count, u8 name_length, skip31, u16 depth, skip2"
_AUDIO = "skip6, u16 data_reference_index, u16 sound_version, skip6, u16 channelcount, u16 samplesize, skip4, f32 samplerate"
_TEXT = "full, lang language, str value"
_IDS = "track_ids*(u32 id)"
GRAMMAR = {
    "ftyp": "cc major_brand, u32 minor_version, brands*(cc brand)",
    "styp": "cc major_brand, u32 minor_version, brands*(cc brand)",
    "pdin": "full, entries*(u32 rate, u32 initial_delay)",
    "mvhd": _TIMES + "u32 timescale, v duration, f32 rate, f16 volume, skip10, skip36, skip24, u32 next_track_id",
    "tkhd": _TIMES + "u32 track_id, skip4, v duration, skip8, s16 layer, s16 alternate_group, f16 volume, skip2, skip36, f32 width, f32 height",
    "mdhd": _TIMES + "u32 timescale, v duration, lang language",
    "hdlr": "full, skip4, cc handler_type, skip12, str name",
    "vmhd": "full, u16 graphicsmode, opcolor*3(u16 color)",
    "smhd": "full, f16 balance",
    "hmhd": "full, u16 max_pdu_size, u16 avg_pdu_size, u32 max_bitrate, u32 avg_bitrate",
    "nmhd": _FULL,
    "url ": "full, str location",
    "urn ": "full, str name, str location",
    "dref": "full, u32 count",
    "stsd": "full, u32 count",
    "stts": "full, u32 count, entries*count(u32 sample_count, u32 sample_delta)",
    "ctts": "full, u32 count, entries*count(u32 sample_count, o sample_offset)",
    "cslg": "full, s32 shift, s32 least_delta, s32 greatest_delta, s32 start, s32 end",
    "stsc": "full, u32 count, entries*count(u32 first_chunk, u32 samples_per_chunk, u32 description_index)",
    "stss": "full, u32 count, entries*count(u32 sample)",
    "stps": "full, u32 count, entries*count(u32 sample)",
    "stsh": "full, u32 count, entries*count(u32 shadowed_sample, u32 sync_sample)",
    "stdp": "full, entries*(u16 priority)",
    "sdtp": "full, entries*(u8 dependency)",
    "stsz": "full, u32 sample_size, u32 count, entries*count(u32 size)",
    "stz2": "full, skip3, u8 field_size, u32 count, hex sizes",
    "stco": "full, u32 count, entries*count(u32 offset)",
    "co64": "full, u32 count, entries*count(u64 offset)",
    "padb": "full, u32 count, hex pads",
    "btrt": "u32 buffer_size, u32 max_bitrate, u32 avg_bitrate",
    "elst": "full, u32 count, entries*count(v segment_duration, w media_time, f32 media_rate)",
    "mehd": "full, v fragment_duration",
    "trex": "full, u32 track_id, u32 description_index, u32 sample_duration, u32 sample_size, u32 sample_flags",
    "mfhd": "full, u32 sequence_number",
    "tfhd": "full, u32 track_id, 0x1?u64 base_data_offset, 0x2?u32 description_index, 0x8?u32 sample_duration, 0x10?u32 sample_size, 0x20?u32 sample_flags",
    "tfdt": "full, v base_media_decode_time",
    "trun": "full, u32 count, 0x1?s32 data_offset, 0x4?u32 first_sample_flags, entries*count(0x100?u32 duration, 0x200?u32 size, 0x400?u32 flags, 0x800?o composition_offset)",
    "mfro": "full, u32 size",
    "sidx": "full, u32 reference_id, u32 timescale, v earliest_presentation_time, v first_offset, skip2, u16 count, entries*count(u32 type_and_size, u32 subsegment_duration, u32 sap)",
    "sbgp": "full, cc grouping_type, v1?u32 parameter, u32 count, entries*count(u32 sample_count, u32 group_index)",
    "sgpd": "full, cc grouping_type, v1?u32 default_length, u32 count, hex descriptions",
    "saio": "full, 0x1?cc aux_type, 0x1?u32 parameter, u32 count, entries*count(v offset)",
    "saiz": "full, 0x1?cc aux_type, 0x1?u32 parameter, u8 default_size, u32 count, entries*(u8 size)",
    "pitm": "full, u16 item_id",
    "iods": "full, hex descriptor",
    "ctry": "full, u8 count, hex countries",
    "lang": "full, u8 count, hex languages",
    "ID32": "full, lang language, hex tag",
    "srat": "full, u32 sampling_rate",
    "cprt": _TEXT, "titl": _TEXT, "dscp": _TEXT, "perf": _TEXT, "gnre": _TEXT, "auth": _TEXT,
    "albm": "full, lang language, str value, u8 track",
    "yrrc": "full, u16 year",
    "loci": "full, lang language, str name, u8 role, f32 longitude, f32 latitude, f32 altitude, str body, str notes",
    "colr": "cc colour_type, u16 primaries, u16 transfer, u16 matrix, u8 full_range",
    "pasp": "u32 h_spacing, u32 v_spacing",
    "schm": "full, cc scheme, u32 scheme_version, 0x1?str uri",
    "frma": "cc format",
    "d263": "cc vendor, u8 decoder_version, u8 level, u8 profile",
    "damr": "cc vendor, u8 decoder_version, u16 mode_set, u8 mode_change_period, u8 frames_per_sample",
    "hvcC": "u8 configuration_version, u8 profile, u32 compatibility, skip6, u8 level, u16 min_segmentation, u8 parallelism, u8 chroma_format, u8 luma_depth, u8 chroma_depth, u16 avg_frame_rate, u8 layers_and_length, u8 count, hex arrays",
    "meta": _FULL,
    "data": "u32 data_type, u32 locale, hex value",
    "mean": "full, text value", "name": "full, text value",
    "mhdr": "full, u32 next_item_id",
    "keys": "full, u32 count, hex keys",
    "hint": _IDS, "cdsc": _IDS, "dpnd": _IDS, "ipir": _IDS, "mpod": _IDS, "sync": _IDS, "chap": _IDS,
    **dict.fromkeys(("avc1", "avc2", "hvc1", "hev1", "mp4v", "s263"), _VISUAL),
    **dict.fromkeys(("mp4a", "samr", "alac", "raw ", "twos"), _AUDIO),
}

_DTYPES = {f"{s}{n}": f">{t}{n // 8}" for s, t in (("u", "u"), ("s", "i")) for n in (8, 16, 32, 64)} | {"f16": ">i2", "f32": ">i4", "f2": ">i4", "cc": "V4", "lang": ">u2"}
_SCALES = {"f16": 1 << 8, "f32": 1 << 16, "f2": 1 << 30}


@lru_cache(maxsize=4096)
def _fields(spec: str, version: int, flags: int) -> tuple[tuple, ...]:
    """(kind, name, count, inner) of a body's fields, in a version and with flags."""
    out, depth, start = [], 0, 0
    spec += ","
    for i, c in enumerate(spec):
        depth += (c == "(") - (c == ")")
        if c != "," or depth:
            continue
        word, start = spec[start:i].strip(), i + 1
        if not word or word == _FULL:
            continue
        if "(" in word:
            name, _, count = word[: word.index("(")].partition("*")
            out.append(("table", name, count, _fields(word[word.index("(") + 1 : -1], version, flags)))
            continue
        if "?" in word:
            need, _, word = word.partition("?")
            if not (version >= int(need[1:]) if need[0] == "v" else flags & int(need, 16)):
                continue
        kind, _, name = word.partition(" ")
        kind = {"v": ("u32", "u64")[version == 1], "w": ("s32", "s64")[version == 1], "o": ("u32", "s32")[version > 0]}.get(kind, kind)
        out.append((kind, name, "", ()))
    return tuple(out)


def _dtype(fields: tuple) -> np.dtype:
    return np.dtype([(name or f"_{k}", f"V{kind[4:]}" if kind.startswith("skip") else _DTYPES[kind]) for k, (kind, name, _, _) in enumerate(fields)])


def _values(kind: str, column: np.ndarray) -> list:
    if kind in _SCALES:
        return (column / _SCALES[kind]).tolist()
    if kind == "cc":
        return [bytes(x).decode("latin-1") for x in column]
    if kind == "lang":
        return ["".join(chr(0x60 + (x >> s & 31)) for s in (10, 5, 0)) for x in column.tolist()]
    return column.tolist()


def _entries(fields: tuple, data: bytes) -> list:
    """Entries of a table: values, or objects if they have several fields."""
    if not data:
        return []
    raw = np.frombuffer(data, _dtype(fields))
    columns = [_values(kind, raw[name]) for kind, name, _, _ in fields]
    return columns[0] if len(fields) == 1 else [dict(zip([f[1] for f in fields], row)) for row in zip(*columns)]


def _text(data: bytes) -> str:
    return data.decode("utf-16", "replace") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("utf-8", "replace")


def _upto_zero(data: bytes) -> tuple[int, int]:
    """Bytes of a text and of the zero that ends it, which has two bytes after a mark of UTF-16."""
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return next(((k, 2) for k in range(2, len(data) - 1, 2) if data[k : k + 2] == b"\0\0"), (len(data), 0))
    at = data.find(b"\0")
    return (at, 1) if at >= 0 else (len(data), 0)


def body(name: str, data, at: int, size: int) -> Iterator[dict]:
    """What a box's body says, in parts of up to PART entries of its table; "cut" is true if it ends before its fields do.

    data is bytes, or anything that is sliced like them. Boxes without a grammar have up to RAW bytes as hex.
    """
    end = min(at + size, len(data))
    if name in ("avcC", "esds"):
        found = (configs.avcc if name == "avcC" else configs.esds)(data[at:end])
        plain = lambda v: v.hex() if isinstance(v, bytes) else [plain(x) for x in v] if isinstance(v, list) else v
        yield {k: plain(v) for k, v in found.items()} if found else {"cut": True}
        return
    spec = GRAMMAR.get(name)
    if spec is None:
        yield {"hex": data[at : min(end, at + RAW)].hex()}
        return
    out: dict = {}
    if spec.startswith(_FULL):
        if at + 4 > end:
            yield {"cut": True}
            return
        out = {"version": data[at], "flags": int.from_bytes(data[at + 1 : at + 4], "big")}
        at += 4
    for kind, field, count, inner in _fields(spec, out.get("version", 0), out.get("flags", 0)):
        if kind == "table":
            width = _dtype(inner).itemsize if inner else 0
            fit = (end - at) // width if width else 0
            n = min(fit, int(count) if count.isdigit() else out.get(count, 0)) if count else fit
            if name == "stsz" and out.get("sample_size"):
                n = 0  # all samples are as long as it says
            elif count and not count.isdigit() and width and n < out.get(count, 0):
                out["cut"] = True
            for first in range(0, max(n, 1), PART):
                stop = min(n, first + PART)
                yield {**(out if not first else {}), "first": first, field: _entries(inner, data[at + first * width : at + stop * width])}
            return
        if kind in ("str", "text", "hex"):
            rest = data[at:end]
            size, after = _upto_zero(rest) if kind == "str" else (len(rest), 0)
            out[field] = rest.hex() if kind == "hex" else _text(rest[:size])
            at += size + after
            continue
        width = int(kind[4:]) if kind.startswith("skip") else np.dtype(_DTYPES[kind]).itemsize
        if at + width > end:
            out["cut"] = True
            break
        if not kind.startswith("skip"):
            out[field] = _values(kind, np.frombuffer(data[at : at + width], _DTYPES[kind]))[0]
        at += width
    yield out


_SCHEMA = "path string, node_id long, parent_id long, name string, path_expr string, part int, json string"


def _rows(path: str, data) -> Iterator[tuple]:
    paths: list[str] = []
    for k, (parent, _, name, at, size) in enumerate(walk_mp4(data)):
        paths.append((paths[parent] + "/" if parent >= 0 else "") + name)
        if name in ("mdat", "free", "skip", "wide"):
            continue
        for part, found in enumerate(body(name, data, at, size)):
            yield path, k, parent, name, paths[-1], part, json.dumps(found)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
    names = ["path", "node_id", "parent_id", "name", "path_expr", "part", "json"]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[-1]) + 200
        if size > BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _typed(found: DataFrame) -> DataFrame:
    return found.withColumn("body", F.parse_json("json")).drop("json")


def typed(files: DataFrame) -> DataFrame:
    """path, node_id, parent_id, name, path_expr, part, body (VARIANT): what the boxes of MP4 files (path, content) say.

    Long tables come in parts of PART entries, with the number of the first one. Payload and padding have no rows.
    Null, empty or foreign content has none.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from _batches(_rows(path, content.as_py() or b""))

    return _typed(files.select("path", "content").mapInArrow(run, _SCHEMA))


def typed_by_range(spark: SparkSession, folder: str) -> DataFrame:
    """typed() of the files at a path, of which only the boxes' heads and bodies are read."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                data = ranged(path)
                try:
                    yield from _batches(_rows(path, data))
                finally:
                    data.file.close()

    paths = read(spark, folder).filter("format = 'mp4'").select("path")
    return _typed(paths.mapInArrow(run, _SCHEMA))


def find(found: DataFrame, path_expr: str) -> DataFrame:
    """The boxes at a path from the top, such as moov/trak/mdia/mdhd; of each parent all that have the name."""
    return found.filter(F.col("path_expr") == path_expr)


def value(path: str, kind: str):
    """A typed value of a body as a column; null if it isn't there or isn't of the kind."""
    return F.try_variant_get("body", path, kind)


def entries(found: DataFrame, field: str, kind: str) -> DataFrame:
    """path, node_id, idx and entry: the entries of tables, of all their parts."""
    each = found.select("path", "node_id", value("$.first", "long").alias("first"), F.posexplode(value(f"$.{field}", f"array<{kind}>")).alias("idx", "entry"))
    return each.select("path", "node_id", (F.col("first") + F.col("idx")).alias("idx"), "entry")
