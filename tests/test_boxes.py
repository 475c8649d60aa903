import json
import struct

import pytest
from pyspark.sql import functions as F

from reelframe.functions.configs import compose_avcc, compose_esds
from reelframe.sources import boxes, compose, containers
from reelframe.sources.compose import box


def body(name, data):
    return list(boxes.body(name, data, 0, len(data)))


def pack(fmt, *values):
    return struct.pack(">" + fmt, *values)


LANG = pack("H", (5 << 10) | (14 << 5) | 7)  # eng
BODIES = [
    ("ftyp", b"isom" + pack("I", 512) + b"mp41qt  ", {"major_brand": "isom", "minor_version": 512, "first": 0, "brands": ["mp41", "qt  "]}),
    ("mvhd", pack("IIIIIIH", 0, 1, 2, 90000, 5, 1 << 16, 128) + bytes(70) + pack("I", 3), {"version": 0, "flags": 0, "creation_time": 1, "modification_time": 2, "timescale": 90000, "duration": 5, "rate": 1.0, "volume": 0.5, "next_track_id": 3}),
    ("mdhd", pack("IQQIQ", 1 << 24, 1, 2, 48000, 1 << 40) + LANG, {"version": 1, "flags": 0, "creation_time": 1, "modification_time": 2, "timescale": 48000, "duration": 1 << 40, "language": "eng"}),
    ("tkhd", pack("IIIIII", 7, 1, 2, 9, 0, 50) + bytes(8) + pack("hhHH", -1, 2, 256, 0) + bytes(36) + pack("II", 640 << 16, 480 << 16), {"version": 0, "flags": 7, "creation_time": 1, "modification_time": 2, "track_id": 9, "duration": 50, "layer": -1, "alternate_group": 2, "volume": 1.0, "width": 640.0, "height": 480.0}),
    ("hdlr", bytes(8) + b"vide" + bytes(12) + b"Name\0more", {"version": 0, "flags": 0, "handler_type": "vide", "name": "Name"}),
    ("vmhd", pack("I4H", 1, 0, 1, 2, 3), {"version": 0, "flags": 1, "graphicsmode": 0, "first": 0, "opcolor": [1, 2, 3]}),
    ("urn ", bytes(4) + b"a\0b\0", {"version": 0, "flags": 0, "name": "a", "location": "b"}),
    ("stts", pack("4I", 0, 1, 3, 40), {"version": 0, "flags": 0, "count": 1, "first": 0, "entries": [{"sample_count": 3, "sample_delta": 40}]}),
    ("ctts", pack("3Ii", 1 << 24, 1, 3, -40), {"version": 1, "flags": 0, "count": 1, "first": 0, "entries": [{"sample_count": 3, "sample_offset": -40}]}),
    ("stsz", pack("3I", 0, 8, 900), {"version": 0, "flags": 0, "sample_size": 8, "count": 900, "first": 0, "entries": []}),
    ("stss", pack("3I", 0, 5, 1), {"version": 0, "flags": 0, "count": 5, "cut": True, "first": 0, "entries": [1]}),
    ("co64", pack("IIQ", 0, 1, 1 << 40), {"version": 0, "flags": 0, "count": 1, "first": 0, "entries": [1 << 40]}),
    ("elst", pack("IIIiI", 0, 1, 5, -1, 1 << 16), {"version": 0, "flags": 0, "count": 1, "first": 0, "entries": [{"segment_duration": 5, "media_time": -1, "media_rate": 1.0}]}),
    ("tfhd", pack("III", 0x28, 3, 40) + pack("I", 9), {"version": 0, "flags": 0x28, "track_id": 3, "sample_duration": 40, "sample_flags": 9}),
    ("trun", pack("III", 0x301, 2, 100) + pack("4I", 1, 2, 3, 4), {"version": 0, "flags": 0x301, "count": 2, "data_offset": 100, "first": 0, "entries": [{"duration": 1, "size": 2}, {"duration": 3, "size": 4}]}),
    ("trun", pack("II", 0, 2), {"version": 0, "flags": 0, "count": 2, "first": 0, "entries": []}),
    ("sbgp", pack("I4sIII", 0, b"roll", 1, 5, 1), {"version": 0, "flags": 0, "grouping_type": "roll", "count": 1, "first": 0, "entries": [{"sample_count": 5, "group_index": 1}]}),
    ("loci", bytes(4) + LANG + b"x\0" + pack("B3i", 1, 3 << 15, -1 << 16, 0) + b"earth\0n\0", {"version": 0, "flags": 0, "language": "eng", "name": "x", "role": 1, "longitude": 1.5, "latitude": -1.0, "altitude": 0.0, "body": "earth", "notes": "n"}),
    ("titl", bytes(4) + LANG + b"\xfe\xff\0T\0\0", {"version": 0, "flags": 0, "language": "eng", "value": "T"}),
    ("mp4a", pack("6xH8xHH4xI", 1, 2, 16, 44100 << 16 & 0xFFFFFFFF), None),
    ("avc1", pack("6xH16xHHII4xHB31xH2x", 1, 640, 480, 72 << 16, 72 << 16, 1, 0, 24), {"data_reference_index": 1, "width": 640, "height": 480, "horizresolution": 72.0, "vertresolution": 72.0, "frame_count": 1, "name_length": 0, "depth": 24}),
    ("avcC", compose_avcc([b"\x67\x42\x00\x1e"], [b"\x68\xce"]), {"profile": 0x42, "level": 0x1E, "nal_length": 4, "sps": ["6742001e"], "pps": ["68ce"]}),
    ("data", pack("II", 1, 0) + b"hi", {"data_type": 1, "locale": 0, "value": "6869"}),
    ("chap", pack("II", 2, 3), {"first": 0, "track_ids": [2, 3]}),
    ("stts", b"\0\0", {"cut": True}),
    ("mdhd", pack("II", 0, 1), {"version": 0, "flags": 0, "creation_time": 1, "cut": True}),
    ("????", b"\1\2", {"hex": "0102"}),
]


@pytest.mark.parametrize("k", range(len(BODIES)), ids=lambda k: f"{BODIES[k][0]}-{k}")
def test_bodies(k):
    name, data, want = BODIES[k]
    if want:
        assert body(name, data) == [want]


def test_all_grammars_take_any_bytes():
    assert len(boxes.GRAMMAR) > 60
    for name in [*boxes.GRAMMAR, "avcC", "esds"]:
        for data in (b"", b"\0", bytes(12), bytes(200), b"\xff" * 200, bytes(range(200)), bytes([1]) + bytes(300)):
            assert all(json.loads(json.dumps(r)) == r for r in body(name, data))
    assert body("esds", compose_esds(0x40, b"\x12\x10"))[0]["object_type"] == 0x40


def test_long_tables_come_in_parts(monkeypatch):
    monkeypatch.setattr(boxes, "PART", 3)
    got = body("stsz", pack("3I", 0, 0, 7) + pack("7I", *range(7)))
    assert [r["first"] for r in got] == [0, 3, 6] and sum((r["entries"] for r in got), []) == list(range(7)) and "count" not in got[1]


def test_values_of_files(spark, tmp_path):
    items = box(b"meta", bytes(4) + box(b"ilst", box(b"\xa9nam", box(b"data", pack("II", 1, 0) + b"title")) + box(b"----", box(b"mean", bytes(4) + b"com") + box(b"name", bytes(4) + b"tool"))))
    made = {"a.mp4": compose.mp4([b"x" * k for k in range(1, 21)]) + box(b"udta", items + box(b"gnre", bytes(4) + LANG + b"Rock\0")), "e.mp4": b"", "t.mp4": b"text"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(k, v, 1) for k, v in made.items()] + [("null", None, 2)], "path string, content binary, body int")
    found = boxes.typed(files)
    shown = lambda df: sorted(tuple(r) for r in df.select("node_id", "name", "path_expr", "part", F.to_json("body")).collect())
    assert shown(found) == shown(boxes.typed_by_range(spark, str(tmp_path)))
    assert {r[2] for r in shown(found)} == {r["path_expr"] for r in containers.elements(files, "mp4").collect()} - {"mdat"}
    one = lambda path, v, kind="string": [r[0] for r in boxes.find(found, path).select(boxes.value(v, kind)).collect()]
    assert one("moov/trak/mdia/mdhd", "$.timescale", "long") == [1000] and one("moov/trak/mdia/hdlr", "$.nothing") == [None]
    assert one("udta/meta/ilst/\xa9nam/data", "$.value") == [b"title".hex()] and one("udta/meta/ilst/----/mean", "$.value") == ["com"] and one("udta/gnre", "$.value") == ["Rock"]
    sizes = boxes.entries(boxes.find(found, "moov/trak/mdia/minf/stbl/stsz"), "entries", "long").orderBy("idx").collect()
    assert [(r["idx"], r["entry"]) for r in sizes] == [(k, k + 1) for k in range(20)]
