import random

import pytest
from pyspark.sql import functions as F

from reelframe.functions import nal
from reelframe.sources import packetizer


def slow_escape(raw):
    out, zeros = bytearray(), 0
    for b in raw:
        if zeros == 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out) + (b"\3" if zeros == 2 else b"")


def units(seed, n=20):
    r = random.Random(seed)
    return [nal.escape(bytes([0x65, *(r.choice([0, 0, 0, 1, 2, 3, 4, 255]) for _ in range(r.randrange(60))), 0x80])) for _ in range(n)]


def test_emulation_bytes():
    r = random.Random(3)
    for _ in range(2000):
        raw = bytes(r.choice([0, 0, 0, 1, 3, 4]) for _ in range(r.randrange(12)))
        assert nal.escape(raw) == slow_escape(raw)
        if not raw.endswith(b"\0") or raw.endswith(b"\0\0"):
            assert nal.unescape(nal.escape(raw)) == raw
        assert b"\0\0\1" not in nal.escape(raw) and b"\0\0\0" not in nal.escape(raw)


def test_round_trip_and_damage():
    for seed in range(50):
        some = units(seed)
        assert nal.from_annexb(nal.to_annexb(some)) == some == nal.from_lengths(nal.to_lengths(some, 2), 2)
    assert nal.from_annexb(b"junk\0\0\0\1\x65\x01\0\0\0\0\1\0\0\1\x41") == [b"\x65\x01", b"\x41"]
    assert nal.from_lengths(b"\0\2ab\0\0\0\5cd", 2) == [b"ab"] and nal.from_annexb(b"") == [] and nal.to_annexb([]) == b""
    with pytest.raises(ValueError, match="too long"):
        nal.to_lengths([b"x" * 256], 1)
    assert nal.parameter_sets(b"nothing") == b""


def test_what_a_seek_needs(spark):
    one = lambda *u: nal.to_lengths(u, 2)
    rows = [
        ("b", "h264", one(b"\x01\xa0"), 2, False, True), ("b6", "h264", one(b"\x01\x9c"), 2, False, True), ("used", "h264", one(b"\x21\xa0"), 2, False, False), ("p", "h264", one(b"\x01\xc0"), 2, False, False),
        ("after", "h264", one(b"\x09\x10", b"\x06\x80", b"\x01\xa0"), 2, False, True), ("none", "h264", one(b"\x06\x80"), 2, False, False), ("null", "h264", None, 2, False, False), ("cut", "h264", b"\0\x09\x01", 2, False, False),
        ("length", "h264", one(b"\x01\xa0"), None, False, False), ("sync", "aac", None, None, True, False), ("other", "aac", b"\0\2\x01\xa0", 2, False, True),
        ("escaped", "h264", one(nal.escape(b"\x01\x00\x00\x01\x01\x00\x00\x10")), 2, False, False),
    ]
    df = spark.createDataFrame(rows, "name string, codec string, data binary, n int, sync boolean, want boolean")
    got = df.select("name", "want", nal.droppable(F.col("codec"), F.col("data"), F.col("n"), F.col("sync")).alias("got")).collect()
    assert {r["name"]: r["got"] for r in got} == {r["name"]: r["want"] for r in got}


def test_units_of_files_by_blocks(spark, tmp_path):
    made = {f"{k}.264": nal.to_annexb(units(k, 60)) + b"\0" * k for k in range(3)} | {"none.264": b"\0" * 50, "empty.264": b""}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = packetizer.annexb_units(spark, str(tmp_path), 97).orderBy("path", "unit_idx").collect()
    got = {}
    for r in rows:
        own = got.setdefault(r["path"].rpartition("/")[2], [])
        assert r["unit_idx"] == len(own) and made[r["path"].rpartition("/")[2]][r["offset"] :].startswith(bytes(r["data"]))
        own.append(bytes(r["data"]))
    assert got == {k: nal.from_annexb(v) for k, v in made.items() if nal.from_annexb(v)}
