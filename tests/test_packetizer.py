import random
import struct

import pytest

from reelframe.functions.configs import mpeg_frame
from reelframe.sources import compose, media, packetizer, ranged


def plain(data):
    """(place, length) of a stream's frames, read from its start to its end."""
    word = lambda at: struct.unpack_from(">I", data, at)[0] if at + 4 <= len(data) else 0
    kind, at, out = None, 0, []
    while at + 4 <= len(data):
        found = mpeg_frame(word(at))
        if found and kind is None and mpeg_frame(word(at + found["length"])) and not (word(at) ^ word(at + found["length"])) & media.SAME_STREAM:
            kind = word(at) & media.SAME_STREAM
        if found and kind is not None and word(at) & media.SAME_STREAM == kind and at + found["length"] <= len(data):
            out.append((at, found["length"]))
            at += found["length"]
        else:
            at += 1
    return out


def hard(seed, n=9000):
    """A stream with junk, headers within frames that look like the stream's own, and some of another kind."""
    r = random.Random(seed)
    frames = bytearray(compose.mp3(bytes(r.randrange(255) for _ in range(n))))
    for _ in range(12):
        at = r.randrange(600, len(frames) - 4)
        frames[at : at + 4] = struct.pack(">I", r.choice([0xFFFB9000, 0xFFFB9200, 0xFFFB9040, 0xFFF3A000]))
    at = r.randrange(600, len(frames))
    return b"junk\xff\xfb" * r.randrange(3) + bytes(frames[:at]) + b"\xff\xff\xfb" * r.randrange(200) + bytes(frames[at : len(frames) - r.randrange(300)])


def cut(data, sizes):
    at, out = 0, []
    for k, n in enumerate(sizes):
        out.append((k, data[at : at + n]))
        at += n
    return [*out, (len(out), data[at:])]


def found(df):
    out = {}
    for r in df.orderBy("path", "frame_idx").collect():
        rows = out.setdefault(r["path"], [])
        assert r["frame_idx"] == len(rows) and r["pts"] == 1152 * len(rows)
        rows.append((r["offset"], r["frame_length"]))
    return out


@pytest.mark.parametrize("block", [700, 5000, packetizer.BLOCK])
def test_streams_cut_anywhere(spark, block):
    r, rows, want = random.Random(block), [], {}
    for seed in range(12):
        data, path = hard(seed), f"s{seed}"
        want[path] = plain(data)
        rows += [(path, k, d, "x") for k, d in cut(data, [r.choice([0, 1, 2, 3, 50, 417, 3000]) for _ in range(30)])]
    rows += [("empty", 0, b"", "x"), ("null", 0, None, "x"), ("one", 0, compose.mp3(b"x", 1), "x"), ("text", 0, b"\xff" * 900, "x")]
    pieces = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "path string, seq int, data binary, start string")
    assert found(packetizer.packetize(pieces, block)) == {k: v for k, v in want.items() if v}
    assert all(len(v) > 10 for v in want.values())
    assert found(packetizer.packetize(pieces.limit(0), block)) == {}


def test_cut_at_every_place(spark):
    data = b"\xff\xfb" + compose.mp3(b"abc", 3)
    pieces = spark.createDataFrame([(f"{at}", k, d) for at in range(0, len(data), 7) for k, d in cut(data, [at])] + [("bytes", k, data[k : k + 1]) for k in range(len(data))], "path string, seq int, data binary")
    got = found(packetizer.packetize(pieces, 300))
    assert len(got) == len(range(0, len(data), 7)) + 1 and all(v == plain(data) for v in got.values())


def test_files_by_blocks(spark, tmp_path):
    made = {f"{k}.mp3": hard(k, 40_000) for k in range(3)} | {"e.bin": b""}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    frames = packetizer.packetize_files(spark, str(tmp_path), 5000)
    got = {k.rpartition("/")[2]: v for k, v in found(frames).items()}
    assert got == {k: plain(v) for k, v in made.items() if v}
    payload = ranged.fetch(frames.withColumnRenamed("frame_length", "size")).collect()
    assert all(bytes(r["data"]) == made[r["path"].rpartition("/")[2]][r["offset"] :][: r["size"]] for r in payload)
