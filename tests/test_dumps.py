import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reelframe.functions import configs, pcm
from reelframe.operators import scan
from reelframe.queries import ORACLE_SQL, QUERIES
from reelframe.sources import compose, containers, dumps
from tests import oracle


def tree(data, at=0, end=None, parent=-1, depth=0, rows=None):
    """Elements of a file without unknown sizes, by recursion."""
    rows = [] if rows is None else rows
    end = len(data) if end is None else end
    while at < end:
        n = 9 - data[at].bit_length()
        name, at = containers.EBML_NAMES[int.from_bytes(data[at : at + n], "big")], at + n
        n = 9 - data[at].bit_length()
        size, at = int.from_bytes(data[at : at + n], "big") - (1 << 7 * n), at + n
        k = len(rows)
        rows.append((k, parent, depth, name, at, size))
        if name in containers.EBML_PARENTS:
            tree(data, at, at + size, k, depth + 1, rows)
        at += size
    return rows


def test_ebml_trees_are_those_of_a_plain_reader():
    for seed in range(5):
        r = random.Random(seed)
        data = compose.mkv([[bytes(r.randrange(256) for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 15))] for _ in range(r.randrange(1, 5))])
        assert [(k, *row) for k, row in enumerate(containers.walk_ebml(data))] == tree(data)


def test_wave_formats_round_trip():
    for tag, channels, bits, mask in ((1, 2, 16, 0), (1, 6, 24, 0x3F), (3, 2, 32, 3), (0x55, 2, 0, 0), (1, 4, 16, 0)):
        frame = channels * bits // 8
        fmt = {"tag": tag, "channels": channels, "rate": 48000, "bytes_per_second": 48000 * frame or 16000, "align": frame or 1, "bits": bits, "mask": mask, "extra": b"extra" if tag == 0x55 else b""}
        got = configs.wave_format(configs.compose_wave_format(fmt))
        assert {**got, "extra": b""} == {**fmt, "extra": b""} and (tag != 0x55 or got["extra"] == b"extra")
    bad = {"tag": 1, "channels": 2, "rate": 8000, "bytes_per_second": 32000, "align": 4, "bits": 16, "mask": 7, "extra": b""}
    assert configs.wave_format(configs.compose_wave_format(bad))["mask"] == 0


def test_bitmap_info():
    body = (44).to_bytes(4, "little") + (640).to_bytes(4, "little") + (-480).to_bytes(4, "little", signed=True) + b"\1\0\x18\0MJPG" + (921600).to_bytes(4, "little") + bytes(16) + b"morexx"
    assert configs.bitmap_info(body) == {"width": 640, "height": -480, "planes": 1, "bits": 24, "compression": "MJPG", "image_size": 921600, "x_density": 0, "y_density": 0, "colors": 0, "important": 0, "extra": b"more"}
    assert configs.bitmap_info(body[:39]) is None and configs.bitmap_info(bytes(40)) is None


def test_stored_samples(spark):
    rows = [("u8", b"\0\xff", [0, 255]), ("s16", b"\0\x80\xff\x7f\1", [-32768, 32767]), ("s24", b"\1\0\0\xff\xff\xff\0\0\x80\7", [256, -256, -(1 << 31)]), ("s32", b"\1\0\0\0", [1]), ("f32", b"\0\0\0\x3f", [0.5]), ("s24", b"", []), ("s24", None, None), ("x", b"ab", None)]
    df = spark.createDataFrame([(f, d, None if w is None else [float(x) for x in w]) for f, d, w in rows], "form string, data binary, want array<double>")
    assert all(r["got"] == r["want"] for r in df.select("want", pcm.samples(F.col("data"), F.col("form")).alias("got")).collect())


def test_packets_keep_their_files_apart(spark, tmp_path):
    rows = [(1, 5, 40, b"abc"), (1, 5, 40, b"abd"), (1, 5, 40, b"abc"), (2, 12345678, 0, b""), (None, None, None, None)]
    dumps.dump_packets(spark.createDataFrame(rows, "track int, us long, duration_us long, data binary"), str(tmp_path / "p"))
    got = {f.name: f.read_bytes() for f in (tmp_path / "p").iterdir()}
    assert got == {"1_0000005_0000040@3": b"abc", "1_0000005_0000040@3.1": b"abc", "1_0000005_0000040@3.2": b"abd", "2_12345678_0000000@0": b"", "0_0000000_0000000@0": b""}


@pytest.mark.parametrize("small", [scan.SMALL, 0])
def test_packets_without_text_or_key_or_with_equal_names_are_those_of_sql(spark, tmp_path, monkeypatch, small):
    rows = [(1, "abc"), (1, "abc"), (1, "abd"), (2, ""), (2, ""), (3, None), (-1, "x"), (-8, ""), (7, "\u00e4.1"), (300_000_000, "far"), (0, "zero"), (None, "zero"), (None, "zero"), (None, None)]
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / "documents.parquet")
    monkeypatch.setattr(oracle, "SF", str(tmp_path))
    monkeypatch.setattr(scan, "SMALL", small)
    oracle.compare(spark, QUERIES["packet_dump"], ORACLE_SQL["packet_dump"])
    assert QUERIES["packet_dump"](spark, str(tmp_path)).count() == len(rows)


def test_tracks_end_to_end(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, bytes(r.randrange(256) for _ in range(r.randrange(60)))) for k in range(200)] + [("c", 0, None), ("c", 1, b"")]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "track string, k int, data binary")
    dumps.dump_raw(df, ["k"], str(tmp_path / "raw"), 300)
    for track in ("a", "b", None):
        parts = sorted((tmp_path / "raw" / f"track-{track or 'null'}.raw").iterdir())
        whole = b"".join(f.read_bytes() for f in parts)
        assert whole == b"".join(d for t, _, d in rows if t == track) and len(parts) > 1
        assert all(int(f.name) == sum(g.stat().st_size for g in parts[:i]) and f.stat().st_size < 360 for i, f in enumerate(parts))
    assert not (tmp_path / "raw" / "track-c.raw").exists()
    planes = spark.createDataFrame([("a", 0, [b"y", b"u", None]), ("a", 1, [b"v"])], "track string, k int, planes array<binary>")
    assert [(x["path"], bytes(x["content"])) for x in dumps.raw_parts(planes, ["k"]).collect()] == [("track-a.raw/000000000000000000", b"yuv")]
