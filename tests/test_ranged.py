import os
import pickle
import struct

import pytest
from pyspark.sql import functions as F

from reelframe.sources import compose, containers, media, ranged

SAMPLES = [bytes([65 + k]) * (50 + k) for k in range(20)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("media")
    made = {
        "a.mp4": compose.mp4(SAMPLES), "b.mkv": compose.mkv([[b"x" * 300, b"y" * 40], [b"ccc"], [b"dd", b"e" * 9000]]), "c.wav": compose.wav(bytes(50_000)), "d.mp3": compose.mp3(bytes(9000)),
        "e.jpg": compose.jpeg(b"comment", b"maker", 1), "f.bin": b"", "g.bin": b"hello", "tag.mp3": b"ID3\4\0\0" + bytes([0, 1, 0, 0]) + bytes(16384) + compose.mp3(bytes(9000)),
    }
    for name, content in made.items():
        (d / name).write_bytes(content)
    return str(d), made


def short(rows):
    return {r["path"].rpartition("/")[2]: r for r in rows}


def test_probes_read_a_window_and_say_the_same(spark, folder):
    path, made = folder
    files = spark.createDataFrame(list(made.items()), "path string, content binary")
    want = {r["path"]: (r["format"], r["score"]) for r in media.probe_scores(files).collect()}
    got = short(ranged.read(spark, path).collect())
    assert {k: (r["format"], r["score"]) for k, r in got.items()} == want and got["tag.mp3"]["score"] == 100
    assert all(r["bytes_read"] <= 10 + media.PROBE_BYTES and r["length"] == len(made[k]) for k, r in got.items())


def test_tables_by_range_are_those_of_whole_files(spark, folder):
    path, made = folder
    files = spark.createDataFrame([(f"{path}/{k}", c) for k, c in made.items()], "path string, content binary")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(ranged.read(spark, path, "mp4")) == rows(media.mp4_tables(files))
    assert rows(ranged.mp4_samples(spark, path)) == rows(media.mp4_samples(files))
    for kind in ("mp4", "riff"):
        assert rows(ranged.read(spark, path, "elements", kind=kind)) == rows(containers.elements(files, kind))
    assert rows(ranged.read(spark, path, "tracks")) == rows(media.mkv_tracks(files).drop("codec"))
    assert rows(ranged.read(spark, path, "cues").drop("segment")) == rows(media.mkv_cues(files))
    jpeg = [r["name"] for r in ranged.read(spark, f"{path}/e.jpg", "elements", kind="jpeg").orderBy("node_id").collect()]
    whole = [r["name"] for r in containers.elements(files.filter("path LIKE '%jpg'"), "jpeg").orderBy("node_id").collect()]
    assert jpeg == whole[: len(jpeg)] and jpeg[-1] == "SOS"


def test_payload_by_range(spark, folder):
    path, made = folder
    got = ranged.fetch(ranged.mp4_samples(spark, path)).orderBy("sample_idx").collect()
    assert [bytes(r["data"]) for r in got] == SAMPLES
    odd = spark.createDataFrame([(f"{path}/g.bin", 1, 3, b"pre"), (f"{path}/g.bin", 3, 99, None), (f"{path}/g.bin", 50, 5, None), (f"{path}/g.bin", None, 2, None), (f"{path}/g.bin", -1, 2, b"p")], "path string, offset long, size long, prefix binary")
    assert sorted(bytes(r["data"]) for r in ranged.fetch(odd).collect()) == sorted([b"preell", b"lo", b"", b"he", b"p"])


def test_clusters_by_cues(spark, folder):
    path, made = folder
    files = spark.createDataFrame([(f"{path}/b.mkv", made["b.mkv"])], "path string, content binary")
    every = {(r["track"], r["pts"], r["offset"], r["size"]) for r in media.mkv_packets(files).collect()}
    got = ranged.mkv_packets(spark, f"{path}/b.mkv", 1500, 2500).collect()
    assert {(r["track"], r["pts"], r["offset"], r["size"]) for r in got} == {x for x in every if x[1] >= 1000}
    assert [bytes(r["data"]) for r in ranged.fetch(ranged.mkv_packets(spark, f"{path}/b.mkv", 0, 0)).orderBy("offset").collect()][:2] == [b"x" * 300, b"y" * 40]


def test_a_file_of_3_gib_is_read_in_parts(spark, tmp_path):
    """The payload is a hole of 3 GiB before the index."""
    small, hole = compose.mp4(SAMPLES), 3 << 30
    at = small.index(b"mdat") - 4
    end = at + struct.unpack_from(">I", small, at)[0]
    shift = hole + 8
    moov = bytearray(small[end:])
    table = moov.index(b"stco") + 8
    n = struct.unpack_from(">I", moov, table)[0]
    old = [struct.unpack_from(">I", moov, table + 4 + 4 * k)[0] for k in range(n)]
    for k, x in enumerate(old):
        struct.pack_into(">I", moov, table + 4 + 4 * k, x + shift)
    with open(tmp_path / "big.mp4", "wb") as f:
        f.write(small[:at] + struct.pack(">I4sQ", 1, b"mdat", hole + 16 + end - at - 8))
        f.seek(at + 16 + hole)
        f.write(small[at + 8 : end] + bytes(moov))
    assert os.path.getsize(tmp_path / "big.mp4") > 3 << 30
    data = ranged.ranged(str(tmp_path / "big.mp4"))
    rows = list(media._mp4_rows(data))
    assert len(rows) > len(SAMPLES) and data.read <= len(moov) + 16 * ranged.BLOCK
    s = ranged.mp4_samples(spark, str(tmp_path))
    assert s.count() == len(SAMPLES)
    assert [bytes(r["data"]) for r in ranged.fetch(s.filter("sample_idx IN (0, 7, 19)")).orderBy("sample_idx").collect()] == [SAMPLES[0], SAMPLES[7], SAMPLES[19]]


def test_a_seek_head_spares_the_clusters(spark, tmp_path):
    whole = compose.mkv([[bytes(60_000)]] * 12)
    nodes = [(name, o, s) for _, _, name, o, s in containers.walk_ebml(whole)]
    body = next(o for name, o, _ in nodes if name == "Segment")
    first = next(o for name, o, _ in nodes if name == "Cues")
    cues = whole.rindex(b"\x1c\x53\xbb\x6b", 0, first) - body
    seek = lambda pos: compose.ebml(0x114D9B74, compose.ebml(0x4DBB, compose.ebml(0x53AB, b"\x1c\x53\xbb\x6b") + compose.ebml(0x53AC, pos.to_bytes(8, "big"))))
    size = len(seek(0))
    head = whole[:body].rindex(b"\x18\x53\x80\x67")
    live = whole[:head] + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + seek(size + cues) + whole[body:]
    (tmp_path / "a.mkv").write_bytes(live)
    (tmp_path / "b.mkv").write_bytes(whole)
    data = ranged.ranged(str(tmp_path / "a.mkv"))
    found = list(ranged._mkv_index(data, "cues"))
    assert [r[:3] for r in found] == list(media._mkv_cues(whole)) and len(found) == 12
    assert data.read <= 6 * ranged.BLOCK + len(whole) - cues
    assert ranged.read(spark, str(tmp_path), "cues").count() == 24 and ranged.read(spark, str(tmp_path), "tracks").count() == 4


def test_filters_reach_the_reader(spark, folder):
    path, made = folder
    spark.conf.set(ranged.PUSHDOWN, "true")
    try:
        one = ranged.read(spark, path).filter(F.col("path") == f"{path}/a.mp4")
        assert [r["format"] for r in one.collect()] == ["mp4"] and one.rdd.getNumPartitions() == 1
        sizes = ranged.read(spark, path, "mp4").filter("name IN ('stsz', 'stss') AND entry > 0")
        assert {r["name"] for r in sizes.collect()} == {"stsz", "stss"}
    finally:
        spark.conf.set(ranged.PUSHDOWN, "false")
    reader = ranged.PushingReader({"path": path}, ranged.StructType().add("path", "string").add("format", "string"))
    left = list(reader.pushFilters([ranged.In(("path",), (f"{path}/c.wav", "x")), ranged.EqualTo(("format", "deep"), 1)]))
    assert len(left) == 1 and [p.paths for p in reader.partitions()] == [[f"{path}/c.wav"]]


def test_whole_files_are_read_by_tasks(spark, folder, tmp_path):
    path, made = folder
    got = {r["path"]: (r["length"], bytes(r["content"])) for r in ranged.contents(spark, path).collect()}
    assert got == {f"{path}/{n}": (len(c), c) for n, c in made.items()}
    (tmp_path / "a b%20#").mkdir()
    for name in ("x?@1", "a b%20#/y z", "a b%20#/_left out", "_left out", ".left out"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty").mkdir()
    got = {r["path"]: bytes(r["content"]) for r in ranged.contents(spark, f"file://{tmp_path}/").collect()}
    assert got == {f"file://{tmp_path}/{n}": n.encode() for n in ("x?@1", "a b%20#/y z")}
    assert ranged.contents(spark, str(tmp_path / "none")).count() == 0


def test_written_files_are_whole_or_not_there(spark, tmp_path):
    rows = [(f"sub/{k % 3}/{k}.bin", bytes([k]) * k) for k in range(20)] + [("empty", None)]
    files = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    ranged.write(files, str(tmp_path / "out"))
    found = {os.path.relpath(os.path.join(d, x), tmp_path / "out"): open(os.path.join(d, x), "rb").read() for d, _, names in os.walk(tmp_path / "out") for x in names}
    assert found == {n: c or b"" for n, c in rows} and os.listdir(tmp_path / "out") and not any("_staging" in x for x in os.listdir(tmp_path / "out"))
    bad = spark.createDataFrame([("fine", b"1"), ("../out of here", b"2")], "path string, content binary").coalesce(1)
    with pytest.raises(Exception, match="not a place"):
        ranged.write(bad, str(tmp_path / "none"))
    assert not [x for _, _, names in os.walk(tmp_path / "none") for x in names] and not os.path.exists(tmp_path / "out of here")


def test_no_name_of_a_written_file_goes_to_the_driver(tmp_path, monkeypatch):
    """What tasks say to the commit is as long for many files as for one, and spread files lie in folders of LISTED at most."""
    monkeypatch.setattr(ranged, "LISTED", 8)
    for spread in ("false", "true"):
        root = tmp_path / spread
        writer = ranged.MediaWriter({"path": str(root), "spread": spread})
        said = [writer.write(iter([{"path": f"sub/{t}-{k}", "content": b"%d" % k} for k in range(n)])) for t, n in enumerate((1, 50, 0))]
        assert len({len(pickle.dumps(m)) for m in said}) == 1
        writer.write(iter([{"path": "killed", "content": b"x"}]))
        writer.commit([*said, None])
        found = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names]
        assert sorted(os.path.basename(f) for f in found) == sorted(["0-0", *(f"1-{k}" for k in range(50))])
        assert all(open(f).read() == f.rpartition("-")[2] and f.split("/")[-2] == "sub" for f in found)
        if spread == "true":
            parts = [len(names) for _, _, names in os.walk(root) if names]
            assert max(parts) == 8 and len(parts) == 8 and all(x.startswith("part-") for x in os.listdir(root))
        else:
            assert os.listdir(root) == ["sub"]
