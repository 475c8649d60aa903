import struct

from pyspark.sql import functions as F

from reelframe.functions import configs
from reelframe.plans.sample_table import expand_runs
from reelframe.queries import files as file_queries
from reelframe.sources import compose, containers, media

SAMPLES = [bytes([k]) * (5 + k) for k in range(8)]


def files(spark, **content):
    return spark.createDataFrame(list(content.items()), "path string, content binary")


def test_probe(spark):
    got = media.probe(files(spark, wav=compose.wav(b"1234"), mp3=compose.mp3(b""), id3=compose.id3("a", "b", "1"), mp4=compose.mp4(SAMPLES), mkv=compose.mkv([[b"x"]]), jpg=compose.jpeg(b"c", b"m", 1), none=b"", text=b"hello world!", flac=b"fLaC1234"))
    assert dict(map(tuple, got.collect())) == {"wav": "wave", "mp3": "mp3", "id3": "mp3", "mp4": "mp4", "mkv": "matroska", "jpg": "jpeg", "none": "----", "text": "----", "flac": "flac"}


def test_wav_packets_stop_at_the_data_chunk(spark):
    payload = bytes(5000 * 4)
    got = media.wav_packets(files(spark, a=compose.wav(payload) + b"TAG" + bytes(125), b=b"RIFF", c=b"")).orderBy("sample_idx").collect()
    assert [(r["size"] // 4, r["pts"], r["timescale"]) for r in got] == [(2048, 0, 8000), (2048, 2048, 8000), (904, 4096, 8000)]


def test_mp3_frames(spark):
    got = media.mp3_frames(files(spark, a=b"junk\xff\xfb\x90\x00junk" + compose.mp3(bytes(12 * 413)), b=b"\xff" * 50)).orderBy("frame_idx").collect()
    assert [r["frame_length"] for r in got] == [417, 417, 418] * 4
    assert [r["pts"] for r in got] == [1152 * k for k in range(12)]


def test_mp3_files_with_a_lone_frame_at_the_end_keep_it(spark):
    assert media.mp3_frames(files(spark, a=compose.mp3(b""))).count() == 2


def test_id3_texts(spark):
    got = media.id3_tags(files(spark, a=compose.id3("Titel ü", "Künstler", "(17)"), b=b"ID3", c=b"none")).collect()
    assert [dict(r["tags"]) for r in got] == [{"title": "Titel ü", "artist": "Künstler", "genre": "Rock", "comment": ""}]


def id3_file(version, *frames, flags=0):
    width = 3 if version == 2 else 4
    safe = lambda n: bytes(n >> k & 127 for k in (21, 14, 7, 0))
    size = lambda n: n.to_bytes(3, "big") if version == 2 else safe(n) if version == 4 else n.to_bytes(4, "big")
    body = b"".join(tag[:width] + size(len(b)) + (b"" if version == 2 else b"\0\0") + b for tag, b in frames)
    return b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body


def test_id3_comments_pictures_links_and_older_tags(spark):
    v1 = b"TAG" + b"Old title".ljust(30, b"\0") + b"Old artist".ljust(30, b" ") + b"Album".ljust(30, b"\0") + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    v3 = id3_file(3, (b"COMM", b"\x01eng\xff\xfes\0\0\0\xff\xfeh\0i\0"), (b"COMM", b"\0engd\0more"), (b"APIC", b"\0image/png\0\x03cover\0" + b"x" * 50), (b"WOAR", b"http://a.example"), (b"TXXX", b"\x03mood\0calm"))
    v2 = id3_file(2, (b"TT2", b"\0Two"), (b"PIC", b"\0PNG\x03\0" + b"y" * 9), (b"COM", b"\0eng\0short"))
    got = {r["path"]: dict(r["tags"]) for r in media.id3_tags(files(spark, v1=b"data" * 50 + v1, v3=v3, v2=v2, both=v3 + b"data" * 50 + v1, none=b"TAG")).collect()}
    old = {"title": "Old title", "artist": "Old artist", "album": "Album", "year": "1999", "comment": "note", "track": "7", "genre": "Rock"}
    new = {"comment": "hi\nmore", "APIC": "image/png 50", "WOAR": "http://a.example", "TXXX:mood": "calm"}
    assert got == {"v1": old, "v3": new, "v2": {"title": "Two", "PIC": "PNG 9", "comment": "short"}, "both": old | new}


def test_mp4_sample_table_finds_the_samples(spark):
    f = files(spark, a=compose.mp4(SAMPLES), cut=compose.mp4(SAMPLES)[:40], none=b"")
    got = media.packets(media.mp4_samples(f), f).orderBy("sample_idx").collect()
    assert [bytes(r["data"]) for r in got] == SAMPLES
    assert [r["dts"] for r in got] == [40 * k for k in range(8)]
    assert [r["pts"] for r in got] == [40 * k + (80 if k % 2 else 40) for k in range(8)]
    assert [r["flags"] for r in got] == [1, 0, 4, 0, 0, 5, 0, 0]
    track = media.mp4_tracks(f).collect()
    assert [(t["timescale"], t["duration"], t["codec"]) for t in track] == [(1000, 320, "h264")]


def test_mkv_packets(spark):
    parts = [bytes([65 + k]) * (300 + k) for k in range(8)] + [b"eq1", b"eq2", b"strip"]
    f = files(spark, a=compose.mkv([parts, [b"ccc"]]), web=compose.mkv([[b"x"]]).replace(b"matroska", b"other\0\0\0"), none=b"")
    got = media.packets(media.mkv_packets(f), f).orderBy("pts").collect()
    assert [bytes(r["data"]) for r in got] == [*parts[:10], b"!strip", b"ccc"]
    assert [(r["track"], r["pts"], r["flags"]) for r in got] == [(1 if k < 10 else 300, 40 * k, {0: 1, 10: 4}.get(k, 0)) for k in range(11)] + [(1, 1000, 1)]
    assert {(r["track"], r["codec"], r["compression"]) for r in media.mkv_tracks(f).collect()} == {(1, "vp9", None), (300, "aac", 3)}
    whole = compose.mkv([parts, [b"ccc"]])
    clusters = [o for _, _, name, o, _ in containers.walk_ebml(whole) if name in ("Segment", "Cluster")]
    cues = media.mkv_cues(f).orderBy("time").collect()
    assert [(r["track"], r["time"]) for r in cues] == [(1, 0), (1, 1000)]
    assert [clusters[0] + r["pos"] + 12 for r in cues] == clusters[1:]


def test_laces_that_are_cut_off_give_nothing():
    for kind in (1, 2, 3):
        block = b"\x81\0\x05" + bytes([kind << 1]) + compose.lace([b"abc", b"d" * 3, b"efg"], kind)
        track, time, flags, frames = media.block_frames(block, 0, len(block))
        assert (track, time, [block[a : a + n] for a, n in frames]) == (1, 5, [b"abc", b"ddd", b"efg"])
        for n in range(len(block) - 9):
            assert all(a + size <= n for a, size in media.block_frames(block[:n], 0, n)[3])


def wav_file(fmt, data=b"", more=b""):
    return compose._chunk(b"RIFF", b"WAVE" + compose._chunk(b"fmt ", fmt) + more + compose._chunk(b"data", data))


def test_wav_formats(spark):
    wide = struct.pack("<HHIIHHHHII", 0xFFFE, 2, 48000, 0, 8, 32, 22, 32, 7, 3) + configs.WAVE_GUID
    f = files(
        spark,
        pcm=wav_file(struct.pack("<HHIIHH", 1, 1, 8000, 0, 3, 24), bytes(24000)),
        mp3=wav_file(struct.pack("<HHIIHHH", 0x55, 2, 44100, 16000, 1, 0, 0), bytes(32000), compose._chunk(b"fact", struct.pack("<I", 44100))),
        wide=wav_file(wide, bytes(80)), guid=wav_file(wide[:-1] + b"x", bytes(80)), short=wav_file(b"abc", b"d"), none=b"", cut=wav_file(wide)[:30],
    )
    got = {r["path"]: r for r in media.wav_files(f).collect()}
    assert [(got[k]["tag"], got[k]["format"], got[k]["bits"], got[k]["mask"], got[k]["duration_us"], got[k]["bitrate"]) for k in ("pcm", "mp3", "wide")] == [(1, "s24", 24, 0, 1_000_000, 192_000), (0x55, None, 0, 0, 1_000_000, 128_000), (3, "f32", 32, 0, 208, 3_072_000)]
    assert {k for k, r in got.items() if r["error"]} == {"guid", "short", "cut"} and "none" not in got
    assert {r["path"]: r["size"] for r in media.wav_packets(f).filter("sample_idx = 0").collect()} == {"pcm": 6144, "wide": 80}


def test_mp3_durations_and_seeking(spark):
    plain = compose.mp3(bytes(20 * 413))
    first = bytearray(plain[:417])
    first[36:48] = b"Xing" + struct.pack(">II", 0x0F, 1000)
    first[48:52] = struct.pack(">I", 256_000)
    first[52:152] = bytes(range(0, 200, 2))
    first[152:156] = struct.pack(">I", 78)
    first[156:165] = b"LAME3.100"
    first[177:180] = (576 << 12 | 1000).to_bytes(3, "big")
    vbr = bytearray(plain[:417])
    vbr[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, 90_000, 200, 4, 10, 2, 50)
    vbr[62:70] = struct.pack(">4H", 100, 200, 300, 400)
    f = files(spark, xing=bytes(first) + plain[417:], vbri=compose.id3("t", "a", "1") + bytes(vbr) + plain[417:], cbr=plain + b"TAG" + bytes(125), none=b"nothing")
    info = media.mp3_files(f)
    got = {r["path"]: r for r in info.collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"xing": "xing", "vbri": "vbri", "cbr": "cbr"}
    x = got["xing"]
    assert (x["frames"], x["duration_us"], x["encoder"], x["delay"], x["padding"]) == (1000, 1000 * 1152 * 1_000_000 // 44100, "LAME3.100", 576, 1000)
    assert x["toc"][:3] == [0, 2000, 4000] and got["cbr"]["size"] == len(plain) and got["cbr"]["duration_us"] == 8 * len(plain) * 1_000_000 // 128_000
    at = got["vbri"]["first_frame"]
    assert got["vbri"]["toc"] == [at, at + 1000, at + 3000, at + 6000]
    pos = {r["path"]: r["pos"] for r in media.mp3_seek(info, F.col("duration_us") / 2).collect()}
    assert (pos["vbri"], pos["cbr"]) == (at + 2000, len(plain) // 2)
    assert x["toc"][49] <= pos["xing"] <= x["toc"][50]


def test_scores_of_damaged_files(spark):
    tree = compose.mp4(SAMPLES)
    f = files(spark, wav=compose.wav(b"")[:36], tag=compose.id3("t" * 40_000, "a", "1") + compose.mp3(b""), lone=compose.mp3(b"")[:417], ebml=compose.mkv([[b"a"]])[:20], moov=tree[tree.index(b"moov") - 4 :])
    got = {r["path"]: (r["format"], r["score"]) for r in media.probe_scores(f).collect()}
    assert got == {"wav": ("wave", 80), "tag": ("mp3", 100), "lone": ("----", 0), "ebml": ("matroska", 20), "moov": ("mp4", 100)}


def test_compact_sizes_and_wide_offsets(spark):
    full = lambda tag, *body: compose.box(tag, b"\0\0\0\0" + b"".join(body))
    u4 = lambda *n: struct.pack(f">{len(n)}I", *n)
    stbl = full(b"stts", u4(1, 5, 10)) + full(b"stsc", u4(2, 1, 2, 1, 3, 1, 1)) + full(b"stz2", bytes([0, 0, 0, 4]), u4(5), b"\x12\x34\x50") + full(b"co64", u4(3), struct.pack(">3Q", 1 << 33, 100, 200))
    f = files(spark, a=compose.box(b"moov", compose.box(b"trak", compose.box(b"mdia", compose.box(b"minf", compose.box(b"stbl", stbl))))))
    got = media.mp4_samples(f).orderBy("sample_idx").collect()
    assert [(r["chunk"], r["offset"], r["size"], r["dts"], r["flags"]) for r in got] == [(1, 1 << 33, 1, 0, 1), (1, (1 << 33) + 1, 2, 10, 1), (2, 100, 3, 20, 1), (2, 103, 4, 30, 1), (3, 200, 5, 40, 1)]


def test_audio_track_configuration(spark):
    csd = bytes([0x12, 0x10])
    esds = compose.box(b"esds", configs.compose_esds(0x40, csd, 128_000))
    stsd = compose.box(b"stsd", struct.pack(">II", 0, 1) + compose.box(b"mp4a", bytes(28) + esds))
    mdhd = compose.box(b"mdhd", b"\1\0\0\0" + bytes(16) + struct.pack(">IQI", 44100, 1 << 34, 0))
    f = files(spark, a=compose.box(b"moov", compose.box(b"trak", compose.box(b"mdia", mdhd + compose.box(b"minf", compose.box(b"stbl", stsd))))))
    (r,) = media.mp4_tracks(f).collect()
    assert (r["timescale"], r["duration"], r["codec"], r["sample_rate"], r["channels"], bytes(r["csd"])) == (44100, 1 << 34, "aac", 44100, 2, csd)


def test_exif_of_both_byte_orders(spark):
    f = files(spark, a=compose.jpeg(b"c", b"Camera", 6), b=compose.jpeg(b"", b"Other", 3, ">"), c=b"\xff\xd8")
    got = {r["path"]: dict(r["tags"]) for r in media.exif(f).collect()}
    assert got == {"a": {"Make": "Camera", "Orientation": "6"}, "b": {"Make": "Other", "Orientation": "3"}}


def test_trees_of_cut_files_end_quietly():
    whole = {"riff": compose.wav(b"12345"), "mp4": compose.mp4(SAMPLES), "ebml": compose.mkv([[b"a"]]), "jpeg": compose.jpeg(b"c", b"m", 1)}
    for kind, data in whole.items():
        for n in range(len(data)):
            nodes = list(containers.WALKERS[kind](data[:n]))
            assert all(o + s <= n for _, _, _, o, s in nodes)


def test_large_box_sizes():
    data = struct.pack(">I4sQ", 1, b"free", 24) + b"12345678" + compose.box(b"free", b"")
    assert [(n[2], n[3], n[4]) for n in containers.walk_mp4(data)] == [("free", 16, 8), ("free", 32, 0)]


def test_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(compose.wav(b"1234"))
    got = containers.elements(containers.load(spark, str(tmp_path)), "riff")
    assert [r["name"] for r in got.orderBy("node_id").collect()] == ["RIFF", "fmt ", "data"]
    assert containers.dump(got).filter(F.col("line").startswith("  data")).count() == 1


def test_long_texts_are_whole_in_mkv_and_jpeg_files():
    text = "".join(f"word{k} " for k in range(20_000))
    mkv = compose.mkv(file_queries._clusters(text))
    blocks = [mkv[o : o + n] for _, _, _, _, o, n, _ in media._mkv_packets(mkv)]
    assert b"".join(blocks) == text.encode() + b"end"
    jpeg = compose.jpeg(text.encode(), b"m", 1)
    comments = [jpeg[n[3] : n[3] + n[4]] for n in containers.walk_jpeg(jpeg) if n[2] == "COM"]
    assert b"".join(comments) == text.encode()


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + name + body


def mp4_of_tables(*tables):
    return box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", *tables))))) + box(b"mdat", bytes(400))


def full(name, *numbers):
    return box(name, b"".join(struct.pack(">I", n) for n in (0, *numbers)))


def test_counts_beyond_a_files_samples_are_left_out(spark):
    huge = 0xFFFFFFFF
    damaged = mp4_of_tables(full(b"stts", 1, huge, 5), full(b"ctts", 1, huge, 2), full(b"stsc", 1, 1, huge, 1), full(b"stsz", 0, 3, 10, 20, 30), full(b"stco", 1, 100))
    constant = mp4_of_tables(full(b"stts", 1, huge, 1), full(b"stsc", 1, 1, huge, 1), full(b"stsz", 8, huge), full(b"stco", 1, 0))
    got = media.mp4_samples(files(spark, damaged=damaged, constant=constant, good=compose.mp4(SAMPLES))).orderBy("path", "sample_idx").collect()
    assert [(r["offset"], r["size"], r["dts"], r["pts"]) for r in got if r["path"] == "damaged"] == [(100, 10, 0, 2), (110, 20, 5, 7), (130, 30, 10, 12)]
    some = [r for r in got if r["path"] == "constant"]
    assert len(some) == len(constant) // 8 and [(r["offset"], r["size"], r["dts"]) for r in some[:3]] == [(0, 8, 0), (8, 8, 1), (16, 8, 2)]
    assert sum(r["path"] == "good" for r in got) == len(SAMPLES)


def test_long_runs_are_made_in_parts(spark):
    runs = spark.createDataFrame([("a", 0, 200_000, 7), ("a", 1, 3, 9), ("b", 0, 0, 1)], "k string, entry int, n long, x int")
    got = expand_runs(runs, ["k"], ["entry"], "n")
    r = got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("sample_idx").alias("d"), F.max("sample_idx").alias("last"), F.sum("x").alias("x")).collect()
    assert [tuple(x) for x in r] == [("a", 200_003, 200_003, 200_002, 1_400_027)]


def exif_jpeg(*entries):
    tiff = b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(entries) + bytes(40)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


def test_exif_pointers_that_are_no_places_point_nowhere(spark):
    entry = lambda tag, kind, n, value: struct.pack("<HHI4s", tag, kind, n, value)
    size = entry(0xA002, 4, 1, struct.pack("<I", 77))
    bad = {
        "text": entry(0x8769, 2, 4, b"abc\0"), "two": entry(0x8825, 3, 2, b"\1\0\2\0"), "ratio": entry(0x8769, 5, 1, struct.pack("<I", 30)),
        "back": entry(0x8769, 9, 1, struct.pack("<i", -5)), "far": entry(0x8825, 4, 1, b"\xff\xff\xff\xff"), "self": entry(0x8769, 4, 1, struct.pack("<I", 8)),
    }
    got = {r["path"]: dict(r["tags"]) for r in media.exif(files(spark, **{k: exif_jpeg(b, size) for k, b in bad.items()})).collect()}
    assert got == {k: {"PixelXDimension": "77"} for k in bad}


def test_a_stereo_frame_and_a_mono_one_are_no_stream(spark):
    frame = lambda mode: (b"\xff\xfb\x90" + bytes([mode << 6])).ljust(417, b"\0")
    got = {r["path"]: r["score"] for r in media.probe_scores(files(spark, same=frame(0) * 2, other=frame(0) + frame(3))).collect()}
    assert got == {"same": 100, "other": 0}
    first = media.mp3_files(files(spark, same=frame(0) * 2, other=frame(0) + frame(3) + frame(0))).select("path", "first_frame").collect()
    assert dict(map(tuple, first)) == {"same": 0, "other": 834}


def test_clusters_of_unknown_size_are_siblings(spark):
    block = b"\xa3\x85\x81\0\0\x80x"
    cluster = b"\x1f\x43\xb6\x75\xff\xe7\x81\x05" + block
    live = b"\x1a\x45\xdf\xa3\x80" + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + cluster * 4 + b"\x1c\x53\xbb\x6b\x80"
    got = containers.elements(files(spark, live=live, cut=live[:-8]), "ebml").orderBy("path", "node_id").collect()
    rows = [(r["depth"], r["name"], r["size"]) for r in got if r["path"] == "live"]
    inner = [(1, "Cluster", 10), (2, "Timecode", 1), (2, "SimpleBlock", 5)]
    assert rows == [(0, "EBML", 0), (0, "Segment", len(live) - 17), *inner * 4, (1, "Cues", 0)]
    assert [r["depth"] for r in got if r["path"] == "cut" and r["name"] == "Cluster"] == [1] * 4


def test_many_rows_of_a_file_come_in_parts(spark):
    got = containers.elements(files(spark, a=b"\xff\xd8" * 120_000), "jpeg")
    assert got.count() == 120_000
