import struct

from reelframe.sources import compose, tags


def files(spark, **made):
    return spark.createDataFrame(list(made.items()), "path string, content binary")


def app1(tiff):
    return compose.jpeg_of((0xE1, b"Exif\0\0" + tiff))


def test_all_types_in_both_byte_orders(spark):
    made = {}
    for name, o in (("little", "<"), ("big", ">")):
        kinds = [(0x9000 + k, k, 2, struct.pack(o + f, *v)) for k, f, v in ((1, "2B", (1, 255)), (3, "2H", (1, 65535)), (4, "2I", (1, 1 << 31)), (5, "4I", (1, 2, 3, 4)), (6, "2b", (1, -1)), (7, "2B", (0, 9)), (8, "2h", (1, -1)), (9, "2i", (1, -1)), (10, "4i", (1, -2, 3, 4)), (11, "2f", (0.5, -1.0)), (12, "2d", (0.25, 1e9)))]
        made[name] = app1(compose.tiff(o, [(0x010E, 2, 3, b"ab\0")], kinds, [(31, 5, 1, struct.pack(o + "II", 7, 2))], b"\xff\xd8thumb"))
    got = tags.tags(files(spark, **made)).collect()
    want = ["1 255", "1 65535", f"1 {1 << 31}", "1/2 3/4", "1 -1", "0 9", "1 -1", "1 -1", "1/-2 3/4", "0.5 -1.0", "0.25 1000000000.0"]
    for name in made:
        own = [r for r in got if r["path"] == name]
        assert [r["value"] for r in sorted((r for r in own if r["directory"] == "Exif"), key=lambda r: r["tag"])] == want
        assert {(r["directory"], r["name"]) for r in own if r["directory"] != "Exif"} == {("IFD0", "ImageDescription"), ("IFD0", "ExifIFD"), ("IFD0", "ExifGPSIFD"), ("GPS", "gps.HPositioningError"), ("IFD1", "JPEGInterchangeFormat"), ("IFD1", "JPEGInterchangeFormatLength")}
    thumbs = tags.thumbnails(files(spark, **made)).collect()
    assert [(r["source"], r["kind"], r["width"], bytes(r["data"])) for r in thumbs] == [("Exif", "jpeg", None, b"\xff\xd8thumb")] * 2


def test_names_are_one_table_each():
    assert len(tags.TIFF_TAGS) == 45 and len(tags.GPS_TAGS) == 32
    assert len({(d, t) for d, t, _ in tags.NAMES}) == len(tags.NAMES) and len({n for _, _, n in tags.NAMES}) == len(tags.NAMES)


def test_damaged_directories(spark):
    good = compose.tiff("<", [(0x010E, 2, 3, b"ab\0")], [], [], b"t")
    loop = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 0x8769, 4, 1, 8) + struct.pack("<I", 8)
    made = {"cut": app1(good[:24]), "loop": app1(loop), "none": b"\xff\xd8", "empty": b"", "null": None, "text": b"hello", "order": app1(b"XX*\0" + good[4:]), "far": app1(b"II*\0" + struct.pack("<I", 1 << 31)), "type": app1(b"II*\0" + struct.pack("<IHHHII", 8, 1, 0x010E, 99, 1, 0)), "good": app1(good)}
    got = tags.tags(files(spark, **made)).collect()
    assert {r["path"] for r in got} == {"loop", "good", "cut"} and len([r for r in got if r["path"] == "loop"]) == 1
    assert [r["path"] for r in tags.thumbnails(files(spark, **made)).collect()] == ["good"]


def test_jfif(spark):
    head = b"JFIF\0\1\2\1\0\x48\0\x60"
    made = {
        "plain": compose.jpeg_of((0xE0, head + b"\0\0")), "rgb": compose.jpeg_of((0xE0, head + b"\2\1abcdef")), "cut": compose.jpeg_of((0xE0, head + b"\2\2abcdef")), "short": compose.jpeg_of((0xE0, head)), "less": compose.jpeg_of((0xE0, b"JFIF\0\1")),
        "inner": compose.jpeg_of((0xE0, head + b"\0\0"), (0xE0, b"JFXX\0\x10\xff\xd8")), "three": compose.jpeg_of((0xE0, b"JFXX\0\x13\1\1xyz")), "palette": compose.jpeg_of((0xE0, b"JFXX\0\x11\1\2" + bytes(range(256)) * 3 + b"\1\0")), "palette cut": compose.jpeg_of((0xE0, b"JFXX\0\x11\1\2" + bytes(768) + b"\1")),
    }
    heads = {r["path"]: tuple(r)[1:] for r in tags.jfif(files(spark, **made)).collect()}
    assert heads["rgb"] == (0x0102, 1, 72, 96, 2, 1) and heads["short"] == (0x0102, 1, 72, 96, 0, 0) and set(heads) == {"plain", "rgb", "cut", "short", "inner"}
    got = {r["path"]: (r["source"], r["kind"], r["width"], r["height"], bytes(r["data"])) for r in tags.thumbnails(files(spark, **made)).collect()}
    assert got == {"rgb": ("JFIF", "rgb", 2, 1, b"abcdef"), "inner": ("JFXX", "jpeg", None, None, b"\xff\xd8"), "three": ("JFXX", "rgb", 1, 1, b"xyz"), "palette": ("JFXX", "palette", 1, 2, b"\3\4\5\0\1\2")}
