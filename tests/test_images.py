import random

import pytest
from pyspark.sql import functions as F

from reelframe.functions.dims import COLOR_MATRICES, PIXEL_FORMATS
from reelframe.operators import images


def sizes(name, w, h):
    return [w * h * bpp // (8 * hss * vss) for bpp, hss, vss in PIXEL_FORMATS[name]]


def frame(rng, name, w=8, h=4):
    return name, w, h, [bytes(rng.randrange(256) for _ in range(n)) for n in sizes(name, w, h)]


SCHEMA = "format string, width int, height int, planes array<binary>"


@pytest.mark.parametrize("to", images.TARGETS)
def test_every_format_has_every_target(spark, to):
    rng = random.Random(1)
    d = spark.createDataFrame([frame(rng, n) for n in PIXEL_FORMATS], SCHEMA).withColumn("width", F.col("width"))
    got = {r["format"]: r["converted"] for r in images.convert(d, to).collect()}
    want = {"BGRA": [128], "RGBA": [128], "BGR888": [96], "BGR565": [64], "420p": [32, 8, 8]}[to]
    assert {n: [len(p) for p in c] for n, c in got.items()} == {n: want for n in PIXEL_FORMATS}


def test_same_image_in_all_layouts_is_the_same(spark):
    """A flat image has no rounding in its chroma: all layouts of Y, U, V give the same pixels."""
    y, u, v = 90, 40, 200
    of = {"Y": y, "U": u, "V": v}
    rows = []
    for name in PIXEL_FORMATS:
        n = sizes(name, 4, 4)
        if name in images.PLANAR:
            rows.append((name, 4, 4, [bytes([y]) * n[0]] + [bytes([of[c]]) * n[1] for c in images.PLANAR[name][2]]))
        elif name in images.SEMI_PLANAR:
            rows.append((name, 4, 4, [bytes([y]) * n[0], bytes(of[c] for c in images.SEMI_PLANAR[name]) * (n[1] // 2)]))
        elif name in images.PACKED_422:
            rows.append((name, 4, 4, [bytes(of[c] for c in name.upper()) * 8]))
        elif name == "yuv444":
            rows.append((name, 4, 4, [bytes([y, u, v]) * 16]))
    d = spark.createDataFrame(rows, SCHEMA)
    assert len(rows) == 13
    assert {tuple(map(bytes, r["converted"])) for r in images.convert(d, "420p").collect()} == {(bytes([y]) * 16, bytes([u]) * 4, bytes([v]) * 4)}
    assert len({bytes(r["converted"][0]) for r in images.convert(d, "BGRA").collect()}) == 1


def test_matrices_are_undone(spark):
    """RGB to Y, U, V and back is at most two levels away, in each matrix."""
    rng = random.Random(2)
    flat = [bytes(c for _ in range(4) for c in px) for px in [(0, 0, 0), (255, 255, 255), *[tuple(rng.randrange(40, 216) for _ in range(3)) for _ in range(20)]]]
    rows = [("BGR888", 2, 2, [p], m) for p in flat for m in COLOR_MATRICES]
    there = images.convert(spark.createDataFrame(rows, SCHEMA + ", matrix string"), "420p")
    back = images.convert(there.select(F.lit("420p").alias("format"), "width", "height", F.col("converted").alias("planes"), "matrix", F.col("planes").alias("own")), "BGR888")
    for r in back.collect():
        assert max(abs(a - b) for a, b in zip(bytes(r["converted"][0]), bytes(r["own"][0]))) <= 3


def test_565_keeps_its_bits(spark):
    words = b"".join(k.to_bytes(2, "little") for k in range(0, 65536, 7))[: 2 * 9360]
    d = spark.createDataFrame([("BGR565", 9360, 1, [words])], SCHEMA)
    assert bytes(images.convert(d, "BGR565").first()["converted"][0]) == words


def test_images_that_do_not_fit_are_null(spark):
    ok = bytes(24)
    rows = [("420p", 4, 4, [ok[:16], ok[:4], ok[:4]], None), ("420p", 4, 4, [ok[:16], ok[:4]], None), ("420p", 5, 4, [ok, ok, ok], None), ("BGRA", 4, 4, [ok], None), ("none", 4, 4, [ok], None), (None, 4, 4, [ok], None), ("BGRA", None, 4, [ok], None), ("BGRA", 1, 1, None, None), ("BGRA", 1, 1, [None], None), ("BGRA", 2, 2, [ok[:16]], "xyz"), ("BGRA", -2, -2, [ok], None)]
    got = images.convert(spark.createDataFrame(rows, SCHEMA + ", matrix string").coalesce(1), "BGRA").collect()
    assert [r["converted"] is not None for r in got] == [True] + [False] * 10
    assert images.convert(spark.createDataFrame([("BGRA", 1, 1, [ok[:4]])], SCHEMA), "420p").first()["converted"] is None
    with pytest.raises(ValueError, match="no target"):
        images.convert(spark.createDataFrame([], SCHEMA), "nv12")
