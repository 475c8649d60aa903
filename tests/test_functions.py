import os
import random

from pyspark.sql import functions as F

from reelframe import stored
from reelframe.functions import bits, color, configs, dims, pcm, rational
from reelframe.operators import timeline


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_rational_times(spark):
    lit = lambda x: F.lit(x).cast("long")
    got = one(
        spark,
        rational.add(lit(0), lit(1000000), lit(1), lit(2)),
        rational.add(lit(1), lit(2), lit(1), lit(3)),
        rational.subtract(lit(5), lit(6), lit(1), lit(3)),
        rational.microseconds(lit(1), lit(2)),
        rational.microseconds(lit(-7), lit(2000000)),
        rational.reduced(lit(2), lit(4)),
        rational.reduced(lit(-1), lit(0)),
        rational.microseconds(lit(1 << 60), lit(1 << 40)),
    )
    assert [tuple(x) if isinstance(x, tuple) else x for x in got] == [(1, 2), (5, 6), (1, 2), 500000, -3, (1, 2), None, (1 << 20) * 1000000]


def test_saturation_and_rounding(spark):
    x = F.array(*(F.lit(v) for v in (-2.0, -1.0, 0.5 / 32768, 1.5 / 32768, 0.99999, 2.0)))
    assert one(spark, pcm.float_to_s16(x))[0] == [-32768, -32768, 0, 2, 32767, 32767]
    assert one(spark, pcm.float_to_s32(x))[0][0::5] == [-(1 << 31), (1 << 31) - 1]


def test_layouts_are_inverse(spark):
    a = F.array(*map(F.lit, range(12)))
    assert one(spark, pcm.interleave(pcm.planarize(a, 3, 4)))[0] == list(range(12))


def test_bits(spark):
    assert one(spark, bits.exp_golomb(F.lit("00101")), bits.exp_golomb(F.lit("1")), bits.exp_golomb(F.lit("0001")), bits.exp_golomb(F.lit("000"))) == (4, 0, None, None)
    assert one(spark, bits.fourcc_text(bits.fourcc(F.lit("mp4 "))))[0] == "mp4 "


def test_interleave_is_the_greedy_merge(spark):
    rng = random.Random(5)
    rows = [(f, t, k, rng.randrange(12)) for f in range(60) for t in range(3) for k in range(rng.randrange(6))]
    want = {}
    for f in range(60):
        left = {t: [r for r in rows if r[0] == f and r[1] == t] for t in range(3)}
        n = 0
        while any(left.values()):
            t = min((t for t in left if left[t]), key=lambda t: (left[t][0][3], -t))
            want[left[t].pop(0)] = n
            n += 1
    df = spark.createDataFrame(rows, "file int, track int, idx int, at int")
    got = {tuple(r)[:4]: r["position"] for r in timeline.interleave(df, "file", "track", "idx", "at").collect()}
    assert got == want


def test_a_seek_past_the_end_and_before_the_start(spark):
    df = spark.createDataFrame([(1, k, 10 * k, k == 2) for k in range(5)] + [(2, 0, 7, False)], "track int, id int, pts long, sync boolean")
    got = {r["track"]: (r["cur"], r["start"]) for r in timeline.seek(df, "track", "pts", ["id"], F.col("sync")).collect()}
    assert got == {1: (2, 2), 2: (0, 0)}


def test_as_of_without_a_match_is_null(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (2, 1, "c")], "k int, at long, name string")
    right = spark.createDataFrame([(1, 10, 7), (1, 10, 9), (1, 11, 8)], "k int, at long, v int")
    got = {r["name"]: r["o"] for r in timeline.as_of(left, right, ["k"], "at", "v", "o").collect()}
    assert got == {"a": None, "b": 9, "c": None}


def test_audio_configurations():
    bits = lambda *fields: int("".join(f"{v:0{n}b}" for v, n in fields).ljust(-(-sum(n for _, n in fields) // 8) * 8, "0"), 2).to_bytes(-(-sum(n for _, n in fields) // 8), "big")
    plain = configs.audio_specific_config(bits((2, 5), (4, 4), (2, 4), (0, 3)))
    assert (plain["object_type"], plain["rate"], plain["channels"], plain["frame_samples"], plain["sbr"]) == (2, 44100, 2, 1024, False)
    odd = configs.audio_specific_config(bits((31, 5), (10, 6), (15, 4), (12345, 24), (1, 4)))
    assert (odd["object_type"], odd["rate"], odd["channels"]) == (42, 12345, 1)
    he = configs.audio_specific_config(bits((29, 5), (7, 4), (1, 4), (4, 4), (2, 5), (1, 1), (0, 2)))
    assert (he["object_type"], he["rate"], he["extension_rate"], he["sbr"], he["ps"], he["frame_samples"]) == (2, 22050, 44100, True, True, 960)
    later = configs.audio_specific_config(bits((2, 5), (7, 4), (1, 4), (0, 3), (0x2B7, 11), (5, 5), (1, 1), (4, 4), (0x548, 11), (1, 1)))
    assert (later["sbr"], later["ps"], later["extension_rate"]) == (True, True, 44100)
    assert configs.audio_specific_config(b"") is None


def test_decoder_configurations_round_trip():
    sps, pps = [b"\x67\x64\x00\x1f\xac", b"\x67\x42\x00\x1e"], [b"\x68\xee"]
    body = configs.compose_avcc(sps, pps, 2)
    got = configs.avcc(body)
    assert (got["profile"], got["level"], got["nal_length"], got["sps"], got["pps"]) == (0x64, 0x1F, 2, sps, pps)
    assert all(configs.avcc(body[:n]) is None for n in range(len(body)))
    assert [configs.h264_kind(x) for x in (body, b"\0\0\0\1\x67", b"\0\0\1\x67", b"abc")] == ["avcC", "annexB", "annexB", None]
    for size in (0, 2, 200, 40_000):
        found = configs.esds(configs.compose_esds(0x40, bytes(size), 96_000))
        assert (found["object_type"], found["stream_type"], found["avg_bitrate"], found["csd"]) == (0x40, 5, 96_000, bytes(size))
    assert configs.esds(b"\0\0\0\0\3\x90") is None and configs.descriptor_size(300) == b"\x82\x2c"


def test_nal_units():
    assert configs.nal_unit(b"\x65\x88\x80") == {"ref_idc": 3, "type": 5, "first_mb": 0, "slice_type": 7}
    assert configs.nal_unit(b"\x67\x42") == {"ref_idc": 3, "type": 7, "first_mb": None, "slice_type": None}
    assert configs.nal_unit(b"\x80") is None and configs.nal_unit(b"") is None and configs.nal_unit(b"\x65") is None


def test_times_beyond_64_bits_are_null(spark):
    lit = lambda v: F.lit(v).cast("long")
    big, fine, gcds = one(spark, rational.add(lit(1 << 62), lit(3), lit(1), lit(7)), rational.add(lit(-3), lit(4), lit(1), lit(4)), F.array(*(rational.gcd(lit(a), lit(b)) for a, b in ((0, 0), (0, 5), (7, 0), (1 << 62, 6), (7540113804746346429, 4660046610375530309), (-12, 18)))))
    assert big is None and tuple(fine) == (-1, 2)
    assert gcds == [0, 5, 7, 2, 1, 6]


def test_clock_waits_for_its_master(spark):
    rows = [(1, 0, "set", 500.0), (2, 10, "start", None), (3, 110, "pause", None), (4, 200, "set", 500.0), (5, 300, "register", None), (6, 400, "start", None), (7, 500, "update", 1000.0), (8, 600, "update", 10.0), (9, 700, "speed", 2.0), (10, 800, "pause", None)]
    log = spark.createDataFrame([("c", *r) for r in rows], "clock string, seq int, at_us long, cmd string, arg double")
    states = timeline.clock_states(log, "clock", ["seq"])
    got = [(r["media_us"], r["started"], r["ticking"]) for r in states.orderBy("seq").collect()]
    assert got == [(500, False, False), (500, True, True), (600, False, False), (500, False, False), (500, False, False), (500, True, False), (1000, True, True), (1100, True, True), (1200, True, True), (1400, False, False)]
    reads = spark.createDataFrame([("c", t) for t in (-5, 0, 60, 450, 550, 750, 900)], "clock string, us long")
    assert {r["us"]: r["media_us"] for r in timeline.clock_reads(reads, states, "clock", "us", "seq").collect()} == {-5: 0, 0: 500, 60: 550, 450: 500, 550: 1050, 750: 1300, 900: 1400}


def test_stored_tables_are_swept(spark):
    kept, gone = stored.materialize(spark.range(3), "kept"), stored.materialize(spark.range(2), "gone")
    assert kept.count() == 3 and gone.count() == 2
    stored.discard(gone)
    paths = [gone._written_to, kept._written_to]
    assert [os.path.exists(p) for p in paths] == [False, True] and paths[0] not in stored._written
    left = set(stored._written) - {paths[1]}
    stored._written.difference_update(left)
    stored.sweep(spark)
    assert not os.path.exists(paths[1])
    stored._written.update(left)


def test_formats_by_their_planes(spark):
    names = [n for n, planes in dims.PIXEL_FORMATS.items()]
    d = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["p"], r["s"]) for r in d.select("name", color.is_planar(F.col("name")).alias("p"), color.is_semi_planar(F.col("name")).alias("s")).collect()}
    assert got == {n: (len(p) == 3, len(p) == 2) for n, p in dims.PIXEL_FORMATS.items()}
    assert tuple(one(spark, pcm.is_raw(F.lit("s16")), pcm.is_raw(F.lit("f64-packed")), pcm.is_raw(F.lit("aac")))) == (True, True, False)


def test_samples_beyond_all_bounds_saturate(spark):
    values = [float("inf"), float("-inf"), float("nan"), 9e20, -9e20, 1.0, -1.0, 0.5, 0.0]
    df = spark.createDataFrame([(values,)], "x array<double>")
    r = df.select(pcm.float_to_s16(F.col("x")).alias("a"), pcm.float_to_s32(F.col("x")).alias("b")).first()
    assert r["a"] == [32767, -32768, 0, 32767, -32768, 32767, -32768, 16384, 0]
    assert r["b"] == [2**31 - 1, -(2**31), 0, 2**31 - 1, -(2**31), 2**31 - 1, -(2**31), 2**30, 0]
