import random

import pytest
from pyspark.sql import functions as F

from reelframe.streaming import packets, reorder


def stream_of(spark, tmp_path, rows, schema, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts == 1 else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_packets_across_batches(spark, tmp_path):
    pts = [5, 3, 9, 9, 8, 12, 1, 13]
    rows = [(1, k, p) for k, p in enumerate(pts)]
    s = stream_of(spark, tmp_path, rows, "track long, seq long, pts long", 3)
    got = packets.drain(packets.late_packets(s), str(tmp_path / "out"), str(tmp_path / "cp")).orderBy("seq").collect()
    assert [r["late"] for r in got] == [k > 0 and p < max(pts[:k]) for k, p in enumerate(pts)]
    assert [r["clock"] for r in got] == [None, *(max(pts[:k]) for k in range(1, len(pts)))]


def test_decoder_states(spark, tmp_path):
    kinds = ["packet", "packet", "packet", "seek", "packet", "packet", "end", "packet"]
    s = stream_of(spark, tmp_path, [(1, k, x) for k, x in enumerate(kinds)], "track long, seq long, kind string", 2)
    got = packets.drain(packets.decoder_states(s), str(tmp_path / "out"), str(tmp_path / "cp")).orderBy("seq").collect()
    assert [r["state"] for r in got] == ["preparing", "ready", "decoding", "preparing", "preparing", "ready", "ended", "ended"]


def test_equal_seeks_are_one(spark, tmp_path):
    rows = [(1, 100 + k, t) for k, t in enumerate([5, 5, 7, 5])]
    s = stream_of(spark, tmp_path, rows, "track long, us long, time long", 1).withColumn("at", F.timestamp_micros("us"))
    got = packets.drain(packets.first_seeks(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["time"] for r in got.collect()) == [5, 7]


def plain_order(rows):
    """The two slots as they are described: one ahead, one before it."""
    out, ahead, before, ended = [], None, None, False
    for seq, kind, pts in rows:
        if kind == "seek":
            ahead = before = None
            ended = False
        elif ended:
            continue
        elif kind == "end":
            out += [(x, "end") for x in (before, ahead) if x is not None]
            ahead, before, ended = None, None, True
        elif ahead is None:
            ahead = pts
        elif pts > ahead:
            out += [(x, "order") for x in (before, ahead) if x is not None]
            ahead, before = pts, None
        elif before is None:
            before = pts
        elif pts > before:
            out.append((before, "order"))
            before = pts
        else:
            out.append((pts, "order"))
    return out, [x for x in (before, ahead) if x is not None]


@pytest.fixture
def stateful(spark):
    before = spark.conf.get(reorder.PROVIDER[0])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    reorder.configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(reorder.PROVIDER[0], before)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_frames_in_order_of_presentation(spark, tmp_path, stateful):
    rng = random.Random(5)
    rows, want = [], {}
    for track in range(3):
        own = []
        for g in range(4):  # groups as decoders put them out: I0 P4 B2 P8 B6 ...
            pts = [100 * g, *(x + 100 * g for k in range(4, 30, 4) for x in (k, k - 2))]
            own += [("packet", p) for p in pts] + [(rng.choice(["end", "seek", "packet"]), 100 * g + 31)]
        own += [("packet", 1000), ("packet", 998), ("end", None), ("packet", 5)]
        own = [(k, *x) for k, x in enumerate(own)]
        want[track] = plain_order(own)[0]
        rows += [(track, seq, kind, pts, seq) for seq, kind, pts in own]
    rows.sort(key=lambda r: r[1])
    s = stream_of(spark, tmp_path, rows, "track long, seq long, kind string, pts long, us long", 5).withColumn("at", F.timestamp_millis(F.col("us") + 1000))
    got = packets.drain(reorder.in_order(s), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    for track in range(3):
        mine = [(r["pts"], r["why"]) for r in got if r["track"] == track]
        assert sorted(mine) == sorted(want[track]) and any(why == "end" for _, why in mine)


def test_a_pause_shows_what_is_held(spark, tmp_path, stateful):
    rows = [(1, 0, "packet", 40, 0), (1, 1, "packet", 20, 10), (2, 0, "packet", 7, 20), (2, 1, "packet", 9, 60_000), (2, 2, "packet", 11, 90_000)]
    s = stream_of(spark, tmp_path, rows, "track long, seq long, kind string, pts long, ms long", 5).withColumn("at", F.timestamp_millis(F.col("ms") + 1000))
    got = packets.drain(reorder.in_order(s), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert [(r["pts"], r["why"]) for r in got if r["track"] == 1] == [(20, "pause"), (40, "pause")]
    assert {r["pts"] for r in got if r["track"] == 2} >= {7, 9}
