import random

import pytest
from pyspark.sql import functions as F

from reelframe.operators import audio, scan, timeline
from reelframe.plans import sample_table
from reelframe.stored import materialize

ROWS = 4000


@pytest.fixture(scope="module")
def packets(spark):
    """One track of 90 % of the rows, short ones, a null track, null and repeated values."""
    rng = random.Random(21)
    rows = []
    for k in range(ROWS):
        track = 1 if rng.random() < 0.9 else rng.choice([0, 2, 3, None])
        rows.append((k % 2, track, (k * 7919) % ROWS, rng.choice([None, *[rng.randrange(ROWS)] * 9]), rng.randrange(100)))
    return spark.createDataFrame(rows, "file int, track int, at long, pts long, size long").repartition(5).cache()


@pytest.fixture
def dealt(spark, monkeypatch):
    """The tables that scans were dealt to; small partitions are not joined meanwhile."""
    found = []

    def written(df, name):
        found.append(materialize(df, name))
        return found[-1]

    monkeypatch.setattr(scan, "materialize", written)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield found
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(df):
    return sorted(map(repr, df.collect()))


def no_range_holds_it_all(dealt, keys):
    assert dealt
    for t in dealt:
        most = t.groupBy(*keys, "_part").count().agg(F.max("count")).first()[0]
        assert most <= 0.6 * ROWS


def test_running_values_of_a_split_track(packets, dealt):
    outs = {f"{kind}_{b}": (kind, F.col("pts"), b) for kind in ("sum", "max", "last") for b in (True, False)}
    one, two = (scan.scan(packets, ["track"], ["at"], outs, split) for split in (False, True))
    assert rows(one) == rows(two)
    no_range_holds_it_all(dealt, ["track"])


def test_look_ups_in_a_split_track(packets, dealt):
    right = packets.filter("size < 30").select("track", (F.col("at") + 1).alias("at"), F.col("size").alias("v"))
    one, two = (timeline.as_of(packets, right, ["track"], "at", "v", "found", split) for split in (False, True))
    assert rows(one) == rows(two) and one.filter("found IS NOT NULL").count() > ROWS / 2
    no_range_holds_it_all(dealt, ["track"])


def test_sums_of_a_split_track(packets, dealt):
    one, two = (sample_table.prefix_sum(packets, ["track"], ["at"], "size", "dts", split) for split in (False, True))
    assert rows(one) == rows(two)
    no_range_holds_it_all(dealt, ["track"])


def test_arrivals_of_a_split_track(packets, dealt):
    one, two = (timeline.arrivals(packets, "track", "at", "pts", split) for split in (False, True))
    assert rows(one) == rows(two) and one.filter("late").count() > 0
    no_range_holds_it_all(dealt, ["track"])


def test_interleaving_with_a_split_track(packets, dealt):
    p = packets.filter("track IS NOT NULL").fillna(0)
    one, two = (timeline.interleave(p, "file", "track", "at", "pts", split) for split in (False, True))
    assert rows(one) == rows(two)
    no_range_holds_it_all(dealt, ["file"])


def test_small_tables_take_one_sort(packets, dealt, monkeypatch):
    timeline.arrivals(packets, "track", "at", "pts").collect()
    assert not dealt and scan.is_small(packets)
    monkeypatch.setattr(scan, "SMALL", 10)
    timeline.arrivals(packets, "track", "at", "pts").collect()
    assert dealt


def test_scan_of_nothing(packets, dealt):
    assert scan.scan(packets.limit(0), ["track"], ["at"], {"s": ("sum", F.col("size"), False)}, True).count() == 0


@pytest.mark.parametrize("rates", [(48000, 44100), (8000, 48000), (3, 1), (7, 7)])
@pytest.mark.parametrize("split", [False, True])
def test_packets_of_any_cut_resample_as_the_joined_track(spark, rates, split):
    rng = random.Random(rates[0])
    rate_in, rate_out = rates
    tracks, rows = {t: [rng.uniform(-1, 1) for _ in range(rng.choice([1, 2, 700]))] for t in range(4)}, []
    for t, x in tracks.items():
        cuts = sorted([0, len(x), *[rng.randrange(len(x) + 1) for _ in range(rng.randrange(40))]])
        rows += [(t, k, x[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(t, -1, None), (t, 999, [])]
    df = spark.createDataFrame(rows, "track int, at int, s array<double>").repartition(4)
    got = {}
    for r in audio.resample_packets(df, ["track"], ["at"], "s", rate_in, rate_out, split).orderBy("track", "at").collect():
        if r["resampled"]:
            assert r["first"] == len(got.get(r["track"], []))
        got.setdefault(r["track"], []).extend(r["resampled"])
    for t, x in tracks.items():
        want = []
        for k in range((len(x) - 1) * rate_out // rate_in + 1):
            i, f = divmod(k * rate_in, rate_out)
            want.append(x[i] if not f else (1 - f / rate_out) * x[i] + f / rate_out * x[i + 1])
        assert got[t] == pytest.approx(want, abs=1e-12)
