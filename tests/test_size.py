"""What must not grow with the input: what goes through the driver, and what a task holds."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelframe.functions import pcm
from reelframe.operators import scan
from reelframe.plans import sample_table
from reelframe.queries import QUERIES, registry
from reelframe.sources import compose, media, packetizer, ranged
from reelframe.stored import materialize
from tests.oracle import SF


def broadcasts(df):
    """Joins by broadcast in the plan that has run, without the carries of scan(), which are fewer than partitions."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_part#" not in line]


def test_sample_tables_are_not_broadcast(spark):
    files = spark.createDataFrame([(f"f{k}", compose.mp4([b"x" * (j + 1) for j in range(7)])) for k in range(5)], "path string, content binary")
    found = media.mp4_samples(files)
    assert broadcasts(found) == [] and found.count() == 35
    assert broadcasts(media.packets(found, files)) == []
    runs = spark.createDataFrame([("a", 0, 9)], "track string, entry long, count long")
    totals = spark.createDataFrame([("a", 4)], "track string, total long")
    held = sample_table.expand_runs(runs, ["track"], ["entry"], "count", totals=totals)
    assert broadcasts(held) == [] and held.count() == 4


def test_preroll_is_not_broadcast(spark):
    assert broadcasts(QUERIES["preroll_by_bytes"](spark, SF)) == []


def test_dumped_packets_are_not_listed_by_the_driver(spark):
    found = QUERIES["packet_dump"](spark, SF)
    assert found.inputFiles() == [] and found.count() == registry.table(spark, SF, "documents").count()


def test_streams_are_not_broadcast(spark):
    pieces = spark.createDataFrame([(f"s{k}", 0, compose.mp3(b"x" * 3000)) for k in range(40)], "path string, seq int, data binary")
    found = packetizer.packetize(pieces)
    assert broadcasts(found) == [] and found.count() == 40 * 8


def test_groups_that_batches_cut_stay_whole():
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), pa.array([k for _, k in rows])], names=["path", "at"])
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 1), ("d", 1), ("d", 2)]
    for n in (1, 2, 3, 9):
        got = []
        for some, at in packetizer._whole(iter([batch(rows[i : i + n]) for i in range(0, len(rows), n)]), ["path"]):
            paths = some.column("path").to_pylist()
            got += [tuple(paths[a:b]) for a, b in zip(at, at[1:])]
        assert got == [("a", "a"), ("b",) * 4, ("c",), ("d", "d")]


def test_only_the_ebml_header_starts_a_matroska_file():
    words = [w.encode() for w in ("Das er und", "{ und", "\u05d0BDas", "B\u0702 und")]
    assert [media._matroska_score(w + b" der " * 20) for w in words] == [0] * 4
    assert media._matroska_score(compose.mkv([[b"x"]])) == 100


def test_long_texts_are_no_bounds_of_ranges(spark, monkeypatch):
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return materialize(df, name)

    monkeypatch.setattr(scan, "materialize", written)
    start = "x" * 200
    rows = [(f"t{k % 2}", k // 8, (start + str(k % 5)).encode()) for k in range(64)]
    df = spark.createDataFrame(rows, "track string, at long, data binary")
    got = scan.scan(df, ["track"], ["at", "data"], {"n": ("sum", F.lit(1).cast("long"), False)}, split=True).collect()
    dealt = next(line for line in plans[0].splitlines() if "RepartitionByExpression" in line)
    assert "substring(data" in dealt and "substring(track" in dealt
    for track in ("t0", "t1"):
        want = sorted(r[1:] for r in rows if r[0] == track)
        assert [(r["at"], bytes(r["data"])) for r in sorted((r for r in got if r["track"] == track), key=lambda r: r["n"])] == want
        assert sorted(r["n"] for r in got if r["track"] == track) == list(range(1, 33))
    some = scan.scan(df, ["track"], ["data", "at"], {"n": ("sum", F.lit(1).cast("long"), False)}, split=True).collect()
    for track in ("t0", "t1"):
        assert [(bytes(r["data"]), r["at"]) for r in sorted((r for r in some if r["track"] == track), key=lambda r: r["n"])] == sorted((d, k) for t, k, d in rows if t == track)


class Rows:
    """Stands for a DataFrame whose mapInArrow() gives the function itself."""

    schema = StructType().add("path", "string").add("data", "binary")

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_made_files_go_on_in_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * 500_000, None] * 20)], names=["doc_id", "text"])
    got = list(registry.made(Rows(), lambda doc, text: [(f"doc/{doc}", (text or "").encode())])(iter([batch])))
    assert [p for b in got for p in b.column("path").to_pylist()] == [f"doc/{k}" for k in range(40)]
    assert [len(c) for b in got for c in b.column("content").to_pylist()] == [500_000, 0] * 20
    assert max(b.nbytes for b in got) < registry.MOST + 600_000


def test_appended_columns_go_on_in_small_batches(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(50)]), pa.array([b"\0\0\1" * 60_000, None] * 25)], names=["path", "data"])
    got = list(pcm.decoded(Rows(), "s24")(iter([batch])))
    assert [p for b in got for p in b.column("path").to_pylist()] == [str(k) for k in range(50)]
    assert [b and len(b) for g in got for b in g.column("samples").to_pylist()] == [60_000, None] * 25
    assert len(got) > 2 and max(len(g) for g in got) < 25


def test_many_files_make_few_partitions(tmp_path):
    for k in range(200):
        (tmp_path / f"{k}.wav").write_bytes(b"x")
    reader = lambda **more: ranged.MediaReader({"path": str(tmp_path), **more}, StructType().add("path", "string"))
    some = reader(parts="3").partitions()
    assert len(some) == 3 and [p for x in some for p in x.paths] == sorted(f"{tmp_path}/{k}.wav" for k in range(200))
    assert len(reader().partitions()) == 7 and len(reader(parts="100").partitions()) == 7
    one = ranged.MediaReader({"path": f"{tmp_path}/7.wav"}, StructType().add("path", "string")).partitions()
    assert [x.paths for x in one] == [[f"{tmp_path}/7.wav"]]
    (tmp_path / "none").mkdir()
    assert [x.paths for x in ranged.MediaReader({"path": f"{tmp_path}/none"}, StructType().add("path", "string")).partitions()] == [[]]


def test_decoding_times_are_summed_over_runs(spark, monkeypatch):
    """Only lines are dealt out, once; the samples made of them are neither dealt out nor written, however large the table is."""
    written = []
    monkeypatch.setattr(scan, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(scan, "SMALL", 0)
    found = QUERIES["dts_prefix"](spark, SF)
    rows = found.count()
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert written == [] and plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan
    assert rows > registry.table(spark, SF, "lineitem").count()


def test_sums_over_runs_with_gaps(spark):
    runs = [("a", 0, 2, 5), ("a", 1, 0, 9), ("a", 2, -3, 9), ("a", 3, 3, None), ("a", 4, None, 9), ("a", 5, 2, 7), (None, 0, 2, 4), ("b", 0, 4294967295, 4294967295)]
    df = spark.createDataFrame(runs, "track string, entry long, count long, delta long")
    got = sample_table.expand_runs(df.filter("track IS NULL OR track = 'a'"), ["track"], ["entry"], "count", sums={"dts": "delta"})
    want = [(None, 0, 0), (None, 1, 4)] + [("a", k, t) for k, t in enumerate([0, 5, 10, 10, 10, 10, 17])]
    assert sorted(((r["track"], r["sample_idx"], r["dts"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    totals = spark.createDataFrame([("a", 6), ("b", 3)], "track string, total long")
    held = sample_table.expand_runs(df, ["track"], ["entry"], "count", totals=totals, sums={"dts": "delta"})
    want = [("a", k, t) for k, t in enumerate([0, 5, 10, 10, 10, 10])] + [("b", k, k * 4294967295) for k in range(3)]
    assert sorted((r["track"], r["sample_idx"], r["dts"]) for r in held.collect()) == want


def plain_samples(stts, ctts, per_chunk, offsets, sizes, stss, sdtp):
    """What sample_table.build() gives of one track, by loops."""
    deltas = [d for n, d in stts for _ in range(n)]
    shifts = [x for n, x in ctts for _ in range(n)]
    chunks = [c for c, n in enumerate(per_chunk, 1) for _ in range(n)]
    total = min(len(sizes), len(deltas), len(chunks))
    out, dts, at = [], 0, 0
    synced = any(0 <= k < total for k in stss)
    for k in range(total):
        at = at + sizes[k - 1] if k and chunks[k - 1] == chunks[k] else offsets[chunks[k] - 1]
        pts = dts + (shifts[k] if k < len(shifts) else 0)
        byte = sdtp[k] if k < len(sdtp) else 0
        flags = (not synced or k in stss or byte >> 4 & 3 == 2) + 4 * (byte >> 2 & 3 == 2)
        out.append((k, chunks[k], at, sizes[k], dts, pts if pts >= 0 else dts, flags))
        dts += deltas[k]
    return out


def built(spark, tracks):
    """sample_table.build() of the tables of some tracks: stts, ctts, per_chunk, offsets, sizes, stss, sdtp of each."""
    table = lambda cols, rows: spark.createDataFrame(list(rows), "track string, " + ", ".join(f"{c} long" for c in cols.split())).repartition(3)
    of = lambda k, f: [(t, *f(j, x)) for t, parts in tracks.items() for j, x in enumerate(parts[k])]
    return sample_table.build(
        table("entry count delta", of(0, lambda j, x: (j, *x))),
        table("entry count shift", of(1, lambda j, x: (j, *x))),
        table("first_chunk per_chunk", of(2, lambda j, x: (j + 1, x))),
        table("chunk chunk_offset", of(3, lambda j, x: (j + 1, x))),
        table("sample_idx size", of(4, lambda j, x: (j, x))),
        table("sample_idx", of(5, lambda j, x: (x,))),
        ["track"],
        table("sample_idx depends", of(6, lambda j, x: (j, x))),
    )


def test_blocks_of_samples_join_as_the_whole_track(spark, monkeypatch):
    rng, tracks = random.Random(4), {}
    for k in range(30):
        n = rng.choice([1, 3, 4, 5, 8, 30, 61])
        cut = lambda most: [rng.randrange(most + 1) for _ in range(rng.randrange(1, 3 * n))]  # noqa: E731, B023
        per_chunk = rng.choice([[n], [5] * (n // 5 + 1), cut(3), cut(20)])
        tracks[f"t{k}"] = (
            [(c, rng.randrange(50)) for c in rng.choice([[n], [1] * n, cut(9)])],
            [(c, rng.randrange(-40, 40)) for c in rng.choice([[], [n], [1] * n, cut(9)])],
            per_chunk,
            [1000 * (c + 1) for c in range(len(per_chunk))],
            [rng.randrange(90) for _ in range(n)],
            rng.choice([[], [0], [n], sorted(rng.sample(range(2 * n), n))]),
            [rng.randrange(256) for _ in range(rng.choice([0, n, n // 2]))],
        )
    tracks["long counts"] = ([(4294967295, 4294967295)], [], [4294967295], [7], [2] * 9, [], [])
    want = [(t, *row) for t, parts in tracks.items() if t != "long counts" for row in plain_samples(*parts)]
    want += [("long counts", k, 1, 7 + 2 * k, 2, k * 4294967295, k * 4294967295, 1) for k in range(9)]
    for run in (65_536, 4):
        monkeypatch.setattr(sample_table, "RUN", run)
        assert sorted(map(tuple, built(spark, tracks).collect())) == sorted(want)


def test_rows_of_sample_tables_are_dealt_out_once(spark, monkeypatch):
    """No join of samples by their number, no sort of a track's samples for its offsets or its sync samples, and none are written."""
    tracks = {f"t{k}": ([(9, 2)], [(9, 1)], [4, 5], [100, 200], [3] * 9, [0, 4], []) for k in range(3)}
    written = []
    monkeypatch.setattr(scan, "materialize", lambda df, name: written.append(df.columns) or materialize(df, name))
    found = built(spark, tracks)
    assert found.count() == 27 and broadcasts(found) == []
    assert all("size" not in columns for columns in written)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Exchange " in line]
    assert dealt and not any("sample_idx#" in line.split("partitioning(")[1] for line in dealt if "partitioning(" in line)
    assert all("size" not in line and "depends" not in line for line in dealt if "rangepartitioning" in line)
