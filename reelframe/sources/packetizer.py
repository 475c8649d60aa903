"""Units of byte streams that are cut anywhere: MPEG audio frames, and H.264 units behind start codes.

A stream's frames follow each other: one starts at the first header at or after the end of the last one that agrees with the
stream's. So where a part of the stream begins can be known only from the part before. Instead of reading a stream from
its start, each block of it finds its headers by itself, and what it does with every place that its first frame may start from: where
its last frame then ends, and how many there are. These few rows a block are joined end to end; then each block
gives its frames, with their numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions.bits import mpeg_header
from reelframe.functions.configs import mpeg_frame
from reelframe.operators.scan import scan
from reelframe.sources.media import SAME_STREAM
from reelframe.sources.ranged import fetch, ranged, read
from reelframe.stored import materialize

#: Bytes of a stream that a task looks through at a time.
BLOCK = 16 << 20
#: What the bits of a header from version to padding give as a frame's length; 0 if they are not valid.
LENGTHS = np.array([(mpeg_frame(0xFFE00000 | bits << 9) or {"length": 0})["length"] for bits in range(1 << 12)])
LONGEST = int(LENGTHS.max())


def _headers(data: bytes, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, header, frame length) of all valid headers that start in the first `own` bytes."""
    raw = np.frombuffer(data, np.uint8)
    last = min(own, len(raw) - 3)
    if last <= 0:
        return (np.empty(0, np.int64),) * 3
    at = np.flatnonzero((raw[:last] == 255) & (raw[1 : last + 1] >= 0xE0))
    head = sum(raw[at + k].astype(np.int64) << 24 - 8 * k for k in range(4))
    length = LENGTHS[head >> 9 & 0xFFF]
    return at[length > 0], head[length > 0], length[length > 0]


_CANDIDATES = "path string, block long, at long, head long, until long"


def _candidates(path: str, start: int, data: bytes, own: int, block: int) -> pa.RecordBatch:
    at, head, length = _headers(data, own)
    at = at + start
    return pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), *map(pa.array, (at // block, at, head, at + length))], names=["path", "block", "at", "head", "until"])


def placed(pieces: DataFrame) -> DataFrame:
    """path, start, data: pieces (path, seq, data) of streams, laid end to end in order of seq. Null data is empty."""
    some = pieces.select("path", "seq", F.coalesce("data", F.lit(b"")).alias("data"))
    found = scan(some, ["path"], ["seq"], {"start": ("sum", F.octet_length("data").cast("long"), True)})
    return found.select("path", F.coalesce("start", F.lit(0)).alias("start"), "data")


def blocks(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, start, data: pieces (path, start, data) of any sizes put together to blocks, each with the 3 bytes after it."""
    end = F.col("start") + F.octet_length("data")
    some = pieces.filter("octet_length(data) > 0")
    first = F.greatest(F.lit(0), F.floor((F.col("start") - 3) / block))
    each = some.withColumn("block", F.explode(F.sequence(first, F.floor((end - 1) / block))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(end, (F.col("block") + 1) * block + 3)
    part = F.call_function("substring", F.col("data"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    parts = each.select("path", "block", low.alias("at"), part.alias("part")).filter("octet_length(part) > 0")
    whole = parts.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))

    @F.pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda some: b"".join(p["part"] for p in some))

    return whole.select("path", (F.col("block") * block).alias("start"), joined("parts").alias("data"))


def headers(of: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, block, at, head, until: every place of blocks (path, start, data) that could start a frame."""

    def run(batches):
        for batch in batches:
            for path, start, data in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), batch.column("data")):
                yield _candidates(path, start, data.as_py(), block, block)

    return of.select("path", "start", "data").mapInArrow(run, _CANDIDATES)


def file_headers(spark: SparkSession, folder: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """headers() of the files at a path, of which each task reads blocks by their range, and (path, length) of the files."""
    files = read(spark, folder).select("path", "length")
    dealt = files.withColumn("k", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L) div {block})"))).withColumn("start", F.col("k") * block)
    dealt = dealt.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                data = ranged(path)
                try:
                    yield _candidates(path, start, data.direct(start, block + 3), block, block)
                finally:
                    data.file.close()

    return dealt.select("path", "start").mapInArrow(run, _CANDIDATES), files


def _chain(at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For frames from each place on: (the next one, where the last one ends, how many there are)."""
    after = np.searchsorted(at, until)
    nxt, ends, counts = after.tolist(), until.tolist(), [1] * len(at)
    for k in range(len(at) - 1, -1, -1):
        if nxt[k] < len(nxt):
            ends[k], counts[k] = ends[nxt[k]], counts[nxt[k]] + 1
    return after, np.array(ends, np.int64), np.array(counts, np.int64)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """(rows, where their groups start, and their end): sorted rows put together so that no group of the keys is cut."""

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.ones(rows.num_rows, bool)
        new[1:] = False
        for k in keys:
            column = rows.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy()
        return np.flatnonzero(new)

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows and (last := int((at := starts(held))[-1])):
            yield held.slice(0, last), at.tolist()
            held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield held, [*starts(held).tolist(), held.num_rows]


def _by_group(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, list[int]], pa.Table], schema: str) -> DataFrame:
    """What run(rows, starts) makes of many groups of the keys at once, each in order; a task gets whole groups."""

    def each(batches):
        for some, at in _whole(batches, keys):
            yield from run(some, at).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy() for n in names]


def frames(found: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The frames of streams, as media.mp3_frames() has them, from their headers (of headers() or file_headers()) and
    lengths (path, length).

    A stream's kind is that of the first header which an agreeing one follows at its end; streams without one have no
    frames. Frames that are cut off at the end don't count, and what can't be a frame is skipped. A block is one task's work; of a
    stream only some rows a block meet in one task. Joins are merged, as there may be as many streams as one likes.
    """
    kind = F.col("head").bitwiseAND(F.lit(SAME_STREAM))
    all_ = materialize(found.withColumn("kind", kind), "mpeg-headers")
    nxt = all_.select("path", F.col("at").alias("until"), "kind")
    first = all_.join(nxt.hint("merge"), ["path", "until", "kind"], "left_semi").groupBy("path").agg(F.min_by("kind", "at").alias("kind"), F.min("at").alias("from"))
    streams = first.join(lengths.hint("merge"), "path")
    real = all_.withColumnRenamed("kind", "_kind").join(streams.hint("merge"), "path").filter("_kind = kind AND at >= from AND until <= length").select("path", "block", "at", "head", "until")

    def ways(rows: pa.Table, starts: list[int]) -> pa.Table:
        at, until, of = _numbers(rows, "at", "until", "block")
        taken, ends, counts = [], [], []
        for a, b in pairwise(starts):
            _, end, n = _chain(at[a:b], until[a:b])
            some = min(b - a, int(np.searchsorted(at[a:b], of[a] * block + LONGEST)) + 1)
            taken.append(np.arange(a, a + some))
            ends.append(end[:some])
            counts.append(n[:some])
        got = rows.select(["path", "block", "at"]).take(np.concatenate(taken)).rename_columns(["path", "block", "upto"])
        return got.append_column("end", pa.array(np.concatenate(ends))).append_column("n", pa.array(np.concatenate(counts)))

    def stitched(rows: pa.Table, starts: list[int]) -> pa.Table:
        of, upto, end, n = (x.tolist() for x in _numbers(rows, "block", "upto", "end", "n"))
        taken, entries, numbers = [], [], []
        for a, b in pairwise(starts):
            at, number, k = 0, 0, a
            while k < b:
                taken.append(k)
                entries.append(at)
                numbers.append(number)
                own = of[k]
                while k < b and of[k] == own and upto[k] < at:
                    k += 1
                if k < b and of[k] == own:
                    at, number = end[k], number + n[k]
                while k < b and of[k] == own:
                    k += 1
        got = rows.select(["path", "block"]).take(pa.array(taken, pa.int64()))
        return got.append_column("entry", pa.array(entries, pa.int64())).append_column("number", pa.array(numbers, pa.int64()))

    def taken(rows: pa.Table, starts: list[int]) -> pa.Table:
        at, until, entry, number = _numbers(rows, "at", "until", "entry", "number")
        out, numbers = [], []
        for a, b in pairwise(starts):
            nxt = np.searchsorted(at[a:b], until[a:b]).tolist()
            k, first = int(np.searchsorted(at[a:b], entry[a])), len(out)
            while k < b - a:
                out.append(a + k)
                k = nxt[k]
            numbers.append(number[a] + np.arange(len(out) - first))
        got = rows.select(["path", "at", "head"]).take(pa.array(out, pa.int64()))
        return pa.table([got.column("path"), pa.array(np.concatenate(numbers), pa.int64()), got.column("at"), got.column("head")], ["path", "frame_idx", "offset", "head"])

    by_block = _by_group(real, ["path", "block"], ["at"], ways, "path string, block long, upto long, end long, n long")
    entries = _by_group(by_block, ["path"], ["block", "upto"], stitched, "path string, block long, entry long, number long")
    got = _by_group(real.join(entries.hint("merge"), ["path", "block"]), ["path", "block"], ["at"], taken, "path string, frame_idx long, offset long, head long")
    full = got.select("path", "frame_idx", "offset", *(c.alias(n) for n, c in mpeg_header(F.col("head")).items()))
    return full.select("path", "frame_idx", "offset", "frame_length", "bitrate", "sample_rate", "channels", "samples", (F.col("frame_idx") * F.col("samples")).alias("pts"))


def packetize(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """The frames of streams that come in pieces (path, seq, data), cut anywhere. Places are those in the whole stream."""
    laid = placed(pieces)
    lengths = laid.groupBy("path").agg(F.max(F.col("start") + F.octet_length("data")).alias("length"))
    return frames(headers(blocks(laid, block), block), lengths, block)


def packetize_files(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """The frames of the MPEG audio files at a path; each block is read by its range, so a long file is read by many tasks.
    ranged.fetch() reads their bytes."""
    found, lengths = file_headers(spark, folder, block)
    return frames(found, lengths, block)


def annexb_units(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """path, unit_idx, offset, size, data: the units of the Annex B streams at a path.

    Start codes are found in blocks that tasks read by range, a unit ends where the next one starts, and its bytes are
    fetched by range; zeros before a start code belong to no unit.
    """
    files = read(spark, folder).select("path", "length")
    dealt = files.withColumn("k", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L) div {block})"))).withColumn("start", F.col("k") * block)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                data = ranged(path)
                try:
                    raw = np.frombuffer(data.direct(start, block + 2), np.uint8)
                finally:
                    data.file.close()
                at = start + np.flatnonzero((raw[:-2] == 0) & (raw[1:-1] == 0) & (raw[2:] == 1))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64())], names=["path", "at"])

    spread = dealt.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start").select("path", "start")
    codes = materialize(spread.mapInArrow(run, "path string, at long"), "start-codes")
    ends = scan(codes, ["path"], [F.col("at").desc()], {"next": ("last", F.col("at"), True)})
    places = ends.join(files, "path").select("path", (F.col("at") + 3).alias("offset"), (F.coalesce("next", "length") - F.col("at") - 3).alias("size"))

    @F.pandas_udf("binary")
    def without_zeros(data: pd.Series) -> pd.Series:
        return data.map(lambda b: b.rstrip(b"\0"))

    stripped = fetch(places).withColumn("data", without_zeros("data")).withColumn("size", F.octet_length("data").cast("long")).filter("size > 0")
    numbered = scan(materialize(stripped, "units"), ["path"], ["offset"], {"unit_idx": ("sum", F.lit(1).cast("long"), True)})
    return numbered.select("path", F.coalesce("unit_idx", F.lit(0)).alias("unit_idx"), "offset", "size", "data")
