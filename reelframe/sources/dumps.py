"""Packets and frames as files: one for each packet, or the frames of a track end to end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators.scan import scan
from reelframe.sources.ranged import write

#: Bytes from which on frames of a track go to another part.
PART = 64 << 20


def packet_name(track: Column, us: Column, duration_us: Column, size: Column) -> Column:
    """What a packet's file is called: track, time and duration of seven digits at least, and size."""
    return F.format_string("%d_%07d_%07d@%d", track.cast("long"), us.cast("long"), duration_us.cast("long"), size.cast("long"))


def packet_files(packets: DataFrame) -> DataFrame:
    """path, content for packets (track, us, duration_us, data). Nulls count as 0, null data as empty.

    Packets whose names are the same get a second number, in the order of their bytes, so no file takes another's place.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    data = F.coalesce("data", F.lit(b""))
    named = packets.select(packet_name(zero("track"), zero("us"), zero("duration_us"), F.octet_length(data)).alias("name"), data.alias("content"))
    again = scan(named, ["name"], ["content"], {"again": ("sum", F.lit(1), True)})
    return again.select(F.concat("name", F.when(F.col("again") > 0, F.concat(F.lit("."), F.col("again"))).otherwise("")).alias("path"), "content")


def dump_packets(packets: DataFrame, folder: str, spread: bool = False) -> None:
    """Write each packet to a file of its own; a killed task leaves none. With `spread` they lie in folders of some thousand files,
    which ranged.contents() reads side by side; else all in one."""
    write(packet_files(packets), folder, spread)


def raw_parts(frames: DataFrame, order: list[str], part: int = PART) -> DataFrame:
    """path, content: the frames (track, data) of each track end to end, in parts of about as many bytes as said.

    Parts of a track lie in a folder track-<track>.raw and are called by the place of their first byte, so in order of
    their names they are the track; no task holds more than a part and a frame. A frame with the columns planes (array of binary) instead of data
    gives its planes one after the other. Null tracks are "null", null data is empty.
    """
    if "planes" in frames.columns:
        frames = frames.withColumn("data", F.aggregate("planes", F.lit(b""), lambda a, b: F.concat(a, F.coalesce(b, F.lit(b"")))))
    some = frames.select(F.coalesce(F.col("track").cast("string"), F.lit("null")).alias("track"), F.coalesce("data", F.lit(b"")).alias("data"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [f"_o{i}" for i in range(len(order))]
    placed = scan(some, ["track"], [*keys, "data"], {"start": ("sum", F.octet_length("data").cast("long"), True)}).withColumn("start", F.coalesce("start", F.lit(0)))
    each = placed.filter("octet_length(data) > 0").groupBy("track", F.floor(F.col("start") / part).alias("part"))
    whole = each.agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "data"))).alias("some"))

    @F.pandas_udf("binary")
    def joined(some: pd.Series) -> pd.Series:
        return some.map(lambda rows: b"".join(r["data"] for r in rows))

    return whole.select(F.format_string("track-%s.raw/%018d", "track", "start").alias("path"), joined("some").alias("content"))


def dump_raw(frames: DataFrame, order: list[str], folder: str, part: int = PART) -> None:
    """Write raw_parts(); a killed task leaves none."""
    write(raw_parts(frames, order, part), folder)
