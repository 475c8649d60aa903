"""Packet streams: lateness against a clock, one seek for equal requests, and the states of a track's decoder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Packets that a track's decoder needs before it is ready.
READY_PACKETS = 2


def late_packets(stream: DataFrame) -> DataFrame:
    """track, seq, pts, clock, late of a stream of (track, seq, pts): a packet is late if it is before the highest pts of
    its track so far. The clock is the state, one number a track; a batch's packets are taken in order of seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        clock = state.get[0] if state.exists else None
        before = rows["pts"].cummax().shift()
        if clock is not None:
            before = before.fillna(clock).clip(lower=clock)
        state.update((int(max(rows["pts"].max(), clock if clock is not None else rows["pts"].max())),))
        out = rows[["track", "seq", "pts"]].copy()
        out["clock"] = before.astype("Int64")
        out["late"] = (rows["pts"] < before).fillna(False)
        yield out

    return stream.select("track", "seq", "pts").groupBy("track").applyInPandasWithState(step, "track long, seq long, pts long, clock long, late boolean", "clock long", "append", GroupStateTimeout.NoTimeout)


def first_seeks(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The requests of a stream of (track, at timestamp, time) without those for a time that was already sought."""
    return requests.withWatermark("at", delay).dropDuplicatesWithinWatermark(["track", "time"])


def decoder_states(stream: DataFrame) -> DataFrame:
    """track, seq, state of a stream of (track, seq, kind: packet, seek or end): a decoder is preparing until it has
    READY_PACKETS, then ready, decoding with the next packet, and preparing again after a seek; the end ends it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.get if state.exists else ("init", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        said = []
        for kind in rows["kind"]:
            if now == "ended" and kind != "seek":
                pass
            elif kind == "seek":
                now, held = "preparing", 0
            elif kind == "end":
                now = "ended"
            else:
                held += 1
                now = "preparing" if held < READY_PACKETS else "ready" if held == READY_PACKETS else "decoding"
            said.append(now)
        state.update((now, held))
        yield pd.DataFrame({"track": rows["track"], "seq": rows["seq"], "state": said})

    return stream.select("track", "seq", "kind").groupBy("track").applyInPandasWithState(step, "track long, seq long, state string", "state string, held long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there into a table at out, and read that."""
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def by_hour(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """hour, track, packets of a stream of (track, at): tumbling windows, which the engine adds to the media operators."""
    return events.withWatermark("at", delay).groupBy(F.window("at", "1 hour").alias("w"), "track").agg(F.count("*").alias("packets")).select(F.col("w.start").alias("hour"), "track", "packets")
