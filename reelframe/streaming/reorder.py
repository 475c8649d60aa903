"""A decoder's output put in order of presentation, as a stream: at most two frames a track are held."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: transformWithState() keeps its state there only.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "track long, seq long, pts long, why string"


def shown(held: list[tuple[int, int]], frame: tuple[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(what is held then, what is shown now) when a frame (pts, seq) comes to those held, in order of pts.

    One frame that lies ahead (an I or P frame) and one before it (a B frame) are held. A later one than both shows them; one
    between them shows the earlier; one before them is shown at once.
    """
    if not held or frame[0] > held[-1][0]:
        return [frame], held
    if len(held) == 1:
        return [frame, held[0]], []
    if frame[0] > held[0][0]:
        return [frame, held[1]], [held[0]]
    return held, [frame]


class Reorder(StatefulProcessor):
    """Held frames, whether the track has ended, and a timer that shows what is held when a track pauses."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "pts long, seq long")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = sorted((r[0], r[1]) for r in self.held.get())
        ended = self.ended.exists() and self.ended.get()[0]
        last = None
        for r in sorted(rows, key=lambda r: r["seq"]):
            last = max(last or 0, int(r["at"].timestamp() * 1000))
            out: list[tuple[int, int]] = []
            why = "order"
            if r["kind"] == "seek":
                held, ended = [], False
            elif ended:
                continue
            elif r["kind"] == "end":
                held, out, ended, why = [], held, True, "end"
            else:
                held, out = shown(held, (r["pts"], r["seq"]))
            for pts, seq in out:
                yield Row(track=key[0], seq=seq, pts=pts, why=why)
        if held:
            self.held.put([Row(pts=p, seq=s) for p, s in held])
        else:
            self.held.clear()
        self.ended.update((ended,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held and last is not None:
            self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        for pts, seq in sorted((r[0], r[1]) for r in self.held.get()):
            yield Row(track=key[0], seq=seq, pts=pts, why="pause")
        self.held.clear()

    def close(self) -> None:
        pass


def configure(spark: SparkSession) -> None:
    """The state store that in_order() needs, for streams that start from now on."""
    spark.conf.set(*PROVIDER)


def in_order(stream: DataFrame, delay: str = "10 seconds", idle_ms: int = 10_000) -> DataFrame:
    """track, seq, pts, why of a stream of (track, seq, kind, pts, at): its packets in order of presentation.

    kind is packet, seek or end; at is a timestamp, and rows that come later than delay are dropped. A track's rows of a batch are taken in order of seq. What is held is
    shown at the end (why: end) or when event time has gone on by idle_ms without a packet (why: pause); a seek
    drops it and opens a track that has ended.
    """
    timed = stream.select("track", "seq", "kind", "pts", "at").withWatermark("at", delay)
    return timed.groupBy("track").transformWithState(Reorder(idle_ms), OUT, "Append", "EventTime")
