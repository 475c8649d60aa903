"""Timelines of packets: seeking, as-of look-ups, interleaving, reordering, lateness and clocks.

Everything is partitioned by track (or file and track) and ordered by explicit columns. Look-ups, interleaving and arrivals
go through scan(), which splits long tracks; `split` says whether to, else the size of the table decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.operators.scan import scan

MASTER_LATENCY_US = 5_000
LEAST_SEEK_US = 200_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")
    part = F.extract(F.lit("SECOND"), ts).cast("decimal(8,6)") * 1_000_000
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + seconds * 1_000_000 + part.cast("long") % 1_000_000


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, out: str, split: bool | None = None) -> DataFrame:
    """left with out: the value of the last right row of the same keys whose `at` is not later; null if there is none.

    Spark has no such join, so both sides go through one sort: rows of right come before those of left at equal times,
    and the last value seen is carried on. Of right rows at one time the highest value counts. Columns of left are kept.
    """
    cols = [c for c in left.columns if c not in keys and c != at]
    own = left.select(*keys, at, F.lit(1).alias("_side"), *cols, F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols]
    other = right.select(*keys, at, F.lit(0).alias("_side"), *none, F.col(value).alias("_value"))
    order = [at, "_side", F.col("_value").asc_nulls_first()]
    both = scan(own.unionByName(other), keys, order, {out: ("last", F.col("_value"), False)}, split)
    return both.filter("_side = 1").select(*left.columns, out)


def seek(packets: DataFrame, track: str, pts: str, order: list[str], sync: Column) -> DataFrame:
    """packets with idx, target (the middle of the track), cur (last packet not after it) and start (last sync packet not
    after it, else the first): where a seek to the middle lands and from where decoding has to start."""
    in_track = Window.partitionBy(track)
    w = in_track.orderBy(pts, *order)
    p = packets.withColumn("idx", F.row_number().over(w).cast("long") - 1)
    p = p.withColumn("target", F.call_function("div", F.min(pts).over(in_track) + F.max(pts).over(in_track), F.lit(2)))
    early = F.col(pts) <= F.col("target")
    p = p.withColumn("cur", F.max(F.when(early, F.col("idx"))).over(in_track))
    return p.withColumn("start", F.coalesce(F.max(F.when(early & sync, F.col("idx"))).over(in_track), F.lit(0)))


def worth_seeking(target: Column, clock: Column) -> Column:
    """Whether a seek goes far enough from what the clock shows not to be ignored."""
    return F.abs(target - clock) >= LEAST_SEEK_US


def preroll(sought: DataFrame, droppable: Column) -> DataFrame:
    """The packets between start and cur of seek(): those that nothing refers to are dropped, the others only decoded."""
    between = sought.filter((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("cur")))
    return between.withColumn("action", F.when(droppable, "drop").otherwise("reference"))


def interleave(packets: DataFrame, file: str, track: str, idx: str, offset: str, split: bool | None = None) -> DataFrame:
    """packets with position, in the order in which a reader takes them: always from the track whose next packet lies
    lowest in the file, of equal ones from the track with the higher number. A track is never reordered, so a packet is
    due at the highest offset of its track so far."""
    due = scan(packets, [file, track], [idx], {"_due": ("max", F.col(offset), False)}, split)
    placed = scan(due, [file], ["_due", F.col(track).desc(), idx], {"position": ("sum", F.lit(1).cast("long"), True)}, split)
    return placed.withColumn("position", F.coalesce("position", F.lit(0).cast("long"))).drop("_due")


def arrivals(packets: DataFrame, track: str, arrival: str, pts: str, split: bool | None = None) -> DataFrame:
    """packets with last_pts (the one before), clock (the highest before), unordered and late, in order of arrival.

    A packet is late if it is before the clock; one at the clock is not.
    """
    p = scan(packets, [track], [arrival], {"_before": ("last", F.struct(F.col(pts).alias("pts")), True), "clock": ("max", F.col(pts), True)}, split)
    p = p.select(*packets.columns, F.col("_before.pts").alias("last_pts"), "clock")
    return p.withColumn("unordered", F.coalesce(F.col(pts) <= F.col("last_pts"), F.lit(False))).withColumn("late", F.coalesce(F.col(pts) < F.col("clock"), F.lit(False)))


def pacing(pts: Column, clock: Column, next_pts: Column, latency: int = 0) -> tuple[Column, Column]:
    """(what to do with a frame, microseconds to wait for the next): within 5 ms of its time a frame is played."""
    early = pts - clock - latency
    return F.when(early > MASTER_LATENCY_US, "wait").when(early < -MASTER_LATENCY_US, "late").otherwise("play"), F.greatest(next_pts - clock, F.lit(0).cast("long"))


def clock_states(log: DataFrame, clock: str, order: list[str]) -> DataFrame:
    """A control log with the clock's state after each entry: media_us, speed, started and ticking.

    log has at_us (the time of the entry), cmd and arg: `set` and `update` (by the master, forward only) name a media time,
    `speed` a factor, `start`, `pause`, `register` and `unregister` (of a master) nothing. A clock runs on by its speed from
    entry to entry while it ticks: it is started and, with a master, that one has updated it since. What has passed while
    it ticked is a running sum, and the last `set`, pushed forward by updates since, is added to it; so no entry needs the
    one before, and all is windows over a clock's entries.
    """
    w = Window.partitionBy(clock).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    cmd = F.col("cmd")
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(so_far)
    s = log.withColumns({
        "_k": F.row_number().over(w),
        "speed": F.coalesce(last(cmd == "speed", F.col("arg").cast("double")), F.lit(1.0)),
        "started": F.coalesce(last(cmd.isin("start", "pause"), cmd == "start"), F.lit(False)),
        "_master": F.coalesce(last(cmd.isin("register", "unregister"), cmd == "register"), F.lit(False)),
    })
    s = s.withColumns({"_start": last(cmd == "start", F.col("_k")), "_update": last(cmd == "update", F.col("_k"))})
    s = s.withColumn("ticking", F.col("started") & (~F.col("_master") | F.coalesce(F.col("_update") > F.col("_start"), F.lit(False))))
    ran = F.when(F.lag("ticking").over(w), F.floor((F.col("at_us") - F.lag("at_us").over(w)) * F.lag("speed").over(w))).otherwise(0)
    s = s.withColumn("_ran", F.coalesce(ran, F.lit(0)).cast("long")).withColumn("_ran", F.sum("_ran").over(so_far))
    s = s.withColumn("_sets", F.sum((cmd == "set").cast("int")).over(so_far))
    ahead = F.max(F.when(cmd.isin("set", "update"), F.col("arg").cast("long") - F.col("_ran"))).over(Window.partitionBy(clock, "_sets").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    base = F.when(F.col("_sets") > 0, ahead).otherwise(F.greatest(F.coalesce(ahead, F.lit(0)), F.lit(0)))
    return s.withColumn("media_us", F.col("_ran") + base).select(*log.columns, "media_us", "speed", "started", "ticking")


def clock_reads(reads: DataFrame, states: DataFrame, clock: str, at: str, order: str) -> DataFrame:
    """reads with media_us: what a clock of clock_states() shows then, 0 before its first entry. Of entries at one time the
    last counts, by a column that orders them."""
    state = F.struct(order, F.col("at_us").alias("since"), "media_us", "speed", "ticking")
    got = as_of(reads, states.select(clock, F.col("at_us").alias(at), state.alias("_state")), [clock], at, "_state", "_found")
    f = F.col("_found")
    passed = F.when(f["ticking"], F.floor((F.col(at) - f["since"]) * f["speed"])).otherwise(0)
    return got.withColumn("media_us", F.coalesce(f["media_us"] + passed, F.lit(0)).cast("long")).drop("_found")


def newest_generation(packets: DataFrame, track: str, order: list[str], is_seek: Column) -> DataFrame:
    """packets with generation (seeks so far) of the track's last generation; older ones belong to before a seek."""
    w = Window.partitionBy(track).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = packets.withColumn("generation", F.sum(is_seek.cast("long")).over(w))
    return p.withColumn("_last", F.max("generation").over(Window.partitionBy(track))).filter("generation = _last").drop("_last")


def track_mask(track: Column, mask: int) -> Column:
    """Whether a track's bit is set."""
    return F.call_function("shiftright", F.lit(mask), track.cast("int")).bitwiseAND(F.lit(1)) == 1
