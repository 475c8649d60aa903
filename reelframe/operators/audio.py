"""PCM across packets: what a resampler keeps from one packet to the next is a running sum and a last value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators.scan import scan


def resample_packets(packets: DataFrame, keys: list[str], order: list[str | Column], samples: str, rate_in: int, rate_out: int, split: bool | None = None) -> DataFrame:
    """packets with first (the place of its first new sample in the track) and resampled: linear interpolation at another rate.

    New sample k lies at k * rate_in / rate_out of the track's samples and comes with the packet that has the later one of
    the two around it. So packets of any cut give the samples that the joined track gives, up to its last one. Places are
    whole numbers and remainders; nothing adds up errors. Null packets are empty, null samples give null. An empty
    packet gives none, and may lie anywhere.
    """
    own = F.coalesce(F.size(F.col(samples)), F.lit(0)).cast("long")
    size = F.when(F.col(samples).isNull(), F.lit(0).cast("long")).otherwise(own)
    last = F.when(size > 0, F.struct(F.element_at(samples, -1).cast("double").alias("x")))
    p = scan(packets, keys, order, {"_from": ("sum", size, True), "_last": ("last", last, True)}, split)
    start, n = F.coalesce("_from", F.lit(0).cast("long")), size
    low = F.when(start == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", (start - 1) * rate_out, F.lit(rate_in).cast("long")) + 1)
    high = F.call_function("div", (start + n - 1) * rate_out, F.lit(rate_in).cast("long"))

    def at(k: Column) -> Column:
        i = (F.call_function("div", k * rate_in, F.lit(rate_out).cast("long")) - F.col("_start")).cast("int")
        t = (k * rate_in % rate_out).cast("double") / float(rate_out)
        level = lambda j: F.get(samples, j).cast("double")
        before = F.when(i < 0, F.col("_last.x")).otherwise(level(F.greatest(i, F.lit(0))))
        return F.when(t == 0, before).otherwise((1 - t) * before + t * level(i + 1))

    none = F.array().cast("array<double>")
    made = F.when((n > 0) & (F.col("first") <= F.col("_high")), F.transform(F.sequence("first", "_high"), at)).otherwise(none)
    p = p.withColumns({"_start": start, "first": low, "_high": high})
    return p.withColumn("resampled", made).select(*packets.columns, "first", "resampled")
