"""Sample tables of MP4 tracks from their run-length tables, as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.operators.scan import scan
from reelframe.operators.timeline import as_of

SYNC, DISPOSAL, REFERENCE = 1, 4, 8


#: Samples that one row of a run is made into at a time.
RUN = 65_536


def _number_runs(runs: DataFrame, keys: list[str], order: list[str], count: str, totals: DataFrame | None, sums: dict[str, str]) -> DataFrame:
    """The runs that have samples, with _first and _end, their first number and that after their last, and the sums before them."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda value: F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long")
    runs = runs.withColumn("_count", F.greatest(F.col(count).cast("long"), F.lit(0)))
    if totals is None:
        runs = runs.withColumns({"_first": so_far(F.col("_count")), **{name: so_far(F.col("_count") * F.col(value)) for name, value in sums.items()}})
        runs = runs.withColumn("_end", F.col("_first") + F.col("_count"))
    else:
        runs = runs.withColumn("_first", so_far(F.col("_count"))).join(totals.hint("merge"), keys).withColumn("_end", F.least(F.col("_first") + F.col("_count"), "total"))
        runs = runs.withColumns({name: so_far(F.greatest(F.col("_end") - F.col("_first"), F.lit(0)) * F.col(value)) for name, value in sums.items()}).drop("total")
    return runs.filter("_end > _first").drop("_count")


def _sum_at(name: str, value: str, at: str) -> Column:
    """The sum before the sample `at` of a run, from that before the run."""
    return F.col(name) + (F.col(at) - F.col("_first")) * F.coalesce(F.col(value).cast("long"), F.lit(0))


def expand_runs(
    runs: DataFrame, keys: list[str], order: list[str], count: str, out: str = "sample_idx", totals: DataFrame | None = None, sums: dict[str, str] | None = None
) -> DataFrame:
    """A row for each sample of run-length entries, numbered from 0 within the keys; other columns are repeated.

    A run's first number is the sum of the counts before it, so the samples themselves needn't be sorted. A long run is
    made in parts of RUN. With totals (keys, total) numbers end there: what a damaged file counts beyond is left out. Totals
    grow with the files, so they are merged: sent to all tasks they would pass through the driver.

    sums are name -> column: the sum of a column over the samples before, nulls as 0. It is made of the runs as the numbers
    are, as values repeat within a run; so the samples, which are many more, are neither dealt out nor written for it.
    """
    sums = sums or {}
    runs = _number_runs(runs, keys, order, count, totals, sums).withColumn("_from", F.explode(F.expr(f"sequence(_first, _end - 1, {RUN}L)")))
    runs = runs.withColumn(out, F.explode(F.expr(f"sequence(_from, least(_from + {RUN - 1}L, _end - 1))")))
    return runs.withColumns({name: _sum_at(name, value, out) for name, value in sums.items()}).drop("_first", "_end", "_from")


def prefix_sum(samples: DataFrame, keys: list[str], order: list[str], value: str, out: str, split: bool | None = None) -> DataFrame:
    """out: the sum of the values before this one within the keys, as decoding times and offsets are."""
    summed = scan(samples, keys, order, {out: ("sum", F.col(value), True)}, split)
    return summed.withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def chunk_runs(chunks: DataFrame, runs: DataFrame, keys: list[str], chunk: str, first_chunk: str, value: str) -> DataFrame:
    """chunks with the value of the run they are in: each run goes from its first chunk up to the next run's."""
    found = as_of(chunks, runs.select(*keys, F.col(first_chunk).alias(chunk), value), keys, chunk, value, value)
    return found.filter(F.col(value).isNotNull())


#: What a row of build() tells, in the order in which rows of one sample come.
TIME, SHIFT, CHUNK, CARRY, LISTED, IS_SYNC, DEPENDS, SAMPLE = range(8)


def build(stts: DataFrame, ctts: DataFrame, stsc: DataFrame, stco: DataFrame, stsz: DataFrame, stss: DataFrame, keys: list[str], sdtp: DataFrame | None = None) -> DataFrame:
    """keys, sample_idx, chunk, offset, size, dts, pts, flags of every sample.

    stts and ctts (entry, count, delta or shift), stsc (first_chunk, per_chunk), stco (chunk from 1, chunk_offset), stsz
    (sample_idx, size), stss (sample_idx), sdtp (sample_idx, depends: its byte). A track without stss has sync samples only;
    a sample that depends on no other is one too, and one that no other depends on can be disposed of. A negative pts
    gives way to dts. Samples are those that stsz has, whatever other tables count.

    Runs are not made into samples that are joined then, as each join deals all of them out again. Runs are cut at every RUN
    samples of a track, and so many samples are a block: rows of all tables are dealt out once, by track and block, and
    sorted by sample, where each sample has the last run of each kind before it. A chunk that goes on from the block before
    has its bytes there as a row of its own.
    """
    laid = chunk_runs(stco, stsc, keys, "chunk", "first_chunk", "per_chunk")
    counts = [stsz.select(*keys, F.lit(1).cast("long").alias("a"), F.lit(SAMPLE).alias("of")), stts.select(*keys, F.col("count").cast("long"), F.lit(TIME)), laid.select(*keys, F.col("per_chunk").cast("long"), F.lit(CHUNK))]
    counted = lambda of: F.coalesce(F.sum(F.when(F.col("of") == of, F.greatest("a", F.lit(0)))), F.lit(0))
    totals = counts[0].union(counts[1]).union(counts[2]).groupBy(*keys).agg(F.least(*map(counted, (SAMPLE, TIME, CHUNK))).alias("total"))

    def pieces(runs, order, count, sums=None):
        runs = _number_runs(runs, keys, order, count, totals, sums or {}).withColumn("_block", F.explode(F.expr(f"sequence(_first div {RUN}, (_end - 1) div {RUN})")))
        return runs.withColumns({"_from": F.expr(f"greatest(_first, _block * {RUN})"), "_to": F.expr(f"least(_end, (_block + 1) * {RUN})")})

    def rows(df, kind, at, a=None, b=None, c=None):
        block = F.col("_block") if "_block" in df.columns else F.expr(f"{at} div {RUN}")
        long = lambda x: (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast("long")
        return df.select(*keys, block.alias("_block"), long(at).alias("_at"), F.lit(kind).cast("byte").alias("_kind"), long(a).alias("_a"), long(b).alias("_b"), long(c).alias("_c"))

    chunks = pieces(laid, ["chunk"], "per_chunk")
    sizes = stsz.select(*keys, "sample_idx", "size", F.expr(f"sample_idx div {RUN}").alias("_block"))
    cut = chunks.filter("_first < _from OR _to < _end").select(*keys, "_block", "_first", "_from", "_to")
    own = cut.join(sizes.hint("merge"), [*keys, "_block"]).filter("sample_idx >= _from AND sample_idx < _to").groupBy(*keys, "_first", "_block", "_from").agg(F.sum("size").alias("_own"))
    carry = own.withColumn("_own", F.sum("_own").over(Window.partitionBy(*keys, "_first").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).filter("_own IS NOT NULL")
    listed = stss.join(totals.hint("merge"), keys).filter("sample_idx >= 0 AND sample_idx < total").select(*keys, "total").distinct()
    listed = listed.withColumn("_block", F.explode(F.expr(f"sequence(0L, (total - 1) div {RUN})"))).withColumn("_from", F.expr(f"_block * {RUN}"))
    told = [
        rows(pieces(stts, ["entry"], "count", {"dts": "delta"}), TIME, "_from", "_to", _sum_at("dts", "delta", "_from"), "delta"),
        rows(pieces(ctts, ["entry"], "count"), SHIFT, "_from", "_to", "shift"),
        rows(chunks, CHUNK, "_from", "_to", "chunk", "chunk_offset"),
        rows(carry, CARRY, "_from", b="_own"),
        rows(listed, LISTED, "_from"),
        rows(stss, IS_SYNC, "sample_idx"),
        *([] if sdtp is None else [rows(sdtp, DEPENDS, "sample_idx", b="depends")]),
        rows(sizes, SAMPLE, "sample_idx", b="size"),
    ]
    s = reduce(DataFrame.unionByName, told)
    w = Window.partitionBy(*keys, "_block").orderBy("_at", "_kind")
    is_ = lambda kind: F.col("_kind") == kind
    last = lambda kind: F.last(F.when(is_(kind), F.struct("_at", "_a", "_b", "_c", "_bytes")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_bytes", F.coalesce(F.sum(F.when(is_(SAMPLE), F.col("_b"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumns({f"_{kind}": last(kind) for kind in range(SAMPLE)}).filter(is_(SAMPLE))
    time, shift, chunk, carry, listed, sync, depends = (F.col(f"_{kind}") for kind in range(SAMPLE))
    at = F.col("_at")
    s = s.filter((time["_a"] > at) & (chunk["_a"] > at))
    inside = F.col("_bytes") - chunk["_bytes"] + F.when(carry["_at"] == chunk["_at"], carry["_b"]).otherwise(0)
    dts = time["_b"] + (at - time["_at"]) * F.coalesce(time["_c"], F.lit(0))
    pts = dts + F.when(shift["_a"] > at, F.coalesce(shift["_b"], F.lit(0))).otherwise(0)
    byte = F.when(depends["_at"] == at, F.coalesce(depends["_b"], F.lit(0))).otherwise(0)
    two = lambda by: F.shiftright(byte, by).bitwiseAND(F.lit(3)) == 2
    flags = F.when(listed.isNull() | F.coalesce(sync["_at"] == at, F.lit(False)) | two(4), SYNC).otherwise(0) + F.when(two(2), DISPOSAL).otherwise(0)
    return s.select(
        *keys, at.alias("sample_idx"), chunk["_b"].alias("chunk"), (chunk["_c"] + inside).alias("offset"), F.col("_b").alias("size"), dts.alias("dts"), F.when(pts < 0, dts).otherwise(pts).alias("pts"), flags.alias("flags")
    )
