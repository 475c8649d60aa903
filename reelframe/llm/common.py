"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.stored import discard, materialize, new_path  # noqa: F401  operators take them from here

#: The white space that separates words: blank and the control characters 9 to 13.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often the body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_start(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str, bucket: Column) -> DataFrame:
    """Add out: the sum of value over the rows before this one among those of its keys, if any.

    bucket must not fall as order rises within a key. A key's rows are summed in one task per bucket, and a second,
    small pass adds what the buckets before hold, so no key has to fit in one task.
    """
    cols = [*keys, "_bucket"]
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*cols).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cols, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [df[c].eqNullSafe(sums[c]) for c in cols]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    kept = [df[c] for c in df.columns if c not in ("_bucket", "_inside")]
    return df.join(sums, cond).select(*kept, (sums["_base"] + df["_inside"]).alias(out))


def lean(run):
    """run, a function of a task's Arrow batches, made to hand freed memory back to the system when it ends: Python workers
    live on, and several share an executor's memory."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
                ctypes.CDLL(None).malloc_trim(0)

    return task


def by_size(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (or lists) in a column hold about most bytes (or items) together, one row at least."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def by_bytes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges (first, last + 1) of texts that hold about most bytes each, one text at least."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def join_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts, with the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts
