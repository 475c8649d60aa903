"""Running sums, maxima and last values along tracks, of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from reelframe.stored import materialize

#: What Spark estimates a table to have in bytes up to which a track is scanned by one task, in one sort.
SMALL = 256 << 20
#: Letters or bytes of keys, and of what they are ordered by, that ranges are dealt by.
KEY, START = 256, 16


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of df is at most SMALL. Its estimates are bounds for scans, filters and unions."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def _dealt_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> list[str | Column]:
    """What ranges of keys and order are dealt by. Their bounds are sampled by the driver, so texts and bytes go by their start; what
    is ordered after a cut one doesn't count. A track's rows still lie in ranges by their order."""
    out: list[str | Column] = []
    for k, c in enumerate([*keys, *order]):
        long = isinstance(c, str) and isinstance(df.schema[c].dataType, (StringType, BinaryType))
        out.append(F.call_function("substring", F.col(c), F.lit(1), F.lit(KEY if k < len(keys) else START)) if long else c)
        if long and k >= len(keys):
            break
    return out


def _over(kind: str, value: Column, frame) -> Column:
    return {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}[kind](value).over(frame)


def scan(df: DataFrame, keys: list[str], order: list[str | Column], outs: dict[str, tuple[str, Column, bool]], split: bool | None = None) -> DataFrame:
    """df with, for each of outs, a running value along the rows of the same keys: name -> (kind, value, before).

    Kinds are sum, max and last (of values that aren't null); with `before` the row itself doesn't count. A value is
    null where no row counts. Rows of equal order are in any order.

    A small table goes through one sort by the keys. Of a larger one (or with split) ranges of keys and order are dealt
    out, so the rows of a long track lie in several ranges that follow each other. Each range is scanned by itself,
    and what the ranges before hold of the same track is added: at most one track goes on from one range to the next, so these
    carries are fewer than ranges, and are broadcast.
    """
    if is_small(df) if split is None else not split:
        w = Window.partitionBy(*keys).orderBy(*order)
        frames = {before: w.rowsBetween(Window.unboundedPreceding, -1 if before else 0) for before in (True, False)}
        return df.withColumns({name: _over(kind, value, frames[before]) for name, (kind, value, before) in outs.items()})
    names = list(outs)
    dealt = df.withColumns({f"_v{i}": outs[n][1] for i, n in enumerate(names)}).repartitionByRange(*_dealt_by(df, keys, order)).withColumn("_part", F.spark_partition_id())
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    own = {"_n": F.row_number().over(inner)}
    for i, n in enumerate(names):
        kind, _, before = outs[n]
        own[f"_i{i}"] = _over(kind, F.col(f"_v{i}"), inner.rowsBetween(Window.unboundedPreceding, -1) if before else so_far)
        own[f"_a{i}"] = _over(kind, F.col(f"_v{i}"), so_far)
    within = materialize(dealt.withColumns(own), "scan")
    ends = within.groupBy(*keys, "_part").agg(*(F.max_by(f"_a{i}", "_n").alias(f"_a{i}") for i in range(len(names))))
    by_part = Window.partitionBy(*keys).orderBy("_part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carried = [_over(outs[n][0], F.col(f"_a{i}"), earlier).alias(f"_c{i}") for i, n in enumerate(names)]
    carries = ends.select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), F.col("_part").alias("_of"), F.row_number().over(by_part).alias("_k"), *carried).filter("_k > 1")
    on = within["_part"] == carries["_of"]
    for j, k in enumerate(keys):
        on = on & within[k].eqNullSafe(carries[f"_k{j}"])
    both = within.join(F.broadcast(carries), on, "left")
    add = {
        "sum": lambda c, x: F.when(c.isNull(), x).when(x.isNull(), c).otherwise(c + x),
        "max": lambda c, x: F.greatest(c, x),
        "last": lambda c, x: F.coalesce(x, c),
    }
    return both.select(*(within[c] for c in df.columns), *(add[outs[n][0]](F.col(f"_c{i}"), F.col(f"_i{i}")).alias(n) for i, n in enumerate(names)))
