"""How filters act on each other: every order of them, walked by adjacent swaps over counts by failure mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import let, materialize, read_table, words

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a cell counts: documents, those of good quality, toxic ones.
KINDS = 3
#: Parts whose rows are made at a time: each has orders x filters rows.
AT_ONCE = 64


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A under 200 words, B under half of the words distinct, C over 2 % of
    the code points in A-Z, D a symbol of SYMBOLS. Null is empty, which fails A alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ab = let(words(text), lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(2 * F.size(F.array_distinct(w)).cast("long") < F.size(w), 2).otherwise(0))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    c = F.when(50 * upper.cast("long") > F.length(text), 4).otherwise(0)
    d = F.when(F.translate(text, SYMBOLS, "") != text, 8).otherwise(0)
    return (ab + c + d).cast("int")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each row of docs (doc_id, text, source); labels: doc_id, quality, toxic.

    Bit 16 (filter E) is set if a smaller doc_id has the same text; texts are told apart by their SHA-256. A text's
    least doc_id is found by a minimum, which combines before it is shuffled, and is joined by text and doc_id, so copies
    don't meet in one task. A null doc_id has no smaller one and is smaller than none; a null source is part ''.
    A document of several labels is good or toxic if one of them says so. Repeated rows are judged each for itself.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_mask(F.col("text")).alias("own"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    slim = materialize(slim, "filter-masks")
    first = slim.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = slim.join(first.withColumnRenamed("key", "_key"), (F.col("doc_id") == F.col("first")) & (F.col("key") == F.col("_key")), "left")
    rows = rows.join(marks, F.col("doc_id") == F.col("label_id"), "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("part", (F.col("own") + copy).cast("int").alias("mask"), zero("good").alias("good"), zero("toxic").alias("toxic"))


def mask_cells(masks: DataFrame) -> DataFrame:
    """part, cells: counts (mask, n, good, toxic) of a part's documents by what they fail, at most 2 ** filters of them."""
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def adjacent_orders(n: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """All orders of 0 to n - 1 so that each comes from the one before by swapping places i and i + 1; i is -1 at first.

    Each element wanders through the orders of those below it, from end to end and back.
    """
    order, way = list(range(n)), [-1] * n
    yield tuple(order), -1
    while True:
        for x in range(n - 1, -1, -1):  # the largest one that has a smaller one ahead
            at = order.index(x)
            to = at + way[x]
            if 0 <= to < n and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield tuple(order), min(at, to)


def walk(cells: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """(orders, steps, shapley) of cells, counts by (part, mask, kind).

    steps has by (order, part, step) kept, removed, redundant, unique fails, good lost and toxic lost. A swap of two
    neighbours changes their two steps only: what is kept after the first of them is counted anew from the cells, all else
    is carried on. shapley, by (part, filter), adds up each filter's removed as the walk goes; what a step's
    filter removed is taken out of the sum and put back only where the swap changes it, times the orders it stood for.
    """
    parts, size, _ = cells.shape
    n = size.bit_length() - 1
    masks = np.arange(size)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(n)], 1)
    failing = np.stack([cells[:, masks >> f & 1 == 1, 0].sum(1) for f in range(n)], 1)
    left = np.zeros((n + 1, parts, KINDS), np.int64)  # what is left after each step
    shapley = np.zeros((parts, n), np.int64)
    now = np.zeros((n, parts, 6), np.int64)
    since = [0] * n  # the order from which a step stands as it is
    orders: list[tuple[int, ...]] = []
    out = []

    def count(order, step):
        gone = sum(1 << f for f in order[: step + 1])
        left[step + 1] = cells[:, masks & gone == 0].sum(1)

    def set_step(order, step, at):
        f, lost = order[step], left[step] - left[step + 1]
        now[step] = np.stack([left[step + 1][:, 0], lost[:, 0], failing[:, f] - lost[:, 0], alone[:, f], lost[:, 1], lost[:, 2]], 1)
        since[step] = at

    def close(order, step, at):
        shapley[:, order[step]] += now[step][:, 1] * (at - since[step])

    left[0] = cells.sum(1)
    for k, (order, swap) in enumerate(adjacent_orders(n)):
        if swap < 0:
            for s in range(n):
                count(order, s)
                set_step(order, s, k)
        else:
            for s in (swap, swap + 1):
                close(orders[-1], s, k)
            count(order, swap)
            for s in (swap, swap + 1):
                set_step(order, s, k)
        orders.append(order)
        out.append(now.transpose(1, 0, 2).copy())
    for s in range(n):
        close(orders[-1], s, len(orders))
    return orders, np.stack(out), shapley


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of each step, one row for each part, order of the filters and place in it.

    A part's cells are one row, so the walk needs no other rows; it goes over AT_ONCE parts side by side. No parts, no rows.
    """
    n = len(filters)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    schema = ", ".join(["part string", "filter_order string", "step int", *(f"{c} long" for c in names), "shapley long"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                lists = some.column("cells")
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                cells = np.zeros((len(lists), 1 << n, KINDS), np.int64)
                mask = flat.field("mask").to_numpy()
                for k, c in enumerate(("n", "good", "toxic")):
                    cells[of, mask, k] = flat.field(c).to_numpy()
                orders, steps, shapley = walk(cells)
                rows = len(lists) * n
                part = pa.array(np.repeat(np.arange(len(lists)), n), pa.int32())
                for order, of_order in zip(orders, steps):
                    made = [some.column("part").take(part), pa.array(["".join(filters[f] for f in order)] * rows), pa.array(np.tile(np.arange(1, n + 1), len(lists)), pa.int32())]
                    made += [pa.array(of_order[:, :, k].reshape(-1)) for k in range(6)]
                    made.append(pa.array(shapley[:, list(order)].reshape(-1)))
                    yield pa.RecordBatch.from_arrays(made, names=["part", "filter_order", "step", *names, "shapley"])

    return cells.mapInArrow(run, schema)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction audit of the five filters over all documents.

    Null texts are empty and null sources part ''; repeated rows count each; an empty table gives an empty result; other
    columns are ignored.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(mask_cells(failure_masks(docs, read_table(spark, sf_dir, "labels"))))


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM t GROUP BY text
), marks AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT t.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask
  FROM w JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT unnest(range(5)) AS f
), orders AS (
  SELECT '' AS o, [] :: INT[] AS fs
  UNION ALL
  SELECT o || substr('ABCDE', CAST(f + 1 AS INT), 1), list_append(fs, CAST(f AS INT)) FROM orders, f WHERE NOT list_contains(fs, CAST(f AS INT)) AND len(fs) < 5
), steps AS (
  SELECT o AS filter_order, step, fs[step] AS f, list_sum(list_transform(fs[:step - 1], lambda x : 1 << x)) AS before
  FROM (SELECT o, fs, unnest(range(1, 6)) AS step FROM orders WHERE len(fs) = 5)
), s AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN mask & CAST(coalesce(before, 0) AS INT) = 0 AND mask >> f & 1 = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & CAST(coalesce(before, 0) AS INT) = 0 AND mask >> f & 1 = 1 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & CAST(coalesce(before, 0) AS INT) <> 0 AND mask >> f & 1 = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & CAST(coalesce(before, 0) AS INT) = 0 AND mask >> f & 1 = 1 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & CAST(coalesce(before, 0) AS INT) = 0 AND mask >> f & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM s
"""
