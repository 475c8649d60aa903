"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import by_size, lean, materialize, read_table
from reelframe.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0


def pieces(docs: DataFrame, tokenizer_file: str, kind: str = "words", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Tokenize whole texts, append end_id, and cut what is longer than the capacity.

    Returns doc_id, piece, start, length, ids_crc32, and ids (binary, little-endian unsigned 32 bit) if with_ids.
    Strings of the tokenizer's special tokens in a text give their ids, as the library has it, or are text like any other
    with special_as_text. Null and empty texts give the end id alone; repeated rows give repeated pieces; an empty table
    gives an empty result; other columns are ignored.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        enc = encoder(model.value, kind, special_as_text)
        for batch in batches:
            for part in by_size(batch, most=1 << 20):
                rows = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    ids += end
                    for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[first : first + 4 * capacity]
                        rows.append((doc, k, first // 4, len(own) // 4, zlib.crc32(own), own)[: 5 + with_ids])
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[: 5 + with_ids], strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit on a histogram of lengths: [(bins, [(length, uses in each bin)])].

    A bin is filled greedily, the longest that fits first; when nothing more fits, its smallest document gives way to the
    two unpacked ones that fill the widened gap best, if they fill more than it did. Bins that would come out alike are
    planned at once: as many as the counts allow before a choice could change. So the work depends on the number of
    distinct lengths, at most the capacity, and not on the number of documents; the result is that of one bin at a time.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan = []
    while lengths:
        gap, used, at = capacity, {}, len(lengths)
        while gap and (at := bisect_right(lengths, gap, 0, at)):
            n = lengths[at - 1]
            used[n] = min(left[n], gap // n)
            gap -= used[n] * n
            at -= 1
        peak = dict(used)
        if gap:
            small = min(used)
            best, pair = small, None
            free = [n for n in lengths if left[n] > used.get(n, 0)]
            lo, hi = 0, bisect_right(free, gap + small) - 1
            while lo <= hi:
                total = free[lo] + free[hi]
                if total > gap + small:
                    hi -= 1
                elif lo == hi and left[free[lo]] - used.get(free[lo], 0) < 2:
                    break
                else:
                    if total > best:
                        best, pair = total, (free[lo], free[hi])
                    lo += 1
            if pair:
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                    peak[n] = peak.get(n, 0) + 1
                used[small] -= 1
        bins = min((left[n] - peak[n]) // used[n] + 1 for n in peak if used[n])
        plan.append((bins, sorted(((n, u) for n, u in used.items() if u), reverse=True)))
        gone = False
        for n, u in used.items():
            left[n] -= bins * u
            gone |= not left[n]
        if gone:
            lengths = [n for n in lengths if left[n]]
    return plan


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY, rows_per_salt: int = 100_000, least_salts: int = 64) -> DataFrame:
    """Add sequence_id and offset to items, which have a column length (1 to capacity); order tells rows apart.

    Only the histogram of lengths, at most capacity rows, reaches the driver. A row finds its place by its rank among
    the rows of its length, and ranks are counted in salted parts, so a length that a third of all rows share is no hot
    spot. An empty table gives an empty result.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, first, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, parts in plan_bins(counts, capacity):
        offset = 0
        for n, uses in parts:
            rows.append((n, first[n], first[n] + bins * uses, uses, sequence, offset))
            first[n] += bins * uses
            offset += n * uses
        sequence += bins
    # at most a few rows for each of the capacity's lengths, whatever the number of items
    plan = spark.createDataFrame(rows, "_n long, _first long, _end long, _uses long, _sequence long, _offset long")

    salts = max(least_salts, sum(counts.values()) // rows_per_salt)
    items = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = items.groupBy("length", "_salt").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_rank"))
    found = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_n")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    at = F.col("_rank") - F.col("_first")
    return found.select(
        *(c for c in items.columns if c != "_salt"),
        (F.col("_sequence") + F.expr("(_rank - _first) div _uses")).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_uses") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() of docs, kept as a table, then packed by pack()."""
    return pack(materialize(pieces(docs, tokenizer_file, capacity=capacity, with_ids=with_ids), "pieces"), ["doc_id", "piece", "start", "length", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack_documents(..., with_ids=True): sequence_id, length, n_documents, ids (binary)."""
    at = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    joined = F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("n_documents"), at.alias("parts")).select("sequence_id", "length", "n_documents", joined.alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
