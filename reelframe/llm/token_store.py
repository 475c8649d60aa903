"""Token-id files: documents' ids in doc_id order, in blocks of interleaved range asymmetric numeral systems (rANS).

A store is a folder with two tables. frequencies holds (symbol, frequency), the table that all blocks share, scaled to
sum to 2**PROB_BITS. blocks holds one row a block, (part, seq, n_tokens, payload); ordered by part and seq their
documents ascend by doc_id. A payload is, in little-endian order:

    "RNS1", prob_bits u32, lanes u32, documents u32, tokens u32, segments u32, words u32
    has_id u8 and doc_id i64 and n_tokens u32 of each document
    first_step u32, first_word u32, crc32 u32 of each segment, and the lanes' u64 states at its start
    the words, u32

Token i of a block belongs to lane i % lanes. Each segment starts at a checkpoint (the states and the word it reads
first), so segments can be decoded in parallel, and its checksum is that of its ids as u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import by_size, discard, lean, materialize, new_path, read_table
from reelframe.llm.tokens import encoder

PROB_BITS = 20
LOW = 1 << 31
BLOCK_TOKENS = 1 << 18
SEGMENT_STEPS = 64
MOST_LANES = 4096
END_ID = 2
_HEAD = "<4s6I"


class Model:
    """A frequency table, made ready for coding."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[symbols] = frequencies
        self.start = np.zeros(size, np.uint64)
        self.start[1:] = np.cumsum(self.freq)[:-1]
        self.slots = np.repeat(np.arange(size, dtype=np.uint16 if size <= 1 << 16 else np.uint32), self.freq.astype(np.int64))
        self.both = (self.freq << np.uint64(32)) | self.start  # one look-up gives a symbol's frequency and start
        self.common = int(self.freq.argmax())


def scale_frequencies(counts: np.ndarray, total: int = 1 << PROB_BITS) -> np.ndarray:
    """Counts as frequencies of 1 at least that sum to total; there are at most total / 2 of them."""
    if not len(counts):
        return np.zeros(0, np.int64)
    if 2 * len(counts) > total:
        raise ValueError("too many symbols for the table")
    freq = 1 + (counts.astype(np.float64) / counts.sum() * (total - len(counts))).astype(np.int64)
    freq[np.argmax(freq)] += total - freq.sum()
    return freq


def encode_block(docs: list[tuple[int | None, np.ndarray]], model: Model) -> bytes:
    """The payload of a block with these documents, each (doc_id, ids)."""
    ids = np.concatenate([d[1] for d in docs]).astype(np.int64)
    n = len(ids)
    lanes = 1
    while lanes < MOST_LANES and lanes * 64 < n:
        lanes *= 2
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, model.common, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    states, half, upper, lower = np.full(lanes, LOW, np.uint64), np.uint64(32), np.uint64(63 - PROB_BITS), np.uint64(0xFFFFFFFF)
    words: list[np.ndarray] = []
    written = 0
    marks = []  # for each segment, from the last: words written so far, states
    for k in range(steps - 1, -1, -1):
        both = model.both[grid[k]]
        f = both >> half
        full = np.flatnonzero(states >= (f << upper))
        if len(full):
            over = states[full]
            words.append(over.astype(np.uint32))
            written += len(full)
            states[full] = over >> half
        quotient = states // f
        # quotient << PROB_BITS, and the remainder
        states += quotient * (np.uint64(1 << PROB_BITS) - f)
        states += both & lower
        if k % SEGMENT_STEPS == 0:
            marks.append((written, states.copy()))
    total = written
    marks.reverse()
    crcs = [zlib.crc32(ids[i : i + SEGMENT_STEPS * lanes].astype("<u4").tobytes()) for i in range(0, n, SEGMENT_STEPS * lanes)]
    table = np.array([(i * SEGMENT_STEPS, total - m[0], c) for i, (m, c) in enumerate(zip(marks, crcs, strict=True))], "<u4")
    return b"".join([
        struct.pack(_HEAD, b"RNS1", PROB_BITS, lanes, len(docs), n, len(marks), total),
        bytes(d[0] is not None for d in docs),
        np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
        np.array([len(d[1]) for d in docs], "<u4").tobytes(),
        table.tobytes(),
        b"".join(m[1].astype("<u8").tobytes() for m in marks),
        b"".join(w.astype("<u4").tobytes() for w in reversed(words)),
    ])


class Block:
    """A payload's parts; ids are decoded on demand, a segment at a time."""

    def __init__(self, payload: bytes):
        magic, bits, self.lanes, docs, self.n_tokens, self.segments, words = struct.unpack_from(_HEAD, payload)
        if magic != b"RNS1" or bits != PROB_BITS:
            raise ValueError("not a block of this format")
        at = struct.calcsize(_HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, count, at)
            at += got.nbytes
            return got

        has, ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [int(i) if h else None for h, i in zip(has, ids, strict=True)]
        self.lengths = take("<u4", docs)
        self.table = take("<u4", 3 * self.segments).reshape(-1, 3)
        self.states = take("<u8", self.lanes * self.segments).reshape(-1, self.lanes)
        self.words = take("<u4", words)

    def decode(self, segment: int, model: Model) -> np.ndarray:
        """The ids of one segment, from its checkpoint alone; they are held against its checksum."""
        first, at, crc = (int(x) for x in self.table[segment])
        steps = min(SEGMENT_STEPS, -(-self.n_tokens // self.lanes) - first)
        states, mask, half, lower = self.states[segment].astype(np.uint64), np.uint64((1 << PROB_BITS) - 1), np.uint64(32), np.uint64(0xFFFFFFFF)
        out = np.empty((steps, self.lanes), np.uint32)
        for k in range(steps):
            slot = states & mask
            out[k] = s = model.slots[slot]
            both = model.both[s]
            states >>= np.uint64(PROB_BITS)
            states *= both >> half
            states += slot
            states -= both & lower
            low = np.flatnonzero(states < np.uint64(LOW))
            if need := len(low):
                states[low] = (states[low] << half) | self.words[at : at + need]
                at += need
        ids = out.reshape(-1)[: self.n_tokens - first * self.lanes].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a segment's checksum doesn't hold")
        return ids

    def decode_all(self, model: Model) -> np.ndarray:
        return np.concatenate([self.decode(k, model) for k in range(self.segments)])


def tokenize(docs: DataFrame, tokenizer_file: str, kind: str = "bytes", end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian u16, with the end id), tie (their crc32), counts; null and empty texts give the end
    id alone.

    Strings of the tokenizer's special tokens in a text give their ids, as the library has it, or are text like any other
    with special_as_text. A vocabulary beyond 16 bits is refused.

    At its end each task adds a row with counts, how often it has each id (binary, u64), and no ids.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(2, "little")
    names = ["doc_id", "ids", "tie", "counts"]

    def run(batches):
        enc = encoder(model.value, kind, special_as_text, keep=250_000)
        size = enc.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids have to fit in 16 bits")
        counts = np.zeros(max(size, end_id + 1), np.int64)
        for batch in batches:
            for part in by_size(batch):
                ids = [x + end for x in enc.encode([t or "" for t in part.column("text").to_pylist()], "<u2")]
                counts += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=len(counts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([counts.astype("<u8").tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, ids binary, tie long, counts binary")


def count_symbols(tokens: DataFrame) -> DataFrame:
    """symbol, n: over all ids of tokenize(), from what its tasks have counted."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                counts = np.frombuffer(raw, "<u8").astype(np.int64)
                got = counts.nonzero()[0]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(counts[got], pa.int64())], names=["symbol", "n"])

    return tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def _model(spark: SparkSession, path: str):
    """The table has one row for each symbol of the tokenizer at most."""
    got = spark.read.parquet(f"{path}/frequencies").orderBy("symbol").toPandas()
    return spark.sparkContext.broadcast(Model(got["symbol"].to_numpy(np.int64), got["frequency"].to_numpy(np.int64)))


def write_store(docs: DataFrame, tokenizer_file: str, path: str) -> None:
    """Write the ids of docs as a store at path.

    Null doc_ids come first, rows of one doc_id in an order of their ids, each written; so no doc_id has to fit in one
    task. A long text is one document of one block, however many segments it takes. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer_file), "tokens")
    counts = count_symbols(tokens).orderBy("symbol").toPandas()
    counts["frequency"] = scale_frequencies(counts["n"].to_numpy(np.int64))
    spark.createDataFrame(counts[["symbol", "frequency"]], "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    model = _model(spark, path)

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        held, n, part, seq = [], 0, TaskContext.get().partitionId(), 0

        def flush():
            nonlocal held, n, seq
            made = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([n], pa.int64()), pa.array([encode_block(held, model.value)], pa.binary())], names=["part", "seq", "n_tokens", "payload"])
            held, n, seq = [], 0, seq + 1
            return made

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                if held and n + len(ids) > BLOCK_TOKENS:
                    yield flush()
                held.append((doc, ids))
                n += len(ids)
        if held:
            yield flush()

    rows = tokens.filter("counts IS NULL").select("doc_id", "tie", "ids")
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    ordered.mapInArrow(lean(blocks), "part long, seq long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(tokens)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and ids if asked for, decoded from the store's files."""
    model = _model(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    schema = "part long, seq long, doc_id long, _inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for batch in batches:
            for part, seq, payload in zip(batch.column("part"), batch.column("seq"), batch.column("payload"), strict=True):
                block = Block(payload.as_py())
                raw = memoryview(block.decode_all(model.value).tobytes())
                ends = 4 * np.cumsum(block.lengths, dtype=np.int64)
                own = [raw[e - 4 * int(n) : e] for e, n in zip(ends.tolist(), block.lengths, strict=True)]
                cols = [pa.array([part.as_py()] * len(own), pa.int64()), pa.array([seq.as_py()] * len(own), pa.int64()), pa.array(block.doc_ids, pa.int64()), pa.array(ends // 4 - block.lengths, pa.int64()), pa.array(block.lengths, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["part", "seq", "doc_id", "_inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([bytes(x) for x in own], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = blocks.select("part", "seq", "payload").mapInArrow(lean(run), schema)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that wrote
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_all")).select("part", F.coalesce(F.sum("_all").over(before("part")), F.lit(0)).alias("_base"))
    bases = blocks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before("part", "seq")), F.lit(0)).alias("_in_part")).join(parts, "part")
    got = docs.join(bases, ["part", "seq"]).withColumn("start", F.col("_base") + F.col("_in_part") + F.col("_inside"))
    return got.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_store(spark, path)
