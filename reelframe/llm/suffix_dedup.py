"""Removal of repeated passages by a sparse suffix array, built by a merge sort that knows common prefixes.

Whole suffixes of all documents can't be shuffled, so the array is sparse: of each window of `length` bytes the 16-byte
string with the least hash is its anchor, and equal windows have the same anchor at the same place. A fingerprint pass
finds the anchors whose string occurs again; only their suffixes, cut at `length` bytes, are sorted. Each task sorts its
own suffixes and front-codes them (a suffix holds only what its predecessor doesn't), the runs are exchanged, and each
partition merges its runs through a loser tree which compares two suffixes only beyond the prefix that they are known to
share. The merged order comes with the common prefix of neighbours, which says at once which suffixes agree in the part
of a window right of its anchor; the reversed bytes before the anchors, sorted alike, say it for the part left of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelframe.llm.common import by_bytes, by_size, join_bytes, lean, read_table

LENGTH = 100
ANCHOR = 16
FIRST = -(1 << 63)
#: What repeated_passages() reads; a caller that joins these columns again shares its shuffle of the texts.
COLUMNS = ["doc_id", "text", "th", "doc"]
CHUNK_BYTES = 1 << 21
RUN_SUFFIXES = 30_000
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at each place; the last 15 places hash zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    word = np.empty(len(padded) // 8 * 8 - 8, np.uint64)
    for r in range(8):
        own = padded[r : r + (len(word) - r + 7) // 8 * 8].view("<u8")
        word[r::8] = own[: len(word[r::8])]
    a, b = word[: len(data)], word[8 : len(data) + 8]
    h = (a * _C1) ^ ((b ^ (a >> np.uint64(31))) * _C2)
    h ^= h >> np.uint64(32)
    h *= _C3
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(place, lo, hi, key) of the anchors in documents that lie end to end: it is that of the windows that start from
    hi to lo bytes before it. Windows stay inside a document; of equal hashes the leftmost counts."""
    n, width = len(data), length - ANCHOR + 1
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64)
    h = _hashes(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    ends = np.repeat(starts[1:], np.diff(starts))
    x = np.flatnonzero(np.arange(n) + length <= ends)
    p = (least[x] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(p)]]).astype(np.int64) - 1
    place = p[new]
    return place, place - x[last[: len(new)]], place - x[new], h[place]


def fingerprint_rows(batches, length: int) -> Iterator[pa.RecordBatch]:
    """(key, doc, at, n): an anchor's string, where it is, and how often the chunk has it.

    at is place << 16 | lo << 8 | hi. The first of a chunk's equal anchors stands for all; the others are known to occur
    again and go by a key of their own, so that no key has more rows than there are chunks.
    """
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        docs = batch.column("doc").to_numpy(zero_copy_only=False)
        for a, b in by_bytes(texts, CHUNK_BYTES):
            data, starts = join_bytes(texts[a:b])
            place, lo, hi, key = anchors(data, starts, length)
            own = np.searchsorted(starts, place, side="right") - 1
            at = (place - starts[own]) << 16 | lo << 8 | hi
            _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            n = n[which]
            other = first[which] != np.arange(len(key))
            key = np.where(other, (docs[a:b][own].view(np.uint64) + at.view(np.uint64) * _C1) * _C2, key)
            n[other] = 2
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(docs[a:b][own]), pa.array(at), pa.array(n.astype(np.int32))], names=["key", "doc", "at", "n"])


def _common(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it, all if they are equal; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 50_000):
        differ = rows[a : a + 50_000] != rows[a - 1 : a - 1 + len(rows[a : a + 50_000])]
        out[a : a + 50_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order of byte rows and numbers, the first column counting most."""
    keys = []
    for c in reversed(columns):
        if c.ndim == 1:
            keys.append(c)
        else:
            wide = np.zeros((len(c), -(-c.shape[1] // 8) * 8), np.uint8)
            wide[:, : c.shape[1]] = c
            keys += list(wide.view(">u8").astype(np.uint64).T[::-1])
    return np.lexsort(keys)


def _strings(data: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(right, left): the bytes from each anchor on, and those before it backwards, both filled up with zeros."""
    padded = np.concatenate([np.zeros(length, np.uint8), data, np.zeros(length, np.uint8)])
    right = padded[place[:, None] + length + np.arange(length)]
    right[np.arange(length) >= (length - lo)[:, None]] = 0
    before = np.arange(1, length - ANCHOR + 1)
    left = padded[place[:, None] + length - before]
    left[before > hi[:, None]] = 0
    return right, left


def sorted_runs(batches, length: int, partitions: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, run) of front-coded runs of suffixes, and rows (part, doc, th, start, end) of passages that a chunk itself
    shows to be repeated; a chunk sends each string once, from its first place."""
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        d, th, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "th", "doc"))
        lists = batch.column("places")
        edges, places = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        edges = edges - edges[0]
        for a, b in by_bytes(texts, CHUNK_BYTES):
            data, starts = join_bytes(texts[a:b])
            all_at = places[edges[a] : edges[b]]
            all_own = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
            for k in range(0, len(all_at), RUN_SUFFIXES):
                at, own = all_at[k : k + RUN_SUFFIXES], all_own[k : k + RUN_SUFFIXES]
                pos, lo, hi = at >> 16, at >> 8 & 255, at & 255
                size = starts[own + 1] - starts[own]
                fits = (pos >= hi) & (pos - lo + length <= size)  # places of another document with the same hash are no use
                at, own, pos, lo, hi = (v[fits] for v in (at, own, pos, lo, hi))
                if not len(at):
                    continue
                right, left = _strings(data, starts[own] + pos, lo, hi, length)
                od, oth, odoc = d[a:b][own], th[a:b][own], doc[a:b][own]
                order = _order(right, lo, left, hi, od, oth, odoc, pos)
                right, left, lo, hi, pos, od, oth, odoc = (v[order] for v in (right, left, lo, hi, pos, od, oth, odoc))
                shared = _common(np.concatenate([right, left, lo[:, None].astype(np.uint8), hi[:, None].astype(np.uint8)], axis=1))
                new = shared < right.shape[1] + left.shape[1] + 2
                new[0] = True
                group = np.cumsum(new) - 1
                heads = np.flatnonzero(new)
                same = (odoc == odoc[heads][group]) & (oth == oth[heads][group]) & (pos == pos[heads][group])
                out = ~same
                if out.any():
                    o_doc, o_th, o_from, o_to = joined(odoc[out], oth[out], (pos - hi)[out], (pos - lo + length)[out])
                    yield _rows((o_doc ^ o_from) % partitions, None, o_doc, o_th, o_from, o_to)
                right, left, lo, hi, pos, od, oth, odoc = (v[heads] for v in (right, left, lo, hi, pos, od, oth, odoc))
                part = (_hashes_of_rows(right) % np.uint64(partitions)).astype(np.int64)
                by_part = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[by_part], prepend=-1))
                runs, parts = [], []
                for i, j in zip(cuts, [*cuts[1:], len(by_part)]):
                    s = by_part[i:j]
                    runs.append(front_code(right[s], left[s], lo[s], hi[s], pos[s], od[s], oth[s], odoc[s], length))
                    parts.append(int(part[s[0]]))
                yield _rows(np.array(parts), runs, None, None, None, None)


def joined(doc: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, th, start, end): the passages of each document with those that touch made one."""
    order = np.lexsort((start, th, doc))
    doc, th, start, end = (v[order] for v in (doc, th, start, end))
    base = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])).astype(np.int64) << 40
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate([[True], (start + base)[1:] > reach[:-1]])
    last = np.flatnonzero(np.concatenate([new[1:], [True]]))
    return doc[new], th[new], start[new], (reach - base)[last]


def _hashes_of_rows(right: np.ndarray) -> np.ndarray:
    """The anchors' hashes again, from the first 16 bytes of their suffixes."""
    two = np.ascontiguousarray(right[:, :ANCHOR]).view("<u8")
    h = (two[:, 0] * _C1) ^ (two[:, 1] * _C2)
    return h ^ (h >> np.uint64(33))


def _rows(part, runs, doc, th, start, end) -> pa.RecordBatch:
    n = len(part)
    none = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(v, kind)
    return pa.RecordBatch.from_arrays([pa.array(np.abs(part), pa.int32()), none(runs, pa.binary()), none(doc, pa.int64()), none(th, pa.int64()), none(start, pa.int64()), none(end, pa.int64())], names=["part", "run", "doc", "th", "start", "end"])


def front_code(right, left, lo, hi, pos, d, th, doc, length: int) -> bytes:
    """A sorted run, compressed: counts, then the columns; of each suffix only the bytes its predecessor doesn't share."""
    size = length - lo
    shared = np.minimum(_common(right), size)
    rest = right[(np.arange(right.shape[1]) >= shared[:, None]) & (np.arange(right.shape[1]) < size[:, None])]
    before = left[np.arange(left.shape[1]) < hi[:, None]]
    head = np.array([len(pos), len(rest), len(before)], "<i8")
    return zstandard.compress(b"".join(v.tobytes() for v in (head, shared.astype(np.uint8), lo.astype(np.uint8), hi.astype(np.uint8), pos.astype("<i8"), d.astype("<i8"), th.astype("<i8"), doc.astype("<i8"), rest, before)))


def read_run(run: bytes, length: int) -> dict:
    """front_code()'s columns; suffixes as bytes filled up with zeros."""
    run = zstandard.decompress(run)
    n, n_rest, n_left = np.frombuffer(run, "<i8", 3).tolist()
    at, out = 24, {"n": n}
    for name, kind, count in (("shared", "u1", n), ("lo", "u1", n), ("hi", "u1", n), ("pos", "<i8", n), ("d", "<i8", n), ("th", "<i8", n), ("doc", "<i8", n), ("rest", "u1", n_rest), ("before", "u1", n_left)):
        out[name] = np.frombuffer(run, kind, count, at)
        at += out[name].nbytes
    rest, shared = out["rest"].tobytes(), out["shared"].tolist()
    ends = np.cumsum(length - out["lo"].astype(np.int64) - out["shared"]).tolist()
    suffixes, last, k = [], bytes(length), 0
    for s, e in zip(shared, ends, strict=True):
        last = (last[:s] + rest[k:e]).ljust(length, b"\0")
        suffixes.append(last)
        k = e
    out["suffixes"] = suffixes
    left = np.zeros((n, length - ANCHOR), np.uint8)
    left[np.arange(length - ANCHOR) < out["hi"].astype(np.int64)[:, None]] = out["before"]
    out["left"] = left
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]], length: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (suffixes, bytes shared with the predecessor) through a loser tree.

    Returns the order, as (run, index), and what each suffix shares with the one before it. Each run's next suffix is
    kept with what it shares with the last one that was put out. Of two, the one that shares more comes first; only if
    they share the same are they compared, from there on, and the loser then keeps what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    end = (b"", -1)
    heads = [(r[0][0], 0) if r[0] else end for r in runs] + [end] * (k - len(runs))
    at = [0] * k
    losers: list[tuple[bytes, int, int]] = [(b"", -1, -1)] * k

    def play(a, b):
        """(winner, loser) of two players (suffix, shared, run); shared is -1 beyond a run's end."""
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        if a[1] < 0 or a[0] == b[0]:
            return (a, (b[0], length if a[1] >= 0 else -1, b[2])) if a[2] <= b[2] else (b, (a[0], length if a[1] >= 0 else -1, a[2]))
        h, x, y = a[1], a[0], b[0]
        differ = int.from_bytes(x[h:], "big") ^ int.from_bytes(y[h:], "big")
        h = length - (differ.bit_length() + 7) // 8
        return (a, (y, h, b[2])) if x[h] < y[h] else (b, (x, h, a[2]))

    players = [(h[0], h[1], i) for i, h in enumerate(heads)]
    tree = [None] * k + players
    for node in range(k - 1, 0, -1):
        tree[node], losers[node] = play(tree[2 * node], tree[2 * node + 1])
    winner = tree[1]
    order, shared = [], []
    while winner[1] >= 0:
        run = winner[2]
        order.append((run, at[run]))
        shared.append(winner[1])
        at[run] += 1
        suffixes, lcps = runs[run]
        winner = (suffixes[at[run]], lcps[at[run]], run) if at[run] < len(suffixes) else (b"", -1, run)
        node = (k + run) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return order, shared


def repeated_windows(shared: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat an earlier one: entry x bytes before the anchor, for suffixes in merged order. rank orders
    them by document and place. Two windows are equal if both their parts, left and right of the anchor, are."""
    n = len(lo)
    by_left = _order(left)
    shared_left = _common(left[by_left])
    out = np.zeros((n, length - ANCHOR + 1), bool)
    class_left = np.empty(n, np.int64)
    for a in range(length - ANCHOR + 1):
        some = np.flatnonzero((lo <= a) & (a <= hi))
        if len(some) < 2:
            continue
        class_right = np.cumsum(shared < length - a)
        class_left[by_left] = np.cumsum(shared_left < a)
        group = class_right[some] * (n + 1) + class_left[some]
        order = np.lexsort((rank[some], group))
        group, own = group[order], rank[some][order]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        first = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        out[some[order], a] = own > first
    return out


def merged_passages(runs: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(doc, th, start, end) of the passages that the runs of one partition show to be repeated."""
    read = [read_run(r, length) for r in runs]
    order, shared = merge_runs([(r["suffixes"], r["shared"].tolist()) for r in read], length)
    base = np.cumsum([0] + [r["n"] for r in read])
    take = np.array([base[r] + i for r, i in order], np.int64)
    col = lambda name: np.concatenate([r[name] for r in read])[take]
    lo, hi, pos, d, th, doc = (col(c).astype(np.int64) for c in ("lo", "hi", "pos", "d", "th", "doc"))
    by = np.lexsort((pos, doc, th, d))
    new = np.ones(len(by), bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (th[by][1:] != th[by][:-1]) | (pos[by][1:] != pos[by][:-1])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    found = repeated_windows(np.array(shared, np.int64), col("left"), lo, hi, rank, length)
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return doc[row], th[row], pos[row] - last, pos[row] - first + length


def merge_partitions(batches, length: int) -> Iterator[pa.RecordBatch]:
    """(doc, th, start, end) of repeated passages, from sorted_runs()'s rows sorted by part."""
    held: dict[int, list[bytes]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for runs in held.values():
            found = merged_passages(runs, length)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["doc", "th", "start", "end"])
        held.clear()

    for batch in batches:
        run = batch.column("run")
        plain = batch.filter(run.is_null()).select(["doc", "th", "start", "end"])
        if plain.num_rows:
            yield plain
        rows = batch.filter(run.is_valid())
        for part, own in zip(rows.column("part").to_pylist(), rows.column("run").to_pylist(), strict=True):
            if held and part not in held:
                yield from flush()
            held.setdefault(part, []).append(own)
    yield from flush()


def repeated_passages(docs: DataFrame, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """doc, found: for each doc of identified() with any, (th, start << 32 | end) of the repeated passages' bytes, which
    own_spans() takes apart.

    Anchors are looked up by doc alone: documents of one doc look at each other's places besides their own, in vain.
    """
    partitions = partitions or max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prints = docs.select("doc", "text").mapInArrow(lean(lambda b: fingerprint_rows(b, length)), "key long, doc long, at long, n int")
    again = prints.selectExpr("doc", "at", "sum(n) OVER (PARTITION BY key) AS total").filter("total > 1")
    places = again.groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("places"))
    d = F.coalesce("doc_id", F.lit(FIRST)).alias("d")
    runs = docs.join(places, "doc").select(d, "th", "doc", "text", "places").mapInArrow(lean(lambda b: sorted_runs(b, length, partitions)), "part int, run binary, doc long, th long, start long, end long")
    dealt = runs.repartition(partitions, "part").sortWithinPartitions("part")
    spans = dealt.mapInArrow(lean(lambda b: merge_partitions(b, length)), "doc long, th long, start long, end long")
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("end"))
    return spans.select("doc", F.struct("th", packed.alias("span")).alias("span")).groupBy("doc").agg(F.collect_set("span").alias("found"))


def own_spans(found: str, th: Column) -> Column:
    """The spans of the document whose text has this hash."""
    return F.transform(F.filter(found, lambda x: x["th"] == th), lambda x: x["span"])


def identified(docs: DataFrame) -> DataFrame:
    """docs with th and doc, two hashes of doc_id and text. doc_id, null first, and th order documents.

    Rows with the same doc_id and text are one document. It goes by both hashes, 128 bits: doc takes th, and so the text, into the
    seed with which it hashes the text once more. One of them alone decides nothing.
    """
    text = F.coalesce("text", F.lit(""))
    th = F.xxhash64(text)
    return docs.withColumns({"th": th, "doc": F.xxhash64(F.coalesce("doc_id", F.lit(FIRST)), th, text)})


def _union(spans: list[int] | None, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(spans or ()):
        a, b = s >> 32, min(s & 0xFFFFFFFF, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts are empty. A byte goes if a string of `length` bytes that covers it also starts earlier, in a document
    that comes before or further left in the same one. Repeated rows (same doc_id and text) are one document and each get
    its figures. An empty table gives an empty result.
    """
    named = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select(*COLUMNS)
    found = named.join(repeated_passages(named, length), "doc", "left")

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                own = _union(spans, len(raw))
                rows.append((len(raw), sum(b - a for a, b in own), len(own), hashlib.sha256(_kept(raw, own)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # th is read so that this join's shuffle of the texts is the very one of repeated_passages()
    return found.select("doc_id", "th", "text", own_spans("found", F.col("th")).alias("spans")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut out of their texts, n_chars set anew where it exists, other columns as they are,
    whatever their names.

    A character of which a part goes is dropped whole. Null texts stay null; repeated rows (same doc_id and text) are one
    document and are cut alike; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    named = identified(own)
    spans = repeated_passages(named.select(*COLUMNS), length).withColumnRenamed("doc", "_doc")
    both = named.join(spans, named["doc"] == spans["_doc"], "left")

    def cut(batches):
        for batch in batches:
            for part in by_size(batch):
                texts = part.column("text").to_pylist()
                for k, spans in enumerate(part.column("spans").to_pylist()):
                    if texts[k] is not None and spans:
                        raw = texts[k].encode()
                        texts[k] = _kept(raw, _union(spans, len(raw))).decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    chosen = both.select("row", named["text"], own_spans("found", named["th"]).alias("spans"))
    left = chosen.mapInArrow(lean(cut), StructType([f for f in chosen.schema.fields if f.name != "spans"]))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents"))
