"""SimHash near-duplicates by the generalised pigeonhole principle, and connected components.

near_duplicates() links fingerprints. keep_first() takes such links as candidates, compares them by their whole sets of
shingles, and completes them: fingerprints can't promise to find all sets of a similarity of 0.8, a prefix filter can.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import by_size, discard, lean, let, lower_ascii, materialize, read_table, words

BITS = 64
DISTANCE = 2
SHINGLE = 3
BUCKET = 128
#: Texts of the sample that guides the first order of shingles. Whatever it misses is mended by counts over all rows.
SAMPLE = 5000
#: Where more rows of about the same size share a shingle, besides those of the largest component, they don't meet pair by
#: pair: their shingles are ordered anew.
CROWD = 64
_ODD = np.uint64(0x9FB21C651E98DF25)


def shingle_hashes(text: Column | str, shingle: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each shingle of the lower-cased text; of all words, if they are fewer; none without words."""
    joined = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - shingle + 1),
        lambda i: F.xxhash64(F.concat_ws(" ", *(F.element_at(w, i + k) for k in range(shingle)))),
    )
    few = lambda w: F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return let(words(lower_ascii(text)), lambda w: F.when(F.size(w) >= shingle, joined(w)).otherwise(few(w)))


def majority_bits(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each list of hashes: a bit is 1 if over half of them have it; 0 without hashes."""
    n = np.diff(offsets)
    some = n > 0
    firsts, out = offsets[:-1][some], np.zeros(len(n), np.uint64)
    got = np.zeros(len(firsts), np.uint64)
    for b in range(BITS if len(h) else 0):
        ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), firsts)
        got |= (2 * ones > n[some].astype(np.uint64)).astype(np.uint64) << np.uint64(b)
    out[some] = got
    return out


def fingerprints(hashed: DataFrame) -> DataFrame:
    """id, fp of (id, h): majority_bits() of the hashes in h."""

    def run(batches):
        for batch in batches:
            for part in by_size(batch, "h", 1 << 18):
                lists = part.column("h")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                fp = majority_bits(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return hashed.select("id", "h").mapInArrow(lean(run), "id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, how many have both bits i and j): over all rows, 64 x 64 numbers from each task."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                x = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                both += x.T @ x
                n += len(fp)
        flat = both.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1), pa.int32()), pa.array(np.append(flat, n).astype(np.int64), pa.int64())], names=["k", "n"])

    got = {r["k"]: r["n"] for r in fps.select("fp").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    flat = np.array([got.get(k, 0) for k in range(BITS * BITS + 1)], float)
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance that two random rows agree in bit i, and in bits i and j."""
    ones = np.diag(both)
    cells = [both, ones[:, None] - both, ones[None, :] - both, n - ones[:, None] - ones[None, :] + both]
    pair = sum((c / max(n, 1)) ** 2 for c in cells)
    p = ones / max(n, 1)
    return p**2 + (1 - p) ** 2, np.maximum(pair, 1e-12)


def _match_chance(bits: tuple[int, ...], one: np.ndarray, pair: np.ndarray) -> float:
    """That two random rows agree in all these bits: a chain in which each bit depends on the one before."""
    chance = one[bits[0]] if bits else 1.0
    for a, b in zip(bits, bits[1:]):
        chance *= min(1.0, pair[a, b] / one[a])
    return float(chance)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Correlated bits together: each part takes in turn the free bit that goes best with those it has."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - p[:, None] * p[None, :]
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(cov / sd[:, None] / sd[None, :])
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), [[] for _ in range(parts)]
    turn = 0
    while free:
        g = groups[turn % parts]
        if g:
            best = max(sorted(free), key=lambda b: tie[b, g].mean())
        else:
            best = max(sorted(free), key=lambda b: tie[b].sum())
        g.append(best)
        free.discard(best)
        turn += 1
    return [tuple(g) for g in groups]


def allocate(costs: list[list[float]], units: int) -> list[int]:
    """Thresholds by dynamic programming: costs[i][u] is what part i costs with threshold u - 1, and -1 leaves it out.

    By the pigeonhole principle, thresholds t with sum(t + 1) = distance + 1 lose no pair.
    """
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(float("inf"), ())] * units
    for c in costs:
        best = [min((best[u - v][0] + c[v], best[u - v][1] + (v,)) for v in range(min(u, len(c) - 1) + 1)) for u in range(units + 1)]
    return [v - 1 for v in best[units][1]]


def choose_parts(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[tuple[int, ...], int]]:
    """[(bits, threshold)]: the cheapest of several numbers of parts, by probes and estimated candidates."""
    one, pair = _agreement(n, both)
    found = []
    for parts in range(2, distance + 3):
        groups = group_bits(n, both, parts)
        costs = []
        for bits in groups:
            c = [0.0]
            for t in range(distance + 1):
                masks = [m for k in range(t + 1) for m in combinations(range(len(bits)), k)]
                if t == 2 or len(masks) > 64:
                    c.append(float("inf"))
                    continue
                chance = sum(_match_chance(tuple(b for i, b in enumerate(bits) if i not in m), one, pair) for m in masks if len(m) == t or t == 0)
                c.append(n * len(masks) + 0.05 * n * n / 2 * chance)
            costs.append(c)
        t = allocate(costs, distance + 1)
        found.append((sum(costs[i][x + 1] for i, x in enumerate(t)), [(g, x) for g, x in zip(groups, t, strict=True) if x >= 0]))
    return min(found, key=lambda f: f[0])[1]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def probes(prints: DataFrame, parts: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """id, fp, mask, value: what a row is looked up by. A threshold of 1 leaves out one bit after the other."""
    masks = [_mask(set(bits) - {b}) for bits, t in parts for b in (bits if t == 1 else [-1])]
    each = prints.select("id", "fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    return each.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _forest(batches, distance: int):
    """(a, b): links of at most the distance among the rows of each probe, fewer than rows; the closest come first."""
    for batch in batches:
        left, right = [], []
        for rows in batch.column("rows"):
            ids = rows.values.field("id").to_numpy(zero_copy_only=False)
            fp = rows.values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            far = np.bitwise_count(fp[:, None] ^ fp[None, :])
            i, j = np.nonzero(np.triu(far <= distance, 1))
            closest = np.argsort(far[i, j], kind="stable")
            root, open_ = list(range(len(ids))), len(ids) - 1

            def top(i, root=root):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for x, y in zip(i[closest].tolist(), j[closest].tolist()):
                p, q = top(x), top(y)
                if p != q:
                    root[q] = p
                    left.append(ids[x])
                    right.append(ids[y])
                    open_ -= 1
                    if not open_:
                        break
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links of rows (id, fp) that connect all rows within the distance of each other. Fingerprints are distinct.

    Rows that share a probe are candidates. In a probe of at most `bucket` rows each pair is verified, and a spanning
    forest of the links is kept, fewer than rows. A fuller probe is split by the same principle: its rows differ in at most
    `distance` of the bits that the probe leaves open, so they agree in one of distance + 1 parts of them, and each part
    makes a narrower probe. It ends, as fingerprints differ: a probe that leaves out few bits has few rows.
    """
    bucket = max(bucket, 1 << distance)  # where at most `distance` bits are open, no probe is fuller
    n, both = bit_statistics(prints)
    level, key, found = probes(prints, choose_parts(n, both, distance)), ["mask", "value"], []
    while True:
        level = materialize(level, "probes")
        counts = materialize(level.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "probe-counts")
        lists = level.join(counts.filter(F.col("n") <= bucket), key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("id", "fp"))).alias("rows"))
        found.append(materialize(lists.select("rows").mapInArrow(lean(lambda b: _forest(b, distance)), "a long, b long"), "links"))
        full = counts.filter(F.col("n") > bucket)
        masks = [r["mask"] for r in full.select("mask").distinct().collect()]  # a few for each level
        if not masks:
            discard(level, counts)
            break
        narrower = {}
        for m in masks:
            rest = [b for b in range(BITS) if not (m >> b) & 1]
            narrower[m] = [_mask([*(b for b in range(BITS) if (m >> b) & 1), *rest[k :: distance + 1]]) for k in range(distance + 1)]
        pairs = prints.sparkSession.createDataFrame([(m, x) for m, xs in narrower.items() for x in xs], "mask long, narrower long")
        more = level.join(full.drop("n"), key).join(F.broadcast(pairs), "mask").select("id", "fp", F.col("narrower").alias("mask")).dropDuplicates(["id", "mask"])
        wider, level = (level, counts), materialize(more.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "probes")
        discard(*wider)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b) lead to, for each node that has an edge.

    Large-star and small-star steps in turn until nothing changes. Each is a minimum by node, which is combined before it
    is shuffled, and a join that can be split where a node has many edges.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(down, "u").select(F.col("v").alias("x"), "m", "u")
        small = turned.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, now = now, materialize(small, "edges")
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links of at most `distance` bits lead to.

    Equal fingerprints are one class, which takes part once, under its least doc_id; a document whose doc_id is null is
    in the component of its class, which is null if no doc_id is known. Repeated rows are each returned; an empty table
    gives an empty result. Null and wordless texts have fingerprint 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("long").alias("id"), shingle_hashes(text, shingle).alias("h"))
    prints = materialize(fingerprints(hashed).select(F.col("id").alias("doc_id"), "fp"), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "classes")
    known = classes.filter(F.col("class_id").isNotNull()).select(F.col("class_id").alias("id"), "fp")
    comp = components(links(known, distance))
    classes = classes.join(comp, F.col("class_id") == F.col("node"), "left").select("fp", F.coalesce("component", "class_id").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])


def shingle_lists(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the hashes of each text's lower-cased word shingles in order; of all words, if they are fewer.

    Words are found by array operations, each distinct one is hashed once, and a shingle's hash is made from its words'.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    data = _LOWER[np.frombuffer(b"".join(texts.to_pylist()), np.uint8)]
    gap = np.concatenate([[True], _SPACE[data], [True]])
    first = np.zeros(len(data) + 1, bool)
    first[np.append(0, ends)] = True
    word = ~gap[1:-1]
    starts, stops = np.flatnonzero(word & (gap[:-2] | first[:-1])), np.flatnonzero(word & (gap[2:] | first[1:])) + 1
    edges = np.append(0, np.cumsum(stops - starts))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[word])]).dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64)
    at = np.append(0, np.searchsorted(starts, ends))
    n = np.diff(at)
    until = np.repeat(at[1:], n) - np.arange(len(each))  # words from each to its text's end
    out = np.zeros(len(each), np.uint64)
    for k in range(shingle):
        ahead = np.concatenate([each[k:], np.zeros(min(k, len(each)), np.uint64)])
        out = (out ^ np.where(until > k, ahead, np.uint64(0))) * (_ODD + np.uint64(2 * k))
        out ^= out >> np.uint64(29)
    some = until >= shingle
    short = (n > 0) & (n < shingle)
    some[at[:-1][short]] = True
    return out[some], np.append(0, np.cumsum(np.where(short, 1, np.maximum(n - shingle + 1, 0))))


def text_digest(text: Column) -> Column:
    """128 bits that name a text: its MD5; that of no text for null."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("")).cast("binary")))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """id, h of texts (id, text): the distinct hashes of shingle_lists(), in order."""

    def run(batches):
        for batch in batches:
            for part in by_size(batch):
                values, offsets = shingle_lists(part.column("text"), shingle)
                sets = [np.unique(values[a:b]).view(np.int64) for a, b in zip(offsets, offsets[1:])]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], names=["id", "h"])

    return texts.select("id", "text").mapInArrow(lean(run), "id long, h array<long>")


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least three texts of a bounded sample, in order, and how many these are. It only guides an order."""
    some = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(-(-texts.count() // SAMPLE) or 1)) == 0)
    each = shingle_sets(some.select(F.lit(0).cast("long").alias("id"), "text"), shingle).select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    got = each.filter("n > 2").orderBy(F.desc("n"), "h").limit(10 * SAMPLE).orderBy("h").collect()
    return np.array([r["h"] for r in got], np.int64), np.array([r["n"] for r in got], np.int64)


def prefixes(texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """digest, key, fp, n, tokens of texts (digest, text) with words: 128 bits that name the set of shingles, its fingerprint,
    size and prefix.

    A prefix is the first shingles of a set in an order that all sets have in common, frequent ones last. It is so long
    that sets of at least this similarity have one in common.
    """
    often, times = _frequent(texts, shingle)

    def run(batches):
        for batch in batches:
            for part in by_size(batch):
                values, offsets = shingle_lists(part.column("text"), shingle)
                sets = [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:])]
                sizes = np.array(list(map(len, sets)))
                fp = majority_bits(np.concatenate([np.empty(0, np.uint64), *sets]), np.append(0, np.cumsum(sizes)))
                keys, tokens = [], []
                for x in sets:
                    keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    x = x.view(np.int64)
                    if len(often) and len(x):
                        at = np.minimum(np.searchsorted(often, x), len(often) - 1)
                        x = x[np.argsort(np.where(often[at] == x, times[at], 0), kind="stable")]
                    tokens.append(x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1])
                ends = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
                flat = pa.array(np.concatenate([np.empty(0, np.int64), *tokens]))
                made = [part.column("digest"), pa.array(keys, pa.binary()), pa.array(fp.view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, flat)]
                yield pa.RecordBatch.from_arrays(made, names=["digest", "key", "fp", "n", "tokens"]).filter(pa.array(sizes > 0))

    return texts.select("digest", "text").mapInArrow(lean(run), "digest binary, key binary, fp long, n int, tokens array<long>")


def _sized(like: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return F.least("n_a", "n_b") >= like * F.greatest("n_a", "n_b") - 1e-9


def _stars(shared: DataFrame, like: float) -> DataFrame:
    """(a, b): the rows that share a token, each with the one of them whose prefix other sets share most, if the tokens
    that two prefixes share don't rule the similarity out. Fewer pairs than rows."""
    central = shared.groupBy("id").agg((F.sum("df") / F.first("p")).alias("rank"))
    most = shared.join(central, "id").groupBy("token").agg(F.max(F.struct("rank", "id", "n", "p")).alias("f"))
    one = most.select("token", *(F.col(f"f.{c}").alias(f"{c}_a") for c in ("id", "n", "p")))
    other = shared.select("token", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "p")))
    pairs = one.join(other, "token").filter((F.col("id_a") != F.col("id_b")) & _sized(like))
    rest = F.greatest(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    counted = pairs.groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(F.count("*").alias("c"), F.first(F.col("n_a") + F.col("n_b")).alias("sum"), F.first(rest).alias("rest"))
    return counted.filter(F.col("c") + F.col("rest") >= like / (1 + like) * F.col("sum") - 1e-9).select("a", "b")


def _met(open_: DataFrame, like: float) -> DataFrame:
    """(a, b): pairs of rows of different components that can be so similar by their sizes and the place of a shared token.

    open_: token, cell, largest, id, n, i, component. The first token that two such sets share stands so early in both that
    enough shingles are left; other rows of a token don't meet. Rows of a cell's largest component only meet the others.
    """
    one, other = (open_.select("token", "cell", "largest", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "i", "component"))) for x in "ab")
    pairs = one.filter("component_a <> largest").drop("largest").join(other.drop("largest"), ["token", "cell"])
    left = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    pairs = pairs.filter((F.col("component_a") != F.col("component_b")) & _sized(like) & (left >= like / (1 + like) * (F.col("n_a") + F.col("n_b")) - 1e-9))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _open(shared: DataFrame, labels: DataFrame, like: float) -> DataFrame:
    """token, cell, id, n, i, component, largest, outside of the rows of cells that several components share: the cell's
    largest component, and how many of its rows are in others.

    A cell is a token and a range of sizes. Ranges overlap by half and each half spans the similarity, so a row is in two of
    them and rows whose sizes allow the similarity are in one together.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(like - 1e-6))).cast("int")
    now = shared.join(labels, F.col("id") == F.col("node"), "left").select("token", "id", "n", "i", F.coalesce("component", "id").alias("component"), F.explode(F.array(step, step + 1)).alias("cell"))
    per = now.groupBy("token", "cell", "component").agg(F.count("*").alias("c"))
    per = per.groupBy("token", "cell").agg(F.count("*").alias("of"), F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("largest")).filter("of > 1")
    return now.join(per.select("token", "cell", F.col("largest.component").alias("largest"), (F.col("all") - F.col("largest.c")).alias("outside")), ["token", "cell"])


def _reordered(crowded: DataFrame, sets: DataFrame, texts: DataFrame, like: float, shingle: int) -> DataFrame:
    """token, id, n, i of the prefixes of crowded (id), shingles ordered by how many of these rows have them.

    All shingles of these rows are counted, over all of them. Those of one row alone come first and meet nobody, so only
    shared ones go back to their rows, and of a row with enough shingles of its own none is left.
    """
    full = materialize(_whole_sets(crowded, sets, texts, shingle), "crowded-sets")
    each = full.select("id", F.size("h").alias("n"), F.explode("h").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    back = each.join(counts, "token").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    alone = F.col("n") - F.size("common")
    prefix = (F.col("n") - F.ceil(like * F.col("n") - 1e-9) + 1).cast("int")
    some = back.filter(prefix > alone).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), prefix - alone)).alias("k", "x"))
    return some.select(F.col("x.token").alias("token"), "id", "n", (F.col("alone") + F.col("k")).alias("i"))


def _others(shared: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame, like: float, shingle: int) -> DataFrame:
    """(a, b): all pairs of rows of different components that can be so similar by their sizes and shared tokens.

    A cell of a token with at most CROWD rows outside its largest component lets them meet, which is CROWD pairs a row at
    most. The rows of fuller cells take new prefixes, ordered by counts over all of them: what a passage adds to many
    texts comes last there, and texts that share nothing else don't meet. Both rows of a pair in a full cell are among
    them, so none is lost. Of the pairs that have met, those stay whose prefixes share so many tokens that what is left of the
    longer rest can make up for the others.
    """
    now = materialize(_open(shared, labels, like), "open-shingles")
    crowded = materialize(now.filter(F.col("outside") > CROWD).select("id").distinct(), "crowded")
    anew = materialize(_reordered(crowded, sets, texts, like, shingle), "reordered-shingles")
    pairs = _met(now.filter(F.col("outside") <= CROWD), like).unionByName(_met(_open(anew, labels, like), like))
    pairs = materialize(pairs.distinct(), "met")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = shared.join(ids, "id", "left_semi").groupBy("id").agg(F.struct(F.first("n").alias("n"), F.first("p").alias("p"), F.collect_list("token").alias("tokens")).alias("own"))
    own = materialize(own, "shared-prefixes")
    x, y = F.col("x"), F.col("y")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    most = F.size(F.array_intersect(x["tokens"], y["tokens"])) + F.greatest(x["n"] - x["p"], y["n"] - y["p"])
    out = materialize(both.filter(most >= like / (1 + like) * (x["n"] + y["n"]) - 1e-9).select("a", "b"), "candidates")
    discard(now, crowded, anew, pairs, own)
    return out


def _whole_sets(ids: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """id, h: all shingles of the sets with these ids. sets: id, digest; texts: digest, text, copies of which count once."""
    wanted = sets.select("id", "digest").join(ids, "id", "left_semi")
    own = texts.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    return shingle_sets(own.join(wanted, "digest").select("id", "text"), shingle)


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, like: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles are so similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = materialize(_whole_sets(ids, sets, texts, shingle), "shingle-sets")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(own.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    near = materialize(both.filter(common >= like * (F.size("ha") + F.size("hb") - common) - 1e-9).select("a", "b"), "near")
    discard(own)
    return near


def similar(texts: DataFrame, sets: DataFrame, like: float, shingle: int) -> DataFrame:
    """(a, b): pairs of sets (id, digest, fp, n, tokens) of at least this similarity that connect all such pairs.

    First come SimHash links, and of each token of prefixes a star; they connect most of a group by fewer pairs than it
    has rows. Then all pairs that are not connected yet and share a token follow. Each is compared by its whole sets of
    shingles, so no pair is lost, whatever the size of a group. texts: digest, text.
    """
    classes = sets.groupBy("fp").agg(F.min("id").alias("a"))
    alike = sets.select("id", "fp").join(classes, "fp").filter("id <> a").select("a", F.col("id").alias("b"))
    by_print = alike.unionByName(links(classes.select(F.col("a").alias("id"), "fp")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # a set's size and the token's place travel in one number
    bare = sets.select("id", "n", F.posexplode("tokens").alias("i", "token")).select("id", "token", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("ni"))
    counts = bare.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    often = bare.join(counts, "token")
    n = F.shiftright("ni", 32).cast("int")
    shared = materialize(often.select("id", "token", "df", n.alias("n"), F.col("ni").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("i"), (n - F.ceil(like * n - 1e-9) + 1).cast("int").alias("p")), "shared-shingles")
    first = materialize(by_print.unionByName(_stars(shared, like)).distinct(), "candidates")
    near = _verified(first, sets, texts, like, shingle)
    rest = _others(shared, components(near), sets, texts, like, shingle)
    found = near.unionByName(_verified(rest.join(first, ["a", "b"], "left_anti"), sets, texts, like, shingle))
    discard(shared)
    return found


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near copies: the one with the least doc_id, null last.

    Near copies share at least `similarity` of their distinct word shingles (Jaccard); all of them are found. Equal texts
    are one class, and so are texts with equal shingles; null texts are equal, and texts without words have no other near
    copies. Repeated rows (same doc_id and text) stay once. An empty table gives an empty result. Other columns stay as
    they are, whatever their names.
    """
    text = F.col("text").cast("string")
    rows = docs.select(text_digest(text).alias("digest"), F.col("doc_id"), text.alias("text"), F.struct(*docs.columns).alias("row"))
    slim = rows.select("digest", "text")
    prints = materialize(prefixes(slim, similarity, shingle), "prefixes")
    sets = prints.groupBy("key").agg(F.min("digest").alias("digest"), *(F.first(c).alias(c) for c in ("fp", "n", "tokens")))
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    comp = components(similar(slim, sets, similarity, shingle))
    of_set = sets.select("key", "id").join(comp, F.col("id") == F.col("node"), "left").select("key", F.coalesce("component", "id").alias("component"))
    comp = materialize(prints.select("digest", "key").distinct().join(of_set, "key").select("digest", "component"), "near-copies")
    discard(prints, sets)
    # a text without words has no set and is a class of its own
    named = rows.select("digest", "doc_id").join(comp, "digest", "left").select(F.coalesce(F.col("component").cast("string"), F.hex("digest")).alias("component"), "digest", "doc_id")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest")).alias("f")).select(F.col("f.digest").alias("kept"), F.col("f.doc_id").alias("kept_doc"))
    kept = rows.join(first, (F.col("digest") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("kept_doc"))).dropDuplicates(["digest", "doc_id"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
