"""The trie of conversations' prefixes by prefix doubling: equal blocks of 1, 2, 4, ... turns get equal dense numbers.

Blocks are aligned: one of 2 ** k turns starts at a multiple of 2 ** k, so all rounds together name twice as many blocks as
there are turns. A prefix of d turns is a prefix of d less its lowest bit, and one block of that many turns. The rounds of
blocks go up, those of prefixes go down, and each is a join and a numbering of the distinct pairs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import discard, lean, materialize, read_table, running_start

#: The most turns that a rebuilt conversation takes from the first of its hundred, and one more.
HEADS = 6
GROUP = 100
#: Ids that are joined to one string before the strings of a node are hashed in turn.
CHUNK = 4096


def dense(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows with out: a number from 1 on for each distinct value of the keys.

    Distinct values are combined before they are shuffled and numbered within their partition, after those of the
    partitions before; only how many each partition has meets in one place. They are joined back by value, where Spark
    splits a frequent one.
    """
    each = materialize(rows.select(*keys).distinct().withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "distinct-blocks")
    in_part = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.groupBy("_part").agg((F.max(in_part) + 1).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    named = each.join(F.broadcast(offsets), "_part").select(*keys, (F.col("_from") + in_part + 1).alias(out))
    found = materialize(rows.join(named, keys), "named")
    discard(each)
    return found


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, key, length: each turn's place in its conversation from 0, the SHA-256 of its role and text, and its
    text's code points.

    Turns are in order of turn (null first), then role and text; a null role or text is empty. Rows without a conv_id
    belong to no conversation. Ranges of that order (of the texts' first characters) are dealt out, so a long conversation is
    numbered in many tasks.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = part("role"), part("text")
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("length"), role.alias("role"), F.substring(text, 1, 64).alias("start"), text.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = slim.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "start").sortWithinPartitions("conv_id", *order)
    dealt = materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), "_one": F.lit(1)}).drop("role", "text", "start", "turn"), "turns")
    return running_start(dealt, ["conv_id"], ["_at"], "_one", "pos", F.col("_part")).select("conv_id", "pos", "key", "length")


def head_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of ordered_turns(): conv_id and n_turns of each, with or without turns; and conv_id, pos, key, length.

    Conversation c is the first head_turns(c) turns of c - c % 100 (all, if it has fewer; none, if it is not there), and
    then its own ones after its first head_turns(c), if any.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("last")).withColumns({"h": head_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    convs = materialize(convs, "conversations")
    bases = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS - 1))
    heads = bases.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "length"))).alias("head")).withColumnRenamed("conv_id", "base")  # HEADS - 1 turns at most
    with_head = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos: bigint, key: binary, length: bigint>>")), F.lit(1), F.col("h")))
    with_head = with_head.withColumn("n_head", F.size("head").cast("long"))
    taken = with_head.select("conv_id", F.inline("head"))
    own = turns.join(with_head.select("conv_id", "h", "n_head"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "key", "length")
    sizes = with_head.select("conv_id", (F.col("n_head") + F.greatest(F.col("last") + 1 - F.col("h"), F.lit(0))).alias("n_turns"))
    return materialize(sizes, "rebuilt"), materialize(taken.unionByName(own), "rebuilt-turns")


def prefix_names(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, depth, node: a number from 1 on for each distinct sequence of a conversation's first turns; 0 is the empty one.

    turns: conv_id, pos, name, equal names for equal turns. A number names one sequence: those of different lowest bits of
    the depth are kept apart by the bit.
    """
    blocks, k = [turns.select("conv_id", "pos", "name")], 0
    while 2 << k <= longest:  # blocks of 2 ** (k + 1) turns from two of 2 ** k
        size = 1 << k
        low = blocks[k].filter(F.col("pos") % (2 * size) == 0).withColumnRenamed("name", "x")
        high = blocks[k].filter(F.col("pos") % (2 * size) == size).select("conv_id", (F.col("pos") - size).alias("pos"), F.col("name").alias("y"))
        blocks.append(dense(low.join(high, ["conv_id", "pos"]), ["x", "y"], "name").select("conv_id", "pos", "name"))
        k += 1
    found = None
    for k in range(len(blocks) - 1, -1, -1):  # prefixes whose depth has 2 ** k as its lowest bit
        size = 1 << k
        last = blocks[k].filter((F.col("pos") + size).bitwiseAND(F.lit(2 * size - 1)) == size)
        alone = last.filter("pos = 0").select("conv_id", "pos", F.col("name").alias("y"), F.lit(0).cast("long").alias("x"))
        pairs = alone
        if found is not None:
            after = last.filter("pos > 0").select("conv_id", "pos", F.col("name").alias("y"))
            pairs = alone.unionByName(after.join(found.select("conv_id", F.col("depth").alias("pos"), F.col("node").alias("x")), ["conv_id", "pos"]))
        named = dense(pairs, ["x", "y"], "node").select("conv_id", (F.col("pos") + size).alias("depth"), (F.col("node") * 64 + k).alias("node"))
        found = named if found is None else found.unionByName(named)
    return found


def subtree_sums(nodes: DataFrame, longest: int, values: list[str]) -> DataFrame:
    """nodes (node, parent, depth, values) with each value summed over a node's subtree, itself included.

    By doubling: a node's sum over less than 2 ** k levels, and those of its descendants 2 ** k levels below, make its sum
    over less than 2 ** (k + 1). Sums combine before they are shuffled.
    """
    now = materialize(nodes.select("node", F.col("parent").alias("up"), *values), "subtrees")
    k = 0
    while 1 << k <= longest:
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        jump = now.filter("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("next"))
        then = now.join(below, "node", "left").join(jump, "up", "left")
        then = then.select("node", F.col("next").alias("up"), *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values))
        before, now = now, materialize(then, "subtrees")
        discard(before)
        k += 1
    return now.select("node", *values)


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the ids of (node, conv_id) as decimals in ascending order, comma-joined.

    Ids are dealt by ranges of (node, conv_id) and joined to strings of CHUNK ids there. A node's strings are then hashed
    one after the other, as SHA-256 asks for: a task streams over them and keeps one string at a time.
    """
    dealt = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def join(batches):
        node, first, ids = None, None, []

        def out():
            text = ",".join(map(str, ids))
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([first], pa.int64()), pa.array([text])], names=["node", "first", "ids"])

        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (n != node or len(ids) >= CHUNK):
                    yield out()
                    ids = []
                if not ids:
                    node, first = n, c
                ids.append(c)
        if ids:
            yield out()

    chunks = dealt.mapInArrow(lean(join), "node long, first long, ids string")

    def digest(batches):
        node, state, nodes, sums = None, None, [], []
        for batch in batches:
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if n != node:
                    if state is not None:
                        nodes.append(node)
                        sums.append(state.hexdigest())
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sums, pa.string())], names=["node", "ends_sha256"])
            nodes, sums = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(lean(digest), "node long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of rebuilt conversations, from the textless root on.

    turns: conv_id, turn, role, text. Equal rows are turns each; those without a conv_id are left out; turns with the same
    number are in order of role and text. A conversation that has no turns left is a member of the root. Returned are the
    node's least member, depth, parent's least member, members, children, leaves, saved code points of its subtree, and
    the digest of the members that end there. An empty table has no root.
    """
    convs, each = rebuilt(ordered_turns(turns))
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    named = dense(each, ["key"], "name")
    paths = materialize(prefix_names(named, longest).join(named.select("conv_id", (F.col("pos") + 1).alias("depth"), "length"), ["conv_id", "depth"]), "paths")
    nodes = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("length").alias("length"))
    # a node's parent is the prefix before it of its least member
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"))
    nodes = nodes.join(above, ["conv_id", "depth"], "left").select("node", "conv_id", "depth", "n_convs", "length", F.coalesce("above", F.lit(0)).alias("parent"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("parent"))
    nodes = materialize(nodes.unionByName(root), "trie")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    own = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("length")})
    sums = subtree_sums(own, longest, ["n_leaves", "saved_tokens"])
    last = paths.select("conv_id", F.col("depth").alias("n_turns"), "node")
    ends = convs.join(last, ["conv_id", "n_turns"], "left").select(F.coalesce("node", F.lit(0)).alias("node"), "conv_id")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, "parent", "left").join(sums, "node").join(end_digests(ends), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: CRC-32 of the decimal digits of a number: DuckDB has no function for it.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c : CAST(ascii(c) AS BIGINT))),
  lambda a, b : list_reduce(list_prepend(xor(a, b), [0 :: BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y : xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, [] :: STRUCT(role VARCHAR, text VARCHAR)[] AS path, 0 AS len FROM c
  UNION ALL
  SELECT conv_id, row_number() OVER w, list({{'role': role, 'text': text}}) OVER w, length(text) FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
), sizes AS (
  SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(len) AS len,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
  FROM p JOIN sizes USING (conv_id) GROUP BY path
), kids AS (
  SELECT b.conv_id, b.depth, a.conv_id AS parent_conv_id, a.depth AS parent_depth
  FROM nodes b JOIN p ON p.conv_id = b.conv_id AND p.depth = b.depth - 1 JOIN nodes a ON a.path = p.path
), own AS (
  SELECT n.*, k.parent_conv_id, coalesce(m, 0) AS n_children, (n_convs - 1) * len AS saved
  FROM nodes n LEFT JOIN kids k USING (conv_id, depth)
  LEFT JOIN (SELECT parent_conv_id AS conv_id, parent_depth AS depth, count(*) AS m FROM kids GROUP BY ALL) x USING (conv_id, depth)
), sums AS (
  SELECT a.conv_id, a.depth, sum(CAST(u.n_children = 0 AS INT)) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM own u JOIN p ON p.conv_id = u.conv_id AND p.depth <= u.depth JOIN nodes a ON a.path = p.path GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM own JOIN sums USING (conv_id, depth)
"""
