"""Mixing sources to target weights: fixed-length blocks, multinomial counts by output shard, and permuted block indexes.

The counts are drawn with their sums given (a multivariate hypergeometric draw), so that each source meets its target,
however small its part of a shard is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import SPACE, WORD, let, materialize, read_table, running_start

BLOCK_WORDS = 64
SHARD_SLOTS = 1024
ROUNDS = 24
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20_000
#: Rows of a source that are made from one row of a plan.
RUN = 4096
#: Rows with the same source are joined with what is known of it in so many parts.
SALTS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> source, source_no, source_size, weight, target.

    Sources in order of their code points, null last, take numbers from 0 and the weights in turn. Each gets its share of
    all sizes by weight, but at most `most` times its own size, and what is cut off is shared again: those that the level
    of target by weight fills are taken out and the level is raised, until it fills no more. One row a source.
    """
    order = [F.col("source").asc_nulls_last()]
    dealt = materialize(sizes.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_one": F.lit(1)}), "mix-sources")
    s = running_start(dealt, [], order, "_one", "source_no", F.col("_part")).drop("_one", "_part")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size"))
    at, level = F.col("_cap") / F.col("weight"), -1.0
    while True:
        full = at <= level
        r = s.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        new = (r["all"] - r["capped"]) / r["open"] if r["open"] else level
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("weight"))).select("source", "source_no", "source_size", "weight", "target")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1 at x: a swap-or-not shuffle, each round of which is its own inverse."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(*key, r, F.greatest(at, other), F.lit(1)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def shard_counts(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """How many blocks of each source go to each output shard, and from which draw on: source_no, n_blocks, shard, count, first.

    A source's blocks are its target's, rounded so that sums over sources are rounded sums: less than a block away. A shard
    has shard_slots slots, the last fewer. A source gets the whole part of its share in each shard; what is left of all
    sources is dealt to the open slots by one pseudorandom permutation, so its counts by shard are drawn from the
    multinomial with the sources' totals and the open slots given. Only sources with a block in a shard have a row for it.
    """
    spark = targets.sparkSession
    t = targets.filter("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    # blocks to take so that the words taken, at the mean length of a block, come to the target
    t = t.select("source_no", "n_blocks", (F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("decimal(28,6)").alias("_want"))
    t = running_start(t, [], ["source_no"], "_want", "_before", F.expr(f"source_no div {RUN}"))
    t = t.select("source_no", "n_blocks", (F.round(F.col("_before") + F.col("_want")) - F.round("_before")).cast("long").alias("_n"))
    t = materialize(t, "mix-totals")
    slots = t.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    shards = -(-slots // shard_slots)
    last = slots - (shards - 1) * shard_slots
    tasks = max(spark.sparkContext.defaultParallelism, slots // 500_000)
    if not slots:
        return t.select("source_no", "n_blocks", *(F.lit(0).cast("long").alias(c) for c in ("shard", "count", "first"))).limit(0)
    part = t.select("source_no", "_n", F.expr(f"_n * {shard_slots}L div {slots}L").alias("whole"), F.expr(f"_n * {last}L div {slots}L").alias("in_last"))
    part = part.withColumn("left", F.col("_n") - F.col("whole") * (shards - 1) - F.col("in_last"))
    sums = part.agg(F.sum("whole").alias("whole"), F.sum("left").alias("left")).first()
    # a source's rows, in runs that tasks take up
    each = lambda df, upto: df.withColumn("_run", F.explode(F.expr(f"sequence(0L, {upto} - 1, {RUN}L)"))).repartition(tasks).withColumn("_i", F.explode(F.expr(f"sequence(_run, least(_run + {RUN - 1}L, {upto} - 1))")))
    counts = part.filter("in_last > 0").select("source_no", F.lit(shards - 1).cast("long").alias("shard"), F.col("in_last").alias("count"))
    if shards > 1:
        counts = counts.unionByName(each(part.filter("whole > 0"), f"{shards - 1}L").select("source_no", F.col("_i").alias("shard"), F.col("whole").alias("count")))
    if sums["left"]:
        open_ = shard_slots - sums["whole"]  # slots of each shard but the last one, which takes what these leave
        rest = running_start(part.filter("left > 0").select("source_no", "left"), [], ["source_no"], "left", "_from", F.expr(f"source_no div {RUN}"))
        place = permuted(F.col("_from") + F.col("_i"), F.lit(sums["left"]).cast("long"), F.lit(seed), F.lit("slots"))
        shard = F.expr(f"least(_place div {open_}L, {shards - 1}L)") if open_ else F.lit(shards - 1).cast("long")
        dealt = each(rest, "left").select("source_no", place.alias("_place")).select("source_no", shard.alias("shard"), F.lit(1).cast("long").alias("count"))
        counts = counts.unionByName(dealt)
    counts = counts.groupBy("source_no", "shard").agg(F.sum("count").alias("count"))
    counts = running_start(counts, ["source_no"], ["shard"], "count", "first", F.expr(f"shard div {RUN}"))
    return counts.join(t.select("source_no", "n_blocks"), "source_no").repartition(tasks, "shard")


def plan_slots(targets: DataFrame, most: int = MOST_REPEATS, seed: int = SEED, **sizes: int) -> DataFrame:
    """The mix: shard, source_no, epoch, block; a source's draws go through its blocks in permuted order, epoch after epoch.

    No block comes more than `most` times.
    """
    c = shard_counts(targets, seed=seed, **sizes)
    end = F.least(F.col("first") + F.col("count"), most * F.col("n_blocks"))
    j = c.filter(F.col("first") < end).select("shard", "source_no", "n_blocks", F.explode(F.sequence(F.col("first"), end - 1)).alias("_draw"))
    j = j.withColumn("_epoch", F.expr("_draw div n_blocks"))
    block = permuted(F.col("_draw") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("source_no"), F.col("_epoch"))
    return j.select("shard", "source_no", F.col("_epoch").cast("int").alias("epoch"), block.alias("block"))


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (with _no and source) with their source's source_no, source_size and target. A source's rows are dealt over
    SALTS parts, as one may hold a third of them."""
    salted = targets.select("source", "source_no", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    on = rows["source"].eqNullSafe(salted["source"]) & (F.pmod(rows["_no"], F.lit(SALTS)) == salted["_salt"])
    return rows.join(salted, on).drop(salted["source"], "_salt")


def place(docs: DataFrame, *keep: Column) -> DataFrame:
    """_no, doc_id, source, size and what to keep of docs, and start: the words of their source before them, in order of
    doc_id, then of the text's hash.

    Null doc_ids come first. Rows are dealt by ranges of that order, so a source is summed in as many tasks as it needs.
    _no tells rows apart; it is written with them.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("_hash"), *keep)
    dealt = own.repartitionByRange("source", "doc_id", "_hash").withColumns({"_part": F.spark_partition_id(), "_no": F.monotonically_increasing_id()})
    return running_start(materialize(dealt, "mix-sizes"), ["source"], ["doc_id", "_hash"], "size", "start", F.col("_part")).drop("_part", "_hash")


def taken_parts(placed: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST_REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(targets, parts) of place(docs): source_targets(), and the parts of documents that the mix takes: _no, epoch,
    block, part_from and part_words (the part's place in the document, and its words)."""
    targets = materialize(source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), most=most), "mix-targets")
    slots = plan_slots(targets, most, seed, block_words=block_words)
    some = with_targets(placed.select("_no", "source", "start", "size").filter("size > 0"), targets)
    blocks = some.withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    blocks = blocks.select("_no", "source_no", "block", (lo - F.col("start")).alias("part_from"), (hi - lo).alias("part_words"))
    return targets, blocks.join(slots, ["source_no", "block"]).select("_no", "epoch", "block", "part_from", "part_words")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes, repeats counted.

    Null texts have size 0 and a null source is a source of its own, apart from any named one; repeated rows count each;
    an empty table gives an empty result; columns besides doc_id, text and source are ignored.
    """
    placed = place(docs)
    targets, parts = taken_parts(placed)
    taken = parts.groupBy("_no").agg(F.sum("part_words").alias("taken"))
    named = with_targets(placed.drop("start"), targets)
    return named.join(taken, "_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each document and epoch, one row with the words its taken blocks hold, and n_chars.

    Words keep the white space that follows them. Other columns stay as they are, whatever their names. Null and wordless
    texts are in no row; repeated rows are taken each by itself; an empty table gives an empty result.
    """
    placed = place(docs, F.struct(*docs.columns).alias("row"))
    _, parts = taken_parts(placed)
    runs = parts.groupBy("_no", "epoch").agg(F.sort_array(F.collect_list(F.struct("part_from", "part_words"))).alias("runs"))
    both = placed.select("_no", "row").join(runs, "_no")
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(f"{WORD}[{SPACE}]*"), F.lit(0))
    part = lambda p: lambda r: F.slice(p, (r["part_from"] + 1).cast("int"), r["part_words"].cast("int"))
    text = let(pieces, lambda p: F.array_join(F.flatten(F.transform("runs", part(p))), ""))
    own = both.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return own.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))
