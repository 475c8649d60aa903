"""A corpus from documents: quality rules, near-duplicates, repeated passages, source weights, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from reelframe.llm.common import discard, materialize, read_table

#: Near copies in the pipeline share at least this part of their word 5-grams.
SIMILARITY = 0.8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects, as the stored ledger has it.

    Null, empty and very short texts are rejected; repeated rows are judged each for itself; an empty table gives an empty
    result. Columns stay as they are, whatever their names.
    """
    ledger = materialize(quality_rules.ledger(docs.select("text", F.struct(*docs.columns).alias("row"))).drop("text"), "ledger")
    judged = quality_rules.apply_policy(ledger, max(quality_rules.POLICIES))
    return judged.filter("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, null last.

    Null texts are copies of each other, and so are texts without words that are equal; repeated rows stay once; an empty
    table gives an empty result.
    """
    return simhash.keep_first(docs, SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go, as do null and empty texts.

    Repeated rows are one document and stay each, cut alike; an empty table gives an empty result.
    """
    return suffix_dedup.remove_repeats(docs).filter(F.length(F.trim("text")) > 0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, as the parts of documents that the mix takes, one row an epoch.

    A null source is one of its own; null and wordless texts give nothing to take; repeated rows are taken each for itself;
    an empty table gives an empty result.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of the model's length. Null and empty texts are the end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashes, permutations and a tokenizer are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each kept as a table until the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
