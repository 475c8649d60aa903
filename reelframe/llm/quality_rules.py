"""A ledger of quality rules: every rule is evaluated once, and policies are bit masks over what it found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import SPACE, let, read_table, words

SYMBOLS = "#*$%&|<>"


def _repeat_words(ws: Column, n: int = 5) -> Column:
    """Words inside windows of n words that occur twice or more in ws. Windows are sorted, so equal ones are neighbours."""
    last = F.size(ws) - n + 1
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.concat_ws(" ", *(F.element_at(ws, i + k) for k in range(n))).alias("w"), i.alias("i")))

    def covered(found: Column) -> Column:
        """Words that windows starting at these places cover; a place that two neighbours name comes twice and adds 0."""
        ahead = F.concat(F.slice(found, 2, F.size(found)), F.array(F.element_at(found, -1) + n))
        return F.aggregate(F.zip_with(found, ahead, lambda a, b: F.least(b - a, F.lit(n))), F.lit(0), lambda s, x: s + x)

    def repeated(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
        found = F.sort_array(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
        return let(found, lambda f: F.when(F.size(f) > 0, covered(f)).otherwise(0))

    # most texts repeat no window: their windows' hashes, made from the words' hashes, differ
    hashed = lambda h: F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(n))))
    differ = let(F.transform(ws, lambda x: F.xxhash64(x)), lambda h: F.size(F.array_distinct(hashed(h))) == last)
    found = F.when(differ, 0).otherwise(let(F.sort_array(windows), repeated))
    return F.when(last >= 2, found).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """docs with the measurements that the rules read, all of the whole text; null texts measure 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ws = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")),
    )
    return (
        docs.withColumns({"_ws": ws, "_lines": lines})
        .withColumns(
            {
                "n_words": F.col("_ws.n").cast("long"),
                "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_lines": F.col("_lines.n").cast("long"),
                "n_dup_lines": F.col("_lines.d").cast("long"),
                "n_repeat_words": F.col("_ws.r").cast("long"),
            }
        )
        .drop("_ws", "_lines")
    )


@dataclass(frozen=True)
class Rule:
    """A rule's bit in the ledger, and when a document fails it, over measure()'s columns."""

    bit: int
    name: str
    fails: str


#: Bits are never given anew: ledgers that are stored keep their meaning.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > word_chars"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 40 * n_words"),
)

#: Which bits reject, by version.
POLICIES = {1: 0b000011, 2: 0b111111}
BASE = 0b000011


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with their measurements and fail_bits (long), each rule evaluated once on each row.

    A null text has no words. Repeated rows are judged each for itself; other columns stay, except those whose names the
    ledger uses, which it replaces.
    """
    bits = " | ".join(f"shiftleft(CAST({r.fails} AS bigint), {r.bit})" for r in rules)
    return measure(docs).withColumn("fail_bits", F.expr(bits))


def apply_policy(kept_ledger: DataFrame, version: int) -> DataFrame:
    """The ledger with kept: no bit of the policy's mask is set."""
    return kept_ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(kept_ledger: DataFrame, version: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy does: bit, rule, n_failed, n_only (rejected by it alone), n_kept_without.

    Documents are counted by their bits first, so at most 2 ** rules rows go on.
    """
    mask = POLICIES[version]
    by_bits = kept_ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*(F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("own")) for r in rules if mask >> r.bit & 1))
    each = by_bits.select("bits", "n", F.inline(named))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("own")))
    return each.groupBy("bit", "rule").agg(
        total(F.col("bits").bitwiseAND(F.col("own")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("own")).alias("n_only"),
        total(rest == 0).alias("n_kept_without"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy 2 over all documents."""
    got = apply_policy(ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text")), max(POLICIES))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "fail_bits")


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines
  FROM w
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), r AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n_repeat_words FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), f AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT)
    + 4 * CAST(10 * n_symbols > word_chars AS BIGINT) + 8 * CAST(n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines AS BIGINT)
    + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 40 * n_words AS BIGINT) AS fail_bits
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""
