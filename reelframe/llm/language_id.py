"""Language identification by rank-order profiles of n-grams and the out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import by_size, read_table

RANKS = 300
UNKNOWN = "und"
_BREAK = 0x20

_letters: np.ndarray | None = None


def grams(text: str) -> np.ndarray:
    """Codes of the letters of a text, lower-cased, and of its 2- and 3-grams, in which a blank stands for a word's border."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = _letters[c]
    if not letter.any():
        return np.zeros(0, np.uint64)
    after = np.concatenate([[False], letter[:-1]])
    c = np.where(letter, c, np.uint64(_BREAK))[letter | after]
    c = np.concatenate([[np.uint64(_BREAK)], c, [np.uint64(_BREAK)]])
    letter = c != _BREAK
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The codes of the most frequent n-grams, most frequent first, ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:most]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, rank, gram: the most frequent n-grams of each language of (text, lang), counted over all rows with both.

    A language is a value of lang: as many of them as there are have `ranks` rows each. An empty table teaches nothing.
    Each task adds up its own counts first. The most frequent are found in salted parts of a language, then among those.
    """

    def run(batches):
        for batch in batches:
            for part in by_size(batch):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(grams(text))
                for lang, found in by.items():
                    codes, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    some = counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= ranks)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= ranks).select("lang", "rank", "gram")


class Profiles:
    """Learned profiles as one table: the rank of each n-gram in each language, or `ranks` where it has none."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS):
        self.ranks = ranks
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[2] for r in rows], np.int64).view(np.uint64))
        self.table = np.full((len(self.codes) + 1, len(self.langs)), ranks, np.int64)
        for lang, rank, gram in rows:
            self.table[np.searchsorted(self.codes, np.int64(gram).view(np.uint64)), self.langs.index(lang)] = rank - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text and self.langs else ()
        if not len(codes):
            return UNKNOWN, 0.0
        own = ranked(*np.unique(codes, return_counts=True), self.ranks)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        rank = self.table[at]
        out = np.where(rank == self.ranks, self.ranks, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.langs[best], 1.0 - float(out[best]) / (self.ranks * len(own))


def identify(docs: DataFrame, profiles: DataFrame, ranks: int = RANKS) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone. Profiles have `ranks` rows a language at most.

    Texts are taken whole, however long; an empty table gives an empty result. Null texts and those without a letter are `und` with score 0; so is everything where no language was learned. Ties
    go to the language whose name comes first. Repeated rows are each returned.
    """
    got = [(r["lang"], r["rank"], r["gram"]) for r in profiles.collect()]
    model = docs.sparkSession.sparkContext.broadcast(Profiles(got, ranks))

    def run(batches):
        for batch in batches:
            for part in by_size(batch):
                found = [model.value.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify(docs.select("doc_id", "text"), learn(known.select("text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
