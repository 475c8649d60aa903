"""Toxicity by a classifier chain: each category's linear model also reads the probabilities of the categories before."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import by_size, discard, materialize, read_table

#: Labelled rows that a chain is fitted on at most; its vocabulary is all of theirs.
MAX_TRAIN_ROWS = 8_000
LEAST_DOCUMENTS = 3
FOLDS = 3
STEPS = 300
RATE = 1.0
PENALTY = 1e-5
#: In the order of the chain.
CATEGORIES = ("low_quality", "toxic")
ALL = -1
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    """The distinct words of a whole text, lower-cased, and the first four and five letters of the longer ones."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:4] + "-" for w in found if len(w) > 4} | {w[:5] + "-" for w in found if len(w) > 5}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(lists: list[np.ndarray], earlier: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Weights of a logistic model: `size` for terms that are there, one for each earlier probability, and the intercept.

    Terms are scaled by the log ratio of how often they are in either class, so that those that tell nothing stay small;
    then gradient descent with momentum on all rows.
    """
    n, k = len(lists), earlier.shape[1]
    if not n:
        return np.zeros(size + k + 1)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    term = np.concatenate(lists)
    yes = np.bincount(term, labels[row], size) + 1
    no = np.bincount(term, 1 - labels[row], size) + 1
    scale = np.log(yes / (labels.sum() + 2)) - np.log(no / (n - labels.sum() + 2))
    scale[np.abs(scale) < 0.5] = 0
    value = scale[term]
    unit = np.sqrt(max(np.bincount(row, value * value, n).mean(), 1e-9))
    value, w, ahead = value / unit, np.zeros(size + k + 1), np.zeros(size + k + 1)
    for t in range(STEPS):
        z = np.bincount(row, ahead[term] * value, n) + earlier @ ahead[size : size + k] + ahead[-1]
        error = _sigmoid(z) - labels
        grad = np.concatenate([np.bincount(term, error[row] * value, size), earlier.T @ error, [error.sum()]]) / n + PENALTY * ahead
        last, w = w, ahead - RATE * grad
        ahead = w + t / (t + 3) * (w - last)
    w[:size] *= scale / unit
    return w


def predict_linear(lists: list[np.ndarray], earlier: np.ndarray, w: np.ndarray) -> np.ndarray:
    size, k = len(w) - earlier.shape[1] - 1, earlier.shape[1]
    return _sigmoid(np.array([w[x].sum() for x in lists]) + earlier @ w[size : size + k] + w[-1])


@dataclass
class Chain:
    """A fitted chain, small enough to send to all tasks: a weight for each category and term of the bounded sample."""

    vocabulary: dict[str, int]
    categories: tuple[str, ...]
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """texts x categories: probabilities, each model fed with those before it."""
        get = self.vocabulary.get
        lists = [np.array([i for i in map(get, terms(t)) if i is not None], np.int64) for t in texts]
        p = np.zeros((len(texts), 0))
        for w in self.weights:
            p = np.column_stack([p, predict_linear(lists, p, w)])
        return p


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs (doc_id, text) -> doc_id, p_<category> and a boolean <category> of each category of the chain.

    Texts are taken whole, however long. Null and empty ones have no terms and get the models' base rates; repeated rows
    are each scored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *(f"p_{c}" for c in chain.categories), *chain.categories]

    def run(batches):
        for batch in batches:
            for part in by_size(batch):
                p = model.value.predict(part.column("text").to_pylist())
                said = p >= np.array(model.value.thresholds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), *(pa.array(said[:, k]) for k in range(p.shape[1]))], names=names)

    schema = ", ".join(["doc_id long", *(f"p_{c} double" for c in chain.categories), *(f"{c} boolean" for c in chain.categories)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _best_threshold(p: np.ndarray, labels: np.ndarray, steps: int = 100) -> float:
    """The probability that parts rows best by F1; of equal ones the middle."""
    found = []
    for k in range(1, steps):
        said = p >= k / steps
        found.append((2 * int(labels[said].sum()) / max(int(said.sum() + labels.sum()), 1), k))
    top = [k for s, k in found if s == max(found)[0]]
    return top[len(top) // 2] / steps


def _fitter(category: str, earlier: list[str], size: int):
    def fit(key: int, own: pd.DataFrame) -> pd.DataFrame:
        """One model of a category: for a fold it leaves the fold's rows out and predicts them; for ALL it gives weights."""
        out = (own["fold"] == key).to_numpy()
        lists = [np.asarray(x, np.int64) for x in own["terms"]]
        dense, y = own[earlier].to_numpy(float).reshape(len(own), len(earlier)), own[category].to_numpy(float)
        w = fit_linear([x for x, o in zip(lists, out, strict=True) if not o], dense[~out], y[~out], size)
        if key == ALL:
            return pd.DataFrame({"row": [-1], "label": [0.0], "p": [0.0], "weights": [w.astype("<f8").tobytes()]})
        p = predict_linear([x for x, o in zip(lists, out, strict=True) if o], dense[out], w) if out.any() else np.zeros(0)
        return pd.DataFrame({"row": own["row"][out].to_numpy(), "label": y[out], "p": p, "weights": [None] * len(p)})

    def run(batches):
        held = list(batches)  # a model's rows are bounded, and a task has one model
        if held:
            for key, own in pd.concat(held, ignore_index=True).groupby("model"):
                yield fit(int(key), own.sort_values("row", ignore_index=True))

    return run


def fit_chain(labelled: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_rows: int = MAX_TRAIN_ROWS, folds: int = FOLDS) -> Chain | None:
    """Fit a chain on (doc_id, text, a 0 or 1 column for each category); None where no row is labelled.

    At most max_rows rows are used, those whose doc_ids hash lowest, so a model's task has a bounded input. Terms of fewer
    than LEAST_DOCUMENTS of them tell nothing and are left out. What a later model reads of an earlier category in training
    are out-of-fold predictions, of models that didn't see the row; for new texts the models fitted on all rows predict.
    Thresholds come from out-of-fold predictions too.
    """
    spark = labelled.sparkSession
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "text", *categories)

    @F.pandas_udf("array<string>")
    def term_list(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(terms(t)))

    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).cast("int")
    sample = materialize(rows.repartition(4, "doc_id").select(F.monotonically_increasing_id().alias("row"), fold.alias("fold"), *categories, term_list("text").alias("terms")), "toxicity-sample")
    known = sample.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS).select("term").orderBy("term")
    chain = Chain({r["term"]: k for k, r in enumerate(known.collect())}, categories)  # of max_rows rows
    vocabulary, size = spark.sparkContext.broadcast(chain.vocabulary), len(chain.vocabulary)

    @F.pandas_udf("array<long>")
    def numbers(found: pd.Series) -> pd.Series:
        get = vocabulary.value.get
        return found.map(lambda t: [i for i in map(get, t) if i is not None])

    data = materialize(sample.select("row", "fold", *categories, numbers("terms").alias("terms")), "toxicity-rows")
    used = [sample, data]
    for k, category in enumerate(categories):
        earlier = [f"p_{c}" for c in categories[:k]]
        # ranges, unlike hashes, give each model a task of its own
        models = data.withColumn("model", F.explode(F.array(*map(F.lit, (ALL, *range(folds)))))).repartitionByRange(folds + 1, "model")
        got = models.mapInPandas(_fitter(category, earlier, size), "row long, label double, p double, weights binary").toPandas()  # max_rows rows
        full, held = got[got["row"] < 0], got[got["row"] >= 0].sort_values("row")
        if full.empty:
            return None
        chain.weights.append(np.frombuffer(full["weights"].iloc[0], "<f8"))
        chain.thresholds.append(_best_threshold(held["p"].to_numpy(), held["label"].to_numpy()))
        if k + 1 < len(categories):
            own = spark.createDataFrame(held[["row", "p"]].rename(columns={"p": f"p_{category}"}), f"row long, p_{category} double")
            data = materialize(data.join(own, "row"), "toxicity-rows")
            used.append(data)
    discard(*used)
    return chain


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and the categories of labels (doc_id, quality, toxic): one row a document, which has a category if any of its
    rows says so; rows with a null label or doc_id are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("low_quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def label_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text and the categories of the documents in known_labels()."""
    return docs.select("doc_id", "text").join(known, "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = known_labels(read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    # the sample is drawn before texts are fetched for it
    drawn = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS)
    chain = fit_chain(label_documents(docs, drawn))
    if chain is None:
        return docs.select("doc_id", *(F.lit(0.0).alias(f"p_{c}") for c in CATEGORIES), *(F.lit(False).alias(c) for c in CATEGORIES))
    return score(docs, chain)
