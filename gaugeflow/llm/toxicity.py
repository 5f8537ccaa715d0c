"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

A document is the set of its distinct words and of the beginnings of these words (abusive words are
inflected and compounded). The model is one weight per such feature and ordered thresholds, shared
weights for all of them: P(grade >= j) = sigmoid(w . x - t_j). The output is the expected grade,
the sum of these probabilities, and the verdict whether grade 1 or more is more likely than not.

Labels say only toxic or not, so grades are made from them: 0 for a document that is not toxic; a toxic
one has grade 1 to ``GRADES`` by how many of the words that mark toxic documents it holds, against the
quantiles of all toxic documents of the sample. The model is fitted on a bounded sample: at most
``TRAINED`` labelled documents, those with the smallest hash of the id, without copies. Features are
picked by the likelihood-ratio statistic of their document counts, at most ``FEATURES`` of them; the fit
sees one short row of feature numbers per sample document. Prediction reads every whole text once.

A null or empty text has no words; its expected grade is that of no evidence. Without toxic labels, or
without words that tell them apart, nothing is toxic. A null doc_id is never in the sample; its row is
predicted like any other. Repeated rows have the same result each. Equal statistics are ordered by word.
Columns named like the added ones are replaced, others are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.text import cut_lineage, table

TRAINED = 10_000
FEATURES = 2000
LEAST_DOCUMENTS, LEAST_G2 = 4, 25.0
GRADES = 3
RIDGE = 1e-4
STEPS, RATE = 400, 0.1
CACHED_WORDS = 300_000
STEMS = (4, 5, 6, 7)  # letters of a beginning
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\`~"


def word_features(raw: str) -> list[str]:
    """A lower-case word without the signs around it, and its beginnings, marked as such."""
    word = raw.strip(EDGES)
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)] if word else []


def distinct_features(text: str | None) -> set[str]:
    return {f for raw in set(text.lower().split()) for f in word_features(raw)} if text else set()


class Model:
    """Word weights and thresholds; cached by raw word, so that a known word costs one look-up."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]) -> None:
        self.weights, self.thresholds = weights, np.array(thresholds)
        self.known: dict[str, tuple[str, ...]] = {}

    def evidence(self, text: str | None) -> float:
        if not text or not self.weights:
            return 0.0
        known, weights = self.known, self.weights
        if len(known) > CACHED_WORDS:
            known.clear()
        words = set(text.lower().split())
        for raw in words.difference(known):
            known[raw] = tuple(f for f in word_features(raw) if f in weights)
        found = {f for raw in words for f in known[raw]}
        return sum(sorted(weights[f] for f in found))

    def at_least(self, evidence: float) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - evidence, -500, 500)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, features: int, grade_count: int = GRADES, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient steps (Adam) on the ordinal likelihood.

    Thresholds are a first one and positive gaps, so they stay ordered.
    """
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], np.int64)
    share = np.clip([(grades >= j).mean() for j in range(1, grade_count + 1)], 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    theta = np.concatenate([[first[0]], np.log(np.maximum(np.diff(first), 1e-2)), np.zeros(features)])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    gaps = grade_count - 1
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    each = np.arange(n)
    for step in range(1, STEPS + 1):
        gap, w = np.exp(theta[1 : 1 + gaps]), theta[1 + gaps :]
        cuts = theta[0] + np.concatenate([[0], np.cumsum(gap)])
        score = np.bincount(owner, w[column], n)
        # P(grade >= 0) = 1 and P(grade >= last + 1) = 0 close the list.
        above = np.column_stack([np.ones(n), *[sigmoid(score - t) for t in cuts], np.zeros(n)])
        slope = above * (1 - above)
        p = np.maximum(above[each, grades] - above[each, grades + 1], 1e-12)
        into, out = slope[each, grades] / p, slope[each, grades + 1] / p
        by_score = (into - out) / n
        by_cut = np.array([-(into * (grades == j)).sum() + (out * (grades + 1 == j)).sum() for j in range(1, grade_count + 1)]) / n
        gradient = np.concatenate(
            [[by_cut.sum()], [by_cut[j + 1 :].sum() * gap[j] for j in range(gaps)], np.bincount(column, by_score[owner], features) - ridge * w]
        )
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return theta[1 + gaps :], theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1 : 1 + gaps]))])


def training_words(documents: DataFrame, labels: DataFrame, trained: int = TRAINED) -> DataFrame:
    """doc_id, toxic, words of the sample."""
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(trained)
    )
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(distinct_features(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    found = chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc_id long, toxic int, words array<string>")
    return cut_lineage(found.dropDuplicates(["words", "toxic"]))


def telling_words(rows: DataFrame, features: int = FEATURES) -> DataFrame:
    """word, g2, marks: the words whose documents are toxic more (marks) or less often than by chance."""
    size = rows.agg(F.coalesce(F.sum(F.col("toxic")), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    if not 0 < size.t < size.n:
        return rows.sparkSession.createDataFrame([], "word string, g2 double, marks boolean")
    t, n = float(size.t), float(size.n)
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("k"), F.sum("toxic").alias("a"))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    g2 = 2 * (part(a, k * t / n) + part(k - a, k * (n - t) / n) + part(t - a, (n - k) * t / n) + part(n - t - k + a, (n - k) * (n - t) / n))
    scored = counts.filter(F.col("k") >= LEAST_DOCUMENTS).select("word", g2.alias("g2"), (a / k > t / n).alias("marks"))
    return scored.filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "word").limit(features)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    rows = training_words(documents, labels)
    words = {r.word: (k, r.marks) for k, r in enumerate(telling_words(rows).collect())}  # at most FEATURES
    if not words:
        return Model({}, [50.0] * GRADES)

    number = {word: k for k, word in enumerate(words)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[number[w] for w in ws if w in number] for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, toxic, marks = [], [], np.array([m for _, m in words.values()])
        for batch in batches:
            toxic += batch.column(1).to_pylist()
            found += batch.column(2).to_pylist()
        held = np.array([int(marks[f].sum()) for f in found])
        label = np.array(toxic)
        cuts = np.quantile(held[label == 1], np.arange(1, GRADES) / GRADES)
        grades = np.where(label == 1, 1 + (held[:, None] > cuts).sum(axis=1), 0)
        weights, thresholds = fit_ordinal(found, grades, len(words))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()]), pa.array([thresholds.tolist()])], names=["weights", "thresholds"])

    # The sample is bounded, and short rows of numbers by now, so one task fits the model.
    short = rows.select("doc_id", "toxic", "words").mapInArrow(numbered, "doc_id long, toxic int, found array<int>")
    model = short.repartition(1).sortWithinPartitions("doc_id", "found").mapInArrow(run, "weights array<double>, thresholds array<double>").first()
    return Model(dict(zip(words, model.weights)), model.thresholds)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replaces ``text`` by expected_severity (double), severity (most likely grade) and toxic."""
    add = [T.StructField("expected_severity", T.DoubleType()), T.StructField("severity", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    keep = [c for c in df.columns if c not in (text, *(f.name for f in add))]
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in batches:
            out = []
            for value in batch.column(text):
                above = fitted.at_least(fitted.evidence(value.as_py()))
                each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
                out.append((float(above.sum()), int(each.argmax()), bool(above[0] >= 0.5)))
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.float64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + [f.name for f in add])

    return df.select(*keep, text).mapInArrow(run, T.StructType([df.schema[c] for c in keep] + add))


def document_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(documents, fit(documents, table(spark, sf_dir, "labels")))
