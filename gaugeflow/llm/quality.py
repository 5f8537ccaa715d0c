"""Quality rules: hashed n-gram likelihood ratio of trusted texts to the raw corpus.

Words and word pairs of a text are hashed into a fixed number of buckets. Two multinomials over the
buckets, of trusted documents and of the whole corpus, give each bucket a log ratio; a document's score
is the mean log ratio of its n-grams, so it does not grow with length. A document passes if its score
is not below a threshold that is the same for every document. Some plain counts are made in the same
pass and have rules of their own.

The corpus multinomial counts every document. The trusted one is fitted on a bounded sample of labelled
rows: at most ``TRUSTED`` documents with label quality 1, those with the smallest hash of the id. A task
adds up its counts and sends one row per bucket, so what is shuffled grows with tasks, not with words;
the model on the driver is one number per bucket.

A null text is an empty one: no words, so it fails the base rules. Without trusted documents every log
ratio is 0 and only the base rules decide. A null doc_id is never trusted. Repeated rows are judged, and
counted, each. Columns named like the added ones are replaced, others are passed through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.text import table

BUCKETS = 1 << 14
TRUSTED = 20_000
THRESHOLD = -0.1  # mean log ratio (nats) below which a document goes; no held-out trusted document fell below
SMOOTHING = 10.0  # per bucket, so that few trusted documents decide little
WINDOW = 5
CACHED_WORDS = 150_000

# Fixed by the contract of the query: what separates words, and which characters are symbols.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


class Hasher:
    """Bucket numbers of the n-grams of a text; word hashes are kept between texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def buckets(self, words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        try:
            found = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            for word in set(words):
                if word not in known:
                    known[word] = zlib.crc32(word)
            found = list(map(known.__getitem__, words))
        one = np.array(found, np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] + np.uint64(0x7F4A7C15))
        two = (two * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
        both = np.concatenate([one, two]) % np.uint64(buckets)
        return both.astype(np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text."""
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered, until = 0, 0
    for i, gram in enumerate(grams):
        if gram in often:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if line.strip(SPACES))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    spaces = sum(map(text.count, SPACES))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words)


def words_of(text: str | None) -> list[bytes]:
    """Bytes are split at exactly the six spaces of the contract, texts would be at others too."""
    return text.encode().split() if text else []


def trusted_ids(labels: DataFrame, trusted: int = TRUSTED) -> DataFrame:
    """doc_id of at most ``trusted`` documents with quality 1."""
    return (
        labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(trusted)
    )


def ngram_counts(documents: DataFrame, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, trusted, corpus: n-grams of trusted documents and of all, in one pass over the texts."""
    flagged = documents.select("doc_id", "text").join(F.broadcast(ids.withColumn("is_trusted", F.lit(True))), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, is_trusted in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(hasher.buckets(words_of(text.as_py()), buckets), minlength=buckets)
                counts[1] += found
                if is_trusted:
                    counts[0] += found
        used = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, counts[0][used], counts[1][used])], names=["bucket", "trusted", "corpus"])

    counted = flagged.select("text", "is_trusted").mapInArrow(run, "bucket long, trusted long, corpus long")
    return counted.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("corpus").alias("corpus"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each bucket, smoothed towards the corpus; one number per bucket comes to the driver."""
    trusted, corpus = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # at most ``buckets`` rows
        trusted[row.bucket], corpus[row.bucket] = row.trusted, row.corpus
    if not trusted.sum():
        return np.zeros(buckets)
    p = (corpus + smoothing) / (corpus + smoothing).sum()
    q = (trusted + smoothing * buckets * p) / (trusted.sum() + smoothing * buckets)
    return np.log(q) - np.log(p)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(df: DataFrame, ratios: np.ndarray, text: str = "text", keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base counts, base_failed, score and kept; drops ``text`` unless ``keep_text``."""
    add = [T.StructField(c, T.LongType()) for c in COUNTS]
    add += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    keep = [c for c in df.columns if c not in {f.name for f in add} and (keep_text or c != text)]
    model = df.sparkSession.sparkContext.broadcast(ratios)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ratio = Hasher(), model.value
        for batch in batches:
            out = []
            for value in batch.column(text):
                whole = value.as_py() or ""
                words = words_of(whole)
                counts = base_counts(whole, words)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                score = float(ratio[hasher.buckets(words, len(ratio))].mean()) if words else 0.0
                out.append((*counts, failed, score, not failed and score >= threshold))
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + [f.name for f in add])

    wanted = keep if keep_text else [*keep, text]
    return df.select(*wanted).mapInArrow(run, T.StructType([df.schema[c] for c in keep] + add))


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    return log_ratios(ngram_counts(documents, trusted_ids(labels), buckets), buckets, smoothing)


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns whatever their names."""
    others = [c for c in documents.columns if c != "text"]
    held = documents.select(F.struct(*others).alias("_row"), "text")
    passed = judge(held, fit(documents, labels), keep_text=True).filter("kept")
    return passed.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in documents.columns])


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = judge(documents.select("doc_id", "text"), fit(documents, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "score")
