"""Ranked lexical search with hashed max-sketches.

A document's impact for a term is what its frequency and the document's length give; the weight of the
term comes with the query. A sketch folds the impacts of all terms of a document into ``BUCKETS``
coordinates by a hash of the term, keeping the maximum of each. An item's weights, summed per coordinate,
are a vector too, and its product with a sketch can never be below the exact score. For a batch of
documents all items get their bounds by one matrix product. An item rescores documents exactly by
descending bound until the next bound is below the k-th score that its task has found so far; an equal
bound does not stop it, as a smaller doc_id would win the tie. The best of all tasks are merged in two
steps, at most k of each task and item.

One pass counts documents, terms and the document frequency of the items' terms, a second one searches;
texts stay in the tasks that read them. The items are a stated query set: they are dealt into blocks of
about ``BLOCK_CHARS`` characters, each block goes to the tasks as a whole and has its own two passes.

Null texts have no terms; documents without terms are in no count and no result, items without terms have
no result. Very long texts are read whole. Repeated rows take part each, items too. A null doc_id comes
last among equal scores. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.llm.bpe import batches
from gaugeflow.llm.text import table

BUCKETS = 4096  # coordinates of a sketch
BLOCK_CHARS = 4_000_000  # characters of items searched in one pass
CACHED_TERMS = 300_000
MERGES = 32  # parts per item in the first merge
LAST = 2**63  # stands for a null doc_id where ids are compared

#: Fixed by the contract of the query: bytes that separate terms, and A-Z in lower case.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def length_norm(n: int, documents: int, total: int) -> int:
    """The length part of a document of n terms: 100 for the average length."""
    return 75 + (25 * n * documents) // total


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Items:
    """A block of items: distinct terms, and the weights that each item gives to them."""

    def __init__(self, texts: list[str | None]) -> None:
        self.counts = [Counter(terms(t)) for t in texts]
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*self.counts)))}

    def weigh(self, documents: int, df: dict[int, int]) -> list[list[tuple[bytes, int]]]:
        known = {t: weight(documents, df.get(k, 0)) for t, k in self.vocabulary.items()}
        return [[(t, known[t] * n) for t, n in counts.items()] for counts in self.counts]


def statistics(documents: DataFrame, items: Items) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all documents, and documents that hold each term of the items."""
    vocabulary = items.vocabulary

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        wanted = set(vocabulary)
        for batch in batches(rows):
            for text in batch.column(0).to_pylist():
                words = terms(text)
                if words:
                    held[-1] += 1
                    held[-2] += len(words)
                    held.update(map(vocabulary.__getitem__, wanted.intersection(words)))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(held), pa.int64()), "n": pa.array(list(held.values()), pa.int64())})

    found = documents.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r.term: r.n for r in found}  # no more rows than terms of the block
    return counts.pop(-1, 0), counts.pop(-2, 0), counts


class Sketcher:
    """Sketches of documents, at the coordinates that a block of items looks up."""

    def __init__(self, weighed: list[list[tuple[bytes, int]]]) -> None:
        self.bucket: dict[bytes, int] = {}
        used = sorted({self.place(t) for item in weighed for t, _ in item})
        self.used = np.array(used, np.int64)
        column = {b: k for k, b in enumerate(used)}
        self.weights = np.zeros((len(used), len(weighed)))
        for j, item in enumerate(weighed):
            for t, w in item:
                self.weights[column[self.place(t)], j] += w

    def place(self, term: bytes) -> int:
        return xxhash.xxh64_intdigest(term, 13) % BUCKETS

    def places(self, words: list[bytes]) -> list[int]:
        known = self.bucket
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHED_TERMS:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = self.place(word)
            return list(map(known.__getitem__, words))

    def sketch(self, counts: Counter, norm: int) -> np.ndarray:
        """Largest impact of a document's terms per coordinate, as far as looked up."""
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        folded = np.zeros(BUCKETS, np.int64)
        np.maximum.at(folded, self.places(list(counts)), (10**9 * tf) // (1000 * tf + 12 * norm))
        return folded[self.used]

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bound of the score of every document (row) for every item (column)."""
        return (sketches.astype(np.float64) @ self.weights) * (1 + 1e-9)


def exact(item: list[tuple[bytes, int]], counts: Counter, norm: int) -> int:
    held = ((w, counts[t]) for t, w in item if t in counts)
    return sum(w * ((10**9 * tf) // (1000 * tf + 12 * norm)) for w, tf in held)


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    @property
    def floor(self) -> int:
        """Scores below this cannot enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, -(LAST if doc_id is None else doc_id))
        if score > 0 and len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif score > 0 and entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def search_batch(sketcher: Sketcher, weighed: list, best: list[Best], ids: list, texts: list, documents: int, total: int) -> int:
    """Offers a batch of documents to all items; returns the number of exact scores."""
    held = [(i, Counter(words), len(words)) for i, words in zip(ids, map(terms, texts)) if words]
    if not held or not len(sketcher.used):
        return 0
    norms = [length_norm(n, documents, total) for _, _, n in held]
    sketches = np.stack([sketcher.sketch(counts, norm) for (_, counts, _), norm in zip(held, norms)])
    bounds = sketcher.bounds(sketches)
    scored = 0
    row, item = np.nonzero(bounds >= np.array([b.floor for b in best]))
    order = np.lexsort((-bounds[row, item], item))
    done = -1  # the item whose threshold has been reached
    for k, j, bound in zip(row[order].tolist(), item[order].tolist(), bounds[row, item][order].tolist()):
        if j == done:
            continue
        if bound < best[j].floor:
            done = j
            continue
        best[j].offer(exact(weighed[j], held[k][1], norms[k]), held[k][0])
        scored += 1
    return scored


def search(documents: DataFrame, weighed: list, k: int, n_documents: int, total: int) -> DataFrame:
    """item (place in the block), doc_id, score: at least the k best of each item, at most k a task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, best = Sketcher(weighed), [Best(k) for _ in weighed]
        for batch in batches(rows):
            search_batch(sketcher, weighed, best, *(batch.column(c).to_pylist() for c in ("doc_id", "text")), n_documents, total)
        found = [(j, -i if -i != LAST else None, score) for j, b in enumerate(best) for score, i in b.heap]
        names = ["item", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item long, doc_id long, score long")


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def top_documents(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents with a score above 0 for every row of ``items``."""
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first().chars
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    results = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block = Items([r.text for r in rows])
        n_documents, total, df = statistics(documents, block)
        found = search(documents, block.weigh(n_documents, df), k, n_documents, total)
        part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGES))
        ranked = best_of(best_of(found.withColumn("part", part), ["item", "part"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(j, r.item_id) for j, r in enumerate(rows)], "item long, item_id long")
        results.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results)


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
