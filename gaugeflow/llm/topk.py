"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are turned into integers; the score of a pair is their inner product. Queries and candidates are
dealt into blocks of bounded size, and each pair of blocks is one group. Inside it every dimension has a
list of the candidates sorted by that component. The queries of a block walk down the lists together (upwards
where a component of theirs is negative), score in full what is met, and a query knows that nothing unseen can score
more than the sum of its components times the values it stands at. It leaves when that bound is below the
k-th score found. An equal bound does not make it leave: an unseen candidate with a smaller identifier would
win the tie. What one query meets is scored for all that still walk, by one matrix product: at the same depth the lists
have the same rows for all, so together they meet at most twice what one of them meets alone. The best of
all blocks are merged per query, at most k from each.

Vectors that are null, or hold a null or non-finite component, take no part; nor do rows whose vec_id is
null. Vectors meet only those of the same length. A query row is not its own candidate, other rows with
the same vec_id are; repeated query rows have results each. Components and scores beyond 64 bits take the
largest or smallest 64-bit number; blocks where they could occur are computed in whole numbers of any size. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.llm.text import cut_lineage, table

CANDIDATES, QUERIES = 4096, 1024  # rows of a block
FIRST_DEPTH, DEEPER = 8, 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
EXACT = 1 << 53  # whole numbers up to here are exact in a double
FOUND = "query_row long, query_id long, vec_id long, score long"


def within_64_bits(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers of any size cut to 64 bits; others stay as they are."""
    return np.minimum(np.maximum(numbers, LOWEST), HIGHEST) if numbers.dtype == object else numbers


def numbers_for(asked: np.ndarray, held: np.ndarray) -> type:
    """What holds every score times the number of candidates: doubles if exact, 64-bit numbers, or numbers of any size."""
    largest = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    most = (largest(asked) * largest(held) * max(asked.shape[1], 1) + 1) * max(len(held), 1)
    return np.float64 if most < EXACT else np.int64 if most < HIGHEST else object


class Lists:
    """A block of candidates with a sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.lexsort((rows, ids))
        self.ids, self.rows, self.vectors = ids[by_id], rows[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def best(self, queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among the queries, places and scores of the k best candidates of each but its own of ``rows``, best first, ties to the smaller id.

        A candidate's key is its score times the number of candidates plus what puts smaller places first,
        so that keys of a query differ and fall from best to worst.
        """
        n, kind = len(self.ids), self.vectors.dtype
        lowest = -np.inf if kind == np.float64 else LOWEST if kind == np.int64 else LOWEST * (n + 1)
        by_row = np.argsort(self.rows)
        own = by_row[np.minimum(np.searchsorted(self.rows, rows, sorter=by_row), n - 1)]
        own = np.where(self.rows[own] == rows, own, -1)
        top = np.full((len(queries), k), lowest, kind)
        walking, seen = np.arange(len(queries)), np.zeros(n, bool)
        start, depth = 0, FIRST_DEPTH
        while start < n and len(walking):
            end, asked = min(depth, n), queries[walking]
            up, down = np.flatnonzero((asked < 0).any(axis=0)), np.flatnonzero((asked > 0).any(axis=0))
            met = np.zeros(n, bool)
            met[self.order[start:end, up]] = True
            met[self.order[n - end : n - start, down]] = True
            if end == n:
                met[:] = True  # without a component all candidates score 0
            new = np.flatnonzero(met & ~seen)
            seen |= met
            if len(new):
                keys = within_64_bits(asked @ self.vectors[new].T)
                keys *= n
                keys += (n - 1 - new).astype(kind)
                # A query's own row is no candidate.
                at = np.minimum(np.searchsorted(new, own[walking]), len(new) - 1)
                self_met = np.flatnonzero(new[at] == own[walking])
                keys[self_met, at[self_met]] = lowest
                # Keys above the k-th so far, side by side, and the k best of both.
                query, place = np.nonzero(keys > top[walking].min(axis=1)[:, None])
                found = np.bincount(query, minlength=len(walking))
                width = int(found.max())
                better = np.full((len(walking), k + width), lowest, kind)
                better[:, :k] = top[walking]
                better[query, k + np.arange(len(query)) - np.repeat(np.cumsum(found) - found, found)] = keys[query, place]
                top[walking] = np.partition(better, width, axis=1)[:, width:]
            bound = within_64_bits(np.maximum(asked, 0) @ self.values[n - end] + np.minimum(asked, 0) @ self.values[end - 1])
            walking = walking[bound * n + (n - 1) >= top[walking].min(axis=1)]
            start, depth = end, depth * DEEPER
        top = np.sort(top, axis=1)[:, ::-1]
        query, place = np.nonzero(top > lowest)
        keys = top[query, place]
        keys = keys if kind == object else keys.astype(np.int64)
        return query, n - 1 - (keys % n).astype(np.int64), (keys // n).astype(np.int64)


def _search(key, queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """One pair of blocks."""
    out = [np.zeros(0, np.int64)] * 4
    if queries.num_rows and candidates.num_rows:
        matrix = lambda t: np.asarray(t.column("vector").combine_chunks().flatten(), np.int64).reshape(t.num_rows, -1)
        number = lambda t, c: t.column(c).to_numpy()
        asked, held = matrix(queries), matrix(candidates)
        kind = numbers_for(asked, held)
        lists = Lists(number(candidates, "vec_id"), number(candidates, "row"), held.astype(kind))
        rows = number(queries, "row")
        query, place, score = lists.best(asked.astype(kind), rows, k)
        out = [rows[query], number(queries, "vec_id")[query], lists.ids[place], score]
    return pa.table([pa.array(x, pa.int64()) for x in out], names=[f.split(" ")[0] for f in FOUND.split(", ")])


def integer_vectors(df: DataFrame, scale: float = 64.0, vector: str = "embedding") -> DataFrame:
    """vec_id, row, vector of longs, of the rows that take part; ``row`` tells rows apart."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), whole.alias("vector"))


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row that ``is_query`` (on vec_id) selects."""
    rows = cut_lineage(integer_vectors(df, scale, vector))
    asked = rows.filter(is_query)
    n_blocks, q_blocks = max(1, math.ceil(rows.count() / CANDIDATES)), max(1, math.ceil(asked.count() / QUERIES))
    dealt = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    columns = ["row", "vec_id", "vector", F.size("vector").alias("length")]
    left = asked.select(*columns, dealt(q_blocks).alias("q"), every(n_blocks).alias("c"))
    right = rows.select(*columns, every(q_blocks).alias("q"), dealt(n_blocks).alias("c"))
    keys = ["q", "c", "length"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    found = pairs.applyInArrow(lambda key, a, b: _search(key, a, b, k), FOUND)
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
