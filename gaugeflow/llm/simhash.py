"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into ``SEGMENTS`` segments, and the numbers of ones per segment embed it in a grid:
the Manhattan distance of two embeddings is never above the Hamming distance of the fingerprints. Counts
are held in unary (``unary``), so that the Manhattan distance is the population count of an XOR.

Range join over the grid: segments are grouped into ``k + radius`` blocks. Fingerprints within the radius
have a Manhattan distance of at most the radius, so at least ``k`` blocks are at distance 0; a cell is a
choice of ``k`` blocks and their counts, every fingerprint lies in one cell per choice, and whoever is within
the radius shares a cell. ``k`` grows with the number of fingerprints, so that a fingerprint meets about the
same number of others whatever the size of the corpus. Pairs of a cell are held against the Manhattan
distance and verified on the fingerprints. No link is missed.

Equal fingerprints are one class from the start. The classes of a cell are not paired with each other at once:

1. Every class is held against the head of each of its cells, picked by a hash. Most of a dense group
   collapses here, at one pair per class and cell. Connected classes become components.
2. In cells that still hold several components the pairs across components are verified, each in the first
   cell the two have in common. Pairs inside a component can change nothing.

Nulls, empty and odd rows: a text without words, or a null one, has fingerprint zero and is linked like any
other. Words are counted with repeats, texts are read whole. Rows whose doc_id is null have a fingerprint,
link nothing and have a null component. Repeated rows have a result each. Ties do not arise: a bit needs
more than half. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.bpe import batches
from gaugeflow.llm.neardup import connected
from gaugeflow.llm.text import cut_lineage, table

WORDS, SEED = 4, 42  # of a shingle and of its XXH64; fixed by the contract of the query
RADIUS = 4  # differing bits of a link
SEGMENTS = 32  # of two bits each
MEETINGS = 256  # classes that one class may meet on average before cells are made finer
LANE = np.uint64(0x0101010101010101)
ROWS_AT_ONCE = 255  # what a lane of eight bits can count


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set: eight lanes of a number count at once."""
    whole = -len(hashes) % ROWS_AT_ONCE
    rows = np.concatenate([hashes, np.zeros(whole, np.uint64)]).reshape(-1, ROWS_AT_ONCE)
    lanes = [(rows >> np.uint64(k) & LANE).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0) for k in range(8)]
    return np.stack(lanes, axis=1).reshape(64)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of the word shingles in order; of a shorter text the whole sequence as one."""
    found = text.encode().lower().split() if text else []  # bytes: A-Z and the six spaces only
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in more than half of the hashes, as a signed number; zero for a text without words."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    ones = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = pa.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def unary(fp: Column) -> Column:
    """Number of ones of every two-bit segment in unary: 00, 01 or 11."""
    low = F.lit(signed(0x5555555555555555))
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def distance(left: Column, right: Column) -> Column:
    """Manhattan distance of unary embeddings, or Hamming distance of fingerprints."""
    return F.bit_count(left.bitwiseXOR(right))


def fineness(classes: int, radius: int = RADIUS) -> int:
    """Number of blocks in a cell, the fewest that keep the expected meetings of a class in bounds.

    Two random segments have equal counts with probability 3/8.
    """
    expected = lambda k: classes * comb(k + radius, k) * 0.375 ** (SEGMENTS * k / (k + radius))
    return next((k for k in range(1, SEGMENTS - radius) if expected(k) <= MEETINGS), SEGMENTS - radius)


def block_masks(blocks: int) -> list[int]:
    """The bits of each block; blocks are runs of whole segments."""
    edges = [2 * (SEGMENTS * b // blocks) for b in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def choices(k: int, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """For each choice of k blocks: its bits, and the blocks passed over before its last one.

    Of two embeddings that share several cells the first is the one whose passed blocks all differ.
    """
    masks = block_masks(k + radius)
    return [(sum(masks[b] for b in chosen), [masks[b] for b in range(chosen[-1]) if b not in chosen]) for chosen in combinations(range(k + radius), k)]


def cells(classes: DataFrame, k: int, radius: int = RADIUS) -> DataFrame:
    """node, fp, counts, no, cell: one row per class and choice of blocks."""
    masks = F.array(*[F.lit(signed(mask)) for mask, _ in choices(k, radius)])
    rows = classes.withColumn("counts", unary(F.col("fp"))).select("*", F.posexplode(masks).alias("no", "mask"))
    return rows.select("node", "fp", "counts", "no", F.xxhash64("no", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"))


def close(a: str, b: str, radius: int = RADIUS) -> Column:
    """The lower bound allows a link, and the fingerprints are one."""
    col = lambda side, name: F.col(f"{side}.{name}")
    return (distance(col(a, "counts"), col(b, "counts")) <= radius) & (distance(col(a, "fp"), col(b, "fp")) <= radius)


def cell_heads(rows: DataFrame) -> DataFrame:
    """cell, node, fp, counts of the head of every cell with several classes."""
    head = F.min(F.struct(F.xxhash64("cell", "node").alias("order"), "node", "fp", "counts")).alias("head")
    return rows.groupBy("cell").agg(head, F.count("*").alias("members")).filter("members > 1").select("cell", "head.node", "head.fp", "head.counts")


def head_links(rows: DataFrame, heads: DataFrame, radius: int = RADIUS) -> DataFrame:
    """x, y: each class with the heads of its cells within the radius."""
    linked = rows.alias("a").join(heads.alias("b"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.node") != F.col("b.node")) & close("a", "b", radius))
    return linked.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()


def links_across(rows: DataFrame, components: DataFrame, k: int, radius: int = RADIUS) -> DataFrame:
    """x, y: links between classes of different components."""
    placed = rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("cell")
    held = cut_lineage(placed.join(mixed, "cell"))
    a, b = held.alias("a"), held.alias("b")
    apart = F.col("a.counts").bitwiseXOR(F.col("b.counts"))
    passed = F.array(*[F.array(*[F.lit(signed(m)) for m in skipped]).cast("array<long>") for _, skipped in choices(k, radius)])
    first = F.forall(F.get(passed, F.col("a.no")), lambda mask: apart.bitwiseAND(mask) != 0)
    pair = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.component") < F.col("b.component")) & close("a", "b", radius) & first
    return a.join(b, pair).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    made = cut_lineage(fingerprints(documents, words))
    classes = cut_lineage(made.filter("doc_id is not null").groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("node")))
    k = fineness(classes.count(), radius)
    rows = cells(classes, k, radius)
    links = cut_lineage(head_links(rows, cell_heads(rows), radius))
    across = links_across(rows, connected(links), k, radius)
    components = connected(links.unionByName(across))
    named = classes.join(components, "node", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component", "node").alias("component"))
    found = made.join(named, "fingerprint", "left")
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def document_near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
