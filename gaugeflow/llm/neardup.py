"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles, as 64-bit hashes. One pass over the texts gives the
size of the set, a digest of it, MinHash samples joined into bands, and an odd sketch: every pair of
(sample number, sample value) flips one bit of a bitmap, so that the XOR of two bitmaps has about as many
ones as the two sample lists have differing entries, and its population count estimates a high
similarity closely. Documents with equal sets are one class from then on.

Candidates share a band. They are thinned by set sizes and by the sketch, and confirmed on the full sets:

1. Every band has a head, picked by a hash. A class is held against the ``HEADS`` heads of its bands that
   its sketch is closest to. A group of near copies collapses here, at a few pairs each: it has many
   heads, most members are similar to some, and the heads are members too.
2. Connected classes become components. In bands that still hold several components, all pairs
   across components are thinned and confirmed, each in the first band the two have in common. Pairs
   inside a component can change nothing. Here sets of up to ``SMALL`` shingles are thinned by an odd
   sketch of the whole set: the ones in the XOR of two such bitmaps never exceed the symmetric
   difference, so a group whose members are all a little too far apart yields hardly any pairs, and
   none that is a link is lost.

So no link that joins two groups is left out, whatever the size of a band, and no group's pairs are
listed. With ``BANDS`` bands of ``ROWS`` samples a pair at similarity 0.8 shares no band with probability
4e-9, and exceeds the sketch's bound, five standard deviations off, with probability 3e-7.

Nulls, empty and odd rows: a null or empty text, or one of separators only, has an empty set and is
linked with nothing. A null doc_id takes no part either: its component is null and it is kept. Of
repeated rows with one doc_id all have the same component and are all marked kept. Ties do not arise: a
component is named by its smallest doc_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.llm.text import cut_lineage, table

BANDS, ROWS = 64, 6
SKETCH_LONGS = 16
BITS = 64 * SKETCH_LONGS
SIMILAR_PERCENT = 80
HEADS = 2
SURE = 0.676  # estimate five standard deviations (12.8 bits each) below that of a pair at 0.8
CACHED_WORDS = 150_000
SHINGLES_AT_ONCE = 2048
SMALL, WHOLE_LONGS = 1400, 32  # shingles of a set that an odd sketch of all of it, of so many longs, tells apart

SKETCH = [f"s{k}" for k in range(SKETCH_LONGS)]
WHOLE = [f"w{k}" for k in range(WHOLE_LONGS)]
SIGNED = f"doc_id long, n_shingles long, digest string, bands array<long>, {', '.join(f'{s} long' for s in SKETCH + WHOLE)}"


class Shingler:
    """Shingle sets of texts, with the hashes of words kept between texts."""

    def __init__(self, words: int = 2) -> None:
        self.words, self.known = words, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the word shingles; of a shorter text the whole sequence as one."""
        words = text.encode().lower().split() if text else []  # bytes: A-Z and the six spaces only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            found = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            for word in set(words).difference(known):
                known[word] = xxhash.xxh64_intdigest(word)
            found = list(map(known.__getitem__, words))
        hashes = np.array(found, np.uint64)
        size = min(self.words, len(hashes))
        mixed = np.full(len(hashes) - size + 1, size, np.uint64)
        for k in range(size):
            mixed = mix64((mixed * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : k + len(mixed)])
        return np.unique(mixed)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Signer:
    """MinHash bands and odd sketch of a set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 8) -> None:
        draw = np.random.RandomState(seed)
        self.bands, self.k = bands, bands * rows
        self.a = (draw.randint(0, 2**32, self.k, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = draw.randint(0, 2**32, self.k, np.uint64).astype(np.uint32)
        self.place = mix64(np.arange(1, self.k + 1, dtype=np.uint64) << np.uint64(32))

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(low), SHINGLES_AT_ONCE):
            part = low[start : start + SHINGLES_AT_ONCE, None] * self.a + self.b
            np.minimum(least, part.min(axis=0), out=least)
        return least

    def sign(self, hashes: np.ndarray) -> tuple[list[int], list[int]]:
        entries = mix64(self.samples(hashes).astype(np.uint64) ^ self.place)
        bands = np.zeros(self.bands, np.uint64)
        for row in entries.reshape(self.bands, -1).T:
            bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) ^ row)
        odd = np.bincount((entries >> np.uint64(23)).astype(np.int64) % BITS, minlength=BITS) & 1
        sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
        return bands.view(np.int64).tolist(), sketch.tolist()


def whole_sketch(hashes: np.ndarray) -> list[int | None]:
    """Odd sketch of all hashes of a small set; nulls for a larger one."""
    if len(hashes) > SMALL:
        return [None] * WHOLE_LONGS
    bits = 64 * WHOLE_LONGS
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signatures(documents: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, digest, bands and the sketches; digest and the rest are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = shingler.shingles(text.as_py())
                if len(found):
                    bands, sketch = signer.sign(found)
                    rows.append((len(found), set_digest(found), bands, *sketch, *whole_sketch(found)))
                else:
                    rows.append((0, None, None, *[None] * (SKETCH_LONGS + WHOLE_LONGS)))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64())] + [pa.int64()] * (SKETCH_LONGS + WHOLE_LONGS)
            arrays = [batch.column(0)] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in SIGNED.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


def set_digest(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def differing_bits(similarity: float, samples: int = BANDS * ROWS) -> int:
    """Expected ones in the XOR of two odd sketches at a similarity."""
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * samples * (1 - similarity))))


def differing(left: str, right: str, sketch: list[str] = SKETCH) -> Column:
    """Ones in the XOR of two sketches."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in sketch])


def may_be_similar(left: str, right: str) -> Column:
    """Sizes and sketches of two classes allow the similarity."""
    col = lambda side, name: F.col(f"{side}.{name}")
    sizes = 100 * F.least(col(left, "n"), col(right, "n")) >= SIMILAR_PERCENT * F.greatest(col(left, "n"), col(right, "n"))
    return sizes & (differing(left, right) <= differing_bits(SURE))


def cannot_be_similar(left: str, right: str) -> Column:
    """The whole sets, where both are small, are known to differ too much.

    Similarity s leaves a symmetric difference of (1 - s) / (1 + s) of both sizes together.
    """
    n = F.col(f"{left}.n") + F.col(f"{right}.n")
    too_far = (100 + SIMILAR_PERCENT) * differing(left, right, WHOLE) > (100 - SIMILAR_PERCENT) * n
    return F.coalesce(too_far, F.lit(False))


def set_classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: node (its smallest doc_id), digest, n, bands and sketch."""
    same = lambda c: F.first(c).alias(c)  # noqa: E731  equal sets have equal signatures
    return (
        signed.filter("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), same("bands"), *map(same, SKETCH + WHOLE))
    )


def band_members(classes: DataFrame) -> DataFrame:
    """no, band, node, head; bands with one member are left out."""
    rows = classes.select("node", F.posexplode("bands").alias("no", "band"))
    first = F.min(F.struct(F.xxhash64("band", "node").alias("order"), "node")).node.alias("head")
    return rows.join(rows.groupBy("band").agg(F.count("*").alias("members"), first).filter("members > 1"), "band").drop("members")


def closest_heads(members: DataFrame, classes: DataFrame, heads: int = HEADS) -> DataFrame:
    """x, y: each class with the heads of its bands that its sketch is closest to."""
    side = classes.select("node", "n", *SKETCH)
    pairs = members.filter("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y")).distinct()
    near = (
        pairs.join(side.alias("a"), F.col("x") == F.col("a.node"))
        .join(side.alias("b"), F.col("y") == F.col("b.node"))
        .filter(may_be_similar("a", "b"))
        .select("x", "y", differing("a", "b").alias("ones"))
    )
    place = Window.partitionBy("x").orderBy("ones", "y")
    best = near.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= heads)
    return best.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def pairs_across(members: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """x, y: candidate pairs of different components, from all bands that hold several."""
    placed = members.select("no", "band", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    # Half of each band hash is enough to see a common one (a chance hit on 64 bands: 1e-8).
    halves = F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("halves")
    rows = cut_lineage(placed.join(mixed, "band").join(classes.select("node", "n", *SKETCH, *WHOLE, halves), "node"))
    before = F.zip_with(F.slice("a.halves", F.lit(1), F.col("a.no")), F.slice("b.halves", F.lit(1), F.col("b.no")), lambda x, y: x == y)
    first = ~F.exists(before, lambda same: same)
    pair = (F.col("a.band") == F.col("b.band")) & (F.col("a.component") < F.col("b.component")) & may_be_similar("a", "b") & ~cannot_be_similar("a", "b") & first
    return rows.alias("a").join(rows.alias("b"), pair).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()


def full_sets(documents: DataFrame, nodes: DataFrame, words: int = 2) -> DataFrame:
    """node, shingles of the named classes, made anew from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [shingler.shingles(t.as_py()) for t in batch.column(1)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0] + [len(f) for f in found]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))
            )
            arrays = [batch.column(0), pa.array([set_digest(f) for f in found], pa.string()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "digest", "shingles"])

    wanted = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.select("node").distinct(), "node", "left_semi")
    made = wanted.mapInArrow(run, "node long, digest string, shingles array<long>")
    # A doc_id may name several texts; the class is the one with its digest.
    return made.join(nodes, ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"]).select("node", "shingles")


def confirmed(pairs: DataFrame, documents: DataFrame, classes: DataFrame, words: int = 2) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    sets = cut_lineage(full_sets(documents, ends.join(classes.select("node", "digest"), "node"), words))
    common = F.size(F.array_intersect("a.shingles", "b.shingles"))
    union = F.size("a.shingles") + F.size("b.shingles") - common
    return cut_lineage(
        pairs.join(sets.alias("a"), F.col("x") == F.col("a.node"))
        .join(sets.alias("b"), F.col("y") == F.col("b.node"))
        .filter(100 * common >= SIMILAR_PERCENT * union)
        .select("x", "y")
    )


def connected(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge.

    Large-star and small-star in turn: each links the neighbours of a node to the smallest of them,
    first the larger ones, then the smaller. Neighbours are joined to the minimum, never gathered, so
    a node with any number of links is spread over tasks. The edges are stored after each round.
    """
    both = lambda e: e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    edges = cut_lineage(edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    size = (-1, -1)
    while True:
        around = both(edges)
        low = around.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("low"))
        large = around.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(low, "x")
        small = small.select(F.col("y").alias("x"), F.col("low").alias("y")).unionByName(small.select("x", F.col("low").alias("y")))
        edges = cut_lineage(small.filter("x <> y").distinct())
        found = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0)).alias("mark")).first()
        if (found.n, found.mark) == size:
            break
        size = (found.n, found.mark)
    smallest = edges.select(F.col("y").alias("node")).distinct()
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(smallest.select("node", F.col("node").alias("component")))


def near_duplicates(documents: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    signed = cut_lineage(signatures(documents, words))
    classes = cut_lineage(set_classes(signed))
    members = cut_lineage(band_members(classes))
    links = confirmed(closest_heads(members, classes), documents, classes, words)
    across = confirmed(pairs_across(members, classes, connected(links)), documents, classes, words)
    components = connected(links.unionByName(across))
    named = classes.select("digest", "node").join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def kept_documents(documents: DataFrame, words: int = 2) -> DataFrame:
    """One document of each group, with all columns whatever their names: the one with the smallest doc_id.

    Rows are told apart by number, so of rows with one doc_id, or without any, one of a group stays as well: a null
    doc_id comes after all others and equal ones are taken in the order of the stored table. Documents without words stay.
    """
    held = documents.select(F.struct(*documents.columns).alias("_document"), F.monotonically_increasing_id().alias("_row"))
    field = lambda c: F.col("_document").getField(c)
    found = near_duplicates(held.select(F.col("_row").alias("doc_id"), field("text").alias("text")), words)
    grouped = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = held.select("_row", field("doc_id").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")
    first = ids.join(grouped, "_row").groupBy("_group").agg(F.min(order)["_row"].alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    gone = grouped.join(first, "_group").filter("_row <> _first").select("_row")
    return held.join(gone, "_row", "left_anti").select(*[field(c).alias(c) for c in documents.columns])


def document_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
