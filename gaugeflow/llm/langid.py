"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of sample texts. A text is compressed with
each dictionary, block by block, and belongs to the language that makes it smallest; where the two
smallest sizes lie within a narrow margin the text is marked as rejected. Nothing but the text is an
input of a prediction.

Learning takes a bounded sample, ``SAMPLE`` distinct texts of each language at most, picked by a hash of
the text. A dictionary is made of blocks from all over these texts, in an order drawn by hash: the first
block of every text, then the second of every text, until it is full. So neither an opening that texts
share nor a few long texts fill it, and few texts give as many blocks as they have. Prediction reads every whole text in blocks, so memory does not grow with a text.

A null text, or one without a letter, is ``und`` with score 0. So is every text if nothing could be
learned. Equal sizes go to the language with more rows, then the first in code-point order. Rows whose language is
null teach nothing. A passage that the samples of one language hold and those of another do not speaks for
the first, be it of either language. Repeated rows count as they come. Columns named like the added ones
are replaced; others are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.text import table

SAMPLE = 256  # documents of a language
DICTIONARY_BYTES = 256 << 10
BLOCK_BYTES = 4096
DRAWN_CHARS = 256  # of a block of a dictionary
LEVEL = 7
MARGIN = 0.01  # of the second smallest size
UNKNOWN = "und"


def language_samples(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """lang, rows (of that language), text of at most ``sample`` rows of each language, by smallest hash.

    A share of the rows by hash, twice of what is wanted, is freed of copies and ranked; no language
    meets in one task.
    """
    rows = labelled.filter(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(11), "text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("draw", 0.02).alias("texts")).collect()  # a row per language
    if not counts:
        return rows.select("lang", F.lit(0).alias("rows"), "text")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, 2.0 * sample / max(r["texts"], 1) * (1 << 20))])
    size = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, r["count"])])
    chosen = rows.filter(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "draw"])
    place = Window.partitionBy("lang").orderBy("draw", "text")
    return chosen.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= sample).select("lang", F.element_at(size, F.col("lang")).alias("rows"), "text")


def drawn_blocks(samples: DataFrame, size: int = DICTIONARY_BYTES) -> DataFrame:
    """lang, rows, place, block: at most ``size`` characters of each language in the order of their draw."""
    most = math.ceil(size / DRAWN_CHARS) + 1  # blocks of one text; its last may be short
    number = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / DRAWN_CHARS).cast("int"))).alias("k")
    cut = samples.filter(F.length("text") > 0).select("lang", "rows", F.xxhash64(F.lit(11), "text").alias("draw"), "text", number)
    cut = cut.withColumn("order", F.xxhash64("draw", "k"))
    of_text = F.row_number().over(Window.partitionBy("lang", "draw").orderBy("order", "k"))
    turns = cut.select("lang", "rows", "draw", "order", of_text.alias("turn"), F.substring("text", F.col("k") * DRAWN_CHARS + 1, F.lit(DRAWN_CHARS)).alias("block"))
    before = Window.partitionBy("lang").orderBy("turn", "order", "draw").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.filter(F.col("turn") <= most).withColumn("place", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)))
    return placed.filter(F.col("place") < size).select("lang", "rows", "place", "block")


def dictionaries(samples: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary content of each language, blocks of its sample texts; the most frequent language first."""
    found: dict[tuple[int, str], list[bytes]] = {}
    for row in drawn_blocks(samples, size).orderBy("lang", "place").toLocalIterator():
        found.setdefault((-row.rows, row.lang), []).append(row.block.encode())
    return {lang: b"".join(blocks)[:size] for (_, lang), blocks in sorted(found.items())}


class Compressors:
    def __init__(self, content: tuple[tuple[str, bytes], ...]):
        self.languages = [lang for lang, _ in content]
        self.by_language = []
        for _, data in content:
            # Eight bytes at least make a dictionary.
            book = zstandard.ZstdCompressionDict(data.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            self.by_language.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.letter = regex.compile(r"\p{L}")

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not self.letter.search(text):
            return UNKNOWN, 0.0, True
        data = text.encode()
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.by_language]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1 :] or [sum(len(self.plain.compress(b)) for b in blocks)]
        second = max(min(others), sizes[best])
        margin = 1 - sizes[best] / second
        return self.languages[best], margin, margin < MARGIN


@lru_cache(maxsize=1)
def compressors(content: tuple[tuple[str, bytes], ...]) -> Compressors:
    return Compressors(content)


def predict(df: DataFrame, learned: dict[str, bytes], text: str = "text") -> DataFrame:
    """Replaces ``text`` by lang_pred, score (relative margin to the second language) and rejected."""
    add = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    keep = [c for c in df.columns if c not in (text, *(f.name for f in add))]
    content = df.sparkSession.sparkContext.broadcast(tuple(learned.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compressors(content.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(text)]
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + [f.name for f in add])

    return df.select(*keep, text).mapInArrow(run, T.StructType([df.schema[c] for c in keep] + add))


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of the documents that teaches nothing; a null id belongs to neither part and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = dictionaries(language_samples(documents.filter(~held_out() & F.col("doc_id").isNotNull())))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, learned).select("doc_id", "held_out", "lang_pred", "score", "rejected")
