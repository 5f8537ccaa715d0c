"""Fill-in-the-middle transformation over a wavelet matrix of character classes.

Every character has a class (``CLASSES``), and a unit of text ends after each character of certain classes:
a line after a newline, a sentence after a newline or a full stop. The texts of a bounded Arrow batch are
one sequence of classes, held as a wavelet matrix: one bit vector with counts per 64 bits for each bit of
the class. ``rank`` counts a class before a position; summed over the classes of a unit it counts unit ends.
Two such counts give the number of units of a text, and bisection on the counts finds the place of any
unit's end, so both cuts of all texts of the batch are found together.

Where to cut, and the form of the output, depend on a hash of seed and doc_id alone. The output is
``prefix + suffix + middle`` with marks in front of each (psm), ``suffix + prefix + middle`` (spm) or the text
itself (plain). ``restored`` gives the text back as a column expression. Texts never leave the task that
reads them: no shuffle. A batch holds at most ``bpe.BATCH_CHARS`` characters or one text.

Null and empty texts are plain with no units; a text that holds a mark is plain. A null doc_id hashes as
an empty string. Very long texts are cut whole. Repeated rows have a result each. Other columns are passed
through; one that has the name of an added column is replaced by it. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.bpe import batches
from gaugeflow.llm.text import table

#: Class of a character by its place in this list; what no entry names has class 0.
CLASSES = ["other", "newline", "space", "digit", "stop", "pause"]
MEMBERS = {"newline": "\n", "space": " \t\r\v\f", "digit": "0123456789", "stop": ".!?", "pause": ",;:"}
#: A unit ends after every character of these classes.
UNITS = {"line": ["newline"], "sentence": ["newline", "stop"], "clause": ["newline", "stop", "pause"], "word": ["newline", "space"], "character": CLASSES}
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle; fixed by the contract of the query
LEVELS = 3  # bits of a class
FIELDS = [
    T.StructField("units", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


class BitVector:
    """Bits with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of small numbers in a sequence."""

    def __init__(self, codes: np.ndarray, levels: int = LEVELS) -> None:
        self.size, self.levels = len(codes), []
        for level in reversed(range(levels)):
            bits = (codes >> level & 1).astype(bool)
            zeros = codes[~bits]
            self.levels.append((level, BitVector(bits), len(zeros)))
            codes = np.concatenate([zeros, codes[bits]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` occurs before each position."""
        start, end = np.zeros(1, np.int64), at
        for level, bits, zeros in self.levels:
            if code >> level & 1:
                start, end = zeros + bits.rank(start), zeros + bits.rank(end)
            else:
                start, end = start - bits.rank(start), end - bits.rank(end)
        return end - start

    def count(self, codes: list[int], at: np.ndarray) -> np.ndarray:
        """How many characters of several classes are before each position."""
        return sum(self.rank(code, at) for code in codes)

    def locate(self, codes: list[int], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First position in (low, high] before which ``nth`` characters of the classes are."""
        low, high = low.copy(), high.copy()
        while (open_ := high - low > 1).any():
            middle = (low + high) >> 1
            enough = self.count(codes, middle) >= nth
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle, low)
        return high


def class_table() -> np.ndarray:
    """Class of every ASCII character, and of all others in the last place."""
    codes = np.zeros(129, np.uint8)
    for name, members in MEMBERS.items():
        codes[[ord(c) for c in members]] = CLASSES.index(name)
    return codes


def unit_cuts(texts: list[str], picks: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of units of each text, and the ends of the units that two picks (modulo units + 1) name.

    Row k of ``picks`` holds two numbers for text k; the ends are code points from the start of the text.
    """
    codes = [CLASSES.index(c) for c in UNITS[unit]]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    classes = class_table()[np.minimum(points, 128)]
    matrix = WaveletMatrix(classes)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(lengths)
    start = end - lengths
    before = matrix.count(codes, start)
    closed = matrix.count(codes, end) - before
    last = classes[np.maximum(end - 1, 0)] if len(classes) else np.zeros(len(texts), np.uint8)
    units = closed + ((lengths > 0) & ~np.isin(last, codes))
    cuts = np.sort(picks % (units + 1)[:, None].astype(np.uint64), axis=1).astype(np.int64)
    ends = np.zeros_like(cuts)
    for side in (0, 1):
        nth = cuts[:, side]
        inside = (nth > 0) & (nth <= closed)
        ends[:, side] = np.where(nth > closed, lengths, 0)
        found = matrix.locate(codes, before[inside] + nth[inside], start[inside], end[inside])
        ends[inside, side] = found - start[inside]
    return units, ends


def hashes(seed: int, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of seed and doc_id."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[k : k + 8], 16) for k in (0, 8, 16, 24)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever text meets them: none lies in or overlaps with another."""
    for a in marks:
        for b in marks:
            inside = a != b and a in b
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b)))
            if not a or inside or overlap or len(set(marks)) < 3:
                raise ValueError(f"marks {marks} cannot be told apart")


def transform(
    df: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Replaces ``text`` by units, form, prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are transformed, ``spm`` percent of those with the suffix first.
    """
    check_marks(marks)
    added = {f.name for f in FIELDS}
    keep = [c for c in df.columns if c != text and c not in added]
    schema = T.StructType([df.schema[c] for c in keep] + FIELDS)
    p, s, m = marks

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches(rows, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            drawn = [hashes(seed, i) for i in batch.column("id").to_pylist()]
            units, ends = unit_cuts(texts, np.array([h[:2] for h in drawn], np.uint64).reshape(-1, 2), unit)
            made: list[tuple] = []
            for value, (_, _, h3, h4), n, (a, b) in zip(texts, drawn, units.tolist(), ends.tolist()):
                if not value or p in value or s in value or m in value or h3 % 100 >= rate:
                    made.append((n, "plain", None, None, value))
                elif h4 % 100 < spm:
                    made.append((n, "spm", a, b - a, f"{s}{value[b:]}{p}{value[:a]}{m}{value[a:b]}"))
                else:
                    made.append((n, "psm", a, b - a, f"{p}{value[:a]}{s}{value[b:]}{m}{value[a:b]}"))
            arrays = [batch.column(f"c{k}").cast(arrow.field(c).type) for k, c in enumerate(keep)]
            arrays += [pa.array([r[k] for r in made], arrow.field(f.name).type) for k, f in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    given = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(text).alias("text"), F.col(doc_id).cast("long").alias("id"))
    return given.mapInArrow(run, schema)


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``output`` was made in ``form``."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(map(re.escape, marks)))
    part = lambda k: F.get(parts, F.lit(k))  # noqa: E731  the first part is empty
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )


def document_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored("output", "form")).alias("restored_sha256"),
    )
