"""Packed token-id matrices by best-fit-decreasing packing.

Documents become token ids; one longer than the context is split into whole contexts and a rest, so no
token is lost. The rests are packed, longest first, each into the fullest open row that still has room:
a segment tree over the free room of rows, from 0 to the context, counts the open rows and finds the
smallest sufficient room in logarithmic time. Every packed row has its ids in one matrix row (two bytes
each, padded), the cumulative lengths of its segments as attention kernels take them, the places where
positions start again from 0, and for each segment the document and its offset in it.

Packing is done on groups of at most ``GROUP_TOKENS`` tokens where the texts are read: nothing is
shuffled, a task holds one group, and a repeated task gives the same rows. ``write_matrices`` stores them,
``read_matrices`` reads them back and derives lengths and digests from what is stored.

Ids come from ``encode``, a function of a text; matrices hold two bytes an id, or four for a ``vocabulary`` of
more than 65,536, and an id outside the vocabulary is an error. By default ids are bytes: 0 pads, 1 ends a
document, byte b is b + 3. A null text is an empty one and gives the end
mark only. A null doc_id stays null in the lists. Repeated rows are packed each. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from gaugeflow.llm.text import table
from gaugeflow.session import shared_folder

CONTEXT = 2048
GROUP_TOKENS = 1 << 23
PAD, END, FIRST_BYTE = 0, 1, 3
BYTES = FIRST_BYTE + 256  # ids of the byte vocabulary
ROWS = "pack long, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"


def byte_ids(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint16) + FIRST_BYTE
    return np.append(data, np.uint16(END))


def id_type(vocabulary: int) -> type:
    """The smallest type of a matrix that holds every id of a vocabulary."""
    if vocabulary > 1 << 32:
        raise OverflowError(f"ids of a vocabulary of {vocabulary} do not fit into four bytes")
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def checked(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids in the type of their matrix; one outside the vocabulary is an error."""
    ids = np.asarray(ids)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < vocabulary:
        raise OverflowError(f"an id lies outside the vocabulary of {vocabulary}")
    return ids.astype(id_type(vocabulary))


class FreeRoom:
    """Open rows by free room, with a segment tree that counts them."""

    def __init__(self, context: int) -> None:
        self.leaves = 1 << context.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the smallest room of at least ``need``."""
        node, count = need + self.leaves, self.count
        while not count[node]:
            # Up to the first node whose right sibling holds rows, all of them with more room.
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], context: int) -> list[list[int]]:
    """Items in each row; items are placed longest first, equal ones in their order."""
    free, rows = FreeRoom(context), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[item])
        if found is None:
            room, row = context, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(item)
        if room > lengths[item]:
            free.add(room - lengths[item], row)
    return rows


def pack_rows(documents: list[tuple[int | None, np.ndarray]], context: int = CONTEXT, vocabulary: int = BYTES) -> Iterator[tuple[list, np.ndarray]]:
    """([(doc_id, offset, length), ...], padded ids) of each packed row."""
    rests: list[tuple[int | None, int, np.ndarray]] = []
    for doc_id, ids in documents:
        ids = checked(ids, vocabulary)
        whole = len(ids) - len(ids) % context
        for start in range(0, whole, context):
            yield [(doc_id, start, context)], ids[start : start + context]
        if whole < len(ids):
            rests.append((doc_id, whole, ids[whole:]))
    for items in best_fit([len(r[2]) for r in rests], context):
        row, at = np.full(context, PAD, id_type(vocabulary)), 0
        for i in items:
            row[at : at + len(rests[i][2])] = rests[i][2]
            at += len(rests[i][2])
        yield [(rests[i][0], rests[i][1], len(rests[i][2])) for i in items], row


def packed(
    df: DataFrame, context: int = CONTEXT, group_tokens: int = GROUP_TOKENS, encode: Callable[[str | None], np.ndarray] = byte_ids, vocabulary: int = BYTES
) -> DataFrame:
    """Packed rows of the documents (doc_id, text): pack, doc_ids, doc_offsets, cu_seqlens, position_resets, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("pack", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))]
            + [("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary())]
        )
        number = TaskContext.get().partitionId() << 33

        def emit(group: list) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []
            for segments, ids in pack_rows(group, context, vocabulary):
                ends = np.cumsum([0] + [s[2] for s in segments]).tolist()
                rows.append((number, [s[0] for s in segments], [s[1] for s in segments], ends, ends[:-1], ids.tobytes()))
                number += 1
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        group, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                if held and held + len(ids) > group_tokens:
                    yield from emit(group)
                    group, held = [], 0
                group.append((doc_id, ids))
                held += len(ids)
        if group:
            yield from emit(group)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def write_matrices(df: DataFrame, path: str, **options) -> None:
    """Packed rows as a table; ``ids`` are little-endian numbers of two or four bytes, ``context`` of them in a row."""
    packed(df, **options).write.parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with n_tokens, from the segment lengths, and ids_sha256, from the stored ids."""
    stored = spark.read.schema(ROWS).parquet(path)
    return stored.select(
        "pack", F.element_at("cu_seqlens", -1).alias("n_tokens"), "doc_ids", "doc_offsets", "cu_seqlens", "position_resets", F.sha2("ids", 256).alias("ids_sha256"), "ids"
    )


def document_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrices of all documents to the shared folder and reads them back."""
    path = f"{shared_folder(spark)}/gaugeflow-matrices/{uuid.uuid4().hex}"
    write_matrices(table(spark, sf_dir, "documents"), path)
    return read_matrices(spark, path).drop("ids")
