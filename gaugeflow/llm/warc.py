"""WARC archives by way of a chunked record table.

A payload leaves its row at once as chunks of bounded size, rows of record identifier and chunk number,
while a running SHA-1 gives the digest of the whole. A chunk is one WARC record on disk: the first (or
only) one of type response, the others of type continuation with segment numbers, as the format
provides for payloads in pieces. Reading gives chunk rows again; a record in one piece is digested
where it is read, the chunks of a longer one go by record identifier and in chunk order through a
running digest. No task ever joins the chunks of a record.

Files are gzip-compressed and written by Spark's own writer, so they may lie in any store that Spark
knows and a lost task is written anew. Records are cut so that ``WARC/1.1`` with its line end occurs
only where a record starts; the reader splits there, and block lengths and digests are checked.

Of records with equal payloads (by SHA-1) of at least ``revisit_bytes`` bytes the one with the smallest
identifier is stored, the others become revisit records that refer to it. Of repeated rows with one
identifier one is stored; a null identifier comes after all others. A null payload is an empty one.
A null URL gives a record without target; characters that would break a header line are escaped.
An empty table gives an archive without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.text import cut_lineage, table
from gaugeflow.session import shared_folder

CHUNK_BYTES = 1 << 20
MARK = b"WARC/1.1\r\n"
END = "\r\n"

CHUNKS = "record string, id long, url string, digest string, bytes long, chunk_no int, last boolean, chunk string"
DIGESTS = "record string, id long, digest string, bytes long"
READ = "record string, id long, type string, url string, refers string, segment int, bytes long, digest string, stated string, chunk binary"
INDEX = "record string, id long, type string, url string, refers string, bytes long, digest string, stated string"


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def pieces(payload: memoryview, chunk_bytes: int = CHUNK_BYTES) -> Iterator[memoryview]:
    """The payload in chunks that end between characters and never hold a record's first line."""
    start, n = 0, len(payload)
    if not n:
        yield payload
    while start < n:
        end = min(start + chunk_bytes, n)
        while end < n and end > start + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        # The line end after a block completes a mark too.
        at = (bytes(payload[start:end]) + b"\r\n").find(MARK)
        if at >= 0:
            end = start + at + 1
        yield payload[start:end]
        start = end


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, str | None, memoryview]]:
    """record (unique and the same in a repeated task), id, url, payload."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        payloads = batch.column(2).cast(pa.large_binary())
        for i, (key, url) in enumerate(zip(ids, urls)):
            value = payloads[i].as_buffer()
            yield f"urn:page:{'' if key is None else key}:{part}-{k}", key, url, memoryview(value if value is not None else b"")
            k += 1


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for record, key, _, payload in _rows(batches):
            sha = hashlib.sha1()
            for piece in pieces_plain(payload):
                sha.update(piece)
            yield record, key, base32_sha1(sha), len(payload)

    yield from _packed(made(), DIGESTS)


def pieces_plain(payload: memoryview) -> Iterator[memoryview]:
    return (payload[k : k + CHUNK_BYTES] for k in range(0, len(payload), CHUNK_BYTES))


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _packed(rows: Iterator[tuple], schema: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; a chunk, if any, is the last column."""
    fields = [(x.split(" ")[0], _ARROW[x.split(" ")[1]]) for x in schema.split(", ")]
    arrow, held, size = pa.schema(fields), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        size += 200 + (len(row[-1]) if row[-1].__class__ in (str, bytes) else 0)
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def chunk_table(df: DataFrame, id_column: str, url: str, payload: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of every payload, with digest and length of the whole payload on each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for record, key, link, data in _rows(batches):
                sha = hashlib.sha1()
                for piece in pieces_plain(data):
                    sha.update(piece)
                digest, parts = base32_sha1(sha), pieces(data, chunk_bytes)
                no, piece = 0, next(parts)
                while piece is not None:
                    after = next(parts, None)
                    yield record, key, link, digest, len(data), no, after is None, str(piece, "utf-8")
                    no, piece = no + 1, after

        yield from _packed(made(), CHUNKS)

    return _source(df, id_column, url, payload).mapInArrow(run, CHUNKS)


def _source(df: DataFrame, id_column: str, url: str, payload: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload"))


def escaped(url: str):
    """A URL as one header value: white space and control characters percent-encoded."""
    one = F.col(url)
    for c in (*range(0x00, 0x21), 0x7F):
        one = F.replace(one, F.lit(chr(c)), F.lit(quote(chr(c))))
    one = F.replace(one, F.lit("WARC/1.1"), F.lit("%57ARC/1.1"))
    return F.when(F.col(url).rlike(r"[\x00-\x20\x7F]|WARC/1\.1"), one).otherwise(F.col(url))


def write_archive(df: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Writes the records of ``df`` as gzip-compressed WARC files into the folder ``path``."""
    seen = _source(df, id_column, url, payload).mapInArrow(_digest_rows, DIGESTS)
    first = (
        seen.filter(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "record")).record.alias("original"))
    )
    # Copies meet by digest without their payload; payloads go by record, of which there is one each.
    again = seen.select("record", "digest", "bytes").filter(F.col("bytes") >= revisit_bytes).join(first, "digest").filter("original <> record")
    chunks = chunk_table(df, id_column, url, payload, chunk_bytes).join(again.select("record", "original"), "record", "left")
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(END))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END)
    )
    block = F.when(revisit, head).when(F.col("chunk_no") == 0, F.concat(head, "chunk")).otherwise(F.col("chunk"))
    kind = F.when(revisit, "revisit").when(F.col("chunk_no") == 0, "response").otherwise("continuation")
    named = F.when(F.col("chunk_no") == 0, F.col("record")).otherwise(F.concat("record", F.lit("#"), F.col("chunk_no").cast("string")))
    ref = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    pieces_of = (F.col("chunk_no") > 0) | ~F.col("last")
    record = F.concat(
        F.lit(MARK.decode()),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", ref(named)),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", escaped("url"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("kind") == "revisit", F.concat(
            line("WARC-Refers-To", ref(F.col("original"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(""),
        F.when(pieces_of & (F.col("kind") != "revisit"), line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"))).otherwise(""),
        F.when(F.col("kind") == "continuation", line("WARC-Segment-Origin-ID", ref(F.col("record")))).otherwise(""),
        F.when((F.col("kind") == "continuation") & F.col("last"), line("WARC-Segment-Total-Length", (F.col("bytes") + F.octet_length(head)).cast("string"))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(END),
        F.col("block"),
        F.lit(END),
    )
    rows = chunks.filter(~revisit | (F.col("chunk_no") == 0)).withColumns({"kind": kind, "block": block})
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each WARC record; a payload in one piece is digested here and goes no further."""

    def made():
        for batch in batches:
            for value in batch.column(0):
                data = memoryview(value.as_buffer())
                if not len(data):
                    continue
                # Header lines are short; a look at the front finds their end.
                front = bytes(data[: 1 << 16])
                cut = front.find(b"\r\n\r\n")
                if cut < 0:
                    front = bytes(data)
                    cut = front.find(b"\r\n\r\n")
                fields = {}
                for row in front[:cut].decode("utf-8", "replace").split("\r\n"):
                    name, _, text = row.partition(": ")
                    fields[name.lower()] = text
                length = int(fields["content-length"])
                block = data[cut + 4 : cut + 4 + length]
                if len(block) != length or bytes(data[cut + 4 + length :]) != b"\r\n\r\n":
                    raise ValueError(f"damaged record {fields.get('warc-record-id')}")
                kind = fields["warc-type"]
                body = block if kind == "continuation" else block[bytes(block[: 1 << 16]).find(b"\r\n\r\n") + 4 :]
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])[1:-1]
                segment = int(fields.get("warc-segment-number", 0))
                key = origin.split(":")[2]
                stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                common = origin, int(key) if key else None, kind, fields.get("warc-target-uri"), fields.get("warc-refers-to", "<>")[1:-1] or None, segment
                if kind == "revisit":
                    yield *common, None, None, stated, None
                elif segment:
                    yield *common, None, None, stated, bytes(body)
                else:
                    yield *common, len(body), base32_sha1(hashlib.sha1(body)), stated, None

    yield from _packed(made(), READ)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a record follow each other by segment; those of a payload in pieces become one row."""

    def made():
        open_row, sha, size, segment = None, None, 0, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            chunks = batch.column(batch.num_columns - 1)
            for i, row in enumerate(zip(*columns)):
                if open_row is not None and row[0] != open_row[0]:
                    yield *open_row[:5], size, base32_sha1(sha), open_row[8]
                    open_row = None
                if not row[5]:
                    yield *row[:5], *row[6:9]
                    continue
                if open_row is None:
                    open_row, sha, size, segment = row, hashlib.sha1(), 0, 0
                if row[5] != segment + 1:
                    raise ValueError(f"segment {segment + 1} of {row[0]} is missing")
                chunk = memoryview(chunks[i].as_buffer())
                sha.update(chunk)
                size, segment = size + len(chunk), segment + 1
        if open_row is not None:
            yield *open_row[:5], size, base32_sha1(sha), open_row[8]

    yield from _packed(made(), INDEX)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Every WARC record below ``path``: payloads in pieces keep their chunk, others have a digest already."""
    return spark.read.text(path, lineSep=MARK.decode()).select(F.col("value").cast("binary")).mapInArrow(_parsed, READ)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: id, url, bytes, digest, type and refers_to, digests of revisits taken from what they refer to.

    A payload whose digest is not the stated one fails the job.
    """
    chunks = read_chunks(spark, path)
    placed = chunks.repartition("record").sortWithinPartitions("record", "segment")
    index = cut_lineage(placed.mapInArrow(_running, INDEX))
    wrong = F.raise_error(F.concat(F.lit("payload digest of "), "record"))
    stored = index.filter("type = 'response'").withColumn("digest", F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(wrong))
    target = stored.select(F.col("record").alias("refers"), F.col("id").alias("refers_to"), F.col("bytes").alias("full"), F.col("digest").alias("whole"))
    again = index.filter("type = 'revisit'").join(target, "refers", "left")
    columns = ["id", "url", "type"]
    return stored.select(*columns, "bytes", "digest", F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.select(*columns, F.col("full").alias("bytes"), F.col("whole").alias("digest"), "refers_to")
    )


def archive_round_trip(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``df`` and reads it back; without ``path``, below the shared folder of the session."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/gaugeflow-warc/{uuid.uuid4().hex}"
    return read_archive(spark, write_archive(df, path, **options))


def pages_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_round_trip(table(spark, sf_dir, "pages"))
    return rows.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
