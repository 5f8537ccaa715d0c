"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A text is cut at special tokens, then before every space that a non-space follows (no piece of the
vocabulary's pattern crosses such a place). A batch's distinct chunks (found by Arrow) are looked up in a bounded cache
of two generations, so that frequent chunks stay when it is full, and the ids of all texts are gathered from theirs
at once. Chunks met for the first time in a batch are cut into words by the pattern. A short word is a row of
two contiguous arrays, its parts and the ranks of adjacent parts: the smallest rank is scanned for, its
boundary deleted and the two ranks beside it refreshed, until no pair can merge. The rows of a batch
take these steps together (numpy). The scan is quadratic, so a word of more than ``SHORT`` bytes keeps
its candidate pairs in a heap instead; both ways pick the leftmost pair of the lowest rank.

The texts stay in the tasks that read them (``mapInArrow``): no shuffle. A task holds one Arrow batch,
the vocabulary and the caches.

Null text counts as empty: no ids. Empty texts give empty lists, very long texts and words are whole.
Repeated rows are encoded each. Other columns are passed through; one that has the name of an added
column is replaced by it. Empty tables give no rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORT = 64  # bytes of a word up to which the rank array is scanned
CACHED_CHUNKS = 300_000
CACHED_CHARS = 48  # longer chunks are not kept
SCANNED = 4096  # words scanned at once
BATCH_CHARS = 2_000_000
NEVER = np.iinfo(np.int32).max

# Fixed by the vocabulary: white space as Unicode defines it (not Python's, which has four more).
WHITE = r"\t-\r \x85\xA0  -     　"
PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def printable_bytes() -> dict[str, int]:
    """Byte of each character that the vocabulary file writes: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def has_newer(text: str) -> bool:
    """Whether a text has a code point that this Python's Unicode tables do not know."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class Vocabulary:
    """A vocabulary file of the ``tokenizers`` library (byte-level BPE) and the encoder over it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = printable_bytes()
        ids = spec["model"]["vocab"]
        raw = {token: bytes(byte_of[c] for c in token) for token in ids}
        self.bytes_of = {i: raw[token] for token, i in ids.items()}
        self.of_byte = [0] * 256
        for token, i in ids.items():
            if len(raw[token]) == 1:
                self.of_byte[raw[token][0]] = i
        #: (left id, right id) as one number -> (rank, id of the merged part)
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        # By id: decimal digits and a comma, padded with zero bytes; the bytes of the token.
        self._decimal = np.array([f"{i}," for i in range(max(self.bytes_of) + 1)], "S")
        self._raw = np.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], object)
        marks = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self._piece = regex.compile(PIECES)
        self._spaces = regex.compile(rf" [{WHITE}]| $")
        self._chunk = regex.compile(rf" (?=[^{WHITE}])")
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        keys = sorted(self.merge)
        self._keys = np.array(keys, np.int64)
        self._rank = np.array([self.merge[k][0] for k in keys], np.int32)
        self._made = np.zeros(len(keys), np.int64)  # by rank
        self._made[self._rank] = [self.merge[k][1] for k in keys]
        self._of_byte = np.array(self.of_byte, np.int64)
        self._of_bytes = self._ranks(self._of_byte[:, None], self._of_byte[None, :])
        self._path, self._library = path, None

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in the merge table and whether it is there."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return at, self._keys[at] == key

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self._pair(left, right)
        return np.where(there, self._rank[at], NEVER)

    def _scan(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Merge by scanning the rank arrays of short words of about the same length, all at once.

        Row k of ``part`` and ``rank`` is the array pair of word k: parts from the left without gaps,
        the rank of each with its right neighbour. Unused places hold part 0 and rank NEVER.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        part = np.zeros((len(words), width), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        part[np.arange(width) < size[:, None]] = self._of_byte[data]
        rank = np.full((len(words), width), NEVER, np.int32)
        # In the row of all words the pairs that reach into the next word are left out.
        pairs = self._of_bytes[data[:-1], data[1:]]
        within = np.ones(len(data), bool)
        within[np.cumsum(size) - 1] = False
        rank[:, :-1][np.arange(width - 1) < size[:, None] - 1] = pairs[within[:-1]]
        out: list[tuple[int, ...]] = [()] * len(words)
        row, column = np.arange(len(words)), np.arange(width)
        while len(row):
            i = rank.argmin(axis=1)
            here = np.arange(len(row))
            going = rank[here, i] != NEVER
            if not going.all():
                for k, n, ids in zip(row[~going].tolist(), size[~going].tolist(), part[~going].tolist()):
                    out[k] = tuple(ids[:n])
                part, rank, size, row, i = part[going], rank[going], size[going], row[going], i[going]
                here = np.arange(len(row))
                if not len(row):
                    break
            merged = self._made[rank[here, i]]
            # Delete the boundary after part i: what follows moves one place to the left.
            source = np.minimum(column + (column > i[:, None]), width - 1)
            part = np.take_along_axis(part, source, 1)
            rank = np.take_along_axis(rank, np.minimum(column + (column >= i[:, None]), width - 1), 1)
            rank[:, -1] = NEVER
            part[here, i] = merged
            size -= 1
            # Refresh the two ranks beside it.
            for at, valid in ((i - 1, i > 0), (i, i < size - 1)):
                k, j = here[valid], at[valid]
                rank[k, j] = self._ranks(part[k, j], part[k, j + 1])
            rank[here[i >= size - 1], i[i >= size - 1]] = NEVER
        return out

    def _heap(self, word: bytes) -> list[int]:
        """Merge a long word: candidate pairs in a heap by (rank, place), parts in a linked list."""
        n = len(word)
        part = [self.of_byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, queue = self.merge, []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n and (found := rank_of.get(part[i] << 32 | part[after[i]])):
                queue.append((found[0], i, part[i], part[after[i]]))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i] if part[i] >= 0 else n
            if part[i] != left or j >= n or part[j] != right:
                continue  # one of the two has merged meanwhile
            part[i], part[j] = rank_of[left << 32 | right][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                size = len(queue)
                offer(k)
                if len(queue) > size:
                    heapq.heappush(queue, queue.pop())
        return [p for p in part if p >= 0]

    def words_ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words: short ones by rank arrays, those of about the same length together, long ones by heap."""
        data = [word.encode() for word in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out: list[tuple[int, ...]] = [()] * len(data)
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], [2, *range(5, SHORT + 1, 4), SHORT + 1]).tolist()
        order = order.tolist()
        for k in order[: bounds[0]]:
            out[k] = (self.of_byte[data[k][0]],)
        for low, high in zip(bounds, bounds[1:]):
            for k in range(low, high, SCANNED):
                some = order[k : min(k + SCANNED, high)]
                for i, ids in zip(some, self._scan([data[i] for i in some])):
                    out[i] = ids
        for k in order[bounds[-1] :]:
            out[k] = tuple(self._heap(data[k]))
        return out

    def _learn(self, chunks: list[str], lead: str, into: dict[str, tuple[int, ...]]) -> None:
        """Ids of distinct chunks with ``lead`` before them, into a cache."""
        findall = self._piece.findall
        if has_newer("".join(chunks)):
            # Characters newer than this Python: their class is the one the tokenizers library has.
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self._path).pre_tokenizer
            cut = self._library.pre_tokenize_str
            findall = lambda c: [c[a:b] for _, (a, b) in cut(c)] if has_newer(c) else self._piece.findall(c)
        # Letters alone are one word of the pattern.
        whole, others = [c for c in chunks if c.isalpha()], [c for c in chunks if not c.isalpha()]
        words_of = [findall(lead + c) for c in others]
        words = [lead + c for c in whole]
        words += set(chain.from_iterable(words_of)).difference(words)
        found = self.words_ids(words)
        into.update(zip(whole, found))
        ids = dict(zip(words, found))
        for chunk, words in zip(others, words_of):
            into[chunk] = ids[words[0]] if len(words) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, words)))

    def _chunks_of(self, pieces: list[str]) -> pa.ListArray:
        """Every piece cut before every space that a non-space follows; that space is left out."""
        odd = np.fromiter((self._spaces.search(p) is not None for p in pieces), bool, len(pieces))
        cut = pc.split_pattern(pa.array(pieces, pa.large_string()), " ")
        if not odd.any():
            return cut
        by_pattern = pa.array([self._chunk.split(pieces[k]) for k in np.flatnonzero(odd)], cut.type)
        return pa.concat_arrays([cut, by_pattern]).take(pa.array(np.where(odd, len(pieces) - 1 + np.cumsum(odd), np.arange(len(pieces)))))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text. Nothing made here refers back to itself, so cycles need not be looked for."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _ids_of(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct chunks with a space before them, from the cache if they are there."""
        if len(self._chunks) > CACHED_CHUNKS // 2:
            self._older, self._chunks = self._chunks, {}
        found, needed = list(map(self._chunks.get, chunks)), []
        missing = [k for k, ids in enumerate(found) if ids is None]
        for c in map(chunks.__getitem__, missing):
            ids = self._older.get(c)
            if ids is None:
                needed.append(c)
            else:
                self._chunks[c] = ids
        self._learn(needed, " ", self._chunks)
        for k in missing:
            found[k] = self._chunks[chunks[k]]
        for c in needed:
            if len(c) > CACHED_CHARS:
                del self._chunks[c]
        return found

    def _encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        # Pieces between special tokens, and the special tokens, each with the number of pieces before it.
        pieces, text_of, special, special_at, special_text = [], [], [], [], []
        for n, t in enumerate(texts):
            parts = self._special.split(t) if t and self._special is not None and self._special.search(t) else [t or ""]
            for k, p in enumerate(parts):
                if k % 2:
                    special.append(self.special[p])
                    special_at.append(len(pieces))
                    special_text.append(n)
                else:
                    pieces.append(p)
                    text_of.append(n)
        cut = self._chunks_of(pieces)
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        text_of = np.repeat(np.array(text_of), np.diff(offsets))
        # Numbers of what stands in the texts: chunks with a space before them, first chunks of pieces, special tokens.
        firsts, first_number = np.unique(code[offsets[:-1]], return_inverse=True)
        first: dict[str, tuple[int, ...]] = {"": ()}
        self._learn([distinct[c] for c in firsts.tolist() if distinct[c]], "", first)
        held = self._ids_of(distinct) + [first[distinct[c]] for c in firsts.tolist()]
        number = code.copy()
        number[offsets[:-1]] = len(distinct) + first_number
        if special:
            at = np.append(offsets[:-1], len(code))[special_at]
            number, text_of = np.insert(number, at, len(held) + np.arange(len(special))), np.insert(text_of, at, special_text)
            held += [(i,) for i in special]
        # Their ids in a row, and from there to the places in the texts.
        size = np.fromiter(map(len, held), np.int64, len(held))
        ids = np.fromiter(chain.from_iterable(held), np.int32, int(size.sum()))
        start, size_at = (np.cumsum(size) - size)[number], size[number]
        end = np.cumsum(size_at)
        ids = ids[np.repeat(start - end + size_at, size_at) + np.arange(end[-1])]
        # ``text_of`` rises, and every text has a chunk.
        last = np.searchsorted(text_of, np.arange(len(texts)), "right") - 1
        return np.split(ids, end[last[:-1]])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and ids.min() < 0:
            raise KeyError(int(ids.min()))
        return b"".join(self._raw[ids].tolist()).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._decimal[ids].tobytes().replace(b"\0", b"")[:-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker; workers are kept between tasks."""
    return Vocabulary(path)


def batches(rows: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text (a single row may be longer)."""
    for batch in rows:
        lengths = [len(t) if t is not None else 0 for t in batch.column(column).to_pylist()] if batch.nbytes > BATCH_CHARS else []
        if not lengths:
            yield batch
            continue
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > BATCH_CHARS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def _with_columns(df: DataFrame, text: str, add: list[T.StructField], make: Callable[[list], list]) -> DataFrame:
    """``df`` without ``text`` and with the columns that ``make`` gives for its values."""
    keep = [c for c in df.columns if c not in (text, *(f.name for f in add))]
    schema = T.StructType([df.schema[c] for c in keep] + add)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches(rows, text):
            made = make(batch.column(text).to_pylist())
            arrays = [batch.column(c) for c in keep] + [pa.array(v, arrow.field(f.name).type) for v, f in zip(made, add)]
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(i).type) for i, a in enumerate(arrays)], schema=arrow)

    return df.select(*keep, text).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replaces ``text`` by ids (array of int) and n_tokens (long)."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())]

    def make(texts: list) -> list:
        ids = vocabulary(path).encode_batch(texts)
        return [ids, list(map(len, ids))]

    return _with_columns(df, text, fields, make)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Replaces ``ids`` by decoded (string); bytes that are no UTF-8 become U+FFFD, a null list an empty text."""
    fields = [T.StructField("decoded", T.StringType())]
    keep = [c for c in df.columns if c not in (ids, "decoded")]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in rows:
            texts = [vocabulary(path).decode(x or []) for x in batch.column(ids).to_pylist()]
            arrays = [batch.column(c) for c in keep] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(i).type) for i, a in enumerate(arrays)], schema=arrow)

    return df.select(*keep, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes, decodes the ids again and keeps digests in place of both, so that no ids leave the task.

    Adds n_tokens (long), ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    decoded text in UTF-8), both in lower-case hex.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(texts: list) -> list:
        vocab, out = vocabulary(path), ([], [], [])
        for ids in vocab.encode_batch(texts):
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(vocab.decimals(ids)).hexdigest())
            out[2].append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
        return list(out)

    return _with_columns(df, text, fields, make)
