"""Byte-level BPE encoding and decoding as a monoid tree.

A text is halved down to leaves, leaves are encoded on their own, and neighbours are joined.
Two levels make every join exact:

* Text. A whitespace run that follows a non-space character always starts a match of the
  pattern, whatever stands before or after (no alternative of it continues into white space).
  A node holds the chunks between such places; a join glues the last chunk of the left to the
  first of the right and cuts again, so its window grows to the next provable border.
* Long matches without any border (a megabyte of letters). Token lists are joined by encoding
  the last and first ``k`` tokens again, ``k`` doubling until the window's outer tokens are
  compatible with their neighbours. A token sequence is the encoding of its bytes exactly if
  each adjacent pair is the encoding of its own bytes, so tokens outside cannot change.

Decoding concatenates the bytes of tokens up the same kind of tree.

Defined cases: NULL and empty texts have no tokens; repeated rows are encoded each; an empty
table gives no rows; other columns are not read unless named in ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltmark.llm.workers import task

#: Characters of a text leaf, bytes of a leaf inside one match.
LEAF, PIECE_LEAF = 4096, 512
#: Chunks up to this many characters are cached, this many at most.
CHUNK, CACHED = 64, 200_000
#: Tokens per batch that is handed back to Spark.
BATCH_TOKENS = 1_000_000

_IRREGULAR = re.compile(r"\s(?= )|^ ")
_BORDER = re.compile(r"(?<=\S)(?=\s)")


class Codec:
    """Ranks and pattern of one vocabulary. Built once per worker process from its file."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes[r] = b
        self.longest = max(map(len, ranks))
        self.cache: dict[str, bytes] = {}

    # Inside one match of the pattern.

    def _compatible(self, a: int, b: int) -> bool:
        return self.bpe._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = b"".join(map(self.bytes.__getitem__, left[a:] + right[:b]))
            middle = self.bpe._encode_single_piece(window)
            if (not a or self._compatible(left[a - 1], middle[0])) and (b == len(right) or self._compatible(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            k *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        """The tokens of one match."""
        if len(data) <= max(PIECE_LEAF, self.longest):
            return self.bpe._encode_single_piece(data)
        mid = len(data) // 2
        return self.join_tokens(self.encode_piece(data[:mid]), self.encode_piece(data[mid:]))

    # Over a whole text.

    def encode_chunk(self, chunk: str) -> bytes:
        """The tokens of a text between two borders, as little-endian unsigned 32-bit integers."""
        ids = self.cache.get(chunk)
        if ids is None:
            if len(chunk) <= PIECE_LEAF:
                found = self.bpe.encode_ordinary(chunk)
            else:
                found = [t for piece in self.pattern.findall(chunk) for t in self.encode_piece(piece.encode())]
            ids = np.asarray(found, dtype="<u4").tobytes()
            if len(chunk) <= CHUNK:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[chunk] = ids
        return ids

    def chunks(self, text: str) -> list[str]:
        """The text cut at its provable borders before blanks (cutting at fewer is also right)."""
        if _IRREGULAR.search(text):
            return [c for c in _BORDER.split(text) if c]
        first, *rest = text.split(" ")
        return [c for c in (first, *[" " + p for p in rest]) if c]

    def _tree(self, text: str) -> list[str]:
        if len(text) <= LEAF:
            return self.chunks(text)
        mid = len(text) // 2
        left, right = self._tree(text[:mid]), self._tree(text[mid:])
        left[-1:] = self.chunks(left[-1] + right[0])
        left += right[1:]
        return left

    def encode(self, text: str) -> bytes:
        cache, encode = self.cache, self.encode_chunk
        return b"".join([cache.get(c) or encode(c) for c in self._tree(text)])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _rows(batches: Iterator[pa.RecordBatch], name: str, size) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches whose values of ``name`` come to about ``BATCH_TOKENS`` in ``size``."""
    for batch in batches:
        values, start, total = batch.column(batch.schema.get_field_index(name)), 0, 0
        for i, v in enumerate(values):
            total += size(v)
            if total >= BATCH_TOKENS or i + 1 == len(values):
                yield batch.slice(start, i + 1 - start), values.slice(start, i + 1 - start)
                start, total = i + 1, 0


def _replaced(batch: pa.RecordBatch, name: str, new: str, values: pa.Array, drop: bool) -> pa.RecordBatch:
    cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if not (drop and f.name == name)}
    return pa.RecordBatch.from_pydict(cols | {new: values})


def _encoded(ranks_path: str, pattern: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch, values in _rows(batches, text, lambda v: len(v.as_buffer() or b"") if v.is_valid else 0):
            parts = [c.encode(v or "") for v in values.to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype("i4")
            flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
            yield _replaced(batch, text, "ids", pa.ListArray.from_arrays(pa.array(offsets), flat), drop=True)

    return run


def _decoded(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch, values in _rows(batches, "ids", lambda v: len(v.values) if v.is_valid else 0):
            flat = values.flatten().to_numpy(zero_copy_only=False)
            sizes = [len(v.values) if v.is_valid else 0 for v in values]
            ends = np.cumsum(sizes)
            out = [c.decode(flat[e - n : e].tolist()) for n, e in zip(sizes, ends)]
            yield _replaced(batch, "ids", "decoded", pa.array(out, pa.binary()), drop=False)

    return run


def _both(ranks_path: str, pattern: str, text: str):
    first, second = _encoded(ranks_path, pattern, text), _decoded(ranks_path, pattern)
    return lambda batches: second(first(batches))


def _schema(df: DataFrame, drop: str | None, *added: T.StructField) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != drop] + list(added))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), True))
DECODED = T.StructField("decoded", T.BinaryType())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every row. No shuffle; memory is one batch of texts."""
    rows = df.select(*keep, text)
    return rows.mapInArrow(task(_encoded, ranks_path, pattern, text), _schema(rows, text, IDS))


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of ``df`` with ``decoded``, the bytes of their ``ids`` (NULL ids: no bytes)."""
    return df.mapInArrow(task(_decoded, ranks_path, pattern), _schema(df, None, DECODED))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``decode(encode(df))`` in one pass through one worker."""
    rows = df.select(*keep, text)
    return rows.mapInArrow(task(_both, ranks_path, pattern, text), _schema(rows, text, IDS, DECODED))
